"""JSON Schema compiled to one expression over a table's rows: structs, lists and maps to any depth.

Each row gets a list of issues such as `resources.gpus[].count: below 1`; [] stands for the places of a list,
so issues can be counted by name.  All rules are one expression, so a table is read once however many there are.

* A null is an absent value: it breaks `required` and nothing else.
* Structs and maps with string keys are objects.  Times and dates are strings with a format; `timestamp` is a type too.
* An integer is any number without a fraction, so a column of doubles may hold integers.
* Keywords that no rule here covers are an error, not ignored; annotations are known as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NullType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

# Keywords of JSON Schema that say nothing about a value.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
#: Keywords that are compiled.
KEYWORDS = {
    "$ref", "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format",
    "items", "minItems", "maxItems", "uniqueItems", "properties", "required", "additionalProperties", "dependentRequired", "minProperties", "maxProperties",
    "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "uuid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
}


def _kind(t: DataType) -> str:
    if isinstance(t, (TimestampType, TimestampNTZType, DateType)):
        return "timestamp"
    if isinstance(t, StructType) or (isinstance(t, MapType) and isinstance(t.keyType, StringType)):
        return "object"
    for kind, of in (("string", StringType), ("boolean", BooleanType), ("array", ArrayType), ("number", NumericType), ("null", NullType)):
        if isinstance(t, of):
            return kind
    return t.typeName()


def _whole(t: DataType) -> bool:
    return t.typeName() in ("byte", "short", "integer", "long") or (t.typeName() == "decimal" and t.scale <= 0)


def _none() -> Column:
    return F.array().cast("array<string>")


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


class Compiler:
    """Compiles the rules of one schema document; formats: whether `format` is a rule or an annotation."""

    def __init__(self, schema: dict, *, formats: bool = True):
        self.schema, self.formats = schema, formats

    def table(self, df: DataFrame, *, types: bool = True) -> Column:
        """An array with what is wrong with a row; types=False leaves the columns' own types to a check without rows."""
        fields = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
        return F.array_distinct(self._row(self.schema, fields, types, ()))

    def _row(self, rule: dict | bool, fields: dict, types: bool, open_refs: tuple) -> Column:
        """The issues of a whole row under a rule."""
        if isinstance(rule, bool):
            return _none() if rule else F.array(F.lit("row: not allowed"))
        parts = self._object(rule, fields, None, F.lit(True), "", types)
        if "$ref" in rule:
            if rule["$ref"] in open_refs:
                raise ValueError(f"{rule['$ref']} refers to itself")
            parts.append(self._row(self._target(rule["$ref"]), fields, True, (*open_refs, rule["$ref"])))
        return _all(parts + self._combined(rule, lambda r: self._row(r, fields, True, open_refs)))

    def value(self, rule: dict | bool, v: Column, t: DataType, path: str, *, types: bool = True, open_refs: tuple = ()) -> Column:
        """The issues of a value under a rule."""
        if isinstance(rule, bool):
            return _none() if rule else F.when(v.isNotNull(), F.array(F.lit(f"{path}: not allowed"))).otherwise(_none())
        self._known(rule)
        parts = self._plain(rule, v, t, path, types)
        kind = _kind(t)
        if kind == "array":
            parts += self._list(rule, v, t, path, open_refs)
        if isinstance(t, StructType):
            parts += self._object(rule, {f.name: (v.getField(f.name), f.dataType) for f in t}, None, v.isNotNull(), path, True, open_refs)
        elif kind == "object":
            parts += self._object(rule, {}, (v, t.valueType), v.isNotNull(), path, True, open_refs)
        if "$ref" in rule:
            if rule["$ref"] in open_refs:
                raise ValueError(f"{rule['$ref']} refers to itself")
            parts.append(self.value(self._target(rule["$ref"]), v, t, path, open_refs=(*open_refs, rule["$ref"])))
        parts += self._combined(rule, lambda r: self.value(r, v, t, path, open_refs=open_refs), v, path)
        return _all(parts)

    def _known(self, rule: dict) -> None:
        if unknown := sorted(set(rule) - KEYWORDS - ANNOTATIONS):
            raise ValueError(f"no rule for {', '.join(unknown)}")

    def _target(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"{ref} is in another document")
        at = self.schema
        for step in ref[1:].strip("/").split("/") if ref.strip("#/") else []:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or step not in at:
                raise ValueError(f"{ref} leads nowhere")
            at = at[step]
        return at

    def _plain(self, rule: dict, v: Column, t: DataType, path: str, types: bool) -> list[Column]:
        kind, parts = _kind(t), []

        def broken(test: Column, what: str) -> None:
            parts.append(F.when(v.isNotNull() & test, F.array(F.lit(f"{path}: {what}"))).otherwise(_none()))

        if types and "type" in rule:
            wanted = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
            what = f"not {' or '.join(wanted)}"
            timed = kind == "timestamp" and "string" in wanted
            if kind == "number" and "number" not in wanted:
                if "integer" not in wanted:
                    broken(F.lit(True), what)
                elif not _whole(t):
                    broken(F.coalesce(v != F.floor(v), F.lit(True)) | F.isnan(v.cast("double")), what)
            elif kind not in wanted and not timed:
                broken(F.lit(True), what)
        for word, values in (("enum", rule.get("enum")), ("const", [rule["const"]] if "const" in rule else None)):
            if values is None:
                continue
            if any(isinstance(x, (dict, list)) for x in values):
                raise ValueError(f"{word} of lists or objects")
            alike = {"string": str, "boolean": bool, "number": (int, float)}.get(kind, ())
            fit = [x for x in values if isinstance(x, alike) and (kind == "boolean") == isinstance(x, bool)]
            broken(~v.isin(fit) if fit else F.lit(True), "not allowed")
        if kind == "number":
            for word, test, what in (("minimum", v.__lt__, "below"), ("maximum", v.__gt__, "above"), ("exclusiveMinimum", v.__le__, "not above"), ("exclusiveMaximum", v.__ge__, "not below")):
                if word in rule:
                    broken(test(F.lit(rule[word])), f"{what} {rule[word]}")
            if "multipleOf" in rule:
                broken(F.try_mod(v.cast("decimal(38,9)"), F.lit(str(rule["multipleOf"])).cast("decimal(38,9)")) != 0, f"no multiple of {rule['multipleOf']}")
        if kind == "string":
            if "minLength" in rule:
                broken(F.length(v) < rule["minLength"], f"shorter than {rule['minLength']}")
            if "maxLength" in rule:
                broken(F.length(v) > rule["maxLength"], f"longer than {rule['maxLength']}")
            if "pattern" in rule:
                broken(~v.rlike(rule["pattern"]), "malformed")
            if self.formats and rule.get("format") in FORMATS:
                ok = v.rlike(FORMATS[rule["format"]])
                if rule["format"] in ("date", "date-time"):
                    ok &= F.substring(v, 1, 10).try_cast("date").isNotNull()  # the day is in its month
                broken(~ok, f"no {rule['format']}")
        return parts

    def _list(self, rule: dict, v: Column, t: ArrayType, path: str, open_refs: tuple) -> list[Column]:
        parts = []
        for word, test, what in (("minItems", F.size(v).__lt__, "fewer than {} items"), ("maxItems", F.size(v).__gt__, "more than {} items")):
            if word in rule:
                parts.append(F.when(v.isNotNull() & test(rule[word]), F.array(F.lit(f"{path}: {what.format(rule[word])}"))).otherwise(_none()))
        if rule.get("uniqueItems"):
            parts.append(F.when(v.isNotNull() & (F.size(F.array_distinct(v)) < F.size(v)), F.array(F.lit(f"{path}: repeated items"))).otherwise(_none()))
        if "items" in rule:
            each = F.flatten(F.transform(v, lambda x: self.value(rule["items"], x, t.elementType, f"{path}[]")))
            parts.append(F.coalesce(F.array_distinct(each), _none()))
        return parts

    def _object(self, rule: dict, fields: dict, entries: tuple | None, there: Column, path: str, types: bool, open_refs: tuple = ()) -> list[Column]:
        """Rules of an object: a struct's (or table's) fields, or a map as (column, type of values)."""
        self._known(rule)
        under = lambda name: f"{path}.{name}" if path else name
        named = rule.get("properties", {})

        def get(name: str) -> tuple[Column, DataType]:
            if entries is not None:
                return F.try_element_at(entries[0], F.lit(name)), entries[1]
            return fields.get(name, (F.lit(None).cast("string"), NullType()))

        def told(test: Column, text: str) -> Column:
            return F.when(there & test, F.array(F.lit(text))).otherwise(_none())

        parts = [told(get(name)[0].isNull(), f"{under(name)}: required") for name in rule.get("required", []) if types or name in fields]
        for name, needs in rule.get("dependentRequired", {}).items():
            parts += [told(get(name)[0].isNotNull() & get(other)[0].isNull(), f"{under(other)}: required with {name}") for other in needs]
        for name, below in named.items():
            v, t = get(name)
            if not isinstance(t, NullType):
                parts.append(self.value(below, v, t, under(name), types=types))
        more = rule.get("additionalProperties", True)
        if more is not True:
            if entries is not None:
                m, t = entries
                others = F.map_filter(m, lambda k, x: ~k.isin(list(named)) & x.isNotNull()) if named else F.map_filter(m, lambda k, x: x.isNotNull())
                if more is False:
                    parts.append(told(F.size(others) > 0, f"{under('*')}: not expected"))
                else:
                    each = F.flatten(F.transform(F.map_values(others), lambda x: self.value(more, x, t, under("*"))))
                    parts.append(F.coalesce(F.array_distinct(each), _none()))
            else:
                for name, (v, t) in fields.items():
                    if name not in named:
                        parts.append(told(v.isNotNull(), f"{under(name)}: not expected") if more is False else self.value(more, v, t, under(name)))
        for word, test, what in (("minProperties", Column.__lt__, "fewer than"), ("maxProperties", Column.__gt__, "more than")):
            if word in rule:
                filled = F.size(F.map_filter(entries[0], lambda k, x: x.isNotNull())) if entries is not None else sum((v.isNotNull().cast("int") for v, _ in fields.values()), F.lit(0))
                parts.append(told(test(filled, F.lit(rule[word])), f"{path or 'row'}: {what} {rule[word]} properties"))
        return parts

    def _combined(self, rule: dict, issues, v: Column | None = None, path: str = "") -> list[Column]:
        """allOf, anyOf, oneOf, not, if; issues(rule) of the same value.  A null meets them all."""
        there, name, parts = F.lit(True) if v is None else v.isNotNull(), path or "row", []
        fits = lambda r: F.size(issues(r)) == 0

        def told(test: Column, text: str) -> None:
            parts.append(F.when(there & test, F.array(F.lit(f"{name}: {text}"))).otherwise(_none()))

        parts += [issues(r) for r in rule.get("allOf", [])]
        if "anyOf" in rule:
            told(~F.greatest(F.lit(False), *map(fits, rule["anyOf"])), "fits no alternative")
        if "oneOf" in rule:
            told(sum((fits(r).cast("int") for r in rule["oneOf"]), F.lit(0)) != 1, "fits not exactly one alternative")
        if "not" in rule:
            told(fits(rule["not"]), "fits what it must not")
        if "if" in rule:
            yes, no = (issues(rule[w]) if w in rule else _none() for w in ("then", "else"))
            parts.append(F.when(there & fits(rule["if"]), yes).when(there, no).otherwise(_none()))
        return parts


def row_issues(df: DataFrame, schema: dict, *, formats: bool = True, types: bool = True) -> Column:
    """An array with what is wrong with each row of df under a JSON Schema of an object."""
    return Compiler(schema, formats=formats).table(df, types=types)
