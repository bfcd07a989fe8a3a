"""The compiled schema against a plain checker of JSON values."""

import json
import random
import re

import pytest

from opsloom.plans import rules

SCHEMA = {
    "$schema": "x", "type": "object", "required": ["id", "when"], "additionalProperties": False,
    "$defs": {
        "size": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9},
        "node": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2, "pattern": "^n"}, "gpus": {"type": "array", "items": {"$ref": "#/$defs/size"}, "maxItems": 2, "uniqueItems": True}}, "additionalProperties": False},
    },
    "properties": {
        "id": {"type": ["string", "integer"]}, "when": {"type": "string", "format": "date-time"}, "kind": {"enum": ["a", "b", 3]},
        "nodes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/node"}}, "first": {"$ref": "#/$defs/node"},
        "labels": {"type": "object", "properties": {"x": {"const": "1"}}, "additionalProperties": {"maxLength": 2}},
        "load": {"anyOf": [{"type": "integer"}, {"minimum": 100}]}, "part": {"oneOf": [{"pattern": "a"}, {"pattern": "b"}], "not": {"const": "az"}},
    },
    "if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["load"]}, "else": {"required": ["part"]},
    "dependentRequired": {"first": ["nodes"]},
}
DDL = "id bigint, when string, kind string, nodes array<struct<name string, gpus array<double>, extra string>>, first struct<name string, gpus array<double>, extra string>, labels map<string,string>, load double, part string, more string"


def fits(rule, v):
    """Whether a JSON value fits; nulls are absent."""
    if v is None:
        return True
    if isinstance(rule, bool):
        return rule
    if "$ref" in rule and not fits(SCHEMA["$defs"][rule["$ref"].split("/")[-1]], v):
        return False
    number, text = isinstance(v, (int, float)), isinstance(v, str)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": text, "number": number, "integer": number and v == int(v)}
    if "type" in rule and not any(kinds[k] for k in ([rule["type"]] if isinstance(rule["type"], str) else rule["type"])):
        return False
    ok = [v in rule.get("enum", [v]), v == rule.get("const", v)]
    if number:
        ok += [v >= rule.get("minimum", v), v < rule.get("exclusiveMaximum", v + 1)]
    if text:
        ok += [rule.get("minLength", 0) <= len(v) <= rule.get("maxLength", 99), bool(re.search(rule.get("pattern", ""), v)), "format" not in rule or v == "2024-02-29T10:00:00Z"]
    if kinds["array"]:
        ok += [rule.get("minItems", 0) <= len(v) <= rule.get("maxItems", 99), all(fits(rule.get("items", True), x) for x in v), not rule.get("uniqueItems") or all(x not in v[:i] for i, x in enumerate(v))]
    if kinds["object"]:
        o = {k: x for k, x in v.items() if x is not None}
        ok += [k in o for k in rule.get("required", [])] + [fits(r, o.get(k)) for k, r in rule.get("properties", {}).items()]
        ok += [fits(rule.get("additionalProperties", True), x) for k, x in o.items() if k not in rule.get("properties", {})]
        ok += [n in o for k, needs in rule.get("dependentRequired", {}).items() if k in o for n in needs]
    ok += ["anyOf" not in rule or any(fits(r, v) for r in rule["anyOf"]), "oneOf" not in rule or sum(fits(r, v) for r in rule["oneOf"]) == 1, "not" not in rule or not fits(rule["not"], v)]
    if "if" in rule:
        ok.append(fits(rule.get("then" if fits(rule["if"], v) else "else", True), v))
    return all(ok)


def made(rng):
    node = lambda: rng.choice([None, {"name": rng.choice(["n1", "n2", "x1", "n", None]), "gpus": rng.choice([None, [], [1.0], [2.0, 2.0], [0.5], [1.0, 9.0], [1.0, 2.0, 3.0], [None]]), "extra": rng.choice([None] * 9 + ["e"])}])
    return {
        "id": rng.choice([1, 2, 3, None]), "when": rng.choice(["2024-02-29T10:00:00Z"] * 6 + ["2023-02-29T10:00:00Z", "soon", None]), "kind": rng.choice(["a", "b", None, "c"]),
        "nodes": rng.choice([None, [node()], [node(), node()], []]), "first": node(), "labels": rng.choice([None, {}, {"x": "1"}, {"x": "2"}, {"y": "12"}, {"y": "123"}, {"y": None}]),
        "load": rng.choice([None, 1.0, 1.5, 100.5]), "part": rng.choice([None, "a", "b", "ab", "c", "az"]), "more": rng.choice([None] * 9 + ["m"]),
    }


def test_against_a_plain_checker(spark):
    rng = random.Random(3)
    values = [made(rng) for _ in range(3000)]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string").selectExpr("j", f"from_json(j, '{DDL}') r").select("j", "r.*")
    got = df.select("j", rules.row_issues(df.drop("j"), SCHEMA).alias("issues")).collect()
    wrong = [(r.j, r.issues) for r in got if (not r.issues) != fits(SCHEMA, json.loads(r.j))]
    assert not wrong, wrong[:3]
    assert 20 < sum(not r.issues for r in got) < 2900
    assert {"nodes[].gpus[]: not integer", "nodes[].name: malformed", "first.extra: not expected", "labels.*: longer than 2", "labels.x: not allowed", "when: no date-time", "load: fits no alternative", "part: required"} <= {i for r in got for i in r.issues}


def test_formats_may_be_annotations_and_unknown_words_are_errors(spark):
    df = spark.createDataFrame([("soon",)], "when string")
    rule = {"properties": {"when": {"format": "date-time"}}}
    assert df.select(rules.row_issues(df, rule)).first()[0] == ["when: no date-time"] and df.select(rules.row_issues(df, rule, formats=False)).first()[0] == []
    with pytest.raises(ValueError, match="no rule for contains"):
        rules.row_issues(df, {"properties": {"when": {"contains": {}}}})
    with pytest.raises(ValueError, match="refers to itself"):
        rules.row_issues(df, {"$defs": {"a": {"$ref": "#/$defs/a"}}, "properties": {"when": {"$ref": "#/$defs/a"}}})
    with pytest.raises(ValueError, match="leads nowhere"):
        rules.row_issues(df, {"properties": {"when": {"$ref": "#/$defs/b"}}})
