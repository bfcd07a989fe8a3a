"""Format-preserving pseudonyms for personal data.

Numbers and dates in the text that pass validation (and e-mail names and hex secrets) are replaced
by a keyed permutation within their own format: an unbalanced Feistel network over the digits, with
SHA-256 of key, kind, length, round and the other half as its round function.  A permutation keeps
distinct values distinct and gives equal values equal pseudonyms in every document.  Where a format
has invalid members (dates, security numbers), the permutation is applied again until it lands on a
valid one, which keeps it a permutation.  A day has one pseudonym, in whatever notation it is written.

Kinds: email (the name, by segments of letters and digits in base 36; lower-cased), phone (the last
ten digits of (ddd) ddd-dddd, ddd-ddd-dddd, ddd.ddd.dddd and of + with 8 to 15 digits in groups or
none), card (13 to 19 digits in one run, in fours, or as 4-6-5, that pass the Luhn test; its check digit
is computed anew), ipv4, date (1900-01-01 to 2099-12-31: yyyy-mm-dd, also before a time, d/m/yyyy, and
m/d/yyyy where the day is above 12; if that of its pseudonym is not, it is written d/m/yyyy, as it would be read),
ssn (ddd-dd-dddd), secret (24 to 128 hex digits; letters take the case of the secret, in mixed ones that of their
place).  Not recognised: bare runs of digits that are no card, IBANs, names, addresses, IPv6,
dates with month names or two-digit years.

The key comes from the caller; who has it can invert the pseudonyms, so it is no constant here.  It
reaches the rows as a column of a one-row table, so no plan, log or page of Spark shows it.

Only DataFrame functions are used: the text is split at the matches and joined again around their
pseudonyms, row by row, without a shuffle.

Defined results for odd input: a null text stays null with no findings; text without findings stays
as it is; repeated rows are each rewritten alike; any length is processed whole; all other columns
of the input are passed on, except those named ``findings``, which is replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import let

KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?!\d)|(?<![\w.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)",
    "date": r"(?<![\w/.-])(?:19|20)\d\d-[01]\d-[0-3]\d(?=T\d\d:|(?![\w/-]))|(?<![\w/.-])[0-3]?\d/[0-3]?\d/(?:19|20)\d\d(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "secret": r"(?<!\w)(?=[A-Fa-f]*\d)[0-9A-Fa-f]{24,128}(?!\w)",
}
ROUNDS = 8
#: So many digits at most go through the network at once, so that the halves fit a bigint.
CHUNK = {10: 34, 16: 28, 36: 22}


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(s: str, radix: int) -> str:
    return f"coalesce(cast(conv(nullif({s}, ''), {radix}, 10) AS bigint), 0)"


def _digits(n: str, size: str, radix: int) -> str:
    return f"lpad(lower(conv(cast({n} AS string), 10, {radix})), {size}, '0')"


def feistel(s: str, radix: int, key: str, tweak: str) -> str:
    """SQL: the keyed permutation of a digit string s of at most CHUNK[radix] digits, lower case; key: SQL of the key."""

    def f(half: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, length(s), i, {half}), 256), 1, 15), 16, 10) AS bigint)"

    left, right = "(length(s) div 2)", "(length(s) - length(s) div 2)"
    ml, mr = (f"cast(power({radix}, cast({x} AS int)) AS bigint)" for x in (left, right))
    body = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {_number(f'substr(s, 1, cast({left} AS int))', radix)}, 'r', {_number(f'substr(s, cast({left} AS int) + 1)', radix)}), "
        f"(h, i) -> IF(i % 2 = 1, named_struct('l', (h.l + pmod({f('h.r')}, {ml})) % {ml}, 'r', h.r), named_struct('l', h.l, 'r', (h.r + pmod({f('h.l')}, {mr})) % {mr})), "
        f"h -> concat(IF({left} = 0, '', {_digits('h.l', f'cast({left} AS int)', radix)}), {_digits('h.r', f'cast({right} AS int)', radix)}))"
    )
    return let("s", f"lower({s})", body)


def permute(s: str, radix: int, key: str, tweak: str) -> str:
    """SQL: the permutation of a digit string of any length, by chunks."""
    if radix == 36:  # one digit would only be rotated; as two of base 6 it has two halves
        pair = f"lpad(conv({s}, 36, 6), 2, '0')"
        return f"IF(length({s}) = 1, lower(conv({feistel(pair, 6, key, tweak)}, 6, 36)), {_chunks(s, radix, key, tweak)})"
    return _chunks(s, radix, key, tweak)


def _chunks(s: str, radix: int, key: str, tweak: str) -> str:
    size = CHUNK[radix]
    return (
        f"IF(length({s}) <= {size}, {feistel(s, radix, key, tweak)}, array_join(transform(sequence(0, cast((length({s}) - 1) div {size} AS int)), "
        f"j -> {feistel(f'substr({s}, j * {size} + 1, {size})', radix, key, f'concat({tweak}, j)')}), ''))"
    )


def walk(s: str, valid, step) -> str:
    """SQL: step applied to s once, and again while the result is not valid; an error after 200 more steps, as any other value would be no permutation."""
    return f"aggregate(sequence(1, 200), {step(s)}, (w, t) -> IF({valid('w')}, w, {step('w')}), w -> IF({valid('w')}, w, raise_error('no valid pseudonym')))"


def fill(template: str, digits: str) -> str:
    """SQL: template with its digits replaced by the given ones in turn."""
    return (
        f"array_join(transform(sequence(1, length({template})), p -> IF(substr({template}, p, 1) RLIKE '[0-9]', "
        f"substr({digits}, length(regexp_replace(substr({template}, 1, p), '[^0-9]', '')), 1), substr({template}, p, 1))), '')"
    )


def luhn_sum(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum; doubled: 1 if the last digit is doubled, else 0."""
    d = f"cast(substr({digits}, length({digits}) - q, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, q) -> a + IF(q % 2 = {0 if doubled else 1}, IF({d} > 4, {d} * 2 - 9, {d} * 2), {d}))"


DAYS = 73049  # from 1900-01-01 to 2099-12-31


#: The column that holds the key while texts are rewritten.
KEY = "`__pseudonym_key`"


def pseudonyms(key: str = KEY) -> dict[str, tuple[str, str]]:
    """For each kind the SQL of (is m valid, the pseudonym of m); key: SQL of the key."""
    only = r"regexp_replace(m, '[^0-9]', '')"
    local = "substring_index(m, '@', 1)"
    email = (
        f"concat(array_join(transform(regexp_extract_all(lower({local}), '[a-z0-9]+|[^a-z0-9]+', 0), g -> IF(g RLIKE '^[a-z0-9]', {permute('g', 36, key, _quote('email'))}, g)), ''), "
        f"'@', substring_index(m, '@', -1))"
    )
    phone = let("d", only, fill("m", f"concat(substr(d, 1, greatest(0, length(d) - 10)), {permute('substr(d, greatest(1, length(d) - 9))', 10, key, _quote('phone'))})"))
    card = let(
        "d", only,
        let("b", permute("substr(d, 1, length(d) - 1)", 10, key, _quote("card")), fill("m", f"concat(b, cast((10 - {luhn_sum('b', 1)} % 10) % 10 AS string))")),
    )
    octets = "split(m, '[.]')"
    packed = f"array_join(transform({octets}, o -> lpad(lower(hex(cast(o AS int))), 2, '0')), '')"
    ipv4 = let("x", permute(packed, 16, key, _quote("ipv4")), "array_join(transform(sequence(0, 3), z -> conv(substr(x, z * 2 + 1, 2), 16, 10)), '.')")
    first = "coalesce(try_to_timestamp(m, 'yyyy-MM-dd'), try_to_timestamp(m, 'd/M/yyyy'))"  # the day first, if that can be
    day = f"coalesce({first}, try_to_timestamp(m, 'M/d/yyyy'))"
    number = f"lpad(cast(datediff({day}, date'1900-01-01') AS string), 5, '0')"

    moved = f"date_add(date'1900-01-01', cast({walk(number, lambda w: f'cast({w} AS int) < {DAYS}', lambda w: permute(w, 10, key, _quote('date')))} AS int))"
    day_first, month_first = "IF(length(m) = 10, 'dd/MM/yyyy', 'd/M/yyyy')", "IF(length(m) = 10, 'MM/dd/yyyy', 'M/d/yyyy')"
    own = f"CASE WHEN m LIKE '____-__-__' THEN 'yyyy-MM-dd' WHEN {first} IS NULL AND day(t) > 12 THEN {month_first} ELSE {day_first} END"
    date = let("t", moved, f"date_format(t, {own})")
    sound = lambda s: f"NOT ({s} RLIKE '^(000|666|9)') AND substr({s}, 4, 2) <> '00' AND substr({s}, 6) <> '0000'"
    ssn = fill("m", walk(only, sound, lambda w: permute(w, 10, key, _quote("ssn"))))
    placed = "array_join(transform(sequence(1, length(m)), p -> IF(substr(m, p, 1) RLIKE '[A-Z]', upper(substr(x, p, 1)), substr(x, p, 1))), '')"
    secret = let("x", permute("m", 16, key, _quote("secret")), f"CASE WHEN m = lower(m) THEN x WHEN m = upper(m) THEN upper(x) ELSE {placed} END")
    return {
        "email": ("true", email),
        "phone": (f"length({only}) BETWEEN 8 AND 15", phone),
        "date": (f"{day} IS NOT NULL", date),
        "ssn": (sound(only), let("n", ssn, "n")),
        "ipv4": (f"NOT exists({octets}, o -> cast(o AS int) > 255)", ipv4),
        "card": (f"{luhn_sum(only, 0)} % 10 = 0", card),
        "secret": ("true", secret),
    }


def session_key(spark: SparkSession) -> str:
    """The key that the session names in spark.opsloom.pseudonyms.secret (Spark hides settings of that name); if it names none, a random one for the session."""
    name = "spark.opsloom.pseudonyms.secret"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def pseudonymise(docs: DataFrame, *, key: str) -> DataFrame:
    """docs with text rewritten and findings, an array of (kind, pseudonym) in the order of the text."""
    pattern = "|".join(f"(?:{p})" for p in KINDS.values())
    cases = []
    rules = pseudonyms()
    for kind, regex in KINDS.items():
        valid, new = rules[kind]
        cases.append(f"WHEN m RLIKE {_quote('^(?:' + regex + ')$')} THEN IF({valid}, named_struct('kind', '{kind}', 'pseudonym', {new}), NULL)")
    one = f"CASE {' '.join(cases)} END"
    others = [f"`{c}`" for c in docs.columns if c.lower() not in ("findings", "text")]
    parts = f"split(text, {_quote(pattern)}, -1)"
    # Split leaves one part more than there are matches.
    joined = f"array_join(flatten(zip_with({parts}, zip_with(ms, ps, (m, p) -> coalesce(p.pseudonym, m)), (a, b) -> array(a, coalesce(b, '')))), '')"
    rewritten = let("ps", f"transform(ms, m -> {one})", f"named_struct('text', {joined}, 'findings', filter(ps, p -> p IS NOT NULL))")
    none = "named_struct('text', text, 'findings', cast(array() AS array<struct<kind:string,pseudonym:string>>))"
    known = docs.sparkSession.createDataFrame([(key,)], f"{KEY} string")
    told = docs.crossJoin(F.broadcast(known)).selectExpr(*others, let("ms", f"IF(text RLIKE '[0-9@]', regexp_extract_all(text, {_quote(pattern)}, 0), array())", f"IF(size(ms) = 0, {none}, {rewritten})") + " AS __t")
    out = told.selectExpr(*others, "__t.text AS text", "__t.findings AS findings")
    return out.select(*(c for c in docs.columns if c.lower() != "findings"), "findings")
