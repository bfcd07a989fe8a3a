"""DuckDB SQL that gives the rows of the queries whose operators SQL can express."""

from __future__ import annotations

import string

from . import decontam, quality

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def jaccard(words: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, then what each document reaches."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"coalesce({_LOWER}, '')")} AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
s AS (SELECT doc_id, unnest(s) AS s FROM l),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN l x ON x.doc_id = i.a JOIN l y ON y.doc_id = i.b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM r JOIN both_ways x ON r.b = x.a)
SELECT l.doc_id, len(l.s)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = l.doc_id) AS component_id FROM l
"""


def quality_rules(rounds: int = 20) -> str:
    """The features, then one pair of steps for each round of expectation-maximisation."""
    names = list(quality.RULES)
    rules = ", ".join(f"{sql} AS v_{name}" for name, sql in quality.RULES.items())
    votes = ", ".join(f"v_{n}" for n in names)
    parts = [
        f"w AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents)",
        "x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5)",
        "g AS (SELECT doc_id, i, w[i:i + 4] AS s FROM x)",
        "h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1)",
        "k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h, range(5) t(o) GROUP BY doc_id)",
        r"ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w)",
        "f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, "
        r"length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, "
        f"length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words, "
        r"len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters, "
        "length(regexp_replace(text, '[^.!?]+', '', 'g')) AS n_marks FROM w JOIN ln USING (doc_id) LEFT JOIN k USING (doc_id))",
        f"v AS (SELECT *, {rules} FROM f)",
        f"p AS MATERIALIZED (SELECT {votes}, count(*) AS n FROM v GROUP BY {votes})",
        f"q0 AS MATERIALIZED (SELECT *, CASE WHEN least({votes}) > -1 THEN 0.95::DOUBLE ELSE 0.1 END AS y FROM p)",
    ]

    def odds(alias: str) -> str:
        terms = [f"ln(({alias}.g + 1) / ({alias}.t - {alias}.g + 1))"]
        for n in names:
            good, bad = f"({alias}.g - {alias}.g_{n}_0)", f"({alias}.t - {alias}.g - ({alias}.t_{n}_0 - {alias}.g_{n}_0))"
            one = {v: f"ln(({alias}.g_{n}_{k} + 0.5) / ({good} + 1)) - ln(({alias}.t_{n}_{k} - {alias}.g_{n}_{k} + 0.5) / ({bad} + 1))" for v, k in ((1, "p"), (-1, "m"))}
            terms.append(f"CASE v_{n} WHEN 1 THEN {one[1]} WHEN -1 THEN {one[-1]} ELSE 0 END")
        return " + ".join(terms)

    sums = ["sum(n * y) AS g", "sum(n)::DOUBLE AS t"]
    for n in names:
        for v, k in ((-1, "m"), (0, "0"), (1, "p")):
            sums += [f"coalesce(sum(n * y) FILTER (WHERE v_{n} = {v}), 0) AS g_{n}_{k}", f"coalesce(sum(n) FILTER (WHERE v_{n} = {v}), 0)::DOUBLE AS t_{n}_{k}"]
    for r in range(1, rounds + 1):
        parts.append(f"m{r} AS MATERIALIZED (SELECT {', '.join(sums)} FROM q{r - 1})")
        if r < rounds:
            parts.append(f"q{r} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds(f'm{r}')}))) AS y FROM p, m{r})")
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return f"WITH {', '.join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND 1 / (1 + exp(-({odds(f'm{rounds}')}))) >= 0.5 AS kept FROM v, m{rounds}"


def decontamination(window: int = 13, substitutions: int = 2) -> str:
    """Every window of every pair that shares a token, compared without masks or hashes.

    A good window begins at most ``substitutions`` places before its first common token.
    """

    def tokens(table: str, key: str) -> str:
        return rf"SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"

    return f"""
WITH d AS ({tokens('documents', 'doc_id')}), b AS ({tokens('benchmark', 'item_id')}),
dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
bt AS (SELECT item_id, len(w) AS m, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM b),
c AS (SELECT doc_id, item_id, i - j AS o, any_value(n) AS n, any_value(m) AS m, list(j) AS js FROM dt JOIN bt USING (t) GROUP BY 1, 2, 3
  HAVING count(*) >= least({window}, any_value(m)) - CASE WHEN any_value(m) < {decontam.EXACT} THEN 0 ELSE {substitutions} END),
x AS (SELECT doc_id, item_id, o, n, m, js, least({window}, m) AS win, CASE WHEN m < {decontam.EXACT} THEN 0 ELSE {substitutions} END AS most, unnest(js) AS j FROM c),
y AS (SELECT *, j - unnest(range(0, {substitutions} + 1)) AS s FROM x),
g AS (SELECT DISTINCT doc_id, item_id, o FROM y WHERE s >= greatest(1, 1 - o) AND s + win - 1 <= least(m, n - o) AND len(list_filter(js, lambda q: q >= s AND q < s + win)) >= win - most),
r AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, count(*) AS n_overlaps FROM g GROUP BY doc_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, coalesce(n_overlaps, 0) AS n_overlaps FROM documents LEFT JOIN r USING (doc_id)
"""
