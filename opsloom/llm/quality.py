"""Quality rules combined by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document.  Without labels, expectation-
maximisation estimates how accurately each rule votes on good and on bad documents, from the counts
of the vote patterns (at most 3 to the number of rules, however many documents).  A document
is kept if its posterior probability of being good is at least one half, unless the base rule fails.

Only DataFrame functions run over the texts.  Words are runs of anything but ASCII white space.

Defined results for odd input: a null or blank text has no words, so the base rule fails; a null
``doc_id`` is a row like any other; repeated rows are each judged; very long texts take time in
proportion to their length times its logarithm; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stages, let

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = r" \t\n\u000b\u000c\r"
RULES = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "word_size": "CASE WHEN word_chars < 2.5 * n_words OR word_chars > 14 * n_words THEN -1 WHEN word_chars BETWEEN 3.5 * n_words AND 9 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN n_symbols > 0.1 * n_words THEN -1 WHEN n_symbols <= 0.02 * n_words THEN 1 ELSE 0 END",
    "capitals": "CASE WHEN n_upper > 0.4 * n_letters THEN -1 WHEN n_upper <= 0.15 * n_letters THEN 1 ELSE 0 END",
    "letters": "CASE WHEN n_letters < 0.88 * word_chars THEN -1 WHEN n_letters >= 0.93 * word_chars THEN 1 ELSE 0 END",
    "marks": "CASE WHEN n_marks > 0.5 * n_words THEN -1 WHEN n_marks BETWEEN 0.01 * n_words AND 0.3 * n_words THEN 1 ELSE 0 END",
    "lines": "CASE WHEN n_dup_lines > 0.3 * n_lines THEN -1 WHEN n_dup_lines = 0 AND n_lines > 1 THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN n_repeat_words > 0.2 * n_words THEN -1 WHEN n_repeat_words <= 0.05 * n_words THEN 1 ELSE 0 END",
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text, all computed inside the row."""
    words = let("body", f"trim(BOTH '{SPACES}' FROM text)", r"IF(body = '', cast(array() AS array<bigint>), transform(split(body, '[\\x20\\x09-\\x0D]+', -1), w -> xxhash64(w)))")
    windows = "IF(size(words) < 6, cast(array() AS array<bigint>), transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])))"
    # Few texts repeat a window: only theirs are sorted to find the places.
    twice = (
        "transform(filter(transform(sorted, (s, k) -> named_struct('i', s.i, 'twice', (k > 0 AND sorted[greatest(k - 1, 0)].h = s.h) "
        "OR (k < size(sorted) - 1 AND sorted[least(k + 1, size(sorted) - 1)].h = s.h))), x -> x.twice), x -> x.i)"
    )
    places = let("sorted", "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))", f"sort_array({twice})")
    covered = f"aggregate({places}, named_struct('end', 0, 'n', 0), (s, p) -> named_struct('end', p + 5, 'n', s.n + least(5, p + 5 - s.end)), s -> s.n)"
    repeated = let("windows", windows, f"IF(size(array_distinct(windows)) < size(windows), {covered}, 0)")
    of_words = let("words", words, f"named_struct('n_words', size(words), 'n_repeat_words', {repeated})")
    lines = f"filter(split(text, '\\n', -1), l -> length(trim(BOTH '{SPACES}' FROM l)) > 0)"
    of_lines = let("ls", lines, "named_struct('n_lines', size(ls), 'n_dup_lines', size(ls) - size(array_distinct(ls)))")
    counted = docs.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr(
        "doc_id",
        f"{of_words} AS w",
        f"{of_lines} AS l",
        r"length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '')) AS word_chars",
        f"length(regexp_replace(text, '[^{SYMBOLS}]+', '')) AS n_symbols",
        r"length(regexp_replace(text, '[^\\p{Lu}]+', '')) AS n_upper",
        r"length(regexp_replace(text, '[^\\p{L}]+', '')) AS n_letters",
        "length(regexp_replace(text, '[^.!?]+', '')) AS n_marks",
    )
    places_of = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines"}
    return counted.selectExpr("doc_id", *(f"cast({places_of.get(f, f)} AS bigint) AS {f}" for f in FEATURES))


def votes() -> list[Column]:
    return [F.expr(rule).cast("tinyint").alias(f"v_{name}") for name, rule in RULES.items()]


def _log_odds(odds: dict[tuple[str, int], float], prior: float) -> Column:
    total = F.lit(prior)
    for name in RULES:
        v = F.col(f"v_{name}")
        total = total + F.when(v == 1, F.lit(odds[name, 1])).when(v == -1, F.lit(odds[name, -1])).otherwise(F.lit(odds[name, 0]))
    return total


def fit(patterns: DataFrame, *, rounds: int = 20) -> tuple[dict[tuple[str, int], float], float]:
    """Log odds of good against bad for each vote of each rule, and of the prior.

    patterns: v_<rule> columns and n, one row per pattern.  It starts from the belief that a
    document with any bad vote is more likely bad.  Each round is one aggregation to one row.
    """
    cols = [F.col(f"v_{r}") for r in RULES]
    no_bad = F.least(*cols) > -1
    good = F.when(no_bad, F.lit(0.95)).otherwise(F.lit(0.1))
    odds: dict[tuple[str, int], float] = {}
    prior = 0.0
    for _ in range(rounds):
        n = F.col("n")
        sums = [F.sum(n * good).alias("g"), F.sum(n).alias("t")]
        for r in RULES:
            for v in (-1, 0, 1):
                here = F.when(F.col(f"v_{r}") == v, n).otherwise(0)
                sums += [F.sum(here * good).alias(f"g_{r}_{v}"), F.sum(here).alias(f"t_{r}_{v}")]
        s = patterns.agg(*sums).first()
        g, t = s["g"] or 0.0, s["t"] or 0
        b = t - g
        prior = math.log((g + 1) / (b + 1))
        for r in RULES:
            for v in (-1, 0, 1):
                x, y = s[f"g_{r}_{v}"] or 0.0, s[f"t_{r}_{v}"] or 0
                voted_g = g - (s[f"g_{r}_0"] or 0.0)
                voted_b = b - ((s[f"t_{r}_0"] or 0) - (s[f"g_{r}_0"] or 0.0))
                # To abstain says nothing; votes weigh by how often the rule casts them on either kind.
                odds[r, v] = math.log((x + 0.5) / (voted_g + 1)) - math.log((y - x + 0.5) / (voted_b + 1)) if v else 0.0
        good = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(odds, prior)))
    return odds, prior


def judge(docs: DataFrame, *, rounds: int = 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, the features, the votes, posterior, base_failed and kept of each document."""
    stages = Stages(docs.sparkSession)
    seen = stages.write("features", features(docs)).select("*", *votes())
    patterns = stages.write("patterns", seen.groupBy(*(f"v_{r}" for r in RULES)).agg(F.count(F.lit(1)).alias("n")))
    odds, prior = fit(patterns, rounds=rounds)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(odds, prior)))
    return seen.withColumn("posterior", posterior).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
