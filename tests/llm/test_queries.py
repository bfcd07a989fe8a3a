"""The registered queries, their SQL twins, and the pipeline against its stages run apart."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_samples import MOTS, SCHEMA, WORDS, prose
from opsloom.llm import langid, mixing, queries, twins
from opsloom.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain(v):
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert name in ("op10_mixing", "op11_chat_formatting", "op12_phrase_mining", "op13_centroid_clustering") or len(rows) == 200
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
        for t in ("benchmark", "conversations", "embeddings"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        answer = con.execute(queries.ORACLE_SQL[name])
        cols = [c[0] for c in answer.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in rows) == sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in answer.fetchall())


# -- the pipeline by brute force, in plain Python ------------------------------------------------
def poisson(u, rate):
    """The number that inverts the Poisson distribution at u."""
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def plain_pipeline(rows, benchmark):
    """(text, doc_id, ...) -> copies, of rows (doc_id, text, lang, source, n_chars); the language stage by test_languages_by_all_subsets' rule."""
    from test_dedup import brute_links
    from test_texts import brute_contaminated, plain_language

    learned = plain_language([(t, lang) for i, t, lang, *_ in rows if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 5)])
    kept = [r for r in rows if learned(r[1])]
    named = {}
    for k, r in enumerate(kept):  # nodes: a doc_id, or a text without one
        named.setdefault((0, r[0]) if r[0] is not None else (1, r[1]), []).append(r)
    order = sorted(named, key=lambda x: (x[0], str(x[1]) if x[0] else x[1]))
    texts = [(n, min(r[1] for r in named[node])) for n, node in enumerate(order)]
    links = brute_links(texts, 5, 80)
    kept = []
    for n, node in enumerate(order):
        own = named[node]
        first = links[n][1] == n
        if first or not links[n][0]:
            kept += own if node[0] == 0 else own[:1] if own[0][1].split() else own
    told = brute_contaminated(list(enumerate(r[1] for r in kept)), benchmark)
    bad = {i for (i, hit, *_) in told if hit}
    kept = [r for n, r in enumerate(kept) if n not in bad]
    size = Counter(r[3] for r in kept)
    out = Counter()
    for r in kept:
        rate = len(kept) / len(size) / size[r[3]]
        u = int(hashlib.sha256(f"mix-1:{hashlib.md5((r[1] or '').encode()).hexdigest() if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) / 2.0**52
        if n := poisson(u, rate):
            out[r] += n
    return out


def run_on(spark, rows, items, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.shard_id is not None for r in out)
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out)


def test_pipeline_by_brute_force(spark, tmp_path):
    """Copies, near copies, benchmark passages, texts in no language, nulls in every column and repeated rows: the exact multiset of rows."""
    r = random.Random(12)
    items = [(k, prose(3000 + k, 20)) for k in range(4)] + [(9, "walnut tide 17")]
    rows = []
    for i in range(60):
        text = prose(i, r.randint(4, 60), MOTS if i % 3 == 0 else WORDS)
        rows.append((i, text, None if i % 7 == 0 else "fr" if i % 3 == 0 else "en", r.choice(["a", "b", "c", None]), r.choice([None, len(text)])))
    for k in range(12):
        i, text, lang, source, n = rows[k * 4]
        rows.append((100 + k, text if k % 2 else text + " more", lang, source, n))
    rows += [(200 + k, prose(k, 15) + " " + items[k % 4][1] + " " + prose(k + 50, 9), "en", "b", 1) for k in range(6)]
    rows += [(300, "so walnut, TIDE 17", "en", "a", 1), (301, None, "en", "a", 1), (302, "", None, "a", 1), (303, "12 34 !", "en", None, None), (304, "   ", "fr", "c", 2)]
    rows += [(None, rows[5][1], "en", "a", 1), (None, prose(901, 30), None, "a", 1), (None, prose(901, 30), None, "a", 1), (None, prose(902, 25, MOTS), "fr", None, 1), (None, None, None, None, None)]
    rows += [(None, prose(910 + k, 30), "en", "abc"[k % 3], k) for k in range(9)]
    rows += [rows[10], rows[10]]
    got = run_on(spark, rows, items, tmp_path)
    assert got == plain_pipeline(rows, items)
    assert None in {k[0] for k in got} and max(got.values()) > 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run_on(spark, [], [(1, "a b c")], tmp_path) == Counter()


def test_pipeline_equals_its_stages_in_sql(spark):
    """Every kept document with its number of copies."""
    out = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    und = [r.doc_id for r in langid.identify(documents(spark, SF)).where("lang_pred = 'und'").collect()]
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    con.execute(f"create table documents as select * from read_parquet('{SF}/documents.parquet')")

    def keep(sql: str) -> None:
        con.execute(f"create or replace table documents as select * from documents where doc_id in ({sql})")

    keep(f"select doc_id from documents where doc_id not in ({', '.join(map(str, [-1, *und]))})")
    keep(f"select doc_id from ({twins.jaccard(5, 80)}) where doc_id = component_id")
    keep(f"select doc_id from ({twins.decontamination()}) where not contaminated")
    assert out == Counter(r[0] for r in con.execute(f"select doc_id from ({mixing.oracle()})").fetchall())


def test_language_stage_judges_row_by_row(spark):
    """Rows of one doc_id or of none stand for themselves, and short clear texts stay with any number of labels."""
    texts = [(k, " ".join(chr(0x4E00 + 40 * k + j) * 3 for j in range(30)), f"l{k}") for k in range(100)]
    rows = [(1000, "123 456", None), (1000, texts[3][1], None), (None, texts[4][1], None), (None, "!", None), (1001, " ".join(texts[5][1].split()[:6]), None)]
    docs = spark.createDataFrame(texts + rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.where("lang is null").collect())
    assert got == Counter((i, t) for i, t, _ in (rows[1], rows[2], rows[4]))


def test_stages_keep_the_columns(spark):
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
