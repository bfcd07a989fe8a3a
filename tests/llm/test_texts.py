"""Language, tokens, quality, personal data, contamination, mixing and shards."""

import hashlib
import math
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.llm import decontam, langid, mixing, pii, quality, sharding, tokencount
from opsloom.llm.common import documents, new_path

from llm_samples import MOTS, SCHEMA, WORDS, prose


# -- language ---------------------------------------------------------------------------------
def test_languages_of_held_out_texts(spark):
    rows = [(i, prose(i, 40, WORDS if i % 2 else MOTS), "en" if i % 2 else "fr", "s", 1) for i in range(200)] + [(1000, prose(1, 60) + " " + prose(2, 40, MOTS), None, "s", 1)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 1000]
    assert len(held) > 20 and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") and r.score > 0.8 for r in held)
    both = out[1000]
    assert both.langs == ["en", "fr"] and both.shares[0] == pytest.approx(0.6, abs=0.08)


def test_languages_of_odd_input(odd, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in rows}
    assert got[4] == got[5] == got[6] == got[8] == "und" and got[1] == "en" and got[2] == "fr" and got[11] in ("en", "fr")
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep_identified(odd).columns == odd.columns


def test_many_languages(spark):
    """More labels than a task holds at once, and than the model may have."""
    rows = [(5 * k + 1, " ".join(chr(0x4E00 + 20 * k + j) * 3 for j in range(12)), f"l{k:03}", "s", 1) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = [r for r in langid.identify(df).collect() if not r.held_out]
    assert len(got) > 200 and all(r.lang_pred == f"l{r.doc_id // 5:03}" for r in got)
    with pytest.raises(ValueError, match="more than 100 labels"):
        langid.identify(df, max_languages=100)


def plain_words(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]


def plain_tables(rows):
    """language -> log-probability of each hashed trigram, from rows (text, language)."""
    counts = {}
    for text, lang in rows:
        for w in plain_words(text):
            counts.setdefault(lang, Counter()).update(langid.grams(w))
    return {lang: lambda g, c=c, n=sum(c.values()): math.log(c[g] + 0.5) - math.log(n + 0.5 * langid.BUCKETS) for lang, c in counts.items()}


def plain_mixture(words, tables, langs, rounds=400):
    """(log-likelihood, shares) of the best mixture of the given languages, by plain expectation-maximisation."""
    like = {w: {x: sum(tables[x](g) for g in langid.grams(w)) for x in langs} for w in words}
    best = {w: max(v.values()) for w, v in like.items()}
    share = {x: 1 / len(langs) for x in langs}
    for _ in range(rounds):
        new = dict.fromkeys(langs, 0.0)
        for w, n in words.items():
            part = {x: share[x] * math.exp(like[w][x] - best[w]) for x in langs}
            total = sum(part.values())
            for x in langs:
                new[x] += n * part[x] / total
        share = {x: v / sum(words.values()) for x, v in new.items()}
    return sum(n * (best[w] + math.log(sum(share[x] * math.exp(like[w][x] - best[w]) for x in langs))) for w, n in words.items()), share


def plain_language(rows):
    """A function that says of a text whether the language stage keeps it: some language, and at most a quarter of its words won by the background."""
    from itertools import combinations

    tables = plain_tables(rows)

    def keep(text):
        words = Counter(plain_words(text))
        if not words or not tables or not any(c.isalpha() for c in text):
            return False
        cost = 2.0 * math.log1p(sum(words.values()))
        options = {x: plain_mixture(words, tables, x) for n in range(1, len(tables) + 1) for x in combinations(sorted(tables), n)}
        best = max(options, key=lambda x: options[x][0] - (len(x) - 1) * cost)
        like = {w: sum(options[best][1][x] * math.exp(sum(tables[x](g) + math.log(langid.BUCKETS) for g in langid.grams(w))) for x in best) for w in words}
        share = 0.5
        for _ in range(langid.BACKGROUND_ROUNDS):
            share = sum(n * share / (share + (1 - share) * like[w]) for w, n in words.items()) / sum(words.values())
        return share <= 0.25

    return keep


def test_noise_and_unlearned_languages_go(spark):
    """Random letters, letters with digits and an alphabet that was not learned; documents in learned languages stay."""
    docs = documents(spark, "/root/testdata/sf0.001")
    r = random.Random(4)
    kinds = ["bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz0123456789", "абвгдежзиклмноп"]
    noise = [(10_000 + k, " ".join("".join(r.choice(kinds[k % 3]) for _ in range(r.randint(3, 9))) for _ in range(r.randint(5, 60))), None, "s", 1) for k in range(150)]
    both = docs.unionByName(spark.createDataFrame(noise, SCHEMA).select(*docs.columns))
    kept = {x.doc_id for x in langid.keep_identified(both).select("doc_id").collect()}
    clean = {x.doc_id for x in docs.where(F.col("text").rlike("[a-z]")).select("doc_id").collect()}
    assert clean <= kept and not any(k >= 10_000 for k in kept)
    told = langid.identify(both).select("doc_id", "lang_pred", "score").collect()
    assert all(x.lang_pred in ("en", "de", "fr", "es", "und") for x in told)
    assert max(x.score for x in told if x.doc_id >= 10_000) < 0.3


def test_languages_by_all_subsets(spark):
    """The nested sets that EM suggests give the set that all subsets of four languages give, and its shares."""
    from itertools import combinations

    lists = {"en": WORDS, "fr": MOTS, "xx": [w[::-1] for w in WORDS], "yy": ["kra" + w[:3] + "um" for w in MOTS]}
    r = random.Random(6)
    rows = [(5 * i + 1, prose(i, 50, lists[x]), x, "s", 1) for i, x in enumerate(list(lists) * 12)]
    mixed = []
    for k in range(24):
        chosen = r.sample(list(lists), r.choice([1, 1, 2, 2, 3]))
        mixed.append((10_000 + k, " ".join(prose(700 + k, r.randint(15, 40), lists[x]) for x in chosen), None, "s", 1))
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows + mixed, SCHEMA)).collect()}
    tables = plain_tables([(t, x) for i, t, x, *_ in rows if not zlib_held(i)])
    for i, text, *_ in mixed:
        words = Counter(plain_words(text))
        cost = 2.0 * math.log1p(sum(words.values()))
        options = {s: plain_mixture(words, tables, s) for n in (1, 2, 3, 4) for s in combinations(sorted(tables), n)}
        best = max(options, key=lambda s: options[s][0] - (len(s) - 1) * cost)
        assert set(out[i].langs) == set(best), (i, best, out[i].langs)
        shares = dict(zip(out[i].langs, out[i].shares))
        assert all(shares[x] == pytest.approx(options[best][1][x], abs=0.02) for x in best)
        assert out[i].lang_pred == max(best, key=lambda x: shares[x])


def zlib_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


# -- tokens -----------------------------------------------------------------------------------
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokencount.default_vocabulary()
    t = Tokenizer.from_file(path)
    r = random.Random(0)
    texts = ["", " ", "a" * 3000, "<|endoftext|>x<|endoftext|> <|endoftext|", "日本語 テキスト", "é́ü ß  x\x85y\x1cz", "\U00010940 new ꟎", "'s don't I'LL", "\n\n  \t\n", "1234567890 3.14", "🙂" * 9, "ab" * 500]
    texts += ["".join(chr(r.choice([32, 10, 97, 98, 65, 48, 233, 0x4E00, 0x1F600, 39, 46, r.randint(33, 0x2FFF)])) for _ in range(80)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in tokencount.count_tokens(df, path).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(x.encode()), n > 1024)


def test_long_pre_tokens(spark):
    """Runs without a break: equal to the library, and not quadratic in their length."""
    import time

    from tokenizers import Tokenizer

    path = tokencount.default_vocabulary()
    r = random.Random(3)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    texts = [letters[:30_000], "a" * 20_001, "ab" * 9_000 + "a", "".join(r.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop") for _ in range(20_000)), "=" * 5000 + letters[:5000] + "-" * 4097, "é" * 4000]
    t, merger = Tokenizer.from_file(path), tokencount.Merger(open(path, encoding="utf-8").read())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for n in (2049, 2500, 3000):
        x = "".join(r.choice("aab") for _ in range(n)).encode()
        assert merger.count([x])[0] == merger.count_short([x])[0]
    began = time.perf_counter()
    merger.count([letters.encode()])
    assert time.perf_counter() - began < 6  # about 1 s on a free core


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    import json

    import public_tokenizers

    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="normalizer, pre_tokenizer"):
        tokencount.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(tokencount.default_vocabulary(), encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="added token"):
        tokencount.count_tokens(df, str(tmp_path / "t.json"))


def test_tokens_of_odd_input(odd, nothing):
    rows = tokencount.count_tokens(odd, tokencount.default_vocabulary()).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.n_tokens for r in rows}[4] == 0
    assert tokencount.count_tokens(nothing, tokencount.default_vocabulary()).count() == 0


# -- quality ----------------------------------------------------------------------------------
W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    text = text or ""
    w = W.findall(text)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c, cov = Counter(wins), set()
    for k, x in enumerate(wins):
        if c[x] > 1:
            cov |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov)


def test_features(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 20))) for _ in range(60)] + ["f f\x0b\x0cf f\n\nf f\nf f\r\nf f", "a#b $ <|>\n \n", "x\x85y", None, "one two three four five", "a b c d e a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(df).collect()}
    assert got == {i: brute_features(t) for i, t in enumerate(texts)}


def test_supervision_tells_junk(spark):
    clean = [(i, ". ".join(prose(i * 50 + k, 12).capitalize() for k in range(8)) + ".\n" + prose(i + 9000, 30) + ".", None, None, None) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), None, None, None) for i in range(30)] + [(2000 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split()), None, None, None) for i in range(30)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(out[i].kept for i, *_ in clean) and not any(out[i].kept for i, *_ in junk)


def test_quality_of_odd_input(odd, nothing):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    assert got[4].base_failed and got[5].base_failed and got[6].base_failed and not got[1].base_failed and not got[4].kept
    assert quality.judge(nothing).count() == 0


# -- personal data ----------------------------------------------------------------------------
def rewritten(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in pii.pseudonymise(df, **({"key": "k"} | options)).orderBy("doc_id").collect()]


def luhn(s):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    text = "mail und.34@mail7.example.com, call +1 (017) 555-7713 or 4111 1111 1111 1111 from 192.168.0.1 on 2024-02-29 and 31/12/1999; 123-45-6789; key deadbeef00112233445566778899aabb."
    a, b = rewritten(spark, [text, "again " + text])
    assert [f["kind"] for f in a.findings] == ["email", "phone", "card", "ipv4", "date", "date", "ssn", "secret"]
    assert a.findings == b.findings and b.text == "again " + a.text and len(a.text) >= len(text) - 12
    new = [f["pseudonym"] for f in a.findings]
    assert re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{2}@mail7\.example\.com", new[0]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[1])
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", new[2]) and luhn(new[2].replace(" ", "")) and all(int(x) < 256 for x in new[3].split("."))
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", new[4]) and re.fullmatch(r"\d\d/\d\d/(19|20)\d\d", new[5]) and re.fullmatch(r"[0-9a-f]{32}", new[7])
    assert not any(x in a.text for x in ("und.34", "555-7713", "4111 1111", "192.168.0.1", "2024-02-29", "31/12/1999", "123-45-6789", "deadbeef"))
    assert rewritten(spark, [text], key="other")[0].text != a.text


def test_only_valid_values_change(spark):
    for text in ("4111111111111112", "999.1.1.1", "2024-02-30", "000-12-3456", "version 1.2.3", "3.14 and 42", "plain words, no data", "1.2.3.4.5"):
        (row,) = rewritten(spark, [text])
        assert row.text == text and row.findings == []


def test_pseudonyms_are_permutations(spark):
    ips = [f"10.0.{k // 256}.{k % 256}" for k in range(3000)]
    days = [f"2001-{m:02}-{d:02}" for m in range(1, 13) for d in range(1, 29)]
    (a, b) = rewritten(spark, [" ".join(ips), " ".join(days)])
    assert len({f["pseudonym"] for f in a.findings}) == 3000 and len({f["pseudonym"] for f in b.findings}) == len(days)


def test_feistel_is_a_bijection(spark):
    df = spark.range(1000).selectExpr("lpad(cast(id AS string), 3, '0') AS x")
    got = df.selectExpr(pii.permute("x", 10, "'k'", "'t'") + " AS y").distinct().collect()
    assert len(got) == 1000 and all(re.fullmatch(r"\d{3}", r.y) for r in got)


DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def plain_feistel(s, radix, key, tweak):
    """The permutation in plain Python."""
    if radix == 36 and len(s) == 1 and tweak == "email":
        n = int(s, 36)
        return DIGITS[int(plain_feistel(f"{n // 6}{n % 6}", 6, key, tweak), 6)]
    size = {6: 34, 10: 34, 16: 28, 36: 22}[radix]
    if len(s) > size:
        return "".join(plain_feistel(s[k : k + size], radix, key, f"{tweak}{k // size}") for k in range(0, len(s), size))
    s = s.lower()
    n = len(s) // 2
    sizes = (radix**n, radix ** (len(s) - n))
    half = [int(s[:n] or "0", radix), int(s[n:], radix)]
    for i in range(1, 9):
        k = 0 if i % 2 else 1
        f = int(hashlib.sha256(f"{key}|{tweak}|{len(s)}|{i}|{half[1 - k]}".encode()).hexdigest()[:15], 16)
        half[k] = (half[k] + f % sizes[k]) % sizes[k]
    out = ""
    for x, m in zip(half, (n, len(s) - n)):
        digits = ""
        for _ in range(m):
            x, d = divmod(x, radix)
            digits = DIGITS[d] + digits
        out += digits
    return out


def plain_pseudonym(kind, m, key):
    only = re.sub("[^0-9]", "", m)

    def fill(digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in m)

    def walk(s, valid, tweak):
        s = plain_feistel(s, 10, key, tweak)
        while not valid(s):
            s = plain_feistel(s, 10, key, tweak)
        return s

    if kind == "email":
        name, _, host = m.rpartition("@")
        return re.sub("[a-z0-9]+", lambda g: plain_feistel(g[0], 36, key, kind), name.lower()) + "@" + host
    if kind == "phone":
        return fill(only[:-10] + plain_feistel(only[-10:], 10, key, kind))
    if kind == "card":
        body = plain_feistel(only[:-1], 10, key, kind)
        return fill(body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "ipv4":
        h = plain_feistel("".join(f"{int(o):02x}" for o in m.split(".")), 16, key, kind)
        return ".".join(str(int(h[k : k + 2], 16)) for k in range(0, 8, 2))
    if kind == "ssn":
        return fill(walk(only, lambda s: not re.match("000|666|9", s) and s[3:5] != "00" and s[5:] != "0000", kind))
    if kind == "secret":
        x = plain_feistel(m, 16, key, kind)
        return x if m == m.lower() else x.upper() if m == m.upper() else "".join(b.upper() if a.isupper() else b for a, b in zip(m, x))
    day0 = date(1900, 1, 1)
    a, b, c = map(int, re.split("[-/]", m))
    iso = "-" in m
    day_first = iso or b <= 12
    day = date(a, b, c) if iso else date(c, b, a) if day_first else date(c, a, b)
    n = walk(f"{(day - day0).days:05}", lambda s: int(s) < 73049, kind)
    d = day0 + timedelta(int(n))
    if iso:
        return d.isoformat()
    x, y = (d.day, d.month) if day_first or d.day <= 12 else (d.month, d.day)
    return f"{x:02}/{y:02}/{d.year}" if len(m) == 10 else f"{x}/{y}/{d.year}"


VALUES = {
    "email": ["a.b-c@x.org", "7@x.org", "z.z9@x.org", "John.Smith42@mail.example.com", "x" * 40 + "@y.io"],
    "phone": ["+1 (017) 555-7713", "(415) 555-2671", "415-555-2671", "415.555.2671", "+491701234567", "+44 20 7946 0958", "+33 6 12 34 56 78", "+49 30 123456"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "3782 822463 10005"],
    "ipv4": ["10.0.0.1", "255.254.1.0"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "secret": ["deadbeef00112233445566778899aabb", "0" * 23 + "f" * 77, "DEADBEEF00112233445566778899AABB", "DeadBeef00112233445566778899aAbB"],
    "date": ["2024-02-29", "31/12/1999", "12/25/2020", "1/2/2020", "2/30/1999".replace("30", "28"), "01/02/2020"],
}


def test_pseudonyms_equal_plain_python(spark):
    cases = [(kind, m) for kind, ms in VALUES.items() for m in ms]
    for (kind, m), row in zip(cases, rewritten(spark, [f"so: {m} !" for _, m in cases], key="other key")):
        assert row.text == f"so: {plain_pseudonym(kind, m, 'other key')} !" and [f.kind for f in row.findings] == [kind]
    (row,) = rewritten(spark, ["at 2020-01-01T10:00:00Z"])
    assert row.text == f"at {plain_pseudonym('date', '2020-01-01', 'k')}T10:00:00Z"
    days = [f"{m}/{d}/2001" for m in range(1, 13) for d in range(1, 29)]
    (row,) = rewritten(spark, [" ".join(days)])
    assert len(set(row.text.split())) == len(days)


def test_a_day_has_one_pseudonym(spark):
    """In every notation, read back as the rule reads it."""
    days = [date(1900, 1, 1) + timedelta(73 * k + k % 7) for k in range(1000)]
    forms = [f"{d.isoformat()} {d.day}/{d.month}/{d.year} {d:%d/%m/%Y}" + (f" {d.month}/{d.day}/{d.year} {d:%m/%d/%Y}" if d.day > 12 else "") for d in days]

    def plain_date(s):
        if "-" in s:
            return date.fromisoformat(s)
        a, b, c = map(int, s.split("/"))
        return date(c, b, a) if b <= 12 else date(c, a, b)

    seen = set()
    for d, row in zip(days, rewritten(spark, forms)):
        (one,) = {plain_date(x) for x in row.text.split()}
        assert "-" in row.text.split()[0] and len(row.text.split()[2]) == 10
        seen.add(one)
    assert len(seen) == len(days)


def test_one_letter_names_are_permuted(spark):
    names = "0123456789abcdefghijklmnopqrstuvwxyz"
    got = [r.text.split("@")[0] for r in rewritten(spark, [f"{c}@x.org" for c in names])]
    assert sorted(got) == list(names) and len({(names.index(b) - names.index(a)) % 36 for a, b in zip(names, got)}) > 5


def test_no_plan_shows_the_key(spark):
    out = pii.pseudonymise(spark.createDataFrame([(1, "a@b.org 2020-01-02")], "doc_id bigint, text string"), key="open sesame 1234")
    out.collect()
    assert "open sesame" not in out._jdf.queryExecution().toString() and "open sesame" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_key_is_the_callers(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64


def test_data_of_odd_input(odd, nothing):
    rows = pii.pseudonymise(odd, key="k").collect()
    assert len(rows) == odd.count() and {r.doc_id: r.text for r in rows}[4] is None
    assert pii.pseudonymise(nothing, key="k").count() == 0 and pii.pseudonymise(odd, key="k").columns[: len(SCHEMA.split(","))] == odd.columns[:5]


# -- contamination ----------------------------------------------------------------------------
def test_masks_meet_their_promise():
    from itertools import combinations

    places = [{o + k for k, c in enumerate(m) if c == "1"} for m in decontam.MASKS for o in range(13 - len(m) + 1)]
    assert all(any(not (p & set(s)) for p in places) for s in combinations(range(13), 2))


def test_families_are_complete():
    from itertools import combinations

    for size, most in ((8, 2), (8, 1), (8, 0), (8, 3), (12, 4), (20, 3), (10, 6)):
        kept = [{p for p, c in enumerate(m) if c == "1"} for m in decontam.family(size, most)]
        assert all(kept) and all(any(not (k & set(s)) for k in kept) for s in combinations(range(size), most))


def brute_contaminated(docs, items, window=13, most=2):
    tok = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    out = Counter()
    for d, text in docs:
        w, hit, n = tok(text), set(), 0
        for i, x in {(i, x) for i, x in items if x is not None}:
            x = tok(x)
            win = min(window, len(x))
            least = win - (most if len(x) >= 8 else 0)
            diagonals = {b - a for a in range(len(x) - win + 1) for b in range(len(w) - win + 1) if sum(p == q for p, q in zip(x[a : a + win], w[b : b + win])) >= least} if x else set()
            n += len(diagonals)
            if diagonals:
                hit.add(i)
        out[d, bool(n), tuple(sorted(i for i in hit if i is not None)), n] += 1
    return out


def found_contaminated(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    return Counter((r.doc_id, r.contaminated, tuple(r.item_ids), r.n_overlaps) for r in decontam.judge(d, b, **options).collect())


def test_substitutions_are_tolerated(spark):
    r = random.Random(8)
    items = [(k, prose(7000 + k, r.randint(13, 40))) for k in range(8)] + [(90, "too short here"), (91, None)]
    docs = []
    for i in range(60):
        w = prose(i, 60).split()
        if r.random() < 0.7:
            x = items[r.randrange(8)][1].split()
            s = r.randint(0, max(0, len(x) - 13))
            x = x[s : s + r.randint(10, 25)]
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = "swap"
            at = r.choice([0, 20, len(w)])
            w[at:at] = x
        docs.append((i, " ".join(w).replace("stone", "Stone,")))
    for limit in (1_000_000, 0):  # by broadcast, and by shuffle
        assert found_contaminated(spark, docs, items, broadcast_hashes=limit) == brute_contaminated(docs, items)


@pytest.mark.parametrize("substitutions", [0, 1, 2, 3])
def test_no_overlap_is_lost_whatever_the_size_of_items(spark, substitutions):
    """Items of 1 to 14 tokens, all pairs of substituted places in turn, at the edges of texts too."""
    from itertools import combinations

    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 15)]
    docs = [(None, items[6][1]), (None, "nothing here"), (1, None), (2, "")]
    for n, text in items:
        places = [s for most in range(4) for s in combinations(range(n), most)]
        for k, swapped in enumerate(places if n <= 9 else places[:: 1 + len(places) // 60]):
            w = text.split()
            for p in swapped:
                w[p] = "swap"
            pad = prose(k, k % 3).split()
            docs.append((1000 * n + k, " ".join([*pad, *w, *pad[::-1]] if k % 4 else w)))
    got = found_contaminated(spark, docs, items, substitutions=substitutions)
    assert got == brute_contaminated(docs, items, most=substitutions)
    assert got[None, True, (7,), 1] == 1


def test_one_word_over_and_over(spark):
    """All diagonals of a degenerate text are hits."""
    docs, items = [(1, "the " * 3000), (2, "a " + "the " * 12), (3, "the " * 11)], [(1, "the " * 40), (2, "the " * 5), (None, "the " * 3)]
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {1: (True, [1, 2]), 2: (True, [1, 2]), 3: (True, [2])}


def test_contamination_of_odd_input(spark, odd, nothing):
    items = spark.createDataFrame([(1, prose(1, 120)), (1, prose(1, 120)), (None, "x"), (2, ""), (None, None)], "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.contaminated, tuple(r.item_ids), r.n_overlaps) for r in decontam.judge(odd, items).collect())
    assert got == brute_contaminated(docs, [(r.item_id, r.text) for r in items.collect()]) and got[None, True, (1,), 1] == 1
    assert decontam.judge(nothing, items).count() == 0 and not decontam.judge(odd, items.limit(0)).where("contaminated").count()
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 5, 6, 7, 8, 11])
    with pytest.raises(ValueError, match="8 tokens"):
        decontam.judge(odd, items, window=5)


# -- mixing -----------------------------------------------------------------------------------
def test_mix_follows_the_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").otherwise("off").alias("source"))
    out = mixing.replicate(df, weights={"big": 1.0, "small": 3.0}, total=20_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and n["small"] == pytest.approx(15_000, rel=0.03) and n["big"] == pytest.approx(5_000, rel=0.05)
    keys = [r.shuffle_key for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    times = Counter(r.n for r in out.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert times[7] / 2000 == pytest.approx(math.exp(-7.5) * 7.5**7 / math.factorial(7), abs=0.03)
    again = mixing.replicate(df.repartition(7), weights={"big": 1.0, "small": 3.0}, total=20_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_large_rates(spark):
    df = spark.createDataFrame([(k, "s") for k in range(20)], "doc_id bigint, source string")
    n = mixing.replicate(df, total=20 * 2000).groupBy("doc_id").count().agg(F.avg("count"), F.min("count")).first()
    assert n[0] == pytest.approx(2000, rel=0.03) and n[1] > 1700


def test_mix_of_odd_input(odd, nothing):
    out = mixing.replicate(odd, total=13_000)
    assert {r.source for r in out.select("source").distinct().collect()} == {"s1", "s2", "s3", None}
    assert out.columns == [c for c in odd.columns if c not in ("copy", "shuffle_key")] + ["copy", "shuffle_key"]
    assert mixing.replicate(nothing).count() == 0 and mixing.replicate(odd, weights={}).count() == 0


# -- shards -----------------------------------------------------------------------------------
def some_rows(spark, *starts, n=200, parts=6):
    return [spark.createDataFrame([(k, prose(k, 40)) for k in range(s, s + n)], "doc_id bigint, text string").repartition(parts) for s in starts]


def test_shards_round_trip(spark):
    root = new_path(spark, "t")
    store = sharding.ShardStore(spark, root)
    parts = some_rows(spark, 0, 200, 400)
    for p in parts:
        store.append(p)
    before = store.manifest()
    assert before["version"] == 3 and len(before["shards"]) == 18
    size = sum(s["bytes"] for s in before["shards"])
    now = store.compact(target_bytes=size // 3)
    assert len(now["shards"]) <= 5 and now["version"] > 3 and sum(s["rows"] for s in now["shards"]) == 600
    rows = sorted((r.doc_id, r.text) for r in store.read().collect())
    assert rows == sorted((r.doc_id, r.text) for p in parts for r in p.collect())
    assert all(r.shard.rows == r["count"] for r in store.read().groupBy("shard").count().collect())
    assert store.compact(target_bytes=size // 3)["version"] == now["version"]
    # Older versions stay whole until a vacuum that is told to let them go.
    assert store.vacuum() == [] and sorted((r.doc_id, r.text) for r in store.read(3).collect()) == rows
    assert len(store.vacuum(keep_seconds=0)) >= 18 and store.versions() == [now["version"]]
    assert sorted((r.doc_id, r.text) for r in store.read().collect()) == rows and store.vacuum(keep_seconds=0) == []


def test_one_of_racing_writers_wins(spark):
    store = sharding.ShardStore(spark, new_path(spark, "t"))
    store.append(some_rows(spark, 0, n=10, parts=1)[0])
    base = store.manifest()

    def write(k):
        try:
            store.commit(base, [{"path": f"writer-{k}", "bytes": 1, "rows": 1}], None)
            return k
        except sharding.CommitError:
            return None

    with ThreadPoolExecutor(16) as pool:
        won = [k for k in pool.map(write, range(64)) if k is not None]
    now = store.manifest()
    assert len(won) == 1 and now["version"] == 2 and [s["path"] for s in now["shards"]] == [f"writer-{won[0]}"]
    with pytest.raises(sharding.CommitError, match="another writer"):
        store.commit({"version": 0, "schema": base["schema"]}, [], None)
    with ThreadPoolExecutor(4) as pool:  # two whole appends from one base: one of them has to come again
        other = sharding.ShardStore(spark, new_path(spark, "t"))
        results = list(pool.map(lambda df: _appended(other, df), some_rows(spark, 0, 100, n=20, parts=2)))
    assert sum(results) == other.manifest()["version"] and other.read().count() == 20 * sum(results)


def _appended(store, df):
    try:
        store.append(df)
        return 1
    except sharding.CommitError:
        return 0


def test_stores_without_exclusive_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SCHEMES", {"hdfs": "rename"})
    with pytest.raises(ValueError, match="no exclusive commit"):
        sharding.ShardStore(spark, new_path(spark, "t"))
    sharding.ShardStore(spark, new_path(spark, "t"), single_writer=True).append(some_rows(spark, 0, n=3, parts=1)[0])


def test_plans_until_nothing_is_left_to_merge(spark):
    """Against the rules: runs within a tier and about the target, all shards in at most one run, an end with few small shards."""
    store, r = sharding.ShardStore(spark, new_path(spark, "t")), random.Random(4)
    for target, fan in ((1000, 4), (5000, 3), (100_000, 8)):
        shards = [{"path": f"p{k}", "bytes": int(r.lognormvariate(5, 2)) + 1, "rows": 1} for k in range(400)]
        total = sum(s["bytes"] for s in shards)
        for step in range(40):
            runs = store.plan(shards, target, fan)
            if not runs:
                break
            names = [s["path"] for run in runs for s in run]
            assert len(names) == len(set(names))
            for run in runs:
                sizes = [s["bytes"] for s in run]
                assert len(run) > 1 and sum(sizes) <= target * 5 // 4 and max(sizes) < fan * max(1, min(sizes)) + 1 and max(sizes) < target * 3 // 4
                assert len(run) >= fan or sum(sizes) >= target * 3 // 4 or sum(sizes) + max(sizes) * fan > target // 2
            shards = [s for s in shards if s["path"] not in set(names)] + [{"path": f"m{step}-{k}", "bytes": sum(s["bytes"] for s in run), "rows": 1} for k, run in enumerate(runs)]
            assert sum(s["bytes"] for s in shards) == total
        assert not runs
        tiers = Counter(int(math.log(s["bytes"], fan)) for s in shards if s["bytes"] < target * 3 // 4)
        assert all(n < 2 * fan + 1 for n in tiers.values())


def test_large_arrivals_are_cut(spark):
    store = sharding.ShardStore(spark, new_path(spark, "t"))
    store.append(some_rows(spark, 0, n=600, parts=1)[0])
    size = store.manifest()["shards"][0]["bytes"]
    now = store.compact(target_bytes=size // 5)
    assert 5 <= len(now["shards"]) <= 6 and sum(s["rows"] for s in now["shards"]) == 600 and {r.doc_id for r in store.read().collect()} == set(range(600))
    assert store.compact(target_bytes=size // 5)["version"] == now["version"]


def test_shards_of_odd_input(spark, odd, nothing):
    out = sharding.shard(odd, new_path(spark, "t"), target_bytes=1 << 20)
    assert out.columns == [*odd.columns, "shard_"] and out.count() == odd.count()
    assert sharding.shard_once(nothing, new_path(spark, "t")).count() == 0
    assert sharding.shard_once(odd, new_path(spark, "t"), target_bytes=1000).count() == odd.count()
