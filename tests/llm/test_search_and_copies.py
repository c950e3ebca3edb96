"""Ranked search, fill-in-middle and exact copies against brute force, and their defined cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import common, exact_dedup, fill_in_middle, ranked_search

SPACES = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _ranked(docs, items, top=10, once=True):
    words = [_terms(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    out = []
    for item, text in set(items):
        own = _terms(text)
        scored = []
        for (doc, _), ws in zip(docs, words, strict=True):
            m = 10 + 90 * len(ws) * n_docs // n_terms if n_terms else 0
            score = 0
            for t in set(own):
                if tf := ws.count(t):
                    df = sum(t in w for w in words)
                    score += (1 if once else own.count(t)) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if x[1] else x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("most,block,salts", [(10**6, 8192, 64), (12, 3, 2)])
def test_search_against_brute_force(spark, once, most, block, salts):
    rnd = random.Random(4)
    words = ["the", "The", "cat", "Ärger", "ärger", "x1", "[y]", "z-z", "日本", " q", "naïve"]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 30])))) for k in range(60)]
    docs += [(k, "cat the cat") for k in range(100, 130)] + [(None, "cat the cat"), (None, None), (7, "cat"), (7, "cat"), (9, None), (10, ""), (11, "-- [ ]")]
    items = [(k, " ".join(rnd.choices(words, k=4))) for k in range(8)] + [(1, "cat the"), (1, "cat the"), (1, "the cat"), (2, None), (3, "unknown"), (4, ""), (None, "cat"), (6, "cat cat cat the")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "SCORE": F.lit("s"), "item": F.lit(0)}).repartition(5)
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = ranked_search.search(docs_df, items_df, once=once, most=most, block=block, salts=salts)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == _ranked(docs, items, once=once)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a cat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []
    assert len(ranked_search.search(docs, items).collect()) == 1


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9], dtype=np.int64)
    assert ranked_search.lengths(n, 10**10, 10**12).tolist() == [10 + 90 * int(x) * 10**10 // 10**12 for x in n]


def test_the_best_of_a_block():
    scores, ids, nameless = np.array([5, 0, 7, 5, 5, 9]), np.array([4, 1, 9, 2, 0, 8]), np.array([False, False, False, False, True, False])
    assert ranked_search.best_of(scores, ids, nameless, 4).tolist() == [5, 2, 3, 0]
    assert ranked_search.best_of(scores, ids, nameless, 9).tolist() == [5, 2, 3, 0, 4]


def _middle(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    return len(units), "spm" if spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_brute_force(spark):
    rnd = random.Random(6)
    pieces = ["\n", "a", "é日", "\r\n", "<", "P>", "<P", "S", "$1", "\\E", " ", " ", "\x00", "x" * 50]
    rows = [(k, "".join(rnd.choices(pieces, k=rnd.choice([0, 1, 2, 8, 40])))) for k in range(300)]
    rows += [(5, None), (None, "a\nb\nc"), (6, ""), (7, "\n"), (7, "\n"), (8, "no <M> here\n"), (9, "line\n" * 200_000), (10, "long" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("old"), "PREFIX": F.lit(1), "extra": F.lit(2), "restored": F.lit(0)})
    out = fill_in_middle.restore(fill_in_middle.transform(df))
    assert sorted(out.columns) == sorted(["doc_id", "text", "extra", "n", "form", "prefix", "middle", "suffix", "output", "restored"])
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.restored == (r.text or "") for r in got)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in got), key=repr) == sorted([(i, *_middle(i, t)) for i, t in rows], key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restore(fill_in_middle.transform(df.limit(0))).collect() == []


def test_fill_in_middle_settings(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a\nb|c\n").alias("text"))
    assert {r.form for r in fill_in_middle.transform(df, rate=0).select("form").distinct().collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.transform(df, spm_rate=100).select("form").distinct().collect()} == {"spm"}
    marks = ("[|p.", "(*s?", "{+m$")
    out = fill_in_middle.restore(fill_in_middle.transform(df, sentinels=marks), sentinels=marks)
    assert out.where("restored <> text or form = 'plain'").isEmpty()
    with pytest.raises(ValueError):
        fill_in_middle.transform(df, sentinels=("<P<", "<S>", "<M>"))


def test_fill_in_middle_stays_in_the_jvm(spark):
    plan = fill_in_middle.op12_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def _copies(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(SPACES), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for content, held in groups.items():
        first = min(held)
        out += [(rows[x[3]][0], rows[first[3]][0], len(held), x is first, hashlib.sha256(content.encode()).hexdigest(), -x[0]) for x in held]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])  # with 3, nearly all contents share keys
@pytest.mark.parametrize("hot", [100, 5])
def test_exact_groups_against_brute_force(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(8)
    texts = [None, "", "a b", "ab", "a  b", " x", "x  ", "é é", "éé", "long" * 50, " ", "\t\n\x0b\x0c\r", " x", "x  "]
    rows = [(k, "hot  group" if k % 3 else rnd.choice(texts)) for k in range(400)] + [(rnd.choice([None, *range(9)]), rnd.choice(texts)) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(0), "key": F.lit(1), "n_chars": F.lit("x")}).repartition(7)
    got = exact_dedup.exact_groups(df, bits=bits, window_bytes=200)
    assert sorted(map(tuple, got.collect()), key=repr) == _copies(rows)
    stay = exact_dedup.deduplicate(df, bits=bits, window_bytes=200)
    assert stay.columns == df.columns
    digest = lambda t: hashlib.sha256((t or "").translate(SPACES).encode()).hexdigest()
    assert sorted([(r.doc_id, digest(r.text), len(r.text or "")) for r in stay.collect()], key=repr) == sorted([(w[1], w[4], w[5]) for w in _copies(rows) if w[3]], key=repr)


def test_exact_groups_edges(spark):
    df = spark.createDataFrame([(3, "one two"), (2, "onetwo"), (1, "one\ntwo")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_groups(df).select("doc_id", "keep_id", "kept").collect())) == [(1, 1, True), (2, 1, False), (3, 1, False)]
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []
    assert exact_dedup.deduplicate(df.limit(0)).collect() == []
    big = spark.createDataFrame([(1, "x" * 3_000_000), (2, "x" * 3_000_000 + " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(big).collect()) == [(1, 2), (2, 2)]
