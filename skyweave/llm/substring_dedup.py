"""Exact removal of repeated word passages, found by recompression.

A window of `window` words repeats if its word sequence also starts at another place, in any document. Rounds of
recompression (recompress.py) name runs and pairs of words by their content, so equal windows hold an equal symbol at an
equal place, their representative:

1. Every document is read once and gives the fingerprints of its windows' representatives (about one in ten words);
   Spark counts them over all documents. A window whose representative stands once can't repeat.
2. For the documents that have repeated ones, the windows of those representatives alone are verified, by 96 bits of
   hash each, counted over all documents. Of equal texts one is read, and counts as often as it stands: every window of
   theirs repeats.
3. Words covered by repeated windows are removed from those documents; the others keep all their words.

Counting pre-aggregates in every task, so a passage of a third of all documents is no hot group; the joins back are plain
equi-joins that adaptive execution splits, or dealt into slices. Only per-document lists are ever gathered. Texts are cut into overlapping
pieces while hashing, so memory is bounded for texts of any length.

Defined results: a null or empty text, or one of fewer words than the window, loses nothing (null stays without words);
words are kept as they are, joined by one space; repeated rows and copies all lose their repeated windows, none stays as
a first copy; an input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, as_bytes, discard, materialize, salted_join, table, without
from skyweave.llm.near_dedup import WordHashes
from skyweave.llm.recompress import REACH, Prefix, mix, representatives

WINDOW = 35
#: Words hashed at a time (longer texts in overlapping pieces).
PIECE = 300_000
#: Text keys broadcast at most (16 bytes each); beyond, texts are joined by a shuffle.
MOST_KEYS = 500_000
#: In place of the starts of a text whose windows all repeat.
WHOLE = -1
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _pieces(texts: list[bytes], window: int, hashes: WordHashes) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """(word hashes with separators, [(text number, offset, windows, first word)]) of some texts at a time."""
    apart = 0
    flat: list[np.ndarray] = []
    spans: list[tuple[int, int, int, int]] = []
    size = 0

    def separator() -> np.ndarray:
        nonlocal apart
        apart += 1
        return mix(np.array([apart], dtype=np.uint64) ^ _SECOND)

    for k, raw in enumerate(texts):
        words = raw.split()
        for first in range(0, max(0, len(words) - window + 1), PIECE):
            some = words[first : first + PIECE + window - 1]
            flat += [separator(), hashes.of(some)]
            spans.append((k, size + 1, len(some) - window + 1, first))
            size += 1 + len(some)
            if size >= PIECE:
                yield np.concatenate([*flat, separator()]), spans
                flat, spans, size = [], [], 0
    if spans:
        yield np.concatenate([*flat, separator()]), spans


def _lists(n: int, found: dict[int, list[np.ndarray]], kind) -> pa.Array:
    return pa.array([np.concatenate(found[k]) if k in found else np.zeros(0, dtype=np.int64) for k in range(n)], pa.list_(kind))


def _fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """Distinct representatives of each text: fingerprint and place."""

    def make():
        hashes = WordHashes()

        def run(col: pa.Array) -> list[pa.Array]:
            texts, prints, places = as_bytes(col), {}, {}
            for flat, spans in _pieces(texts, window, hashes):
                rep, prefix = representatives(flat, window), Prefix(flat)
                for k, at, n, first in spans:
                    own = np.unique(rep[at : at + n])
                    prints.setdefault(k, []).append(prefix.of(own, REACH).view(np.int64))
                    places.setdefault(k, []).append(own - at + first)
            return [_lists(len(texts), prints, pa.int64()), _lists(len(texts), places, pa.int64())]

        return run

    return append_columns(docs, ["text"], [T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType()))], make).drop("text")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Start and hashes of each text's windows whose representative is one of `places`."""
    kinds = [("starts", T.LongType(), pa.int64()), ("h", T.LongType(), pa.int64()), ("c", T.IntegerType(), pa.int32())]

    def make():
        hashes = WordHashes()

        def run(col: pa.Array, wanted: pa.Array) -> list[pa.Array]:
            texts, found = as_bytes(col), [{}, {}, {}]
            wanted = [np.array(x, dtype=np.int64) for x in wanted.to_pylist()]
            for flat, spans in _pieces(texts, window, hashes):
                rep, one, two = representatives(flat, window), Prefix(flat), Prefix(mix(flat ^ _SECOND))
                for k, at, n, first in spans:
                    p = np.flatnonzero(np.isin(rep[at : at + n] - at + first, wanted[k]))
                    for into, values in zip(found, (p + first, one.of(p + at, window).view(np.int64), (two.of(p + at, window) >> np.uint64(32)).astype(np.uint32).view(np.int32)), strict=True):
                        into.setdefault(k, []).append(values)
            return [_lists(len(texts), f, kind) for f, (_, _, kind) in zip(found, kinds, strict=True)]

        return run

    return append_columns(docs, ["text", "places"], [T.StructField(n, T.ArrayType(t)) for n, t, _ in kinds], make).drop("text", "places")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Texts less the words that windows at `starts` cover; WHOLE stands for all of them."""

    def run(col: pa.Array, starts: pa.Array) -> list[pa.Array]:
        rows = []
        for raw, at in zip(as_bytes(col), starts.to_pylist(), strict=True):
            words = raw.split()
            if at == [WHOLE]:
                rows.append((b"", len(words), len(words)))
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, np.array(at or [], dtype=np.int64), 1)
            np.add.at(edge, np.array(at or [], dtype=np.int64) + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            rows.append((b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())))
        return [pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]

    return append_columns(docs, ["text", "starts"], [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())], lambda: run).drop("starts")


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with the text's kept words, n_words (before) and n_removed."""
    if window <= REACH:
        raise ValueError(f"windows must be longer than {REACH} words")
    order = [c for c in without(docs, ["n_words", "n_removed"]).columns]
    rest = [c for c in order if c != text]
    # Rows of equal texts are told apart by nothing and need not be: 128 bits of hash name a text.
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(None).cast("int").alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    keyed = given.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    read = materialize(_fingerprints(keyed.select("k1", "k2", "text"), window).where("size(prints) > 0").withColumn("r", F.monotonically_increasing_id()), "fingerprints")
    # Counts are written before they are joined back: a join of two plain exchanges is one whose hot keys Spark can split.
    twice = materialize(read.select(F.explode("prints").alias("f")).groupBy("f").count().where("count > 1").select("f"), "twice")
    places = read.select("r", F.explode(F.arrays_zip(F.col("prints").alias("f"), F.col("places").alias("p"))).alias("x")).select("r", "x.f", "x.p")
    some = places.join(twice, "f", "left_semi").groupBy("r").agg(F.collect_set("p").alias("places"))
    some = materialize(read.select("r", "k1", "k2").join(some, "r").groupBy("k1", "k2").agg(F.min_by("places", "r").alias("places")), "places")
    discard(read)
    few = some.count() <= MOST_KEYS
    keys = some.select("k1", "k2")
    keys = F.broadcast(keys) if few else keys
    apart = materialize(keyed.join(keys, ["k1", "k2"], "left_semi").withColumn("t", F.monotonically_increasing_id()), "texts")
    copies = materialize(apart.groupBy("k1", "k2").agg(F.min("t").alias("t"), F.count("*").alias("rows")), "copies")
    chosen = copies.join(some, ["k1", "k2"]).select("t", "rows", "places")
    windows = materialize(_windows(apart.select("t", "text").join(chosen, "t"), window), "windows")
    each = windows.select("t", "rows", F.explode(F.arrays_zip("starts", "h", "c")).alias("x")).select("t", "rows", "x.starts", "x.h", "x.c")
    again = materialize(each.groupBy("h", "c").agg(F.sum("rows").alias("n")).where("n > 1").select("h", "c"), "again")
    alone = each.where("rows = 1").join(again, ["h", "c"], "left_semi").groupBy("t").agg(F.collect_list("starts").alias("starts"))
    repeated = salted_join(apart.select("k1", "k2", "t"), copies.where("rows > 1").select("k1", "k2"), ["k1", "k2"], "t", counts=copies.select("k1", "k2", "rows"))
    starts = materialize(alone.union(repeated.select("t", F.array(F.lit(WHOLE)).cast("array<bigint>"))), "starts")
    discard(windows, again)
    cut = _cut(apart.select("t", "row", "text").join(starts, "t", "left").drop("t"), window)
    whole = _cut(keyed.join(keys, ["k1", "k2"], "left_anti").select("row", "text", F.array().cast("array<bigint>").alias("starts")), window)
    both = cut.select("row", "text", "n_words", "n_removed").unionByName(whole.select("row", "text", "n_words", "n_removed"))
    return both.select(*[F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in order], "n_words", "n_removed")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its repeated passages."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM s JOIN d USING (rid)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY rid),
u AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT rid, unnest(gone) AS i FROM c),
k AS (SELECT u.rid, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN a END, ' ' ORDER BY u.i), '') AS kept FROM u LEFT JOIN g ON g.rid = u.rid AND g.i = u.i GROUP BY u.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
