"""Ranked lexical search: a blocked sparse product of item-term multiplicities and term-document impacts, in 64-bit integers.

Items (queries) are cut into terms; their vocabulary and their sparse rows are all that is broadcast, and the number of
(item, term) entries is checked: beyond `most` entries the items are dealt into shards of about that size, searched
one after another (an item is never cut). For a shard:

1. One pass over the texts counts all terms of a document and, for the shard's terms, how often each occurs: the sparse
   term-document matrix, written once. Its counts a term give the document frequencies, one number a vocabulary entry.
2. Documents are taken in blocks. A block's counts become int64 impacts, kept by term; an item's row of the product is
   Gustavson's merge: the impact rows of its terms added into one accumulator over the block's documents.
3. The best of a block join the best of the task's earlier blocks, so a task hands on at most `top` documents an item.
   These are ranked within salts and then over all salts, so no task gets an item's rows from all tasks.

Nothing but matrix rows and a task's best is ever written or shuffled, and no pair of an item and a document is, unless it is
among a task's best.

Defined results: a null or empty text (or one without terms) isn't found and doesn't count as a document; an item
without terms finds nothing, nor does any in an empty table; equal scores go by ascending id, a null id last, and
documents that repeat an id are ranked each; items of the same id and text count once, those of one id with different
texts are ranked apart; very long texts are counted whole (an integer beyond 64 bits in the length formula is computed
exactly); other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import FOLD_WORDS, PART, as_bytes, discard, materialize, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Results an item, (item, term) entries broadcast at a time, documents of a block, and salts of the last reduction.
TOP, MOST, BLOCK, SALTS = 10, 1_000_000, 8192, 64

_COUNTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
_BEST = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, tfs) of (id, text) rows: all terms of a text, and the counts of those in the broadcast vocabulary (bytes to numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = vocabulary.value.get, max(1, len(vocabulary.value))
        for whole in batches:
            step = max(1, whole.num_rows * PART // max(1, whole.nbytes))
            for first in range(0, whole.num_rows, step):
                b = whole.slice(first, step)
                ns, codes = [], []
                for raw in as_bytes(b.column(1)):
                    words = raw.translate(FOLD_WORDS).split()
                    ns.append(len(words))
                    codes.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words)))
                n = np.array(ns, dtype=np.int64)
                code = np.concatenate(codes)
                at = np.repeat(np.arange(len(n)), n) * size + code
                cells, tfs = np.unique(at[code >= 0], return_counts=True)
                ends = np.searchsorted(cells, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % size, tfs)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=_COUNTS.names)

    return docs.mapInArrow(run, _COUNTS)


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m, from its number of terms."""
    if 90 * n_docs * int(n.max(initial=0)) < 1 << 63:
        return 10 + 90 * n * n_docs // max(1, n_terms)
    return np.array([10 + 90 * int(x) * n_docs // max(1, n_terms) for x in n], dtype=np.int64)


class Block:
    """The impacts of a block of documents, by term."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        tf, m = tfs.astype(np.int64), lengths(n, n_docs, n_terms)
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1)).tolist()
        self.total = np.zeros(len(n), dtype=np.int64)

    def scores(self, terms: list[int], times: list[int]) -> np.ndarray:
        """An item's row of the product: the rows of its terms, merged."""
        total, starts = self.total, self.starts
        total[:] = 0
        for t, k in zip(terms, times, strict=True):
            a, b = starts[t], starts[t + 1]
            if a < b:  # a document stands once in a term's row
                total[self.doc[a:b]] += self.impact[a:b] if k == 1 else k * self.impact[a:b]
        return total


def best_of(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest scores above 0; equal ones by id, null ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], nameless[at], -scores[at]))[:top]]


def _ranked(counts: DataFrame, shared, n_docs: int, n_terms: int, top: int, block: int) -> DataFrame:
    """(item, id, score): a task's best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, block):
                b = whole.slice(first, block)
                ids = b.column(0)
                nameless, named = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
                terms, ends = b.column(2).flatten().to_numpy(), np.r_[0, np.cumsum(b.column(2).value_lengths().to_numpy())]
                product = Block(b.column(1).to_numpy(), ends, terms, b.column(3).flatten().to_numpy(), weights, n_docs, n_terms)
                for k, own, times in items:
                    scores = product.scores(own, times)
                    at = best_of(scores, named, nameless, top)
                    if len(at):
                        found = scores[at], named[at], nameless[at]
                        if k in best:
                            found = tuple(map(np.concatenate, zip(best[k], found, strict=True)))
                            at = best_of(*found, top)
                            found = tuple(x[at] for x in found)
                        best[k] = found
        for k, (scores, ids, nameless) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=nameless), pa.array(scores, pa.int64())], names=_BEST.names)

    return counts.select("id", "n", "terms", "tfs").mapInArrow(run, _BEST)


def _reduced(best: DataFrame, top: int, salts: int) -> DataFrame:
    """(item, rank, id, score): each item's best, first within salts of tasks."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    out = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    for keys in (["item", "salt"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item", "rank", "id", "score")


def _items(queries: DataFrame, id_col: str, text_col: str, once: bool) -> DataFrame:
    """(item, id, terms, times): distinct items that have a term, with the multiplicity of each."""
    rows = queries.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).distinct()
    words = F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(TERM), F.lit(0))
    cut = rows.select("id", F.monotonically_increasing_id().alias("item"), words.alias("words")).where("size(words) > 0")
    if once:
        return materialize(cut.select("item", "id", F.array_distinct("words").alias("terms"), F.lit(None).cast("array<int>").alias("times")), "items")
    each = cut.select("item", "id", F.explode("words").alias("w")).groupBy("item", "id", "w").agg(F.count("*").cast("int").alias("c"))
    return materialize(each.groupBy("item", "id").agg(F.collect_list("w").alias("terms"), F.collect_list("c").alias("times")), "items")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = TOP, once: bool = True, most: int = MOST, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """(query id, rank, document id, score): each query's `top` documents. A query's term counts once, or (`once` false) as often as it stands there."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = _items(queries, query_id, query_text, once)
    total = items.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    # Hashing deals unevenly, hence half-full shards.
    shards = 1 if total <= most else math.ceil(2 * total / most)
    found = None
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).select("item", "terms", "times").collect()
        part = _searched(spark, base, rows, top, block, salts)
        found = part if found is None else found.union(part)
    return found.join(items.select("item", F.col("id").alias("query")), "item").select(F.col("query").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _searched(spark: SparkSession, base: DataFrame, rows: list[Row], top: int, block: int, salts: int) -> DataFrame:
    """One shard's items against all documents."""
    names: dict[bytes, int] = {}
    own = [(r.item, [names.setdefault(t.encode(), len(names)) for t in r.terms], r.times or [1] * len(r.terms)) for r in rows]
    vocabulary = spark.sparkContext.broadcast(names)
    counts = materialize(count_terms(base, vocabulary), "term-counts")
    whole = counts.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    # At most one row a vocabulary entry, however many documents were counted.
    df = dict(map(tuple, counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
    weights = np.array([weight(whole.docs, df.get(t, 0)) for t in range(len(names))], dtype=np.int64)
    shared = spark.sparkContext.broadcast((own, weights))
    out = materialize(_reduced(_ranked(counts, shared, whole.docs, whole.terms or 0, top, block), top, salts), "ranked")
    discard(counts)
    vocabulary.unpersist()
    shared.unpersist()
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM d WHERE len(ws) > 0),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT item, item_id, unnest(ts) AS term FROM q),
c AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, s GROUP BY term, docs),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ws) * docs) // terms AS m FROM d, s),
r AS (SELECT item, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item, item_id, rid, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
