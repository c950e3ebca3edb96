"""Exact deduplication with skew-safe combining of whole texts.

Texts are equal when identical without ASCII white space. One pass writes a thin table of all rows: id, length, digest
and a 64-bit key of the digest. Then the contents are compared, never the digests alone, in three stages:

1. Locally: a worker folds equal contents of its rows, a bounded window of bytes at a time, into one row a content that
   has the best row's length and id and the number of rows.
2. Salted groups: these rows meet by key and content. A hot key, of which there are fewer than common.HOT_SHARE, has its
   rows dealt over as many salts as its rows ask for; others need no salt and are finished here.
3. Globally: the winners of a hot key's salts, one a salt and content, meet by key and content.

The winners go back to the rows of the thin table by their key, again in slices where it is hot. Keys that different contents share
are settled by joining their rows on the content itself. So contents are shuffled once, those of hot keys once more, and
no task gets more of a group than a worker's folds leave, a salt.

Defined results: the row with the most code points in its original text, then the smallest id, stays; a null id comes
after all others; a null text counts as an empty one, and all texts of white space are equal; rows that repeat a winner's
id and length are its copies, and just one of them is kept; very long texts are compared whole; an empty table gives an
empty one; other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm import common
from skyweave.llm.common import PART, as_bytes, discard, materialize, salted_join, table

#: The characters that don't count.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of contents that a worker folds at a time.
WINDOW_BYTES = 32 << 20
KEY_BITS = 64

_THIN = T.StructType([T.StructField("id", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("key", T.LongType()), T.StructField("sha256", T.StringType())])
_WHOLE = T.StructType([*_THIN.fields, T.StructField("content", T.BinaryType())])
_FOLDED = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("id", T.LongType()), T.StructField("rows", T.LongType())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[bytes], list[bytes]]]:
    """(ids, lengths, contents, digests) of parts of about PART bytes of (id, text) batches."""
    for whole in batches:
        step = max(1, whole.num_rows * PART // max(1, whole.nbytes))
        for first in range(0, whole.num_rows, step):
            b = whole.slice(first, step)
            contents = [t.translate(None, SPACE) for t in as_bytes(b.column(1))]
            yield b.column(0), pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64()), contents, [hashlib.sha256(c).digest() for c in contents]


def _key(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big", signed=True) >> (64 - bits)


def _rows(docs: DataFrame, bits: int, with_content: bool) -> DataFrame:
    """The thin table of (id, text) rows, or that with contents."""
    names = (_WHOLE if with_content else _THIN).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chars, contents, digests in _read(batches):
            cols = [ids, chars, pa.array([_key(d, bits) for d in digests], pa.int64()), pa.array([d.hex() for d in digests], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(contents, pa.binary())] if with_content else []), names=names)

    return docs.mapInArrow(run, _WHOLE if with_content else _THIN)


def _folded(docs: DataFrame, bits: int, window_bytes: int) -> DataFrame:
    """Stage 1: a row a content and window, with its best row's length and id, and its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> pa.RecordBatch:
            cols = [[k for k, _ in held], [c for _, c in held], *zip(*held.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_FOLDED.names)

        for ids, chars, contents, digests in _read(batches):
            for i, n, c, d in zip(ids.to_pylist(), chars.to_pylist(), contents, digests, strict=True):
                at = (_key(d, bits), c)
                before = held.get(at)
                if before is None:
                    held[at] = (n, i, 1)
                    size += len(c) + 100
                else:
                    best, who, rows = before
                    if n > best or n == best and i is not None and (who is None or i < who):
                        best, who = n, i
                    held[at] = (best, who, rows + 1)
            if size >= window_bytes:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _FOLDED)


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows equal in `keys` as one: the best one's chars and id, and the sum of rows."""
    out = rows.groupBy(*keys).agg(F.min(F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().alias("nameless"), "id")).alias("best"), F.sum("rows").alias("rows"))
    return out.select(*keys, (-F.col("best.short")).alias("chars"), F.col("best.id").alias("id"), "rows")


def _winners(docs: DataFrame, counts: DataFrame, bits: int, window_bytes: int) -> DataFrame:
    """(key, chars, id, rows) of every content, by the three stages."""
    whole = counts.agg(F.sum("rows").alias("n")).first().n or 0
    size = max(whole / common.HOT_SHARE, common.HOT_ROWS)
    hot = counts.where(F.col("rows") > size).select("key", F.ceil(F.col("rows") / size).alias("salts"))  # fewer than HOT_SHARE rows
    dealt = _folded(docs, bits, window_bytes).join(F.broadcast(hot), "key", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id", "chars"), F.col("salts"))).otherwise(-1))
    salted = _combined(dealt, "key", "salt", "content")
    salted = materialize(salted.withColumn("content", F.when(F.col("salt") >= 0, F.col("content"))), "salted")
    done = salted.where("salt < 0").select("key", "chars", "id", "rows")
    return done.union(_combined(salted.where("salt >= 0"), "key", "content").drop("content"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = KEY_BITS, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, n_chars) of every row; `bits` of the digest are the key that contents meet by."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    thin = materialize(_rows(base, bits, False), "digests")
    counts = materialize(thin.groupBy("key").agg(F.count("*").alias("rows")), "digest-counts")
    best = materialize(_winners(base, counts, bits, window_bytes).withColumn("group", F.monotonically_increasing_id()), "winners")
    shared = materialize(best.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    named = lambda df: df.select(*[c for c in ("key", "content") if c in df.columns], F.col("chars").alias("keep_chars"), F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), "group")
    columns = ["id", "chars", "sha256", "keep_chars", "keep_id", "group_size", "group"]
    if shared.isEmpty():
        placed = salted_join(thin, named(best), ["key"], "id", counts=counts).select(columns)
    else:
        placed = salted_join(thin.join(shared, "key", "left_anti"), named(best), ["key"], "id").select(columns)
        rows = materialize(_rows(base, bits, True).join(shared, "key", "left_semi"), "shared-contents")
        own = materialize(_combined(rows.withColumn("rows", F.lit(1).cast("long")), "key", "content").withColumn("group", -1 - F.monotonically_increasing_id()), "shared-winners")
        placed = placed.union(salted_join(rows, named(own), ["key", "content"], "id").select(columns))
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "grouped")
    first = (F.col("chars") == F.col("keep_chars")) & F.col("id").eqNullSafe(F.col("keep_id"))
    seen = placed.where(first).agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups")).first()
    discard(thin, counts, best, shared)
    if seen.rows == seen.groups:
        out = placed.withColumn("kept", first)
    else:  # rows that repeat the winner
        one = placed.where(first).groupBy("group").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("one"))
        out = placed.join(one, "row", "left").withColumn("kept", F.coalesce("one", F.lit(False)))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"), F.col("chars").alias("n_chars"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one a group, with all their columns."""
    found = materialize(exact_groups(docs, id_col, text, **options), "exact-groups")
    stay = found.where("kept").select(F.col(f"`{id_col}`").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"))
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumns({"__own": F.col(f"`{id_col}`").cast("long"), "__digest": F.sha2(F.translate(whole, SPACE.decode(), ""), 256), "__chars": F.length(whole)})
    out = marked.join(stay, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")) & (F.col("__chars") == F.col("__n")), "left_semi")
    same = found.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha")) & (F.col("n_chars") == F.col("__n")), "left_semi")
    if same.count() > found.where("kept").count():
        out = out.dropDuplicates(["__own", "__digest", "__chars"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the row that stays for it."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT rid, doc_id, length(t) AS n_chars, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST, rid) AS place, count(*) OVER (PARTITION BY norm) AS group_size,
      first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST, rid) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256, n_chars FROM r"""
