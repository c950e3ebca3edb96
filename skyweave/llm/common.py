"""Shared helpers of the training-data operators: table reads, shared scratch tables, Arrow column appending."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.plans.scratch import discard, materialize, shared_dir  # noqa: F401  (the operators' scratch tables)

#: Byte table for words `[0-9a-z]` and every non-ASCII byte: A-Z fold to a-z, all other ASCII becomes a space.
FOLD_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a part of an Arrow batch.
PART = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under `sf_dir`, read through Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot beyond a thousandth of all rows (and this many), so there are fewer than a thousand hot keys.
HOT_SHARE, HOT_ROWS = 1000, 100


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right`, which has one row a key, so that no hot key of `left` lands in one task.

    `counts` (keys, rows) has the rows of each key in `left`; it is counted if not given. The hashes of hot keys, fewer
    than HOT_SHARE, are all that the driver ever holds: hot rows of `left` are dealt into slices by the hash of the column
    `salt`, those of `right` are copied to each slice. Keys of equal hash are hot together, which changes no result.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("rows")) if counts is None else counts
    whole = counts.agg(F.sum("rows").alias("n"), F.max("rows").alias("most")).first()
    size = max((whole.n or 0) / HOT_SHARE, HOT_ROWS)
    if (whole.most or 0) <= size:
        return left.join(right, keys, how)
    tiers: dict[int, list[int]] = {}
    for h, n in counts.where(F.col("rows") > size).select(F.xxhash64(*keys), F.ceil(F.col("rows") / size).cast("long")).collect():
        tiers.setdefault(1 << (n - 1).bit_length(), []).append(h)
    slices = F.lit(1).cast("long")
    for n, hashes in tiers.items():
        slices = F.when(F.xxhash64(*keys).isin(hashes), F.lit(n).cast("long")).otherwise(slices)
    dealt = left.withColumn("__slice", F.pmod(F.xxhash64(salt), slices))
    copied = right.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    return dealt.join(copied, [*keys, "__slice"], how).drop("__slice")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less the columns whose names an operator is about to write (Spark's names ignore case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def append_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField], make: Callable[[], Callable[..., Sequence[pa.Array]]]) -> DataFrame:
    """Append columns computed batch by batch.

    `make()` runs once a task and returns a function from the input columns (Arrow arrays) to one Arrow array a
    field. Input columns of a field's name are replaced. Batches are bounded by Spark's Arrow record and byte limits, and
    given to the function in parts of about PART bytes, which bounds what a worker holds beside them.
    """
    base = without(df, {f.name for f in fields} - set(inputs))
    kept = [c for c in base.columns if c.lower() not in {f.name.lower() for f in fields}]
    schema = T.StructType([base.schema[c] for c in kept] + list(fields))
    read = base.select(*[base[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(base.columns)])
    at, names = [base.columns.index(c) for c in inputs], schema.names
    stay = [base.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            rows = max(1, whole.num_rows * PART // max(1, whole.nbytes))
            for first in range(0, whole.num_rows, rows):
                b = whole.slice(first, rows)
                new = fn(*[b.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in stay] + list(new), names=names)

    return read.mapInArrow(run, schema)


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]
