"""Results frozen in the shared folder: pages of one answer, and answers built batch by batch."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.plans.scratch import delete, exists, materialize, rename, shared_dir, size_of

#: Batches of one request, keys remembered between batches, and rows of a snapshot.
BATCHES, SEEN, MOST_BYTES = 32, 100_000, 64 << 20


def freeze(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` written once, in order, so that all pages are of the same answer."""
    return materialize(rows.orderBy(*order), "snapshot").withColumn("__order", F.struct(*order))


def keyed(rows: DataFrame, identity: dict, order: list[str], most: int = MOST_BYTES) -> DataFrame:
    """As freeze(), under the digest of what the answer is of: asked again, the first answer is read.

    An answer is written aside and renamed once it fits; one of more than `most` bytes is an error, each time it is asked
    for, and leaves nothing. Of two callers at once the first to rename gives the answer of both.
    """
    spark = rows.sparkSession
    name = hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    path = f"{shared_dir(spark)}/snapshot-{name}"
    if not exists(spark, path):
        aside = f"{path}-{uuid.uuid4().hex}"
        rows.orderBy(*order).write.parquet(aside)
        if (n := size_of(spark, aside)) > most:
            delete(spark, aside)
            raise ValueError(f"{n} bytes exceed the {most} of a snapshot")
        try:
            rename(spark, aside, path)
        except FileExistsError:
            delete(spark, aside)
    return spark.read.schema(rows.schema).parquet(path).withColumn("__order", F.struct(*order))


def page(frozen: DataFrame, offset: int, size: int, scope: Column | None = None) -> DataFrame:
    """`size` rows of a frozen answer from `offset` on, of a sub-scope if given."""
    rows = frozen if scope is None else frozen.where(scope)
    return rows.orderBy("__order").offset(offset).limit(size).drop("__order")


def in_batches(find: Callable[[DataFrame], DataFrame], batches: Sequence[DataFrame], key: str, seen: DataFrame | None = None, start: int = 0, most: int = SEEN) -> tuple[DataFrame, int | None]:
    """((key, batch), next): what `find` gives for each batch from `start` on, less the keys of `seen` and of earlier batches.

    The batch that brings more than `most` new keys ends the turn and is given whole: `next` is then the batch to go on
    from, with the keys found as `seen`. After the last batch it is None.
    """
    if len(batches) > BATCHES:
        raise ValueError(f"more than {BATCHES} batches")
    new = 0
    for k in range(start, len(batches)):
        found = find(batches[k]).select(key).distinct()
        found = found if seen is None else found.join(seen.select(key), key, "left_anti")
        found = materialize(found.withColumn("batch", F.lit(k).cast("long")), "batch")
        seen = found if seen is None else seen.unionByName(found)
        new += found.count()
        if new > most and k + 1 < len(batches):
            return seen, k + 1
    return seen, None
