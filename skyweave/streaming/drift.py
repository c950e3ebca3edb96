"""The drift monitor as a stream: each batch of observations moves every source's state on by one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from skyweave.operators import catalogue
from skyweave.plans.scratch import exists

STATE = "id string, good_sha string, good_order int, failures long"


def monitor_stream(seen: DataFrame, sources: DataFrame, state: str, alert: int = 3) -> DataStreamWriter:
    """Write each source's state after batch n to `state`/n, from the one before; a batch that is run again writes the same.

    `seen` is a stream of (id, sha, max_order, error), `sources` a table as catalogue.monitor() takes it. Sources that a
    batch says nothing about keep their state. A source seen twice in a batch counts by its greatest revision.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{state}/{n - 1}"
        kept = spark.read.parquet(before) if exists(spark, before) else None
        old = kept.select("id", "good_sha", "good_order", "failures") if kept is not None else spark.createDataFrame([], STATE)
        once = batch.groupBy("id").agg(F.max(F.struct("sha", "max_order", "error")).alias("s")).select("id", "s.*")
        after = catalogue.monitor(sources.join(once.select("id"), "id", "left_semi"), once, old, alert)
        if kept is not None:
            after = after.unionByName(kept.join(once.select("id"), "id", "left_anti"))
        after.write.mode("overwrite").parquet(f"{state}/{n}")

    return seen.writeStream.foreachBatch(step)
