"""Tables in the folder that all executors share, to cut a lineage so that a lost executor costs little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local sessions that leave it unset) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skyweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by materialize() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            system, where = _place(df.sparkSession, path)
            system.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    system, where = _place(spark, path)
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    system, where = _place(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a path to a name that is free, in one step; another's path there is an error."""
    system, where = _place(spark, old)
    if system.exists(_place(spark, new)[1]) or not system.rename(where, _place(spark, new)[1]):
        raise FileExistsError(new)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    system, where = _place(spark, path)
    return system.getContentSummary(where).getLength()
