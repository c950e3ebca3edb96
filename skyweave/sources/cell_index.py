"""An index of rows by sky cell on disk, pruned by its folders when read and refreshed one input source at a time.

Inputs stand in folders source=<name> under a root. An index folder holds rows/source=.../build=.../part=..., where a part
is the coarse parent of a row's cell and rows are sorted by cell inside a file, and manifest-<n>, one small row a source,
which names the build that is current, the digest of the input it was made of, and what became of its rows. A refresh
compares digests of file names, sizes and times, reads the sources that changed and nothing else, and appends their new
builds; the manifest is renamed into place last, so a refresh that fails leaves the index as it was, and readers of an
older manifest keep their rows until vacuum() deletes builds that none names.

Defined results: rows with a reason are excluded and counted; equal rows of a source are kept once; a source without
files any more leaves the index; a row of a null cell is an error of the caller's rules, and is excluded as 'no-cell'.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.plans.scratch import children, delete, rename

#: Orders of a row's own cell, of the cell rows are found by, and of the folders.
CELL, COARSE, PART = 8, 4, 1
_MANIFEST = "source string, build string, digest string, files long, bytes long, read long, excluded long, kept long, units long, cells long, state string"


def inputs(spark: SparkSession, root: str) -> DataFrame:
    """(source, digest, files, bytes) of each input source, from the list of its files alone: none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    named = listed.withColumn("source", F.regexp_extract("path", r"/source=([^/]+)/", 1)).withColumn("h", F.xxhash64("path", "length", "at"))
    digest = F.concat_ws("-", F.count("*").cast("string"), F.sum("length").cast("string"), F.hex(F.bit_xor("h")), F.sum(F.col("h").cast("decimal(38,0)")).cast("string"))
    return named.groupBy("source").agg(F.sha2(digest, 256).alias("digest"), F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _generations(spark: SparkSession, target: str) -> list[str]:
    return sorted(c for c in children(spark, target) if c.startswith("manifest-"))


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The newest manifest, one row a source; without an index it is empty."""
    names = _generations(spark, target)
    return spark.read.schema(_MANIFEST).parquet(f"{target}/{names[-1]}") if names else spark.createDataFrame([], _MANIFEST)


def refresh(spark: SparkSession, root: str, target: str, judge: Callable[[DataFrame], DataFrame], unit: str = "unit_id", cell: str = "ipix") -> DataFrame:
    """Bring the index up to date with its inputs; its new manifest, whose state says which sources were built or reused.

    `judge` gives input rows a reason (null: accepted). Only sources that changed are read.
    """
    now = {r.source: r for r in inputs(spark, root).collect()}
    before = {r.source: r for r in manifest(spark, target).collect()}
    changed = sorted(s for s, r in now.items() if s not in before or before[s].digest != r.digest)
    rows = [tuple(before[s])[:-1] + ("reused",) for s in now if s not in changed]
    if changed:
        build = f"b{uuid.uuid4().hex}"
        raw = spark.read.option("basePath", root).parquet(*[f"{root}/source={s}" for s in changed]).withColumn("source", F.col("source").cast("string"))
        judged = judge(raw).withColumn("reason", F.coalesce("reason", F.when(F.col(cell).isNull(), "no-cell")))
        _write(judged.where("reason is null").drop("reason"), f"{target}/rows", build, cell)
        counts = judged.groupBy("source").agg(F.count("*").alias("read"), F.count("reason").alias("excluded"))
        kept = _read(spark, target, [(s, build) for s in changed]).groupBy("source").agg(F.count("*").alias("kept"), F.count_distinct(unit).alias("units"), F.count_distinct("coarse_cell").alias("cells"))
        for r in counts.join(kept, "source", "left").collect():
            x = now[r.source]
            rows.append((r.source, build, x.digest, x.files, x.bytes, r.read, r.excluded, r.kept or 0, r.units or 0, r.cells or 0, "built"))
    names = _generations(spark, target)
    new = f"manifest-{int(names[-1].split('-')[1]) + 1 if names else 1:08d}"
    staged = f"{target}/_{new}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(staged)
    rename(spark, staged, f"{target}/{new}")
    return manifest(spark, target)


def _write(rows: DataFrame, path: str, build: str, cell: str) -> None:
    """Distinct rows by source and part, sorted by cell; a part with many rows is split over files, never held by one task."""
    own = rows.distinct().withColumns({"build": F.lit(build), "coarse_cell": hpx.parent(F.col(cell), CELL - COARSE)}).withColumn("part", hpx.parent(F.col("coarse_cell"), COARSE - PART))
    spread = own.hint("rebalance", F.col("source"), F.col("part")).sortWithinPartitions("source", "part", "coarse_cell")
    spread.write.mode("append").partitionBy("source", "build", "part").parquet(path)


def _read(spark: SparkSession, target: str, builds: list[tuple[str, str]]) -> DataFrame:
    """Rows of some sources' builds: only their folders are listed."""
    have = [f"{target}/rows/source={s}/build={b}" for s, b in builds if f"build={b}" in children(spark, f"{target}/rows/source={s}")]
    found = spark.read.option("basePath", f"{target}/rows").parquet(*have) if have else spark.createDataFrame([], "coarse_cell long, unit_id long, source string, build string, part long")
    return found.withColumns({"source": F.col("source").cast("string")})


def lookup(spark: SparkSession, target: str, request: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Rows whose coarse cell is requested (`request`: cell, at the coarse order).

    The request's parts, at most 12 * 4^PART numbers, choose folders before any file is opened; inside them row groups
    without a requested cell are skipped by their statistics.
    """
    asked = request.select(F.col("cell").alias("coarse_cell")).where("cell is not null").distinct()
    ends = asked.groupBy(hpx.parent(F.col("coarse_cell"), COARSE - PART).alias("part")).agg(F.min("coarse_cell").alias("lo"), F.max("coarse_cell").alias("hi")).collect()
    named = manifest(spark, target)
    named = named if sources is None else named.where(F.col("source").isin(sources))
    rows = _read(spark, target, [(r.source, r.build) for r in named.where("kept > 0").collect()])
    near = rows.where(F.col("part").isin([r.part for r in ends]))
    if ends:
        near = near.where(F.col("coarse_cell").between(min(r.lo for r in ends), max(r.hi for r in ends)))
    return near.join(asked, "coarse_cell", "left_semi").drop("part", "build")


def vacuum(spark: SparkSession, target: str) -> int:
    """Delete builds that the newest manifest doesn't name; how many went."""
    current = {(r.source, r.build) for r in manifest(spark, target).collect()}
    gone = 0
    for source in children(spark, f"{target}/rows"):
        for build in children(spark, f"{target}/rows/{source}") if source.startswith("source=") else []:
            if build.startswith("build=") and (source[7:], build[6:]) not in current:
                delete(spark, f"{target}/rows/{source}/{build}")
                gone += 1
    return gone
