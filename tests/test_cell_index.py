"""The index on disk: pruning by folders, refreshing of changed sources alone, and what a failure leaves."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import units
from skyweave.plans.scratch import delete, shared_dir
from skyweave.sources import cell_index


def _rows(spark, n, seed, source):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(50), rnd.randrange(786_432) if rnd.random() < 0.9 else None, rnd.choice(["G", None, "R"]), source) for _ in range(n)]
    return spark.createDataFrame(rows + rows[: n // 10], "unit_id long, ipix long, band string, source string")


def _arrive(df, root):
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(root)


@pytest.fixture
def folders(spark, tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/index"


def _judge(rows):
    return units.judged_rows(rows, {"no-band": F.col("band").isNull()})


def test_a_lookup_reads_the_requested_parts_alone(spark, folders):
    root, target = folders
    _arrive(_rows(spark, 4000, 1, "a").union(_rows(spark, 3000, 2, "b")), root)
    cell_index.refresh(spark, root, target, _judge)
    request = spark.createDataFrame([(5,), (6,), (2000,), (5,), (None,)], "cell long")
    found = cell_index.lookup(spark, target, request)
    want = spark.read.option("basePath", root).parquet(root).where("band is not null and ipix is not null").distinct().where("floor(ipix / 256) in (5, 6, 2000)")
    columns = ["unit_id", "ipix", "band", "source"]
    assert found.count() > 0 and found.select(columns).exceptAll(want.select(columns)).isEmpty() and want.select(columns).exceptAll(found.select(columns)).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "coarse_cell" in plan.split("PushedFilters")[1]
    files = spark.read.parquet(f"{target}/rows").select("part", "_metadata.file_path").distinct()
    scans = [x for x in _leaves(found) if x.metrics().contains("numFiles")]
    assert len(scans) == 1 and scans[0].selectedPartitions().totalNumberOfFiles() == files.where("part in (0, 31)").count() < files.count() / 10
    assert cell_index.lookup(spark, target, request, sources=["b"]).select("source").distinct().collect()[0][0] == "b"
    assert cell_index.lookup(spark, target, request.limit(0)).collect() == []


def _leaves(df):
    plan = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [plan.apply(k) for k in range(plan.size())]


def test_a_refresh_reads_changed_sources_alone_and_equals_a_rebuild(spark, folders):
    root, target = folders
    _arrive(_rows(spark, 800, 1, "a").union(_rows(spark, 700, 2, "b")).union(_rows(spark, 600, 3, "c")), root)
    first = cell_index.refresh(spark, root, target, _judge)
    assert {r.state for r in first.collect()} == {"built"}
    read = []

    def judge(rows):
        read.extend(rows.inputFiles())
        return _judge(rows)

    _arrive(_rows(spark, 500, 9, "b"), root)
    _arrive(_rows(spark, 100, 10, "d"), root)
    delete(spark, f"{root}/source=c")
    second = cell_index.refresh(spark, root, target, judge)
    assert {r.source: r.state for r in second.collect()} == {"a": "reused", "b": "built", "d": "built"}
    assert read and all("source=b" in f or "source=d" in f for f in read)
    full = cell_index.refresh(spark, root, f"{target}-again", _judge)
    same = ["source", "read", "excluded", "kept", "units", "cells"]
    assert sorted(map(tuple, second.select(same).collect())) == sorted(map(tuple, full.select(same).collect()))
    everything = spark.range(3072).withColumnRenamed("id", "cell")
    rows = [sorted(map(tuple, cell_index.lookup(spark, t, everything).select("source", "unit_id", "ipix", "band").collect())) for t in (target, f"{target}-again")]
    assert rows[0] == rows[1] and rows[0]
    assert cell_index.refresh(spark, root, target, judge).where("state = 'built'").isEmpty()
    before = len(rows[0])
    assert cell_index.vacuum(spark, target) == 2  # the builds of the first b and of c
    assert cell_index.lookup(spark, target, everything).count() == before


def test_a_refresh_that_fails_leaves_the_index(spark, folders):
    root, target = folders
    _arrive(_rows(spark, 300, 1, "a"), root)
    cell_index.refresh(spark, root, target, _judge)
    _arrive(_rows(spark, 400, 2, "a"), root)
    with pytest.raises(Exception, match="contract broken: any"):
        cell_index.refresh(spark, root, target, lambda rows: units.judged_rows(rows, {}, {"any": F.col("unit_id") >= 0}))
    everything = spark.range(3072).withColumnRenamed("id", "cell")
    assert cell_index.lookup(spark, target, everything).count() == cell_index.manifest(spark, target).agg(F.sum("kept")).first()[0]
    after = cell_index.refresh(spark, root, target, _judge)
    assert after.first().read == 440 and cell_index.lookup(spark, target, everything).count() == after.first().kept


def test_sources_of_no_accepted_rows(spark, folders):
    root, target = folders
    _arrive(spark.createDataFrame([(1, 5, None, "x"), (1, None, "G", "y")], "unit_id long, ipix long, band string, source string"), root)
    got = {r.source: (r.read, r.excluded, r.kept) for r in cell_index.refresh(spark, root, target, _judge).collect()}
    assert got == {"x": (1, 1, 0), "y": (1, 1, 0)}
    assert cell_index.lookup(spark, target, spark.range(3072).withColumnRenamed("id", "cell")).count() == 0
    assert shared_dir(spark)
