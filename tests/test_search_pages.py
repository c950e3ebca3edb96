"""Paging by cursor: every bucket once, nulls, pages that fail, files cut in two."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.sources import search_pages as pages

KIND = "layer_id string, ord int, ipix long"


def _edges(spark, n=900, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcdef"), rnd.choice([None, 0, 1, 2]), rnd.choice([None, *range(12)])) for _ in range(n)]
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("per_file", [10, 10**6])
@pytest.mark.parametrize("size", [7, 60, 1000])
def test_pages_hold_every_bucket_once(spark, size, per_file):
    edges = _edges(spark)
    stored = pages.Stored(edges, pages.CELL_KEY, per_file)
    got, after = [], None
    while rows := pages.buckets(stored, pages.CELL_KEY, after, size).collect():
        assert len(rows) <= size
        got += [tuple(r) for r in rows]
        after = tuple(rows[-1])[:3]
    want = [tuple(r) for r in edges.groupBy(*pages.CELL_KEY).agg(F.count("*")).orderBy(*[F.asc_nulls_first(k) for k in pages.CELL_KEY]).collect()]
    assert got == want
    assert pages.buckets(stored.rows, pages.CELL_KEY, got[5][:3], 4).collect() == pages.buckets(stored, pages.CELL_KEY, got[5][:3], 4).collect()


def test_a_page_pushes_its_cursor_down(spark):
    stored = pages.Stored(_edges(spark), pages.CELL_KEY, 50)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = pages.buckets(stored, pages.CELL_KEY, ("c", 1, 2), 5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(layer_id,c)" in plan and "LessThanOrEqual(layer_id" in plan


def test_harvest_commits_whole_layers_alone(spark):
    edges = _edges(spark).where("ord is not null and ipix is not null")
    edges = edges.union(spark.createDataFrame([("c", 0, 12), ("e", 30, 1)], KIND))
    layers = edges.groupBy("layer_id").agg(F.count("*").alias("edges")).union(spark.createDataFrame([("g", 5), ("h", 0)], "layer_id string, edges long"))
    cells, states = pages.harvest(lambda after: pages.buckets(edges, pages.CELL_KEY, after, 20), layers, 20)
    state = {r.layer_id: r.state for r in states.collect()}
    assert state == {"a": "committed", "b": "committed", "c": "failed: invalid cell", "d": "committed", "e": "failed: invalid cell", "f": "committed", "g": "failed: no cells", "h": "committed"}
    want = edges.where("layer_id in ('a', 'b', 'd', 'f')").groupBy(*pages.CELL_KEY).agg(F.count("*"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, want.collect()))


def test_a_missing_page_fails_its_layers(spark):
    edges = _edges(spark).where("ord is not null and ipix is not null")
    layers = edges.groupBy("layer_id").agg(F.count("*").alias("edges"))
    asked = []

    def fetch(after):
        asked.append(after)
        if after and after[0] >= "c":
            raise TimeoutError("no answer")
        return pages.buckets(edges, pages.CELL_KEY, after, 20)

    cells, states = pages.harvest(fetch, layers, 20)
    state = {r.layer_id: r.state for r in states.collect()}
    assert state["a"] == state["b"] == "committed" and all(state[x] == "failed: no answer" for x in "cdef")
    assert {r.layer_id for r in cells.select("layer_id").distinct().collect()} == {"a", "b"}
    none, states = pages.harvest(lambda after: 1 / 0, layers, 20)
    assert none.collect() == [] and {r.state for r in states.collect()} == {"failed: division by zero"}
    with pytest.raises(ValueError, match="did not advance"):
        pages.harvest(lambda after: pages.buckets(edges, pages.CELL_KEY, None, 20), layers, 20)
    none, states = pages.harvest(lambda after: pages.buckets(edges.limit(0), pages.CELL_KEY, after, 20), layers.limit(0), 20)
    assert none.collect() == [] and states.collect() == []


def test_edges_behind_a_cursor(spark):
    rows = [(f, layer, 8, k, "s") for f in (1, 2, 3) for layer in ("a", "b") for k in range(4)]
    edges = spark.createDataFrame(rows, "file_id long, layer_id string, ord int, ipix long, role string")
    page, after, cut = pages.edge_page(edges, None, 10)
    assert [tuple(r) for r in page.collect()] == rows[:10] and after == rows[9] and cut == [2]
    page, after, cut = pages.edge_page(pages.Stored(edges, pages.EDGE_KEY), after, 6)
    assert [tuple(r) for r in page.collect()] == rows[10:16] and cut == []
    page, after, cut = pages.edge_page(edges, after, 10, edges.where("file_id = 2"))
    assert [tuple(r) for r in page.collect()] == rows[16:] and after is None and cut == []
    assert pages.edge_page(edges, rows[-1], 10)[0].collect() == []


@pytest.mark.parametrize("per_file", [200, 10**6])
def test_all_pages_of_stored_rows_at_once(spark, per_file):
    """pages made side by side are the pages that a cursor gives, and their number costs no jobs."""
    edges = _edges(spark)
    stored = pages.Stored(edges, pages.CELL_KEY, per_file)
    got, after, n = [], None, 0
    while rows := pages.buckets(stored, pages.CELL_KEY, after, 60).collect():
        got += [(*r, n) for r in map(tuple, rows)]
        after, n = tuple(rows[-1])[:3], n + 1
    assert sorted(map(tuple, stored.pages(60).collect()), key=repr) == sorted(got, key=repr)
    sound = edges.where("ord is not null and ipix is not null").union(spark.createDataFrame([("c", 0, 12)], KIND))
    layers = sound.groupBy("layer_id").agg(F.count("*").alias("edges")).union(spark.createDataFrame([("g", 5)], "layer_id string, edges long"))
    one = pages.harvest(lambda a: pages.buckets(sound, pages.CELL_KEY, a, 200), layers, 200)
    two = pages.harvest_stored(pages.Stored(sound, pages.CELL_KEY, per_file), layers, 200)
    assert [sorted(map(tuple, x.collect())) for x in one] == [sorted(map(tuple, x.collect())) for x in two]
