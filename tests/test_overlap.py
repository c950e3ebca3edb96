"""Overlap, regions, bounds, cones, region queries and selectors against fixtures and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import overlap, ranges, region

LAYER = "survey_id string, layer_id string, order int, ipix long"


def test_fixture_of_common_orders(spark):
    rows = [("a", "a-one", 4, 100), ("a", "a-one", 8, 200), ("a", "a-two", 4, 101), ("b", "b-one", 4, 100), ("b", "b-one", 4, 101), ("b", "b-one", 8, 200)]
    found = overlap.overlap(spark.createDataFrame(rows, LAYER), ["a", "b"])
    assert sorted((r.order, r.ipix) for r in found.collect()) == [(4, 100), (4, 101)]
    assert [tuple(r) for r in overlap.limiting_layers(spark.createDataFrame(rows, LAYER), ["a", "b"], 8).collect()] == [("a-two", "4")]


def test_fixture_of_a_coarser_order(spark):
    rows = [("a", "a", 4, 637), ("a", "a", 8, 548923), ("b", "b", 4, 637), ("b", "b", 8, 283791)]
    assert [(r.order, r.ipix) for r in overlap.overlap(spark.createDataFrame(rows, LAYER), ["a", "b"]).collect()] == [(4, 637)]
    assert overlap.overlap(spark.createDataFrame(rows[:2] + [("b", "b", 4, 5)], LAYER), ["a", "b"]).collect() == []
    assert overlap.overlap(spark.createDataFrame(rows, LAYER), ["a", "b"], most=3).collect() == []


def test_boundaries_meet_the_neighbours(spark):
    """Corners are shared by neighbours: two with each side neighbour, and the centre lies between them."""
    for order in (0, 1, 3):
        cells = spark.range(hpx.cells(order)).select("id", hpx.boundaries(order, F.col("id")).alias("b"), hpx.neighbours4(order, F.col("id")).alias("n"), hpx.pix2ang(order, F.col("id")).alias("c"))
        rows = {r.id: r for r in cells.collect()}
        corners = {i: {(round(p.x, 9) + 0.0, round(p.y, 9) + 0.0, round(p.z, 9) + 0.0) for p in r.b} for i, r in rows.items()}
        for i, r in rows.items():
            assert len(corners[i]) == 4 and all(len(corners[i] & corners[j]) >= (2 if order else 1) for j in r.n)
            assert all(abs(p.x**2 + p.y**2 + p.z**2 - 1) < 1e-12 for p in r.b)
            far = max(math.degrees(math.acos(max(-1, min(1, sum(a * b for a, b in zip(p, (math.cos(math.radians(r.c.dec)) * math.cos(math.radians(r.c.ra)), math.cos(math.radians(r.c.dec)) * math.sin(math.radians(r.c.ra)), math.sin(math.radians(r.c.dec))), strict=True)))))) for p in r.b)
            assert far <= hpx.max_pixel_radius(order) + 1e-9


def test_bounds_and_cones_by_hand(spark):
    rnd = random.Random(4)
    keys = {"wrap": [hpx_of(spark, [(359.0, 1.0), (1.0, 1.0)])], "some": [[rnd.randrange(3072) for _ in range(5)]]}
    rows = [(k, c) for k, (cells,) in keys.items() for c in set(cells)]
    df = spark.createDataFrame(rows, "region string, ipix long")
    corners = {}
    for r in df.select("region", F.explode(hpx.boundaries(4, F.col("ipix"))).alias("c")).select("region", "c.*").collect():
        corners.setdefault(r.region, []).append(((math.degrees(math.atan2(r.y, r.x)) + 360) % 360, math.degrees(math.asin(r.z))))
    cones = {r.region: r for r in overlap.cones(df, 4, "region").collect()}
    for r in overlap.bounds(df, 4, "region").collect():
        ras = sorted(a for a, _ in corners[r.region])
        gaps = [(b - a, k) for k, (a, b) in enumerate(zip(ras, ras[1:] + [ras[0] + 360], strict=True))]
        widest = max(g for g, _ in gaps)
        at = next(k for g, k in gaps if g == widest)
        assert (r.ra_min, r.ra_max) == pytest.approx((ras[(at + 1) % len(ras)], ras[at])) and r.ra_wraps == (r.ra_min > r.ra_max)
        assert (r.dec_min, r.dec_max) == pytest.approx((min(d for _, d in corners[r.region]), max(d for _, d in corners[r.region])))
        assert r.area_deg2 == pytest.approx(r.cells * 41252.96124941927 / 3072)
        c = cones[r.region]
        span = 360 - r.ra_min + r.ra_max if r.ra_wraps else r.ra_max - r.ra_min
        assert (c.ra, c.dec) == pytest.approx(((r.ra_min + span / 2) % 360, (r.dec_min + r.dec_max) / 2))
        away = lambda a, d, c=c: math.degrees(math.acos(max(-1, min(1, math.sin(math.radians(d)) * math.sin(math.radians(c.dec)) + math.cos(math.radians(d)) * math.cos(math.radians(c.dec)) * math.cos(math.radians(a - c.ra))))))
        assert c.radius_deg == pytest.approx(max(away(a, d) for a, d in corners[r.region]) + 0.01)
    assert {r.region: r.ra_wraps for r in overlap.bounds(df, 4, "region").collect()}["wrap"]


def hpx_of(spark, points, order=4):
    return [r[0] for r in spark.createDataFrame(points, "ra double, dec double").select(hpx.ang2pix(order, F.col("ra"), F.col("dec"))).collect()]


def test_regions_against_flood_fill(spark):
    rnd = random.Random(6)
    cells = set(rnd.sample(range(768), 250))
    beside = {r.id: r.n for r in spark.range(768).select("id", hpx.neighbours4(3, F.col("id")).alias("n")).collect()}
    want, left = {}, set(cells)
    while left:
        todo, part = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.discard(c)
                part.add(c)
                todo += beside[c]
        want |= {c: min(part) for c in part}
    got = {r.ipix: r.component for r in overlap.regions(spark.createDataFrame([(c,) for c in cells], "ipix long"), 3).collect()}
    assert got == want


def _joined(pairs, cells):
    """Each cell's smallest joined cell, by union-find."""
    head = {c: c for c in cells}

    def find(c):
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    for a, b in pairs:
        if a in head and b in head:
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {c: find(c) for c in cells}


@pytest.mark.parametrize("alone,bits", [(100_000, 12), (0, 12), (0, 4), (0, 2)])
def test_regions_by_blocks_of_any_size(spark, monkeypatch, alone, bits):
    monkeypatch.setattr(overlap, "ALONE", alone)
    monkeypatch.setattr(overlap, "BLOCK_BITS", bits)
    rnd = random.Random(bits)
    beside = spark.range(12 * 4**5).select("id", F.explode(hpx.neighbours4(5, F.col("id"))).alias("n")).where("n is not null").toPandas()
    for share in (0.45, 0.62, 0.9) if alone else (0.62,):
        cells = {c for c in range(12 * 4**5) if rnd.random() < share}
        got = overlap.regions(spark.createDataFrame([(c,) for c in cells], "ipix long"), 5).collect()
        want = _joined(zip(beside["id"].tolist(), beside["n"].tolist(), strict=True), cells)
        assert {r.ipix: r.component for r in got} == want
        names = {c: f"C{k + 1:02d}" for k, c in enumerate(sorted(set(want.values())))}
        assert all(r.region == names[r.component] for r in got)
    assert overlap.regions(spark.createDataFrame([], "ipix long"), 5).collect() == []


def test_regions_of_many_cells_take_few_jobs(spark):
    """200,000 cells of order 9, a winding band across the sky: more than one block holds, in a number of jobs that doesn't grow."""
    cells = spark.range(hpx.cells(9)).select(F.col("id").alias("ipix"), hpx.pix2ang(9, F.col("id")).alias("c")).where("abs(c.dec - 40 * sin(radians(c.ra * 7))) < 4.2").select("ipix")
    spark.sparkContext.setJobGroup("regions", "regions")
    found = overlap.regions(cells, 9)
    n, heads = found.count(), found.select("region").distinct().count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("regions"))
    spark.sparkContext.setJobGroup("", "")
    assert n > 190_000 and heads == 1 and jobs <= 30, (n, heads, jobs)


def test_strict_overlap_grows_beyond_the_view(spark):
    line = [k for k in range(256, 320)]
    rows = [(s, 6, c) for s in ("a", "b") for c in line + [5000]] + [("a", 5, 900)]
    df = spark.createDataFrame(rows, "survey_id string, order int, ipix long")
    whole = overlap.strict_overlap(df, ["a", "b"], 6)
    assert sorted(r.ipix for r in whole.collect()) == line + [5000]
    # One tile of order 0 holds the line; the other cell's region isn't in view.
    seen = overlap.strict_overlap(df, ["a", "b"], 6, tiles=[0])
    assert sorted(r.ipix for r in seen.collect()) == line
    with pytest.raises(overlap.OverBudget) as e:
        overlap.strict_overlap(df, ["a", "b"], 6, budget=10)
    assert e.value.action == "zoom-or-reduce-selection"
    narrow = spark.createDataFrame([(s, 7, c) for s in ("a", "b") for c in range(4096 - 40, 4096 + 60)], "survey_id string, order int, ipix long")
    with pytest.raises(ValueError, match="192"):
        overlap.strict_overlap(narrow, ["a", "b"], 7, tiles=list(range(200)))


def test_region_query_shares_its_budget(spark):
    coverage = spark.createDataFrame([("x", 6, c) for c in range(100, 110)] + [("y", 4, 6)] + [("z", 7, c) for c in range(400, 420)], "layer_id string, order int, ipix long")
    sources = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "source_no long, layer_id string")
    cells = region.check_region(6, list(range(96, 112)), ["x", "y", "z"])
    got = region.query_region(sources, coverage, 6, cells, 12).collect()
    assert sorted((r.source_no, r.order, r.ipix) for r in got) == [(1, 6, c) for c in range(100, 110)] + [(2, 4, 6), (3, 6, 100)]
    assert {r.source_no: (r.truncated, r.operation) for r in got} == {1: (False, "exact-native-cell-intersection"), 2: (False, "exact-native-cell-intersection"), 3: (True, "conservative-projection")}
    for bad in ((14, [0], ["x"]), (6, [], ["x"]), (6, [0], []), (6, [0], ["x", "x"]), (6, [0], ["public:x"]), (4, list(range(60)), ["x"]), (6, [49152], ["x"])):
        with pytest.raises(ValueError):
            region.check_region(*bad)


def test_selectors(spark):
    rows = region.selector(spark, region=[(6, c) for c in range(80, 96)] + [(7, 999)]).collect()
    assert [(r.order, r.ipix, r.batch) for r in rows] == [(4, 5, 0), (7, 999, 1)]
    for bad in ({}, {"cells": (4, [1]), "region": [(4, 1)]}, {"cells": (4, [])}, {"region": [(3, 1)]}, {"cells": (14, [1])}):
        with pytest.raises(ValueError):
            region.selector(spark, **bad)
    cover = region.selector(spark, rectangle=(10.0, 12.0, 0.0, 2.0), target=6)
    assert cover.groupBy("batch").count().agg(F.max("count")).first()[0] <= 64


def test_rectangle_report_and_poles(spark):
    cover = region.cover_rectangle(spark, 0.0, 360.0, 85.0, 90.0, target=6)
    report = region.cover_report(cover, 0.0, 360.0, 85.0, 90.0).first()
    assert report.cover_deg2 >= report.rectangle_deg2 > 0 and report.excess_deg2 == pytest.approx(report.cover_deg2 - report.rectangle_deg2)
    # At the pole a cell can be inside, as nothing lies beyond the bound.
    wide = {(r.order, r.ipix): r.state for r in region.cover_rectangle(spark, 0.0, 360.0, 60.0, 90.0, target=5).collect()}
    assert all(wide[4, p] == "inside" for p in (255, 511, 767, 1023))
    assert {tuple(r) for r in ranges.canonical(cover.select("order", "ipix"), finest=6).select("order", "ipix").collect()} == {tuple(r) for r in cover.select("order", "ipix").collect()}


def test_views(spark):
    cells = spark.range(hpx.cells(6)).withColumnRenamed("id", "ipix")
    near = {r.ipix for r in region.in_view(cells, 6, 30.0, 10.0, 5.0, far_side=False).collect()}
    both = {r.ipix for r in region.in_view(cells, 6, 30.0, 10.0, 5.0).collect()}
    assert set(hpx_of(spark, [(30.0, 10.0), (34.0, 12.0)], 6)) <= near and set(hpx_of(spark, [(210.0, -10.0)], 6)) <= both - near
    assert region.in_view(cells, 6, 0.0, 0.0, 90.0).count() == hpx.cells(6)
    tiles = spark.createDataFrame([("a", c) for c in range(192)] + [("b", c) for c in range(96)], "survey_id string, ipix long")
    with pytest.raises(ValueError, match="budget"):
        region.shared_view_tiles(tiles, ["a", "b"], 8, 0.0, 0.0, 60.0, budget=3)


def test_healpix_list_refuses_coarse_layers(spark):
    cells = spark.createDataFrame([("x", 6, 5), ("y", 4, 3)], "layer_id string, order int, ipix long")
    with pytest.raises(ValueError, match="y"):
        region.healpix_list(cells, 5)
    assert [r.ipix for r in region.healpix_list(cells, 4).collect()] == [0, 3]


def test_without_a_budget_a_view_gives_whole_regions(spark):
    """regions larger than any budget come whole, those out of view don't."""
    line = list(range(256, 320))
    df = spark.createDataFrame([(s, 6, c) for s in ("a", "b") for c in line + [5000]], "survey_id string, order int, ipix long")
    seen = overlap.strict_overlap(df, ["a", "b"], 6, tiles=[0], budget=None).collect()
    assert sorted(r.ipix for r in seen) == line and {r.region for r in seen} == {"C01"}
