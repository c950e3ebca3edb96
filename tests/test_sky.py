"""HEALPix expressions, ranges, overlap and depth: known values, brute force, and every registered query against DuckDB."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import depth, overlap, ranges
from skyweave.plans import catalog, registry
from tests.oracle import SMALL, assert_same


#: Queries of overlaps that the smallest tables don't have.
EMPTY_WHEN_SMALL = {"agg_components", "agg_bounds", "agg_cone", "q_overlap_view"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        assert_same(spark, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, SMALL).collect() or name in EMPTY_WHEN_SMALL


def test_entry(spark):
    assert catalog.overlap_at(spark, SMALL, 2).count() > 0


@pytest.mark.parametrize("order", [0, 1, 3])
def test_pixels(spark, order):
    cells = spark.range(hpx.cells(order)).select("id", hpx.pix2ang(order, F.col("id")).alias("c"), hpx.neighbours4(order, F.col("id")).alias("beside"))
    assert cells.where(hpx.ang2pix(order, F.col("c.ra"), F.col("c.dec")) != F.col("id")).count() == 0
    sides = {r.id: r.beside for r in cells.collect()}
    assert all(len(set(b)) == 4 and all(i in sides[j] for j in b) for i, b in sides.items())


def test_domain_and_codes(spark):
    df = spark.createDataFrame([(0.0, 90.0), (359.999, -90.0), (360.0, 0.0), (-0.1, 0.0), (1.0, 90.1), (float("nan"), 0.0), (None, 0.0)], "ra double, dec double")
    got = [r[0] for r in df.select(hpx.ang2pix(4, F.col("ra"), F.col("dec"))).collect()]
    assert got[0] == 255 and got[1] is not None and got[2:] == [None] * 5
    r = spark.range(1).select(*hpx.uniq_decode(F.lit(4 * 4**13 + 12 * 4**13 - 1))).first()
    assert tuple(r) == (13, 12 * 4**13 - 1)


def _random_ranges(rnd, n):
    return [(k % 3, lo, lo + rnd.randint(1, 30)) for k in range(n) for lo in [rnd.randint(0, 900)]]


def test_ranges_against_sets(spark):
    rnd = random.Random(4)
    rows = _random_ranges(rnd, 60)
    df = spark.createDataFrame(rows, "k int, lo long, hi long")
    sets = {k: {c for q, lo, hi in rows if q == k for c in range(lo, hi)} for k in range(3)}
    merged = ranges.union(df, "k")
    assert {(r.k, r.ipix) for r in ranges.expand(merged).collect()} == {(k, c) for k, s in sets.items() for c in s}
    by_key = {k: merged.where(F.col("k") == k).select("lo", "hi") for k in range(2)}
    assert {r.ipix for r in ranges.expand(ranges.intersect(by_key[0], by_key[1], block=16)).collect()} == sets[0] & sets[1]
    for block in (16, 7, ranges.BLOCK):
        assert sorted(map(tuple, ranges.union(df, "k", block=block).select("k", "lo", "hi").collect())) == sorted(map(tuple, merged.select("k", "lo", "hi").collect()))
    assert {r.ipix for r in ranges.expand(ranges.intersect_all(df, "k", 3, block=32)).collect()} == sets[0] & sets[1] & sets[2]
    assert [r.ipix for r in ranges.page(by_key[0], 100, 50).orderBy("ipix").collect()] == sorted(c for c in sets[0] if c >= 100)[:50]
    points = spark.range(0, 950).withColumnRenamed("id", "ipix")
    assert {r.ipix for r in ranges.contained(points, by_key[1], block=16).collect()} == sets[1]
    with pytest.raises(ValueError, match="budget"):
        ranges.expand(merged, budget=10)


def test_canonical_cells(spark):
    cells = lambda rows: spark.createDataFrame(rows, "order int, ipix long")
    show = lambda df: sorted((r.order, r.ipix) for r in df.collect())
    assert show(ranges.canonical(cells([(6, k) for k in range(80, 96)]))) == [(4, 5)]
    assert show(ranges.canonical(cells([(4, 5), (6, 81)]))) == [(4, 5)]
    assert show(ranges.canonical(cells([(4, k) for k in range(4)]))) == [(4, k) for k in range(4)]
    one, other = cells([(5, 20), (5, 21), (5, 22), (5, 23)]), cells([(4, 5)])
    assert ranges.identity(one).first().revision == ranges.identity(other).first().revision
    assert show(ranges.overlapping_cells(cells([(4, 5), (6, 81), (7, 9), (7, 9)]))) == [(6, 81), (7, 9)]
    assert ranges.is_full_sky(spark.range(12).select(F.lit(0).alias("order"), F.col("id").alias("ipix"))).first().full_sky


def test_overlap_regions(spark):
    cells = spark.createDataFrame([("a", "a1", 100), ("a", "a2", 101), ("b", "b1", 100), ("b", "b1", 101), ("b", "b1", 2000)], "survey_id string, layer_id string, ipix long")
    found = overlap.shared_cells(cells)
    assert sorted(r.ipix for r in found.collect()) == [100, 101]
    beside = spark.range(1).select(F.element_at(hpx.neighbours4(4, F.lit(1000)), 1).alias("n")).first().n
    got = overlap.regions(spark.createDataFrame([(1000,), (beside,), (10,)], "ipix long"), 4).collect()
    assert {r.ipix: r.region for r in got} == {10: "C01", 1000: "C02", beside: "C02"}
    with pytest.raises(ValueError, match="budget"):
        overlap.regions(found, 4, budget=1)
    assert overlap.finest_overlap({8: cells.where("ipix < 0"), 4: cells}, ["a", "b"])[0] == 4


def test_depth(spark):
    nodes = depth.distance_nodes()
    assert len(nodes) == 1025 and nodes[0] == 0.0 and abs(nodes[512] - 3395.6) < 15
    z = spark.createDataFrame([(0.0,), (depth.STEP * 1.5,), (2.0,), (2.01,), (-0.1,), (None,)], "z double")
    got = [r[0] for r in depth.with_distance(z, nodes=nodes).select("distance").collect()]
    assert got[0] == 0.0 and abs(got[1] - (nodes[1] + nodes[2]) / 2) < 1e-9 and got[2] == nodes[-1] and got[3:] == [None] * 3
    points = spark.createDataFrame([(float(k % 360), 10.0, float(k)) for k in range(400)], "ra double, dec double, distance double")
    for order in (2, 4):
        v = depth.voxels(points, order, bins=8)
        assert v.agg(F.sum("count")).first()[0] == 400 and v.agg(F.max("bin")).first()[0] == 7
    assert depth.adaptive_order(points, 2) == 6 and depth.adaptive_order(points, 2, budget=3) is None and depth.adaptive_order(points, 12) == 13
    edges = depth.voxels(points, 2, bins=8).select("bin", "radial_min", "radial_max").distinct().orderBy("bin").collect()
    assert [(r.radial_min, r.radial_max) for r in edges] == [(k * 399 / 8, (k + 1) * 399 / 8) for k in range(8)]


def test_tree_identity_and_numbers(spark):
    cells = lambda rows: spark.createDataFrame(rows, "order int, ipix long")
    one, other = cells([(5, 20), (5, 21), (5, 22), (5, 23)]), cells([(4, 5)])
    assert ranges.tree_identity(one).first().revision == ranges.tree_identity(other).first().revision != ranges.tree_identity(cells([(4, 6)])).first().revision
    keys = random.Random(3).sample(range(10**6), 500)
    got = {r.k: r.number for r in ranges.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", per=999).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}
    assert sorted((r.order, r.ipix) for r in ranges.capped(cells([(8, 5 * 256 + k) for k in range(256)] + [(9, 0)]), 6).collect()) == [(4, 5), (6, 0)]


def test_canonical_is_minimal_and_whole(spark):
    rnd = random.Random(9)
    rows = [(o, rnd.randrange(12 * 4**2) * 4 ** (o - 4) + rnd.randrange(4 ** (o - 4))) for o in [rnd.choice([4, 5, 6, 7]) for _ in range(150)]]
    got = [(r.order, r.ipix) for r in ranges.canonical(spark.createDataFrame(rows, "order int, ipix long"), finest=7).collect()]
    fine = lambda cells: [c for o, p in cells for c in range(p * 4 ** (7 - o), (p + 1) * 4 ** (7 - o))]
    assert sorted(fine(got)) == sorted(set(fine(rows)))
    quartets = {}
    for o, p in got:
        quartets[o, p // 4] = quartets.get((o, p // 4), 0) + 1
    assert all(n < 4 for (o, _), n in quartets.items() if o > 4)
