"""Covers are supersets of what they cover, and tight."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import region


def _cells(spark, points, order):
    df = spark.createDataFrame(points, "ra double, dec double")
    return {r[0] for r in df.select(hpx.ang2pix(order, F.col("ra"), F.col("dec"))).collect()}


@pytest.mark.parametrize("box", [(350.0, 10.0, -5.0, 5.0), (20.0, 300.0, -30.0, 40.0), (0.0, 360.0, 85.0, 90.0)])
def test_rectangle_cover_holds_its_points(spark, box):
    rnd = random.Random(1)
    width = box[1] - box[0] if box[1] > box[0] else box[1] - box[0] + 360
    points = [((box[0] + rnd.random() * width) % 360, rnd.uniform(box[2], box[3])) for _ in range(400)]
    rows = region.cover_rectangle(spark, *box, target=6).collect()
    assert 0 < len(rows) <= region.LEAVES
    held = {o: {r.ipix for r in rows if r.order == o} for o in {r.order for r in rows}}
    df = spark.createDataFrame(points, "ra double, dec double")
    for r in df.select(*[hpx.ang2pix(o, F.col("ra"), F.col("dec")).alias(f"o{o}") for o in held]).collect():
        assert any(r[f"o{o}"] in held[o] for o in held)


def test_bad_rectangles(spark):
    for box in [(0, 0, 0, 1), (0, 10, 5, 5), (-1, 10, 0, 1), (0, 361, 0, 1), (0, 10, -91, 0), (float("nan"), 1, 0, 1)]:
        with pytest.raises(ValueError):
            region.check_rectangle(*box)


def test_discs_and_polygons(spark):
    discs = spark.createDataFrame([(1, 10.0, 20.0, 3.0), (2, 359.5, -89.0, 2.0)], "unit_id int, ra double, dec double, radius_deg double")
    got = region.disc_cells(discs, 4)
    every = spark.range(hpx.cells(7)).select(hpx.pix2ang(7, F.col("id")).alias("c"), F.col("id"))
    for d in discs.collect():
        inside = every.where(hpx.angular_distance(F.col("c.ra"), F.col("c.dec"), F.lit(d.ra), F.lit(d.dec)) <= d.radius_deg)
        need = {r[0] for r in inside.select(hpx.parent(F.col("id"), 3)).collect()}
        have = {r.ipix for r in got.where(F.col("unit_id") == d.unit_id).collect()}
        assert need <= have and len(have) < 40
    square = spark.createDataFrame([(1, [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)])], "id int, vertices array<struct<ra:double,dec:double>>")
    have = {r.ipix for r in region.polygon_cells(square, 4).collect()}
    assert _cells(spark, [(10.5 + k % 10, 0.5 + k // 10) for k in range(90)], 4) <= have and len(have) < 40


def test_units_cone_and_batches(spark):
    discs = spark.createDataFrame([(1, 10.0, 20.0, 1.0), (2, 200.0, -40.0, 1.0)], "unit_id int, ra double, dec double, radius_deg double")
    request = spark.createDataFrame([(c,) for c in _cells(spark, [(10.0, 20.0)], 6)], "ipix long")
    assert [r.unit_id for r in region.units_touching(discs, request, 6).collect()] == [1]
    c = region.cone(spark.createDataFrame([(359.0, 0.0), (1.0, 0.0)], "ra double, dec double")).first()
    assert abs((c.ra + 180) % 360 - 180) < 1e-9 and abs(c.radius_deg - 1) < 1e-9
    assert region.batches(spark.range(130).withColumnRenamed("id", "ipix"), 8).groupBy("batch").count().agg(F.max("count")).first()[0] == 64


def test_small_discs_start_near_and_lose_nothing(spark):
    """Discs of all sizes everywhere, the poles and the corners of base cells too: every cell with a point of the disc is there."""
    rnd = random.Random(7)
    centres = [(rnd.uniform(0, 360), rnd.uniform(-90, 90)) for _ in range(60)] + [(k * 45.0, d) for k in range(8) for d in (-89.9, -41.81, 0.0, 41.81, 89.95)] + [(10.0, 90.0), (0.0, -90.0)]
    discs = [(k, ra, dec, rnd.choice([0.02, 0.2, 0.9, 1.7, 3.4, 7.0])) for k, (ra, dec) in enumerate(centres)]
    have = {}
    for r in region.disc_cells(spark.createDataFrame(discs, "k int, ra double, dec double, radius_deg double"), 6).collect():
        have.setdefault(r.k, set()).add(r.ipix)
    points = []
    for k, ra, dec, radius in discs:
        for _ in range(60):
            turn, away = rnd.uniform(0, 2 * math.pi), math.radians(radius * rnd.random() ** 0.5)
            d0 = math.radians(dec)
            d = math.asin(max(-1, min(1, math.sin(d0) * math.cos(away) + math.cos(d0) * math.sin(away) * math.cos(turn))))
            a = math.radians(ra) + math.atan2(math.sin(turn) * math.sin(away) * math.cos(d0), math.cos(away) - math.sin(d0) * math.sin(d))
            points.append((k, math.degrees(a) % 360, math.degrees(d)))
    found = spark.createDataFrame(points, "k int, ra double, dec double").select("k", hpx.ang2pix(6, F.col("ra"), F.col("dec")).alias("c")).distinct().collect()
    assert all(r.c in have[r.k] for r in found)
    cell = 41253 / hpx.cells(6)
    assert all(len(have[k]) <= 4 * 3.15 * (radius + 1.3) ** 2 / cell + 12 for k, _, _, radius in discs)


def test_oversampled_covers_hold_the_truth_and_less_besides(spark):
    """Cells of sampled points of a shape are in every cover; each factor's cover is inside the one before, and nearer to the truth."""
    rnd = random.Random(14)
    discs = [(k, rnd.random() * 360, math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.choice([0.3, 2.0, 7.0])) for k in range(12)] + [(12, 10.0, 89.5, 3.0), (13, 359.9, 0.0, 2.0)]
    df = spark.createDataFrame(discs, "k int, ra double, dec double, radius_deg double")
    dense = spark.range(12 * 4**9).select(hpx.pix2ang(9, F.col("id")).alias("c"), hpx.parent(F.col("id"), 4).alias("ipix"))
    near = dense.crossJoin(F.broadcast(df)).where(hpx.angular_distance(F.col("c.ra"), F.col("c.dec"), F.col("ra"), F.col("dec")) <= F.col("radius_deg"))
    truth = {tuple(r) for r in near.select("k", "ipix").distinct().collect()}
    covers = [{(r.k, r.ipix) for r in region.disc_cells(df, 5, factor=f).select("k", "ipix").collect()} for f in (1, 2, 4, 8)]
    assert all(truth <= c for c in covers) and all(b <= a for a, b in zip(covers, covers[1:], strict=False))
    extra = [len(c - truth) for c in covers]
    assert extra[0] > 2 * extra[2] > 2 * extra[3]
    boxes = [(k, [(ra, dec), (ra + w, dec), (ra + w, dec + w), (ra, dec + w)]) for k, ra, dec, w in ((0, 40.0, 10.0, 5.0), (1, 359.0, -30.0, 2.0), (2, 100.0, 60.0, 0.4))]
    shapes = spark.createDataFrame(boxes, "k int, vertices array<struct<ra:double,dec:double>>")
    covers = [{(r.k, r.ipix) for r in region.polygon_cells(shapes, 6, factor=f).select("k", "ipix").collect()} for f in (1, 4)]
    points = [(k, v[0][0] + a * (v[1][0] - v[0][0]), v[0][1] + b * (v[2][1] - v[0][1])) for k, v in boxes for a in (0.01, 0.2, 0.5, 0.8, 0.99) for b in (0.05, 0.3, 0.6, 0.95)]
    inside = {(r.k, r.ipix) for r in spark.createDataFrame(points, "k int, ra double, dec double").select("k", hpx.ang2pix(6, F.col("ra") % 360, F.col("dec")).alias("ipix")).collect()}
    assert inside <= covers[1] < covers[0]
    with pytest.raises(ValueError, match="power of two"):
        region.disc_cells(df, 5, factor=3)


def test_small_frames_make_few_rows(spark):
    """a frame meets its cells without a row for any other cell, one task doesn't do them all, and the cells are those of both starts."""
    corners = lambda k: [(k + 0.0, 0.0), (k + 0.3, 0.0), (k + 0.3, 0.25), (k + 0.0, 0.25)]
    frames = spark.createDataFrame([(k, corners(k)) for k in range(300)], "id long, vertices array<struct<ra:double,dec:double>>").coalesce(1)
    found = region.polygon_cells(frames, 7)
    assert found.rdd.getNumPartitions() > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    from_base = {(i, c) for i, c in _from_base(frames.collect(), 7)}
    assert {(r.id, r.ipix) for r in found.collect()} == from_base


def _from_base(rows, order):
    import numpy as np

    from skyweave.functions import cover

    ra, dec = (np.array([[p[n] for p in r.vertices] for r in rows]) for n in ("ra", "dec"))
    own = np.arange(len(rows))
    for i, c in cover._walk(cover.polygons(ra, dec), np.repeat(own, 12), np.tile(np.arange(12), len(own)), 0, order, 0, True):
        yield from zip((rows[k].id for k in i), c.tolist(), strict=True)


def test_small_shapes_start_with_every_cell_of_the_test(spark):
    """at the order where small shapes start, all cells whose circle meets theirs are there, at skewed polar cells too."""
    import numpy as np

    from skyweave.functions import cover

    rnd = random.Random(3)
    discs = [(k, rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.choice([0.0, 0.5, 0.9])) for k in range(3000)]
    got = {(r.k, r.ipix) for r in region.disc_cells(spark.createDataFrame(discs, "k int, ra double, dec double, radius_deg double"), 4).select("k", "ipix").collect()}
    _, ra, dec, radius = map(np.array, zip(*discs, strict=True))
    away = np.degrees(np.arccos(np.clip(cover.directions(ra, dec).T @ cover.centres(4, np.arange(hpx.cells(4))), -1, 1)))
    assert got == {(int(k), int(c)) for k, c in zip(*np.nonzero(away <= radius[:, None] + hpx.max_pixel_radius(4)), strict=True)}


def test_a_file_of_discs_is_dealt_out(spark):
    """discs that one task reads are covered by many."""
    one = spark.range(50).selectExpr("id as unit_id", "id * 7.0d as ra", "id * 1.0d as dec", "2.5d as radius_deg").coalesce(1)
    found = region.disc_cells(one, 5, factor=4).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 1
