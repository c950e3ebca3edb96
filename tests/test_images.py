"""Shapes against cells: equal to dense sampling, but for touches thinner than the samples."""

import math
import random

from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import images


def test_shapes_meet_the_cells_that_samples_show(spark):
    rnd = random.Random(21)
    shapes = []
    for k in range(12):
        ra, dec, r = rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-0.98, 0.98))), rnd.choice([0.05, 0.4, 1.5])
        if k % 2:
            shapes.append((k, f"CIRCLE ICRS {ra:.6f} {dec:.6f} {r:.6f}"))
        else:
            w = r / max(0.2, math.cos(math.radians(dec)))
            shapes.append((k, f"POLYGON ICRS {ra:.6f} {dec:.6f} {ra + w:.6f} {dec + r / 9:.6f} {ra + w:.6f} {dec + r:.6f} {ra:.6f} {dec + r * 0.9:.6f}"))
    df = spark.createDataFrame(shapes + [(90, "POLYGON ICRS 1 2"), (91, None)], "obsid long, s_region string")
    every = spark.range(hpx.cells(6)).withColumnRenamed("id", "ipix")
    got = {(r.obsid, r.ipix) for r in images.meeting(df, every, 6).collect()}
    assert {k for k, _ in got} == set(range(12))
    # Samples: cells of order 10 near each shape, in it by its own geometry alone.
    coarse = {}
    for k, c in got:
        coarse.setdefault(k, set()).add(c)
    cells = spark.createDataFrame([(k, c) for k, own in coarse.items() for c in own], "obsid long, ipix long")
    around = cells.select("obsid", F.explode(F.concat(F.array("ipix"), hpx.neighbours4(6, F.col("ipix")))).alias("ipix")).distinct()
    fine = around.select("obsid", "ipix", F.explode(F.sequence(F.col("ipix") * 256, F.col("ipix") * 256 + 255)).alias("f")).select("obsid", "ipix", hpx.pix2ang(10, F.col("f")).alias("c"))
    points = fine.select("obsid", "ipix", "c.ra", "c.dec").toPandas()
    truth, near = set(), set()
    for k, text in shapes:
        own = points[points.obsid == k]
        n = [float(x) for x in text.split()[2:]]
        for ipix, ra, dec in zip(own.ipix, own.ra, own.dec, strict=True):
            off = _off(n, ra, dec)
            if off <= 0:
                truth.add((k, int(ipix)))
            if off <= 0.08:  # a sample's cell is 0.06 degrees wide
                near.add((k, int(ipix)))
    assert truth <= got <= near


def _unit(ra, dec):
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def _off(n, ra, dec):
    """Degrees that a direction lies outside of a circle or convex polygon; 0 or less inside."""
    p = _unit(ra, dec)
    if len(n) == 3:
        return math.degrees(math.acos(min(1.0, sum(a * b for a, b in zip(p, _unit(*n[:2]), strict=True))))) - n[2]
    v = [_unit(a, b) for a, b in zip(n[::2], n[1::2], strict=True)]
    m = [sum(x) for x in zip(*v, strict=True)]
    worst = -9.0
    for a, b in zip(v, v[1:] + v[:1], strict=True):
        e = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        size = math.sqrt(sum(x * x for x in e)) * (1 if sum(x * y for x, y in zip(e, m, strict=True)) > 0 else -1)
        worst = max(worst, -math.degrees(math.asin(max(-1.0, min(1.0, sum(x * y for x, y in zip(e, p, strict=True)) / size)))))
    return worst


def test_lookup_caps_and_repeats(spark):
    seen = [(k, 10.0 + k / 100, 5.0, f"CIRCLE ICRS {10 + k / 100} 5 0.01") for k in range(8)] + [(3, 10.03, 5.0, "CIRCLE ICRS 10.03 5 0.01"), (50, 200.0, -5.0, "CIRCLE ICRS 200 -5 1"), (51, 10.0, 5.0, "bad")]
    obs = spark.createDataFrame(seen, "obsid long, ra double, dec double, s_region string")
    products = spark.createDataFrame([(k, p) for k in range(0, 60, 2) for p in ("a", "b", "c")], "obsid long, product string")
    cells = obs.where("obsid < 8").select(hpx.ang2pix(6, F.col("ra"), F.col("dec")).alias("ipix")).distinct()
    rows = sorted(tuple(r) for r in images.lookup(obs, products, cells, 6, 5, 7).fillna({"product": ""}).collect())
    assert rows == [(0, "a", True, True), (0, "b", True, True), (0, "c", True, True), (1, "", True, True), (2, "a", True, True), (2, "b", True, True), (2, "c", True, True), (3, "", True, True), (4, "a", True, True)]
    whole = images.lookup(obs, products, cells, 6).collect()
    assert {r.obsid for r in whole} == set(range(8)) and not any(r.more_observations or r.more_products for r in whole)
