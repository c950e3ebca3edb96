"""Shapes: parsing, corners, rotations, and covers that hold what they cover."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import geometry


def _shapes(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", geometry.stcs(F.col("t")).alias("s")).orderBy("k").collect()
    return [None if r.s is None else [(x.kind, x.ra, x.dec, x.radius, [tuple(v) for v in x.vertices]) for x in r.s] for r in rows]


def test_stcs(spark):
    box = "POLYGON ICRS 10 0 20 0 20 10 10 10"
    corners = [(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)]
    got = _shapes(spark, [box, "polygon 10 0 20 0 20 10 10 10 10 0", "CIRCLE ICRS -5 20.5 1e-1", f"UNION ICRS ({box}CIRCLE 1 2 3)", f"UNION ICRS ( {box} POLYGON 1 1 2 2 )", "POLYGON 1 2 3", "POLYGON J2000 10 0 20 0 20 10", "CIRCLE 1 95 1", "CIRCLE 1 2", "", None, "POLYGON 1 1 1 1 1 1", "BOX 1 2 3 4", box + " 7"])
    assert got[0] == got[1] == [("polygon", None, None, None, corners)]
    assert got[2] == [("circle", 355.0, 20.5, 0.1, [])]
    assert [x[0] for x in got[3]] == ["polygon", "circle"]
    assert got[4:] == [None] * 10


def test_covers_hold_their_shapes(spark):
    rnd = random.Random(2)
    dart = [(30.0, 0.0), (40.0, 10.0), (30.0, 4.0), (20.0, 10.0)]  # not convex
    square = [(350.0, -5.0), (5.0, -5.0), (5.0, 5.0), (350.0, 5.0)]
    texts = {1: "POLYGON " + " ".join(f"{a} {d}" for a, d in dart), 2: "POLYGON " + " ".join(f"{a} {d}" for a, d in square), 3: "CIRCLE 100 80 6"}
    df = spark.createDataFrame(list(texts.items()), "unit_id int, t string").select("unit_id", geometry.stcs(F.col("t")).alias("shapes"))
    have = {}
    for r in geometry.shape_cells(df, 5).collect():
        have.setdefault(r.unit_id, set()).add(r.ipix)
    points = {1: [(30.0 + t, 4.5 + abs(t) * 0.5) for t in (-3, 0.1, 4)], 2: [((350 + rnd.random() * 15) % 360, rnd.uniform(-4.9, 4.9)) for _ in range(50)], 3: [(100.0, 80.0), (100.0, 85.9), (100.0, 74.1)]}
    for k, at in points.items():
        need = {r[0] for r in spark.createDataFrame(at, "ra double, dec double").select(hpx.ang2pix(5, F.col("ra"), F.col("dec"))).collect()}
        assert need <= have[k] and len(have[k]) < 400
    v = spark.createDataFrame([(dart,), (square,)], "v array<struct<ra:double,dec:double>>")
    assert [r[0] for r in v.select(geometry.convex(F.col("v"))).collect()] == [False, True]
    c = v.select(geometry.cap(F.col("v")).alias("c")).select("c.*").collect()[1]
    assert (c.ra + 180) % 360 - 180 == pytest.approx(-2.5) and c.dec == pytest.approx(0, abs=1e-9) and c.radius > 8


def test_texts_are_dealt_out_before_they_are_parsed(spark, capsys):
    """no parsing ahead of the shuffle that deals units out, where one task would do it for all; texts without shapes have no cells."""
    circle = F.format_string("CIRCLE ICRS %d 20 2", "id")
    units = spark.range(0, 60, 1, 1).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 3 == 0, circle).when(F.col("id") % 3 == 1, "POLYGON 1 1 1 1 1 1").otherwise("none").alias("s_region"))
    request = spark.range(hpx.cells(4)).withColumnRenamed("id", "cell")
    found = geometry.stcs_match(units, request, 4)
    found.explain()
    plan = capsys.readouterr().out
    dealt = plan.index("RoundRobinPartitioning")
    assert "RLIKE" in plan[:dealt] and "RLIKE" not in plan[dealt:]
    assert {r.unit_id for r in found.select("unit_id").distinct().collect()} == set(range(0, 60, 3))


def test_great_circles(spark):
    rnd = random.Random(5)
    rows = [(rnd.uniform(0, 360), rnd.uniform(-3, 3), 95.0, rnd.uniform(0, 90)) for _ in range(40)]
    ra, dec = geometry.great_circle(*[F.col(c) for c in ("mu", "nu", "node", "incl")])
    for r in spark.createDataFrame(rows, "mu double, nu double, node double, incl double").select("*", ra.alias("ra"), dec.alias("dec")).collect():
        a, b, i = math.radians(r.mu - r.node), math.radians(r.nu), math.radians(r.incl)
        x, y, z = math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b)
        y, z = y * math.cos(i) - z * math.sin(i), y * math.sin(i) + z * math.cos(i)  # a rotation about x
        assert r.ra == pytest.approx((math.degrees(math.atan2(y, x)) + r.node) % 360) and r.dec == pytest.approx(math.degrees(math.asin(z)))


def _header(**changes):
    values = {"SIMPLE": "T", "NAXIS": "2", "NAXIS1": "200", "NAXIS2": "100", "RADESYS": "'ICRS    '", "CTYPE1": "'RA---TAN'", "CTYPE2": "'DEC--TAN'", "CRVAL1": "150.0 / centre", "CRVAL2": "2.5D0", "CRPIX1": "100.5", "CRPIX2": "50.5", "CD1_1": "-0.01", "CD1_2": "0", "CD2_1": "0", "CD2_2": "0.01"} | changes
    return "".join(f"{k:<8}= {v}".ljust(80) for k, v in values.items()) + "END".ljust(80)


def test_headers(spark):
    texts = [_header(), _header(CTYPE1="'RA---SIN'"), _header(PV1_1="1.0"), _header(CD1_1="-1.0"), "", _header(CRVAL1="x")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "h string").select(geometry.tan_corners(F.col("h"))).collect()]
    assert got[1:] == [None] * 5
    for p, (u, v) in zip(got[0], ((1, -0.5), (-1, -0.5), (-1, 0.5), (1, 0.5)), strict=True):
        # The tangent plane by its definition: the angle from the centre is the arc tangent of the distance on the plane.
        x, y, d0 = math.radians(u), math.radians(v), math.radians(2.5)
        rho, c = math.hypot(x, y), math.atan(math.hypot(x, y))
        dec = math.asin(math.cos(c) * math.sin(d0) + y * math.sin(c) * math.cos(d0) / rho)
        ra = math.radians(150) + math.atan2(x * math.sin(c), rho * math.cos(d0) * math.cos(c) - y * math.sin(d0) * math.sin(c))
        assert (p.ra, p.dec) == pytest.approx((math.degrees(ra) % 360, math.degrees(dec)))
