"""Projections there and back, outlines that hold their pixels, and headers that have none."""

import math

import pytest
from pyspark.sql import functions as F

from skyweave.operators import wcs


def _header(**cards):
    text = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return "".join(f"{k:<8}= {text(v):<70}" for k, v in cards.items()) + f"{'END':<80}"


def _image(kind, dec0=30.0, **more):
    own = {"NAXIS": 2, "NAXIS1": 300, "NAXIS2": 200, "RADESYS": "ICRS", "CTYPE1": f"RA---{kind}", "CTYPE2": f"DEC--{kind}", "CRVAL1": 359.5, "CRVAL2": 0.0 if kind == "CAR" else dec0, "CRPIX1": 150.0, "CRPIX2": 90.0}
    return {**own, **(more or {"CD1_1": -0.03, "CD1_2": 0.004, "CD2_1": 0.003, "CD2_2": 0.03})}


@pytest.mark.parametrize("kind", wcs.PROJECTIONS)
@pytest.mark.parametrize("dec0", [30.0, -89.0, 90.0])
def test_pixels_to_the_sky_and_back(spark, kind, dec0):
    points = [(float(u), float(v)) for u in range(1, 300, 37) for v in range(1, 200, 29)] + [(0.5, 0.5), (300.5, 200.5)]
    df = spark.createDataFrame([(_header(**_image(kind, dec0)), u, v) for u, v in points], "h string, u double, v double").withColumn("w", wcs.read(F.col("h")))
    sky = df.withColumn("s", wcs.to_sky(F.col("w"), F.col("u"), F.col("v")))
    back = sky.withColumn("p", wcs.to_pixel(F.col("w"), F.col("s.ra"), F.col("s.dec"))).collect()
    # 1e-9 degrees are 3.3e-8 pixels.
    assert len(back) == len(points) and max(max(abs(r.p.u - r.u), abs(r.p.v - r.v)) for r in back) < 3.3e-8
    centre = df.limit(1).select(wcs.to_sky(F.col("w"), F.lit(150.0), F.lit(90.0)).alias("s")).first().s
    assert abs(centre.dec - (0.0 if kind == "CAR" else dec0)) < 1e-9


def test_steps_and_turned_axes(spark):
    same = [_header(**_image("SIN", CDELT1=-0.03, CDELT2=0.03)), _header(**_image("SIN", CD1_1=-0.03, CD2_2=0.03)), _header(**_image("SIN", PC1_1=-0.03, PC2_2="0.03D0"))]
    got = [r.s for r in spark.createDataFrame([(h,) for h in same], "h string").select(wcs.to_sky(wcs.read(F.col("h")), F.lit(9.0), F.lit(8.0)).alias("s")).collect()]
    assert got[0] == got[1] == got[2] is not None


def test_headers_without_a_map(spark):
    bad = [
        _image("AIT"), _image("TAN", RADESYS="FK5"), _image("TAN", CD1_1=0.1), _image("CAR") | {"CRVAL2": 5.0}, _image("TAN") | {"PV1_1": 0.5}, _image("TAN") | {"NAXIS1": 0},
        _image("SIN") | {"LONPOLE": 90.0}, _image("TAN") | {"CTYPE2": "DEC--SIN"}, {},
    ]
    got = spark.createDataFrame([(_header(**b),) for b in bad] + [(None,), ("",)], "h string").select(wcs.read(F.col("h")).alias("w")).collect()
    assert [r.w for r in got] == [None] * (len(bad) + 2)
    wide = _image("SIN", CD1_1=-0.6, CD2_2=0.6)  # its corners lie beyond the horizon
    row = spark.createDataFrame([(_header(**wide),)], "h string").select(wcs.to_sky(wcs.read(F.col("h")), F.lit(1.0), F.lit(1.0)).alias("s"), wcs.outline(wcs.read(F.col("h"))).alias("o")).first()
    assert row.s is None and row.o is None


def _plane(ra, dec, ra0, dec0):
    """A direction on the tangent plane at the image's middle, in degrees: great circles are straight there."""
    a, d, d0 = math.radians(ra - ra0), math.radians(dec), math.radians(dec0)
    z = math.sin(d) * math.sin(d0) + math.cos(d) * math.cos(d0) * math.cos(a)
    return math.degrees(math.cos(d) * math.sin(a) / z), math.degrees((math.sin(d) * math.cos(d0) - math.cos(d) * math.sin(d0) * math.cos(a)) / z)


def _inside(p, polygon):
    odd = False
    for (x, y), (u, v) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (y > p[1]) != (v > p[1]) and p[0] < x + (p[1] - y) / (v - y) * (u - x):
            odd = not odd
    return odd


def _nearest(p, polygon):
    out = 9.0
    for (x, y), (u, v) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        t = max(0.0, min(1.0, ((p[0] - x) * (u - x) + (p[1] - y) * (v - y)) / ((u - x) ** 2 + (v - y) ** 2)))
        out = min(out, math.hypot(p[0] - x - t * (u - x), p[1] - y - t * (v - y)))
    return out


@pytest.mark.parametrize("kind", wcs.PROJECTIONS)
def test_outlines_follow_bent_edges(spark, kind):
    df = spark.createDataFrame([(_header(**_image(kind)),)], "h string").withColumn("w", wcs.read(F.col("h")))
    rows = df.select(wcs.to_sky(F.col("w"), F.lit(150.0), F.lit(90.0)).alias("c"), *[wcs.outline(F.col("w"), bound).alias(f"o{k}") for k, bound in enumerate((5.0, 0.01, 0.001))]).first()
    sizes = [len(rows[f"o{k}"]) for k in range(3)]
    assert sizes[0] == 4 <= sizes[1] <= sizes[2] and (kind == "TAN") == (sizes[2] == 4)
    inner = [(float(u), float(v)) for u in range(3, 300, 33) for v in range(3, 200, 31)]
    edge = [(k + 0.5, v) for k in range(0, 301, 3) for v in (0.5, 200.5)] + [(u, k + 0.5) for k in range(0, 201, 3) for u in (0.5, 300.5)]
    sky = spark.createDataFrame([(*p, p in inner) for p in inner + edge], "u double, v double, inner boolean").crossJoin(df).select("inner", wcs.to_sky(F.col("w"), F.col("u"), F.col("v")).alias("s")).collect()
    outline = [_plane(p.ra, p.dec, rows.c.ra, rows.c.dec) for p in rows.o2]
    for r in sky:
        p = _plane(r.s.ra, r.s.dec, rows.c.ra, rows.c.dec)
        assert _inside(p, outline) if r.inner else _nearest(p, outline) < 0.0011


def test_headers_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    """rows that one task reads are dealt out before their headers are parsed."""
    from skyweave.operators import region

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1 and region.dealt(rows).rdd.getNumPartitions() > 4
