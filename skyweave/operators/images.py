"""Images of a region: observations whose shape truly meets requested cells, with their products, under two caps.

A bounding cone and covers of the shapes find candidates; each candidate is then judged exactly: a shape meets a cell if
a point of the cell's outline lies in it, if it has a point in the cell, or if a side of the one crosses a side of the
other. Outlines have SIDES arcs a side, which leave a cell's true side by a few thousandths of its width.

Defined results: an observation of several shapes meets what any of them meets; one without a readable region meets
nothing; polygons that aren't convex count as the circle around them; repeated observations count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import geometry, overlap, region
from skyweave.plans.scratch import materialize

#: Observations and products of one lookup; and arcs of a cell's side.
OBSERVATIONS, PRODUCTS = 50, 500
SIDES = 4


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def _vector(ra: Column, dec: Column) -> Column:
    a, d = F.radians(ra), F.radians(dec)
    return F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))


def _arcs(points: Column) -> Column:
    """Arcs (a, b, n) between neighbouring points of a closed line, n normal to each."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.transform(F.arrays_zip(points.alias("a"), after.alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _cross(s["a"], s["b"]).alias("n")))


def circles_meeting(rows: DataFrame, order: int) -> DataFrame:
    """Rows (ra, dec, radius_deg, ipix) whose circle has a point in common with their cell.

    What is computed once stands in a column of its own: nested lambdas would be analysed again and again.
    """
    out = rows.withColumns({"__c": _vector(F.col("ra"), F.col("dec")), "__points": hpx.outline(order, F.col("ipix"), SIDES), "__inside": hpx.ang2pix(order, F.pmod(F.col("ra"), F.lit(360.0)), F.col("dec")) == F.col("ipix")})
    out = out.withColumn("__arcs", _arcs(F.col("__points"))).withColumn("__arcs", F.transform("__arcs", lambda e: F.struct(e["a"].alias("a"), e["n"].alias("n"), _cross(e["n"], e["a"]).alias("from"), _cross(e["b"], e["n"]).alias("to"))))
    c, near = F.col("__c"), F.cos(F.radians("radius_deg")) - 1e-15
    beside = lambda e: (F.abs(_dot(e["n"], c)) <= F.sin(F.radians("radius_deg")) * F.sqrt(_dot(e["n"], e["n"]))) & (_dot(e["from"], c) >= 0) & (_dot(e["to"], c) >= 0) & (_dot(e["a"], c) > 0)
    return out.where(F.col("__inside") | F.exists("__points", lambda p: _dot(p, c) >= near) | F.exists("__arcs", beside)).drop("__c", "__points", "__inside", "__arcs")


def polygons_meeting(rows: DataFrame, order: int) -> DataFrame:
    """Rows (vertices, ipix) whose convex polygon has a point in common with their cell."""
    corner = F.transform("vertices", lambda p: hpx.ang2pix(order, F.pmod(p["ra"], F.lit(360.0)), p["dec"]))
    out = rows.withColumns({"__corners": corner, "__v": F.transform("vertices", lambda p: _vector(p["ra"], p["dec"])), "__points": hpx.outline(order, F.col("ipix"), SIDES)})
    out = out.withColumns({"__own": _arcs(F.col("__v")), "__cell": _arcs(F.col("__points")), "__m": F.aggregate("__v", F.struct(*[F.lit(0.0).alias(n) for n in "xyz"]), lambda m, v: F.struct(*[(m[n] + v[n]).alias(n) for n in "xyz"]))})
    # Each side with the sign of its inward normal, and each pair of a polygon's and a cell's side.
    out = out.withColumn("__own", F.transform("__own", lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["n"].alias("n"), F.signum(_dot(e["n"], F.col("__m"))).alias("in"))))
    out = out.withColumn("__pairs", F.flatten(F.transform("__own", lambda e: F.transform("__cell", lambda f: F.struct(e.alias("e"), f.alias("f"))))))
    holds = lambda p: (_dot(p, F.col("__m")) > 0) & F.forall("__own", lambda e: F.signum(_dot(e["n"], p)) * e["in"] >= 0)
    crosses = lambda s: (_dot(s["e"]["n"], s["f"]["a"]) * _dot(s["e"]["n"], s["f"]["b"]) <= 0) & (_dot(s["f"]["n"], s["e"]["a"]) * _dot(s["f"]["n"], s["e"]["b"]) <= 0) & (_dot(s["e"]["a"], s["f"]["a"]) + _dot(s["e"]["b"], s["f"]["b"]) > 0)
    meets = F.array_contains("__corners", F.col("ipix")) | F.exists("__points", holds) | F.exists("__pairs", crosses)
    return out.where(meets).drop("__corners", "__v", "__points", "__own", "__cell", "__m", "__pairs")


def meeting(rows: DataFrame, request: DataFrame, order: int, text: str = "s_region", key: str = "obsid") -> DataFrame:
    """(key, ipix): requested cells (`request`: ipix) that a shape of a row's STC-S region meets, exactly."""
    asked = request.select("ipix").distinct()
    each = rows.select(key, F.explode(geometry.stcs(F.col(text))).alias("s"))
    polygons = each.where("s.kind = 'polygon'").select(key, F.col("s.vertices").alias("vertices")).withColumns({"convex": geometry.convex(F.col("vertices")), "c": geometry.cap(F.col("vertices"))})
    plain = F.col("convex") & (F.col("c.radius") < 80)
    circles = each.where("s.kind = 'circle'").select(key, "s.ra", "s.dec", F.col("s.radius").alias("radius_deg"))
    circles = circles.unionByName(polygons.where(~plain).select(key, "c.ra", "c.dec", F.col("c.radius").alias("radius_deg")))
    discs = region.disc_cells(circles, order).join(asked, "ipix", "left_semi")
    flat = region.polygon_cells(polygons.where(plain).select(key, "vertices"), order).join(asked, "ipix", "left_semi")
    found = circles_meeting(discs, order).select(key, "ipix")
    return found.union(polygons_meeting(flat, order).select(key, "ipix")).distinct()


def lookup(observations: DataFrame, products: DataFrame, request: DataFrame, order: int, most: int = OBSERVATIONS, most_products: int = PRODUCTS, reach: float = 0.0) -> DataFrame:
    """(obsid, product, more_observations, more_products) of the first observations by id that meet requested cells.

    `observations` (obsid, ra, dec, s_region), `products` (obsid, product). Positions are asked for in the bounding cone of
    the cells and `reach` degrees more. Of `most` observations the first `most_products` products by id and name are given.
    """
    cone = F.broadcast(overlap.mean_cone(request, order).select(F.col("ra").alias("__ra"), F.col("dec").alias("__dec"), "radius_deg"))
    near = observations.join(cone, F.lit(True)).where(hpx.angular_distance(F.col("ra"), F.col("dec"), F.col("__ra"), F.col("__dec")) <= F.col("radius_deg") + reach)
    hit = meeting(near.select("obsid", "s_region"), request, order).select("obsid").distinct()
    first = materialize(hit.orderBy("obsid").limit(most + 1), "observations")
    own = first.orderBy("obsid").limit(most)
    rows = materialize(products.join(own, "obsid", "left_semi").select("obsid", "product").orderBy("obsid", "product").limit(most_products + 1), "products")
    more = first.agg((F.count("*") > most).alias("more_observations")).join(rows.agg((F.count("*") > most_products).alias("more_products")), F.lit(True))
    shown = rows.orderBy("obsid", "product").limit(most_products)
    return own.join(shown, "obsid", "left").join(F.broadcast(more), F.lit(True)).select("obsid", "product", "more_observations", "more_products")
