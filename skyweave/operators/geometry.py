"""Shapes on the sky: STC-S regions, image headers, great-circle fields, centroids and caps, and the cells they touch.

Parsing and trigonometry are column expressions; cells are found on Arrow batches by region.covers().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import region

#: Limits of an STC-S text.
MOST_PARTS, MOST_VERTICES = 512, 32_768
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_SHAPE = "struct<kind:string,ra:double,dec:double,radius:double,vertices:array<struct<ra:double,dec:double>>>"


def _direction(p: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(p["ra"]), F.radians(p["dec"])
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def _sum(vertices: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "xyz"])
    return F.aggregate(vertices, zero, lambda s, p: F.struct(*[(s[n] + v).alias(n) for n, v in zip("xyz", _direction(p), strict=True)]))


def centroid(vertices: Column) -> Column:
    """The direction of the sum of the vertices' directions: a struct of ra and dec."""
    s = lambda v: F.struct(F.pmod(F.degrees(F.atan2(v["y"], v["x"])) + 360, F.lit(360.0)).alias("ra"), F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("dec"))
    return F.element_at(F.transform(F.array(_sum(vertices)), s), 1)


def cap(vertices: Column) -> Column:
    """The circle about the centroid that holds all vertices: a struct of ra, dec and radius in degrees (radius null if there is no centroid)."""

    def of(m: Column) -> Column:
        far = F.array_max(F.transform(vertices, lambda p: hpx.angular_distance(p["ra"], p["dec"], m["ra"], m["dec"])))
        return F.struct(m["ra"].alias("ra"), m["dec"].alias("dec"), (far + 1e-10).alias("radius"))

    return F.element_at(F.transform(F.array(centroid(vertices)), of), 1)


def convex(vertices: Column) -> Column:
    """Whether a polygon turns the same way at every vertex."""

    def turn(p: Column, i: Column) -> Column:
        n = F.size(vertices)
        q, r = F.element_at(vertices, (i + 1) % n + 1), F.element_at(vertices, (i + 2) % n + 1)
        (a, b, c), (d, e, f), (g, h, k) = _direction(p), _direction(q), _direction(r)
        return F.signum((b * f - c * e) * g + (c * d - a * f) * h + (a * e - b * d) * k)

    turns = F.filter(F.transform(vertices, turn), lambda t: t != 0)
    return (F.size(turns) > 0) & (F.array_min(turns) == F.array_max(turns))


def stcs(text: Column) -> Column:
    """The shapes of an STC-S text, an array of structs (kind, ra, dec, radius, vertices); null if the text isn't one.

    POLYGON and CIRCLE, alone or in UNION ICRS (...), in ICRS; numbers may stand right before a keyword. Closing vertices
    and polygons of fewer than three distinct vertices are dropped.
    """
    part = rf"(?:POLYGON|CIRCLE)(?:\s+ICRS)?(?:\s+{_NUMBER})+"
    whole = rf"^\s*(?:UNION\s+ICRS\s+)?(?:{part}\s*)+$"
    null, no_vertices = F.lit(None).cast("double"), F.array().cast("array<struct<ra:double,dec:double>>")

    def made(kind: str, ra: Column, dec: Column, radius: Column, vertices: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ra.alias("ra"), dec.alias("dec"), radius.alias("radius"), vertices.alias("vertices"))

    def circle(n: Column) -> Column:
        fits = (F.size(n) == 3) & (F.abs(F.get(n, F.lit(1))) <= 90) & F.get(n, F.lit(2)).between(0, 180)
        return F.when(fits, made("circle", F.pmod(F.get(n, F.lit(0)), F.lit(360.0)), F.get(n, F.lit(1)), F.get(n, F.lit(2)), no_vertices))

    def polygon(n: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.pmod(F.get(n, 2 * i), F.lit(360.0)).alias("ra"), F.get(n, 2 * i + 1).alias("dec")))

        def closed(v: Column) -> Column:
            open_ = F.when(F.element_at(v, 1) == F.element_at(v, -1), F.slice(v, 1, F.size(v) - 1)).otherwise(v)
            return F.when(F.forall(v, lambda p: F.abs(p["dec"]) <= 90), made("polygon", null, null, null, open_))

        # Polygons too small to have an inside are left out; an odd number refuses the text.
        return F.when(F.size(n) % 2 == 0, F.when(F.size(n) < 6, made("none", null, null, null, no_vertices)).otherwise(hpx.once(pairs, closed)))

    def shape(p: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(p, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: x.cast("double"))
        return hpx.once(numbers, lambda n: F.when(p.startswith("CIRCLE"), circle(n)).otherwise(polygon(n)))

    def inside(s: Column) -> Column:
        return (s["kind"] == "circle") | ((s["kind"] == "polygon") & (F.size(F.array_distinct(s["vertices"])) >= 3))

    def kept(plain: Column, shapes: Column) -> Column:
        fits = F.forall(shapes, lambda s: s.isNotNull() & (F.size(s["vertices"]) <= MOST_VERTICES)) & (F.size(shapes) <= MOST_PARTS)
        least = F.when(plain.rlike(r"^\s*UNION\s"), 2).otherwise(1)
        return F.when(fits, hpx.once(F.filter(shapes, inside), lambda good: F.when(F.size(good) >= least, good)))

    def read(plain: Column) -> Column:
        shapes = F.transform(F.regexp_extract_all(plain, F.lit(f"({part})"), F.lit(1)), shape).cast(f"array<{_SHAPE}>")
        return F.when(plain.rlike(whole), hpx.once(shapes, lambda s: kept(plain, s)))

    return hpx.once(F.upper(F.regexp_replace(text, "[()]", " ")), read)


def shape_cells(rows: DataFrame, order: int, shapes: str = "shapes", key: str = "unit_id", factor: int = 1, deal: bool = True) -> DataFrame:
    """(key, ipix) of the cells that rows' shapes may touch, by an oversampling `factor`; polygons that aren't convex count as the circle around them."""
    rows = rows.select(key, shapes)
    # Not explode(): Spark would put its test for empty arrays, and what makes the shapes with it, before the rows are dealt out.
    each = (region.dealt(rows) if deal else rows).select(key, F.explode_outer(shapes).alias("s")).where("s.kind in ('circle', 'polygon')")
    flat = each.select(key, "s.ra", "s.dec", "s.radius", F.when(F.col("s.kind") == "polygon", F.col("s.vertices")).alias("vertices"))
    return region.covers(flat, order, F.col("ra"), F.col("dec"), F.col("radius"), F.col("vertices"), factor, deal=False).select(key, "ipix").distinct()


def stcs_cells(units: DataFrame, order: int, text: str = "s_region", key: str = "unit_id", factor: int = 1) -> DataFrame:
    """(key, ipix) of the cells that units' STC-S regions may touch; the texts are dealt out before they are parsed."""
    return shape_cells(region.dealt(units.select(key, text)).select(key, stcs(F.col(text)).alias("shapes")), order, key=key, factor=factor, deal=False)


def stcs_match(units: DataFrame, request: DataFrame, order: int, text: str = "s_region", key: str = "unit_id") -> DataFrame:
    """(key, ipix): requested cells at `order` that a unit's STC-S region may touch."""
    return stcs_cells(units, order, text, key).join(request.select(F.col("cell").alias("ipix")).distinct(), "ipix", "left_semi")


def great_circle(mu: Column, nu: Column, node: Column, inclination: Column) -> tuple[Column, Column]:
    """(ra, dec) of great-circle coordinates about a node."""
    a, b, i = F.radians(mu - node), F.radians(nu), F.radians(inclination)
    x = F.cos(a) * F.cos(b)
    y = F.sin(a) * F.cos(b) * F.cos(i) - F.sin(b) * F.sin(i)
    z = F.sin(a) * F.cos(b) * F.sin(i) + F.sin(b) * F.cos(i)
    return F.pmod(F.degrees(F.atan2(y, x)) + node, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def normalized_fields(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """Imaging fields with the reason that excludes each (null: none), its centre and its corners in ICRS."""
    known = runs.select("run", F.lit(True).alias("__known")).distinct()
    rows = fields.join(known, "run", "left")
    numbers = ("node", "incl", "mu_start", "mu_end", "nu_start", "nu_end")
    finite = F.lit(True)
    for c in numbers:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    wide, high = F.col("mu_end") - F.col("mu_start"), F.col("nu_end") - F.col("nu_start")
    bad = ~finite | ~((wide > 0) & (wide < 2)) | ~((high > 0) & (high < 2))
    reason = (
        F.when(F.trim("rerun") != "301", F.concat(F.lit("rerun-"), F.trim("rerun"))).when(F.col("__known").isNull(), "run-not-listed")
        .when(F.col("photo_status") != 0, F.concat(F.lit("photo-status-"), F.col("photo_status").cast("string"))).when(bad, "invalid-geometry")
    )
    at = lambda mu, nu: F.struct(*[v.alias(n) for n, v in zip(("ra", "dec"), great_circle(mu, nu, F.col("node"), F.col("incl")), strict=True)])
    mu, nu = (F.col("mu_start"), F.col("mu_end")), (F.col("nu_start"), F.col("nu_end"))
    corners = F.array(*[at(mu[i], nu[j]) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    centre = at((mu[0] + mu[1]) / 2, (nu[0] + nu[1]) / 2)
    judged = rows.withColumn("reason", reason).drop("__known")
    return judged.withColumns({"centre": F.when(F.col("reason").isNull(), centre), "vertices": F.when(F.col("reason").isNull(), corners)})


def cards(header: Column) -> Column:
    """A map of a FITS header's cards (80 characters each) to their values, without quotes and comments."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(header) / 80).cast("int") - 1, F.lit(0))), lambda i: F.substring(header, i * 80 + 1, F.lit(80)))
    valued = F.filter(every, lambda c: F.substring(c, 9, 2) == "= ")
    value = lambda c: F.when(F.trim(F.substring(c, 11, 70)).startswith("'"), F.trim(F.replace(F.regexp_extract(F.substring(c, 11, 70), r"'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'")))).otherwise(F.trim(F.split_part(F.substring(c, 11, 70), F.lit("/"), F.lit(1))))
    pairs = F.transform(valued, lambda c: F.struct(F.trim(F.substring(c, 1, 8)).alias("k"), value(c).alias("v")))
    first = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.filter(pairs, lambda p: p["k"] == k)[0]["v"].alias("v")))
    return F.map_from_entries(first)


def tan_corners(header: Column) -> Column:
    """The four outer corners of an image with a tangent-plane header in ICRS, an array of structs ra and dec; null for other headers."""

    def of(c: Column) -> Column:
        number = lambda k: F.replace(F.upper(F.try_element_at(c, F.lit(k))), F.lit("D"), F.lit("E")).try_cast("double")
        nx, ny, ra0, dec0, px, py = (number(k) for k in ("NAXIS1", "NAXIS2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2"))
        cd = [[number(f"CD{i}_{j}") for j in (1, 2)] for i in (1, 2)]
        d0 = F.radians(dec0)

        def corner(u: Column, v: Column) -> Column:
            x = F.radians(cd[0][0] * (u - px) + cd[0][1] * (v - py))
            y = F.radians(cd[1][0] * (u - px) + cd[1][1] * (v - py))
            below = F.cos(d0) - y * F.sin(d0)
            ra = F.pmod(ra0 + F.degrees(F.atan2(x, below)), F.lit(360.0))
            dec = F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(below * below + x * x)))
            return F.struct(F.round(ra, 12).alias("ra"), F.round(dec, 12).alias("dec"))

        half = F.lit(0.5)
        corners = F.array(corner(half, half), corner(nx + half, half), corner(nx + half, ny + half), corner(half, ny + half))
        text = lambda k: F.try_element_at(c, F.lit(k))
        size = F.greatest(F.sqrt(cd[0][0] ** 2 + cd[1][0] ** 2) * nx, F.sqrt(cd[0][1] ** 2 + cd[1][1] ** 2) * ny)
        fits = (text("NAXIS") == "2") & (text("RADESYS") == "ICRS") & (text("CTYPE1") == "RA---TAN") & (text("CTYPE2") == "DEC--TAN") & (nx > 0) & (ny > 0) & ra0.between(0, 360) & (F.abs(dec0) < 90) & (F.abs(cd[0][0] * cd[1][1] - cd[0][1] * cd[1][0]) >= 1e-16) & (size <= 10)
        warped = F.exists(F.map_keys(c), lambda k: k.rlike(r"^(PV\d|PS\d|[AB]_|[AB]P_|CPDIS|D2IM|DP\d|DQ\d)"))
        return F.when(fits & ~warped, corners)

    return F.element_at(F.transform(F.array(cards(header)), of), 1)


def frames_to_cells(frames: DataFrame, bands: list[str], order: int, *keys: str) -> DataFrame:
    """(keys, order, ipix): canonical coverage of the frames (an array of vertices each) of some bands."""
    from skyweave.operators import ranges

    chosen = frames.where(F.col("band").isin(bands)).where("vertices is not null")
    shape = F.array(F.struct(F.lit("polygon").alias("kind"), *[F.lit(None).cast("double").alias(n) for n in ("ra", "dec", "radius")], F.col("vertices")))
    # Frames of one key share their cells, so cells are told apart by key alone.
    shaped = chosen.select(F.struct(F.lit(order).alias("order"), *keys).alias("unit"), shape.alias("shapes"))
    touched = shape_cells(shaped, order, key="unit").select("unit.*", "ipix")
    return ranges.canonical(touched, *keys, finest=order)
