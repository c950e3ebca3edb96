"""Image headers as maps between pixels and the sky: tangent-plane, orthographic, equal-area zenithal and plate-carree.

A header's cards become one struct of numbers; pixels and directions go both ways by column expressions. An image's
outline is sampled edge by edge: an edge is halved until the chords between its samples leave it by no more than a
bound, so a projection's bent edges cost as many vertices as they need.

Defined results: a header that isn't one of these, isn't ICRS, has distortions, a singular matrix, no pixels, or rotates
a plate-carree about another place than the equator has no struct, and so no outline; a pixel that the projection doesn't
reach (beyond an orthographic horizon) has no direction, and an image with such a pixel on its edge no outline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators.geometry import cards

#: Projections by their codes; degrees a chord may leave its edge by, and halvings of an edge at most.
PROJECTIONS = ("TAN", "SIN", "ZEA", "CAR")
BOUND, HALVINGS = 0.001, 7
_DISTORTED = r"^(PV\d|PS\d|[AB]_|[AB]P_|CPDIS|D2IM|DP\d|DQ\d)"


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def read(header: Column) -> Column:
    """A struct (kind, nx, ny, ra0, dec0, px, py, a, b, c, d) of a header's text; null if it isn't one of PROJECTIONS. (a b; c d) is the matrix of degrees a pixel."""

    def of(m: Column) -> Column:
        text = lambda k: F.try_element_at(m, F.lit(k))
        number = lambda k: F.replace(F.upper(text(k)), F.lit("D"), F.lit("E")).try_cast("double")
        step = lambda k: F.coalesce(number(f"CDELT{k}"), F.lit(1.0))
        own = text("CD1_1").isNotNull() | text("CD1_2").isNotNull() | text("CD2_1").isNotNull() | text("CD2_2").isNotNull()
        at = lambda i, j: F.when(own, F.coalesce(number(f"CD{i}_{j}"), F.lit(0.0))).otherwise(step(i) * F.coalesce(number(f"PC{i}_{j}"), F.lit(1.0 if i == j else 0.0)))
        kind = F.when(F.substring(text("CTYPE1"), 1, 5) == "RA---", F.substring(text("CTYPE1"), 6, 3))
        same = (F.length(text("CTYPE1")) == 8) & (text("CTYPE2") == F.concat(F.lit("DEC--"), kind)) & kind.isin(*PROJECTIONS)
        parts = {"kind": kind, "nx": number("NAXIS1"), "ny": number("NAXIS2"), "ra0": number("CRVAL1"), "dec0": number("CRVAL2"), "px": number("CRPIX1"), "py": number("CRPIX2"), "a": at(1, 1), "b": at(1, 2), "c": at(2, 1), "d": at(2, 2)}
        warped = F.exists(F.map_keys(m), lambda k: k.rlike(_DISTORTED))
        turned = F.coalesce(number("LONPOLE"), F.lit(180.0)) != 180

        def sound(s: Column) -> Column:
            zenithal = (s["kind"] != "CAR") & ~turned
            flat = (s["kind"] == "CAR") & (s["dec0"] == 0) & F.coalesce(number("LONPOLE"), F.lit(0.0)).isin(0.0)
            fits = same & (text("RADESYS") == "ICRS") & ~warped & (zenithal | flat) & (s["nx"] > 0) & (s["ny"] > 0) & s["ra0"].between(0, 360) & s["dec0"].between(-90, 90) & s["px"].isNotNull() & s["py"].isNotNull() & (F.abs(s["a"] * s["d"] - s["b"] * s["c"]) >= 1e-16)
            return F.when(fits, s)

        return hpx.once(F.struct(*[v.alias(k) for k, v in parts.items()]), sound)

    return hpx.once(cards(header), of)


def to_sky(w: Column, u: Column, v: Column) -> Column:
    """The direction (ra, dec) of a pixel; null where the projection has none."""
    x = w["a"] * (u - w["px"]) + w["b"] * (v - w["py"])
    y = w["c"] * (u - w["px"]) + w["d"] * (v - w["py"])

    def turned(p: Column) -> Column:
        r = F.radians(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))
        far = F.when(w["kind"] == "TAN", F.atan(r)).when((w["kind"] == "SIN") & (r <= 1), F.asin(r)).when((w["kind"] == "ZEA") & (r <= 2), 2 * F.asin(r / 2))
        return hpx.once(F.struct(far.alias("c"), F.atan2(p["x"], p["y"]).alias("t"), F.radians(w["dec0"]).alias("d0")), lambda s: placed(s))

    def placed(s: Column) -> Column:
        dec = F.asin(_clip(F.sin(s["d0"]) * F.cos(s["c"]) + F.cos(s["d0"]) * F.sin(s["c"]) * F.cos(s["t"])))
        ra = F.atan2(F.sin(s["c"]) * F.sin(s["t"]), F.cos(s["c"]) * F.cos(s["d0"]) - F.sin(s["c"]) * F.sin(s["d0"]) * F.cos(s["t"]))
        return F.when(s["c"].isNotNull(), F.struct(F.pmod(w["ra0"] + F.degrees(ra), F.lit(360.0)).alias("ra"), F.degrees(dec).alias("dec")))

    flat = lambda p: F.when((F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90), F.struct(F.pmod(w["ra0"] + p["x"], F.lit(360.0)).alias("ra"), p["y"].alias("dec")))
    return hpx.once(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(w["kind"] == "CAR", flat(p)).otherwise(turned(p)))


def to_pixel(w: Column, ra: Column, dec: Column) -> Column:
    """The pixel (u, v) of a direction; null where the projection has none (on the far side of TAN and SIN, opposite the centre of ZEA)."""
    turn = F.radians(F.pmod(ra - w["ra0"] + 180, F.lit(360.0)) - 180)
    d, d0 = F.radians(dec), F.radians(w["dec0"])
    east, north = F.cos(d) * F.sin(turn), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(turn)
    near = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(turn)
    parts = F.struct(east.alias("e"), north.alias("n"), near.alias("z"))
    scale = lambda p: F.when((w["kind"] == "TAN") & (p["z"] > 0), 1 / p["z"]).when((w["kind"] == "SIN") & (p["z"] >= 0), F.lit(1.0)).when((w["kind"] == "ZEA") & (p["z"] > -1), F.sqrt(2 / (1 + p["z"])))
    plane = hpx.once(parts, lambda p: F.struct(F.degrees(p["e"] * scale(p)).alias("x"), F.degrees(p["n"] * scale(p)).alias("y")))
    flat = F.struct(F.degrees(turn).alias("x"), dec.cast("double").alias("y"))
    det = w["a"] * w["d"] - w["b"] * w["c"]
    back = lambda p: F.when(p["x"].isNotNull(), F.struct(((w["d"] * p["x"] - w["b"] * p["y"]) / det + w["px"]).alias("u"), ((w["a"] * p["y"] - w["c"] * p["x"]) / det + w["py"]).alias("v")))
    return hpx.once(F.when(w["kind"] == "CAR", flat).otherwise(plane), back)


def _off_arc(p: Column, q: Column, r: Column) -> Column:
    """Degrees from a direction r to the great circle through p and q; 0 where those are one."""
    unit = lambda s: (F.cos(F.radians(s["dec"])) * F.cos(F.radians(s["ra"])), F.cos(F.radians(s["dec"])) * F.sin(F.radians(s["ra"])), F.sin(F.radians(s["dec"])))
    a, b, c = unit(p), unit(q), unit(r)
    normal = F.struct(*[(a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3]).alias(n) for k, n in enumerate("xyz")])
    off = lambda n: F.coalesce(F.try_divide(n["x"] * c[0] + n["y"] * c[1] + n["z"] * c[2], F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])), F.lit(0.0))
    return F.degrees(F.asin(_clip(F.abs(hpx.once(normal, off)))))


def _edge(w: Column, start: tuple[Column, Column], end: tuple[Column, Column], bound: float, halvings: int) -> Column:
    """Samples of one edge, without its end: those of the first number of halvings whose chords are near enough."""

    def at(share: Column) -> Column:
        return to_sky(w, start[0] + (end[0] - start[0]) * share, start[1] + (end[1] - start[1]) * share)

    # Samples twice as fine as the finest chords hold every chord's ends and its middle.
    finest = 2 ** (halvings + 1)
    samples = F.transform(F.sequence(F.lit(0), F.lit(finest)), lambda k: at(k / finest))

    def chosen(all_: Column) -> Column:
        def off(j: int) -> Column:
            wide = finest >> j
            error = lambda k: _off_arc(F.get(all_, k * wide), F.get(all_, (k + 1) * wide), F.get(all_, k * wide + wide // 2))
            return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(2**j - 1)), error))

        out = F.filter(all_, _every(2, finest))
        for j in reversed(range(halvings)):
            out = F.when(off(j) <= bound, F.filter(all_, _every(finest >> j, finest))).otherwise(out)
        return F.when(F.forall(all_, lambda p: p.isNotNull()), out)

    return hpx.once(samples, chosen)


def _every(step: int, end: int):
    return lambda _, i: (i % step == 0) & (i < end)


def outline(w: Column, bound: float = BOUND, halvings: int = HALVINGS) -> Column:
    """The vertices (ra, dec) of an image's outline from its first pixel's outer corner on; null if some of it has no direction."""
    low = F.lit(0.5)
    corners = [(low, low), (w["nx"] + low, low), (w["nx"] + low, w["ny"] + low), (low, w["ny"] + low)]
    edges = [_edge(w, corners[k], corners[(k + 1) % 4], bound, halvings) for k in range(4)]
    return F.when(w.isNotNull(), F.concat(*edges))
