"""HEALPix NESTED cells as column expressions: everything stays inside code generation, no Python on executors.

Orders run from 0 to 13. `N` is 2^order. The pixelisation is that of Gorski et al. 2005.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ORDER = 13
FULL_SKY_DEG2 = 41252.96124941927
#: The face beyond each side of a base face (south-west, north-west, north-east, south-east), and how
#: coordinates turn there for northern, equatorial and southern faces (1 mirrors x, 2 mirrors y, 4 swaps them).
SIDES = ("SW", "NW", "NE", "SE")
STEPS = {"SW": (-1, 0), "NW": (0, 1), "NE": (1, 0), "SE": (0, -1)}
BEYOND = {
    "SW": (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10),
    "NW": (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7),
    "NE": (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4),
    "SE": (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8),
}
TURN = {"SW": (0, 0, 5), "NW": (6, 0, 0), "NE": (5, 0, 0), "SE": (0, 0, 6)}


def cells(order: int) -> int:
    """Cells of an order."""
    return 12 * 4**order


def _long(c: Column) -> Column:
    return c.cast("long")


def spread(v: Column) -> Column:
    """Bit i of v at place 2i: its binary digits read as base 4, which keeps the generated code small."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def gather(v: Column, odd: bool) -> Column:
    """The even (or odd) bits of v, closed up: its base-4 digits' lower (or higher) bits read as base 2."""
    return F.conv(F.translate(F.conv(v.cast("string"), 10, 4), "0123", "0011" if odd else "0101"), 2, 10).cast("long")


def ang2pix(order: int, ra: Column, dec: Column) -> Column:
    """The cell of a direction in degrees; null outside 0 <= ra < 360 or abs(dec) <= 90, and for NaN."""
    n = F.lit(float(2**order))
    z, t = F.sin(F.radians(dec)), ra / F.lit(90.0)
    jp = F.floor(n * (F.lit(0.5) + t) - F.lit(0.75) * n * z)
    jm = F.floor(n * (F.lit(0.5) + t) + F.lit(0.75) * n * z)
    fp, fm = F.floor(jp / n), F.floor(jm / n)
    face = F.when(fp == fm, fp % 4 + 4).when(fp < fm, fp).otherwise(fm + 8)
    side = _long(n)
    x, y = F.pmod(jm, side), side - 1 - F.pmod(jp, side)
    quarter = F.least(F.floor(t), F.lit(3))
    u, r = t - quarter, n * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    a, b = F.least(F.floor(u * r), side - 1), F.least(F.floor((F.lit(1.0) - u) * r), side - 1)
    equator, north = F.abs(z) <= F.lit(2 / 3), z > 0
    face = F.when(equator, face).when(north, quarter).otherwise(quarter + 8)
    x = F.when(equator, x).when(north, side - 1 - b).otherwise(a)
    y = F.when(equator, y).when(north, side - 1 - a).otherwise(b)
    inside = (ra >= 0) & (ra < 360) & (F.abs(dec) <= 90) & ~F.isnan(ra) & ~F.isnan(dec)
    return F.when(inside, _long(face) * F.lit(4**order).cast("long") + spread(_long(x)) + 2 * spread(_long(y)))


def face_xy(order: int, ipix: Column) -> tuple[Column, Column, Column]:
    """Base face and place in it."""
    inner = F.pmod(_long(ipix), F.lit(4**order).cast("long"))
    return F.shiftright(_long(ipix), 2 * order), gather(inner, odd=False), gather(inner, odd=True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(order: int, ipix: Column) -> Column:
    face, x, y = face_xy(order, ipix)
    return F.struct(face.alias("face"), x.alias("x"), y.alias("y"))


def pix2ang(order: int, ipix: Column) -> Column:
    """Centre of a cell: a struct of ra and dec in degrees."""
    return once(_placed(order, ipix), lambda s: _centre(2**order, s["face"], s["x"], s["y"]))


def _centre(n: int, face: Column, x: Column, y: Column) -> Column:
    row, col = F.floor(face / 4), face % 4
    ring = (row + 2) * n - x - y - 1  # from the north pole, 1 to 4N - 1
    north, south = ring < n, ring > 3 * n
    cap = F.when(north, ring).otherwise(4 * n - ring)
    z = F.when(north, 1 - cap * cap / F.lit(3.0 * n * n)).when(south, cap * cap / F.lit(3.0 * n * n) - 1).otherwise((2 * n - ring) * F.lit(2.0 / (3.0 * n)))
    width = F.when(north | south, cap).otherwise(F.lit(n))
    turn = 2 * col + F.when(row == 1, 0).otherwise(1)
    phi = (turn * width + x - y) / (F.lit(2.0) * width) * F.lit(90.0)
    return F.struct(F.when(phi < 0, phi + 360).when(phi >= 360, phi - 360).otherwise(phi).alias("ra"), F.degrees(F.asin(z)).alias("dec"))


def boundaries(order: int, ipix: Column) -> Column:
    """The four corners of a cell, north, west, south and east, as an array of structs of unit vectors x, y and z."""
    return once(_placed(order, ipix), lambda s: F.array(*[_corner(2**order, s["face"], s["x"] + dx, s["y"] + dy) for dx, dy in ((1, 1), (0, 1), (0, 0), (1, 0))]))


def outline(order: int, ipix: Column, parts: int = 4) -> Column:
    """Points along the sides of a cell, `parts` a side, from its south corner on, as an array of structs of unit vectors."""
    steps = range(parts)
    around = [(k, 0) for k in steps] + [(parts, k) for k in steps] + [(parts - k, parts) for k in steps] + [(0, parts - k) for k in steps]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])
    return once(_placed(order, ipix), lambda s: F.transform(places, lambda p: _corner(2**order * parts, s["face"], s["x"] * parts + p["i"], s["y"] * parts + p["j"])))


def _corner(n: int, face: Column, x: Column, y: Column) -> Column:
    """The direction of a lattice point of a base face."""
    row, col = F.floor(face / 4), face % 4
    ring = (row + 2) * n - x - y  # 0 at the north pole, 4N at the south pole
    north, south = ring < n, ring > 3 * n
    cap = F.when(north, ring).when(south, 4 * n - ring).otherwise(n)
    z = F.when(north, 1 - cap * cap / F.lit(3.0 * n * n)).when(south, cap * cap / F.lit(3.0 * n * n) - 1).otherwise((2 * n - ring) * F.lit(2.0 / (3.0 * n)))
    turn = 2 * col + F.when(row == 1, 0).otherwise(1)
    phi = F.when(cap == 0, F.lit(0.0)).otherwise((turn * cap + x - y) / cap * F.lit(math.pi / 4))
    radius = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return F.struct((radius * F.cos(phi)).alias("x"), (radius * F.sin(phi)).alias("y"), z.cast("double").alias("z"))


def neighbours4(order: int, ipix: Column) -> Column:
    """The cells beyond the four sides, in the order of SIDES."""
    return once(_placed(order, ipix), lambda s: _sides(order, s["face"], s["x"], s["y"]))


def _sides(order: int, face: Column, x: Column, y: Column) -> Column:
    n, out = 2**order, []
    for side in SIDES:
        dx, dy = STEPS[side]
        nx, ny = x + dx, y + dy
        crossed = (nx < 0) | (nx >= n) | (ny < 0) | (ny >= n)
        wx, wy = F.pmod(nx, F.lit(n).cast("long")), F.pmod(ny, F.lit(n).cast("long"))
        beyond = F.element_at(F.array(*[F.lit(f).cast("long") for f in BEYOND[side]]), (face + 1).cast("int"))
        turn = F.element_at(F.array(*[F.lit(t) for t in TURN[side]]), (F.floor(face / 4) + 1).cast("int"))
        mx = F.when(turn.bitwiseAND(1) > 0, n - 1 - wx).otherwise(wx)
        my = F.when(turn.bitwiseAND(2) > 0, n - 1 - wy).otherwise(wy)
        swapped = turn.bitwiseAND(4) > 0
        cx = F.when(crossed, F.when(swapped, my).otherwise(mx)).otherwise(nx)
        cy = F.when(crossed, F.when(swapped, mx).otherwise(my)).otherwise(ny)
        out.append(F.when(crossed, beyond).otherwise(face) * F.lit(4**order).cast("long") + spread(_long(cx)) + 2 * spread(_long(cy)))
    return F.array(*out)


def parent(ipix: Column, levels: int | Column = 1) -> Column:
    """The cell that holds a cell, some orders coarser."""
    if isinstance(levels, int):
        return F.shiftright(_long(ipix), 2 * levels)
    return F.floor(ipix / F.pow(F.lit(4.0), levels)).cast("long")


def children(ipix: Column, levels: int = 1) -> Column:
    """The cells inside a cell, some orders finer, as an array."""
    many = F.lit(4**levels).cast("long")
    return F.sequence(_long(ipix) * many, (_long(ipix) + 1) * many - 1)


def uniq_encode(order: Column, ipix: Column) -> Column:
    return (F.pow(F.lit(4.0), order + 1) + ipix).cast("long")


def uniq_decode(uniq: Column) -> tuple[Column, Column]:
    """(order, ipix), the order from the bit length so no logarithm rounds."""
    order = F.floor((F.length(F.bin(uniq)) - 3) / 2).cast("int")
    return order, (uniq - F.pow(F.lit(4.0), order + 1)).cast("long")


def cell_area(order: Column | int) -> Column:
    """Square degrees of a cell."""
    order = F.lit(order) if isinstance(order, int) else order
    return F.lit(FULL_SKY_DEG2) / (F.lit(12.0) * F.pow(F.lit(4.0), order))


def max_pixel_radius(order: int) -> float:
    """Degrees from a cell's centre that hold the whole cell, whichever cell (an upper bound, safe for covers)."""
    n = 2**order
    z = 2 / 3
    a = (math.sqrt(1 - z * z) * math.cos(math.pi / (4 * n)), math.sqrt(1 - z * z) * math.sin(math.pi / (4 * n)), z)
    t = (1 - 1 / n) ** 2
    top = 1 - t / 3
    b = (math.sqrt(max(0.0, 1 - top * top)), 0.0, top)
    return math.degrees(math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b, strict=True))))))


def angular_distance(ra: Column, dec: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two directions, clamped before the arc cosine."""
    dot = F.sin(F.radians(dec)) * F.sin(F.radians(dec2)) + F.cos(F.radians(dec)) * F.cos(F.radians(dec2)) * F.cos(F.radians(ra - ra2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
