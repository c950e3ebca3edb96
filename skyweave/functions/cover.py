"""Covers of shapes on numpy arrays: the part of a task that refines one Arrow batch of shapes, level by level.

Cells are those of hpx. A frontier of (shape, cell) pairs never holds more than PAIRS: a larger one is cut and its parts
are walked one after another, so a task's memory doesn't depend on how large a shape is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from skyweave.functions import hpx

#: Pairs of a frontier, corners handled at once, and degrees of a box of directions that share their first cells.
PAIRS, CORNERS, BOX = 200_000, 500_000, 4


def _even_bits(v: np.ndarray) -> np.ndarray:
    v = v & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v


def centres(order: int, ipix: np.ndarray) -> np.ndarray:
    """Unit vectors (3, n) of the centres of cells."""
    n = 2**order
    face, x, y = ipix >> 2 * order, _even_bits(ipix & (4**order - 1)), _even_bits((ipix & (4**order - 1)) >> 1)
    row, col = face // 4, face % 4
    ring = (row + 2) * n - x - y - 1
    north, south = ring < n, ring > 3 * n
    polar = north | south
    width = np.where(north, ring, np.where(south, 4 * n - ring, n))
    off = width * width / (3.0 * n * n)  # from the pole, in z
    z = np.where(north, 1 - off, np.where(south, off - 1, (2 * n - ring) * (2.0 / (3.0 * n))))
    radius = np.sqrt(np.where(polar, off * (2 - off), 1 - z * z))
    phi = ((2 * col + (row != 1)) * width + x - y) / (2.0 * width) * (np.pi / 2)
    return np.stack([radius * np.cos(phi), radius * np.sin(phi), z])


def directions(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """Unit vectors (3, ...) of directions in degrees."""
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])


def small(order: int) -> float:
    """Degrees of radius up to which a shape starts with the cells near it: a fourth of a cell's side."""
    return float(np.degrees(np.sqrt(4 * np.pi / hpx.cells(order)))) / 4


@lru_cache(maxsize=8)
def _near_boxes(order: int) -> np.ndarray:
    """Of each box of directions, all cells whose circle a small shape centred in it may meet; -1 fills up."""
    dec, ra = np.meshgrid(np.arange(-90 + BOX / 2, 90, BOX), np.arange(BOX / 2, 360, BOX), indexing="ij")
    at = centres(order, np.arange(hpx.cells(order)))
    reach = np.cos(np.radians(min(180.0, BOX / 2 * 1.4143 + small(order) + hpx.max_pixel_radius(order) + 0.01)))
    rows = [np.flatnonzero(b @ at >= reach) for b in directions(ra.ravel(), dec.ravel()).T]
    out = np.full((len(rows), max(map(len, rows))), -1, dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _starts(order: int, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = 180 // BOX, 360 // BOX
    box = np.minimum((dec + 90) // BOX, rows - 1).astype(np.int64) * cols + np.minimum((ra % 360) // BOX, cols - 1).astype(np.int64)
    cells = _near_boxes(order)[box]
    own, place = np.nonzero(cells >= 0)
    return own, cells[own, place]


class Shapes:
    """Circles (m: unit vectors (3, k), radius in degrees), and the sides of the convex polygons inside them (normals (3, k, s); s is 0 for circles)."""

    def __init__(self, m: np.ndarray, radius: np.ndarray, sides: np.ndarray, slack: np.ndarray | float = 0.0):
        self.m, self.radius, self.sides, self.slack = m, radius, sides, slack

    def _within(self, own: np.ndarray, at: np.ndarray, more: float) -> np.ndarray:
        limit = self.radius + more
        least = np.where(limit >= 180, -2.0, np.where(limit >= 0, np.cos(np.radians(limit)), 2.0))
        return (self.m[:, own] * at).sum(axis=0) >= least[own]

    def near(self, level: int, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a cell's circle may meet a shape."""
        r = hpx.max_pixel_radius(level)
        out, slack = self._within(own, at, r + self.slack), np.sin(np.radians(min(90.0, r)))
        for k in range(self.sides.shape[2]):
            out &= ~((self.sides[:, own, k] * at).sum(axis=0) < -slack)
        return out

    def holds(self, level: int, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a cell's circle lies in a shape."""
        r = hpx.max_pixel_radius(level)
        out, slack = self._within(own, at, 0.0 if self.sides.shape[2] else -r), np.sin(np.radians(min(90.0, r)))
        for k in range(self.sides.shape[2]):
            out &= (self.sides[:, own, k] * at).sum(axis=0) >= slack
        return out


def polygons(ra: np.ndarray, dec: np.ndarray) -> Shapes:
    """Polygons of equally many corners (k, s). Those that aren't convex, or reach far, count as the circle around them: their sides rule nothing out."""
    v = directions(ra, dec)
    m = v.sum(axis=2)
    size = np.sqrt((m * m).sum(axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = m / size
        far = np.degrees(np.arccos(np.clip((v * middle[:, :, None]).sum(axis=0), -1, 1))).max(axis=1)
        n = np.cross(v, np.roll(v, -1, axis=2), axis=0)
        # Sides between equal corners have no direction and rule nothing out.
        sides = n * np.sign((n * m[:, :, None]).sum(axis=0)) / np.sqrt((n * n).sum(axis=0))
    turn = np.sign((n * np.roll(v, -2, axis=2)).sum(axis=0))
    plain = (turn.max(axis=1) > 0) ^ (turn.min(axis=1) < 0)
    known = size > 1e-9
    plain &= known & (far < 80)
    return Shapes(np.where(known, middle, [[0.0], [0.0], [1.0]]), np.where(known, far, 180.0), np.where(plain[:, None], sides, np.nan), np.where(plain, 1e-9, 0.0))


def _walk(shapes: Shapes, own: np.ndarray, ipix: np.ndarray, level: int, order: int, deep: int, tested: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells at `order` below a frontier at a level that aren't ruled out on the way down."""
    for k in range(0, len(own), PAIRS):
        i, c = own[k : k + PAIRS], ipix[k : k + PAIRS]
        if tested:
            at = centres(level, c)
            ok = shapes.near(level, i, at)
            i, c, at = i[ok], c[ok], at[:, ok]
        if not len(i):
            continue
        if level < order:
            yield from _walk(shapes, np.repeat(i, 4), (c[:, None] * 4 + np.arange(4)).ravel(), level + 1, order, deep, True)
        elif not deep:
            yield i, c
        else:
            whole = shapes.holds(level, i, at)
            yield i[whole], c[whole]
            yield from _finer(shapes, i[~whole], c[~whole], order, deep)


def _finer(shapes: Shapes, own: np.ndarray, ipix: np.ndarray, order: int, deep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of some pairs that hold a cell `deep` orders finer that isn't ruled out; every pair is told once."""
    step = max(1, PAIRS // 4**deep)
    for k in range(0, len(own), step):
        i, c = own[k : k + step], ipix[k : k + step]
        pair, fine = np.arange(len(i)), c
        for level in range(order + 1, order + deep + 1):
            pair, fine = np.repeat(pair, 4), (fine[:, None] * 4 + np.arange(4)).ravel()
            ok = shapes.near(level, i[pair], centres(level, fine))
            pair, fine = pair[ok], fine[ok]
        kept = np.unique(pair)
        yield i[kept], c[kept]


def _cells(shapes: Shapes, ra: np.ndarray, dec: np.ndarray, order: int, deep: int, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    level = min(order, near)
    own = np.arange(len(ra))
    little = (shapes.radius <= small(level)) & (level > 0)
    i, c = _starts(level, ra[little], dec[little])
    yield from _walk(shapes, own[little][i], c, level, order, deep, True)
    large = own[~little & ~np.isnan(shapes.radius)]
    yield from _walk(shapes, np.repeat(large, 12), np.tile(np.arange(12), len(large)), 0, order, deep, True)


def covered(ra: np.ndarray, dec: np.ndarray, radius: np.ndarray, corners: pa.ListArray, order: int, deep: int, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, cell) of the cells that shapes may touch: polygons where there are corners, circles elsewhere; none for a shape with a null or NaN in it."""
    count = np.nan_to_num(corners.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = corners.flatten()
    first = np.cumsum(count) - count
    v_ra, v_dec = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("ra", "dec"))
    for size in np.unique(count):
        every = np.flatnonzero(count == size)
        step = max(1, CORNERS // max(1, size))
        for k in range(0, len(every), step):
            own = every[k : k + step]
            if size:
                at = first[own][:, None] + np.arange(size)
                own, at = (x[np.isfinite(v_ra[at]).all(axis=1) & np.isfinite(v_dec[at]).all(axis=1)] for x in (own, at))
                shapes = polygons(v_ra[at], v_dec[at])
                x, y, z = shapes.m
                a, d = np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))
            else:
                own = own[np.isfinite(ra[own]) & np.isfinite(dec[own]) & ~np.isnan(radius[own])]
                a, d = ra[own], dec[own]
                shapes = Shapes(directions(a, d), radius[own], np.empty((3, len(own), 0)))
            for i, c in _cells(shapes, a, d, order, deep, near):
                yield own[i], c
