"""Regions of the sky as cells: rectangles, discs and convex polygons, and the spatial joins they allow.

Covers are conservative: a cell is left out only if no point of it can lie in the region, by the largest radius of a cell
of its order. They refine from the twelve base cells or from cells nearby, level by level, on Arrow batches of many units at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import cover, hpx
from skyweave.operators import ranges
from skyweave.plans.scratch import materialize

#: Leaves of a rectangle cover, and its coarsest order.
LEAVES, COARSEST = 4096, 4
#: The order at which covers of small shapes start.
NEAR = 4


def _slices(ra_start: float, ra_end: float) -> list[tuple[float, float]]:
    """Right ascension as slices of at most 180 degrees; none means all of it."""
    width = ra_end - ra_start
    if width >= 360:
        return []
    if width < 0:
        width += 360
    n = max(1, math.ceil(width / 180))
    return [(ra_start + k * width / n, ra_start + (k + 1) * width / n) for k in range(n)]


def check_rectangle(ra_start: float, ra_end: float, dec_min: float, dec_max: float) -> None:
    values = (ra_start, ra_end, dec_min, dec_max)
    if not all(map(math.isfinite, values)) or not (0 <= ra_start < 360 and 0 <= ra_end <= 360 and -90 <= dec_min < dec_max <= 90) or ra_start == ra_end:
        raise ValueError("not a rectangle of the sky")


def classify(order: int, ipix: Column, ra_start: float, ra_end: float, dec_min: float, dec_max: float) -> Column:
    """outside, boundary or inside, for a cell and a rectangle (ra_start > ra_end wraps; 0 to 360 is all)."""
    radius = hpx.max_pixel_radius(order)

    def of(c: Column) -> Column:
        ra, dec = c["ra"], c["dec"]
        out = (dec + radius < dec_min) | (dec - radius > dec_max)
        # A bound at a pole is open: nothing lies beyond it.
        within = F.lit(True)
        if dec_min > -90:
            within = within & (dec - radius >= dec_min)
        if dec_max < 90:
            within = within & (dec + radius <= dec_max)
        sides = _slices(ra_start, ra_end)
        if sides:
            # Degrees from the half-plane of a meridian, counted eastwards.
            east = lambda edge: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(F.radians(dec)) * F.sin(F.radians(ra - edge))))))
            none, some = F.lit(True), F.lit(False)
            for a, b in sides:
                none = none & ((east(a) < -radius) | (east(b) > radius))
                some = some | ((east(a) >= radius) & (east(b) <= -radius))
            out, within = out | none, within & some
        return F.when(out, "outside").when(within, "inside").otherwise("boundary")

    return F.element_at(F.transform(F.array(hpx.pix2ang(order, ipix)), of), 1)


def cover_rectangle(spark: SparkSession, ra_start: float, ra_end: float, dec_min: float, dec_max: float, target: int = 8, leaves: int = LEAVES) -> DataFrame:
    """(order, ipix, state) of at most `leaves` disjoint cells that hold the rectangle.

    Level by level, boundary cells give way to their children that aren't outside, each parent as a whole; where the
    budget stops that, the level is the last. Every level has at most `leaves` rows.
    """
    check_rectangle(ra_start, ra_end, dec_min, dec_max)
    box = (ra_start, ra_end, dec_min, dec_max)
    now = spark.range(hpx.cells(COARSEST)).select(F.lit(COARSEST).alias("order"), F.col("id").alias("ipix"), classify(COARSEST, F.col("id"), *box).alias("state")).where("state <> 'outside'")
    rows = [tuple(r) for r in now.collect()]
    for order in range(COARSEST, target):
        edge = [r for r in rows if r[0] == order and r[2] == "boundary"]
        if not edge:
            break
        parents = spark.createDataFrame([(r[1],) for r in edge], "parent long")
        child = parents.select("parent", F.explode(hpx.children(F.col("parent"))).alias("ipix"))
        kept: dict[int, list[tuple[int, int, str]]] = {r[1]: [] for r in edge}
        for r in child.withColumn("state", classify(order + 1, F.col("ipix"), *box)).where("state <> 'outside'").collect():
            kept[r.parent].append((order + 1, r.ipix, r.state))
        size, split, blocked = len(rows), set(), False
        for parent in sorted(kept):
            if size + len(kept[parent]) - 1 > leaves:
                blocked = True
                continue
            size += len(kept[parent]) - 1
            split.add(parent)
        rows = [r for r in rows if not (r[0] == order and r[1] in split)] + [c for p in split for c in kept[p]]
        if blocked:
            break
    merged = ranges.canonical(spark.createDataFrame([r[:2] for r in rows], "order int, ipix long"), finest=max(target, COARSEST)) if rows else spark.createDataFrame([], "order int, ipix long")
    return _classified(merged, box)


def _classified(cells: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """`cells` (order, ipix) with their state."""
    out = None
    for order in range(COARSEST, hpx.MAX_ORDER + 1):
        part = cells.where(F.col("order") == order).withColumn("state", classify(order, F.col("ipix"), *box))
        out = part if out is None else out.union(part)
    return out


def cover_report(cover: DataFrame, ra_start: float, ra_end: float, dec_min: float, dec_max: float) -> DataFrame:
    """Of a cover: cells, unresolved boundary cells and the largest radius of one, and the areas of rectangle, cover and excess."""
    width = 360.0 if ra_end - ra_start >= 360 else (ra_end - ra_start) % 360
    area = width / 360 * (math.sin(math.radians(dec_max)) - math.sin(math.radians(dec_min))) * hpx.FULL_SKY_DEG2 / 2
    radius = F.element_at(F.array(*[F.lit(hpx.max_pixel_radius(o)) for o in range(hpx.MAX_ORDER + 1)]), F.col("order") + 1)
    edge = F.col("state") == "boundary"
    covered = F.coalesce(F.sum(hpx.cell_area(F.col("order"))), F.lit(0.0))
    return cover.agg(F.count("*").alias("cells"), F.coalesce(F.sum(edge.cast("long")), F.lit(0)).alias("unresolved"), F.coalesce(F.max(F.when(edge, radius)), F.lit(0.0)).alias("max_radius_deg"), F.lit(area).alias("rectangle_deg2"), covered.alias("cover_deg2"), F.greatest(F.lit(0.0), covered - area).alias("excess_deg2"))


def _levels(factor: int) -> int:
    """Orders that an oversampling factor (a power of two) stands for."""
    if factor < 1 or factor & (factor - 1):
        raise ValueError("an oversampling factor is a power of two")
    return factor.bit_length() - 1


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` over all tasks, some to each core: a small file of them, which one task reads, can be much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def covers(shapes: DataFrame, order: int, ra: Column | None = None, dec: Column | None = None, radius: Column | None = None, vertices: Column | None = None, factor: int = 1, deal: bool = True) -> DataFrame:
    """`shapes` with a row for each cell at `order` that can't be ruled out: of the polygon of `vertices` (smaller than a hemisphere;
    one that isn't convex counts as the circle around it), of the circle (ra, dec, radius) where there are none.

    With a `factor`, cells that don't lie inside must hold a cell of log2(factor) orders more that isn't ruled out either: the
    inclusive test of the finer order, folded back to the cells asked for.

    Shapes in a circle of at most a fourth of a cell's side start at order 4 with all cells near its centre; larger ones
    start at the base cells. Shapes are dealt out first, unless the caller did that.
    """
    deep, null = _levels(factor), F.lit(None)
    own = {"__ra": ra, "__dec": dec, "__r": radius}
    made = shapes.withColumns({k: (null if v is None else v).cast("double") for k, v in own.items()} | {"__v": (null if vertices is None else vertices).cast("array<struct<ra:double,dec:double>>")})
    kept = shapes.columns
    schema = T.StructType([*shapes.schema.fields, T.StructField("ipix", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.column(b.schema.get_field_index(n)) for n in ("__ra", "__dec", "__r")]
            numbers = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in at]
            for own, cells in cover.covered(*numbers, b.column(b.schema.get_field_index("__v")), order, deep, NEAR):
                rows = b.select(kept).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells, pa.int64())], names=[*kept, "ipix"])

    return (dealt(made) if deal else made).mapInArrow(run, schema)


def disc_cells(discs: DataFrame, order: int, ra: str = "ra", dec: str = "dec", radius: str = "radius_deg", factor: int = 1) -> DataFrame:
    """`discs` with the cells that may touch each; an oversampling `factor` leaves out more of those that don't."""
    return covers(discs, order, F.col(ra), F.col(dec), F.col(radius), factor=factor)


def _unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(dec)) * F.cos(F.radians(ra)), F.cos(F.radians(dec)) * F.sin(F.radians(ra)), F.sin(F.radians(dec))


def polygon_cells(polygons: DataFrame, order: int, vertices: str = "vertices", factor: int = 1) -> DataFrame:
    """`polygons` (an array of structs ra and dec, convex, smaller than a hemisphere) with the cells that may touch each; as disc_cells() by `factor`."""
    return covers(polygons.where(F.size(vertices) > 0), order, vertices=F.col(vertices), factor=factor)


def units_touching(discs: DataFrame, request: DataFrame, order: int, unit: str = "unit_id", coarse: int = 4) -> DataFrame:
    """Units whose disc may touch a requested cell at `order`: an equi join on coarse cells, then on the cells themselves."""
    blocks = request.select(hpx.parent(F.col("ipix"), order - coarse).alias("ipix")).distinct()
    near = disc_cells(discs, coarse).join(blocks, "ipix", "left_semi").drop("ipix").dropDuplicates([unit])
    return disc_cells(near, order).join(request.select("ipix").distinct(), "ipix", "left_semi").groupBy(unit).agg(F.count("*").alias("cells"))


def cone(points: DataFrame) -> DataFrame:
    """The mean direction of points and the largest distance from it: (ra, dec, radius_deg)."""
    x, y, z = _unit(F.col("ra"), F.col("dec"))
    mean = points.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    ra = F.degrees(F.atan2("y", "x"))
    centre = mean.select(F.when(ra < 0, ra + 360).otherwise(ra).alias("ra0"), F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("dec0"))
    far = points.join(F.broadcast(centre), F.lit(True)).groupBy("ra0", "dec0").agg(F.max(hpx.angular_distance(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))).alias("radius_deg"))
    return far.withColumnsRenamed({"ra0": "ra", "dec0": "dec"})


def in_cone(points: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Points within `radius` degrees of a direction."""
    return points.where(hpx.angular_distance(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec)) <= radius)


def batches(cells: DataFrame, order: int, most: int = 64, area: float = 100.0) -> DataFrame:
    """`cells` numbered into batches of at most `most` cells and `area` square degrees, in cell order."""
    own = hpx.FULL_SKY_DEG2 / hpx.cells(order)
    if own > area:
        raise ValueError(f"one cell of order {order} exceeds {area} square degrees")
    size = max(1, min(most, int(area / own + 1e-12)))
    return ranges.numbered(cells, "ipix").withColumn("batch", F.floor(F.col("number") / size)).drop("number")


#: Limits of a region request.
REGION_AREA, REGION_CELLS, GEOMETRY_CELLS = 100.0, 4096, 10_000


def check_region(order: int, cells: list[int], sources: list[str], most_sources: int = 8) -> list[int]:
    """The distinct cells of a region request in order; an error unless order, cells, area and sources are allowed."""
    if not 0 <= order <= hpx.MAX_ORDER or not cells or len(cells) > REGION_CELLS or any(not 0 <= c < hpx.cells(order) for c in cells):
        raise ValueError("invalid order or cells")
    own = sorted(set(cells))
    if len(own) * hpx.FULL_SKY_DEG2 / hpx.cells(order) > REGION_AREA:
        raise ValueError(f"the region exceeds {REGION_AREA} square degrees")
    if not 1 <= len(sources) <= most_sources or len(set(sources)) < len(sources) or any(not s or s.startswith("public:") or len(s) > 128 for s in sources):
        raise ValueError("invalid, repeated or non-concrete sources")
    return own


def query_region(sources: DataFrame, coverage: DataFrame, order: int, cells: list[int], budget: int = GEOMETRY_CELLS) -> DataFrame:
    """Each source's coverage inside a region, under one cell budget that sources use up in their order.

    `sources` (source_no, layer_id), `coverage` (layer_id, order, ipix). A source is cut at the requested order or its own
    finest, if that is coarser. Returns (source_no, layer_id, order, ipix, truncated, precision): cells up to the budget.
    """
    spark = coverage.sparkSession
    own = coverage.join(F.broadcast(sources), "layer_id")
    finest = own.groupBy("layer_id").agg(F.max("order").alias("finest"))
    found = None
    cut_at = [r.o for r in finest.select(F.least("finest", F.lit(order)).alias("o")).distinct().collect()]
    for o in sorted(cut_at):  # each an equi join of blocks; at most 14
        at = own.join(finest.where(F.least("finest", F.lit(order)) == o), "layer_id").select("source_no", "layer_id", "order", "ipix", "finest")
        region = spark.createDataFrame([(c,) for c in sorted({c >> 2 * (order - o) for c in cells})], "ipix long")
        part = ranges.project_clipped(at, o, region, budget, "source_no", "layer_id", "finest").withColumn("order", F.lit(o))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return own.select("source_no", "layer_id", "order", "ipix", F.lit(False).alias("truncated"), F.lit("").alias("operation")).limit(0)
    # A source holds at most the region's cells here, so the running sum is over few rows.
    by = W.partitionBy(F.lit(0)).orderBy("source_no", "ipix")
    counted = found.withColumn("rank", F.row_number().over(by))
    total = W.partitionBy("source_no")
    cut = F.max("rank").over(total) > budget
    return counted.withColumn("over", cut).where(F.col("rank") <= budget).select("source_no", "layer_id", "order", "ipix", (F.col("truncated") | F.col("over")).alias("truncated"), F.when(F.col("order") >= F.col("finest"), "exact-native-cell-intersection").otherwise("conservative-projection").alias("operation"))


def selector(spark: SparkSession, cells: tuple[int, list[int]] | None = None, rectangle: tuple[float, float, float, float] | None = None, region: list[tuple[int, int]] | None = None, target: int = 10) -> DataFrame:
    """(order, ipix, batch) of exactly one of cells, a rectangle, or a region of mixed cells (orders 4 to 12, made canonical)."""
    if (cells is not None) + (rectangle is not None) + (region is not None) != 1:
        raise ValueError("give exactly one of cells, rectangle or region")
    if cells is not None:
        order, ipix = cells
        if not 0 <= order <= hpx.MAX_ORDER or not ipix or len(ipix) > REGION_CELLS or any(not 0 <= c < hpx.cells(order) for c in ipix):
            raise ValueError("invalid order or cells")
        flat = spark.createDataFrame([(order, c) for c in sorted(set(ipix))], "order int, ipix long")
    elif rectangle is not None:
        flat = cover_rectangle(spark, *rectangle, target=target).select("order", "ipix")
    else:
        if not 1 <= len(region) <= REGION_CELLS or any(not 4 <= o <= 12 or not 0 <= c < hpx.cells(o) for o, c in region):
            raise ValueError("a region has 1 to 4096 cells of orders 4 to 12")
        flat = ranges.canonical(spark.createDataFrame(region, "order int, ipix long"))
    rows = sorted(tuple(r) for r in flat.collect())  # at most 4096
    out, batch = [], 0
    for order in sorted({o for o, _ in rows}):
        size = max(1, min(64, int(REGION_AREA / (hpx.FULL_SKY_DEG2 / hpx.cells(order)) + 1e-12)))
        own = [c for o, c in rows if o == order]
        out += [(order, c, batch + k // size) for k, c in enumerate(own)]
        batch += -(-len(own) // size)
    return spark.createDataFrame(out, "order int, ipix long, batch int")


def in_view(cells: DataFrame, order: int, ra: float, dec: float, radius: float, far_side: bool = True) -> DataFrame:
    """Cells that a view of `radius` degrees may show, on the side looked at and (through the globe) the far one; coarse orders whole."""
    if order < 6 or radius >= 180 or far_side and radius >= 90:
        return cells
    reach = min(180.0, radius + hpx.max_pixel_radius(order))

    def near(c: Column) -> Column:
        d = hpx.angular_distance(c["ra"], c["dec"], F.lit(ra), F.lit(dec))
        return (d <= reach) | (F.lit(far_side) & (180 - d <= reach))

    return cells.where(F.element_at(F.transform(F.array(hpx.pix2ang(order, F.col("ipix"))), near), 1))


def shared_view_tiles(tiles: DataFrame, surveys: list[str], order: int, ra: float, dec: float, radius: float, budget: int = 192) -> DataFrame:
    """Tiles (six orders coarser) in view where every survey has a product; more than `budget` are an error. `tiles` (survey_id, ipix)."""
    seen = in_view(tiles.where(F.col("survey_id").isin(surveys)), max(0, order - 6), ra, dec, radius, far_side=False)
    out = seen.groupBy("ipix").agg(F.count_distinct("survey_id").alias("n")).where(F.col("n") == len(set(surveys))).select("ipix")
    if (n := out.count()) > budget:
        raise ValueError(f"{n} tiles exceed the budget of {budget}")
    return out


def scope_of_overlap(first: DataFrame, second: DataFrame, order: int, nth: int) -> tuple[DataFrame, DataFrame]:
    """The nth region that two coverages share at `order` (cells, at most 4096) and its cone (at most 10 degrees)."""
    from skyweave.operators import overlap

    both = ranges.intersect(*(ranges.union(ranges.to_ranges(c, order).select("lo", "hi")) for c in (first, second)))
    shared = materialize(ranges.expand(materialize(both, "shared"), overlap.BUDGET), "shared")
    found = overlap.regions(shared, order)
    cells = materialize(found.where(F.col("region") == f"C{nth:02d}").select("ipix"), "region")
    n = cells.count()
    if not 0 < n <= REGION_CELLS:
        raise ValueError(f"region {nth} has {n} cells")
    return cells, overlap.mean_cone(cells, order, slack=0.1, most=10.0)


def healpix_list(cells: DataFrame, order: int, start: int = 0, size: int = 1000) -> DataFrame:
    """A page of the cells that layers (layer_id, order, ipix) cover together at `order`; a layer that is too coarse is an error."""
    if not 0 <= order <= hpx.MAX_ORDER or not 1 <= size <= 10_000:
        raise ValueError("order is 0 to 13, a page 1 to 10000 cells")
    coarse = cells.groupBy("layer_id").agg(F.max("order").alias("finest")).join(ranges.is_full_sky(cells, "layer_id"), "layer_id").where((F.col("finest") < order) & ~F.col("full_sky"))
    if names := [r.layer_id for r in coarse.select("layer_id").limit(100).collect()]:
        raise ValueError(f"layers that don't support order {order}: {sorted(names)}")
    return ranges.page(ranges.union(ranges.to_ranges(cells, order).select("lo", "hi")), start, size)


def cone_lookup(points: DataFrame, products: DataFrame, ra: float, dec: float, radius: float, key: str, most: int) -> DataFrame:
    """The first `most` points of a cone by key, each with its products; `truncated` says whether there were more."""
    near = in_cone(points, ra, dec, radius).orderBy(key).limit(most + 1)
    more = near.agg((F.count("*") > most).alias("truncated"))
    return near.orderBy(key).limit(most).join(F.broadcast(more), F.lit(True)).join(products, key, "left")
