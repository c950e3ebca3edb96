"""Coverage as half-open cell ranges [lo, hi) and as mixed-order cells, all in joins, windows and expressions.

Ranges are never expanded until an operator has to return cells. They are merged inside blocks of BLOCK cells, so that a
window never holds more rows than a block has cells, however many ranges one survey has; then pieces that touch a
block's edge are stitched, two a block at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import hpx

#: Cells of a block: rows of a window at most, and pieces that the whole sky at the finest order falls into, 49,152.
BLOCK = 4**7


def to_ranges(cells: DataFrame, order: int = hpx.MAX_ORDER, cell_order: str | int = "order", ipix: str = "ipix") -> DataFrame:
    """`cells` with lo and hi at `order`; coarser cells widen, finer cells floor to the cell that holds them."""
    at = F.lit(cell_order) if isinstance(cell_order, int) else F.col(cell_order)
    wide = F.pow(F.lit(4.0), F.lit(order) - at)
    lo = F.when(at <= order, F.col(ipix) * wide).otherwise(F.floor(F.col(ipix) * wide)).cast("long")
    hi = F.when(at <= order, (F.col(ipix) + 1) * wide).otherwise(F.floor(F.col(ipix) * wide) + 1).cast("long")
    return cells.withColumns({"lo": lo, "hi": hi})


def union(ranges: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """Disjoint ranges of each key: overlapping and touching ones merge."""
    cut = _cut(ranges.select(*keys, "lo", "hi"), block).groupBy(*keys, "block", "lo").agg(F.max("hi").alias("hi"))
    merged = _merge(cut, *keys, "block").drop("block")
    edge = (F.col("lo") % block == 0) | (F.col("hi") % block == 0)
    return merged.where(~edge).unionByName(_merge(merged.where(edge), *keys))


def _merge(ranges: DataFrame, *keys: str) -> DataFrame:
    """Merged ranges of each key, by one sort of its rows."""
    by = W.partitionBy(*(keys or [F.lit(0)])).orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    grouped = marked.withColumn("__run", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def intersect_all(ranges: DataFrame, key: str, n: int, block: int = BLOCK) -> DataFrame:
    """Ranges that all `n` keys cover, by a boundary sweep over each key's own disjoint ranges in every block: no theta join."""
    single = _cut(union(ranges.select(key, "lo", "hi"), key, block=block), block)
    steps = single.select("block", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("s")).groupBy("block", "s.at").agg(F.sum("s.d").alias("d"))
    by = W.partitionBy("block").orderBy("at")
    depth = steps.select(F.col("at").alias("lo"), F.lead("at").over(by).alias("hi"), F.sum("d").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("depth"))
    return union(depth.where(F.col("depth") == n).select("lo", "hi"), block=block)


def intersect(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ranges common to two tables of disjoint ranges. Both are cut at multiples of `block`, which makes the join equi."""
    a, b = (_cut(x, block) for x in (left, right))
    b = b.select("block", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = a.join(b, "block").where("lo < hi2 and lo2 < hi")
    return union(both.select(F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")))


def _cut(ranges: DataFrame, block: int) -> DataFrame:
    at = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))
    cut = ranges.withColumn("block", at)
    return cut.withColumns({"lo": F.greatest("lo", F.col("block") * block), "hi": F.least("hi", (F.col("block") + 1) * block)})


def contained(points: DataFrame, ranges: DataFrame, ipix: str = "ipix", block: int = BLOCK) -> DataFrame:
    """The rows whose cell lies in a range."""
    cut = _cut(ranges.select("lo", "hi"), block)
    placed = points.withColumn("block", F.floor(F.col(ipix) / block))
    hit = (placed["block"] == cut["block"]) & (F.col(ipix) >= F.col("lo")) & (F.col(ipix) < F.col("hi"))
    return placed.join(cut, hit, "left_semi").drop("block")


def expand(ranges: DataFrame, budget: int | None = None) -> DataFrame:
    """The cells of ranges; beyond `budget` cells an error, before any is made."""
    if budget is not None and (n := ranges.agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).first().n or 0) > budget:
        raise ValueError(f"{n} cells exceed the budget of {budget}")
    return ranges.withColumn("ipix", F.explode(F.sequence("lo", F.col("hi") - 1))).drop("lo", "hi")


def page(ranges: DataFrame, start: int, size: int) -> DataFrame:
    """The `size` cells from `start` on, opening only ranges that the page touches."""
    from_lo = ranges.where(F.col("hi") > start).withColumn("lo", F.greatest("lo", F.lit(start)))
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # `size` rows of ranges always hold the page, so only they are sorted together.
    near = from_lo.orderBy("lo").limit(size).withColumn("before", before).where(F.col("before") < size)
    return expand(near.withColumn("hi", F.least("hi", F.col("lo") + size - F.col("before"))).drop("before"))


def project(cells: DataFrame, order: int, *keys: str) -> DataFrame:
    """Distinct cells of each key at `order`, by way of merged ranges."""
    return expand(union(to_ranges(cells, order).select(*keys, "lo", "hi"), *keys))


def canonical(cells: DataFrame, *keys: str, coarsest: int = 4, finest: int = 12) -> DataFrame:
    """Cells less those inside another, with complete quartets merged upwards, never coarser than `coarsest`.

    Cells become merged ranges at the finest order, and a merged range splits into its largest aligned cells by
    arithmetic: of each order, those before the first and those behind the last cell of the order above.
    """
    merged = union(to_ranges(cells, finest).select(*keys, "lo", "hi"), *keys)
    runs = []
    for order in range(coarsest, finest + 1):
        size = 4 ** (finest - order)
        first, last = F.ceil(F.col("lo") / size), F.floor(F.col("hi") / size)
        run = lambda a, b, o=order: F.struct(F.lit(o).alias("order"), a.alias("a"), b.alias("b"))
        if order == coarsest:
            runs.append(run(first, last))
            continue
        up, down = F.ceil(F.col("lo") / (4 * size)) * 4, F.floor(F.col("hi") / (4 * size)) * 4
        inner = up <= down
        runs += [run(first, F.when(inner, up).otherwise(last)), run(F.when(inner, down).otherwise(last), last)]
    parts = merged.select(*keys, F.explode(F.filter(F.array(*runs), lambda r: r["a"] < r["b"])).alias("r"))
    return parts.select(*keys, F.col("r.order").cast("int").alias("order"), F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("ipix"))


def capped(cells: DataFrame, most: int, *keys: str, coarsest: int = 4) -> DataFrame:
    """Canonical cells none finer than `most`: finer ones are taken by the cell that holds them."""
    finer = F.col("order") > most
    up = F.when(finer, F.floor(F.col("ipix") / F.pow(F.lit(4.0), F.col("order") - most))).otherwise(F.col("ipix")).cast("long")
    return canonical(cells.select(*keys, F.least("order", F.lit(most)).alias("order"), up.alias("ipix")), *keys, coarsest=min(coarsest, most), finest=most)


def identity(cells: DataFrame, *keys: str) -> DataFrame:
    """A digest of each key's coverage that doesn't depend on how its cells are packed.

    A digest is of all ranges in order, so one task reads a key's; they stream through it a batch at a time, and no row or
    buffer holds them all.
    """
    merged = union(to_ranges(cells).select(*keys, "lo", "hi"), *keys)
    ordered = (merged.repartition(*keys) if keys else merged.coalesce(1)).sortWithinPartitions(*keys, "lo")
    schema = T.StructType([merged.schema[k] for k in keys] + [T.StructField("revision", T.StringType()), T.StructField("cells", T.LongType())])
    return ordered.select(*keys, "lo", "hi").mapInArrow(lambda batches: _digests(batches, schema.names), schema)


def _digests(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    key, digest, cells, width = None, None, 0, len(names) - 2

    def done() -> pa.RecordBatch:
        digest.update(b"]")
        return pa.RecordBatch.from_arrays([*key, pa.array([digest.hexdigest()]), pa.array([cells], pa.int64())], names=names)

    for b in batches:
        lo, hi = b.column(width).to_pylist(), b.column(width + 1).to_pylist()
        keys = list(zip(*[b.column(k).to_pylist() for k in range(width)], strict=True)) if width else [()] * len(lo)
        first = 0
        while first < len(lo):
            last = first
            while last < len(lo) and keys[last] == keys[first]:
                last += 1
            own = [b.column(k).slice(first, 1) for k in range(width)]
            if key is None or [c.to_pylist() for c in own] != [c.to_pylist() for c in key]:
                if key is not None:
                    yield done()
                key, digest, cells, mark = own, hashlib.sha256(b"["), 0, ""
            digest.update((mark + ",".join(f"[{x},{y}]" for x, y in zip(lo[first:last], hi[first:last], strict=True))).encode())
            cells, mark, first = cells + sum(hi[first:last]) - sum(lo[first:last]), ",", last
    if key is not None:
        yield done()


def tree_identity(cells: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """As identity(), in parallel: the digest of the digests of blocks, so no row holds more than a block's ranges."""
    merged = _cut(union(to_ranges(cells).select(*keys, "lo", "hi"), *keys), block)
    listed = lambda rows, text: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), text), ",")
    blocks = merged.groupBy(*keys, "block").agg(F.sha2(listed(F.struct("lo", "hi"), lambda r: F.format_string("%d-%d", r["lo"], r["hi"])), 256).alias("d"))
    return blocks.groupBy(*keys).agg(F.sha2(listed(F.struct("block", "d"), lambda r: F.format_string("%d:%s", r["block"], r["d"])), 256).alias("revision"))


def is_full_sky(cells: DataFrame, *keys: str) -> DataFrame:
    """Whether each key covers every cell."""
    merged = union(to_ranges(cells).select(*keys, "lo", "hi"), *keys)
    return merged.groupBy(*keys).agg((F.sum(F.col("hi") - F.col("lo")) == hpx.cells(hpx.MAX_ORDER)).alias("full_sky"))


def overlapping_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, order, ipix) that repeat or lie inside another cell of the same key, as often as they do: by equal cells, and by a probe of each cell's ancestors."""
    counted = cells.groupBy(*keys, "order", "ipix").agg(F.count("*").alias("n"))
    above = counted.where("order > 0").select(*keys, F.col("order").alias("own"), F.col("ipix").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("order") - 1)).alias("order"))
    probes = above.select(*keys, "own", "cell", "order", F.floor(F.col("cell") / F.pow(F.lit(4.0), F.col("own") - F.col("order"))).cast("long").alias("ipix"))
    inside = probes.join(counted.select(*keys, "order", "ipix"), [*keys, "order", "ipix"], "left_semi").select(*keys, F.col("own").alias("order"), F.col("cell").alias("ipix")).distinct()
    both = counted.join(inside.withColumn("inside", F.lit(1)), [*keys, "order", "ipix"], "left")
    copies = F.col("n") - 1 + F.coalesce("inside", F.lit(0))
    return both.where(copies > 0).select(*keys, "order", "ipix", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("__k")).drop("__k")


def tiles(cells: DataFrame, *keys: str, size: int = 4096) -> DataFrame:
    """Sorted distinct tiles of `size` cells."""
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_set(F.floor(F.col("ipix") / size))).alias("tile_ids"))


def fold_match(request: DataFrame, layer: DataFrame, levels: int) -> DataFrame:
    """Requested cells that a layer `levels` orders coarser holds, kept in the requested order."""
    held: Column = layer.select(F.col("ipix").alias("held")).distinct()
    return request.join(held, hpx.parent(F.col("ipix"), levels) == F.col("held"), "left_semi")


def tile_ranges(ranges: DataFrame, *keys: str, size: int = 4096) -> DataFrame:
    """Ranges of the tiles that hold ranges of cells, merged."""
    return union(ranges.select(*keys, F.floor(F.col("lo") / size).alias("lo"), F.ceil(F.col("hi") / size).alias("hi")), *keys)


def numbered(rows: DataFrame, key: str, *groups: str, per: int = 4096, name: str = "number") -> DataFrame:
    """`rows` with their place (from 0) in the order of the integer `key`, of each group if any, without one sort of all.

    Rows are counted in blocks of `per` keys; the blocks' counts alone are summed up in order, and rows are placed inside
    their block. Equal keys are placed in any order among themselves.
    """
    placed = rows.withColumn("__block", F.floor(F.col(key) / per))
    counts = placed.groupBy(*groups, "__block").agg(F.count("*").alias("n"))
    before = counts.select(*groups, "__block", (F.sum("n").over(W.partitionBy(*(groups or [F.lit(0)])).orderBy("__block")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*groups, "__block").orderBy(key)) - 1
    return placed.withColumn("__inside", inside).join(before, [*groups, "__block"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__before", "__inside")


def project_clipped(cells: DataFrame, order: int, region: DataFrame, limit: int, *keys: str) -> DataFrame:
    """Cells of each key at `order` inside `region` (ipix at that order), at most `limit` in cell order, and whether more were there."""
    wanted = union(region.select(F.col("ipix").alias("lo"), (F.col("ipix") + 1).alias("hi")))
    coarse = union(to_ranges(cells, order).select(*keys, "lo", "hi"), *keys)
    a, b = _cut(coarse, BLOCK), _cut(wanted, BLOCK).select("block", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = a.join(b, "block").where("lo < hi2 and lo2 < hi").select(*keys, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))
    before = F.sum(F.col("hi") - F.col("lo")).over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("lo"))
    counted = both.withColumns({"before": before - (F.col("hi") - F.col("lo")), "total": F.sum(F.col("hi") - F.col("lo")).over(W.partitionBy(*(keys or [F.lit(0)])))})
    kept = counted.where(F.col("before") < limit).withColumn("hi", F.least("hi", F.col("lo") + limit - F.col("before")))
    return expand(kept.select(*keys, "lo", "hi", (F.col("total") > limit).alias("truncated")))


def public_order_gate(cells: DataFrame, *keys: str, least: int = 4) -> DataFrame:
    """Whether each key's own precision allows publication: cells of `least` or finer, or the whole sky."""
    finest = cells.groupBy(*keys).agg(F.max("order").alias("max_order"))
    return finest.join(is_full_sky(cells, *keys), list(keys)).withColumn("public", F.col("full_sky") | (F.col("max_order") >= least))


def same_cells(claimed: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """(keys, missing, extra): how a claimed projection differs from the actual one; no row where they agree."""
    cols = [*keys, "order", "ipix"]
    extra = claimed.select(*cols).exceptAll(actual.select(*cols)).select(*keys, F.lit(0).alias("m"), F.lit(1).alias("e"))
    missing = actual.select(*cols).exceptAll(claimed.select(*cols)).select(*keys, F.lit(1).alias("m"), F.lit(0).alias("e"))
    return extra.union(missing).groupBy(*keys).agg(F.sum("m").alias("missing"), F.sum("e").alias("extra"))


def sidecars(layers: DataFrame, at: tuple[int, ...]) -> DataFrame:
    """(part, name, order, cells) of a package: each layer's cells at some orders, the union of each survey's layers, and
    the layers omitted because their native cells are coarser. `layers` (survey_id, layer_id, order, ipix)."""
    finest = layers.groupBy("survey_id", "layer_id").agg(F.max("order").alias("finest"))
    out = None
    for order in at:
        able = layers.join(finest.where(F.col("finest") >= order), ["survey_id", "layer_id"]).where("order = finest")
        cells = project(able, order, "survey_id", "layer_id")
        parts = [
            cells.groupBy("layer_id").agg(F.count("*").alias("cells")).select(F.lit("layer").alias("part"), F.col("layer_id").alias("name"), F.lit(order).alias("order"), "cells"),
            cells.groupBy("survey_id").agg(F.count_distinct("ipix").alias("cells")).select(F.lit("survey"), "survey_id", F.lit(order), "cells"),
            finest.where(F.col("finest") < order).select(F.lit("omitted"), "layer_id", F.lit(order), F.lit(0).cast("long")),
        ]
        for p in parts:
            out = p if out is None else out.union(p)
    return out
