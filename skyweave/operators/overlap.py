"""Where surveys overlap: cells that all selected surveys cover, their connected regions, and the layers behind them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import ranges
from skyweave.operators.evidence import PRECISION
from skyweave.plans.scratch import discard, materialize

#: Fixed value: cells of one overlap answer.
BUDGET = 32_768
#: Cells labelled in one block, if there are no more; and bits of a cell's place in a block of six orders.
ALONE, BLOCK_BITS = 100_000, 12


def shared_cells(cells: DataFrame, surveys: list[str] | None = None, survey: str = "survey_id") -> DataFrame:
    """Cells that every survey (of `surveys`, if given) covers by any of its layers. One aggregation on the cell."""
    if surveys is not None:
        cells = cells.where(F.col(survey).isin(surveys))
        n = F.lit(len(set(surveys)))
        return cells.groupBy("ipix").agg(F.count_distinct(survey).alias("__n")).where(F.col("__n") == n).select("ipix")
    total = cells.agg(F.count_distinct(survey).alias("__all"))
    return cells.groupBy("ipix").agg(F.count_distinct(survey).alias("__n")).join(F.broadcast(total), F.col("__n") == F.col("__all")).select("ipix")


def common_order(layer_orders: DataFrame, surveys: int) -> DataFrame:
    """The finest order that every layer of every survey publishes (survey_id, layer_id, order)."""
    layers = layer_orders.groupBy("survey_id").agg(F.count_distinct("layer_id").alias("layers"))
    at = layer_orders.groupBy("survey_id", "order").agg(F.count_distinct("layer_id").alias("n"))
    full = at.join(layers, "survey_id").where("n = layers")
    return full.groupBy("order").agg(F.count_distinct("survey_id").alias("s")).where(F.col("s") == surveys).agg(F.max("order").alias("order"))


def regions(cells: DataFrame, order: int, budget: int | None = None) -> DataFrame:
    """(ipix, component, region): cells joined through their sides; regions C01, C02, ... by smallest cell.

    Cells are labelled inside blocks first, then only the labels that meet across a block's edge are joined, inside ever
    larger blocks: the number of passes depends on the order alone (one pass for what ALONE cells fit, at most six), and
    no task gets more than a block's cells or the labels on its inner edges. Above `budget` cells it is an error.
    """
    return _named(_labelled(cells, order, budget))


def _labelled(cells: DataFrame, order: int, budget: int | None = None) -> DataFrame:
    """(ipix, component): each cell with the smallest cell that it is joined with through sides."""
    base = materialize(cells.select(F.col("ipix").cast("long").alias("ipix")).distinct(), "cells")
    n = base.count()
    if budget is not None and n > budget:
        raise ValueError(f"{n} cells exceed the budget of {budget}")
    whole = 2 * order + 4  # bits of all cells
    bits = whole if n <= ALONE else min(BLOCK_BITS, whole)
    beside = F.filter(hpx.neighbours4(order, F.col("ipix")), lambda x: x.isNotNull())
    near = base.withColumn("beside", beside)
    labels = near.groupBy(F.shiftright("ipix", bits).alias("block")).applyInArrow(_label_cells, "ipix long, component long")
    if bits >= whole:
        return labels
    labels = materialize(labels, "labels")
    block = lambda c, b: F.shiftright(c, b)
    over = near.select("ipix", F.explode("beside").alias("other")).where((F.col("other") < F.col("ipix")) & (block("other", bits) != block("ipix", bits)))
    ends = over.join(labels.select("ipix", F.col("component").alias("a")), "ipix").join(labels.select(F.col("ipix").alias("other"), F.col("component").alias("b")), "other")
    edges = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        bits = min(bits + BLOCK_BITS, whole)
        # A label is its smallest cell, so it lies in its block; labels of one block are joined there.
        inside = edges.where(block("a", bits) == block("b", bits))
        roots = materialize(inside.groupBy(block(F.col("a"), bits).alias("block")).applyInArrow(_join_labels, "label long, root long"), "roots")
        up = lambda df, c, roots=roots: df.join(roots.withColumnRenamed("label", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        left = up(up(edges.where(block("a", bits) != block("b", bits)), "a"), "b")
        after = materialize(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        joined = materialize(up(labels, "component").select("ipix", "component"), "labels")
        discard(edges, labels, roots)
        edges, labels = after, joined
    return labels


def _named(labels: DataFrame) -> DataFrame:
    """Labelled cells with their region's name, by the place of its smallest cell."""
    heads = ranges.numbered(labels.where("ipix = component").select("component"), "component")
    return labels.join(heads.select("component", F.format_string("C%02d", F.col("number") + 1).alias("region")), "component").select("ipix", "component", "region")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is joined with, through pairs of places."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (hop := label[label] != label).any():
            label[hop] = label[label[hop]]


def _label_cells(table: pa.Table) -> pa.Table:
    """A block's cells (ipix, beside) with the smallest cell that each is joined with inside the block."""
    table = table.combine_chunks()
    ipix = table["ipix"].to_numpy()
    order = np.argsort(ipix)
    beside = table["beside"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
    other, own = beside.flatten().to_numpy(), np.repeat(np.arange(len(ipix)), beside.value_lengths().to_numpy())
    sorted_cells = ipix[order]
    at = np.minimum(np.searchsorted(sorted_cells, other), len(ipix) - 1)
    known = sorted_cells[at] == other
    place = np.empty(len(ipix), dtype=np.int64)
    place[order] = np.arange(len(ipix))
    label = _smallest(len(ipix), place[own[known]], at[known])
    return pa.table({"ipix": sorted_cells, "component": sorted_cells[label]})


def _join_labels(table: pa.Table) -> pa.Table:
    """Labels that meet (a, b) with the smallest label that each is joined with."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    known, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _smallest(len(known), places[: len(a)], places[len(a) :])
    return pa.table({"label": known, "root": known[root]})


def layers_of(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Layers with a cell among `wanted`."""
    return cells.join(wanted.select("ipix").distinct(), "ipix", "left_semi").select("survey_id", "layer_id").distinct()


def finest_overlap(by_order: dict[int, DataFrame], surveys: list[str]) -> tuple[int | None, DataFrame | None]:
    """The finest published order with a non-empty overlap, and that overlap; coarser orders are tried in turn."""
    for order in sorted(by_order, reverse=True):
        found = shared_cells(by_order[order], surveys)
        if not found.isEmpty():
            return order, found
    return None, None


def bounds(cells: DataFrame, order: int, *keys: str) -> DataFrame:
    """Each key's area, RA range (by the largest gap between corners; ra_wraps if it passes 360) and DEC range, by the cells' corners."""
    corners = cells.select(*keys, F.explode(hpx.boundaries(order, F.col("ipix"))).alias("c"))
    ra = F.degrees(F.atan2("c.y", "c.x"))
    at = corners.select(*keys, F.pmod(ra + 360, F.lit(360.0)).alias("ra"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c.z"))))).alias("dec"))
    own = keys or ("__all",)
    at = at if keys else at.withColumn("__all", F.lit(0))
    by = W.partitionBy(*own).orderBy("ra")
    # Distinct corners of a key: four times the cells at most, which the overlap budget bounds.
    ras = at.select(*own, "ra").distinct().select(*own, "ra", F.lead("ra").over(by).alias("nxt"), F.min("ra").over(W.partitionBy(*own)).alias("first"))
    gap = ras.select(*own, "ra", F.coalesce("nxt", "first").alias("nxt"), (F.coalesce("nxt", F.col("first") + 360) - F.col("ra")).alias("gap"))
    widest = gap.groupBy(*own).agg(F.max_by(F.struct(F.col("nxt").alias("ra_min"), F.col("ra").alias("ra_max")), F.struct("gap", (-F.col("ra")).alias("first"))).alias("g"))
    rest = at.groupBy(*own).agg(F.min("dec").alias("dec_min"), F.max("dec").alias("dec_max"), (F.count("*") / 4).cast("long").alias("cells"))
    out = widest.join(rest, list(own)).select(*keys, "g.ra_min", "g.ra_max", (F.col("g.ra_min") > F.col("g.ra_max")).alias("ra_wraps"), "dec_min", "dec_max", "cells")
    return out.withColumn("area_deg2", F.col("cells") * hpx.cell_area(order))


def cones(cells: DataFrame, order: int, *keys: str, slack: float = 0.01) -> DataFrame:
    """Each key's enclosing cone: the middle of its bounds, and the farthest corner and a little more."""
    span = F.when(F.col("ra_wraps"), 360 - F.col("ra_min") + F.col("ra_max")).otherwise(F.col("ra_max") - F.col("ra_min"))
    middle = bounds(cells, order, *keys).select(*keys, F.pmod(F.col("ra_min") + span / 2, F.lit(360.0)).alias("ra"), ((F.col("dec_min") + F.col("dec_max")) / 2).alias("dec"))
    corners = cells.select(*keys, F.explode(hpx.boundaries(order, F.col("ipix"))).alias("c"))
    both = corners.join(middle, list(keys)) if keys else corners.join(F.broadcast(middle), F.lit(True))
    a, d = F.radians("ra"), F.radians("dec")
    dot = F.cos(d) * F.cos(a) * F.col("c.x") + F.cos(d) * F.sin(a) * F.col("c.y") + F.sin(d) * F.col("c.z")
    far = F.max(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))
    return both.groupBy(*keys, "ra", "dec").agg((far + slack).alias("radius_deg"))


def mean_cone(cells: DataFrame, order: int, slack: float = 0.1, most: float = 10.0) -> DataFrame:
    """The cone about the cells' mean direction that holds all corners and `slack` degrees more; beyond `most` degrees an error."""
    from skyweave.operators.region import cone

    centres = cells.select(hpx.pix2ang(order, F.col("ipix")).alias("c")).select("c.ra", "c.dec")
    middle = cone(centres).select("ra", "dec")
    corners = cells.select(F.explode(hpx.boundaries(order, F.col("ipix"))).alias("c"))
    a, d = F.radians("ra"), F.radians("dec")
    dot = F.cos(d) * F.cos(a) * F.col("c.x") + F.cos(d) * F.sin(a) * F.col("c.y") + F.sin(d) * F.col("c.z")
    far = F.max(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))) + slack
    wide = F.when(far > most, F.raise_error(F.lit(f"the region is wider than {most} degrees"))).otherwise(far)
    return corners.join(F.broadcast(middle), F.lit(True)).groupBy("ra", "dec").agg(wide.alias("radius_deg"))


def overlap(layers: DataFrame, surveys: list[str], most: int | None = None) -> DataFrame:
    """(order, ipix, component, region) of the finest order that all layers of all surveys publish where they overlap.

    `layers` (survey_id, layer_id, order, ipix). Orders above `most` are not asked for; where the finest has no overlap,
    coarser published ones are tried in turn, and no finer cell is ever made up.
    """
    chosen = layers.where(F.col("survey_id").isin(surveys))
    chosen = chosen if most is None else chosen.where(F.col("order") <= most)
    per = chosen.select("survey_id", "layer_id", "order").distinct()
    in_all = per.groupBy("survey_id", "order").agg(F.count("*").alias("n")).join(layers.where(F.col("survey_id").isin(surveys)).groupBy("survey_id").agg(F.count_distinct("layer_id").alias("layers")), "survey_id").where("n = layers")
    published = in_all.groupBy("order").agg(F.count("*").alias("s")).where(F.col("s") == len(set(surveys))).select("order")
    shared = chosen.join(F.broadcast(published), "order", "left_semi").groupBy("order", "ipix").agg(F.count_distinct("survey_id").alias("s")).where(F.col("s") == len(set(surveys)))
    order = shared.agg(F.max("order").alias("o")).first().o
    if order is None:
        return shared.select("order", "ipix", F.lit(None).cast("long").alias("component"), F.lit(None).cast("string").alias("region")).where(F.lit(False))
    found = regions(shared.where(F.col("order") == order).select("ipix"), order)
    return found.select(F.lit(order).cast("int").alias("order"), "ipix", "component", "region")


def limiting_layers(layers: DataFrame, surveys: list[str], order: int) -> DataFrame:
    """Layers that don't publish `order`, with the orders they do."""
    per = layers.where(F.col("survey_id").isin(surveys)).groupBy("layer_id").agg(F.collect_set("order").alias("orders"))
    return per.where(~F.array_contains("orders", order)).select("layer_id", F.array_join(F.array_sort("orders"), ",").alias("orders"))


class OverBudget(ValueError):
    """An answer of too many cells; `action` says what to do: zoom-or-reduce or reduce-selection."""

    def __init__(self, cells: int, limit: int, action: str):
        super().__init__(f"{cells} cells exceed the budget of {limit}: {action}")
        self.action = action


def strict_overlap(coverage: DataFrame, surveys: list[str], order: int, tiles: list[int] | None = None, budget: int | None = BUDGET) -> DataFrame:
    """(ipix, component, region) of the overlap at exactly `order`, of the regions that a view touches.

    `coverage` (survey_id, order, ipix) is native coverage. A view is at most 192 tiles, six orders coarser. The cells in
    view must fit the budget (else zoom or reduce), and so must the whole regions they belong to (else reduce). Without a
    budget, all shared cells are labelled and regions with a cell in view are given, however large they are.
    """
    shared = ranges.intersect_all(ranges.to_ranges(coverage.where(F.col("survey_id").isin(surveys)), order).select("survey_id", "lo", "hi"), "survey_id", len(set(surveys)))
    shared = materialize(shared, "shared")
    view = shared
    if tiles is not None:
        coarse = max(0, order - 6)
        if len(tiles) > 192 or any(not 0 <= t < hpx.cells(coarse) for t in tiles):
            raise ValueError(f"a view is at most 192 tiles of order {coarse}")
        scale = 4 ** (order - coarse)
        wanted = shared.sparkSession.createDataFrame([(t * scale, (t + 1) * scale) for t in sorted(set(tiles))], "lo long, hi long")
        view = ranges.intersect(shared, wanted)
    size = lambda df: df.agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).first().n or 0
    if budget is not None and (n := size(view)) > budget:
        raise OverBudget(n, budget, "zoom-or-reduce-selection")
    if tiles is None:
        return regions(ranges.expand(view), order, budget)
    if budget is None:
        labels = materialize(_labelled(ranges.expand(shared), order), "labels")
        seen = ranges.contained(labels, view).select("component").distinct()
        return _named(labels.join(seen, "component", "left_semi").select("ipix", "component"))
    # Regions grow beyond the view, ring by ring, over ranges: no more than the budget's cells are ever held.
    held = materialize(ranges.expand(view), "held")
    while True:
        beside = held.select(F.explode(hpx.neighbours4(order, F.col("ipix"))).alias("ipix")).distinct().join(held, "ipix", "left_anti")
        grown = materialize(held.union(ranges.contained(beside, shared)), "held")
        n, m = grown.count(), held.count()
        if n > budget:
            raise OverBudget(n, budget, "reduce-selection")
        if n == m:
            return regions(held, order, budget)
        held = grown


def details(found: DataFrame, layers: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of each region: its layers, sources, evidence files and common precision, one row a region and survey.

    `found` (ipix, region), `layers` (survey_id, layer_id, ipix), `sources` (layer_id, url), `evidence` (layer_id, file_id, prec).
    """
    touching = layers.join(found.select("ipix", "region"), "ipix").select("region", "survey_id", "layer_id").distinct()
    known = sources.groupBy("layer_id").agg(F.count_distinct("url").alias("urls"))
    files = evidence.groupBy("layer_id").agg(F.count_distinct("file_id").alias("files"), F.max(F.coalesce(*[F.when(F.col("prec") == p, F.lit(k)) for p, k in PRECISION.items()])).alias("rank"))
    both = touching.join(known, "layer_id", "left").join(files, "layer_id", "left")
    names = F.array(*[F.lit(p) for p in PRECISION])
    rank = F.max(F.coalesce("rank", F.lit(PRECISION["entrypoint-only"])))
    return both.groupBy("region", "survey_id").agg(F.array_join(F.array_sort(F.collect_set("layer_id")), ",").alias("layers"), F.coalesce(F.sum("urls"), F.lit(0)).alias("urls"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.element_at(names, (rank + 1).cast("int")).alias("prec"))
