"""Native units (tiles, bricks, exposures): finding them for a region, merging their rows, checking their rosters, and building their index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.functions import hpx

#: Units of one lookup, and member rows of one hydration.
MOST_UNITS, MOST_MEMBERS = 50_000, 50_000


def cell_units(layers: DataFrame, geometries: DataFrame, memberships: DataFrame, request: DataFrame) -> DataFrame:
    """(layer_no, unit_id, cells) of units with a geometry that touches a requested cell; geometries are shared by layers."""
    near = geometries.join(request.select("cell").distinct(), "cell", "left_semi").select("geometry_key", "cell").distinct()
    # Units of the same geometries have the same cells, which are counted once a set of geometries, not once a unit.
    units = memberships.join(layers.select("layer_no"), "layer_no", "left_semi").groupBy("layer_no", "unit_id").agg(F.array_sort(F.collect_set("geometry_key")).alias("shape"))
    shapes = units.select("shape").distinct().select("shape", F.explode("shape").alias("geometry_key"))
    counted = shapes.join(near, "geometry_key").groupBy("shape").agg(F.count_distinct("cell").alias("cells"))
    return units.join(counted, "shape").select("layer_no", "unit_id", "cells")


def coarse_candidates(units: DataFrame, request: DataFrame) -> DataFrame:
    """Units whose coarse cell is requested."""
    return units.join(request.select(F.col("cell").alias("coarse_cell")).distinct(), "coarse_cell", "left_semi")


def in_ranges(units: DataFrame, request: DataFrame, order: int, stored: int = 8, block: int = 512) -> DataFrame:
    """Units whose inclusive range [first_ipix, last_ipix] at the stored order meets a requested cell at `order`.

    A coarser request widens to its range of stored cells, a finer one folds to the cell that holds it. Both sides are cut
    at blocks, so the join is an equi join; a unit answers once however many blocks it spans.
    """
    wide = 4 ** abs(stored - order)
    lo = F.col("cell") * wide if order <= stored else F.floor(F.col("cell") / wide)
    asked = request.select(lo.cast("long").alias("lo")).distinct().withColumn("hi", F.col("lo") + (wide - 1 if order <= stored else 0))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block)))
    a = units.withColumn("block", blocks("first_ipix", "last_ipix"))
    b = asked.withColumn("block", blocks("lo", "hi"))
    hit = (a["block"] == b["block"]) & (F.col("lo") <= F.col("last_ipix")) & (F.col("hi") >= F.col("first_ipix"))
    return a.join(b, hit, "left_semi").drop("block").distinct()


def capped_units(units: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` units by key; `truncated` on each says whether there were more."""
    rows = units.orderBy(key).limit(limit + 1)
    more = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy(key).limit(limit).join(F.broadcast(more), F.lit(True))


def scanned_files(units: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Units with the sorted names of the files that scans found for them (by unit), and their number; none is empty."""
    per = edges.select(F.col("layer_id").alias("unit_id"), "file_id").distinct().join(files.select("file_id", "file_name"), "file_id", "left")
    found = per.groupBy("unit_id").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce("file_name", F.concat(F.lit("?"), F.col("file_id").cast("string"))))), ","), 256).alias("names_sha256"))
    return units.join(found, "unit_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def observations(rows: DataFrame) -> DataFrame:
    """Rows of observations as one each: sets of instruments, bands, targets and cells, earliest start and latest end."""
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return rows.groupBy("obsid").agg(texts("instrument").alias("instruments"), texts("band").alias("bands"), texts("target").alias("targets"), F.count_distinct("ipix").alias("cells"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))


def merged_units(rows: DataFrame, order: int = 8, coarse: int = 4) -> DataFrame:
    """Rows of units as one each: their coarse cells, bands and places as sets, complete only if every row is."""
    cells = F.collect_set(hpx.parent(F.col("ipix"), order - coarse))
    bands = F.array_join(F.array_sort(F.collect_set("band")), ",")
    return rows.groupBy("unit_id").agg(F.size(cells).cast("long").alias("coarse_cells"), F.concat(F.lit(","), bands, F.lit(",")).alias("bands"), F.array_join(F.array_sort(F.collect_set("uri")), " ").alias("uris"), F.bool_and("complete").alias("complete"))


def units_by_tile(products: DataFrame) -> DataFrame:
    """Products of each tile as one unit: all places, public only if every product is."""
    return products.groupBy("coarse_cell").agg(F.array_join(F.array_sort(F.collect_set("uri")), " ").alias("uris"), F.bool_and("public").alias("public"), F.count("*").alias("products"))


def dedup_counts(rows: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """Rows read, kept (distinct contents), repeated records, and new variants of a known key."""
    digest = F.sha2(F.to_json(F.struct(*facts)), 256)
    kept = rows.select(key, digest.alias("h")).groupBy(key, "h").agg(F.count("*").alias("n"))
    per = kept.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("variants"))
    return per.agg(F.sum("n").alias("all_rows"), F.sum("variants").alias("kept"), F.sum(F.col("n") - F.col("variants")).alias("duplicate_records"), F.sum(F.col("variants") - 1).alias("duplicate_rows"))


def page_receipts(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Each band's pages by status, rows and distinct ids, with what is wrong: gaps in the pages, rows that differ from the
    receipts, ids that repeat on a page, ids that pages describe differently.

    `pages` (band, page, status, rows), `members` (band, page, name, geometry).
    """
    order = pages.groupBy("band").agg(F.sum((F.col("status") == 200).cast("long")).alias("pages_200"), F.sum((F.col("status") == 404).cast("long")).alias("pages_404"), (F.max("page") - F.min("page") + 1 - F.count_distinct("page")).alias("missing_pages"), F.sum("rows").alias("rows"))
    read = members.groupBy("band", "page").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))
    wrong = pages.join(read, ["band", "page"], "left").groupBy("band").agg(F.sum((F.col("rows") != F.coalesce("n", F.lit(0))).cast("long")).alias("bad_pages"), F.sum(F.coalesce(F.col("n") - F.col("names"), F.lit(0))).alias("repeats"))
    ids = members.groupBy("band", "name").agg((F.min("geometry") != F.max("geometry")).alias("differs")).groupBy("band").agg(F.count("*").alias("ids"), F.sum(F.col("differs").cast("long")).alias("conflicts"))
    return order.join(wrong, "band").join(ids, "band", "left").select("band", "pages_200", "pages_404", "missing_pages", "rows", "bad_pages", "repeats", F.coalesce("ids", F.lit(0)).alias("ids"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def sequence_faults(units: DataFrame, group: str, first: str = "first_ipix", last: str = "last_ipix", block: int = 256) -> DataFrame:
    """Inclusive ranges of each group in order, with how each follows the ones before: first, contiguous, gap or overlap.

    The farthest end before a range is that of the ranges before it in its block of `block` cells, or of the blocks before:
    rows are sorted inside a block alone, and of the blocks only their ends are.
    """
    placed = units.withColumn("__block", F.floor(F.col(first) / block))
    ends = placed.groupBy(group, "__block").agg(F.max(last).alias("end"))
    earlier = ends.select(group, "__block", F.max("end").over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)).alias("__earlier"))
    by = W.partitionBy(group, "__block").orderBy(first, last, "unit_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.greatest("__earlier", F.max(last).over(by))
    known = placed.join(earlier, [group, "__block"]).withColumn("__before", before)
    state = F.when(F.col("__before").isNull(), "first").when(F.col(first) <= F.col("__before"), "overlap").when(F.col(first) == F.col("__before") + 1, "contiguous").otherwise("gap")
    return known.select(group, "unit_id", state.alias("follows"))


def equal_counts(rows: DataFrame, key: str, locked: DataFrame) -> DataFrame:
    """Rows of each band beside the locked number, and whether they agree; bands of either side show."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    both = found.join(locked.select(key, F.col("n").alias("locked")), key, "full_outer")
    return both.select(key, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("locked", F.lit(0)).alias("locked"), F.col("found").eqNullSafe(F.col("locked")).alias("agrees"))


def usage(events: DataFrame) -> DataFrame:
    """Requests, errors and used units of each user; requests of unknown use are counted, not guessed."""
    known = F.col("units").isNotNull()
    return events.groupBy("user_id").agg(F.count("*").alias("requests"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.round(F.sum(F.when(known, F.col("units"))), 4).alias("units"), F.sum((~known).cast("long")).alias("unknown"))


def latest(events: DataFrame, most: int = 1000) -> DataFrame:
    """The last `most` events, as a ring of that size would hold."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def roster_check(rosters: DataFrame, grid: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Releases whose every brick stands in the grid with the same centre and bounds, and their bricks.

    `rosters` (release_id, unit_id, ra, dec, ra1, ra2, dec1, dec2; bounds may be null), `grid` (unit_id, ra, dec, ra1, ra2,
    dec1, dec2). One brick that is absent or differs drops its whole release. RA bounds may wrap.
    """
    names = ("ra", "dec", "ra1", "ra2", "dec1", "dec2")
    both = rosters.join(grid.select("unit_id", *[F.col(n).alias(f"g_{n}") for n in names]), "unit_id", "left")
    turn = lambda a, b: F.abs(F.pmod(F.col(a) - F.col(b) + 180, F.lit(360.0)) - 180)
    off = lambda n: turn(n, f"g_{n}") if n.startswith("ra") else F.abs(F.col(n) - F.col(f"g_{n}"))
    centre = (off("ra") <= tolerance) & (off("dec") <= tolerance)
    sides = F.col("ra1").isNull() | ((off("ra1") <= tolerance) & (off("ra2") <= tolerance) & (off("dec1") <= tolerance) & (off("dec2") <= tolerance))
    fits = F.col("g_ra").isNotNull() & centre & sides
    return both.groupBy("release_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("whole"), F.count("*").alias("bricks")).where("whole").select("release_id", "bricks")


def associate(targets: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(target, object_id) by normalised name or alias; names that lead to several objects are conflicts and give none."""
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", "")
    known = names.select(plain("name").alias("k"), "object_id").union(aliases.select(plain("name").alias("k"), "object_id")).distinct()
    one = known.groupBy("k").agg(F.count("*").alias("n"), F.max("object_id").alias("object_id"))
    found = targets.withColumn("k", plain("target")).join(one, "k", "left")
    return found.select("target", F.when(F.col("n") == 1, F.col("object_id")).alias("object_id"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "conflict").otherwise("matched").alias("state"))


def judged_rows(rows: DataFrame, excluded: dict[str, Column], breaks: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with the first reason that excludes each (null: none). A row that breaks the contract is an error when read."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(excluded.items())):
        reason = F.when(bad, name).otherwise(reason)
    for name, bad in (breaks or {}).items():
        reason = F.when(bad, F.raise_error(F.lit(f"row contract broken: {name}"))).otherwise(reason)
    return rows.withColumn("reason", reason)


def exclusion_counts(judged: DataFrame, *keys: str) -> DataFrame:
    return judged.groupBy(*keys, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def build_index(judged: DataFrame, key: str, facts: Sequence[str], cell: str = "ipix", order: int = 8, coarse: int = 4) -> tuple[DataFrame, DataFrame]:
    """(index, summary): accepted rows once each with their coarse cell, to be written by coarse cell; and what became of all rows."""
    good = judged.where("reason is null").withColumn("row_hash", F.sha2(F.to_json(F.struct(key, *facts)), 256))
    index = good.groupBy("row_hash").agg(F.first(F.struct(key, *facts)).alias("r")).select("row_hash", "r.*").withColumn("coarse_cell", hpx.parent(F.col(cell), order - coarse))
    kept = index.agg(F.count("*").alias("kept"), F.count_distinct(key).alias("units"), F.count_distinct("coarse_cell").alias("coarse_cells"))
    summary = judged.agg(F.count("*").alias("read"), F.sum(F.col("reason").isNotNull().cast("long")).alias("excluded")).join(F.broadcast(kept), F.lit(True))
    return index, summary.withColumn("duplicates", F.col("read") - F.col("excluded") - F.col("kept"))


def merge_delta(base: DataFrame, delta: DataFrame, geometries: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, geometries) of a base index with a delta's layers in place of those of the same alias.

    Memberships are (alias, unit_id, geometry_key), geometries (geometry_key, cell). The delta's geometry keys are
    prefixed, and geometries that no membership names any more go.
    """
    prefixed = lambda df: df.withColumn("geometry_key", F.concat(F.lit("delta:"), F.col("geometry_key")))
    kept = base.join(delta.select("alias").distinct(), "alias", "left_anti")
    out = kept.unionByName(prefixed(delta))
    live = out.select("geometry_key").distinct()
    return out, geometries.unionByName(prefixed(more)).join(live, "geometry_key", "left_semi")


def probes(bindings: DataFrame, units: DataFrame) -> DataFrame:
    """Of each binding (product_id, layer_no): its units, one unit to probe with (the smallest), and whether there is a gap."""
    found = units.groupBy("layer_no").agg(F.count("*").alias("units"), F.min("unit_id").alias("probe"))
    return bindings.join(found, "layer_no", "left").select("product_id", "layer_no", F.coalesce("units", F.lit(0)).alias("units"), "probe", F.col("units").isNull().alias("gap"))


def routed(routes: DataFrame, **indexes: DataFrame) -> DataFrame:
    """Units of each route's own index: `routes` (layer_no, route), every index (layer_no, unit_id)."""
    out = None
    for name, units in indexes.items():
        part = units.join(routes.where(F.col("route") == name).select("layer_no"), "layer_no", "left_semi").select(F.lit(name).alias("route"), "layer_no", "unit_id")
        out = part if out is None else out.union(part)
    return out.distinct()


def hydrate(units: DataFrame, members: DataFrame, limit: int = MOST_MEMBERS) -> DataFrame:
    """Member rows of matched units, up to `limit` in order of unit, observation and sequence; `truncated` says whether more are there."""
    own = members.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    rows = own.orderBy("unit_id", "obsid", "seq").limit(limit + 1)
    more = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy("unit_id", "obsid", "seq").limit(limit).join(F.broadcast(more), F.lit(True))


def path_cells(files: DataFrame, url: str, per: int = 100) -> DataFrame:
    """(url, grp, pixel, fault) of files stored by cell, .../grp/pixel...: fault names a path whose group isn't pixel / per, or a repeated pixel."""
    parts = files.select(url, F.regexp_extract(url, r"/(\d+)/(\d+)[^/]*$", 1).alias("g"), F.regexp_extract(url, r"/(\d+)/(\d+)[^/]*$", 2).alias("p")).where("g <> ''")
    rows = parts.select(url, F.col("g").cast("long").alias("grp"), F.col("p").cast("long").alias("pixel"))
    again = rows.groupBy("pixel").agg(F.count("*").alias("n")).where("n > 1").select("pixel", F.lit(True).alias("again"))
    both = rows.join(again, "pixel", "left")
    fault = F.when(F.col("grp") != F.floor(F.col("pixel") / per), "group").when(F.col("again"), "repeated")
    return both.select(url, "grp", "pixel", fault.alias("fault"))
