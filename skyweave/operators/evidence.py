"""Scan evidence: coverage edges, files and their versions, download plans, their merging, ordering and paging.

An edge says that a file covers a cell for a layer. Precision is a lattice (PRECISION); cells of different orders are
never mixed, so a match is (order, ipix) throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import ranges
from skyweave.operators.catalogue import fold_precision, locator, public_url

#: The precision lattice, conservative last; edges of a lookup, and of one file.
PRECISION = {"exact": 0, "estimated": 1, "entrypoint-only": 2, "truncated": 3}
MOST_EDGES = 50_000
#: Rows of a part that edges are dealt into.
PART_ROWS = 1_000_000
KINDS = ("spatial-unit", "file", "entrypoint", "coverage-evidence")


def requested(edges: DataFrame, request: DataFrame, order: int, cell: str = "cell") -> DataFrame:
    """Edges at `order` or finer inside a requested cell, with ipix at the requested order and the stored cell kept.

    Of each layer only its coarsest stored order that answers is read; coarser edges never answer a finer request.
    """
    able = edges.where(F.col("ord") >= order)
    coarsest = able.groupBy("layer_id").agg(F.min("ord").alias("ord"))
    at = F.floor(F.col("ipix") / F.pow(F.lit(4.0), F.col("ord") - order)).cast("long")
    kept = able.join(coarsest, ["layer_id", "ord"], "left_semi").withColumns({"source_order": F.col("ord"), "source_ipix": F.col("ipix"), "request_cell": at})
    hit = kept.join(request.select(F.col(cell).alias("request_cell")).distinct(), "request_cell", "left_semi")
    return hit.withColumns({"ipix": F.col("request_cell"), "ord": F.lit(order)}).drop("request_cell")


def with_files(edges: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """Edges with their file's metadata: of the version they name if they name one, of the plain file otherwise."""
    facts = ["file_name", "size", "uri"]
    plain = files.select(F.col("file_id").alias("__file"), F.struct(*facts).alias("__plain"))
    named = versions.select(F.col("layer_id").alias("__layer"), F.col("file_id").alias("__named"), F.struct(*facts).alias("__version"))
    unnamed = F.col("observation_layer_id").isNull()
    both = edges.join(plain, unnamed & (F.col("file_id") == F.col("__file")), "left").join(named, (F.col("observation_layer_id") == F.col("__layer")) & (F.col("file_id") == F.col("__named")), "left")
    found = F.when(unnamed, F.col("__plain")).otherwise(F.col("__version"))
    return both.withColumn("__found", found).select(*edges.columns, *[F.col(f"__found.{c}").alias(c) for c in facts], F.col("__found").isNotNull().alias("has_metadata"))


def matches() -> Column:
    """The distinct matches of a group, sorted by layer, order and cell."""
    return F.array_sort(F.collect_set(F.struct("layer_id", "ord", "ipix", "prec")))


def file_groups(edges: DataFrame) -> DataFrame:
    """One row a file: its sorted distinct matches and how many edges gave them."""
    return edges.groupBy("file_id").agg(matches().alias("matches"), F.count("*").alias("edges"))


def file_plans(edges: DataFrame) -> DataFrame:
    """One row a file: its sorted distinct matches, and the common precision of its edges."""
    rank, back = fold_precision(PRECISION)
    return edges.groupBy("file_id").agg(matches().alias("matches"), F.max(rank).alias("rank")).select("file_id", "matches", back.alias("prec"))


def parts_of(rows: DataFrame, per: int = PART_ROWS) -> int:
    """Parts to deal rows into so that none has many more than `per`."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per))


def _agreed() -> list[Column]:
    """Aggregates over the versions that a file's edges name: whether there are several, what they agree on (null counts as a value), and where they differ."""
    named = F.col("observation_layer_id").isNotNull()
    value = lambda c: F.when(named, F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    same = lambda c: F.min(value(c)) == F.max(value(c))
    facts = ("file_name", "size", "uri")
    differ = F.lit(False)
    for c in facts:
        differ = differ | ~same(c)
    own = [F.when(same(c), F.max(F.when(named, F.col(c)))).alias(f"v_{c}") for c in facts]
    return [(F.min("observation_layer_id") != F.max("observation_layer_id")).alias("several"), *own, (~same("uri")).alias("uri_conflict"), differ.alias("conflict")]


def file_conflicts(joined: DataFrame) -> DataFrame:
    """Per file the metadata that all its versions agree on (null counts as a value), else null and a mark.

    Files whose versions name different places are not downloadable.
    """
    seen = joined.where("observation_layer_id is not null")
    out = seen.groupBy("file_id").agg(F.count_distinct("observation_layer_id").alias("versions"), *_agreed(), F.bool_and("has_metadata").alias("complete"))
    out = out.select("file_id", "versions", *[F.col(f"v_{c}").alias(c) for c in ("file_name", "size", "uri")], "uri_conflict", "conflict", "complete")
    return out.withColumn("downloadable", public_url(F.col("uri")).isNotNull() & ~F.col("uri_conflict"))


def download_plan(edges: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """The files of a lookup: metadata of the first edge (by id), matches, downloadable or not, conflicts and missing metadata.

    Edges are joined and grouped once; all that is asked of a file is one aggregate.
    """
    joined = with_files(edges, files, versions)
    both = joined.groupBy("file_id").agg(F.min_by(F.struct("file_name", "size", "uri"), "edge_id").alias("f"), matches().alias("matches"), F.bool_and("has_metadata").alias("complete"), *_agreed())
    several = F.coalesce(F.col("several"), F.lit(False))
    bad_uri = several & F.col("uri_conflict")
    return both.select(
        "file_id", F.when(several, F.col("v_file_name")).otherwise(F.col("f.file_name")).alias("file_name"), F.when(several, F.col("v_size")).otherwise(F.col("f.size")).alias("size"), F.when(~bad_uri, locator(F.col("f.uri"))).alias("uri"),
        (public_url(F.col("f.uri")).isNotNull() & ~bad_uri).alias("downloadable"), F.when(F.col("complete"), "complete").otherwise("missing").alias("metadata"), (several & F.col("conflict")).alias("conflict"), "matches",
    )


def folded(rows: DataFrame, *keys: str) -> DataFrame:
    """The common precision of each key's rows: the most conservative."""
    rank, back = fold_precision(PRECISION)
    return rows.groupBy(*keys).agg(F.max(rank).alias("rank")).select(*keys, back.alias("prec"))


def overlap_precision(rows: DataFrame, *keys: str) -> DataFrame:
    """truncated if any is; exact or estimated if all are at least that; else entrypoint-only."""
    has = lambda p: F.bool_or(F.col("prec") == p)
    return rows.groupBy(*keys).agg(F.when(has("truncated"), "truncated").when(has("entrypoint-only"), "entrypoint-only").when(has("estimated"), "estimated").otherwise("exact").alias("prec"))


def merge_plans(*plans: DataFrame, parts: int | None = None) -> DataFrame:
    """Plans of (file_id, size, prec, matches, truncated), earlier first, as one: later metadata, all matches, the conservative precision.

    Merging is associative, so batches may be merged in any grouping that keeps their order. Files are dealt into `parts`, if given.
    """
    every = None
    for k, p in enumerate(plans):
        p = p.select("file_id", "size", "prec", "matches", "truncated", F.lit(k).alias("turn"))
        every = p if every is None else every.unionByName(p)
    rank, back = fold_precision(PRECISION)
    every = every if parts is None else every.repartition(parts, "file_id")
    out = every.groupBy("file_id").agg(F.max_by("size", "turn").alias("size"), F.max(rank).alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"), F.bool_or("truncated").alias("truncated"))
    return out.select("file_id", "size", back.alias("prec"), "matches", "truncated")


def merge_access(uris: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Places of each unit's files merged by (file name or uri, band, type): the first uri wins, alternatives are gathered."""
    keyed = uris.withColumn("file", F.coalesce("file_name", "uri"))
    alternative = F.when(F.col("provider").isNotNull(), F.concat_ws(":", "provider", "uri"))
    return keyed.groupBy(unit, "file", "band", "access_type").agg(F.min_by("uri", "seq").alias("uri"), F.array_join(F.array_sort(F.collect_set(alternative)), ",").alias("alternatives"))


def connectors(files: DataFrame, runs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file_id, connector) by the scan run or frozen scope of each match; matches whose candidates disagree name none.

    `files` (file_id, layer_id, scan_run, scope_id, scope_sha, partitions), `runs` (layer_id, scan_run, connector),
    `scopes` (layer_id, scope_id, scope_sha, partitions, connector).
    """
    match = ["layer_id", "scan_run", "scope_id", "scope_sha", "partitions"]
    rows = files.select("file_id", *match).distinct()
    by_run = rows.join(runs, ["layer_id", "scan_run"]).select("file_id", *match, "connector")
    by_scope = rows.join(scopes, ["layer_id", "scope_id", "scope_sha", "partitions"]).select("file_id", *match, "connector")
    one = by_run.union(by_scope).groupBy("file_id", *match).agg(F.count_distinct("connector").alias("n"), F.max("connector").alias("connector")).where("n = 1")
    return one.select("file_id", "connector").distinct()


def natural_key(name: Column) -> Column:
    """A text whose plain order is the numeric-aware order of names: lower case, digit runs padded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 3, "0"), bare(p))).otherwise(p)), "")


def interleave(units: DataFrame, survey: str, key: str) -> DataFrame:
    """`units` with `turn`: rank by the integer `key` in the own survey. Ordered by turn and survey, every survey shows before any shows again."""
    return ranges.numbered(units, key, survey, name="turn").withColumn("turn", F.col("turn") + 1)


def fair_preview(units: DataFrame, survey: str, key: str, size: int = 6) -> DataFrame:
    """The first `size` units when surveys take turns; each task keeps `size` units of a survey and no more."""
    near = units.withColumn("turn", F.row_number().over(W.partitionBy(survey).orderBy(key))).where(F.col("turn") <= size)
    return near.withColumn("turn", F.col("turn").cast("long")).orderBy("turn", survey, key).limit(size)


def probe(edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` edges by (file, id), and whether more were there; a file cut in two is marked truncated.

    One row more than the limit is ever read.
    """
    rows = edges.orderBy("file_id", "edge_id").limit(limit + 1).withColumn("n", F.row_number().over(W.orderBy("file_id", "edge_id")))
    over = rows.where(F.col("n") == limit + 1).select(F.col("file_id").alias("cut"))
    shown = rows.where(F.col("n") <= limit).drop("n")
    marks = over.agg(F.max("cut").alias("cut"), (F.count("*") > 0).alias("more"))
    return shown.join(F.broadcast(marks), F.lit(True)).select(*shown.columns, F.col("more"), F.coalesce(F.col("file_id") == F.col("cut"), F.lit(False)).alias("file_truncated"))


def plan_items(units: DataFrame, files: DataFrame, entrypoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """All parts of a plan as (rank, kind, key, name): units, files, entrypoints, evidence; `name` orders each kind."""
    parts = (
        (units, F.concat(F.lit("unit:"), F.sha2(F.concat_ws(":", "layer_no", "unit_kind", "unit_id"), 256)), F.col("unit_id").cast("string")),
        (files, F.concat(F.lit("file:"), F.col("file_id").cast("string")), F.col("file_id").cast("string")),
        (entrypoints, F.concat(F.lit("entry:"), F.sha2(F.concat_ws("|", "kind", "layer_id", "url"), 256)), F.col("url")),
        (evidence, F.concat(F.lit("coverage:"), F.sha2(F.concat_ws(":", "layer_id", "ord"), 256)), F.col("layer_id").cast("string")),
    )
    out = None
    for k, (df, key, name) in enumerate(parts):
        part = df.select(F.lit(k).alias("rank"), F.lit(KINDS[k]).alias("kind"), key.alias("key"), natural_key(name).alias("name")).distinct()
        out = part if out is None else out.union(part)
    return out


def plan_page(items: DataFrame, seen: DataFrame, size: int, scope: str = "manifest") -> DataFrame:
    """The next `size` items that were not seen; scope is manifest, spatial-units or supporting-evidence."""
    own = {"manifest": F.lit(True), "spatial-units": F.col("rank") == 0, "supporting-evidence": F.col("rank") > 0}[scope]
    return items.where(own).join(seen.select("key").distinct(), "key", "left_anti").orderBy("rank", "name", "key").limit(size)


def aliases(partitions: DataFrame) -> DataFrame:
    """Each public scope's alias: the one with most committed partitions under one lock, of equals the smallest; and whether it is whole."""
    per = partitions.groupBy("scope_id", "alias_no").agg(F.sum(F.col("committed").cast("long")).alias("done"), F.count("*").alias("expected"), F.count_distinct("lock_sha").alias("locks"))
    best = per.where("locks = 1 and done > 0").groupBy("scope_id").agg(F.max_by(F.struct("alias_no", "done", "expected"), F.struct("done", (-F.col("alias_no")).alias("first"))).alias("a"))
    return best.select("scope_id", "a.alias_no", "a.done", "a.expected", (F.col("a.done") == F.col("a.expected")).alias("complete"))


def scope_completeness(partitions: DataFrame) -> DataFrame:
    """Committed and expected partitions of each scope, whether all are there, and whether one lock holds them."""
    return partitions.groupBy("scope_id").agg(F.count_distinct("partition_id").alias("expected"), F.count_distinct(F.when(F.col("committed"), F.col("partition_id"))).alias("committed"), (F.count_distinct("lock_sha") == 1).alias("one_lock")).withColumn("complete", (F.col("expected") == F.col("committed")) & F.col("one_lock"))


def layer_rollup(edges: DataFrame) -> DataFrame:
    """Edges, files, orders and runs of each layer; a single run or order shows only if there is just one."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    return edges.groupBy("layer_id").agg(F.count("*").alias("edges"), F.count_distinct("file_id").alias("files"), F.array_join(F.array_sort(F.collect_set("ord")), ",").alias("orders"), one("ord").alias("single_order"), one("scan_run").alias("single_run"))


def composite_cells(edges: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Distinct (layer, order, cell) and their edges. With counters (layer_id, edges), layers that lost cells are an error state."""
    cells = edges.groupBy("layer_id", "ord", "ipix").agg(F.count("*").alias("edges"))
    if counters is None:
        return cells
    per = cells.groupBy("layer_id").agg(F.count("*").alias("cells"), F.sum("edges").alias("found"))
    both = counters.select("layer_id", F.col("edges").alias("counted")).join(per, "layer_id", "left")
    state = F.when((F.col("counted") > 0) & F.col("cells").isNull(), "failed").when(F.col("counted") != F.coalesce("found", F.lit(0)), "incomplete").otherwise("committed")
    return both.select("layer_id", F.coalesce("cells", F.lit(0)).alias("cells"), state.alias("state"))


def source_layers(edges: DataFrame) -> DataFrame:
    """The distinct layers of each file, through its edges."""
    return edges.select("file_id", "layer_id").distinct()


def parents_of(cells: DataFrame, order: int, coarse: int) -> DataFrame:
    return cells.select(hpx.parent(F.col("cell"), order - coarse).alias("cell")).distinct()
