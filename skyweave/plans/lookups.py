"""Registered queries of the catalogue, scan evidence and native units over the sky views.

Each runs operators of the library; its oracle is written apart from them, over the same views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.operators import catalogue, evidence, ranges, units
from skyweave.plans import snapshots
from skyweave.plans.registry import query
from skyweave.plans.scratch import materialize
from skyweave.plans.views import sql, table, view
from skyweave.sources import text
from skyweave.streaming import activity, quotas

LAYERS, EDGES, FILES, VERSIONS, UNITS, MEMBERS, REQUEST, REQUEST8, PARTITIONS = (sql(n) for n in ("layers", "edges", "files", "versions", "units", "members", "request", "request8", "partitions"))


def _text(rows: str, *parts: str) -> Column:
    """An array of structs as one text."""
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), " ")


# Joins


@query(
    "jn_layer_registry",
    f"""SELECT *, CASE WHEN registered_name IS NULL THEN 'unregistered' WHEN index_id IS NULL THEN 'without-index' ELSE 'complete' END AS registration FROM (SELECT layer_id, (SELECT min(x.layer_id) FROM {LAYERS} x WHERE x.survey_id = l.survey_id AND x.release_id = l.release_id AND x.product_id = l.product_id AND x.layer_no % 4 <> 0) AS registered_name,
    (SELECT min(x.layer_id) FROM {LAYERS} x WHERE x.survey_id = l.survey_id AND x.release_id = l.release_id AND x.product_id = l.product_id AND x.layer_no % 5 = 0) AS index_id FROM {LAYERS} l)""",
)
def jn_layer_registry(spark, sf_dir):
    layers = view(spark, sf_dir, "layers")
    registry = layers.where("layer_no % 4 <> 0").groupBy(*catalogue.PRODUCT).agg(F.min("layer_id").alias("name"))
    bindings = layers.where("layer_no % 5 = 0").select(*catalogue.PRODUCT, F.col("layer_id").alias("index_id"))
    return catalogue.with_registry(layers.select("layer_id", *catalogue.PRODUCT), registry, bindings).select("layer_id", "registered_name", "index_id", "registration")


@query("jn_cell_units", f"SELECT layer_no, unit_id, count(*) AS cells FROM (SELECT DISTINCT m.layer_no, m.unit_id, g.coarse_cell FROM {UNITS} m, {UNITS} g WHERE m.unit_id % 40 = g.unit_id % 40 AND m.layer_no <> 3 AND g.coarse_cell IN (SELECT cell FROM {REQUEST})) GROUP BY ALL")
def jn_cell_units(spark, sf_dir):
    own = view(spark, sf_dir, "units").withColumn("geometry_key", F.concat(F.lit("g"), (F.col("unit_id") % 40).cast("string")))
    geometries = own.select("geometry_key", F.col("coarse_cell").alias("cell")).distinct()
    layers = own.select("layer_no").distinct().where("layer_no <> 3")
    return units.cell_units(layers, geometries, own.select("layer_no", "geometry_key", "unit_id"), view(spark, sf_dir, "request"))


@query("jn_coarse_semi", f"SELECT unit_id FROM {UNITS} u WHERE EXISTS (SELECT 1 FROM {REQUEST} r WHERE r.cell = u.coarse_cell)")
def jn_coarse_semi(spark, sf_dir):
    return units.coarse_candidates(view(spark, sf_dir, "units"), view(spark, sf_dir, "request")).select("unit_id")


@query(
    "jn_range_overlap",
    f"""SELECT DISTINCT 8 AS asked, unit_id FROM {UNITS} u, {REQUEST8} r WHERE r.cell BETWEEN u.first_ipix AND u.last_ipix
    UNION ALL SELECT DISTINCT 4, unit_id FROM {UNITS} u, {REQUEST} r WHERE r.cell % 7 = 0 AND CAST(floor(u.first_ipix / 256) AS BIGINT) <= r.cell AND r.cell <= CAST(floor(u.last_ipix / 256) AS BIGINT)
    UNION ALL SELECT DISTINCT 9, unit_id FROM {UNITS} u, {REQUEST8} r WHERE CAST(floor(r.cell / 4) AS BIGINT) BETWEEN u.first_ipix AND u.last_ipix""",
)
def jn_range_overlap(spark, sf_dir):
    own, fine = view(spark, sf_dir, "units"), view(spark, sf_dir, "request8")
    asked = {8: fine, 4: view(spark, sf_dir, "request").where("cell % 7 = 0"), 9: fine}
    parts = [units.in_ranges(own, request, order).select(F.lit(order).alias("asked"), "unit_id") for order, request in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])


REQUESTED = f"""(SELECT edge_id, layer_id, file_id, observation_layer_id, prec, 4 AS ord, CAST(floor(ipix / pow(4, ord - 4)) AS BIGINT) AS ipix, ord AS source_order, ipix AS source_ipix
  FROM {EDGES} e WHERE ord = (SELECT min(ord) FROM {EDGES} x WHERE x.layer_id = e.layer_id) AND CAST(floor(ipix / pow(4, ord - 4)) AS BIGINT) IN (SELECT cell FROM {REQUEST}))"""


def _requested(spark, sf_dir) -> DataFrame:
    return evidence.requested(view(spark, sf_dir, "edges"), view(spark, sf_dir, "request"), 4)


@query("jn_descendants", f"SELECT edge_id, layer_id, file_id, ord, ipix, source_order, source_ipix FROM {REQUESTED}")
def jn_descendants(spark, sf_dir):
    return _requested(spark, sf_dir).select("edge_id", "layer_id", "file_id", "ord", "ipix", "source_order", "source_ipix")


def _joined_sql(edges: str) -> str:
    pick = lambda c: f"CASE WHEN e.observation_layer_id IS NULL THEN f.{c} ELSE v.{c} END AS {c}"
    return f"""(SELECT e.*, {pick("file_name")}, {pick("size")}, {pick("uri")}, CASE WHEN e.observation_layer_id IS NULL THEN f.file_id IS NOT NULL ELSE v.file_id IS NOT NULL END AS has_metadata
      FROM {edges} e LEFT JOIN {FILES} f ON f.file_id = e.file_id LEFT JOIN {VERSIONS} v ON v.layer_id = e.observation_layer_id AND v.file_id = e.file_id)"""


@query("jn_edge_file", f"SELECT edge_id, file_name, size, uri, has_metadata FROM {_joined_sql(EDGES)}")
def jn_edge_file(spark, sf_dir):
    return evidence.with_files(*(view(spark, sf_dir, n) for n in ("edges", "files", "versions"))).select("edge_id", "file_name", "size", "uri", "has_metadata")


@query("jn_source_layers", f"SELECT file_id, layer_id FROM {EDGES} GROUP BY file_id, layer_id")
def jn_source_layers(spark, sf_dir):
    return evidence.source_layers(view(spark, sf_dir, "edges"))


@query(
    "jn_alias_resolution",
    f"""SELECT scope_id, alias_no, done, expected, done = expected AS complete FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY done DESC, alias_no) AS rn FROM
    (SELECT scope_id, alias_no, count(*) FILTER (committed) AS done, count(*) AS expected FROM {PARTITIONS} GROUP BY 1, 2 HAVING min(lock_sha) = max(lock_sha) AND bool_or(committed))) WHERE rn = 1""",
)
def jn_alias_resolution(spark, sf_dir):
    return evidence.aliases(view(spark, sf_dir, "partitions"))


@query(
    "jn_unit_scanned_files",
    f"""SELECT unit_id, count(file_id) AS files, CASE WHEN count(file_id) > 0 THEN sha256(string_agg(name, ',' ORDER BY name)) END AS names_sha256 FROM {UNITS} u
    LEFT JOIN (SELECT DISTINCT e.layer_id, e.file_id, coalesce(f.file_name, '?' || CAST(e.file_id AS VARCHAR)) AS name FROM {EDGES} e LEFT JOIN {FILES} f USING (file_id)) x ON x.layer_id = u.unit_id GROUP BY unit_id""",
)
def jn_unit_scanned_files(spark, sf_dir):
    return units.scanned_files(*(view(spark, sf_dir, n) for n in ("units", "edges", "files"))).select("unit_id", "files", "names_sha256")


@query(
    "jn_overlay_replace",
    f"""SELECT layer_no, weight, 'kept' AS origin FROM {LAYERS} WHERE layer_no % 3 <> 0 AND layer_no % 2 <> 0 UNION ALL SELECT layer_no, weight, 'kept-after-failure' FROM {LAYERS} WHERE layer_no % 3 <> 0 AND layer_no % 8 = 0
    UNION ALL SELECT layer_no, -weight, 'replaced' FROM {LAYERS} WHERE layer_no % 3 <> 0 AND layer_no % 2 = 0 AND layer_no % 8 <> 0 UNION ALL SELECT layer_no, -weight, 'added' FROM {LAYERS} WHERE layer_no % 6 = 0 AND layer_no % 8 <> 0""",
)
def jn_overlay_replace(spark, sf_dir):
    layers = view(spark, sf_dir, "layers").select("layer_no", "weight")
    new = layers.where("layer_no % 2 = 0").select("layer_no", (-F.col("weight")).alias("weight"), (F.col("layer_no") % 8 == 0).alias("failed"))
    return catalogue.upsert(layers.where("layer_no % 3 <> 0"), new, "layer_no")


@query(
    "jn_diff",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 7 = 0 OR (p_partkey % 3 = 0 AND p_size = 1) THEN 'modified' ELSE 'unchanged' END AS state,
    CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN '' ELSE concat_ws(',', CASE WHEN p_partkey % 3 = 0 AND p_size = 1 THEN 'p_brand' END, CASE WHEN p_partkey % 7 = 0 THEN 'p_size' END) END AS fields FROM part WHERE p_partkey % 55 <> 0""",
)
def jn_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    after = part.where("p_partkey % 11 <> 0").select("p_partkey", F.expr("case when p_partkey % 7 = 0 then p_size + 1 else p_size end").alias("p_size"), F.expr("case when p_partkey % 3 = 0 and p_size = 1 then null else p_brand end").alias("p_brand"))
    return catalogue.compare(part.where("p_partkey % 5 <> 0"), after, ["p_partkey"], ["p_size", "p_brand"])


@query("jn_archive_diff", f"SELECT file_id, CASE WHEN file_id % 50 = 0 THEN 'missing' ELSE 'changed' END AS state FROM {FILES} WHERE file_id % 50 = 0 OR file_id % 13 = 0 UNION ALL SELECT file_id + 100000000, 'extra' FROM {FILES} WHERE file_id % 50 = 0")
def jn_archive_diff(spark, sf_dir):
    remote = view(spark, sf_dir, "files").select("file_id", "size", F.md5("file_name").alias("sha"))
    local = remote.select((F.col("file_id") + F.when(F.col("file_id") % 50 == 0, 100_000_000).otherwise(0)).alias("file_id"), (F.col("size") + F.when(F.col("file_id") % 26 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("file_id") % 13 == 0, F.md5("sha")).otherwise(F.col("sha")).alias("sha"))
    return catalogue.archive_diff(remote, local, "file_id", "size", "sha")


_FOUND = f"(SELECT survey_id, product_id, max(status) AS status, count(*) AS n, min(layer_no) AS k FROM {LAYERS} GROUP BY 1, 2)"


@query(
    "jn_inventory_audit",
    f"""WITH p AS (SELECT * FROM {_FOUND}), c AS (SELECT * FROM p WHERE k % 7 <> 0), s AS (SELECT * FROM p WHERE k % 5 <> 0), f AS (SELECT * FROM p WHERE k % 3 <> 0)
    SELECT 'duplicate-footprint' AS rule, survey_id, product_id FROM f WHERE k % 4 = 0 UNION ALL SELECT 'source-unregistered', survey_id, product_id FROM s WHERE k % 7 = 0
    UNION ALL SELECT 'product-without-source', survey_id, product_id FROM c WHERE k % 5 = 0 UNION ALL SELECT 'footprint-without-source', survey_id, product_id FROM f WHERE k % 5 = 0
    UNION ALL SELECT 'incomplete-without-reason', survey_id, product_id FROM s WHERE status <> 'acquired' AND k % 2 = 0 UNION ALL SELECT 'acquired-with-reason', survey_id, product_id FROM s WHERE status = 'acquired' AND k % 2 = 1
    UNION ALL SELECT 'acquired-without-moc', survey_id, product_id FROM s WHERE status = 'acquired' AND (k % 3 = 0 OR k % 4 = 1) UNION ALL SELECT 'overview-claims-moc', survey_id, product_id FROM s WHERE status = 'overview_only' AND k % 3 <> 0 AND k % 4 <> 1""",
)
def jn_inventory_audit(spark, sf_dir):
    p = view(spark, sf_dir, "layers").groupBy("survey_id", "product_id").agg(F.max("status").alias("status"), F.min("layer_no").alias("k"))
    sources = p.where("k % 5 <> 0").withColumn("reason", F.expr("case when k % 2 = 1 then 'pending' end"))
    footprints = p.where("k % 3 <> 0").withColumn("quality", F.expr("case when k % 4 = 1 then 'official_overview' else 'moc' end"))
    footprints = footprints.union(footprints.where("k % 4 = 0"))
    return catalogue.audit(p.where("k % 7 <> 0"), sources, footprints, ["survey_id", "product_id"])


@query(
    "jn_connector_provenance",
    f"""SELECT DISTINCT file_id, connector FROM (SELECT file_id, CASE WHEN layer_id % 2 = 0 AND layer_id % 3 = 0 THEN CASE WHEN layer_id % 3 = layer_id % 4 THEN 'c0' END
    WHEN layer_id % 2 = 0 THEN 'c' || CAST(layer_id % 3 AS VARCHAR) WHEN layer_id % 3 = 0 THEN 'c' || CAST(layer_id % 4 AS VARCHAR) END AS connector FROM {EDGES}) WHERE connector IS NOT NULL""",
)
def jn_connector_provenance(spark, sf_dir):
    edges = view(spark, sf_dir, "edges").select("file_id", "layer_id", "scan_run", (F.col("layer_id") % 5).alias("scope_id"), F.lit("lock").alias("scope_sha"), F.lit(3).alias("partitions"))
    own = view(spark, sf_dir, "units").select(F.col("unit_id").alias("layer_id"))
    name = lambda n: F.concat(F.lit("c"), (F.col("layer_id") % n).cast("string"))
    runs = own.where("layer_id % 2 = 0").select("layer_id", (F.col("layer_id") % 7).alias("scan_run"), name(3).alias("connector"))
    scopes = own.where("layer_id % 3 = 0").select("layer_id", (F.col("layer_id") % 5).alias("scope_id"), F.lit("lock").alias("scope_sha"), F.lit(3).alias("partitions"), name(4).alias("connector"))
    return evidence.connectors(edges, runs, scopes)


@query("jn_survey_tree", f"SELECT n.survey_id, coalesce(t.tree, '') AS tree FROM (SELECT 's' || CAST(n_nationkey AS VARCHAR) AS survey_id FROM nation UNION ALL SELECT 's99') n LEFT JOIN (SELECT survey_id, string_agg(release_id || '=' || products, ';' ORDER BY release_id) AS tree FROM (SELECT survey_id, release_id, string_agg(DISTINCT product_id, ',' ORDER BY product_id) AS products FROM {LAYERS} GROUP BY 1, 2) GROUP BY 1) t USING (survey_id)")
def jn_survey_tree(spark, sf_dir):
    surveys = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("survey_id")).union(spark.createDataFrame([("s99",)], "survey_id string"))
    tree = catalogue.survey_tree(surveys, view(spark, sf_dir, "layers"))
    return tree.select("survey_id", F.array_join(F.transform("releases", lambda r: F.concat(r["release_id"], F.lit("="), F.array_join(r["products"], ","))), ";").alias("tree"))


@query(
    "jn_roster_geometry",
    """SELECT release_id, count(*) AS bricks FROM (SELECT 'r' || CAST(p_size AS VARCHAR) AS release_id, p_partkey FROM part) r GROUP BY release_id
    HAVING count(*) FILTER (p_partkey % 997 = 0 OR p_partkey % 1009 = 0 OR p_partkey % 1013 = 0) = 0""",
)
def jn_roster_geometry(spark, sf_dir):
    k = F.col("p_partkey")
    ra, dec = (k * 104729 % 3600000) / 10000.0, (k * 7919 % 1700000) / 10000.0 - 85.0
    bounds = {"ra": ra, "dec": dec, "ra1": F.pmod(ra - 0.1, F.lit(360.0)), "ra2": F.pmod(ra + 0.1, F.lit(360.0)), "dec1": dec - 0.1, "dec2": dec + 0.1}
    part = table(spark, sf_dir, "part")
    grid = part.where("p_partkey % 997 <> 0").select(k.alias("unit_id"), *[v.alias(n) for n, v in bounds.items()])
    moved = {**bounds, "ra": ra + F.when(k % 1009 == 0, 1e-5).otherwise(1e-9), "dec2": dec + 0.1 + F.when(k % 1013 == 0, 1e-5).otherwise(0.0)}
    rosters = part.select(F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("release_id"), k.alias("unit_id"), *[v.alias(n) for n, v in moved.items()])
    return units.roster_check(rosters, grid)


@query(
    "jn_ero_association",
    """SELECT 'Brand #' || CAST(k AS VARCHAR) AS target, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS object_id, CASE WHEN k % 10 = 0 THEN CASE WHEN k % 20 = 0 THEN 'unknown' ELSE 'conflict' END ELSE 'matched' END AS state FROM (SELECT DISTINCT p_size AS k FROM part)""",
)
def jn_ero_association(spark, sf_dir):
    k = table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct()
    name = F.concat(F.lit("BRAND-"), F.col("k").cast("string"))
    own = F.col("k").cast("string").alias("object_id")
    aliases = k.where("k % 10 = 0 and k % 20 <> 0").select(F.concat(F.lit("brand_"), F.col("k").cast("string")).alias("name"), F.lit("other").alias("object_id"))
    return units.associate(k.select(F.concat(F.lit("Brand #"), F.col("k").cast("string")).alias("target")), k.where("k % 20 <> 0").select(name.alias("name"), own), aliases)


# Aggregations


@query("agg_composite_cells", f"SELECT layer_id, count(*) AS cells, CASE WHEN layer_id % 4 = 1 THEN 'incomplete' ELSE 'committed' END AS state FROM (SELECT DISTINCT layer_id, ord, ipix FROM {EDGES}) GROUP BY layer_id UNION ALL SELECT -1, 0, 'failed'")
def agg_composite_cells(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    counters = edges.groupBy("layer_id").agg(F.count("*").alias("edges")).select("layer_id", (F.col("edges") + (F.col("layer_id") % 4 == 1).cast("int")).alias("edges"))
    return evidence.composite_cells(edges, counters.union(spark.createDataFrame([(-1, 5)], "layer_id long, edges long")))


@query("agg_layer_rollup", f"SELECT layer_id, count(*) AS edges, count(DISTINCT file_id) AS files, string_agg(DISTINCT CAST(ord AS VARCHAR), ',' ORDER BY CAST(ord AS VARCHAR)) AS orders, CASE WHEN min(ord) = max(ord) THEN min(ord) END AS single_order, CASE WHEN min(scan_run) = max(scan_run) THEN min(scan_run) END AS single_run FROM {EDGES} GROUP BY layer_id")
def agg_layer_rollup(spark, sf_dir):
    return evidence.layer_rollup(view(spark, sf_dir, "edges"))


@query("agg_scope_completeness", f"SELECT scope_id, count(*) AS expected, count(*) FILTER (committed) AS committed, min(lock_sha) = max(lock_sha) AS one_lock, bool_and(committed) AND min(lock_sha) = max(lock_sha) AS complete FROM {PARTITIONS} GROUP BY scope_id")
def agg_scope_completeness(spark, sf_dir):
    return evidence.scope_completeness(view(spark, sf_dir, "partitions"))


def _matches_sql(edges: str) -> str:
    return f"(SELECT file_id, string_agg(CAST(layer_id AS VARCHAR) || ':' || CAST(ord AS VARCHAR) || ':' || CAST(ipix AS VARCHAR) || ':' || prec, ' ' ORDER BY layer_id, ord, ipix, prec) AS matches FROM (SELECT DISTINCT file_id, layer_id, ord, ipix, prec FROM {edges}) GROUP BY file_id)"


@query("agg_file_group", f"SELECT file_id, matches, (SELECT count(*) FROM {EDGES} e WHERE e.file_id = m.file_id) AS edges FROM {_matches_sql(EDGES)} m")
def agg_file_group(spark, sf_dir):
    return evidence.file_groups(view(spark, sf_dir, "edges")).select("file_id", _text("matches", "layer_id", "ord", "ipix", "prec").alias("matches"), "edges")


def _conflict_sql(joined: str) -> str:
    one = lambda c: f"min(coalesce(CAST({c} AS VARCHAR), '-')) = max(coalesce(CAST({c} AS VARCHAR), '-'))"
    return f"""(SELECT file_id, count(DISTINCT observation_layer_id) AS versions, CASE WHEN {one("file_name")} THEN max(file_name) END AS file_name, CASE WHEN {one("size")} THEN max(size) END AS size, CASE WHEN {one("uri")} THEN max(uri) END AS uri, NOT ({one("uri")}) AS uri_conflict,
      NOT ({one("file_name")} AND {one("size")} AND {one("uri")}) AS conflict, bool_and(has_metadata) AS complete, {one("uri")} AND coalesce(max(uri) LIKE 'https://%', false) AS downloadable FROM {joined} WHERE observation_layer_id IS NOT NULL GROUP BY file_id)"""


@query("agg_file_conflict", f"SELECT * FROM {_conflict_sql(_joined_sql(EDGES))}")
def agg_file_conflict(spark, sf_dir):
    return evidence.file_conflicts(evidence.with_files(*(view(spark, sf_dir, n) for n in ("edges", "files", "versions"))))


PLAN = f"""(SELECT f.file_id, CASE WHEN several THEN c.file_name ELSE f.file_name END AS file_name, CASE WHEN several THEN c.size ELSE f.size END AS size, CASE WHEN several AND c.uri_conflict THEN NULL WHEN f.uri LIKE 'http://localhost%' THEN NULL ELSE f.uri END AS uri,
  coalesce(f.uri LIKE 'https://archive%', false) AND NOT (several AND c.uri_conflict) AS downloadable, CASE WHEN whole THEN 'complete' ELSE 'missing' END AS metadata, several AND c.conflict AS conflict, m.matches
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY edge_id) AS rn, bool_and(has_metadata) OVER (PARTITION BY file_id) AS whole FROM {_joined_sql(REQUESTED)}) WHERE rn = 1) f
  LEFT JOIN (SELECT *, versions > 1 AS more FROM {_conflict_sql(_joined_sql(REQUESTED))}) c ON c.file_id = f.file_id JOIN {_matches_sql(REQUESTED)} m ON m.file_id = f.file_id, LATERAL (SELECT coalesce(c.more, false) AS several))"""


def _plan(spark, sf_dir) -> DataFrame:
    return evidence.download_plan(_requested(spark, sf_dir), view(spark, sf_dir, "files"), view(spark, sf_dir, "versions"))


@query("q_download_plan", f"SELECT * REPLACE (coalesce(conflict, false) AS conflict) FROM {PLAN}")
def q_download_plan(spark, sf_dir):
    return _plan(spark, sf_dir).withColumn("matches", _text("matches", "layer_id", "ord", "ipix", "prec"))


@query(
    "q_reverse_lookup",
    f"""SELECT 'spatial-unit' AS kind, CAST(unit_id AS VARCHAR) AS id, survey_id, row_number() OVER (PARTITION BY survey_id ORDER BY unit_id) AS turn, NULL::BOOLEAN AS downloadable, NULL AS metadata, NULL AS matches
      FROM {UNITS} u WHERE EXISTS (SELECT 1 FROM {REQUEST} r WHERE r.cell * 256 <= u.last_ipix AND r.cell * 256 + 255 >= u.first_ipix)
    UNION ALL SELECT 'file', CAST(file_id AS VARCHAR), NULL, NULL, downloadable, metadata, matches FROM {PLAN}
    UNION ALL SELECT 'entrypoint', layer_id, survey_id, NULL, NULL, NULL, NULL FROM {LAYERS} WHERE prec = 'entrypoint-only' AND (layer_no * 2654435761) % 3072 IN (SELECT cell FROM {REQUEST})
    UNION ALL SELECT 'coverage-evidence', CAST(layer_id AS VARCHAR), NULL, NULL, NULL, NULL, CAST(count(DISTINCT ipix) AS VARCHAR) FROM {REQUESTED} GROUP BY layer_id""",
)
def q_reverse_lookup(spark, sf_dir):
    """Units, files, entrypoints and coverage of a region, each part found apart and put side by side."""
    request = view(spark, sf_dir, "request")
    edges = materialize(_requested(spark, sf_dir), "requested")
    found = evidence.interleave(units.in_ranges(view(spark, sf_dir, "units"), request, 4), "survey_id", "unit_id")
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        found.select(F.lit("spatial-unit").alias("kind"), F.col("unit_id").cast("string").alias("id"), "survey_id", "turn", none("boolean").alias("downloadable"), none("string").alias("metadata"), none("string").alias("matches")),
        evidence.download_plan(edges, view(spark, sf_dir, "files"), view(spark, sf_dir, "versions")).select(F.lit("file"), F.col("file_id").cast("string"), none("string"), none("long"), "downloadable", "metadata", _text("matches", "layer_id", "ord", "ipix", "prec")),
        view(spark, sf_dir, "layers").where("prec = 'entrypoint-only'").withColumn("cell", F.col("layer_no") * 2654435761 % 3072).join(request, "cell", "left_semi").select(F.lit("entrypoint"), "layer_id", "survey_id", none("long"), none("boolean"), none("string"), none("string")),
        edges.groupBy("layer_id").agg(F.count_distinct("ipix").alias("n")).select(F.lit("coverage-evidence"), F.col("layer_id").cast("string"), none("string"), none("long"), none("boolean"), none("string"), F.col("n").cast("string")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("agg_precision_fold", f"SELECT file_id, CASE WHEN bool_or(prec = 'truncated') THEN 'truncated' WHEN bool_or(prec = 'estimated') THEN 'estimated' ELSE 'exact' END AS prec, CASE WHEN bool_or(prec = 'truncated') THEN 'truncated' WHEN bool_and(prec = 'exact') THEN 'exact' ELSE 'estimated' END AS overlap FROM {EDGES} GROUP BY file_id")
def agg_precision_fold(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    return evidence.folded(edges, "file_id").join(evidence.overlap_precision(edges, "file_id").withColumnRenamed("prec", "overlap"), "file_id")


@query("agg_observation", f"SELECT obsid, string_agg(DISTINCT instrument, ', ' ORDER BY instrument) AS instruments, coalesce(string_agg(DISTINCT band, ', ' ORDER BY band), '') AS bands, string_agg(DISTINCT target, ', ' ORDER BY target) AS targets, count(DISTINCT ipix) AS cells, min(t_min) AS t_min, max(t_max) AS t_max FROM {MEMBERS} GROUP BY obsid")
def agg_observation(spark, sf_dir):
    return units.observations(view(spark, sf_dir, "members"))


@query("agg_unit_merge", f"SELECT unit_id, count(DISTINCT CAST(floor(ipix / 256) AS BIGINT)) AS coarse_cells, ',' || coalesce(string_agg(DISTINCT band, ',' ORDER BY band), '') || ',' AS bands, string_agg(DISTINCT uri, ' ' ORDER BY uri) AS uris, count(*) FILTER (NOT complete) = 0 AS complete FROM {MEMBERS} GROUP BY unit_id")
def agg_unit_merge(spark, sf_dir):
    return units.merged_units(view(spark, sf_dir, "members"))


@query("agg_units_by_tile", f"SELECT CAST(floor(ipix / 256) AS BIGINT) AS coarse_cell, string_agg(DISTINCT uri, ' ' ORDER BY uri) AS uris, min(CASE WHEN unit_id % 6 = 0 THEN 0 ELSE 1 END) = 1 AS public, count(*) AS products FROM {MEMBERS} GROUP BY 1")
def agg_units_by_tile(spark, sf_dir):
    return units.units_by_tile(view(spark, sf_dir, "members").select(F.floor(F.col("ipix") / 256).alias("coarse_cell"), "uri", (F.col("unit_id") % 6 != 0).alias("public")))


@query("agg_dedup_rows", "SELECT count(*) AS all_rows, count(DISTINCT (user_id, event_type)) AS kept, count(*) - count(DISTINCT (user_id, event_type)) AS duplicate_records, count(DISTINCT (user_id, event_type)) - count(DISTINCT user_id) AS duplicate_rows FROM events")
def agg_dedup_rows(spark, sf_dir):
    return units.dedup_counts(table(spark, sf_dir, "events"), "user_id", ["user_id", "event_type"])


_JUDGED = f"(SELECT *, layer_no % 3 <> 1 AS a, layer_no % 4 <> 0 AS b, layer_no % 5 < 3 AS c, layer_no % 7 < 3 AS d, layer_no % 6 <> 2 AS e FROM {LAYERS})"


@query(
    "agg_readiness",
    f"""SELECT survey_id, count(*) AS products, count(*) FILTER (lv = -1) AS needs_information, count(*) FILTER (lv = 0) AS l0, count(*) FILTER (lv = 1) AS l1, count(*) FILTER (lv = 2) AS l2, count(*) FILTER (lv = 3) AS l3, count(*) FILTER (lv >= 1) AS coverage, count(*) FILTER (lv >= 2) AS unit, count(*) FILTER (lv >= 3) AS file,
    CAST(sum(6 - a::INT - b::INT - c::INT - (c AND d)::INT - (layer_no % 8 = 0)::INT - e::INT) AS BIGINT) AS gaps, CASE WHEN count(DISTINCT prec) = 1 THEN max(prec) ELSE 'mixed' END AS prec
    FROM (SELECT *, CASE WHEN NOT a THEN -1 WHEN layer_no % 8 = 0 THEN 3 WHEN c AND d THEN 2 WHEN c THEN 1 ELSE 0 END AS lv FROM {_JUDGED}) GROUP BY survey_id""",
)
def agg_readiness(spark, sf_dir):
    k = F.col("layer_no")
    flags = {"traceable": k % 3 != 1, "input_locked": k % 4 != 0, "coverage": k % 5 < 3, "unit": k % 7 < 3, "file": k % 8 == 0, "validated": k % 6 != 2}
    return catalogue.readiness_rollup(catalogue.readiness(view(spark, sf_dir, "layers").withColumns(flags)), "survey_id")


@query("agg_counts_by_band", "SELECT event_type AS band, count(*) AS found, CASE event_type WHEN 'error' THEN 0 ELSE count(*) END AS locked, event_type <> 'error' AS agrees FROM events GROUP BY event_type UNION ALL SELECT 'X', 0, 7, false")
def agg_counts_by_band(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "band")
    locked = events.where("band <> 'error'").groupBy("band").agg(F.count("*").alias("n"))
    return units.equal_counts(events, "band", locked.union(spark.createDataFrame([("X", 7)], "band string, n long")))


_KIND = "CASE WHEN layer_no % 6 IN (0, 4) THEN 'imaging' WHEN layer_no % 6 IN (1, 2) THEN 'spectroscopy' WHEN layer_no % 6 = 3 THEN 'redshift' END"


@query("agg_release_projection", f"SELECT survey_id, release_id, coalesce(string_agg(DISTINCT {_KIND}, ',' ORDER BY {_KIND}), '') AS modalities, count(*) AS layers FROM {LAYERS} GROUP BY survey_id, release_id")
def agg_release_projection(spark, sf_dir):
    return catalogue.release_projection(view(spark, sf_dir, "layers"))


@query("agg_survey_modalities", f"SELECT survey_id, string_agg(kind, ',' ORDER BY first) AS modalities FROM (SELECT survey_id, {_KIND} AS kind, min(layer_no) AS first FROM {LAYERS} WHERE layer_no % 6 <> 5 GROUP BY 1, 2) GROUP BY survey_id")
def agg_survey_modalities(spark, sf_dir):
    return catalogue.survey_modalities(view(spark, sf_dir, "layers"), "layer_no")


@query(
    "agg_monitor",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'skipped' WHEN s_suppkey % 3 = 0 OR s_suppkey % 8 = 1 THEN 'failed' WHEN s_suppkey % 5 = 1 OR s_suppkey % 7 = 1 THEN 'drifted' ELSE 'unchanged' END AS state,
    CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 8 = 1 THEN '' ELSE concat_ws(',', CASE WHEN s_suppkey % 5 = 1 THEN 'moc-bytes' END, CASE WHEN s_suppkey % 7 = 1 THEN 'max-order' END) END AS drift,
    CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 3 = 0 OR s_suppkey % 8 = 1 OR s_suppkey % 5 = 1 OR s_suppkey % 7 = 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'a' || CAST(s_suppkey AS VARCHAR) END ELSE 'a' || CAST(s_suppkey AS VARCHAR) END AS good_sha,
    CAST(CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 3 = 0 OR s_suppkey % 8 = 1 OR s_suppkey % 5 = 1 OR s_suppkey % 7 = 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 10 END ELSE 10 END AS INTEGER) AS good_order,
    CASE WHEN s_suppkey % 10 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 8 = 1) THEN CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 ELSE 0 END + 1 ELSE 0 END AS failures,
    s_suppkey % 10 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 8 = 1) AND s_suppkey % 2 = 0 AND s_suppkey % 4 >= 2 AS alert FROM supplier""",
)
def agg_monitor(spark, sf_dir):
    k = F.col("id")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    sha = F.concat(F.lit("a"), k.cast("string"))
    sources = base.select("id", (k % 10 == 0).alias("skip"), sha.alias("sha"), F.lit(10).alias("max_order"))
    seen = base.where("id % 3 <> 0").select("id", F.when(k % 5 == 1, F.lit("b")).otherwise(sha).alias("sha"), F.when(k % 7 == 1, 9).otherwise(10).alias("max_order"), F.when(k % 8 == 1, "timeout").alias("error"))
    previous = base.where("id % 2 = 0").select("id", sha.alias("good_sha"), F.lit(10).alias("good_order"), (k % 4).alias("failures"))
    return catalogue.monitor(sources, seen, previous)


@query(
    "agg_page_receipts",
    """WITH m AS (SELECT l_returnflag AS band, l_suppkey AS page, l_partkey % 50 AS name, l_partkey % 50 + CASE WHEN l_partkey % 997 = 0 THEN 1 ELSE 0 END AS geometry FROM lineitem WHERE l_suppkey % 10 <> 0),
    p AS (SELECT b.band, s.s_suppkey AS page, CASE WHEN s.s_suppkey % 10 = 0 THEN 404 ELSE 200 END AS status, (SELECT count(*) FROM m WHERE m.band = b.band AND m.page = s.s_suppkey) + CASE WHEN s.s_suppkey % 6 = 1 THEN 1 ELSE 0 END AS rows FROM (SELECT DISTINCT l_returnflag AS band FROM lineitem) b, supplier s WHERE s.s_suppkey % 9 <> 5)
    SELECT band, count(*) FILTER (status = 200) AS pages_200, count(*) FILTER (status = 404) AS pages_404, max(page) - min(page) + 1 - count(*) AS missing_pages, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (page % 6 = 1) AS bad_pages,
    (SELECT CAST(count(*) - count(DISTINCT (page, name)) AS BIGINT) FROM m WHERE m.band = p.band AND m.page % 9 <> 5) AS repeats, (SELECT count(DISTINCT name) FROM m WHERE m.band = p.band) AS ids, (SELECT count(*) FROM (SELECT name FROM m WHERE m.band = p.band GROUP BY name HAVING count(DISTINCT geometry) > 1)) AS conflicts FROM p GROUP BY band""",
)
def agg_page_receipts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 <> 0")
    name = F.col("l_partkey") % 50
    members = lines.select(F.col("l_returnflag").alias("band"), F.col("l_suppkey").alias("page"), name.alias("name"), (name + (F.col("l_partkey") % 997 == 0).cast("int")).alias("geometry"))
    bands = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("band")).distinct()
    pages = bands.withColumn("page", F.explode(F.lit(table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 5").agg(F.collect_list("s_suppkey")).first()[0])))
    read = members.groupBy("band", "page").agg(F.count("*").alias("n"))
    pages = pages.join(read, ["band", "page"], "left").select("band", "page", F.when(F.col("page") % 10 == 0, 404).otherwise(200).alias("status"), (F.coalesce("n", F.lit(0)) + (F.col("page") % 6 == 1).cast("int")).alias("rows"))
    return units.page_receipts(pages, members)


@query("agg_usage_tally", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value) FILTER (event_id % 4 <> 0), 4) AS units, count(*) FILTER (event_id % 4 = 0) AS unknown FROM events GROUP BY user_id")
def agg_usage_tally(spark, sf_dir):
    return units.usage(table(spark, sf_dir, "events").withColumn("units", F.expr("case when event_id % 4 <> 0 then value end")))


@query("agg_usage_ring", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def agg_usage_ring(spark, sf_dir):
    return units.latest(table(spark, sf_dir, "events")).select("event_id")


@query("agg_order_summary", f"SELECT survey_id, release_id, max(least(max_order, 4)) AS overview_order, max(max_order) AS max_order, max(max_order) + 1 AS orders, count(DISTINCT product_id) AS products, count(*) FILTER (status = 'acquired') AS acquired FROM {LAYERS} GROUP BY 1, 2")
def agg_order_summary(spark, sf_dir):
    return catalogue.survey_index(view(spark, sf_dir, "layers")).select("survey_id", "release_id", "overview_order", "max_order", "orders", "products", "acquired")


@query("agg_sequence_checks", f"SELECT survey_id, unit_id, CASE WHEN b IS NULL THEN 'first' WHEN first_ipix <= b THEN 'overlap' WHEN first_ipix = b + 1 THEN 'contiguous' ELSE 'gap' END AS follows FROM (SELECT u.*, (SELECT max(v.last_ipix) FROM {UNITS} v WHERE v.survey_id = u.survey_id AND (v.first_ipix, v.last_ipix, v.unit_id) < (u.first_ipix, u.last_ipix, u.unit_id)) AS b FROM {UNITS} u)")
def agg_sequence_checks(spark, sf_dir):
    return units.sequence_faults(view(spark, sf_dir, "units"), "survey_id")


@query("agg_exclusion_counter", "SELECT event_type, CASE WHEN value IS NULL THEN 'missing' WHEN value < 5 THEN 'low' WHEN event_id % 13 = 0 THEN 'flagged' ELSE 'accepted' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def agg_exclusion_counter(spark, sf_dir):
    rules = {"missing": F.col("value").isNull(), "low": F.col("value") < 5, "flagged": F.col("event_id") % 13 == 0}
    return units.exclusion_counts(units.judged_rows(table(spark, sf_dir, "events"), rules, {"negative-id": F.col("event_id") < 0}), "event_type")


# Filters and projections


@query("flt_modality", f"SELECT layer_id, {_KIND} AS kind FROM {LAYERS} WHERE layer_no % 6 IN (0, 1, 2, 4)")
def flt_modality(spark, sf_dir):
    return catalogue.by_modality(view(spark, sf_dir, "layers"), ["Image", "spectra"]).select("layer_id", catalogue.modality(F.col("modality")).alias("kind"))


@query("flt_excluded", f"SELECT layer_id FROM {LAYERS} WHERE layer_no % 11 <> 0 AND layer_no % 13 <> 0 AND survey_id <> 's3' AND NOT regexp_matches(layer_id, '^s3(-.*)?$') AND layer_id <> 'l-7'")
def flt_excluded(spark, sf_dir):
    hit = catalogue.denied(F.col("survey_id"), F.col("layer_id"), ["s3"]) | catalogue.excluded(F.col("layer_id"), ["l-7"])
    return view(spark, sf_dir, "layers").where(~hit).select("layer_id")


@query("flt_denied", f"SELECT layer_id FROM {LAYERS} WHERE NOT (survey_id IN ('s3', 's7') OR layer_id LIKE 's3-%' OR layer_id LIKE 's7-%')")
def flt_denied(spark, sf_dir):
    return view(spark, sf_dir, "layers").where(~catalogue.denied(F.col("survey_id"), F.col("layer_id"), ["s3", "s7"])).select("layer_id")


@query("flt_warehouse_layers", f"SELECT layer_id FROM {LAYERS} WHERE layer_no % 7 <> 0 AND layer_no % 5 <> 0 AND layer_no % 11 <> 0 AND layer_no % 13 <> 0 AND layer_no % 2 = 0")
def flt_warehouse_layers(spark, sf_dir):
    layers = view(spark, sf_dir, "layers")
    return catalogue.warehouse_layers(layers, layers.where("layer_no % 2 = 0")).select("layer_id")


@query(
    "flt_selector",
    f"""SELECT unit_id, count(*) AS rows FROM {MEMBERS} WHERE unit_id % 3 IN (0, 1) AND band IN ('G', 'Z') AND (instrument = 'i1' OR instrument LIKE 'i1/%') AND target IN ('t0', 't1', 't2', 't3', 't4', 't5') AND CAST(unit_id AS VARCHAR) NOT LIKE 'q%' GROUP BY unit_id""",
)
def flt_selector(spark, sf_dir):
    rows = view(spark, sf_dir, "members").withColumns({"release_id": F.col("unit_id") % 3, "bands": F.array_compact(F.array("band")), "project": F.lit("Main")})
    return catalogue.selected(rows, releases=[0, 1], targets=[f"t{k}" for k in range(6)], bands=["g", "Z"], instrument="I1", project="main").groupBy("unit_id").agg(F.count("*").alias("rows"))


_URLS = """(SELECT s_suppkey AS k, CASE s_suppkey % 10 WHEN 0 THEN 'https://archive.example/a' WHEN 1 THEN 'http://user:pw@archive.example/a' WHEN 2 THEN 'http://localhost:8080/a' WHEN 3 THEN 'http://10.1.2.3/' WHEN 4 THEN 's3://bucket/key'
  WHEN 5 THEN 'file:///data/x' WHEN 6 THEN ' HTTPS://Archive.example/B ' WHEN 7 THEN 'http://minio.svc.cluster.local/x' WHEN 8 THEN 'ftp://archive.example/x' ELSE 'http://172.20.0.1:80/' END AS url FROM supplier)"""


@query("flt_public_url", f"SELECT k, CASE WHEN k % 10 IN (0, 6) THEN trim(url) END AS public_url, CASE WHEN k % 10 IN (0, 4, 5, 6) THEN trim(url) END AS locator FROM {_URLS}")
def flt_public_url(spark, sf_dir):
    urls = spark.sql(_URLS.replace("FROM supplier", "FROM {supplier}")[1:-1], supplier=table(spark, sf_dir, "supplier"))
    return urls.select("k", catalogue.public_url(F.col("url")).alias("public_url"), catalogue.locator(F.col("url")).alias("locator"))


@query(
    "flt_public_image",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0""",
)
def flt_public_image(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 5 == 0, "x1").otherwise(k.cast("string")).alias("obsid"), F.when(F.col("l_returnflag") == "R", "hst").otherwise("JWST").alias("collection"), F.when(F.col("l_linestatus") == "F", "Public").otherwise("EXCLUSIVE").alias("rights"), F.lit("IMAGE").alias("kind"), F.when(k % 7 != 0, "CIRCLE ICRS 1 1 1").alias("s_region"))
    return catalogue.public_images(rows).select("l_orderkey", "l_linenumber")


@query("flt_tile_nexp", "SELECT s_suppkey, 'https://archive.example/public/dr1/tiles/cumulative/' || CAST(s_suppkey AS VARCHAR) || '/2021' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 4, '0') || '/' AS url FROM supplier WHERE s_suppkey % 6 >= 2")
def flt_tile_nexp(spark, sf_dir):
    k = F.col("s_suppkey")
    tiles = table(spark, sf_dir, "supplier").withColumn("nexp", k % 6).where("nexp >= 2")
    url = catalogue.url_of("https://archive.example/public/{release}/tiles/cumulative/{tile}/{night}/", release=F.lit("dr1"), tile=k.cast("string"), night=F.concat(F.lit("2021"), F.lpad((k % 1000).cast("string"), 4, "0")))
    return tiles.select("s_suppkey", url.alias("url"))


@query("flt_rows_contract", f"SELECT CASE WHEN band IS NULL THEN 'no-band' WHEN t_min > 45 THEN 'late' WHEN target = 't3' THEN 'reserved-target' ELSE 'accepted' END AS reason, count(*) AS n FROM {MEMBERS} GROUP BY 1")
def flt_rows_contract(spark, sf_dir):
    rules = {"no-band": F.col("band").isNull(), "late": F.col("t_min") > 45, "reserved-target": F.col("target") == "t3"}
    breaks = {"time-order": F.col("t_max") <= F.col("t_min"), "cell": ~F.col("ipix").between(0, 786431)}
    return units.exclusion_counts(units.judged_rows(view(spark, sf_dir, "members"), rules, breaks))


@query("prj_url_rules", "SELECT o_orderkey, printf('https://archive.example/%s/%s/coadd-%08d.fits', lower(o_orderstatus), split_part(o_orderpriority, '-', 1), o_orderkey) AS url FROM orders")
def prj_url_rules(spark, sf_dir):
    url = catalogue.url_of("https://archive.example/{band}/{region}/coadd-{id}.fits", band=F.lower("o_orderstatus"), region=F.substring_index("o_orderpriority", "-", 1), id=F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))


@query(
    "prj_recipe_steps",
    """SELECT n_nationkey, CAST(pos AS INTEGER) - 1 AS step_no, step FROM (SELECT n_nationkey, generate_subscripts(s, 1) AS pos, unnest(s) AS step FROM (SELECT n_nationkey, string_split(CASE n_nationkey % 3 WHEN 0 THEN 'input,validate,project,union,outputs,evidence' WHEN 1 THEN 'input,filter,validate,normalize,outputs,evidence' ELSE 'input,filter,geometry,rasterize,union,outputs,evidence' END, ',') AS s FROM nation))""",
)
def prj_recipe_steps(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("native-moc"), F.lit("path-healpix"), F.lit("unheard-of")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return catalogue.recipe_steps(table(spark, sf_dir, "nation").select("n_nationkey", mode.alias("mode"))).select("n_nationkey", "step_no", "step")


@query("prj_product_id", f"SELECT DISTINCT survey_id, release_id, product_id, left(sha256(survey_id || chr(10) || release_id || chr(10) || product_id), 20) AS id, regexp_replace(lower(survey_id || ' & ' || product_id), '[^a-z0-9]+', '-', 'g') AS slug FROM {LAYERS}")
def prj_product_id(spark, sf_dir):
    rows = view(spark, sf_dir, "layers").select(*catalogue.PRODUCT).distinct()
    return rows.select("*", catalogue.product_id(*[F.col(c) for c in catalogue.PRODUCT]).alias("id"), catalogue.slug(F.concat(F.col("survey_id"), F.lit(" & "), F.col("product_id"))).alias("slug"))


@query(
    "prj_color",
    f"""WITH RECURSIVE h(layer_id, i, v) AS (SELECT layer_id, 0, 0::BIGINT FROM {LAYERS} UNION ALL SELECT layer_id, i + 1, (v * 31 + ascii(layer_id[i + 1])) % 4294967296 FROM h WHERE i < length(layer_id))
    SELECT layer_id, ['#1e857b', '#376b9b', '#a66a25', '#b64b3e', '#3b8054', '#7a5a9e', '#b27b2d', '#2b7887'][v % 8 + 1] AS color FROM h WHERE i = length(layer_id)""",
)
def prj_color(spark, sf_dir):
    return view(spark, sf_dir, "layers").select("layer_id", catalogue.color(F.col("layer_id")).alias("color"))


# Order, limits and pages


@query("srt_interleave", f"SELECT *, row_number() OVER (ORDER BY turn, survey_id) AS place FROM (SELECT survey_id, unit_id, count(*) OVER (PARTITION BY survey_id ORDER BY unit_id) AS turn FROM {UNITS})")
def srt_interleave(spark, sf_dir):
    turns = evidence.interleave(view(spark, sf_dir, "units"), "survey_id", "unit_id")
    # At most one unit a survey has each turn, so its place inside the turn is a small rank.
    rank = F.row_number().over(W.partitionBy("turn").orderBy("survey_id"))
    sizes = ranges.numbered(turns, "turn", per=1, name="any").groupBy("turn").agg(F.min("any").alias("start"))
    return turns.withColumn("rank", rank).join(sizes, "turn").select("survey_id", "unit_id", "turn", (F.col("start") + F.col("rank")).alias("place"))


@query("srt_natural", "SELECT n, row_number() OVER (ORDER BY prefix, CAST(digits AS BIGINT), n) AS place FROM (SELECT DISTINCT prefix || digits AS n, prefix, digits FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'tile-' WHEN 1 THEN 'brick' ELSE 'ccd_' END AS prefix, CAST(p_partkey AS VARCHAR) AS digits FROM part))")
def srt_natural(spark, sf_dir):
    k = table(spark, sf_dir, "part")
    name = F.concat(F.element_at(F.array(F.lit("tile-"), F.lit("brick"), F.lit("ccd_")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_partkey").cast("string"))
    rows = k.select(name.alias("n")).distinct().withColumn("k", evidence.natural_key(F.col("n")))
    # Names are placed inside their first letters, and those parts one behind another.
    part = F.substring("k", 1, 7)
    before = rows.groupBy(part.alias("part")).agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("m"))
    placed = rows.withColumn("part", part).withColumn("inside", F.row_number().over(W.partitionBy("part").orderBy("k")))
    return placed.join(F.broadcast(before), "part").select("n", (F.col("before") + F.col("inside")).alias("place"))


@query("prv_cap", f"SELECT survey_id, unit_id FROM (SELECT survey_id, unit_id, row_number() OVER (PARTITION BY survey_id ORDER BY unit_id) AS t FROM {UNITS}) ORDER BY t, survey_id, unit_id LIMIT 6")
def prv_cap(spark, sf_dir):
    return evidence.fair_preview(view(spark, sf_dir, "units"), "survey_id", "unit_id").select("survey_id", "unit_id")


@query("lim_probe", f"SELECT edge_id, file_id, (SELECT count(*) FROM {EDGES}) > 500 AS more, coalesce(file_id = (SELECT file_id FROM {EDGES} ORDER BY file_id, edge_id OFFSET 500 LIMIT 1), false) AS file_truncated FROM (SELECT * FROM {EDGES} ORDER BY file_id, edge_id LIMIT 500)")
def lim_probe(spark, sf_dir):
    return evidence.probe(view(spark, sf_dir, "edges"), 500).select("edge_id", "file_id", "more", "file_truncated")


@query("cap_units", f"SELECT unit_id, (SELECT count(*) FROM {UNITS}) > 50 AS truncated FROM {UNITS} ORDER BY unit_id LIMIT 50")
def cap_units(spark, sf_dir):
    return units.capped_units(view(spark, sf_dir, "units"), "unit_id", 50).select("unit_id", "truncated")


def _items(spark, sf_dir) -> DataFrame:
    layers = view(spark, sf_dir, "layers")
    entry = layers.where("prec = 'entrypoint-only'").select(F.lit("entrypoint").alias("kind"), "layer_id", F.concat(F.lit("https://archive.example/"), "layer_id").alias("url"))
    return evidence.plan_items(view(spark, sf_dir, "units"), view(spark, sf_dir, "files").where("file_id < 4000"), entry, view(spark, sf_dir, "edges").select("layer_id", F.lit(8).alias("ord")).distinct())


_KEYS = f"""(SELECT 0 AS rank, 'spatial-unit' AS kind, 'unit:' || sha256(CAST(layer_no AS VARCHAR) || ':' || unit_kind || ':' || CAST(unit_id AS VARCHAR)) AS key, unit_id AS n, '' AS s FROM {UNITS} UNION ALL SELECT 1, 'file', 'file:' || CAST(file_id AS VARCHAR), file_id, '' FROM {FILES} WHERE file_id < 4000
  UNION ALL SELECT 2, 'entrypoint', 'entry:' || sha256('entrypoint|' || layer_id || '|https://archive.example/' || layer_id), layer_no, regexp_replace(layer_id, '[0-9]+$', '') FROM {LAYERS} WHERE prec = 'entrypoint-only' UNION ALL SELECT DISTINCT 3, 'coverage-evidence', 'coverage:' || sha256(CAST(layer_id AS VARCHAR) || ':8'), layer_id, '' FROM {EDGES})"""


@query("pag_plan", f"SELECT kind, key FROM {_KEYS} WHERE NOT EXISTS (SELECT 1 FROM {FILES} f WHERE f.file_id % 4 = 0 AND key = 'file:' || CAST(f.file_id AS VARCHAR)) ORDER BY rank, s, n LIMIT 900")
def pag_plan(spark, sf_dir):
    seen = view(spark, sf_dir, "files").where("file_id % 4 = 0").select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("key"))
    return evidence.plan_page(_items(spark, sf_dir), seen, 900).select("kind", "key")


@query("pag_snapshot", f"SELECT kind, key FROM {_KEYS} WHERE rank > 0 ORDER BY rank, s, n LIMIT 300 OFFSET 200")
def pag_snapshot(spark, sf_dir):
    frozen = snapshots.freeze(_items(spark, sf_dir), ["rank", "name", "key"])
    return snapshots.page(frozen, 200, 300, F.col("rank") > 0).select("kind", "key")


@query("pag_footprints", f"SELECT unit_id FROM {UNITS} ORDER BY unit_id LIMIT 50 OFFSET 20")
def pag_footprints(spark, sf_dir):
    return ranges.numbered(view(spark, sf_dir, "units"), "unit_id").where("number >= 20 and number < 70").select("unit_id")


@query("src_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 250")
def src_keyset(spark, sf_dir):
    return text.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 250)


# Whole questions


_MERGED = f"(SELECT *, layer_id % 3 AS turn FROM {EDGES})"


@query(
    "q_plan_merge",
    f"""SELECT m.file_id, (SELECT max(turn) FROM {_MERGED} x WHERE x.file_id = m.file_id) * 10 + m.file_id % 10 AS size, CASE WHEN (SELECT bool_or(prec = 'truncated') FROM {EDGES} x WHERE x.file_id = m.file_id) THEN 'truncated' WHEN (SELECT bool_or(prec = 'estimated') FROM {EDGES} x WHERE x.file_id = m.file_id) THEN 'estimated' ELSE 'exact' END AS prec,
    m.matches, EXISTS (SELECT 1 FROM {_MERGED} x WHERE x.file_id = m.file_id AND turn = 2) AND m.file_id % 4 = 0 AS truncated FROM {_matches_sql(EDGES)} m""",
)
def q_plan_merge(spark, sf_dir):
    # Parts don't grow with the table, whatever number of them the session sets.
    edges = view(spark, sf_dir, "edges").select("file_id", "layer_id", "ord", "ipix", "prec")
    parts = evidence.parts_of(edges)
    edges = edges.repartition(parts, "file_id")

    def plan(turn: int) -> DataFrame:
        own = edges.where(F.col("layer_id") % 3 == turn)
        return evidence.file_plans(own).select("file_id", (F.lit(turn * 10) + F.col("file_id") % 10).alias("size"), "prec", "matches", (F.lit(turn == 2) & (F.col("file_id") % 4 == 0)).alias("truncated"))

    return evidence.merge_plans(*(plan(t) for t in range(3)), parts=parts).withColumn("matches", _text("matches", "layer_id", "ord", "ipix", "prec"))


_URIS = f"(SELECT unit_id, CASE WHEN band IS NOT NULL THEN target END AS file_name, uri, band, CASE WHEN obsid % 2 = 0 THEN 'http' END AS access_type, CASE WHEN seq > 1 THEN 'p' || CAST(seq % 3 AS VARCHAR) END AS provider, obsid * 8 + seq AS seq FROM {MEMBERS})"


@query("q_access_merge", f"SELECT unit_id, coalesce(file_name, uri) AS file, band, access_type, arg_min(uri, seq) AS uri, coalesce(string_agg(DISTINCT provider || ':' || uri, ',' ORDER BY provider || ':' || uri), '') AS alternatives FROM {_URIS} GROUP BY unit_id, coalesce(file_name, uri), band, access_type")
def q_access_merge(spark, sf_dir):
    m = view(spark, sf_dir, "members")
    rows = m.select("unit_id", F.expr("case when band is not null then target end").alias("file_name"), "uri", "band", F.expr("case when obsid % 2 = 0 then 'http' end").alias("access_type"), F.expr("case when seq > 1 then concat('p', cast(seq % 3 as string)) end").alias("provider"), (F.col("obsid") * 8 + F.col("seq")).alias("seq"))
    return evidence.merge_access(rows)


@query("q_native_units", f"SELECT DISTINCT 'tiles' AS route, layer_no, unit_id FROM {UNITS} WHERE layer_no IN (0, 2) AND coarse_cell IN (SELECT cell FROM {REQUEST}) UNION ALL SELECT DISTINCT 'survey' AS route, u.layer_no, u.unit_id FROM {UNITS} u JOIN {REQUEST} r ON r.cell BETWEEN floor(u.first_ipix / 256) AND floor(u.last_ipix / 256) WHERE layer_no IN (1, 3)")
def q_native_units(spark, sf_dir):
    own, request = view(spark, sf_dir, "units"), view(spark, sf_dir, "request")
    routes = spark.createDataFrame([(0, "tiles"), (1, "survey"), (2, "tiles"), (3, "survey")], "layer_no long, route string")
    return units.routed(routes, tiles=units.coarse_candidates(own, request), survey=units.in_ranges(own, request, 4))


@query("q_hydrate", f"SELECT unit_id, obsid, seq, (SELECT count(*) FROM {MEMBERS} m JOIN {UNITS} u USING (unit_id) WHERE u.coarse_cell IN (SELECT cell FROM {REQUEST})) > 700 AS truncated FROM {MEMBERS} m WHERE unit_id IN (SELECT unit_id FROM {UNITS} WHERE coarse_cell IN (SELECT cell FROM {REQUEST})) ORDER BY unit_id, obsid, seq LIMIT 700")
def q_hydrate(spark, sf_dir):
    found = units.coarse_candidates(view(spark, sf_dir, "units"), view(spark, sf_dir, "request"))
    return units.hydrate(found, view(spark, sf_dir, "members"), 700).select("unit_id", "obsid", "seq", "truncated")


@query("q_reverse_batched", f"SELECT file_id, min(ipix % 4) AS batch FROM {REQUESTED} GROUP BY file_id")
def q_reverse_batched(spark, sf_dir):
    """Batches of the request in turn, continued as often as a turn's keys ask for; a file is emitted by the first batch that finds it."""
    edges, request = view(spark, sf_dir, "edges"), view(spark, sf_dir, "request")
    find = lambda cells: evidence.requested(edges, cells, 4).select("file_id").distinct()
    batches, found, at = [request.where(F.col("cell") % 4 == k) for k in range(4)], None, 0
    while at is not None:
        found, at = snapshots.in_batches(find, batches, "file_id", found, at)
    return found


@query("q_path_healpix", f"SELECT 'https://archive.example/' || CAST(CASE WHEN k % 50 = 7 THEN k ELSE k // 100 END AS VARCHAR) || '/' || CAST(k AS VARCHAR) || '.fits' AS url, CASE WHEN k % 50 = 7 THEN k ELSE k // 100 END AS grp, k AS pixel, CASE WHEN k % 50 = 7 AND k <> k // 100 THEN 'group' WHEN k % 40 = 0 AND k > 0 THEN 'repeated' END AS fault FROM (SELECT CASE WHEN s_suppkey % 40 = 39 THEN s_suppkey + 1 ELSE s_suppkey END AS k FROM supplier) WHERE k <> (SELECT max(s_suppkey) FROM supplier) + 1")
def q_path_healpix(spark, sf_dir):
    top = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    k = table(spark, sf_dir, "supplier").select(F.expr("case when s_suppkey % 40 = 39 then s_suppkey + 1 else s_suppkey end").alias("k")).where(F.col("k") != top + 1)
    url = catalogue.url_of("https://archive.example/{group}/{pixel}.fits", group=F.expr("cast(case when k % 50 = 7 then k else k div 100 end as string)"), pixel=F.col("k").cast("string"))
    return units.path_cells(k.select(url.alias("url")), "url")


@query("q_unique_member", "SELECT user_id, ts FROM (SELECT user_id, max(ts) AS ts, max(value) AS v FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) = 1) WHERE v > 10")
def q_unique_member(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", F.date_trunc("hour", "ts")).alias("k"), "user_id", "ts", "value")
    return catalogue.unique_member(rows, "k", F.col("value") > 10).select("user_id", "ts")


@query("q_build_index", f"SELECT *, read - excluded - kept AS duplicates FROM (SELECT count(*) AS read, count(*) FILTER (band IS NULL OR t_min > 45) AS excluded, (SELECT count(*) FROM (SELECT DISTINCT unit_id, ipix, band FROM {MEMBERS} WHERE band IS NOT NULL AND t_min <= 45)) AS kept, count(DISTINCT unit_id) FILTER (band IS NOT NULL AND t_min <= 45) AS units, count(DISTINCT floor(ipix / 256)) FILTER (band IS NOT NULL AND t_min <= 45) AS coarse_cells FROM {MEMBERS})")
def q_build_index(spark, sf_dir):
    judged = units.judged_rows(view(spark, sf_dir, "members"), {"no-band": F.col("band").isNull(), "late": F.col("t_min") > 45})
    return units.build_index(judged, "unit_id", ["ipix", "band"])[1]


_BASE = f"(SELECT layer_no AS alias, unit_id, 'g' || CAST(unit_id % 50 AS VARCHAR) AS geometry_key FROM {UNITS})"


@query("q_build_delta", f"SELECT 'geometry' AS part, geometry_key AS a, cell AS b FROM (SELECT DISTINCT 'g' || CAST(unit_id % 50 AS VARCHAR) AS geometry_key, coarse_cell AS cell FROM {UNITS}) g WHERE EXISTS (SELECT 1 FROM {_BASE} m WHERE m.alias <> 2 AND m.geometry_key = g.geometry_key) UNION ALL SELECT 'geometry', 'delta:d' || CAST(unit_id AS VARCHAR), coarse_cell FROM {UNITS} WHERE layer_no = 2 AND unit_id % 3 = 0 UNION ALL SELECT 'member', geometry_key, unit_id FROM {_BASE} WHERE alias <> 2 UNION ALL SELECT 'member', 'delta:d' || CAST(unit_id AS VARCHAR), unit_id FROM {UNITS} WHERE layer_no = 2 AND unit_id % 3 = 0")
def q_build_delta(spark, sf_dir):
    own = view(spark, sf_dir, "units")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    base = own.select(F.col("layer_no").alias("alias"), "unit_id", text("g", F.col("unit_id") % 50).alias("geometry_key"))
    geometries = own.select(text("g", F.col("unit_id") % 50).alias("geometry_key"), F.col("coarse_cell").alias("cell")).distinct()
    new = own.where("layer_no = 2 and unit_id % 3 = 0")
    delta, more = new.select(F.col("layer_no").alias("alias"), "unit_id", text("d", F.col("unit_id")).alias("geometry_key")), new.select(text("d", F.col("unit_id")).alias("geometry_key"), F.col("coarse_cell").alias("cell"))
    members, shapes = units.merge_delta(base, delta, geometries, more)
    return shapes.select(F.lit("geometry").alias("part"), F.col("geometry_key").alias("a"), F.col("cell").alias("b")).union(members.select(F.lit("member"), "geometry_key", "unit_id"))


@query("q_verify_group", f"SELECT DISTINCT product_id, CAST(layer_no % 6 AS BIGINT) AS layer_no, (SELECT count(*) FROM {UNITS} u WHERE u.layer_no = l.layer_no % 6) AS units, (SELECT min(unit_id) FROM {UNITS} u WHERE u.layer_no = l.layer_no % 6) AS probe, l.layer_no % 6 > 3 AS gap FROM {LAYERS} l")
def q_verify_group(spark, sf_dir):
    bindings = view(spark, sf_dir, "layers").select("product_id", (F.col("layer_no") % 6).alias("layer_no")).distinct()
    return units.probes(bindings, view(spark, sf_dir, "units"))


@query("q_survey_index", f"SELECT survey_id, release_id, count(DISTINCT product_id) AS products, count(*) FILTER (status = 'acquired') AS acquired, count(*) FILTER (status = 'overview_only') AS overview_only, count(*) FILTER (status = 'awaiting_geometry') AS awaiting_geometry, count(*) FILTER (status = 'not_applicable') AS not_applicable, string_agg(DISTINCT coalesce({_KIND}, ''), ',' ORDER BY coalesce({_KIND}, '')) AS modalities, max(least(max_order, 4)) AS overview_order, max(max_order) AS max_order, max(max_order) + 1 AS orders FROM {LAYERS} GROUP BY 1, 2")
def q_survey_index(spark, sf_dir):
    return catalogue.survey_index(view(spark, sf_dir, "layers"))


@query("q_usage_quota", "SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS requests FROM events GROUP BY date_trunc('minute', ts), user_id")
def q_usage_quota(spark, sf_dir):
    return quotas.quota_windows(table(spark, sf_dir, "events"), 60).select(F.col("start").alias("minute"), "user_id", "requests")


_REQUESTS = "(SELECT event_id AS request_id, user_id, ts AS start, ts + to_seconds(event_id % 9000 - 20) AS stop, CASE WHEN event_id % 11 <> 0 THEN event_id * 31 % 14000 END AS units FROM events)"
_ACTIVE = f"(SELECT a.request_id, a.user_id, a.start, count(*) AS active FROM {_REQUESTS} a JOIN {_REQUESTS} b ON b.user_id = a.user_id AND b.start <= a.start AND (b.stop > a.start OR b.start = a.start) GROUP BY ALL)"


def _activity(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("request_id"), "user_id", F.col("ts").cast("timestamp").alias("start"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(k % 9000 - 20).cast("decimal(18,6)"))).alias("end"), F.when(k % 11 != 0, k * 31 % 14000).alias("units"))


@query("q_active_requests", f"SELECT user_id, request_id, active FROM {_ACTIVE}")
def q_active_requests(spark, sf_dir):
    """How many of a user's requests are active when each of them starts."""
    return activity.active_requests(_activity(spark, sf_dir)).select("user_id", "request_id", "active")


@query(
    "q_daily_quotas",
    f"""SELECT user_id, day, u.requests, u.units, u.units > 100000 AS over_units, peak_active, over_active FROM (SELECT user_id, CAST(start AS DATE) AS day, count(*) AS requests, CAST(sum(greatest(1, least(11000, coalesce(units, 11000)))) AS BIGINT) AS units FROM {_REQUESTS} GROUP BY 1, 2) u
    JOIN (SELECT user_id, CAST(start AS DATE) AS day, max(active) AS peak_active, count(*) FILTER (active > 2) AS over_active FROM {_ACTIVE} GROUP BY 1, 2) a USING (user_id, day)""",
)
def q_daily_quotas(spark, sf_dir):
    """Units and activity of every user and day, and whether they pass the quotas."""
    return activity.daily_quotas(_activity(spark, sf_dir)).withColumn("day", F.col("day").cast("date"))


@query("q_new_keys", f"SELECT session_id, key, page, overflow FROM (SELECT layer_id AS session_id, file_id AS key, min(page) AS page, false AS overflow, row_number() OVER (PARTITION BY layer_id ORDER BY min(page), file_id) AS n FROM (SELECT layer_id, file_id, edge_id % 6 AS page FROM {EDGES}) GROUP BY layer_id, file_id) WHERE n <= 300 UNION ALL SELECT session_id, NULL, page, true FROM (SELECT layer_id AS session_id, min(page) AS page, row_number() OVER (PARTITION BY layer_id ORDER BY min(page), file_id) AS n FROM (SELECT layer_id, file_id, edge_id % 6 AS page FROM {EDGES}) GROUP BY layer_id, file_id) WHERE n = 301")
def q_new_keys(spark, sf_dir):
    """The files that continued lookups of every layer give, page by page, with room for 300 keys a session."""
    pages = view(spark, sf_dir, "edges").select(F.col("layer_id").alias("session_id"), (F.col("edge_id") % 6).alias("page"), F.timestamp_seconds(F.col("edge_id") % 6 * 60).alias("ts"), F.col("file_id").alias("key"))
    return activity.new_keys(pages, most=300)
