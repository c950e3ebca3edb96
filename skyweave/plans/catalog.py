"""The sky engine's registered queries over the sky views, each with the DuckDB SQL that checks it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import depth, geometry, images, overlap, ranges, region
from skyweave.plans import contracts, indexes, lookups, pages, sources, views  # noqa: F401  (they register queries)
from skyweave.plans.registry import query

LAYERS = "(SELECT o_orderpriority AS survey_id, o_orderpriority || '/' || c_mktsegment AS layer_id, (o_orderkey * 2654435761) % 3072 AS ipix FROM orders JOIN customer ON o_custkey = c_custkey)"
RANGES = "(SELECT survey_id, lo, least(lo + 1 + k % 50, 786432) AS hi FROM (SELECT o_orderpriority AS survey_id, (o_orderkey * 2654435761) % 786432 AS lo, o_custkey AS k FROM orders))"
MIXED = "(SELECT survey_id, ord, CAST(floor(p / pow(4, 7 - ord)) AS BIGINT) AS ipix FROM (SELECT o_orderpriority AS survey_id, CAST(o_orderkey % 4 + 4 AS INTEGER) AS ord, (o_orderkey * 2654435761) % 196608 AS p FROM orders))"
OBJECTS = """(SELECT CASE WHEN event_id % 101 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS object_id,
  CASE WHEN event_id % 103 = 0 THEN 400e0 ELSE (event_id * 104729 % 3600000) / 10000e0 END AS ra, (event_id * 7368787 % 1800001) / 10000e0 - 90e0 AS dec,
  CASE WHEN event_id % 107 = 0 THEN NULL ELSE value / 280e0 END AS z, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS zwarn,
  CASE WHEN event_type = 'error' THEN 'STAR' ELSE 'GALAXY' END AS spectype, CASE WHEN event_id % 109 = 0 THEN 'unknown' ELSE 'heliocentric' END AS frame, event_id AS source_row FROM events)"""


def _merged(source: str, key: str = "survey_id") -> str:
    """DuckDB: sorted disjoint ranges of each key of `source` (key, lo, hi)."""
    return f"""(SELECT {key}, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM
      (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS n FROM {source}))
      GROUP BY {key}, g)"""


def _pixel(order: int, ra: str = "ra", dec: str = "dec") -> str:
    """DuckDB: the cell of a direction."""
    n = 2**order
    bits = lambda v: " + ".join(f"(CAST(floor({v} / {2**i}) AS BIGINT) % 2) * {4**i}" for i in range(order + 1))
    return f"""(SELECT face * {4**order} + {bits("x")} + 2 * ({bits("y")}) FROM (
      SELECT CASE WHEN eq THEN CASE WHEN fp = fm THEN fp % 4 + 4 WHEN fp < fm THEN fp ELSE fm + 8 END WHEN z > 0 THEN q ELSE q + 8 END AS face,
             CASE WHEN eq THEN ((jm % {n}) + {n}) % {n} WHEN z > 0 THEN {n} - 1 - b ELSE a END AS x,
             CASE WHEN eq THEN {n} - 1 - ((jp % {n}) + {n}) % {n} WHEN z > 0 THEN {n} - 1 - a ELSE b END AS y
      FROM (SELECT *, abs(z) <= 2e0 / 3e0 AS eq, CAST(floor(jp / {n}e0) AS BIGINT) AS fp, CAST(floor(jm / {n}e0) AS BIGINT) AS fm,
                   least(CAST(floor((t - q) * r) AS BIGINT), {n} - 1) AS a, least(CAST(floor((1e0 - (t - q)) * r) AS BIGINT), {n} - 1) AS b
            FROM (SELECT *, CAST(floor({n}e0 * (0.5e0 + t) - 0.75e0 * {n}e0 * z) AS BIGINT) AS jp, CAST(floor({n}e0 * (0.5e0 + t) + 0.75e0 * {n}e0 * z) AS BIGINT) AS jm,
                         least(CAST(floor(t) AS BIGINT), 3) AS q, {n}e0 * sqrt(3e0 * (1e0 - abs(z))) AS r
                  FROM (SELECT sin(radians({dec})) AS z, {ra} / 90e0 AS t)))))"""


GOOD = "(SELECT *, CASE WHEN object_id = '' THEN 'missingIdentity' WHEN ra IS NULL OR dec IS NULL OR ra < 0 OR ra >= 360 OR abs(dec) > 90 THEN 'invalidCoordinate' WHEN z IS NULL THEN 'missingRedshift' WHEN z <= 0.001e0 THEN 'lowOrNegativeRedshift' WHEN z > 2 THEN 'outsideModelRange' WHEN zwarn <> 0 OR spectype <> 'GALAXY' THEN 'qualityOrClass' WHEN frame <> 'heliocentric' THEN 'unknownRedshiftFrame' END AS reason FROM " + OBJECTS + ")"


def _lattice(source: str, order: int, points: str) -> str:
    """DuckDB: (columns of source, k, z, phi) of points (k, dx, dy) of cells (ipix) at an order, by their place in the base faces."""
    n, area = 2**order, 4**order
    bits = lambda odd: " + ".join(f"((ipix % {area}) // {4**i * (2 if odd else 1)} % 2) * {2**i}" for i in range(order)) or "0"
    return f"""(SELECT * EXCLUDE (row, col, x, y, ring, cap), CASE WHEN ring < {n} THEN 1 - cap * cap / {3 * n * n}e0 WHEN ring > {3 * n} THEN cap * cap / {3 * n * n}e0 - 1 ELSE ({2 * n} - ring) * 2 / {3 * n}e0 END AS z,
      CASE WHEN cap = 0 THEN 0e0 ELSE ((2 * col + CASE WHEN row = 1 THEN 0 ELSE 1 END) * cap + x - y) / cap * pi() / 4 END AS phi
      FROM (SELECT *, CASE WHEN ring < {n} THEN ring WHEN ring > {3 * n} THEN {4 * n} - ring ELSE {n} END AS cap FROM (SELECT *, (row + 2) * {n} - x - y AS ring
      FROM (SELECT s.*, p.k, ipix // {area} // 4 AS row, ipix // {area} % 4 AS col, {bits(False)} + p.dx AS x, {bits(True)} + p.dy AS y FROM {source} s, (VALUES {points}) p(k, dx, dy)))))"""


def _centres(source: str, order: int) -> str:
    """DuckDB: source (ipix) with ra and dec of the cells' centres."""
    return f"(SELECT * EXCLUDE (k, z, phi), CASE WHEN phi < 0 THEN degrees(phi) + 360 ELSE degrees(phi) END AS ra, degrees(asin(z)) AS dec FROM {_lattice(source, order, '(0, 0.5e0, 0.5e0)')})"


def _corners(source: str, order: int) -> str:
    """DuckDB: source (ipix) with the corners of its cells, as unit vectors."""
    return f"(SELECT * EXCLUDE (phi), sqrt(greatest(0, 1 - z * z)) * cos(phi) AS x, sqrt(greatest(0, 1 - z * z)) * sin(phi) AS y FROM {_lattice(source, order, '(0, 1, 1), (1, 0, 1), (2, 0, 0), (3, 1, 0)')})"


#: DuckDB: cells of order 4 and those beyond their sides: two cells are neighbours if they have two corners in common.
_KEYED = f"(SELECT DISTINCT ipix, CAST(round(x * 1e7) AS BIGINT) AS a, CAST(round(y * 1e7) AS BIGINT) AS b, CAST(round(z * 1e7) AS BIGINT) AS c FROM {_corners('(SELECT unnest(range(3072)) AS ipix)', 4)})"
BESIDE = f"(SELECT p.ipix, q.ipix AS beside FROM {_KEYED} p JOIN {_KEYED} q USING (a, b, c) WHERE p.ipix <> q.ipix GROUP BY p.ipix, q.ipix HAVING count(*) = 2)"


def overlap_at(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    """Cells that all surveys cover at an order, with their area."""
    found = overlap.shared_cells(views.layer_cells(spark, sf_dir, order))
    return found.select("ipix", F.round(hpx.cell_area(order), 6).alias("area_deg2"))


SURVEYS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PUBLISHED = f"""(SELECT survey_id, layer_id, ord, CAST(floor(c / pow(4, 6 - ord)) AS BIGINT) AS ipix FROM (SELECT o_orderpriority AS survey_id, o_orderpriority || '/' || c_mktsegment AS layer_id, (o_orderkey * 2654435761) % 49152 AS c, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey),
  (SELECT unnest([2, 4, 6]) AS ord) WHERE ord < 6 OR m <> 'MACHINERY')"""
SHARED = f"(SELECT ord, ipix FROM {PUBLISHED} GROUP BY ord, ipix HAVING count(DISTINCT survey_id) = 5)"
BEST = f"(SELECT ord, ipix FROM {SHARED} WHERE ord IN (SELECT ord FROM {PUBLISHED} GROUP BY ord HAVING count(DISTINCT layer_id) = (SELECT count(DISTINCT layer_id) FROM {PUBLISHED})) AND ord = (SELECT max(ord) FROM {SHARED} WHERE ord < 6))"


@query("q_overlap", f'SELECT ord AS "order", ipix, round(41252.96124941927e0 / (12 * pow(4, ord)), 6) AS area_deg2 FROM {BEST}')
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest order that all layers publish and where all surveys overlap."""
    return overlap.overlap(views.published(spark, sf_dir), SURVEYS).select("order", "ipix", F.round(hpx.cell_area(F.col("order")), 6).alias("area_deg2"))


@query("q_limiting_layers", f"SELECT layer_id, '2,4' AS orders FROM {PUBLISHED} GROUP BY layer_id HAVING max(ord) < 6")
def q_limiting_layers(spark, sf_dir):
    return overlap.limiting_layers(views.published(spark, sf_dir), SURVEYS, 6)


STRICT = f"(SELECT c FROM (SELECT DISTINCT survey_id, CAST(floor(ipix / pow(4, greatest(ord - 5, 0))) AS BIGINT) * CAST(pow(4, greatest(5 - ord, 0)) AS BIGINT) + k AS c FROM {MIXED}, (SELECT unnest(range(4)) AS k) WHERE ord = 4 OR k = 0) WHERE survey_id IN ('1-URGENT', '5-LOW') GROUP BY c HAVING count(*) = 2)"


@query("q_overlap_strict", f"SELECT c AS ipix FROM {STRICT}")
def q_overlap_strict(spark, sf_dir):
    """Native coverage of two surveys at exactly one order, the whole sky in view."""
    return overlap.strict_overlap(views.mixed_cells(spark, sf_dir), ["1-URGENT", "5-LOW"], 5).select("ipix")


@query("q_overlap_view")
def q_overlap_view(spark, sf_dir):
    """The regions at order 7 that a view of four tiles touches, whole."""
    return overlap.strict_overlap(views.mixed_cells(spark, sf_dir), ["1-URGENT", "5-LOW"], 7, tiles=[3, 4, 17, 40], budget=None)


@query("agg_cells_union", f"SELECT DISTINCT survey_id, ipix FROM {LAYERS}")
def agg_cells_union(spark, sf_dir):
    return views.layer_cells(spark, sf_dir).select("survey_id", "ipix").distinct()


PAIR = f"(SELECT ipix FROM {LAYERS} WHERE survey_id IN ('1-URGENT', '2-HIGH') GROUP BY ipix HAVING count(DISTINCT survey_id) = 2)"


def _pair(spark, sf_dir):
    return overlap.shared_cells(views.layer_cells(spark, sf_dir), ["1-URGENT", "2-HIGH"])


@query("q_component_layers", f"SELECT DISTINCT survey_id, layer_id FROM {LAYERS} WHERE ipix IN (SELECT ipix FROM {PAIR})")
def q_component_layers(spark, sf_dir):
    return overlap.layers_of(views.layer_cells(spark, sf_dir), _pair(spark, sf_dir))


@query(
    "q_overlap_details",
    f"""SELECT 'all' AS region, l.survey_id, string_agg(layer_id, ',' ORDER BY layer_id) AS layers, CAST(sum(urls) AS BIGINT) AS urls, CAST(sum(files) AS BIGINT) AS files, CASE max(rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'estimated' WHEN 2 THEN 'entrypoint-only' ELSE 'truncated' END AS prec FROM (
    SELECT survey_id, layer_id, (SELECT count(DISTINCT n_name) FROM nation WHERE n_nationkey % 5 = length(layer_id) % 5) AS urls, CASE WHEN length(layer_id) % 2 = 0 THEN (SELECT count(*) FROM region) ELSE 0 END AS files, CASE WHEN length(layer_id) % 2 = 0 THEN 1 ELSE 2 END AS rank
    FROM (SELECT DISTINCT survey_id, layer_id FROM {LAYERS} WHERE ipix IN (SELECT ipix FROM {PAIR}))) l GROUP BY survey_id""",
)
def q_overlap_details(spark, sf_dir):
    cells = views.layer_cells(spark, sf_dir)
    known = cells.select("layer_id").distinct()
    nation, files = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    sources = known.join(nation, F.col("n_nationkey") % 5 == F.length("layer_id") % 5).select("layer_id", F.col("n_name").alias("url"))
    scans = known.where("length(layer_id) % 2 = 0").withColumn("file_id", F.explode(F.sequence(F.lit(1), F.lit(files.count())))).withColumn("prec", F.when(F.col("file_id") == 1, "estimated").otherwise("exact"))
    return overlap.details(_pair(spark, sf_dir).withColumn("region", F.lit("all")), cells, sources, scans)


@query("agg_highest_common_order", f"SELECT max(ord) AS \"order\" FROM (SELECT ord FROM {PUBLISHED} GROUP BY ord HAVING count(DISTINCT layer_id) = (SELECT count(DISTINCT layer_id) FROM {PUBLISHED}))")
def agg_highest_common_order(spark, sf_dir):
    return overlap.common_order(views.published(spark, sf_dir).select("survey_id", "layer_id", "order").distinct(), 5)


#: DuckDB: regions of the cells that two surveys share, by passing on the smallest cell.
_REGIONS = f"""(WITH RECURSIVE c AS (SELECT ipix FROM {PAIR}), e AS (SELECT b.ipix, b.beside FROM {BESIDE} b JOIN c ON c.ipix = b.ipix JOIN c d ON d.ipix = b.beside), r(ipix, component) AS (SELECT ipix, ipix FROM c UNION SELECT e.beside, r.component FROM r JOIN e ON e.ipix = r.ipix WHERE r.component < e.beside)
  SELECT ipix, component, printf('C%02d', dense_rank() OVER (ORDER BY component)) AS region FROM (SELECT ipix, min(component) AS component FROM r GROUP BY ipix))"""


@query("agg_components", f"SELECT * FROM {_REGIONS}")
def agg_components(spark, sf_dir):
    return overlap.regions(_pair(spark, sf_dir), 4)


_EDGES = f"(SELECT region, ipix, x, y, z, (degrees(atan2(y, x)) + 360) % 360 AS ra, degrees(asin(greatest(-1, least(1, z)))) AS dec FROM {_corners(_REGIONS, 4)})"
_GAPS = f"(SELECT *, row_number() OVER (PARTITION BY region ORDER BY gap DESC, ra) AS rn FROM (SELECT region, ra, coalesce(lead(ra) OVER w, first_value(ra) OVER w) AS nxt, coalesce(lead(ra) OVER w, first_value(ra) OVER w + 360) - ra AS gap FROM (SELECT DISTINCT region, round(ra, 9) AS ra FROM {_EDGES}) WINDOW w AS (PARTITION BY region ORDER BY ra)))"
_BOUNDS = f"(SELECT g.region, g.nxt AS ra_min, g.ra AS ra_max, g.nxt > g.ra AS ra_wraps, e.dec_min, e.dec_max, e.cells FROM {_GAPS} g JOIN (SELECT region, min(dec) AS dec_min, max(dec) AS dec_max, count(DISTINCT ipix) AS cells FROM {_EDGES} GROUP BY region) e ON e.region = g.region AND g.rn = 1)"


@query("agg_bounds", f"SELECT region, ra_wraps, round(dec_min, 6) + 0e0 AS dec_min, round(dec_max, 6) + 0e0 AS dec_max, cells, round(cells * 41252.96124941927e0 / 3072, 6) AS area_deg2, round(CASE WHEN ra_wraps THEN 360 - ra_min + ra_max ELSE ra_max - ra_min END, 6) AS span FROM {_BOUNDS}")
def agg_bounds(spark, sf_dir):
    """Bounds of every region."""
    found = overlap.bounds(overlap.regions(_pair(spark, sf_dir), 4), 4, "region")
    span = F.when(F.col("ra_wraps"), 360 - F.col("ra_min") + F.col("ra_max")).otherwise(F.col("ra_max") - F.col("ra_min"))
    return found.select("region", "ra_wraps", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("dec_min", "dec_max")], "cells", F.round("area_deg2", 6).alias("area_deg2"), F.round(span, 6).alias("span"))


_APART = lambda ra, dec, ra2, dec2: f"degrees(acos(greatest(-1e0, least(1e0, sin(radians({dec})) * sin(radians({dec2})) + cos(radians({dec})) * cos(radians({dec2})) * cos(radians({ra} - {ra2}))))))"
_MIDDLES = f"(SELECT region, (ra_min + CASE WHEN ra_wraps THEN 360 - ra_min + ra_max ELSE ra_max - ra_min END / 2) % 360 AS mra, (dec_min + dec_max) / 2 AS mdec FROM {_BOUNDS})"


@query("agg_cone", f"SELECT region, round(mra, 5) AS ra, round(mdec, 5) + 0e0 AS dec, round(max({_APART('e.ra', 'e.dec', 'mra', 'mdec')}) + 0.01e0, 5) AS radius_deg FROM {_MIDDLES} JOIN {_EDGES} e USING (region) GROUP BY region, mra, mdec")
def agg_cone(spark, sf_dir):
    """The cone of every region."""
    found = overlap.cones(overlap.regions(_pair(spark, sf_dir), 4), 4, "region")
    return found.select("region", F.round("ra", 5).alias("ra"), (F.round("dec", 5) + F.lit(0.0)).alias("dec"), F.round("radius_deg", 5).alias("radius_deg"))


@query("hpx_boundaries", f"SELECT ipix, CAST(k AS INTEGER) AS corner, round(x, 9) + 0e0 AS x, round(y, 9) + 0e0 AS y, round(z, 9) + 0e0 AS z FROM {_corners(f'(SELECT DISTINCT ipix FROM {LAYERS})', 4)}")
def hpx_boundaries(spark, sf_dir):
    cells = views.layer_cells(spark, sf_dir).select("ipix").distinct().select("ipix", F.posexplode(hpx.boundaries(4, F.col("ipix"))).alias("corner", "c"))
    return cells.select("ipix", "corner", *[(F.round(f"c.{n}", 9) + F.lit(0.0)).alias(n) for n in "xyz"])


@query("hpx_ang2pix", f"SELECT source_row, CASE WHEN ra < 360 THEN {_pixel(4)} END AS o4, CASE WHEN ra < 360 THEN {_pixel(8)} END AS o8 FROM {OBJECTS} o")
def hpx_ang2pix(spark, sf_dir):
    ra, dec = F.col("ra"), F.col("dec")
    return views.objects(spark, sf_dir).select("source_row", hpx.ang2pix(4, ra, dec).alias("o4"), hpx.ang2pix(8, ra, dec).alias("o8"))


@query("hpx_pix2ang", f"SELECT ipix, round(ra, 9) + 0e0 AS ra, round(dec, 9) + 0e0 AS dec FROM {_centres(f'(SELECT DISTINCT ipix FROM {LAYERS})', 4)}")
def hpx_pix2ang(spark, sf_dir):
    cells = views.layer_cells(spark, sf_dir).select("ipix").distinct().select("ipix", hpx.pix2ang(4, F.col("ipix")).alias("c"))
    return cells.select("ipix", *[(F.round(f"c.{n}", 9) + F.lit(0.0)).alias(n) for n in ("ra", "dec")])


@query("hpx_neighbours4", f"SELECT ipix, beside FROM {BESIDE} WHERE ipix IN (SELECT ipix FROM {LAYERS})")
def hpx_neighbours4(spark, sf_dir):
    return views.layer_cells(spark, sf_dir).select("ipix").distinct().select("ipix", F.explode(hpx.neighbours4(4, F.col("ipix"))).alias("beside"))


@query("cell_parent", f"SELECT DISTINCT ipix, CAST(floor(ipix / 16) AS BIGINT) AS o2 FROM {LAYERS}")
def cell_parent(spark, sf_dir):
    return views.layer_cells(spark, sf_dir).select("ipix", hpx.parent(F.col("ipix"), 2).alias("o2")).distinct()


@query("cell_children", f"SELECT ipix, unnest(range(ipix * 4, ipix * 4 + 4)) AS child FROM (SELECT DISTINCT ipix FROM {LAYERS})")
def cell_children(spark, sf_dir):
    return views.layer_cells(spark, sf_dir).select("ipix").distinct().select("ipix", F.explode(hpx.children(F.col("ipix"))).alias("child"))


@query("uniq_code", f"SELECT DISTINCT ord AS \"order\", ipix, CAST(pow(4, ord + 1) AS BIGINT) + ipix AS uniq, ord AS order_back, ipix AS ipix_back FROM {MIXED}")
def uniq_code(spark, sf_dir):
    cells = views.mixed_cells(spark, sf_dir).select("order", "ipix").distinct().withColumn("uniq", hpx.uniq_encode(F.col("order"), F.col("ipix")))
    order, ipix = hpx.uniq_decode(F.col("uniq"))
    return cells.select("order", "ipix", "uniq", order.alias("order_back"), ipix.alias("ipix_back"))


@query("cell_area", f"SELECT survey_id, round(sum(41252.96124941927e0 / (12 * pow(4, ord))), 4) AS area_deg2 FROM {MIXED} GROUP BY survey_id")
def cell_area(spark, sf_dir):
    return views.mixed_cells(spark, sf_dir).groupBy("survey_id").agg(F.round(F.sum(hpx.cell_area(F.col("order"))), 4).alias("area_deg2"))


@query("range_union", f"SELECT survey_id, lo, hi FROM {_merged(RANGES)}")
def range_union(spark, sf_dir):
    return ranges.union(views.survey_ranges(spark, sf_dir), "survey_id")


@query("moc_ranges", f"SELECT survey_id, lo, hi FROM {_merged(f'(SELECT survey_id, CAST(ipix * pow(4, 13 - ord) AS BIGINT) AS lo, CAST((ipix + 1) * pow(4, 13 - ord) AS BIGINT) AS hi FROM {MIXED})')}")
def moc_ranges(spark, sf_dir):
    return ranges.union(ranges.to_ranges(views.mixed_cells(spark, sf_dir)).select("survey_id", "lo", "hi"), "survey_id")


CELLS8 = f"(SELECT survey_id, unnest(range(lo, hi)) AS c FROM {_merged(RANGES)})"


@query("range_intersect_all", f"SELECT lo, hi FROM {_merged(f"""(SELECT 1 AS survey_id, c AS lo, c + 1 AS hi FROM {CELLS8} WHERE survey_id IN ('1-URGENT', '5-LOW') GROUP BY c HAVING count(DISTINCT survey_id) = 2)""")}")
def range_intersect_all(spark, sf_dir):
    both = views.survey_ranges(spark, sf_dir).where(F.col("survey_id").isin("1-URGENT", "5-LOW"))
    return ranges.intersect_all(both, "survey_id", 2)


@query("range_intersect", f"SELECT lo, hi FROM {_merged(f'''(SELECT 1 AS survey_id, c AS lo, c + 1 AS hi FROM {CELLS8} WHERE survey_id IN ('1-URGENT', '2-HIGH') GROUP BY c HAVING count(DISTINCT survey_id) = 2)''')}")
def range_intersect(spark, sf_dir):
    both = ranges.union(views.survey_ranges(spark, sf_dir), "survey_id")
    return ranges.intersect(*(both.where(F.col("survey_id") == s).select("lo", "hi") for s in ("1-URGENT", "2-HIGH")))


@query("range_contains", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey * 2654435761) % 786432 IN (SELECT c FROM {CELLS8} WHERE survey_id = '1-URGENT')")
def range_contains(spark, sf_dir):
    points = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * views.SCATTER % hpx.cells(8)).alias("ipix"))
    return ranges.contained(points, views.survey_ranges(spark, sf_dir).where("survey_id = '1-URGENT'")).select("l_orderkey", "l_linenumber")


@query("range_expand", f"SELECT survey_id, c AS ipix FROM {CELLS8}")
def range_expand(spark, sf_dir):
    return ranges.expand(ranges.union(views.survey_ranges(spark, sf_dir), "survey_id"))


@query("pag_cells", f"SELECT c AS ipix FROM (SELECT DISTINCT c FROM {CELLS8}) WHERE c >= 5000 ORDER BY c LIMIT 1000")
def pag_cells(spark, sf_dir):
    every = ranges.union(views.survey_ranges(spark, sf_dir).withColumn("one", F.lit(1)), "one").select("lo", "hi")
    return ranges.page(every, 5000, 1000)


PROJECTED = f"(SELECT DISTINCT survey_id, unnest(CASE WHEN ord <= 6 THEN range(CAST(ipix * pow(4, 6 - ord) AS BIGINT), CAST((ipix + 1) * pow(4, 6 - ord) AS BIGINT)) ELSE [CAST(floor(ipix / 4) AS BIGINT)] END) AS ipix FROM {MIXED})"


@query("moc_project", f"SELECT survey_id, ipix FROM {PROJECTED}")
def moc_project(spark, sf_dir):
    return ranges.project(views.mixed_cells(spark, sf_dir), 6, "survey_id")


@query("tile_ids", f"SELECT survey_id, array_to_string(list_sort(list(DISTINCT CAST(floor(ipix / 4096) AS BIGINT))), ',') AS tiles FROM {PROJECTED} GROUP BY survey_id")
def tile_ids(spark, sf_dir):
    return ranges.tiles(ranges.project(views.mixed_cells(spark, sf_dir), 6, "survey_id"), "survey_id").select("survey_id", F.array_join("tile_ids", ",").alias("tiles"))


@query("cover_block", f"SELECT survey_id, count(*) AS n, sha256(string_agg(CAST(ipix AS VARCHAR), ',' ORDER BY ipix)) AS sha256 FROM {PROJECTED} WHERE ipix >= 4096 AND ipix < 8192 GROUP BY survey_id")
def cover_block(spark, sf_dir):
    block = ranges.project(views.mixed_cells(spark, sf_dir), 6, "survey_id").where("ipix >= 4096 and ipix < 8192")
    return block.groupBy("survey_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("ipix")), ","), 256).alias("sha256"))


_COVERED8 = f"(SELECT DISTINCT survey_id, unnest(range(CAST(ipix * pow(4, 8 - ord) AS BIGINT), CAST((ipix + 1) * pow(4, 8 - ord) AS BIGINT))) AS c FROM {MIXED})"
_FULL = f"(SELECT survey_id, o, c // CAST(pow(4, 8 - o) AS BIGINT) AS ipix FROM {_COVERED8}, (SELECT unnest(range(4, 9)) AS o) GROUP BY ALL HAVING count(*) = pow(4, 8 - o))"
_MERGED13 = _merged(f"(SELECT survey_id, CAST(ipix * pow(4, 13 - ord) AS BIGINT) AS lo, CAST((ipix + 1) * pow(4, 13 - ord) AS BIGINT) AS hi FROM {MIXED})")
_BLOCKS13 = f"(SELECT survey_id, b, greatest(lo, b * 16384) AS lo, least(hi, (b + 1) * 16384) AS hi FROM (SELECT *, unnest(range(lo // 16384, (hi - 1) // 16384 + 1)) AS b FROM {_MERGED13}))"


@query("moc_canonical", f"SELECT survey_id, CAST(o AS INTEGER) AS \"order\", ipix FROM {_FULL} a WHERE NOT EXISTS (SELECT 1 FROM {_FULL} b WHERE b.survey_id = a.survey_id AND b.o = a.o - 1 AND b.ipix = a.ipix // 4)")
def moc_canonical(spark, sf_dir):
    return ranges.canonical(views.mixed_cells(spark, sf_dir), "survey_id", finest=8)


@query("moc_identity", f"SELECT survey_id, sha256('[' || string_agg('[' || CAST(lo AS VARCHAR) || ',' || CAST(hi AS VARCHAR) || ']', ',' ORDER BY lo) || ']') AS revision, CAST(sum(hi - lo) AS BIGINT) AS cells FROM {_MERGED13} GROUP BY survey_id")
def moc_identity(spark, sf_dir):
    return ranges.identity(views.mixed_cells(spark, sf_dir), "survey_id")


@query("moc_tree_identity", f"SELECT survey_id, sha256(string_agg(CAST(b AS VARCHAR) || ':' || d, ',' ORDER BY b)) AS revision FROM (SELECT survey_id, b, sha256(string_agg(CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR), ',' ORDER BY lo)) AS d FROM {_BLOCKS13} GROUP BY survey_id, b) GROUP BY survey_id")
def moc_tree_identity(spark, sf_dir):
    return ranges.tree_identity(views.mixed_cells(spark, sf_dir), "survey_id")


@query("moc_overlap_check", f"SELECT survey_id, count(*) AS faults FROM (SELECT survey_id, ord, ipix, row_number() OVER (PARTITION BY survey_id, ord, ipix) AS rn, EXISTS (SELECT 1 FROM {MIXED} b WHERE b.survey_id = a.survey_id AND b.ord < a.ord AND b.ipix = CAST(floor(a.ipix / pow(4, a.ord - b.ord)) AS BIGINT)) AS inside FROM {MIXED} a) WHERE rn > 1 OR inside GROUP BY survey_id")
def moc_overlap_check(spark, sf_dir):
    """Cells of each survey that repeat or lie inside another."""
    return ranges.overlapping_cells(views.mixed_cells(spark, sf_dir), "survey_id").groupBy("survey_id").agg(F.count("*").alias("faults"))


@query("moc_cap", f"SELECT survey_id, count(*) AS covered FROM (SELECT DISTINCT survey_id, CAST(floor(ipix / pow(4, greatest(ord - 5, 0))) AS BIGINT) * CAST(pow(4, greatest(5 - ord, 0)) AS BIGINT) + k AS c FROM {MIXED}, (SELECT unnest(range(4)) AS k) WHERE ord = 4 OR k = 0) GROUP BY survey_id")
def moc_cap(spark, sf_dir):
    """Cells capped at order 5, by the order-5 cells that they cover."""
    cells = ranges.capped(views.mixed_cells(spark, sf_dir), 5, "survey_id")
    return cells.groupBy("survey_id").agg(F.sum(F.when(F.col("order") == 4, 4).otherwise(1)).alias("covered"))


@query("moc_order_gate", f"SELECT survey_id, CAST(max(ord) AS INTEGER) AS max_order, false AS full_sky, max(ord) >= 5 AS public FROM {MIXED} WHERE ord < 5 OR survey_id > '2' GROUP BY survey_id")
def moc_order_gate(spark, sf_dir):
    return ranges.public_order_gate(views.mixed_cells(spark, sf_dir).where("order < 5 or survey_id > '2'"), "survey_id", least=5)


@query("moc_project_clip", f"SELECT survey_id, ipix, (SELECT count(*) FROM {{P}} x WHERE x.survey_id = p.survey_id AND x.ipix % 3 = 0 AND x.ipix < 9000) > 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY ipix) AS rn FROM {{P}} WHERE ipix % 3 = 0 AND ipix < 9000) p WHERE rn <= 500".replace("{P}", PROJECTED))
def moc_project_clip(spark, sf_dir):
    """Coverage at order 6 inside a region, 500 cells at most a survey."""
    wanted = spark.range(3000).select((F.col("id") * 3).alias("ipix"))
    return ranges.project_clipped(views.mixed_cells(spark, sf_dir), 6, wanted, 500, "survey_id").select("survey_id", "ipix", "truncated")


@query("tile_ranges", f"SELECT DISTINCT survey_id, t FROM (SELECT survey_id, CAST(floor(ipix / 1024) AS BIGINT) AS t FROM {PROJECTED})")
def tile_ranges(spark, sf_dir):
    """Tiles of 1,024 cells from ranges, shown one by one."""
    own = ranges.union(ranges.to_ranges(views.mixed_cells(spark, sf_dir), 6).select("survey_id", "lo", "hi"), "survey_id")
    return ranges.expand(ranges.tile_ranges(own, "survey_id", size=1024)).select("survey_id", F.col("ipix").alias("t"))


@query("q_projection_verify", f"SELECT survey_id, CAST(count(*) FILTER (ipix % 100 = 0) AS BIGINT) AS missing, CAST(count(*) FILTER (ipix % 100 = 1) AS BIGINT) AS extra FROM {PROJECTED} p GROUP BY survey_id HAVING count(*) FILTER (ipix % 100 <= 1) > 0")
def q_projection_verify(spark, sf_dir):
    """A claimed projection that lacks a cell in a hundred and doubles another, against the actual one."""
    actual = ranges.project(views.mixed_cells(spark, sf_dir), 6, "survey_id").withColumn("order", F.lit(6))
    claimed = actual.where("ipix % 100 <> 0").unionByName(actual.where("ipix % 100 = 1"))
    return ranges.same_cells(claimed, actual, "survey_id")


@query("q_public_projection", f"SELECT survey_id, CAST(4 AS INTEGER) AS \"order\", count(DISTINCT CAST(floor(ipix / 16) AS BIGINT)) AS cells FROM {PROJECTED} GROUP BY survey_id UNION ALL SELECT survey_id, 8, count(*) FROM (SELECT DISTINCT survey_id, unnest(range(CAST(ipix * pow(4, 8 - ord) AS BIGINT), CAST((ipix + 1) * pow(4, 8 - ord) AS BIGINT))) FROM {MIXED}) GROUP BY survey_id")
def q_public_projection(spark, sf_dir):
    """The overview and the order-8 cells of every survey."""
    cells = views.mixed_cells(spark, sf_dir)
    parts = [ranges.project(cells, o, "survey_id").groupBy("survey_id").agg(F.count("*").alias("cells")).select("survey_id", F.lit(o).alias("order"), "cells") for o in (4, 8)]
    return parts[0].union(parts[1])


@query(
    "agg_package_sidecar",
    f"""SELECT 'layer' AS part, layer_id AS name, 4 AS "order", count(DISTINCT ipix) AS cells FROM {PUBLISHED} WHERE ord = 4 GROUP BY layer_id UNION ALL SELECT 'survey', survey_id, 4, count(DISTINCT ipix) FROM {PUBLISHED} WHERE ord = 4 GROUP BY survey_id
    UNION ALL SELECT 'layer', layer_id, 6, count(DISTINCT ipix) FROM {PUBLISHED} WHERE ord = 6 GROUP BY layer_id UNION ALL SELECT 'survey', survey_id, 6, count(DISTINCT ipix) FROM {PUBLISHED} WHERE ord = 6 GROUP BY survey_id
    UNION ALL SELECT 'omitted', layer_id, 6, 0 FROM {PUBLISHED} GROUP BY layer_id HAVING max(ord) < 6""",
)
def agg_package_sidecar(spark, sf_dir):
    return ranges.sidecars(views.published(spark, sf_dir), (4, 6))


@query(
    "q_export_consistent",
    f"""SELECT survey_id, true AS same, 6 AS max_order, count(DISTINCT ipix) FILTER (ord = 6) AS cells FROM {PUBLISHED} GROUP BY survey_id""",
)
def q_export_consistent(spark, sf_dir):
    """Each survey's identity before and after an export, with what was written in between."""
    from skyweave.plans.scratch import materialize

    cells = views.published(spark, sf_dir).where("order = 6").select("survey_id", "order", "ipix").distinct()
    before = ranges.tree_identity(cells, "survey_id")
    written = materialize(ranges.canonical(cells, "survey_id", finest=6), "export")
    after = ranges.tree_identity(written, "survey_id").withColumnRenamed("revision", "again")
    held = ranges.project(written, 6, "survey_id").groupBy("survey_id").agg(F.count("*").alias("cells"))
    finest = cells.groupBy("survey_id").agg(F.max("order").alias("max_order"))
    return before.join(after, "survey_id").join(held, "survey_id").join(finest, "survey_id").select("survey_id", (F.col("revision") == F.col("again")).alias("same"), "max_order", "cells")


@query("q_healpix_list", f"SELECT c AS ipix FROM (SELECT DISTINCT CAST(floor(ipix / pow(4, greatest(ord - 5, 0))) AS BIGINT) * CAST(pow(4, greatest(5 - ord, 0)) AS BIGINT) + k AS c FROM {MIXED}, (SELECT unnest(range(4)) AS k) WHERE survey_id = '2-HIGH' AND (ord = 4 OR k = 0)) WHERE c >= 700 ORDER BY c LIMIT 1000")
def q_healpix_list(spark, sf_dir):
    return region.healpix_list(views.mixed_cells(spark, sf_dir).where("survey_id = '2-HIGH'").withColumn("layer_id", F.col("survey_id")), 5, start=700, size=1000)


@query("moc_fullsky", f"SELECT survey_id, count(*) = 49152 AS full_sky FROM {PROJECTED} GROUP BY survey_id")
def moc_fullsky(spark, sf_dir):
    return ranges.is_full_sky(views.mixed_cells(spark, sf_dir), "survey_id")


@query("layer_fold_match", f"SELECT DISTINCT r.ipix FROM (SELECT (o_orderkey * 2654435761) % 12288 AS ipix FROM orders) r JOIN (SELECT ipix FROM {LAYERS} WHERE survey_id = '1-URGENT') l ON CAST(floor(r.ipix / 4) AS BIGINT) = l.ipix")
def layer_fold_match(spark, sf_dir):
    request = views.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * views.SCATTER % hpx.cells(5)).alias("ipix")).distinct()
    return ranges.fold_match(request, views.layer_cells(spark, sf_dir).where("survey_id = '1-URGENT'"), 1)


@query("flt_quality", f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM {GOOD} GROUP BY 1")
def flt_quality(spark, sf_dir):
    return views.objects(spark, sf_dir).groupBy(F.coalesce(depth.reject_reason(), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def _good(spark, sf_dir):
    return views.objects(spark, sf_dir).where(depth.reject_reason().isNull())


@query("agg_dedup_ambiguous", f"SELECT object_id, min(source_row) AS source_row FROM (SELECT *, min(frame) OVER (PARTITION BY object_id) AS a, max(frame) OVER (PARTITION BY object_id) AS b FROM {GOOD} WHERE coalesce(reason, 'unknownRedshiftFrame') = 'unknownRedshiftFrame') WHERE a = b GROUP BY object_id")
def agg_dedup_ambiguous(spark, sf_dir):
    rows = views.objects(spark, sf_dir).where(F.coalesce(depth.reject_reason(), F.lit("unknownRedshiftFrame")) == "unknownRedshiftFrame")
    return depth.one_of_each(rows, "object_id", "frame").select("object_id", "source_row")


_VALUES = f"(SELECT {_pixel(4)} AS pixel, z FROM {GOOD} o WHERE reason IS NULL)"


@query("agg_voxel", f"SELECT pixel, least(greatest(CAST(floor((z - lo) / (hi - lo) * 64) AS INTEGER), 0), 63) AS bin, count(*) AS count, round(avg(z), 9) AS radial_mean FROM {_VALUES}, (SELECT min(z) AS lo, max(z) AS hi FROM {_VALUES}) GROUP BY 1, 2")
def agg_voxel(spark, sf_dir):
    return depth.voxels(_good(spark, sf_dir), 4, value="z").select("pixel", "bin", "count", F.round("radial_mean", 9).alias("radial_mean"))


@query("agg_cell_extent", f"SELECT pixel, max(z) AS radial_max, count(*) AS count FROM {_VALUES} GROUP BY pixel")
def agg_cell_extent(spark, sf_dir):
    return depth.extents(_good(spark, sf_dir), 4, "z")


@query("agg_top_cell", f"SELECT pixel, count(*) AS count FROM {_VALUES} GROUP BY pixel ORDER BY count DESC, pixel LIMIT 1")
def agg_top_cell(spark, sf_dir):
    return depth.densest(_good(spark, sf_dir))


_SLOW = lambda z: f"(1 / sqrt(0.30966e0 * pow(1 + {z}, 3) + 1 - 0.30966e0))"
_NODES = f"(SELECT k + 1 AS k, sum(299792.458e0 / 67.66e0 * 0.001953125e0 / 6 * ({_SLOW('k * 0.001953125e0')} + 4 * {_SLOW('(k + 0.5e0) * 0.001953125e0')} + {_SLOW('(k + 1) * 0.001953125e0')})) OVER (ORDER BY k) AS d FROM (SELECT unnest(range(1024)) AS k) UNION ALL SELECT 0, 0e0)"
_FAR = f"(SELECT o.*, a.d + (b.d - a.d) * (z / 0.001953125e0 - a.k) AS distance FROM {GOOD} o JOIN {_NODES} a ON a.k = least(CAST(floor(z / 0.001953125e0) AS BIGINT), 1023) JOIN {_NODES} b ON b.k = a.k + 1 WHERE reason IS NULL)"


def _at(z: str) -> str:
    """DuckDB: the distance of a redshift of o, null outside the nodes."""
    k = f"least(CAST(floor({z} / 0.001953125e0) AS BIGINT), 1023)"
    return f"(SELECT CASE WHEN {z} >= 0 AND {z} <= 2 THEN a.d + (b.d - a.d) * ({z} / 0.001953125e0 - a.k) END FROM {_NODES} a JOIN {_NODES} b ON b.k = a.k + 1 WHERE a.k = {k})"


_ERROR = "(CASE WHEN source_row % 4 = 3 THEN NULL WHEN source_row % 53 = 0 THEN -0.001e0 ELSE source_row % 7 / 100e0 END)"


@query("q_comoving", f"SELECT source_row, z, round(distance, 6) AS distance, round(({_at('(z + e)')} - {_at('(z - e)')}) / 2, 6) AS distance_error FROM (SELECT *, CASE WHEN {_ERROR} >= 0 THEN {_ERROR} END AS e FROM {_FAR}) o")
def q_comoving(spark, sf_dir):
    """Distances of accepted redshifts, and their errors where both ends of the redshift's error have a distance."""
    k = F.col("source_row")
    error = F.when(k % 4 == 3, F.lit(None)).when(k % 53 == 0, -0.001).otherwise(k % 7 / F.lit(100.0)).cast("double")
    out = depth.with_distance(_good(spark, sf_dir).withColumn("e", error), error="e")
    return out.select("source_row", "z", F.round("distance", 6).alias("distance"), F.round("distance_error", 6).alias("distance_error"))


_SELECTED = f"(SELECT *, {_pixel(2)} AS cell FROM {GOOD} o WHERE ra < 360)"
_CHOSEN = f"(SELECT * FROM (SELECT f.*, {_pixel(2)} AS p2, {_pixel(4)} AS p4, {_pixel(6)} AS p6 FROM {_FAR} f WHERE ra < 360) WHERE p2 % 2 = 0)"
_BINNED = f"(SELECT p2, p4, p6, least(CAST(floor((distance - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin FROM {_CHOSEN}, (SELECT min(distance) AS lo, max(distance) AS hi FROM {_CHOSEN}))"
_ORDER = f"(SELECT CASE WHEN count(DISTINCT (p6, bin)) <= 32768 THEN 6 WHEN count(DISTINCT (p4, bin)) <= 32768 THEN 4 WHEN count(DISTINCT (p2, bin)) <= 32768 THEN 2 END FROM {_BINNED})"


@query("q_sky_depth", f"SELECT count(*) AS objects, count(z) AS with_redshift, count(*) FILTER (reason IS NULL) AS with_distance, CASE WHEN count(*) FILTER (reason IS NULL) > 20000 THEN 'voxels' ELSE 'points' END AS status, CASE WHEN count(*) FILTER (reason IS NULL) > 20000 THEN any_value(o) END AS \"order\" FROM {_SELECTED}, (SELECT {_ORDER} AS o) WHERE cell % 2 = 0")
def q_sky_depth(spark, sf_dir):
    """What is known in half of the order-2 cells, and how it can be shown."""
    cells = spark.range(0, hpx.cells(2), 2).withColumnRenamed("id", "ipix")
    return depth.sky_depth(views.objects(spark, sf_dir).where("ra < 360"), 2, cells)[0]


@query("q_depth_voxels", f"SELECT {_pixel(4)} AS pixel, least(CAST(floor((distance - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS count, round(any_value(lo + least(floor((distance - lo) / (hi - lo) * 64), 63) * (hi - lo) / 64), 4) AS radial_min, round(avg(distance), 4) AS radial_mean FROM {_FAR} o, (SELECT min(distance) AS lo, max(distance) AS hi FROM {_FAR}) GROUP BY 1, 2")
def q_depth_voxels(spark, sf_dir):
    """Accepted objects' voxels by distance."""
    return depth.voxels(depth.with_distance(_good(spark, sf_dir)), 4).select("pixel", "bin", "count", F.round("radial_min", 4).alias("radial_min"), F.round("radial_mean", 4).alias("radial_mean"))


def _adaptive(selection: int, budget: int) -> str:
    """DuckDB: the finest order of selection + 4, + 2, + 0 whose voxels fit."""
    orders = list(dict.fromkeys(min(hpx.MAX_ORDER, selection + k) for k in (4, 2, 0)))
    cases = " ".join(f"WHEN count(DISTINCT (p{o}, bin)) <= {budget} THEN {o}" for o in orders)
    cells = ", ".join(f"{_pixel(o)} AS p{o}" for o in orders)
    return f"(SELECT {selection} AS selection_order, CASE {cases} END AS \"order\" FROM (SELECT *, least(CAST(floor((distance - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin FROM (SELECT distance, {cells} FROM {_FAR} o), (SELECT min(distance) AS lo, max(distance) AS hi FROM {_FAR})))"


_BUDGETS = ((0, 600), (1, 3000), (2, 32_768), (3, 600), (12, 600))


@query("agg_adaptive_order", " UNION ALL ".join(f"SELECT selection_order, CAST({budget} AS INTEGER) AS budget, CAST(\"order\" AS INTEGER) AS \"order\" FROM {_adaptive(o, budget)}" for o, budget in _BUDGETS))
def agg_adaptive_order(spark, sf_dir):
    points = depth.with_distance(_good(spark, sf_dir)).select("ra", "dec", "distance")
    return spark.createDataFrame([(o, budget, depth.adaptive_order(points, o, budget)) for o, budget in _BUDGETS], "selection_order int, budget int, order int")


def _discs(spark, sf_dir):
    k = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(k.alias("unit_id"), (k * 104729 % 3600000 / F.lit(10000.0)).alias("ra"), (k * 7368787 % 1800001 / F.lit(10000.0) - 90).alias("dec"), (k % 5 + F.lit(0.5)).alias("radius_deg"))


_SMALL = math.degrees(math.sqrt(4 * math.pi / hpx.cells(4))) / 4
_DISCS = "(SELECT s_suppkey AS unit_id, s_suppkey * 104729 % 3600000 / 10000e0 AS dra, s_suppkey * 7368787 % 1800001 / 10000e0 - 90 AS ddec, s_suppkey % 5 + 0.5e0 AS radius, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, c DOUBLE)[]) AS sides FROM supplier)"


def _cover(shapes: str, order: int, factor: int = 1) -> str:
    """DuckDB: (unit_id, ipix) of the cells at an order that may touch shapes (unit_id, dra, ddec, radius of the circle around each, and the
    inward normals of a polygon's sides): from the base cells down, small shapes from order 4 on, and `factor` times as fine for the last test."""

    def near(level: int) -> str:
        r = hpx.max_pixel_radius(level)
        beyond = f"[s FOR s IN sides IF s.a * cos(radians(dec)) * cos(radians(ra)) + s.b * cos(radians(dec)) * sin(radians(ra)) + s.c * sin(radians(dec)) < -{math.sin(math.radians(min(90.0, r)))}e0]"
        return f"{_APART('ra', 'dec', 'dra', 'ddec')} <= radius + {r}e0 AND len({beyond}) = 0"

    deep, start = factor.bit_length() - 1, min(order, 4)
    rows = f"(SELECT s.*, j AS ipix FROM {shapes} s, (SELECT unnest(range(12)) AS j) WHERE radius > {_SMALL}e0)"
    for level in range(order + deep + 1):
        if level:
            rows = f"(SELECT p.* REPLACE (p.ipix * 4 + j AS ipix) FROM {rows} p, (SELECT unnest(range(4)) AS j))"
        if level == start:
            every = _centres(f"(SELECT unnest(range({hpx.cells(level)})) AS ipix)", level)
            rows = f"(SELECT * FROM {rows} UNION ALL SELECT s.*, c.ipix FROM {shapes} s, {every} c WHERE radius <= {_SMALL}e0 AND abs(c.dec - s.ddec) <= radius + {hpx.max_pixel_radius(level) + 0.01}e0)"
        rows = f"(SELECT * EXCLUDE (ra, dec) FROM {_centres(rows, level)} WHERE {near(level)})"
    return f"(SELECT DISTINCT unit_id, ipix // {4**deep} AS ipix FROM {rows})"


def _polygons(source: str) -> str:
    """DuckDB: shapes as _cover() takes them, of convex polygons (unit_id, corners: a list of [ra, dec])."""
    vectors = f"(SELECT unit_id, [{{'x': cos(radians(p[2])) * cos(radians(p[1])), 'y': cos(radians(p[2])) * sin(radians(p[1])), 'z': sin(radians(p[2]))}} FOR p IN corners] AS v FROM {source})"
    summed = f"(SELECT *, list_sum([p.x FOR p IN v]) AS mx, list_sum([p.y FOR p IN v]) AS my, list_sum([p.z FOR p IN v]) AS mz FROM {vectors})"
    sided = f"(SELECT *, [{{'a': v[i].y * v[i % len(v) + 1].z - v[i].z * v[i % len(v) + 1].y, 'b': v[i].z * v[i % len(v) + 1].x - v[i].x * v[i % len(v) + 1].z, 'c': v[i].x * v[i % len(v) + 1].y - v[i].y * v[i % len(v) + 1].x}} FOR i IN range(1, len(v) + 1)] AS n, sqrt(mx * mx + my * my + mz * mz) AS size FROM {summed})"
    unit = "sign(s.a * mx + s.b * my + s.c * mz) / sqrt(s.a * s.a + s.b * s.b + s.c * s.c)"
    return f"(SELECT unit_id, degrees(atan2(my, mx)) AS dra, degrees(asin(mz / size)) AS ddec, list_max([degrees(acos(greatest(-1e0, least(1e0, (p.x * mx + p.y * my + p.z * mz) / size)))) FOR p IN v]) + 1e-9 AS radius, [{{'a': s.a * {unit}, 'b': s.b * {unit}, 'c': s.c * {unit}}} FOR s IN n] AS sides FROM {sided})"


@query("hpx_disc_incl", f"SELECT * FROM {_cover(_DISCS, 5, 4)}")
def hpx_disc_incl(spark, sf_dir):
    """Cells at order 5 that discs may touch, by the inclusive test of order 7."""
    return region.disc_cells(_discs(spark, sf_dir), 5, factor=4).select("unit_id", "ipix")


@query("jn_spatial_filter_refine", f"SELECT unit_id, count(*) AS cells FROM {_cover(_DISCS, 6)} WHERE ipix IN (SELECT p_partkey * 2654435761 % {hpx.cells(6)} FROM part) GROUP BY unit_id")
def jn_spatial_filter_refine(spark, sf_dir):
    request = views.table(spark, sf_dir, "part").select((F.col("p_partkey") * views.SCATTER % hpx.cells(6)).alias("ipix"))
    return region.units_touching(_discs(spark, sf_dir), request, 6)


_AT = "s_suppkey * 104729 % 3600000 / 10000e0 AS ra, s_suppkey * 7368787 % 1500001 / 10000e0 - 75 AS dec"
_CIRCLES = f"(SELECT unit_id, ra AS dra, dec AS ddec, unit_id % 5 / 2e0 AS radius, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, c DOUBLE)[]) AS sides FROM (SELECT s_suppkey AS unit_id, {_AT} FROM supplier) WHERE unit_id % 4 IN (0, 2))"
_BOXES = f"(SELECT unit_id, [[ra, dec], [ra + 2, dec], [ra + 2, dec + 2], [ra, dec + 2]] AS corners FROM (SELECT s_suppkey AS unit_id, {_AT} FROM supplier) WHERE unit_id % 4 IN (1, 2))"


@query("hpx_poly_incl", f"SELECT * FROM {_cover(_CIRCLES, 5, 4)} UNION SELECT * FROM {_cover(_polygons(_BOXES), 5, 4)}")
def hpx_poly_incl(spark, sf_dir):
    """Cells at order 5 that the shapes of STC-S texts may touch, by the inclusive test of order 7."""
    return geometry.stcs_cells(_regions(spark, sf_dir), 5, factor=4)


def _regions(spark, sf_dir):
    """STC-S texts of suppliers: circles, boxes, unions and broken ones."""
    k = F.col("s_suppkey")
    ra, dec = k * 104729 % 3600000 / F.lit(10000.0), k * 7368787 % 1500001 / F.lit(10000.0) - 75
    box = F.format_string("POLYGON ICRS %.4f %.4f %.4f %.4f %.4f %.4f %.4f %.4f", ra, dec, ra + 2, dec, ra + 2, dec + 2, ra, dec + 2)
    circle = F.format_string("CIRCLE ICRS %.4f %.4f %.2f", ra, dec, k % 5 / F.lit(2.0))
    kinds = F.when(k % 4 == 0, circle).when(k % 4 == 1, box).when(k % 4 == 2, F.concat(F.lit("UNION ICRS ("), circle, F.lit(" "), box, F.lit(")"))).otherwise(F.concat(box, F.lit(" 1")))
    return views.table(spark, sf_dir, "supplier").select(k.alias("unit_id"), kinds.alias("s_region"))


def _shapes(spark, sf_dir):
    return _regions(spark, sf_dir).select("unit_id", geometry.stcs(F.col("s_region")).alias("shapes")).where("shapes is not null")


@query("fn_stcs", "SELECT s_suppkey AS unit_id, CASE s_suppkey % 4 WHEN 0 THEN 'circle' WHEN 1 THEN 'polygon' WHEN 2 THEN 'circle,polygon' END AS kinds, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE 4 END AS vertices FROM supplier")
def fn_stcs(spark, sf_dir):
    shapes = _regions(spark, sf_dir).select("unit_id", geometry.stcs(F.col("s_region")).alias("s"))
    return shapes.select("unit_id", F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"), F.aggregate("s", F.lit(0), lambda n, x: n + F.size(x["vertices"])).alias("vertices"))


@query("jn_stcs_match", f"SELECT * FROM (SELECT * FROM {_cover(_CIRCLES, 4)} UNION SELECT * FROM {_cover(_polygons(_BOXES), 4)}) WHERE ipix IN (SELECT cell FROM {views.sql('request')})")
def jn_stcs_match(spark, sf_dir):
    return geometry.stcs_match(_regions(spark, sf_dir), views.view(spark, sf_dir, "request"), 4)


_CENTRES = _polygons(_BOXES)


@query("agg_centroid", f"SELECT unit_id, round((dra + 360) % 360, 6) AS ra, round(ddec, 6) + 0e0 AS dec FROM {_CENTRES}")
def agg_centroid(spark, sf_dir):
    each = _shapes(spark, sf_dir).select("unit_id", F.explode("shapes").alias("s")).where("s.kind = 'polygon'")
    return each.select("unit_id", geometry.centroid(F.col("s.vertices")).alias("c")).select("unit_id", F.round("c.ra", 6).alias("ra"), (F.round("c.dec", 6) + F.lit(0.0)).alias("dec"))


@query("agg_cap", f"SELECT unit_id, round((dra + 360) % 360, 6) AS ra, round(ddec, 6) + 0e0 AS dec, round(radius, 6) AS radius FROM {_CENTRES}")
def agg_cap(spark, sf_dir):
    each = _shapes(spark, sf_dir).select("unit_id", F.explode("shapes").alias("s")).where("s.kind = 'polygon'")
    return each.select("unit_id", geometry.cap(F.col("s.vertices")).alias("c")).select("unit_id", F.round("c.ra", 6).alias("ra"), (F.round("c.dec", 6) + F.lit(0.0)).alias("dec"), F.round("c.radius", 6).alias("radius"))


@query("q_rect_cover")
def q_rect_cover(spark, sf_dir):
    return region.cover_rectangle(spark, 350.0, 10.0, -5.0, 5.0, target=7)


@query("q_rect_report")
def q_rect_report(spark, sf_dir):
    box = (20.0, 300.0, -30.0, 90.0)
    return region.cover_report(region.cover_rectangle(spark, *box, target=6), *box)


_RADIUS4 = hpx.max_pixel_radius(4)


def _plane(ra: float) -> str:
    """DuckDB: how far east of a meridian's half-plane a direction is, as the sine."""
    return f"(-sin(radians({ra}e0)) * cos(radians(dec)) * cos(radians(ra)) + cos(radians({ra}e0)) * cos(radians(dec)) * sin(radians(ra)))"


@query(
    "cls_rectangle_cell",
    f"""SELECT ipix, CASE WHEN dec + r < -30 OR dec - r > 40 THEN 'outside' WHEN (a1 < -t OR b1 < -t) AND (a2 < -t OR b2 < -t) THEN 'outside' WHEN dec - r >= -30 AND dec + r <= 40 AND ((a1 >= t AND b1 >= t) OR (a2 >= t AND b2 >= t)) THEN 'inside' ELSE 'boundary' END AS state
    FROM (SELECT ipix, dec, {_RADIUS4}e0 AS r, sin(radians({_RADIUS4}e0)) AS t, {_plane(20)} AS a1, -{_plane(160)} AS b1, {_plane(160)} AS a2, -{_plane(300)} AS b2 FROM {_centres(f'(SELECT DISTINCT ipix FROM {LAYERS})', 4)})""",
)
def cls_rectangle_cell(spark, sf_dir):
    return views.layer_cells(spark, sf_dir).select("ipix").distinct().select("ipix", region.classify(4, F.col("ipix"), 20.0, 300.0, -30.0, 40.0).alias("state"))


@query("q_selector", "SELECT 6 AS \"order\", unnest(range(100, 250)) AS ipix, CAST(floor((unnest(range(100, 250)) - 100) / 64) AS INTEGER) AS batch")
def q_selector(spark, sf_dir):
    return region.selector(spark, cells=(6, [*range(249, 99, -1), 120]))


_ASKED = f"(SELECT *, CAST(left(survey_id, 1) AS BIGINT) AS source_no FROM {{PROJECTED}} WHERE ipix BETWEEN 1000 AND 1080)"


@query("q_region_query", f"SELECT source_no, survey_id AS layer_id, 6 AS \"order\", ipix, max(rn) OVER (PARTITION BY source_no) > 150 AS truncated, 'conservative-projection' AS operation FROM (SELECT *, row_number() OVER (ORDER BY source_no, ipix) AS rn FROM {_ASKED}) QUALIFY rn <= 150".replace("{PROJECTED}", PROJECTED))
def q_region_query(spark, sf_dir):
    """All surveys in a region of 81 cells at order 6, under one budget of 150 cells."""
    cells = region.check_region(6, list(range(1000, 1081)), ["coverage"])
    sources = spark.createDataFrame(list(enumerate(SURVEYS, 1)), "source_no long, layer_id string")
    return region.query_region(sources, views.mixed_cells(spark, sf_dir).withColumnRenamed("survey_id", "layer_id"), 6, cells, 150)


@query("chk_region", "SELECT unnest(['plain', 'too fine', 'no cells', 'too wide', 'repeated source', 'not concrete']) AS request, unnest([true, false, false, false, false, false]) AS allowed")
def chk_region(spark, sf_dir):
    """Requests with what is wrong with each, and whether they are allowed."""
    asked = {"plain": (6, [1, 2], ["a"]), "too fine": (14, [1], ["a"]), "no cells": (6, [], ["a"]), "too wide": (4, list(range(60)), ["a"]), "repeated source": (6, [1], ["a", "a"]), "not concrete": (6, [1], ["public:a"])}

    def allowed(request) -> bool:
        try:
            return bool(region.check_region(*request))
        except ValueError:
            return False

    return spark.createDataFrame([(n, allowed(r)) for n, r in asked.items()], "request string, allowed boolean")


@query("view_clip", f"SELECT survey_id, ipix FROM (SELECT *, degrees(acos(greatest(-1, least(1, sin(radians(dec)) * sin(radians(30e0)) + cos(radians(dec)) * cos(radians(30e0)) * cos(radians(ra - 120e0)))))) AS d FROM {_centres(PROJECTED, 6)}) WHERE d <= 12 + {hpx.max_pixel_radius(6)}e0 OR 180 - d <= 12 + {hpx.max_pixel_radius(6)}e0")
def view_clip(spark, sf_dir):
    return region.in_view(ranges.project(views.mixed_cells(spark, sf_dir), 6, "survey_id"), 6, 120.0, 30.0, 12.0)


@query("view_tiles")
def view_tiles(spark, sf_dir):
    tiles = ranges.project(views.mixed_cells(spark, sf_dir), 2, "survey_id")
    return region.shared_view_tiles(tiles, SURVEYS, 8, 120.0, 30.0, 20.0)


@query("q_scope_from_overlap")
def q_scope_from_overlap(spark, sf_dir):
    """The second region that two surveys of discs share at order 7, and its cone."""
    discs = lambda rows: region.disc_cells(spark.createDataFrame(rows, "ra double, dec double, radius_deg double"), 7).select(F.lit(7).alias("order"), "ipix").distinct()
    found, cone = region.scope_of_overlap(discs([(40.0, 20.0, 4.0), (200.0, -40.0, 3.0), (300.0, 60.0, 2.0)]), discs([(43.0, 21.0, 3.0), (203.0, -41.0, 3.0)]), 7, 2)
    return found.join(F.broadcast(cone), F.lit(True))


def _fields(spark, sf_dir):
    """Imaging fields of line items on great circles."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    mu, nu = (k * 104729 % 3600000) / F.lit(10000.0), (k * 7919 % 50000) / F.lit(10000.0) - 2.5
    return views.table(spark, sf_dir, "lineitem").select(
        k.alias("field"), (F.col("l_suppkey") % 20).alias("run"), F.when(k % 11 == 0, "40").otherwise(" 301").alias("rerun"), F.when(k % 13 == 0, 2).otherwise(0).alias("photo_status"), F.lit(95.0).alias("node"), (k % 7 * 2.5).cast("double").alias("incl"),
        mu.alias("mu_start"), F.when(k % 17 == 0, mu - 1).otherwise(mu + 0.3).alias("mu_end"), nu.alias("nu_start"), (nu + 0.25).alias("nu_end"), F.col("l_returnflag").alias("band"),
    )


@query("q_sdss_normalize", "SELECT CASE WHEN k % 11 = 0 THEN 'rerun-40' WHEN r >= 15 THEN 'run-not-listed' WHEN k % 13 = 0 THEN 'photo-status-2' WHEN k % 17 = 0 THEN 'invalid-geometry' END AS reason, count(*) AS n FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey % 20 AS r FROM lineitem) GROUP BY 1")
def q_sdss_normalize(spark, sf_dir):
    runs = spark.range(15).withColumnRenamed("id", "run")
    return geometry.normalized_fields(_fields(spark, sf_dir), runs).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "q_sdss_corners",
    """SELECT field, round((degrees(atan2(sin(a) * cos(b) * cos(i) - sin(b) * sin(i), cos(a) * cos(b))) + 95 + 360) % 360, 6) + 0e0 AS ra, round(degrees(asin(sin(a) * cos(b) * sin(i) + sin(b) * cos(i))), 6) + 0e0 AS dec, 4 AS corners
    FROM (SELECT k AS field, radians((k * 104729 % 3600000) / 10000e0 + 0.15e0 - 95) AS a, radians((k * 7919 % 50000) / 10000e0 - 2.5e0 + 0.125e0) AS b, radians(k % 7 * 2.5e0) AS i FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey % 20 AS r FROM lineitem) WHERE k % 11 <> 0 AND r < 15 AND k % 13 <> 0 AND k % 17 <> 0)""",
)
def q_sdss_corners(spark, sf_dir):
    runs = spark.range(15).withColumnRenamed("id", "run")
    good = geometry.normalized_fields(_fields(spark, sf_dir), runs).where("reason is null")
    return good.select("field", *[(F.round(f"centre.{n}", 6) + F.lit(0.0)).alias(n) for n in ("ra", "dec")], F.size("vertices").alias("corners"))


def _on_circle(mu: str, nu: str) -> str:
    """DuckDB: [ra, dec] of great-circle coordinates about node 95."""
    m, v, i = f"radians({mu} - 95)", f"radians({nu})", "radians(k % 7 * 2.5e0)"
    return f"[degrees(atan2(sin({m}) * cos({v}) * cos({i}) - sin({v}) * sin({i}), cos({m}) * cos({v}))) + 95, degrees(asin(sin({m}) * cos({v}) * sin({i}) + sin({v}) * cos({i})))]"


_FRAMES = f"(SELECT k AS unit_id, [{_on_circle('mu', 'nu')}, {_on_circle('(mu + 0.3e0)', 'nu')}, {_on_circle('(mu + 0.3e0)', '(nu + 0.25e0)')}, {_on_circle('mu', '(nu + 0.25e0)')}] AS corners FROM (SELECT *, k * 104729 % 3600000 / 10000e0 AS mu, k * 7919 % 50000 / 10000e0 - 2.5e0 AS nu FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey % 20 AS r, l_returnflag AS band FROM lineitem)) WHERE band IN ('A', 'R') AND k % 11 <> 0 AND r < 15 AND k % 13 <> 0 AND k % 17 <> 0)"
_FULL_PARENTS = lambda cells: f"(SELECT ipix // 4 AS ipix FROM {cells} GROUP BY ipix // 4 HAVING count(*) = 4)"


@query(
    "q_frames_to_moc",
    f"""WITH c7 AS MATERIALIZED (SELECT DISTINCT ipix FROM {_cover(_polygons(_FRAMES), 7)}), c6 AS {_FULL_PARENTS("c7")}, c5 AS {_FULL_PARENTS("c6")}, c4 AS {_FULL_PARENTS("c5")}
    SELECT 4 AS "order", ipix FROM c4 UNION ALL SELECT 5, ipix FROM c5 WHERE ipix // 4 NOT IN (SELECT ipix FROM c4) UNION ALL SELECT 6, ipix FROM c6 WHERE ipix // 4 NOT IN (SELECT ipix FROM c5) UNION ALL SELECT 7, ipix FROM c7 WHERE ipix // 4 NOT IN (SELECT ipix FROM c6)""",
)
def q_frames_to_moc(spark, sf_dir):
    """Canonical coverage at order 7 of the fields of two bands."""
    fields = geometry.normalized_fields(_fields(spark, sf_dir), spark.range(15).withColumnRenamed("id", "run"))
    return geometry.frames_to_cells(fields, ["A", "R"], 7)


_IN_CONE = f"(SELECT source_row, ra, dec, z FROM {OBJECTS} o WHERE ra < 360 AND degrees(acos(greatest(-1e0, least(1e0, sin(radians(dec)) * sin(radians(30e0)) + cos(radians(dec)) * cos(radians(30e0)) * cos(radians(ra - 120e0)))))) <= 12)"


@query("q_cone_lookup", f"SELECT source_row, e.event_type AS product, (SELECT count(*) FROM {_IN_CONE}) > 50 AS truncated FROM (SELECT * FROM {_IN_CONE} ORDER BY source_row LIMIT 50) c JOIN events e ON e.event_id = c.source_row")
def q_cone_lookup(spark, sf_dir):
    """The first 50 objects of a cone with their products, and whether there were more."""
    products = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("source_row"), F.col("event_type").alias("product"))
    return region.cone_lookup(views.objects(spark, sf_dir).where("ra < 360"), products, 120.0, 30.0, 12.0, "source_row", 50).select("source_row", "product", "truncated")


_ASKED6 = "(SELECT unnest(range(1024, 1064)) AS ipix)"
_AROUND = [(k, 0) for k in range(4)] + [(4, k) for k in range(4)] + [(4 - k, 4) for k in range(4)] + [(0, 4 - k) for k in range(4)]
_POINTS = f"(SELECT ipix, k, sqrt(greatest(0, 1 - z * z)) * cos(phi) AS x, sqrt(greatest(0, 1 - z * z)) * sin(phi) AS y, z FROM {_lattice(_ASKED6, 6, ', '.join(f'({n}, {i / 4}e0, {j / 4}e0)' for n, (i, j) in enumerate(_AROUND)))})"
_ARCS = f"(SELECT a.ipix, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS \"by\", b.z AS bz, a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz FROM {_POINTS} a JOIN {_POINTS} b ON b.ipix = a.ipix AND b.k = (a.k + 1) % 16)"
_MEAN6 = f"(SELECT avg(cos(radians(dec)) * cos(radians(ra))) AS x, avg(cos(radians(dec)) * sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM {_centres(_ASKED6, 6)})"
_CONE6 = f"(SELECT any_value(m.x) / sqrt(any_value(m.x * m.x + m.y * m.y + m.z * m.z)) AS x, any_value(m.y) / sqrt(any_value(m.x * m.x + m.y * m.y + m.z * m.z)) AS y, any_value(m.z) / sqrt(any_value(m.x * m.x + m.y * m.y + m.z * m.z)) AS z, max(degrees(acos(least(1e0, (m.x * c.x + m.y * c.y + m.z * c.z) / sqrt(m.x * m.x + m.y * m.y + m.z * m.z))))) + 0.1e0 AS radius FROM {_MEAN6} m, {_corners(_ASKED6, 6)} c)"
_CIRCLES6 = f"(SELECT event_id AS obsid, ra, dec, radius, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM (SELECT event_id, round(event_id * 104729 % 3600000 / 10000e0, 4) AS ra, round(event_id * 7368787 % 1800001 / 10000e0 - 90e0, 4) AS dec, event_id % 5 / 4e0 AS radius FROM events))"
_NEAR6 = f"(SELECT o.* FROM {_CIRCLES6} o, {_CONE6} c WHERE degrees(acos(greatest(-1e0, least(1e0, o.x * c.x + o.y * c.y + o.z * c.z)))) <= c.radius)"
_HITS6 = f"""(SELECT DISTINCT obsid FROM {_NEAR6} o, {_ARCS} e WHERE ax * x + ay * y + az * z >= cos(radians(radius)) - 1e-15
  OR (abs(nx * x + ny * y + nz * z) <= sin(radians(radius)) * sqrt(nx * nx + ny * ny + nz * nz) AND (ny * az - nz * ay) * x + (nz * ax - nx * az) * y + (nx * ay - ny * ax) * z >= 0 AND ("by" * nz - bz * ny) * x + (bz * nx - bx * nz) * y + (bx * ny - "by" * nx) * z >= 0 AND ax * x + ay * y + az * z > 0)
  UNION SELECT obsid FROM {_NEAR6} o WHERE {_pixel(6)} IN (SELECT ipix FROM {_ASKED6}))"""
_OWN6 = f"(SELECT obsid FROM {_HITS6} ORDER BY obsid LIMIT 12)"
_SHOWN6 = f"(SELECT obsid, 'p' || CAST(n AS VARCHAR) AS product FROM {_OWN6}, (SELECT unnest(range(1, 4)) AS n) WHERE n <= obsid % 3 + 1)"


@query("q_cone_images", f"SELECT obsid, product, (SELECT count(*) FROM {_HITS6}) > 12 AS more_observations, (SELECT count(*) FROM {_SHOWN6}) > 20 AS more_products FROM {_OWN6} LEFT JOIN (SELECT * FROM {_SHOWN6} ORDER BY obsid, product LIMIT 20) USING (obsid)")
def q_cone_images(spark, sf_dir):
    """The first 12 circular observations that truly meet 40 cells, with 20 products at most."""
    events, k = views.table(spark, sf_dir, "events"), F.col("event_id")
    ra, dec = k * 104729 % 3600000 / F.lit(10000.0), k * 7368787 % 1800001 / F.lit(10000.0) - 90
    text = F.format_string("CIRCLE ICRS %.4f %.4f %.2f", ra, dec, k % 5 / F.lit(4.0))
    seen = events.select(k.alias("obsid"), ra.alias("ra"), dec.alias("dec"), text.alias("s_region"))
    products = events.select(k.alias("obsid"), F.explode(F.sequence(F.lit(1).cast("long"), k % 3 + 1)).alias("n")).select("obsid", F.concat(F.lit("p"), F.col("n").cast("string")).alias("product"))
    return images.lookup(seen, products, spark.range(1024, 1064).withColumnRenamed("id", "ipix"), 6, 12, 20)


@query("prt_batches", f"SELECT ipix, CAST(floor((row_number() OVER (ORDER BY ipix) - 1) / 7) AS BIGINT) AS batch FROM (SELECT DISTINCT ipix FROM {PAIR})")
def prt_batches(spark, sf_dir):
    return region.batches(_pair(spark, sf_dir), 4)

