"""Deterministic sky views of the test tables: surveys, layers, units, edges and objects from order and event keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import hpx

SCATTER = 2654435761


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layer_cells(spark: SparkSession, sf_dir: str, order: int = 4) -> DataFrame:
    """(survey_id, layer_id, ipix): a survey is an order priority, a layer also a market segment."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    cell = F.col("o_orderkey") * SCATTER % hpx.cells(max(order, 4))
    return joined.select(F.col("o_orderpriority").alias("survey_id"), F.concat_ws("/", "o_orderpriority", "c_mktsegment").alias("layer_id"), hpx.parent(cell, max(0, 4 - order)).alias("ipix"))


def survey_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(survey_id, lo, hi) at order 8."""
    lo = F.col("o_orderkey") * SCATTER % hpx.cells(8)
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("survey_id"), lo.alias("lo"), F.least(lo + 1 + F.col("o_custkey") % 50, F.lit(hpx.cells(8))).cast("long").alias("hi"))


def mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(survey_id, order, ipix) at orders 4 to 7, overlapping freely."""
    order = (F.col("o_orderkey") % 4 + 4).cast("int")
    place = F.floor(F.col("o_orderkey") * SCATTER % hpx.cells(7) / F.pow(F.lit(4.0), 7 - order)).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("survey_id"), order.alias("order"), place.alias("ipix"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(survey_id, layer_id, order, ipix): layers publish orders 2, 4 and 6, those of one segment none finer than 4."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    cell = F.col("o_orderkey") * SCATTER % hpx.cells(6)
    at = F.array(F.lit(2), F.lit(4), F.lit(6))
    rows = joined.select(F.col("o_orderpriority").alias("survey_id"), F.concat_ws("/", "o_orderpriority", "c_mktsegment").alias("layer_id"), cell.alias("c"), F.explode(F.when(F.col("c_mktsegment") == "MACHINERY", F.slice(at, 1, 2)).otherwise(at)).alias("order"))
    return rows.select("survey_id", "layer_id", "order", F.floor(F.col("c") / F.pow(F.lit(4.0), 6 - F.col("order"))).cast("long").alias("ipix"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of events: identity, direction, redshift, quality. Some are missing, conflicting or out of range."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(e % 101 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("object_id"),
        F.when(e % 103 == 0, F.lit(400.0)).otherwise(e * 104729 % 3600000 / F.lit(10000.0)).alias("ra"),
        (e * 7368787 % 1800001 / F.lit(10000.0) - F.lit(90.0)).alias("dec"),
        F.when(e % 107 == 0, F.lit(None)).otherwise(F.col("value") / F.lit(280.0)).cast("double").alias("z"),
        (e % 17 == 0).cast("int").alias("zwarn"),
        F.when(F.col("event_type") == "error", "STAR").otherwise("GALAXY").alias("spectype"),
        F.when(e % 109 == 0, "unknown").otherwise("heliocentric").alias("frame"),
        e.alias("source_row"),
    )


#: Views as SQL that Spark and DuckDB both read; tables stand in braces. They are inputs: no operator is among them.
VIEWS = {
    "layers": """SELECT c_custkey AS layer_no, CASE WHEN c_custkey % 11 = 0 THEN 'batch-' WHEN c_custkey % 13 = 0 THEN 'warehouse-selftest-' WHEN c_custkey % 17 = 0 THEN 's3-' ELSE 'l-' END || CAST(c_custkey AS VARCHAR(40)) AS layer_id,
        's' || CAST(c_nationkey AS VARCHAR(40)) AS survey_id, 'r' || CAST(c_custkey % 3 AS VARCHAR(40)) AS release_id, 'p' || CAST(c_custkey % 50 AS VARCHAR(40)) AS product_id,
        CASE c_custkey % 6 WHEN 0 THEN ' Image' WHEN 1 THEN 'spectrum' WHEN 2 THEN 'Spectra' WHEN 3 THEN 'redshift' WHEN 4 THEN 'imaging' END AS modality,
        CASE c_custkey % 7 WHEN 0 THEN 'RETIRED' WHEN 1 THEN 'PARTITIONED' ELSE 'ACTIVE' END AS state, CASE WHEN c_custkey % 5 = 0 THEN 'CANDIDATE' ELSE 'LIVE' END AS layer_mode,
        CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'estimated' WHEN 2 THEN 'entrypoint-only' ELSE 'exact' END AS prec, c_acctbal AS weight,
        CASE WHEN c_custkey % 9 = 0 THEN 'overview_only' WHEN c_custkey % 9 = 1 THEN 'awaiting_geometry' WHEN c_custkey % 9 = 2 THEN 'not_applicable' ELSE 'acquired' END AS status, c_custkey % 10 + 3 AS max_order FROM {customer}""",
    "edges": """SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_suppkey AS layer_id, l_orderkey AS file_id, CASE WHEN l_partkey % 4 = 0 THEN 9 ELSE 8 END AS ord,
        CASE WHEN l_partkey % 4 = 0 THEN (l_partkey * 2654435761) % 3145728 ELSE (l_partkey * 2654435761) % 786432 END AS ipix,
        CASE WHEN l_returnflag = 'R' THEN 'truncated' WHEN l_linestatus = 'O' THEN 'estimated' ELSE 'exact' END AS prec,
        CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS observation_layer_id, l_suppkey % 7 AS scan_run, l_returnflag AS role FROM {lineitem}""",
    "files": """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 's3://bucket/' WHEN o_orderkey % 31 = 0 THEN 'http://localhost/' ELSE 'https://archive.example/' END || 'f' || CAST(o_orderkey AS VARCHAR(40)) AS uri,
        'f' || CAST(o_orderkey AS VARCHAR(40)) || '.fits' AS file_name, o_orderkey % 5000 AS size, o_orderstatus AS kind FROM {orders} WHERE o_orderkey % 10 <> 9""",
    "versions": """SELECT l_suppkey AS layer_id, l_orderkey AS file_id, max('f' || CAST(l_orderkey AS VARCHAR(40)) || CASE WHEN l_suppkey % 5 = 0 THEN '_v2.fits' ELSE '.fits' END) AS file_name, max(l_orderkey % 5000 + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS size,
        max(CASE WHEN l_orderkey % 3 = 0 THEN 's3://bucket/' ELSE 'https://archive.example/' END || 'f' || CAST(l_orderkey AS VARCHAR(40)) || CASE WHEN l_suppkey % 4 = 0 THEN '?v=2' ELSE '' END) AS uri, max(CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey END) AS modified
        FROM {lineitem} WHERE l_linenumber % 2 = 0 AND l_orderkey % 9 <> 0 GROUP BY l_suppkey, l_orderkey""",
    "units": """SELECT s_suppkey AS unit_id, 's' || CAST(s_nationkey AS VARCHAR(40)) AS survey_id, s_suppkey % 4 AS layer_no, CASE s_suppkey % 3 WHEN 0 THEN 'tile' WHEN 1 THEN 'brick' ELSE 'ccd' END AS unit_kind,
        (s_suppkey * 2654435761) % 3072 AS coarse_cell, (s_suppkey * 7919) % 786000 AS first_ipix, (s_suppkey * 7919) % 786000 + s_suppkey % 300 AS last_ipix, s_suppkey % 7 <> 0 AS complete, s_acctbal AS quality FROM {supplier}""",
    "members": """SELECT l_suppkey AS unit_id, l_orderkey AS obsid, (l_partkey * 2654435761) % 786432 AS ipix, CASE l_partkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'R' WHEN 2 THEN 'I' WHEN 3 THEN 'Z' END AS band, 'i' || CAST(l_suppkey % 9 AS VARCHAR(40)) AS instrument,
        't' || CAST(l_partkey % 12 AS VARCHAR(40)) AS target, l_quantity AS t_min, l_quantity + l_linenumber AS t_max, l_linestatus = 'F' AS complete, 'https://archive.example/u' || CAST(l_suppkey AS VARCHAR(40)) || '/' || CAST(l_partkey % 6 AS VARCHAR(40)) AS uri, l_linenumber AS seq FROM {lineitem}""",
    "request": "SELECT DISTINCT (p_partkey * 2654435761) % 3072 AS cell FROM {part} WHERE p_size < 15",
    "request8": "SELECT DISTINCT (p_partkey * 2654435761) % 786432 AS cell FROM {part}",
    "partitions": """SELECT o_custkey AS scope_id, o_orderkey AS partition_id, o_orderstatus = 'F' AS committed, o_orderkey % 4 AS alias_no, o_orderdate AS created, CASE WHEN o_orderkey % 97 = 0 THEN 'other' ELSE 'lock' END AS lock_sha FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the tables of a folder."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def sql(name: str) -> str:
    """A view of VIEWS as a DuckDB subquery."""
    return "(" + VIEWS[name].replace("{", "").replace("}", "") + ")"
