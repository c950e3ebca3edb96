"""Registered queries of the index on disk: members arrive as files of their instrument, are indexed by cell, and change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators import units
from skyweave.plans.registry import query
from skyweave.plans.scratch import delete, shared_dir
from skyweave.plans.views import sql, view
from skyweave.sources import cell_index

MEMBERS, REQUEST = sql("members"), sql("request")


def _judge(rows: DataFrame) -> DataFrame:
    return units.judged_rows(rows, {"no-band": F.col("band").isNull(), "late": F.col("t_min") > 45})


def _arrived(rows: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Members as input files, a folder an instrument."""
    rows.withColumn("source", F.col("instrument")).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(root)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@query("q_index_lookup", f"SELECT DISTINCT instrument AS source, unit_id, obsid, ipix, band, seq FROM {MEMBERS} WHERE band IS NOT NULL AND t_min <= 45 AND CAST(floor(ipix / 256) AS BIGINT) IN (SELECT cell FROM {REQUEST})")
def q_index_lookup(spark, sf_dir):
    """Members indexed on disk, then those whose coarse cell is requested."""
    root = _folder(spark)
    _arrived(view(spark, sf_dir, "members"), f"{root}/in")
    cell_index.refresh(spark, f"{root}/in", f"{root}/index", _judge)
    return cell_index.lookup(spark, f"{root}/index", view(spark, sf_dir, "request")).select("source", "unit_id", "obsid", "ipix", "band", "seq")


_AFTER = f"(SELECT * FROM {MEMBERS} WHERE instrument <> 'i7' AND (instrument NOT IN ('i3', 'i5') OR seq <> 2))"
_KEPT = "band IS NOT NULL AND t_min <= 45"


@query(
    "q_index_refresh",
    f"""SELECT instrument AS source, count(*) AS read, count(*) FILTER (NOT coalesce({_KEPT}, false)) AS excluded, count(*) FILTER ({_KEPT}) AS kept, count(DISTINCT unit_id) FILTER ({_KEPT}) AS units, count(DISTINCT floor(ipix / 256)) FILTER ({_KEPT}) AS cells,
    CASE WHEN instrument IN ('i3', 'i5') THEN 'built' ELSE 'reused' END AS state FROM (SELECT DISTINCT * FROM {_AFTER}) GROUP BY instrument""",
)
def q_index_refresh(spark, sf_dir):
    """The index after two instruments' members changed and one's went: what was built again, and what every source holds."""
    members, root = view(spark, sf_dir, "members"), _folder(spark)
    _arrived(members, f"{root}/in")
    cell_index.refresh(spark, f"{root}/in", f"{root}/index", _judge)
    _arrived(members.where("instrument in ('i3', 'i5') and seq <> 2"), f"{root}/in")
    delete(spark, f"{root}/in/source=i7")
    return cell_index.refresh(spark, f"{root}/in", f"{root}/index", _judge).select("source", "read", "excluded", "kept", "units", "cells", "state")
