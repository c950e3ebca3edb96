"""Registered queries of row contracts: metadata rows of six surveys (and one without a contract), some of them faulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators import contracts, units
from skyweave.plans.registry import query
from skyweave.plans.views import table

_TEXT = lambda x: f"CAST({x} AS VARCHAR(40))"
_SIX = f"lpad({_TEXT('run')}, 6, '0')"
#: Rows as they should be, as SQL that Spark and DuckDB both read.
_CLEAN = f"""SELECT *, CASE survey WHEN 'sdss' THEN {_TEXT("run")} || '/301/' || {_TEXT("camcol")} || '/' || {_TEXT("field")} WHEN 'iphas' THEN {_TEXT("run")} || '/' || {_TEXT("ccd")} WHEN 'ztf' THEN stem
    WHEN 'decaps' THEN 'c4d_' || stem || '.fits.fz#' || {_TEXT("ccd")} WHEN 'akari' THEN 'images/' || filter || '/' || stem WHEN 'nvss' THEN stem ELSE 'u' END AS unit_id,
    CASE survey WHEN 'iphas' THEN 'r' || {_SIX} || '-' || {_TEXT("ccd")} || '.fits.fz' WHEN 'ztf' THEN stem || '.fits' WHEN 'decaps' THEN 'c4d_' || stem || '.fits.fz' ELSE stem END AS file_name
  FROM (SELECT *, CASE survey WHEN 'ztf' THEN 'ztf_' || {_SIX} || '_z' || filter || '_c0' || {_TEXT("ccd")} || '_q' || {_TEXT("ccd")} || '_refimg' WHEN 'akari' THEN {_SIX} || '_' || filter || '_fixstripe.fits'
    WHEN 'nvss' THEN 'I' || lpad({_TEXT("run % 10000")}, 4, '0') || 'P0' || {_TEXT("ccd")} || '.fits.gz' ELSE {_SIX} || '-x' END AS stem, CASE survey WHEN 'ztf' THEN upper(filter) WHEN 'akari' THEN upper(filter) WHEN 'iphas' THEN 'HALPHA' ELSE 'R' END AS band
  FROM (SELECT *, CASE WHEN survey = 'ztf' THEN run ELSE part_no END AS field, CASE WHEN survey = 'akari' THEN CASE part_no % 4 WHEN 0 THEN 'N60' WHEN 1 THEN 'WideS' WHEN 2 THEN 'WideL' ELSE 'N160' END ELSE CASE part_no % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'r' ELSE 'i' END END AS filter,
    CASE WHEN survey = 'ztf' OR survey = 'akari' THEN 'FK5(J2000)' ELSE 'ICRS' END AS frame
  FROM (SELECT CASE l_orderkey % 7 WHEN 0 THEN 'sdss' WHEN 1 THEN 'iphas' WHEN 2 THEN 'ztf' WHEN 3 THEN 'decaps' WHEN 4 THEN 'akari' WHEN 5 THEN 'nvss' ELSE 'other' END AS survey, l_orderkey % 900000 + 1 AS run, l_linenumber % 6 + 1 AS camcol, l_linenumber % 4 + 1 AS ccd,
    l_partkey AS part_no, (l_orderkey * 8 + l_linenumber) % 41 AS fault, l_orderkey * 8 + l_linenumber AS row_no FROM {{lineitem}})))"""
_ROWS = f"""SELECT row_no, survey, camcol, ccd, filter, field, CASE WHEN fault = 0 THEN NULL ELSE 'CIRCLE ICRS 1 2 3' END AS region, CASE WHEN fault = 1 THEN 'GALACTIC' ELSE frame END AS frame, CASE WHEN fault = 2 THEN unit_id || '!' ELSE unit_id END AS unit_id,
  CASE WHEN fault <> 3 THEN file_name END AS file_name, CASE WHEN fault = 4 THEN 'X' ELSE band END AS band, CASE WHEN fault = 5 THEN 0 ELSE run END AS run, CASE WHEN fault = 6 THEN 'false' ELSE 'true' END AS in_release, CASE WHEN fault = 7 THEN 'failed' ELSE 'captured' END AS header,
  CASE WHEN fault = 8 THEN 400 ELSE part_no % 350 END AS ra_min, part_no % 350 + 4 AS ra_max, CASE WHEN fault = 9 THEN 5 ELSE 1 END AS dec_min, 5 AS dec_max, CASE WHEN fault = 10 THEN 2881 ELSE 5760 END AS header_bytes, CASE WHEN fault = 11 THEN 0 ELSE 30 END AS seconds, CASE WHEN fault = 12 THEN 1 ELSE 0 END AS status, '301' AS rerun FROM ({_CLEAN})"""
#: What each fault is to each survey: reasons by the order of the contracts' rules.
_FAULTS = {
    0: {s: "no-region" for s in ("sdss", "iphas", "ztf", "decaps", "akari", "nvss")},
    1: {s: "broken:frame" for s in ("iphas", "ztf", "decaps", "akari", "nvss")},
    2: {"sdss": "broken:own-name", "iphas": "broken:own-name", "ztf": "broken:own-name", "decaps": "broken:own-name", "akari": "broken:path", "nvss": "broken:path"},
    3: {s: "broken:file-name" for s in ("iphas", "ztf", "decaps", "akari", "nvss")},
    4: {s: "broken:band" for s in ("iphas", "ztf", "decaps", "akari")},
    5: {"sdss": "broken:run", "iphas": "broken:run", "decaps": "broken:exposure"},
    6: {"iphas": "not-in-release"}, 7: {"nvss": "header"}, 8: {"iphas": "broken:ra"}, 9: {"iphas": "broken:dec-order"}, 10: {"nvss": "broken:header-blocks"}, 11: {"decaps": "broken:seconds"}, 12: {"sdss": "broken:photo-status"},
}
_SAID = ", ".join(f"({k}, '{s}', '{reason}')" for k, per in _FAULTS.items() for s, reason in per.items())
_JUDGED = f"(SELECT c.*, CASE WHEN c.survey = 'other' THEN 'no-contract' ELSE f.reason END AS reason FROM ({_CLEAN.replace('{lineitem}', 'lineitem')}) c LEFT JOIN (VALUES {_SAID}) f(fault, survey, reason) ON f.fault = c.fault AND f.survey = c.survey)"


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ROWS, lineitem=table(spark, sf_dir, "lineitem"))


@query("flt_contracts", f"SELECT survey, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM {_JUDGED} GROUP BY 1, 2")
def flt_contracts(spark, sf_dir):
    """Rows of every survey by the first reason against them, broken ones in quarantine."""
    return units.exclusion_counts(contracts.judged(metadata_rows(spark, sf_dir), contracts.SURVEYS, quarantine=True), "survey")


@query("flt_contract_rows", f"SELECT row_no, survey, unit_id FROM {_JUDGED} WHERE reason IS NULL")
def flt_contract_rows(spark, sf_dir):
    """Accepted rows; the rules stand in a table, and the broken rows were set right upstream."""
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(contracts.SURVEYS)], "number int, " + ", ".join(f"{f} string" for f in contracts.FIELDS))
    broken = [(k, s) for k, per in _FAULTS.items() for s, reason in per.items() if reason.startswith("broken")]
    fault = F.col("row_no") % 41
    wrong = F.lit(False)
    for k, s in broken:
        wrong = wrong | ((fault == k) & (F.col("survey") == s))
    rows = metadata_rows(spark, sf_dir).where(~wrong)
    return contracts.judged(rows, contracts.rules_of(rules)).where("reason is null").select("row_no", "survey", "unit_id")
