"""Registered queries of sources and sinks: rows of the tables go out as files to the shared folder and come back through the source."""

from __future__ import annotations

import gzip
import json
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import hpx
from skyweave.operators import geometry, ranges, region, wcs
from skyweave.plans import snapshots
from skyweave.plans.registry import query
from skyweave.plans.scratch import shared_dir
from skyweave.plans.views import table, view
from skyweave.sources import fits, sinks, text

SUPPLIER = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").toPandas()  # a table of a thousandth of a scale


def _fits(spark, sf_dir) -> str:
    rows = _suppliers(spark, sf_dir)
    names = np.array([n.encode() for n in rows["s_name"]], dtype="S24")
    columns = [("s_suppkey", "K", rows["s_suppkey"].to_numpy(">i8")), ("s_name", "24A", names), ("s_acctbal", "D", rows["s_acctbal"].to_numpy(">f8")), ("good", "L", np.where(rows["s_suppkey"] % 2 == 0, ord("T"), ord("F")).astype("u1"))]
    folder = _folder(spark, "fits")
    sinks.put_once(folder, "supplier.fits", sinks.bintable(columns, {"EXTNAME": "'SUPPLIER'"}))
    return f"{folder}/supplier.fits"


@query("src_fits_table", "SELECT s_suppkey, s_name, s_acctbal, s_suppkey % 2 = 0 AS good FROM supplier")
def src_fits_table(spark, sf_dir):
    return fits.fits_table(spark, _fits(spark, sf_dir), T.StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double, good boolean"), "SUPPLIER")


@query("src_row_window", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 3")
def src_row_window(spark, sf_dir):
    return fits.row_window(spark, _fits(spark, sf_dir), T.StructType.fromDDL("s_suppkey bigint"), 3, 5).select("s_suppkey")


def _moc(spark, sf_dir):
    cells = view(spark, sf_dir, "units").select(F.lit(4).alias("order"), F.col("coarse_cell").alias("ipix"))
    return cells.union(view(spark, sf_dir, "units").select(F.lit(8), F.col("first_ipix")))


@query("src_fits_moc", "SELECT DISTINCT c FROM (SELECT CAST(floor(((s_suppkey * 7919) % 786000) / 256) AS BIGINT) AS c FROM supplier UNION ALL SELECT (s_suppkey * 2654435761) % 3072 FROM supplier)")
def src_fits_moc(spark, sf_dir):
    """A map written and read again, by the order-4 cells it touches."""
    folder = _folder(spark, "moc")
    sinks.write_moc(_moc(spark, sf_dir), folder)
    cells = fits.check_moc(fits.fits_moc(spark, f"{folder}/moc.fits"))
    return ranges.project(cells, 4).withColumnRenamed("ipix", "c")  # a full map has cells coarser than order 4


@query("src_moc_legacy", "SELECT DISTINCT (s_suppkey * 2654435761) % 3072 AS ipix FROM supplier")
def src_moc_legacy(spark, sf_dir):
    cells = view(spark, sf_dir, "units").select("coarse_cell").toPandas()["coarse_cell"].to_numpy()
    folder = _folder(spark, "legacy")
    uniq = (4 * 4**4 + np.concatenate([cells, cells[:5]])).astype(">i4")
    sinks.put_once(folder, "old.fits", sinks.bintable([("PIXEL", "J", uniq)], {"PIXTYPE": "'HEALPIX'", "ORDERING": "'NUNIQ'", "COORDSYS": "'C'"}))
    found = fits.fits_moc(spark, f"{folder}/old.fits", legacy=True)
    return found.select(F.explode(F.sequence(F.col("ipix") * F.pow(F.lit(4.0), 4 - F.col("order")).cast("long"), (F.col("ipix") + 1) * F.pow(F.lit(4.0), 4 - F.col("order")).cast("long") - 1)).alias("ipix"))


@query("snk_moc", "SELECT 'query' AS kind, count(DISTINCT c) AS pixels FROM (SELECT unnest(range(((s_suppkey * 2654435761) % 3072) * 256, ((s_suppkey * 2654435761) % 3072 + 1) * 256)) AS c FROM supplier UNION ALL SELECT (s_suppkey * 7919) % 786000 FROM supplier) UNION ALL SELECT 'preview', count(DISTINCT c) FROM (SELECT CAST(floor(((s_suppkey * 7919) % 786000) / 256) AS BIGINT) AS c FROM supplier UNION ALL SELECT (s_suppkey * 2654435761) % 3072 FROM supplier)")
def snk_moc(spark, sf_dir):
    """A map's projections as its sink wrote them."""
    folder = _folder(spark, "moc")
    sinks.write_moc(_moc(spark, sf_dir), folder)
    read = lambda kind, order: spark.read.text(f"{folder}/{kind}-order{order}.json").select(F.lit(kind).alias("kind"), F.size(F.from_json("value", "struct<pixels:array<long>>")["pixels"]).cast("long").alias("pixels"))
    return read("query", 8).union(read("preview", 4))


@query("snk_path_evidence", "SELECT s_suppkey AS ipix FROM supplier")
def snk_path_evidence(spark, sf_dir):
    folder = _folder(spark, "paths")
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pixel"))
    last = k.agg(F.max("pixel")).first()[0] or 0
    order = next(o for o in range(5, hpx.MAX_ORDER + 1) if last < hpx.cells(o))  # 5, or the first order with a cell for every pixel
    files = k.select(F.concat(F.lit("https://archive.example/"), F.expr("pixel div 100").cast("string"), F.lit("/"), F.col("pixel").cast("string"), F.lit(".fits")).alias("url"))
    sinks.write_path_evidence(files, "url", folder, order, roster=k)
    return spark.read.parquet(f"{folder}/files.parquet").select("ipix")


@query("src_csv", "SELECT o_orderkey, o_orderstatus || ', \"' || o_orderpriority || '\"' AS note FROM orders")
def src_csv(spark, sf_dir):
    """Rows exported as CSV with quotes and commas, and read again."""
    folder = _folder(spark, "csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_orderstatus"), F.lit(', "'), F.col("o_orderpriority"), F.lit('"')).alias("note"))
    text.csv_export(rows, ["o_orderkey", "note"], folder)
    return text.csv(spark, folder, T.StructType.fromDDL("o_orderkey bigint, note string"))


@query("src_ndjson_gz", SUPPLIER)
def src_ndjson_gz(spark, sf_dir):
    folder = _folder(spark, "ndjson")
    rows = _suppliers(spark, sf_dir)
    parts = {f"part-{k}.ndjson.gz": rows.iloc[k::3] for k in range(3)}
    for name, part in parts.items():
        sinks.put_once(folder, name, gzip.compress(part.to_json(orient="records", lines=True).encode(), mtime=0))
    return text.ndjson(spark, folder, T.StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double"), {n: len(p) for n, p in parts.items()}, text.FORBIDDEN)


@query("src_json_pages", "SELECT s_suppkey % 4 AS page, s_suppkey FROM supplier")
def src_json_pages(spark, sf_dir):
    folder = _folder(spark, "pages")
    keys = _suppliers(spark, sf_dir)["s_suppkey"]
    for page in range(4):
        own = [{"s_suppkey": int(k)} for k in keys[keys % 4 == page]]
        sinks.put_once(f"{folder}/{'base' if page < 3 else 'more'}", f"page-{page}.json.gz", gzip.compress(json.dumps({"page": page, "rows": own}, indent=1).encode(), mtime=0))
    return text.json_pages(spark, [f"{folder}/base", f"{folder}/more"], T.StructType.fromDDL("s_suppkey bigint"), len(keys))


@query("src_columnar_json", "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS name FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def src_columnar_json(spark, sf_dir):
    """Suppliers as documents of a thousand rows at most, each with a row too short, and nations as one of the other form."""
    row = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"))
    pages = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 1000").alias("page")).agg(F.collect_list(row).alias("rows"))
    columns = F.array(*[F.struct(F.lit(n).alias("dataIndex")) for n in ("k", "name")])
    one = pages.select(F.to_json(F.struct(F.array(F.struct(columns.alias("Columns"), F.concat("rows", F.array(F.array(F.lit("short")))).alias("Rows"))).alias("Tables"))).alias("value"))
    nations = table(spark, sf_dir, "nation").agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("data"))
    two = nations.select(F.to_json(F.struct(F.array(*[F.struct(F.lit(n).alias("name")) for n in ("k", "name")]).alias("metadata"), "data")))
    found = text.columnar_json(one.union(two))
    return found.select(F.col("record")["k"].alias("k"), F.col("record")["name"].alias("name"))


@query("src_text_patches", "SELECT CAST(n_nationkey AS VARCHAR) AS tract, '3,' || CAST(n_nationkey % 9 AS VARCHAR) AS patch, n_nationkey * 10e0 AS ra, n_nationkey - 12e0 AS dec, 4 AS corners FROM nation WHERE n_nationkey % 5 <> 4")
def src_text_patches(spark, sf_dir):
    folder, lines = _folder(spark, "patches"), ["# patches"]
    for k in range(table(spark, sf_dir, "nation").count()):
        head = f"Tract: {k}  Patch: 3,{k % 9} "
        lines.append(f"{head} Center (RA, Dec): ({k * 10}.0 , {k - 12}.0)")
        corners = [(-0.1, -0.1), (-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1), (-0.1, -0.1)][: 6 if k % 5 != 4 else 2]
        lines += [f"{head} Corner{i} (RA, Dec): ({k * 10 + a} , {k - 12 + b})" for i, (a, b) in enumerate(corners)]
    sinks.put_once(folder, "patches.txt", "\n".join(lines).encode())
    return text.text_patches(spark, folder).select("tract", "patch", "ra", "dec", F.size("vertices").alias("corners"))


@query("src_votable", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def src_votable(spark, sf_dir):
    folder = _folder(spark, "votable")
    rows = "".join(f"<TR><TD>{r.s_name}</TD><TD>{r.s_suppkey}</TD></TR>" for r in _suppliers(spark, sf_dir).itertuples())
    page = f'<VOTABLE><RESOURCE><INFO name="QUERY_STATUS" value="OK"/><TABLE><FIELD name="name" datatype="char"/><FIELD name="id" datatype="long"/><DATA><TABLEDATA>{rows}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>'
    sinks.put_once(folder, "page.xml", page.encode())
    found, overflow = text.votable_named(spark, folder, ["id", "name"])
    if overflow:
        raise ValueError("the answer is cut short")
    return found


@query("src_listing", "SELECT 'data/' || CAST(s_suppkey AS VARCHAR) || '.fits' AS path, s_suppkey * 10 AS size FROM supplier")
def src_listing(spark, sf_dir):
    entries = "".join(f"<Contents><Key>data/{k}.fits</Key><LastModified>2026-01-01</LastModified><Size>{k * 10}</Size></Contents>" for k in _suppliers(spark, sf_dir)["s_suppkey"])
    return text.listing(spark.createDataFrame([(f"<ListBucketResult>{entries}</ListBucketResult>",)], "value string"), "s3").select("path", "size")


@query("src_registry", "SELECT 'l' || CAST(n_nationkey AS VARCHAR) AS layer_id, CASE WHEN n_nationkey % 3 = 0 THEN 'without-recipe' WHEN n_nationkey % 4 = 0 THEN 'without-index' ELSE 'complete' END AS state FROM nation")
def src_registry(spark, sf_dir):
    folder = _folder(spark, "registry")
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    product = lambda k: {"survey_id": f"s{k % 5}", "release_id": "r1", "product_id": f"p{k}"}
    parts = {
        "layers": [product(k) | {"layer_id": f"l{k}", "max_order": 8} for k in keys], "recipes": [product(k) | {"mode": "native-moc", "sha": "0"} for k in keys if k % 3],
        "bindings": [product(k) | {"index_id": f"i{k}"} for k in keys if k % 4],
    }
    for name, rows in parts.items():
        sinks.put_once(folder, f"{name}.json", "\n".join(json.dumps(r) for r in rows).encode())
    return text.registry(spark, *(f"{folder}/{n}.json" for n in parts)).select("layer_id", "state")


@query("src_wcs_header", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 4 END AS corners, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_suppkey % 80 - 0.05e0, 5) END AS dec_at_pole_side FROM supplier")
def src_wcs_header(spark, sf_dir):
    """Corners of tangent-plane headers; distorted ones have none. Cells of 0.001 degrees, so a corner's DEC is the centre's less 0.05, to five digits or nearly so."""
    k = F.col("s_suppkey")
    values = {"SIMPLE": "T", "NAXIS": "2", "NAXIS1": "100", "NAXIS2": "100", "RADESYS": "'ICRS'", "CTYPE1": "'RA---TAN'", "CTYPE2": "'DEC--TAN'", "CRPIX1": "50.5", "CRPIX2": "50.5", "CD1_1": "-0.001", "CD1_2": "0.0", "CD2_1": "0.0", "CD2_2": "0.001 / scale"}
    card = lambda n, v: F.rpad(F.concat(F.lit(f"{n:<8}= "), v), 80, " ")
    header = F.concat(*[card(n, F.lit(v)) for n, v in values.items()], card("CRVAL1", (k % 360).cast("string")), card("CRVAL2", F.concat((k % 80).cast("string"), F.lit(".0"))), F.when(k % 4 == 0, card("PV1_1", F.lit("0.5"))).otherwise(F.lit("")), F.rpad(F.lit("END"), 80, " "))
    found = region.dealt(table(spark, sf_dir, "supplier").select("s_suppkey")).select("s_suppkey", geometry.tan_corners(header).alias("c"))
    middle = F.degrees(F.atan(F.tan(F.radians(F.get("c", F.lit(0))["dec"])) / F.cos(F.radians(F.get("c", F.lit(0))["ra"] - k % 360))))
    return found.select("s_suppkey", F.when(F.col("c").isNotNull(), F.size("c")).alias("corners"), F.when(F.col("c").isNotNull(), F.round(middle, 5)).alias("dec_at_pole_side"))


_WCS = "(SELECT s_suppkey AS k, ['TAN', 'SIN', 'ZEA', 'CAR'][s_suppkey % 4 + 1] AS kind, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS ra0, CASE WHEN s_suppkey % 4 = 3 THEN 0e0 ELSE s_suppkey % 81 - 40e0 END AS dec0 FROM supplier)"
#: DuckDB: image points as intermediate degrees (x east, y north), and as the sine and cosine of the distance from the centre.
_PLANE = f"(SELECT *, -0.02e0 * (u - 100) AS x, 0.02e0 * (v - 80) AS y FROM {_WCS}, (VALUES (0, 0.5e0, 0.5e0), (1, 200.5e0, 0.5e0), (2, 200.5e0, 160.5e0), (3, 0.5e0, 160.5e0), (4, 60e0, 90e0)) p(point, u, v))"
_POLAR = f"(SELECT *, sqrt(x * x + y * y) AS q, radians(sqrt(x * x + y * y)) AS r, CASE kind WHEN 'TAN' THEN atan(radians(sqrt(x * x + y * y))) WHEN 'SIN' THEN asin(radians(sqrt(x * x + y * y))) ELSE 2 * asin(radians(sqrt(x * x + y * y)) / 2) END AS c FROM {_PLANE})"
_VECTOR = f"(SELECT *, cos(c) * cos(radians(dec0)) * cos(radians(ra0)) + sin(c) * (-x / q * sin(radians(ra0)) - y / q * sin(radians(dec0)) * cos(radians(ra0))) AS p1, cos(c) * cos(radians(dec0)) * sin(radians(ra0)) + sin(c) * (x / q * cos(radians(ra0)) - y / q * sin(radians(dec0)) * sin(radians(ra0))) AS p2, cos(c) * sin(radians(dec0)) + sin(c) * y / q * cos(radians(dec0)) AS p3 FROM {_POLAR})"


@query("src_wcs_projections", f"SELECT k, point, round(CASE WHEN kind = 'CAR' THEN (ra0 + x + 360) % 360 ELSE (degrees(atan2(p2, p1)) + 360) % 360 END, 7) AS ra, round(CASE WHEN kind = 'CAR' THEN y ELSE degrees(asin(p3)) END, 7) + 0e0 AS dec, u, v FROM {_VECTOR}")
def src_wcs_projections(spark, sf_dir):
    """Corners and an inner point of images in four projections, as directions, and as the pixels that those lead back to."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("TAN", "SIN", "ZEA", "CAR")]), (k % 4 + 1).cast("int"))
    values = {"SIMPLE": "T", "NAXIS": "2", "NAXIS1": "200", "NAXIS2": "160", "RADESYS": "'ICRS'", "CRPIX1": "100.0", "CRPIX2": "80.0", "CDELT1": "-0.02", "CDELT2": "0.02"}
    card = lambda n, v: F.rpad(F.concat(F.lit(f"{n:<8}= "), v), 80, " ")
    quoted = lambda p: F.concat(F.lit(f"'{p}"), kind, F.lit("'"))
    header = F.concat(*[card(n, F.lit(v)) for n, v in values.items()], card("CTYPE1", quoted("RA---")), card("CTYPE2", quoted("DEC--")), card("CRVAL1", (k * 37 % 360).cast("string")), card("CRVAL2", F.when(k % 4 == 3, "0").otherwise((k % 81 - 40).cast("string"))), F.rpad(F.lit("END"), 80, " "))
    points = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(u).alias("u"), F.lit(v).alias("v")) for n, (u, v) in enumerate([(0.5, 0.5), (200.5, 0.5), (200.5, 160.5), (0.5, 160.5), (60.0, 90.0)])])
    rows = region.dealt(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.alias("k"), wcs.read(header).alias("w")).select("k", "w", F.explode(points).alias("p"))
    placed = rows.select("k", "w", "p.point", wcs.to_sky(F.col("w"), F.col("p.u"), F.col("p.v")).alias("s"))
    back = placed.withColumn("b", wcs.to_pixel(F.col("w"), F.col("s.ra"), F.col("s.dec")))
    return back.select("k", "point", F.round("s.ra", 7).alias("ra"), (F.round("s.dec", 7) + F.lit(0.0)).alias("dec"), F.round("b.u", 6).alias("u"), F.round("b.v", 6).alias("v"))


@query("snk_immutable", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def snk_immutable(spark, sf_dir):
    """A table is written once: the same rows again are accepted."""
    folder = _folder(spark, "once")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    text.write_once(rows, folder)
    text.write_once(rows.orderBy(F.desc("o_orderkey")), folder)
    return spark.read.parquet(folder).agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys"))


@query("snk_snapshot", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def snk_snapshot(spark, sf_dir):
    """A page of an answer frozen under the digest of its identity; asked again, the frozen answer is read."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    identity = {"query": "orders", "of": uuid.uuid4().hex}
    snapshots.keyed(rows, identity, ["o_orderkey"])
    return snapshots.page(snapshots.keyed(rows.limit(0), identity, ["o_orderkey"]), 50, 100)


@query("snk_csv_export", "SELECT 'o_orderkey,o_orderstatus' AS line UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus FROM orders")
def snk_csv_export(spark, sf_dir):
    folder = _folder(spark, "export")
    text.csv_export(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").coalesce(1), ["o_orderkey", "o_orderstatus"], folder)
    return spark.read.option("lineSep", "\n").text(folder).select(F.regexp_replace("value", "\r$", "").alias("line"))


@query("hpx_maxpixrad", "SELECT o AS \"order\", round(degrees(acos(sqrt(5e0) / 3 * cos(pi() / (4 * n)) * sqrt(1 - t * t) + 2e0 / 3 * t)), 6) AS radius_deg FROM (SELECT o, n, 1 - pow(1 - 1 / n, 2) / 3 AS t FROM (SELECT o, pow(2e0, o) AS n FROM (SELECT unnest(range(14))::INTEGER AS o)))")
def hpx_maxpixrad(spark, sf_dir):
    return spark.createDataFrame([(o, round(hpx.max_pixel_radius(o), 6)) for o in range(hpx.MAX_ORDER + 1)], "order int, radius_deg double")
