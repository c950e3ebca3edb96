"""Text sources with their checks, publisher listings, and write-once sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import hpx

#: Bytes of one NDJSON row, and columns that hold science and must not be read.
MOST_ROW = 256 * 1024
FORBIDDEN = ("flux", "mag", "redshift", "spectrum", "pixels")


def ndjson(spark: SparkSession, path: str, schema: T.StructType, expected: int | dict[str, int] | None = None, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """JSON rows (plain or gzip) of a fixed schema. Errors: a malformed row, one over MOST_ROW bytes, another number of rows
    than the manifest's (of all files, or by file name), or a forbidden column in any row."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    if isinstance(expected, dict):
        found = {r.file: r.n for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()}
        if wrong := {f for f in found.keys() | expected.keys() if found.get(f, 0) != expected.get(f, 0)}:
            raise ValueError(f"rows differ from the manifest in {sorted(wrong)}")
    elif expected is not None and (n := lines.count()) != expected:
        raise ValueError(f"{n} rows where the manifest has {expected}")
    text = F.when(F.octet_length("value") > MOST_ROW, F.raise_error(F.lit("a row is too long"))).otherwise(F.col("value"))
    if forbidden:
        named = F.json_object_keys(F.col("value"))
        text = F.when(F.arrays_overlap(F.coalesce(F.transform(named, F.lower), F.array().cast("array<string>")), F.array(*[F.lit(c) for c in forbidden])), F.raise_error(F.lit("a row has a forbidden column"))).otherwise(text)
    return lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """RFC 4180 rows with a header: doubled quotes, and line breaks inside quotes."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def json_pages(spark: SparkSession, paths: list[str], row: T.StructType, expected: int | None = None) -> DataFrame:
    """Rows of paged JSON documents {page, rows: [...]}, each its own file, baseline and supplements together, with their page."""
    shape = T.StructType([T.StructField("page", T.LongType()), T.StructField("rows", T.ArrayType(row))])
    pages = spark.read.text(paths, wholetext=True).select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    out = pages.select("page", F.explode("rows").alias("r")).select("page", "r.*")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows where the manifest has {expected}")
    return out


def columnar_json(documents: DataFrame, value: str = "value") -> DataFrame:
    """Maps of column name to text from documents that hold columns apart from rows; rows of another width are left out.

    Two forms: {"Tables": [{"Columns": [{"dataIndex": name}], "Rows": [[...]]}]} and {"metadata": [{"name": name}], "data": [[...]]}.
    """
    shape = "struct<Tables:array<struct<Columns:array<struct<dataIndex:string>>,Rows:array<array<string>>>>,metadata:array<struct<name:string>>,data:array<array<string>>>"
    # A record is made inside its document, so that no exploded row carries the names or the document along.
    def records(d: Column) -> Column:
        first = F.get(d["Tables"], F.lit(0))
        names = F.coalesce(F.transform(first["Columns"], lambda c: c["dataIndex"]), F.transform(d["metadata"], lambda c: c["name"]))
        fits = lambda n: F.transform(F.filter(F.coalesce(first["Rows"], d["data"]), lambda r: F.size(r) == F.size(n)), lambda r: F.map_from_arrays(n, r))
        return hpx.once(names, fits)

    return documents.select(F.explode(hpx.once(F.from_json(value, shape), records)).alias("record"))


def text_patches(spark: SparkSession, path: str) -> DataFrame:
    """(tract, patch, ra, dec, vertices, radius_deg) of lines that give each patch's centre and corners; the first of repeated patches.

    Corners keep their order, repeated neighbours and a closing corner are dropped, patches of fewer than three go.
    """
    number = r"([-+\d.eE]+)"
    form = rf"^Tract:\s*(\d+)\s+Patch:\s*([0-8],[0-8])\s+(Center|Corner(\d+)) \(RA, Dec\):\s*\({number}\s*,\s*{number}\)"
    at = lambda k: F.regexp_extract("value", form, k)
    lines = spark.read.text(path).where(F.col("value").rlike(form)).select(at(1).alias("tract"), at(2).alias("patch"), at(4).alias("corner"), at(5).cast("double").alias("ra"), at(6).cast("double").alias("dec"))
    grouped = lines.groupBy("tract", "patch").agg(
        F.min(F.when(F.col("corner") == "", F.struct("ra", "dec"))).alias("c"), F.array_sort(F.collect_set(F.when(F.col("corner") != "", F.struct(F.col("corner").cast("int").alias("k"), "ra", "dec")))).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (x["k"] != F.get("all", i - 1)["k"]))
    points = F.transform(first, lambda x: F.struct(x["ra"].alias("ra"), x["dec"].alias("dec")))
    apart = F.filter(points, lambda x, i: (i == 0) | (x != F.get(points, i - 1)))
    open_ = F.when((F.size(apart) > 3) & (F.element_at(apart, 1) == F.element_at(apart, -1)), F.slice(apart, 1, F.size(apart) - 1)).otherwise(apart)
    made = grouped.where("c is not null").select("tract", "patch", "c.ra", "c.dec", open_.alias("vertices")).where("size(vertices) >= 3")
    return made.withColumn("radius_deg", F.array_max(F.transform("vertices", lambda v: hpx.angular_distance(v["ra"], v["dec"], F.col("ra"), F.col("dec")))))


def votable(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of a VOTable's TABLEDATA, named by position, as strings."""
    rows = spark.read.format("xml").options(rowTag="TR").schema("TD array<string>").load(path)
    return rows.select(*[F.element_at("TD", k + 1).alias(name) for k, name in enumerate(fields)])


def votable_named(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, bool]:
    """(rows of the fields by name, whether the server cut the answer short)."""
    listed = spark.read.format("xml").options(rowTag="FIELD").schema("_name string").load(path).select("_name", F.monotonically_increasing_id().alias("k")).orderBy("k").collect()
    names = [r["_name"] for r in listed]
    if missing := [f for f in fields if f not in names]:
        raise ValueError(f"VOTable lacks {missing}")
    infos = spark.read.format("xml").options(rowTag="INFO").schema("_name string, _value string").load(path)
    overflow = not infos.where("_name = 'QUERY_STATUS' and _value = 'OVERFLOW'").isEmpty()
    return votable(spark, path, names).select(*fields), overflow


def listing(lines: DataFrame, form: str, value: str = "value") -> DataFrame:
    """(path, size, modified) of a publisher's listing: s3 (XML of ListObjectsV2), html (an index page), or checksum (sha path)."""
    v = F.col(value)
    if form == "s3":
        entry = F.explode(F.regexp_extract_all(v, F.lit(r"(?s)(<Contents>.*?</Contents>)"), F.lit(1))).alias("e")
        part = lambda n: F.regexp_extract("e", rf"(?s)<{n}>(.*?)</{n}>", 1)
        return lines.select(entry).select(_unescaped(part("Key")).alias("path"), part("Size").cast("long").alias("size"), part("LastModified").alias("modified"))
    if form == "html":
        entry = F.explode(F.regexp_extract_all(v, F.lit(r'(?i)(<a\s+href="[^"?/][^"]*"[^>]*>[^<]*</a>[^<\n]*)'), F.lit(1))).alias("e")
        found = lines.select(entry)
        rest = F.regexp_extract("e", r"</a>\s*(\S+ \S+)\s+(\S+)", 1), F.regexp_extract("e", r"</a>\s*(\S+ \S+)\s+(\S+)", 2)
        return found.select(_unescaped(F.regexp_extract("e", r'(?i)href="([^"]*)"', 1)).alias("path"), rest[1].try_cast("long").alias("size"), F.nullif(rest[0], F.lit("")).alias("modified"))
    if form == "checksum":
        good = v.rlike(r"^[0-9a-f]{32,64} [ *]\S+$")
        return lines.where(good).select(F.regexp_extract(v, r"^\S+ [ *](\S+)$", 1).alias("path"), F.lit(None).cast("long").alias("size"), F.regexp_extract(v, r"^(\S+)", 1).alias("modified"))
    raise ValueError("form is s3, html or checksum")


def _unescaped(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def registry(spark: SparkSession, layers: str, recipes: str, bindings: str) -> DataFrame:
    """Registered layers with their locked recipe and binding on (survey, release, product), from three JSON files.

    Repeated layers or recipes of one product are errors; a layer without either is marked.
    """
    keys = ["survey_id", "release_id", "product_id"]
    base = "survey_id string, release_id string, product_id string"
    read = lambda path, more: spark.read.json(path, schema=f"{base}, {more}", mode="FAILFAST")
    parts = {"layer": read(layers, "layer_id string, max_order int"), "recipe": read(recipes, "mode string, sha string"), "binding": read(bindings, "index_id string")}
    for name, df in parts.items():
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"a product has several {name}s")
    out = parts["layer"].join(parts["recipe"], keys, "left").join(parts["binding"], keys, "left")
    return out.withColumn("state", F.when(F.col("mode").isNull(), "without-recipe").when(F.col("index_id").isNull(), "without-index").otherwise("complete"))


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows of a scan by key, behind the last key of the page before."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def keyset_faults(pages: DataFrame, page: str, key: str) -> DataFrame:
    """Keys that repeat or fall behind across the pages of a keyset scan."""
    ends = pages.groupBy(page).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), (F.count(key) - F.count_distinct(key)).alias("repeated"))
    # One row a page: small beside the rows, whatever a page holds.
    return ends.selectExpr("*", f"lag(hi) over (order by {page}) as before").where("repeated > 0 or lo <= before")


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines for a text sink: fields quoted where they hold a quote, comma or line break, ended by a carriage return."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = [F.when(text(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c)) for c in columns]
    return rows.select(F.concat(F.concat_ws(",", *quoted), F.lit("\r")).alias("value"))


def csv_export(rows: DataFrame, columns: list[str], path: str) -> None:
    """Rows as CSV files, one a partition, that each start with the fixed header; lines end in CR LF."""
    header = ",".join(columns)
    lines = csv_lines(rows, columns)

    def with_header(batches):
        first = True
        for b in batches:
            values = b.column("value").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(([header + "\r"] if first else []) + values)], names=["value"])
            first = False

    lines.mapInArrow(with_header, "value string").write.text(path)


def digest(rows: DataFrame) -> tuple[int, int]:
    """Number and order-free hash of rows."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("h")).first()
    return r.n, r.h


def write_once(rows: DataFrame, path: str) -> None:
    """Write Parquet where nothing is; the same rows again are accepted, other rows are an error."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows.write.mode("errorifexists").parquet(path)
    elif digest(spark.read.parquet(path).select(rows.columns)) != digest(rows):
        raise ValueError(f"{path} holds other rows")
