"""FITS, text and streaming sources on small files."""

import json
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import hpx
from skyweave.operators import ranges
from skyweave.sources import fits, sinks, text
from skyweave.streaming import drift, quotas
from tests.oracle import SMALL


def _fits(columns, extra=()):
    """A FITS file of one binary table: columns are (name, TFORM, numpy values)."""
    card = lambda k, v: f"{k:<8}= {v}".ljust(80)
    pad = lambda b, c=b"\0": b + c * (-len(b) % 2880)
    table = np.rec.fromarrays([v for _, _, v in columns])
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(table.dtype.itemsize)), card("NAXIS2", str(len(table))), card("PCOUNT", "0"), card("TFIELDS", str(len(columns)))]
    for k, (name, form, _) in enumerate(columns, 1):
        cards += [card(f"TTYPE{k}", f"'{name}'"), card(f"TFORM{k}", f"'{form}'")]
    cards += [card(k, v) for k, v in extra]
    first = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), "END".ljust(80)]).encode()
    return pad(first, b" ") + pad(("".join(cards) + "END".ljust(80)).encode(), b" ") + pad(table.tobytes())


def test_fits_table(spark, tmp_path):
    data = _fits([("ID", "K", np.array([1, 2**40], ">i8")), ("NAME", "4A", np.array([b"ab", b"cdef"], "S4")), ("Z", "E", np.array([0.5, -1], ">f4")), ("OK", "L", np.array([84, 70], "u1"))])
    (tmp_path / "a.fits").write_bytes(data)
    schema = T.StructType.fromDDL("ID bigint, NAME string, Z float, OK boolean")
    assert sorted(map(tuple, fits.fits_table(spark, str(tmp_path), schema).collect())) == [(1, "ab", 0.5, True), (2**40, "cdef", -1.0, False)]
    with pytest.raises(ValueError, match="truncated"):
        fits.read_bintable(data[:-2880])


def test_fits_moc(spark, tmp_path):
    make = lambda cells: _fits([("UNIQ", "K", np.array([4 * 4**o + p for o, p in cells], ">i8"))], [("ORDERING", "'NUNIQ'"), ("COORDSYS", "'C'")])
    (tmp_path / "a.fits").write_bytes(make([(4, 5), (13, 12 * 4**13 - 1)]))
    got = fits.check_moc(fits.fits_moc(spark, str(tmp_path))).collect()
    assert sorted((r.order, r.ipix) for r in got) == [(4, 5), (13, 12 * 4**13 - 1)]
    (tmp_path / "a.fits").write_bytes(make([(4, 5), (5, 21)]))
    with pytest.raises(Exception, match="inside"):
        fits.fits_moc(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="inside"):
        fits.check_moc(spark.createDataFrame([("a", 4, 5), ("a", 5, 21)], "path string, order int, ipix long"))
    (tmp_path / "a.fits").write_bytes(_fits([("UNIQ", "K", np.array([4], ">i8"))], [("ORDERING", "'NESTED'")]))
    with pytest.raises(Exception, match="NUNIQ"):
        fits.fits_moc(spark, str(tmp_path)).collect()


def test_row_windows_in_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fits, "SPAN", 64)
    (tmp_path / "a.fits").write_bytes(_fits([("K", "K", np.arange(1000, dtype=">i8"))]))
    schema = T.StructType.fromDDL("K bigint")
    assert sorted(r.K for r in fits.fits_table(spark, str(tmp_path), schema).collect()) == list(range(1000))
    rows = fits.row_window(spark, str(tmp_path / "a.fits"), schema, 100, 50).collect()
    assert sorted(r.K for r in rows) == list(range(100, 150)) and len({r.bytes_sha256 for r in rows}) == 7
    for start, count in ((990, 11), (-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            fits.row_window(spark, str(tmp_path / "a.fits"), schema, start, count)
    with pytest.raises(ValueError, match="lacks"):
        fits.fits_table(spark, str(tmp_path), T.StructType.fromDDL("X bigint"))


def test_moc_round_trip_and_write_once(spark, tmp_path):
    cells = spark.createDataFrame([(4, 5), (6, 81), (8, 4000), (8, 4001), (8, 4002), (8, 4003)], "order int, ipix long")
    done = sinks.write_moc(cells, str(tmp_path / "m"))
    assert sinks.write_moc(cells, str(tmp_path / "m")) == done
    got = fits.fits_moc(spark, str(tmp_path / "m" / "moc.fits")).select("order", "ipix")
    assert sorted(map(tuple, got.collect())) == [(4, 5), (7, 1000)]
    assert ranges.identity(got).first().revision == ranges.identity(cells).first().revision
    with pytest.raises(ValueError, match="other bytes"):
        sinks.write_moc(cells.limit(1).union(spark.createDataFrame([(4, 9)], "order int, ipix long")), str(tmp_path / "m"))
    files = spark.createDataFrame([("https://a.example/0/5.fits",), ("https://a.example/1/107.fits",)], "url string")
    manifest = sinks.write_path_evidence(files, "url", str(tmp_path / "p"), 3, spark.createDataFrame([(5,), (107,)], "pixel long"))
    assert "moc.fits" in manifest and spark.read.parquet(str(tmp_path / "p" / "files.parquet")).count() == 2
    for bad in (["https://a.example/1/5.fits"], ["https://a.example/0/5.fits", "https://b.example/0/5.fits"]):
        with pytest.raises(ValueError, match="group"):
            sinks.write_path_evidence(spark.createDataFrame([(u,) for u in bad], "url string"), "url", str(tmp_path / "q"), 3)
    assert hpx.cells(3) == 768


def test_listings_and_long_rows(spark, tmp_path):
    page = '<a href="?C=N">Name</a>\n<a href="../">Up</a>\n<a href="a&amp;b.fits">a&amp;b.fits</a>  2026-01-02 03:04  120\n<a href="sub/">sub/</a>  2026-01-02 03:04  -'
    html = text.listing(spark.createDataFrame([(page,)], "value string"), "html").collect()
    assert [tuple(r) for r in html if r.path != "../"] == [("a&b.fits", 120, "2026-01-02 03:04"), ("sub/", None, "2026-01-02 03:04")]
    sums = text.listing(spark.createDataFrame([("0" * 32 + "  x/y.fits",), ("bad line",)], "value string"), "checksum")
    assert [r.path for r in sums.collect()] == ["x/y.fits"]
    (tmp_path / "a.json").write_text('{"k": 1, "Flux": 2}\n')
    with pytest.raises(Exception, match="forbidden"):
        text.ndjson(spark, str(tmp_path / "a.json"), T.StructType.fromDDL("k int"), 1, text.FORBIDDEN).collect()
    (tmp_path / "b.json").write_text('{"k": 1, "s": "' + "x" * text.MOST_ROW + '"}\n')
    with pytest.raises(Exception, match="too long"):
        text.ndjson(spark, str(tmp_path / "b.json"), T.StructType.fromDDL("k int")).collect()
    xml = '<V><INFO name="QUERY_STATUS" value="OK"/><T><FIELD name="b"/><FIELD name="a"/><D><TR><TD>1</TD><TD>2</TD></TR></D></T><INFO name="QUERY_STATUS" value="OVERFLOW"/></V>'
    (tmp_path / "c.xml").write_text(xml)
    rows, overflow = text.votable_named(spark, str(tmp_path / "c.xml"), ["a"])
    assert overflow and [r.a for r in rows.collect()] == ["2"]
    with pytest.raises(ValueError, match="lacks"):
        text.votable_named(spark, str(tmp_path / "c.xml"), ["z"])


def test_first_seen_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = quotas.first_seen(stream, "user_id", "3650 days").writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    seen = [r.user_id for r in spark.table("seen").collect()]
    assert len(seen) == len(set(seen)) == events.select("user_id").distinct().count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    schema = T.StructType.fromDDL("k int")
    assert text.ndjson(spark, str(tmp_path / "a.json"), schema, 2).count() == 2
    with pytest.raises(ValueError, match="manifest"):
        text.ndjson(spark, str(tmp_path / "a.json"), schema, 3)
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"",\nz"\n')
    assert [tuple(r) for r in text.csv(spark, str(tmp_path / "a.csv"), T.StructType.fromDDL("a int, b string")).collect()] == [(1, 'x "y",\nz')]
    (tmp_path / "a.xml").write_text("<V><T><TR><TD>1</TD><TD>u</TD></TR><TR><TD>2</TD><TD>v</TD></TR></T></V>")
    assert sorted(tuple(r) for r in text.votable(spark, str(tmp_path / "a.xml"), ["k", "name"]).collect()) == [("1", "u"), ("2", "v")]
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 3), (3, 4)], "page int, k int")
    assert [r.page for r in text.keyset_faults(pages, "page", "k").collect()] == [3]
    lines = text.csv_lines(spark.createDataFrame([('a"b', 1), (None, 2)], "s string, n int"), ["s", "n"])
    assert [r.value for r in lines.collect()] == ['"a""b",1\r', ",2\r"]
    out = str(tmp_path / "once")
    text.write_once(pages, out)
    text.write_once(pages, out)
    with pytest.raises(ValueError, match="other rows"):
        text.write_once(pages.limit(1), out)


def test_quota_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in quotas.quota_windows(events, 1).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = quotas.quota_windows(stream, 1).writeStream.format("memory").queryName("quota").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("quota").collect()} == want


def test_drift_stream(spark, tmp_path):
    sources = spark.createDataFrame([("a", False, "s1", 8), ("b", False, None, 8)], "id string, skip boolean, sha string, max_order int")
    batches = [[("a", "s1", 8, None), ("b", None, None, "timeout")], [("b", None, None, "timeout")], [("a", "s2", 8, None), ("b", None, None, "timeout")], [("b", "t1", 8, None)]]
    kind = "id string, sha string, max_order int, error string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = drift.monitor_stream(stream, sources, str(tmp_path / "state")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r.id: (r.state, r.failures, r.alert, r.good_sha) for r in spark.read.parquet(str(tmp_path / "state" / str(k))).collect()}
        want = [{"a": ("unchanged", 0, False, "s1"), "b": ("failed", 1, False, None)}, {"a": ("unchanged", 0, False, "s1"), "b": ("failed", 2, False, None)}, {"a": ("drifted", 0, False, "s1"), "b": ("failed", 3, True, None)}, {"a": ("drifted", 0, False, "s1"), "b": ("unchanged", 0, False, "t1")}][k]
        assert got == want, k


def test_a_map_of_cells_that_no_order_has(spark, tmp_path):
    """projections are written from ranges; pixels beyond their order are refused, as their codes would be other cells'."""
    cells = spark.createDataFrame([(2, 3), (5, 4096)], "order int, ipix long")
    sinks.write_moc(cells, str(tmp_path / "m"))
    pixels = json.loads((tmp_path / "m" / "query-order8.json").read_text())["pixels"]
    assert pixels == [*range(3 * 4096, 4 * 4096), *range(4096 * 64, 4097 * 64)]
    with pytest.raises(ValueError, match="not cells"):
        sinks.write_moc(spark.createDataFrame([(5, 12 * 4**5)], "order int, ipix long"), str(tmp_path / "n"))


def test_columnar_records_are_made_in_their_document(spark):
    """what is exploded is a record alone, without the names and the document beside it."""
    one = {"Tables": [{"Columns": [{"dataIndex": "a"}, {"dataIndex": "b"}], "Rows": [["1", "2"], ["short"], ["3", "4"]]}]}
    found = text.columnar_json(spark.createDataFrame([(json.dumps(one),)], "value string"))
    assert [r.record for r in found.collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "names" not in plan.split("Generate")[0]


def test_a_full_map_has_its_order_4_cells(spark):
    """a map of all order-4 cells is stored coarser and read back as those cells."""
    full = spark.range(3072).select(F.lit(4).alias("order"), F.col("id").alias("ipix"))
    cells = ranges.canonical(full, coarsest=0, finest=13)
    assert cells.count() == 12
    got = ranges.project(cells, 4)
    assert got.count() == 3072 and got.where("ipix is null").isEmpty()
