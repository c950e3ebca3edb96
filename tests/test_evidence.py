"""Download plans, merging, order and catalogue operators against fixtures and small cases."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import catalogue, evidence, units
from skyweave.plans import snapshots

EDGE = "edge_id long, layer_id string, file_id string, ord int, ipix long, prec string, observation_layer_id string"


def test_fixture_of_edges_and_files(spark):
    edges = spark.createDataFrame([(1, "l", "file-1", 8, 101, "exact", None), (2, "l", "file-1", 8, 102, "exact", None), (3, "l", "file-2", 8, 101, "estimated", None), (4, "l", "file-1", 8, 101, "exact", None)], EDGE)
    files = spark.createDataFrame([("file-1", "a.fits", 5, "s3://bucket/a.fits"), ("file-2", "b.fits", 6, "https://archive.example/b.fits")], "file_id string, file_name string, size long, uri string")
    versions = spark.createDataFrame([], "layer_id string, file_id string, file_name string, size long, uri string")
    got = {r.file_id: r for r in evidence.download_plan(edges, files, versions).collect()}
    assert [(m.ord, m.ipix) for m in got["file-1"].matches] == [(8, 101), (8, 102)]
    assert (got["file-1"].downloadable, got["file-1"].uri, got["file-2"].downloadable, got["file-2"].metadata) == (False, "s3://bucket/a.fits", True, "complete")


def test_versions_that_differ(spark):
    edges = spark.createDataFrame([(1, "l", "f", 8, 1, "exact", "v1"), (2, "l", "f", 8, 2, "exact", "v2"), (3, "l", "g", 8, 3, "exact", "v1"), (4, "l", "h", 8, 3, "exact", None)], EDGE)
    files = spark.createDataFrame([("f", "plain", 1, "https://a.example/p")], "file_id string, file_name string, size long, uri string")
    versions = spark.createDataFrame([("v1", "f", "n", 5, "https://a.example/1"), ("v2", "f", "n", None, "https://a.example/2"), ("v1", "g", "m", 5, "https://a.example/g")], "layer_id string, file_id string, file_name string, size long, uri string")
    got = {r.file_id: r for r in evidence.download_plan(edges, files, versions).collect()}
    assert (got["f"].file_name, got["f"].size, got["f"].uri, got["f"].downloadable, got["f"].conflict) == ("n", None, None, False, True)
    assert (got["g"].file_name, got["g"].downloadable, got["g"].conflict) == ("m", True, False)
    assert (got["h"].metadata, got["h"].file_name, got["h"].downloadable) == ("missing", None, False)


def test_requests_never_refine(spark):
    edges = spark.createDataFrame([(1, "a", "f", 3, 5, "exact", None), (2, "b", "f", 8, 5 * 256 + 9, "exact", None), (3, "b", "f", 9, 5 * 1024, "exact", None)], EDGE)
    got = evidence.requested(edges, spark.createDataFrame([(5,)], "cell long"), 4).collect()
    assert [(r.edge_id, r.ord, r.ipix, r.source_order, r.source_ipix) for r in got] == [(2, 4, 5, 8, 5 * 256 + 9)]


def test_merging_is_associative(spark):
    rnd = random.Random(3)
    kind = "file_id long, size long, prec string, matches array<struct<layer_id:string,ord:int,ipix:long,prec:string>>, truncated boolean"
    plan = lambda: spark.createDataFrame([(f, rnd.randrange(9), rnd.choice(list(evidence.PRECISION)), [("l", 8, rnd.randrange(4), "exact") for _ in range(3)], rnd.random() < 0.3) for f in rnd.sample(range(8), 5)], kind)
    a, b, c = plan(), plan(), plan()
    show = lambda df: sorted(map(str, df.collect()))
    assert show(evidence.merge_plans(evidence.merge_plans(a, b), c)) == show(evidence.merge_plans(a, evidence.merge_plans(b, c))) == show(evidence.merge_plans(a, b, c))


def test_natural_order(spark):
    names = ["b2", "a10", "a9", "A09", "a1b2", "a1b10", "a", "10", "9", ""]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(evidence.natural_key(F.col("n")), "n").collect()]
    assert got == ["", "9", "10", "a", "a1b2", "a1b10", "A09", "a9", "a10", "b2"]


def test_pages_cover_a_frozen_answer_once(spark):
    frozen = snapshots.freeze(spark.range(97).withColumnRenamed("id", "k").repartition(5), ["k"])
    pages = [[r.k for r in snapshots.page(frozen, at, 20).orderBy("k").collect()] for at in range(0, 100, 20)]
    assert sum(pages, []) == list(range(97))
    cells = spark.range(10).withColumnRenamed("id", "cell")
    find, batches = lambda c: c.select((F.col("cell") % 3).alias("k")), [cells.where("cell < 2"), cells, cells]
    got, at = snapshots.in_batches(find, batches, "k")
    assert at is None and {r.k: r.batch for r in got.collect()} == {0: 0, 1: 0, 2: 1}
    part, at = snapshots.in_batches(find, batches, "k", most=1)
    assert at == 1 and {r.k: r.batch for r in part.collect()} == {0: 0, 1: 0}
    rest, at = snapshots.in_batches(find, batches, "k", part, at, most=1)
    assert at is None and {r.k: r.batch for r in rest.collect()} == {0: 0, 1: 0, 2: 1}
    with pytest.raises(ValueError, match="more than"):
        snapshots.in_batches(find, batches * 20, "k")


def test_ranges_of_units(spark):
    """The fixture of partitions: [0, 255] and [256, end] at order 8."""
    own = spark.createDataFrame([("p0", 0, 255), ("p1", 256, 12 * 4**8 - 1)], "unit_id string, first_ipix long, last_ipix long")
    hits = lambda cell, order: sorted(r.unit_id for r in units.in_ranges(own, spark.createDataFrame([(cell,)], "cell long"), order).collect())
    assert (hits(255, 8), hits(256, 8), hits(0, 4), hits(0, 3), hits(255 * 4 + 3, 9)) == (["p0"], ["p1"], ["p0"], ["p0", "p1"], ["p0"])


def test_contract_breaks_are_errors(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, band string")
    good = units.judged_rows(rows, {"no-band": F.col("band").isNull()}, {"negative": F.col("k") < 0})
    assert {r.k: r.reason for r in good.collect()} == {1: None, 2: "no-band"}
    with pytest.raises(Exception, match="contract broken: small"):
        units.judged_rows(rows, {}, {"small": F.col("k") < 2}).collect()


def test_catalogue_values(spark):
    urls = ["https://a.example/x", "http://127.0.0.1/", "https://u@a.example/", "ftp://a/", None, " http://a.example "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(catalogue.public_url(F.col("u"))).collect()] == ["https://a.example/x", None, None, None, None, "http://a.example"]
    cases = {
        "http://10.1.2.3/": False, "http://010.example/": True, "http://172.15.0.1/": True, "http://172.31.0.1:80/": False, "http://172.32.0.1/": True, "https://192.168.0.9": False, "https://192.169.0.9": True, "https://169.254.1.1/x": False,
        "http://[::1]/": False, "http://[::1]:8080/x": False, "http://[2001:db8::1]/": True, "http://[::10]/": True, "http://LOCALHOST:1/": False, "http://localhost.example/": True, "http://a.local/": False, "http://local/": True, "http://x.internal:9/": False,
        "http://a.svc/": False, "http://a.svc.cluster.local/": False, "http://svc.example/": True, "http://my-minio.example/": False, "http://minios.example/": True, "http://kubernetes/": False, "https://a.example:443/p?q=@x": True, "https:///x": False, "x": False, "": False,
        "ftp://archive.noao.edu/public/hlsp/decals/dr1/coadd/x.fits": True, "ftp://archive.noao.edu:21/public/hlsp/decals/dr2/coadd/x": True, "ftp://archive.noao.edu:22/public/hlsp/decals/dr2/coadd/x": False, "ftp://archive.noao.edu/public/hlsp/decals/dr3/coadd/x": False,
        "ftp://archive.noao.edu/public/hlsp/decals/dr1/coadd/x?y": False, "ftp://u@archive.noao.edu/public/hlsp/decals/dr1/coadd/x": False, "ftp://other.example/public/hlsp/decals/dr1/coadd/x": False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.p for r in df.select("u", catalogue.public_url(F.col("u")).alias("p")).collect()}
    assert got == {u: u if fine else None for u, fine in cases.items()}
    one = spark.createDataFrame([("Ünïted  Ätlas--2!",)], "n string").select(catalogue.slug(F.col("n"))).first()[0]
    assert one == "united-atlas-2"
    with pytest.raises(ValueError, match="single letters"):
        catalogue.selected(spark.createDataFrame([("a1",)], "unit_id string"), prefixes=["ab"])
    assert catalogue.selected(spark.createDataFrame([("a1",), ("B2",)], "unit_id string"), prefixes=["b"]).count() == 1


def test_claims_and_canonical_json(spark):
    df = spark.createDataFrame([("Coverage MOC", None), ("x", "https://a/hips/"), ("catalog archive", ""), ("overview", None)], "p string, u string")
    assert [r[0] for r in df.select(catalogue.claim_kind(F.col("p"), F.col("u"))).collect()] == ["moc", "tile", "raw-file", "overview"]
    maps = spark.createDataFrame([({"b": "1", "a": 'x"'},), ({"a": 'x"', "b": "1"},)], "m map<string,string>")
    assert {r[0] for r in maps.select(catalogue.canonical_json(F.col("m"))).collect()} == {'{"a":"x\\"","b":"1"}'}


def test_snapshots_keep_the_first_answer(spark):
    import uuid

    rows, identity, over = spark.range(10).withColumnRenamed("id", "k"), {"q": uuid.uuid4().hex}, {"q": uuid.uuid4().hex}
    assert snapshots.keyed(rows, identity, ["k"]).count() == 10
    assert snapshots.keyed(rows.where("k < 3"), identity, ["k"]).count() == 10
    with pytest.raises(ValueError, match="exceed"):
        snapshots.keyed(rows, over, ["k"], most=1)
    with pytest.raises(ValueError, match="exceed"):  # asked again, it isn't served
        snapshots.keyed(rows, over, ["k"], most=1)
    assert snapshots.keyed(rows, over, ["k"]).count() == 10


def test_units_of_one_geometry_are_counted_once(spark):
    """no row for each pair of a unit and a cell, and the cells of several geometries count once."""
    geometries = spark.createDataFrame([(g, c) for g in ("x", "y") for c in range(40)] + [("z", 7), ("z", 99)], "geometry_key string, cell long")
    members = spark.createDataFrame([(1, "x", u) for u in range(300)] + [(1, "z", 0), (2, "y", 5)], "layer_no int, geometry_key string, unit_id long")
    layers, request = spark.createDataFrame([(1,)], "layer_no int"), spark.range(60).withColumnRenamed("id", "cell")
    got = {r.unit_id: r.cells for r in units.cell_units(layers, geometries, members, request).collect()}
    assert got == {u: 40 for u in range(300)}
    plan = units.cell_units(layers, geometries, members, request)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") >= 1 and "unit_id" not in plan[plan.index("count(distinct") if "count(distinct" in plan else 0 :].splitlines()[0]


def test_plans_are_dealt_into_parts_that_keep_their_size(spark):
    """parts grow in number with the rows; a merge into parts is the same merge."""
    edges = spark.range(100).selectExpr("id % 7 as file_id", "id as layer_id", "8 as ord", "id as ipix", "'exact' as prec")
    assert evidence.parts_of(edges, 10) >= 10
    plan = evidence.file_plans(edges).selectExpr("file_id", "file_id as size", "prec", "matches", "false as truncated")
    show = lambda df: sorted(map(str, df.collect()))
    assert show(evidence.merge_plans(plan, plan, parts=3)) == show(evidence.merge_plans(plan, plan))
