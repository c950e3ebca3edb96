"""Reading large evidence page by page: composite buckets and edges behind a cursor (`search_after`), over Parquet.

A cursor is the last row's key. The next page asks for keys behind it by a row-wise comparison, whose first column is
compared on its own too, so that a scan of evidence stored in key order skips what came before by its statistics. No page
is more than a sort of its own size: rows behind the page are dropped by each task.

Defined results: nulls come first in a key, as buckets of their own; equal keys are one bucket; a cursor behind the last
key gives an empty page; an empty table has no page.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.plans.scratch import delete, materialize, shared_dir

#: Buckets of a page, and edges of one.
BUCKETS, EDGES = 10_000, 5_000
#: Rows of a stored file.
PER_FILE = 1_000_000
CELL_KEY = ("layer_id", "ord", "ipix")
EDGE_KEY = ("file_id", "layer_id", "ord", "ipix", "role")


def behind(keys: Sequence[str], after: Row | Sequence | None) -> Column:
    """Whether a row's key comes after `after`, nulls first."""
    if after is None:
        return F.lit(True)
    out, same = F.lit(False), F.lit(True)
    for name, value in zip(keys, after, strict=True):
        c = F.col(name)
        out = out | (same & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))))
        same = same & c.eqNullSafe(F.lit(value))
    first = after[0]
    return out if first is None else (F.col(keys[0]) >= F.lit(first)) & out


class Stored:
    """Rows written in key order, with the last key and the distinct keys of each file (a row a file is all that is held)."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], per_file: int = PER_FILE):
        self.keys, order = tuple(keys), [F.asc_nulls_first(k) for k in keys]
        files = max(1, -(-rows.count() // per_file))
        self.rows = materialize(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), "evidence")
        marked = F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)).alias(k) for k in keys])
        ends = self.rows.groupBy("_metadata.file_path").agg(F.max(marked).alias("last"), F.count_distinct(marked).alias("keys")).collect()
        self.ends = sorted(((tuple((bool(r.last[k][0]), r.last[k][1]) for k in keys), r["keys"], r.file_path) for r in ends), key=lambda e: [(known, value if known else 0) for known, value in e[0]])

    def after(self, cursor: Row | Sequence | None, size: int) -> DataFrame:
        """Rows behind a cursor, up to the end of the file that surely holds the next `size` keys."""
        near = self.rows.where(behind(self.keys, cursor))
        at = None if cursor is None else tuple((v is not None, v) for v in cursor)
        ahead = [e for e in self.ends if at is None or e[0] > at]
        sure = 0
        for k, (last, n, _) in enumerate(ahead):
            sure += n if k or at is None else 0  # of the cursor's own file no more than its end is known
            if sure >= size and k + 1 < len(ahead):
                bound = [v for _, v in last]
                first = F.lit(True) if bound[0] is None else F.col(self.keys[0]).isNull() | (F.col(self.keys[0]) <= F.lit(bound[0]))
                return near.where(first & ~behind(self.keys, bound))
        return near

    def pages(self, size: int) -> DataFrame:
        """All buckets (keys, edges, page), pages of `size` as buckets() gives them one behind another: a file's buckets are placed by one task, behind as many as the files before it hold."""
        spark, name = self.rows.sparkSession, "_metadata.file_path"
        before, firsts = 0, []
        for _, n, path in self.ends:
            firsts.append((path, before))
            before += n
        first = spark.createDataFrame(firsts, "file string, first long")
        grouped = self.rows.groupBy(F.col(name).alias("file"), *self.keys).agg(F.count("*").alias("edges"))
        place = F.row_number().over(W.partitionBy("file").orderBy(*[F.asc_nulls_first(k) for k in self.keys])) - 1
        placed = grouped.withColumn("place", place).join(F.broadcast(first), "file")
        return placed.select(*self.keys, "edges", F.floor((F.col("first") + F.col("place")) / size).cast("int").alias("page"))


def buckets(rows: DataFrame | Stored, keys: Sequence[str], after: Row | Sequence | None = None, size: int = BUCKETS) -> DataFrame:
    """The next `size` distinct keys behind a cursor, in order, and the rows of each."""
    near = rows.after(after, size) if isinstance(rows, Stored) else rows.where(behind(keys, after))
    return near.groupBy(*keys).agg(F.count("*").alias("edges")).orderBy(*[F.asc_nulls_first(k) for k in keys]).limit(size)


def harvest(fetch: Callable[[tuple | None], DataFrame], layers: DataFrame, size: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(cells, layers with a state) of all pages that `fetch` gives for a cursor, as (layer_id, ord, ipix, edges) each.

    Every page is written as it comes. A layer is committed only when all its pages came and each of its cells is valid:
    a page that can't be had fails the layers of the cursor and behind, an invalid cell its own layer, and a layer that
    counts edges (`layers`: layer_id, edges) but has no cell is failed too. Cells of failed layers are not given.
    """
    spark = layers.sparkSession
    kind = f"layer_id {layers.schema['layer_id'].dataType.simpleString()}, ord int, ipix long, edges long, page int"
    folder, after, page, broken = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", None, 0, None
    while True:
        try:
            fetch(after).withColumn("page", F.lit(page)).write.parquet(f"{folder}/page-{page:06d}")
        except Exception as e:  # the layers behind the cursor are failed, what came before stays
            broken = str(e).splitlines()[0][:200] or type(e).__name__
            delete(spark, f"{folder}/page-{page:06d}")
            break
        came = spark.read.schema(kind).parquet(f"{folder}/page-{page:06d}").agg(F.count("*").alias("n"), F.max(F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)).alias(k) for k in CELL_KEY])).alias("last")).first()
        if came.n:
            last = tuple(came.last[k][1] for k in CELL_KEY)
            if last == after:
                raise ValueError("the cursor did not advance")
            after = last
        page += 1
        if came.n < size:
            break
    cells = spark.read.schema(kind).parquet(*[f"{folder}/page-{k:06d}" for k in range(page)]) if page else spark.createDataFrame([], kind)
    return _committed(cells, layers, broken, after)


def harvest_stored(stored: Stored, layers: DataFrame, size: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """As harvest() of buckets(), with all pages of stored rows made and written side by side: their number costs no pass."""
    return _committed(materialize(stored.pages(size), "pages"), layers, None, None)


def _committed(cells: DataFrame, layers: DataFrame, broken: str | None, after: tuple | None) -> tuple[DataFrame, DataFrame]:
    """Cells of the layers whose pages all came and whose cells are valid, and all layers with their state."""
    valid = F.col("ord").between(0, hpx.MAX_ORDER) & (F.col("ipix") >= 0) & (F.col("ipix") < 12 * F.pow(F.lit(4.0), "ord"))
    per = cells.groupBy("layer_id").agg(F.count("*").alias("cells"), F.bool_and(F.coalesce(valid, F.lit(False))).alias("valid"))
    cut = F.lit(False) if broken is None else F.lit(True) if after is None else F.col("layer_id") >= F.lit(after[0])
    state = (
        F.when(cut, F.lit(f"failed: {broken}")).when(~F.col("valid"), "failed: invalid cell")
        .when((F.col("counted") > 0) & F.col("cells").isNull(), "failed: no cells").otherwise("committed")
    )
    judged = layers.select("layer_id", F.col("edges").alias("counted")).join(per, "layer_id", "left").withColumn("state", state)
    judged = materialize(judged.select("layer_id", F.when(F.col("state") == "committed", F.coalesce("cells", F.lit(0))).otherwise(0).alias("cells"), "state"), "harvested")
    return cells.join(judged.where("state = 'committed'").select("layer_id"), "layer_id", "left_semi").select(*CELL_KEY, "edges"), judged


def edge_page(edges: DataFrame | Stored, after: Row | Sequence | None = None, size: int = EDGES, excluded: DataFrame | None = None) -> tuple[DataFrame, tuple | None, list]:
    """(edges, cursor, cut): the next `size` edges in key order; the cursor of the page behind, None if there is none; and
    the file that the page's end cuts in two, if any. Files of `excluded` (file_id) are passed over."""
    rows = edges.after(after, size + 1) if isinstance(edges, Stored) and excluded is None else (edges.rows if isinstance(edges, Stored) else edges).where(behind(EDGE_KEY, after))
    if excluded is not None:
        rows = rows.join(excluded.select("file_id").distinct(), "file_id", "left_anti")
    order = [F.asc_nulls_first(k) for k in EDGE_KEY]
    ends = materialize(rows.orderBy(*order).limit(size + 1), "edge-page")
    behind_it = ends.orderBy(*order).offset(size - 1).limit(2).collect()
    page = ends.orderBy(*order).limit(size)
    if len(behind_it) < 2:
        return page, None, []
    last, over = behind_it
    return page, tuple(last[k] for k in EDGE_KEY), [last.file_id] if last.file_id == over.file_id else []
