"""Objects in depth: quality policy, duplicates, distances, and (cell, radial bin) voxels."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.plans.scratch import materialize

#: Cosmology, redshift step and largest redshift of the distance table, and the voxel budget.
H0, OMEGA_M, STEP, Z_MAX, VOXELS = 67.66, 0.30966, 0.001953125, 2.0, 32_768
LIGHT = 299_792.458
REASONS = ("missingIdentity", "invalidCoordinate", "missingRedshift", "lowOrNegativeRedshift", "outsideModelRange", "qualityOrClass", "unknownRedshiftFrame")


def distance_nodes(step: float = STEP, z_max: float = Z_MAX, h0: float = H0, omega_m: float = OMEGA_M) -> list[float]:
    """Comoving distance in Mpc at every step of redshift: Simpson's rule over a flat universe without radiation."""
    slowness = lambda z: 1 / math.sqrt(omega_m * (1 + z) ** 3 + 1 - omega_m)
    out = [0.0]
    for k in range(round(z_max / step)):
        a, b = k * step, (k + 1) * step
        out.append(out[-1] + LIGHT / h0 * step / 6 * (slowness(a) + 4 * slowness((a + b) / 2) + slowness(b)))
    return out


def distance_table(spark: SparkSession, nodes: list[float]) -> DataFrame:
    """(node, low, high): the distance at each node and at the next, 1,024 rows with the standard nodes."""
    return spark.createDataFrame(pa.table({"node": pa.array(range(len(nodes) - 1), pa.int32()), "low": nodes[:-1], "high": nodes[1:]}))


def with_distance(objects: DataFrame, z: str = "z", nodes: list[float] | None = None, step: float = STEP, error: str | None = None) -> DataFrame:
    """`objects` with `distance` in Mpc, by linear interpolation between nodes; null outside the table (never extrapolated).

    With `error`, the column of the redshift's error, also `distance_error`: half of the distance from z - error to
    z + error, null unless both ends lie inside the table and the error isn't negative.
    """
    nodes = distance_nodes() if nodes is None else nodes
    table, last = F.broadcast(distance_table(objects.sparkSession, nodes)), len(nodes) - 1

    def placed(df: DataFrame, at: Column, name: str) -> DataFrame:
        inside = (at >= 0) & (at <= step * last)
        out = df.withColumn("__node", F.when(inside, F.least(F.floor(at / step), F.lit(last - 1)).cast("int")))
        out = out.join(table, out["__node"] == table["node"], "left")
        return out.withColumn(name, F.col("low") + (F.col("high") - F.col("low")) * (at / step - F.col("__node"))).drop("__node", "node", "low", "high")

    out = placed(objects, F.col(z), "distance")
    if error is not None:
        sound = F.col(error) >= 0
        out = placed(out, F.when(sound, F.col(z) - F.col(error)), "__near")
        out = placed(out, F.when(sound, F.col(z) + F.col(error)), "__far")
        out = out.withColumn("distance_error", (F.col("__far") - F.col("__near")) / 2).drop("__near", "__far")
    return out


def reject_reason(min_z: float = 0.001, max_z: float = Z_MAX) -> Column:
    """The first reason against a row, in a fixed order; null if none."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    return (
        F.when(F.col("object_id").isNull() | (F.col("object_id") == ""), REASONS[0])
        .when(bad("ra") | bad("dec") | (F.col("ra") < 0) | (F.col("ra") >= 360) | (F.abs("dec") > 90), REASONS[1])
        .when(bad("z"), REASONS[2]).when(F.col("z") <= min_z, REASONS[3]).when(F.col("z") > max_z, REASONS[4])
        .when((F.col("zwarn") != 0) | (F.col("spectype") != "GALAXY"), REASONS[5]).when(F.col("frame") != "heliocentric", REASONS[6])
    )


def one_of_each(objects: DataFrame, key: str, *same: str) -> DataFrame:
    """One row a key (its smallest source_row); keys whose rows differ in `same` lose all rows. Pre-aggregated, no window."""
    facts = F.struct(*[F.col(c) for c in same])
    grouped = objects.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in objects.columns if c != key]), "source_row").alias("r"), F.min(facts).alias("lo"), F.max(facts).alias("hi"))
    return grouped.where("lo = hi").select(key, "r.*")


def _ends(points: DataFrame, value: str) -> tuple[float | None, float | None]:
    r = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return r.lo, r.hi


def voxels(points: DataFrame, order: int, bins: int = 64, value: str = "distance", ends: tuple[float | None, float | None] | None = None) -> DataFrame:
    """(pixel, bin, count, radial_min, radial_max, radial_mean) over the range of all points; min and max are the bin's edges."""
    return _shown(_binned(points, order, bins, value, _ends(points, value) if ends is None else ends), order, order)


def _binned(points: DataFrame, order: int, bins: int, value: str, ends: tuple[float | None, float | None]) -> DataFrame:
    """(pixel, bin, count, total, lo, width): the one aggregation over points, at the finest order asked for."""
    lo, hi = (F.lit(x).cast("double") for x in ends)
    at = F.when(hi > lo, F.least(F.greatest(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    cell = hpx.ang2pix(order, F.col("ra"), F.col("dec"))
    found = points.groupBy(cell.alias("pixel"), at.cast("int").alias("bin")).agg(F.count("*").alias("count"), F.sum(value).alias("total"))
    return found.withColumns({"lo": lo, "width": (hi - lo) / bins})


def _shown(binned: DataFrame, finest: int, order: int) -> DataFrame:
    """Voxels at `order` from those at a finer one: bins are the same, so counts and sums add up by parent."""
    if order < finest:
        binned = binned.groupBy(hpx.parent(F.col("pixel"), finest - order).alias("pixel"), "bin", "lo", "width").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return binned.select("pixel", "bin", "count", low.alias("radial_min"), (low + F.col("width")).alias("radial_max"), (F.col("total") / F.col("count")).alias("radial_mean"))


def extents(points: DataFrame, order: int, value: str = "distance") -> DataFrame:
    """Each cell's farthest value and count."""
    return points.groupBy(hpx.ang2pix(order, F.col("ra"), F.col("dec")).alias("pixel")).agg(F.max(value).alias("radial_max"), F.count("*").alias("count"))


def densest(points: DataFrame, order: int = 4) -> DataFrame:
    """The cell with most points; of equals the smallest."""
    return points.groupBy(hpx.ang2pix(order, F.col("ra"), F.col("dec")).alias("pixel")).count().orderBy(F.desc("count"), "pixel").limit(1)


def adaptive_voxels(points: DataFrame, selection_order: int, budget: int = VOXELS, bins: int = 64, value: str = "distance", ends: tuple[float | None, float | None] | None = None) -> tuple[int | None, DataFrame | None]:
    """(order, voxels) of the finest of selection order + 4, + 2, + 0 (none beyond the finest order) whose voxels fit the budget; None if none does.

    Points are read once: their voxels at the finest order are written, and the coarser orders' are counted from them.
    """
    orders = list(dict.fromkeys(min(hpx.MAX_ORDER, selection_order + more) for more in (4, 2, 0)))
    fine = materialize(_binned(points, orders[0], bins, value, _ends(points, value) if ends is None else ends), "voxels")
    many = [F.count_distinct(hpx.parent(F.col("pixel"), orders[0] - o), F.col("bin")).alias(f"n{o}") for o in orders[1:]]
    n = fine.agg(F.count("*").alias(f"n{orders[0]}"), *many).first()
    for order in orders:
        if n[f"n{order}"] <= budget:
            return order, _shown(fine, orders[0], order)
    return None, None


def adaptive_order(points: DataFrame, selection_order: int, budget: int = VOXELS, bins: int = 64) -> int | None:
    """The order that adaptive_voxels() chooses."""
    return adaptive_voxels(points, selection_order, budget, bins)[0]


#: Points shown one by one, and bars.
POINTS, BARS = 20_000, 4_000


def sky_depth(objects: DataFrame, selection_order: int, cells: DataFrame, budget: int = VOXELS) -> tuple[DataFrame, DataFrame | None]:
    """(status row, voxels) of the objects in the selected cells.

    The row counts objects, those accepted, and those with a distance, and says how they are shown: empty, points,
    voxels (with the order chosen) or over-budget, when no order fits and nothing partial is given.
    """
    here = objects.withColumn("cell", hpx.ang2pix(selection_order, F.col("ra"), F.col("dec"))).join(cells.select(F.col("ipix").alias("cell")).distinct(), "cell", "left_semi")
    judged = with_distance(here.withColumn("reason", reject_reason()).withColumn("__z", F.when(F.col("reason").isNull(), F.col("z"))), "__z").drop("__z")
    n = judged.agg(F.count("*").alias("objects"), F.count("z").alias("with_redshift"), F.count("distance").alias("with_distance"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).first()
    order, found = None, None
    if n.with_distance > POINTS:
        order, found = adaptive_voxels(judged.where("distance is not null"), selection_order, budget, ends=(n.lo, n.hi))
    status = "empty" if not n.with_distance else "points" if n.with_distance <= POINTS else "voxels" if order is not None else "over-budget"
    row = objects.sparkSession.createDataFrame([(n.objects, n.with_redshift, n.with_distance, status, order)], "objects long, with_redshift long, with_distance long, status string, order int")
    return row, found
