"""Closest pairs and nearest-neighbour joins over a grid of cells, exact at any cell size."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.functions import dist2
from trailmark.operators.rounds import materialised


def _neighbours(points: DataFrame, width: int) -> DataFrame:
    """Each point once for each of the nine cells around its own."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return (points.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
            .withColumn("cx", F.expr(f"lon div {width}") + F.col("dx")).withColumn("cy", F.expr(f"lat div {width}") + F.col("dy")).drop("dx", "dy"))


def _in_cells(points: DataFrame, width: int) -> DataFrame:
    return points.withColumn("cx", F.expr(f"lon div {width}")).withColumn("cy", F.expr(f"lat div {width}"))


COARSE = 128


def _extent(points: DataFrame) -> tuple[int, float, float]:
    """Points, span and the sum over coarse cells of n * n / area: how dense it is where the points are."""
    r = points.agg(F.count(F.lit(1)), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if not r[0]:
        return 0, 1, 1.0
    span = max(r[2] - r[1], r[4] - r[3]) + 1
    side = -(-span // COARSE)
    cell = [F.expr(f"(lon - {r[1]}) div {side}"), F.expr(f"(lat - {r[3]}) div {side}")]
    square = points.groupBy(*cell).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    return r[0], span, square / (side * side)


def _first_of_places(points: DataFrame, k: int) -> DataFrame:
    """At most k + 1 points of one place, the lowest: more of them can't be among the k nearest of a point."""
    place = Window.partitionBy("lon", "lat").orderBy("pid")
    return points.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1).drop("r")


def closest_pairs(points: DataFrame, k: int, extra: Column | None = None) -> DataFrame:
    """The k closest pairs pid_1 < pid_2 by (distance, pid_1, pid_2). `extra` may compare p1.* and p2.* columns.

    Cells are so wide that about 4k pairs are expected within one width, given how dense the points lie where they are; the width
    doubles until k pairs lie within it. Each round's k rows are kept, not computed again. Without `extra`, more than k+1 points
    of one place can't matter and are cut beforehand.
    """
    n, span, density = _extent(points)
    cols = ["oid", "timestamp_sec", "lon", "lat", "pid"]
    points = points.select(*cols)
    if extra is None:
        points = _first_of_places(points, k)
    width = max(1, math.ceil(math.sqrt(8 * k / (math.pi * density))))
    while True:
        a, b = _in_cells(points, width).alias("p1"), _neighbours(points, width).alias("p2")
        cond = (F.col("p1.cx") == F.col("p2.cx")) & (F.col("p1.cy") == F.col("p2.cy")) & (F.col("p1.pid") < F.col("p2.pid"))
        pairs = a.join(b, cond if extra is None else cond & extra)
        pairs = pairs.select(dist2("p1.lon", "p1.lat", "p2.lon", "p2.lat").alias("distance"), F.col("p1.pid").alias("pid_1"), F.col("p2.pid").alias("pid_2"),
                             F.col("p1.oid").alias("oid_1"), F.col("p2.oid").alias("oid_2"))
        top = materialised(pairs.orderBy("distance", "pid_1", "pid_2").limit(k))  # k rows
        if width > span or top.where(F.col("distance") <= width * width).count() >= k:
            return top
        width *= 2


def knn_join(points: DataFrame, k: int, min_gap_sec: int | None = None) -> DataFrame:
    """The k nearest other points of every point, by (distance, pid); with min_gap_sec, only those further than
    that in time. A point is done once its k-th neighbour is within one cell width; the rest try cells four times as wide.

    The first cells suit the places where most points lie, so that dense cells hold few. Rows found and rows left
    are checkpointed in each round, and the rounds end when none is left. Without min_gap_sec, only the k+1 lowest points of a place are
    candidates.
    """
    n, span, density = _extent(points)
    points = materialised(points.select("pid", "lon", "lat", "timestamp_sec"))
    near = points if min_gap_sec is not None else materialised(_first_of_places(points, k))
    width = max(1, math.ceil(math.sqrt((k + 1) * max(n, 1) / density)))
    left, found = points, []
    while True:
        last = width > span
        a, b = _neighbours(left, width).alias("p1"), _in_cells(near, width).alias("p2")
        cond = (F.col("p1.cx") == F.col("p2.cx")) & (F.col("p1.cy") == F.col("p2.cy")) & (F.col("p1.pid") != F.col("p2.pid"))
        if min_gap_sec is not None:
            cond &= F.abs(F.col("p1.timestamp_sec") - F.col("p2.timestamp_sec")) > min_gap_sec
        d = a.join(b, cond).select(F.col("p1.pid").alias("pid"), F.col("p2.pid").alias("near_pid"), dist2("p1.lon", "p1.lat", "p2.lon", "p2.lat").alias("distance"))
        order = Window.partitionBy("pid").orderBy("distance", "near_pid")
        top = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not last:
            whole = Window.partitionBy("pid")
            top = top.withColumn("far", F.max("distance").over(whole)).withColumn("have", F.max("rank").over(whole))
            top = top.where((F.col("have") == k) & (F.col("far") <= width * width)).drop("far", "have")
        top = materialised(top.select("pid", "rank", "near_pid", "distance"))
        found.append(top)
        if last:
            break
        left = materialised(left.join(top.where("rank = 1").select("pid"), "pid", "left_anti"))
        if not left.head(1):
            break
        width *= 4
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
