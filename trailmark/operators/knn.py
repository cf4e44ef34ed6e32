"""k nearest points to query points, by squared grid distance; ties go to the lower pid."""

from pyspark.sql import DataFrame, Window, functions as F

from trailmark.functions import dist2, max_dist2, min_dist2
from trailmark.operators.filters import maybe_broadcast
from trailmark.operators.rounds import materialised

_BOX = {n: n for n in ("lon_min", "lon_max", "lat_min", "lat_max")}


def knn(points: DataFrame, lon: int, lat: int, k: int) -> DataFrame:
    """A top-k in each partition and one merge of k rows from each; no full sort."""
    return points.withColumn("distance", dist2("lon", "lat", F.lit(lon), F.lit(lat))).orderBy("distance", "pid").limit(k)


def knn_pruned(points: DataFrame, segments: DataFrame, lon: int, lat: int, k: int) -> DataFrame:
    """The same rows as knn, reading only segments that can hold one of them.

    Segments in order of their farthest corner hold k points at some distance; no farther segment can matter.
    """
    near = (segments.where("n > 0").select("n", max_dist2(F.lit(lon), F.lit(lat), _BOX).alias("far"))
            .orderBy("far").limit(k))  # k segments have k points at least
    w = Window.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    bound = near.withColumn("have", F.sum("n").over(w)).where(F.col("have") >= k).agg(F.min("far").alias("bound"))
    keep = (segments.crossJoin(F.broadcast(bound))  # one row
            .where(F.col("bound").isNull() | (min_dist2(F.lit(lon), F.lit(lat), _BOX) <= F.col("bound"))).select("block_id", "seg_id"))
    return knn(points.join(keep, ["block_id", "seg_id"], "left_semi"), lon, lat, k)


def knn_in_matching_blocks(points: DataFrame, index: DataFrame, lon: int, lat: int, k: int) -> DataFrame:
    """Approximate: only blocks whose bounds hold the query point; the answer depends on the layout."""
    hit = index.where((F.col("lon_min") <= lon) & (F.col("lon_max") >= lon) & (F.col("lat_min") <= lat) & (F.col("lat_max") >= lat))
    return knn(points.join(hit.select("block_id"), "block_id", "left_semi"), lon, lat, k)


CELLS = 128


def knn_batch(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Top k of each query.

    Points are counted over a grid of at most 129 x 129 cells. For each query, cells in order of their farthest corner hold k points at
    some distance, and only cells that reach nearer are read: an equi-join of points and cells. The grid and, if they are counted as few, the cells of the
    queries are broadcast.
    """
    low_x, high_x, low_y, high_y = points.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    low_x, low_y = low_x or 0, low_y or 0
    w, h = ((high_x or 0) - low_x) // CELLS + 1, ((high_y or 0) - low_y) // CELLS + 1
    cell = [F.expr(f"(lon - {low_x}) div {w}").alias("cx"), F.expr(f"(lat - {low_y}) div {h}").alias("cy")]
    grid = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    grid = grid.select("*", (F.col("cx") * w + low_x).alias("lon_min"), (F.col("cx") * w + low_x + w - 1).alias("lon_max"),
                       (F.col("cy") * h + low_y).alias("lat_min"), (F.col("cy") * h + low_y + h - 1).alias("lat_max"))
    q = queries.select("qid", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "k")
    seen = q.crossJoin(F.broadcast(grid)).withColumn("far", max_dist2("q_lon", "q_lat", _BOX)).withColumn("near", min_dist2("q_lon", "q_lat", _BOX))
    nearest = Window.partitionBy("qid").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)  # a query's cells
    seen = seen.withColumn("enough", F.when(F.sum("n").over(nearest) >= F.col("k"), F.col("far")))
    bound = F.min("enough").over(Window.partitionBy("qid"))
    seen = materialised(seen.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("qid", "q_lon", "q_lat", "k", "cx", "cy"))
    rows = points.select("*", *cell).join(maybe_broadcast(seen, seen.count()), ["cx", "cy"])
    scored = rows.withColumn("distance", dist2("lon", "lat", "q_lon", "q_lat"))
    most = queries.agg(F.max("k")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "pid"))
    return (scored.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") <= F.col("k"))
            .select("qid", "rank", "oid", "timestamp_sec", "lon", "lat", "pid", "distance"))
