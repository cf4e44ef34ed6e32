"""Range and object-and-time filters, singly and over a table of predicates, with block pruning."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


# Rows of a query table (under 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Box:
    """A closed range in time and on both axes."""

    time_min: int
    time_max: int
    lon_min: int
    lon_max: int
    lat_min: int
    lat_max: int


def in_box(q: Box) -> Column:
    return (F.col("lon").between(q.lon_min, q.lon_max) & F.col("lat").between(q.lat_min, q.lat_max)
            & F.col("timestamp_sec").between(q.time_min, q.time_max))


def box_overlaps(q: Box) -> Column:
    """For rows that carry bounds: blocks or segments."""
    return ((F.col("time_max") >= q.time_min) & (F.col("time_min") <= q.time_max) & (F.col("lon_max") >= q.lon_min)
            & (F.col("lon_min") <= q.lon_max) & (F.col("lat_max") >= q.lat_min) & (F.col("lat_min") <= q.lat_max))


def st_range(points: DataFrame, q: Box) -> DataFrame:
    """Points in a box; over Parquet the six comparisons reach the scan."""
    return points.where(in_box(q))


def id_temporal(points: DataFrame, oid: int, time_min: int, time_max: int) -> DataFrame:
    return points.where((F.col("oid") == oid) & F.col("timestamp_sec").between(time_min, time_max))


def prune_blocks(points: DataFrame, matching: DataFrame, keys: tuple = ("block_id",)) -> DataFrame:
    """Keeps the blocks (or segments) named by `matching`. Spark broadcasts that side only if it measures small."""
    return points.join(matching.select(*keys).distinct(), list(keys), "left_semi")


def id_temporal_indexed(points: DataFrame, index: DataFrame, oid: int, time_min: int, time_max: int) -> DataFrame:
    """id_temporal over the blocks whose list of objects holds the object and whose times overlap."""
    hit = index.where(F.array_contains("oids", oid) & (F.col("time_max") >= time_min) & (F.col("time_min") <= time_max))
    return id_temporal(prune_blocks(points, hit), oid, time_min, time_max)


def block_ranges(blocks: DataFrame, most: int = 64) -> Column:
    """A filter on block_id of at most `most` ranges that hold all the blocks: over Parquet it reaches the scan."""
    low, high = blocks.agg(F.min("block_id"), F.max("block_id")).first()
    if low is None:
        return F.lit(False)
    width = (high - low) // most + 1
    part = F.expr(f"(block_id - {low}) div {width}").alias("part")
    out = F.lit(False)
    for r in blocks.groupBy(part).agg(F.min("block_id").alias("a"), F.max("block_id").alias("z")).collect():  # `most` rows
        out |= F.col("block_id").between(r["a"], r["z"])
    return out


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a table of a counted, small number of narrow rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def st_range_batch(points: DataFrame, queries: DataFrame) -> DataFrame:
    """qid and the points of each query: an equi-join on tiles of the plane. A tile is an eighth of the widest box, so a query
    lies in at most 81 of them and a point in one; the queries are broadcast if they are counted as few."""
    n, dx, dy = queries.agg(F.count(F.lit(1)), F.max(F.col("lon_max") - F.col("lon_min")), F.max(F.col("lat_max") - F.col("lat_min"))).first()
    w, h = max(1, (dx or 0) // 8 + 1), max(1, (dy or 0) // 8 + 1)
    tiles = lambda axis, size: F.explode(F.expr(f"CASE WHEN {axis}_min <= {axis}_max THEN sequence({axis}_min div {size}, {axis}_max div {size}) END"))
    queries = maybe_broadcast(queries.withColumn("tx", tiles("lon", w)).withColumn("ty", tiles("lat", h)), 81 * n)
    p, q = points.withColumn("tx", F.expr(f"lon div {w}")).withColumn("ty", F.expr(f"lat div {h}")).alias("p"), queries.alias("q")
    cond = ((F.col("p.tx") == F.col("q.tx")) & (F.col("p.ty") == F.col("q.ty")) & F.col("p.timestamp_sec").between(F.col("q.time_min"), F.col("q.time_max"))
            & F.col("p.lon").between(F.col("q.lon_min"), F.col("q.lon_max"))
            & F.col("p.lat").between(F.col("q.lat_min"), F.col("q.lat_max")))
    return p.join(q, cond).select("q.qid", "p.*").drop("tx", "ty")


def id_temporal_batch(points: DataFrame, queries: DataFrame) -> DataFrame:
    """qid and the points of each query: an equi-join on the object with a time condition."""
    p, q = points.alias("p"), queries.alias("q")
    cond = (F.col("p.oid") == F.col("q.oid")) & F.col("p.timestamp_sec").between(F.col("q.time_min"), F.col("q.time_max"))
    return p.join(q, cond).select("q.qid", "p.*")
