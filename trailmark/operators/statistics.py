"""Estimates and diagnostics over block index and segment metadata."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailmark.functions import bloom_may_contain
from trailmark.operators.filters import Box, box_overlaps, prune_blocks, st_range
from trailmark.schema import BLOCK_BYTES, POINT_BYTES, POINTS_PER_BLOCK

# Range scores at or below these go to the device, id scores below the first.
GOODNESS_LIMIT = 0.3
OVERLAP_LIMIT = 0.35


def _bytes(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("seg_size"))), F.lit(0))


def _with_pages(size: Column) -> Column:
    return size + POINT_BYTES * F.floor(size / BLOCK_BYTES)


def estimate_range_bytes(segments: DataFrame, q: Box, blocks: DataFrame | None = None) -> DataFrame:
    """Bytes of the segments that overlap; with a block list, those blocks only, page headers added."""
    if blocks is None:
        return segments.agg(_bytes(box_overlaps(q)).alias("bytes"))
    return prune_blocks(segments, blocks).agg(_with_pages(_bytes(box_overlaps(q))).alias("bytes"))


def _id_overlap(oid: int, time_min: int, time_max: int, use_bloom: bool) -> Column:
    t = (F.col("time_max") >= time_min) & (F.col("time_min") <= time_max)
    return t & bloom_may_contain("bloom_lo", "bloom_hi", F.lit(oid)) if use_bloom else t


def estimate_id_bytes(segments: DataFrame, oid: int, time_min: int, time_max: int, use_bloom: bool = True, blocks: DataFrame | None = None) -> DataFrame:
    size = _bytes(_id_overlap(oid, time_min, time_max, use_bloom))
    if blocks is None:
        return segments.agg(size.alias("bytes"))
    return prune_blocks(segments, blocks).agg(_with_pages(size).alias("bytes"))


def block_count(index: DataFrame, q: Box) -> DataFrame:
    return index.where(box_overlaps(q)).agg(F.count(F.lit(1)).alias("blocks"))


def selectivity(points: DataFrame, index: DataFrame, q: Box, capacity: int = POINTS_PER_BLOCK) -> DataFrame:
    """Rows found over rows that the matching blocks can hold."""
    found = st_range(points, q).agg(F.count(F.lit(1)).alias("found"))
    return found.crossJoin(block_count(index, q)).select(
        "found", "blocks", F.try_divide(F.col("found").cast("double"), F.col("blocks") * F.lit(float(capacity))).alias("selectivity"))


def pruning_ratio(segments: DataFrame, index: DataFrame, q: Box) -> DataFrame:
    """Segments of the matching blocks, and how many of them must be read."""
    s = prune_blocks(segments, index.where(box_overlaps(q)))
    return s.agg(F.count(F.lit(1)).alias("total_segments"), F.count(F.when(box_overlaps(q), 1)).alias("checked_segments"))


def adaptive_route(segments: DataFrame, index: DataFrame, q: Box) -> DataFrame:
    """Both routing scores of each matching block, and where each would send it.

    goodness: share of its bytes in overlapping segments. overlap: share of its area in the box, times the whole
    number of times that its time span fits into the common span.
    """
    hit = index.where(box_overlaps(q))
    good = segments.groupBy("block_id").agg(
        (_bytes(box_overlaps(q)).cast("double") / F.sum("seg_size")).alias("goodness"))
    span = lambda lo, hi, a, b: (F.least(F.lit(hi), F.col(b)) - F.greatest(F.lit(lo), F.col(a))).cast("long")
    common = span(q.lon_min, q.lon_max, "lon_min", "lon_max") * span(q.lat_min, q.lat_max, "lat_min", "lat_max")
    area = (F.col("lon_max") - F.col("lon_min")).cast("long") * (F.col("lat_max") - F.col("lat_min"))
    time = F.when(F.col("time_max") > F.col("time_min"), F.floor(span(q.time_min, q.time_max, "time_min", "time_max") / F.nullif(F.col("time_max") - F.col("time_min"), F.lit(0))))
    overlap = F.coalesce(F.try_divide(common.cast("double"), area.cast("double")) * time, F.lit(0.0))
    to = lambda c, limit: F.when(F.col(c) <= limit, "device").otherwise("host")
    return (hit.join(good, "block_id").select("block_id", "goodness", overlap.alias("overlap"))
            .withColumns({"route_goodness": to("goodness", GOODNESS_LIMIT), "route_overlap": to("overlap", OVERLAP_LIMIT)}))


def adaptive_id_route(segments: DataFrame, index: DataFrame, oid: int, time_min: int, time_max: int) -> DataFrame:
    """Share of the bytes of each block that holds the object, at overlapping times, in segments that may hold it, and where
    the block would go: below the limit to the device."""
    hit = index.where(F.array_contains("oids", oid) & (F.col("time_max") >= time_min) & (F.col("time_min") <= time_max))
    good = segments.groupBy("block_id").agg((_bytes(_id_overlap(oid, time_min, time_max, True)).cast("double") / F.sum("seg_size")).alias("goodness"))
    route = F.when(F.col("goodness") < GOODNESS_LIMIT, "device").otherwise("host")
    return hit.join(good, "block_id").select("block_id", "goodness", route.alias("route"))


def block_runs(blocks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Runs of consecutive block numbers: first block and length.

    Islands are found inside ranges of `span` numbers in parallel; those that touch at a range's edge are then
    joined, over a table with a row for each island.
    """
    b = blocks.select(F.col("block_id").cast("long").alias("block_id")).distinct().withColumn("part", F.expr(f"block_id div {span}"))
    rn = F.row_number().over(Window.partitionBy("part").orderBy("block_id"))
    isles = b.withColumn("g", F.col("block_id") - rn).groupBy("part", "g").agg(F.min("block_id").alias("s"), F.max("block_id").alias("e"))
    whole = Window.orderBy("s")
    new = F.when(F.lag("e").over(whole) + 1 == F.col("s"), 0).otherwise(1)
    isles = isles.withColumn("new", new).withColumn("run", F.sum("new").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy("run").agg(F.min("s").alias("block_start"), (F.max("e") - F.min("s") + 1).alias("block_count")).drop("run")


def mbr_shape(index: DataFrame) -> DataFrame:
    """Mean extent of the blocks on each axis."""
    mean = lambda n: F.avg((F.col(f"{n}_max") - F.col(f"{n}_min")).cast("double")).alias(f"mean_{n}")
    return index.agg(mean("time"), mean("lon"), mean("lat"))


# Fixed values of the cost model. MB/s, seconds, Hz; cycles by block, by segment and by point.
BANDWIDTH = 767.42
DEVICE_START = 0.230631
HOST_HZ = 4 * 3600000000.0
DEVICE_HZ = 1200000000.0
MODEL_SEGMENTS = 10
MODEL_POINTS = 225
HOST_RANGE = (3196.0, 64.0, 59.0)
HOST_ID = (3312.0, 401.0, 40.0)
DEVICE_RANGE = (301.0, 25)
DEVICE_ID = (301.0, 31)


def cost_model(spark: SparkSession, blocks: int, steps: int = 10) -> DataFrame:
    """Modelled seconds of range and id queries on host and device, at selectivities 0, 1/steps .. 1."""
    s = F.col("step") / F.lit(float(steps))
    mb = blocks * float(BLOCK_BYTES) / (1024.0 * 1024.0)
    points = float(blocks * MODEL_POINTS)

    def host(c):
        return F.lit(mb / BANDWIDTH) + (F.lit(blocks * c[0] + blocks * MODEL_SEGMENTS * c[1]) + F.lit(points * c[2]) * s) / F.lit(HOST_HZ)

    def device(c):
        return F.lit(mb) * s / F.lit(BANDWIDTH) + (F.lit(blocks * c[0]) + F.lit(points * c[1]) * s) / F.lit(DEVICE_HZ) + F.lit(DEVICE_START)

    return spark.range(steps + 1).withColumnRenamed("id", "step").select(
        "step", *(F.round(f(c), 9).alias(n) for n, f, c in (("host_range", host, HOST_RANGE), ("device_range", device, DEVICE_RANGE), ("host_id", host, HOST_ID), ("device_id", device, DEVICE_ID))))
