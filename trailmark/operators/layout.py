"""Layouts: rows get a block and a segment number; block index and segment metadata follow by aggregation.

Windows are over chunks of the row number, never over the whole table.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.functions import bloom_bits, z2, z3
from trailmark.schema import CHUNK_BLOCKS, POINT_BYTES, POINTS_PER_BLOCK, SEGMENTS_PER_BLOCK

# Fixed values of the sort keys: seconds of a time slot, bits of a space cell, seconds of a fine slot, of a week.
TIME_SLOT = 300
SPACE_SHIFT = 11
FINE_SLOT = 5
WEEK = 604800


def time_oid_key() -> list[Column]:
    return [F.col("oid").asc(), F.col("timestamp_sec").desc(), F.col("pid").asc()]


def zorder_key(option: str = "space") -> list[Column]:
    """space: 2-D curve; time_preferred: 5-minute slots, then the curve; space_preferred: coarse cells, then
    time; no_preference: 3-D curve; space_time: 3-D curve on raw seconds."""
    curve = z2("lon", "lat")
    keys = {
        "space": [curve],
        "time_preferred": [F.expr(f"timestamp_sec div {TIME_SLOT}"), curve],
        "space_preferred": [F.shiftright(curve, SPACE_SHIFT), F.col("timestamp_sec")],
        "no_preference": [z3("lon", "lat", F.expr(f"timestamp_sec div {FINE_SLOT}"))],
        "space_time": [z3("lon", "lat", "timestamp_sec")],
    }[option]
    return [*keys, F.col("pid")]


def _cut(ranked: DataFrame, first_block: Column, capacity: int, segments: int) -> DataFrame:
    """rn counts from 1 in the chunk; the last segment of a block takes what the equal split leaves."""
    slot = (F.col("rn") - 1) % capacity
    return (ranked.withColumn("block_id", (first_block + F.expr(f"(rn - 1) div {capacity}")).cast("long"))
            .withColumn("seg_id", F.least(F.floor(slot / (capacity // segments)), F.lit(segments - 1)).cast("int")))


def _chunked(points: DataFrame, key: list[Column], chunk_blocks: int, capacity: int, segments: int, block_offset: int) -> DataFrame:
    chunk = F.expr(f"pid div {chunk_blocks * capacity}")
    ranked = points.withColumn("chunk", chunk).withColumn("rn", F.row_number().over(Window.partitionBy("chunk").orderBy(*key)))
    return _cut(ranked, F.col("chunk") * chunk_blocks + block_offset, capacity, segments).drop("chunk", "rn")


def layout_time_oid(points: DataFrame, per_block: bool = False, chunk_blocks: int = CHUNK_BLOCKS, capacity: int = POINTS_PER_BLOCK,
                    segments: int = SEGMENTS_PER_BLOCK, block_offset: int = 0) -> DataFrame:
    """By object, newest first, in chunks; with per_block rows stay in arrival blocks and are ordered inside."""
    return _chunked(points, time_oid_key(), 1 if per_block else chunk_blocks, capacity, segments, block_offset)


def layout_zorder(points: DataFrame, option: str = "space", chunk_blocks: int = CHUNK_BLOCKS, capacity: int = POINTS_PER_BLOCK,
                  segments: int = SEGMENTS_PER_BLOCK, block_offset: int = 0) -> DataFrame:
    return _chunked(points, zorder_key(option), chunk_blocks, capacity, segments, block_offset)


def layout_sorted(points: DataFrame, by: str, chunk_blocks: int = CHUNK_BLOCKS, capacity: int = POINTS_PER_BLOCK, segments: int = SEGMENTS_PER_BLOCK) -> DataFrame:
    """By one of lon, lat and timestamp_sec, in chunks."""
    return _chunked(points, [F.col(by), F.col("pid")], chunk_blocks, capacity, segments, 0)


def split_by_size(laid_out: DataFrame, size: int, key: list[Column]) -> DataFrame:
    """Segments of `size` points in each block, in the order of the key; the last one of a block may be smaller."""
    rn = F.row_number().over(Window.partitionBy("block_id").orderBy(*key))
    return laid_out.withColumn("seg_id", F.floor((rn - 1) / size).cast("int"))


def layout_str(points: DataFrame, capacity: int = POINTS_PER_BLOCK, segments: int = SEGMENTS_PER_BLOCK) -> DataFrame:
    """Sort-tile-recursive packing of each week: slices by longitude, blocks by latitude, 3-D curve inside.

    Block numbers are dense: each slice starts after the blocks of all slices before it, which comes from a
    table with a row for each slice.
    """
    week = points.withColumn("week", F.expr(f"timestamp_sec div {WEEK}"))
    n = week.groupBy("week").agg(F.count(F.lit(1)).alias("n_week"))
    tiles = F.ceil(F.sqrt(F.ceil(F.col("n_week") / capacity)))
    by_lon = Window.partitionBy("week").orderBy("lon", "pid")
    cut = (week.withColumn("r", F.row_number().over(by_lon)).join(n, "week")
           .withColumn("tile", F.floor((F.col("r") - 1) / (tiles * capacity)).cast("int")))
    by_lat = Window.partitionBy("week", "tile").orderBy("lat", "pid")
    cut = cut.withColumn("in_tile", F.floor((F.row_number().over(by_lat) - 1) / capacity).cast("int"))
    per_tile = n.withColumn("tiles", tiles.cast("int")).withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    size = F.greatest(F.lit(0), F.least(F.col("tiles") * capacity, F.col("n_week") - F.col("tile") * F.col("tiles") * capacity))
    per_tile = per_tile.withColumn("blocks", F.ceil(size / capacity))
    before = F.sum("blocks").over(Window.orderBy("week", "tile").rowsBetween(Window.unboundedPreceding, -1))
    first = per_tile.select("week", "tile", F.coalesce(before, F.lit(0)).alias("first"))
    inside = Window.partitionBy("block_id").orderBy(z3("lon", "lat", "timestamp_sec"), "pid")
    out = cut.join(first, ["week", "tile"]).withColumn("block_id", (F.col("first") + F.col("in_tile")).cast("long")).withColumn("rn", F.row_number().over(inside))
    seg = F.least(F.floor((F.col("rn") - 1) / (capacity // segments)), F.lit(segments - 1)).cast("int")
    return out.withColumn("seg_id", seg).drop("week", "tile", "n_week", "r", "in_tile", "first", "rn")


def _bounds() -> list[Column]:
    names = {"lon": "lon", "lat": "lat", "timestamp_sec": "time"}
    return [f(c).alias(f"{short}_{end}") for c, short in names.items() for f, end in ((F.min, "min"), (F.max, "max"))]


def block_index(laid_out: DataFrame) -> DataFrame:
    """Bounds and distinct objects of each block; a block has at most its capacity of them."""
    return laid_out.groupBy("block_id").agg(*_bounds(), F.sort_array(F.collect_set("oid")).alias("oids"))


def segment_meta(laid_out: DataFrame) -> DataFrame:
    """Bounds, row count, bytes and Bloom filter of each segment."""
    low, high = bloom_bits("oid")
    return (laid_out.groupBy("block_id", "seg_id")
            .agg(*_bounds(), F.count(F.lit(1)).alias("n"), F.bit_or(low).alias("bloom_lo"), F.bit_or(high).alias("bloom_hi"))
            .withColumn("seg_size", F.col("n") * POINT_BYTES))
