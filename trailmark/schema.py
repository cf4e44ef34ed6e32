"""Types and page-geometry constants of the point model."""

from pyspark.sql import types as T

# Fixed values of the storage model: coordinate grid, page size, segments of a page.
GRID = 1 << 24
BLOCK_BYTES = 4096
SEGMENTS_PER_BLOCK = 12
POINT_BYTES = 16
HEADER_BYTES = 8
SEGMENT_META_BYTES = 48
BLOOM_BITS = 128
CHUNK_BLOCKS = 8192


def block_capacity(block_bytes: int = BLOCK_BYTES, segments: int = SEGMENTS_PER_BLOCK) -> int:
    """Points that fit a page beside its header and segment directory."""
    return (block_bytes - HEADER_BYTES - SEGMENT_META_BYTES * segments) // POINT_BYTES


def block_bytes_for(points: int, segments: int = SEGMENTS_PER_BLOCK) -> int:
    """Smallest whole number of 4 KiB pages that holds so many points."""
    need = HEADER_BYTES + SEGMENT_META_BYTES * segments + POINT_BYTES * points
    return -(-need // 4096) * 4096


POINTS_PER_BLOCK = block_capacity()

POINT = T.StructType(
    [
        T.StructField("oid", T.IntegerType()),
        T.StructField("timestamp_sec", T.IntegerType()),
        T.StructField("lon", T.IntegerType()),
        T.StructField("lat", T.IntegerType()),
        T.StructField("pid", T.LongType()),
    ]
)
