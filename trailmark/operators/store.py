"""A laid-out point set as three Parquet tables: points, block index, segment metadata.

Pruned queries find the blocks in the small tables and pass them to the scan of the points as a few ranges of block numbers;
the exact filter follows in the same scan, so nothing is shuffled.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.functions import bloom_may_contain
from trailmark.operators.filters import Box, block_ranges, box_overlaps, id_temporal, st_range
from trailmark.operators.layout import block_index, segment_meta


@dataclass
class TrailStore:
    points: DataFrame
    index: DataFrame
    segments: DataFrame

    @classmethod
    def of(cls, laid_out: DataFrame) -> "TrailStore":
        return cls(laid_out, block_index(laid_out), segment_meta(laid_out))

    def write(self, path: str, mode: str = "errorifexists", partitions: int | None = None, below: str = "") -> None:
        """below: a partition folder of each table. Rows clustered by block, so that row-group statistics prune; Parquet Bloom filters on the object."""
        args = ([partitions] if partitions else []) + ["block_id"]
        (self.points.repartitionByRange(*args).sortWithinPartitions("block_id", "seg_id", "pid").write.mode(mode)
         .option("parquet.bloom.filter.enabled#oid", "true").option("parquet.bloom.filter.expected.ndv#oid", "100000").parquet(f"{path}/points/{below}"))
        self.index.write.mode(mode).parquet(f"{path}/block_index/{below}")
        self.segments.write.mode(mode).parquet(f"{path}/seg_meta/{below}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TrailStore":
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("points", "block_index", "seg_meta")))

    def blocks(self, first: int, count: int = 1) -> DataFrame:
        """A run of blocks; the range reaches the Parquet scan."""
        return self.points.where(f"block_id BETWEEN {int(first)} AND {int(first) + int(count) - 1}")

    def range(self, q: Box, prune: bool = True) -> DataFrame:
        points = self.points.where(block_ranges(self.segments.where(box_overlaps(q)))) if prune else self.points
        return st_range(points, q)

    def id_temporal(self, oid: int, time_min: int, time_max: int, prune: bool = True) -> DataFrame:
        hit = self.segments.where((F.col("time_max") >= time_min) & (F.col("time_min") <= time_max) & bloom_may_contain("bloom_lo", "bloom_hi", F.lit(oid)))
        points = self.points.where(block_ranges(hit)) if prune else self.points
        return id_temporal(points, oid, time_min, time_max)

    def total_points(self) -> int:
        return self.points.count()
