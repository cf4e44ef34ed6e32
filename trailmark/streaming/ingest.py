"""Continuous forms: appending arrivals to a store, and grid counts by event-time window."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators.layout import layout_zorder
from trailmark.operators.rounds import materialised
from trailmark.operators.store import TrailStore

BATCH_BLOCKS = 1 << 32


def append_points(points: DataFrame, path: str, checkpoint: str, option: str = "space") -> StreamingQuery:
    """Lays out each micro-batch and writes it as partition batch=N of the store's three tables, so that a batch that
    is run again replaces itself. Blocks of batch N are numbered from N * BATCH_BLOCKS; `TrailStore.open(path)` reads all."""
    def add(batch: DataFrame, n: int) -> None:
        batch = materialised(batch)
        if batch.head(1):
            least = batch.agg(F.min("pid")).first()[0]
            laid = layout_zorder(batch.withColumn("pid", F.col("pid") - least), option, block_offset=n * BATCH_BLOCKS)
            TrailStore.of(laid.withColumn("pid", F.col("pid") + least)).write(path, mode="overwrite", below=f"batch={n}")

    return points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def grid_stream(points: DataFrame, lon0: int, lat0: int, width: int, height: int, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and cell of a stream of points; rows later than the watermark are dropped."""
    at = points.withColumn("at", F.timestamp_seconds("timestamp_sec")).withWatermark("at", late)
    x, y = F.expr(f"(lon - {lon0}) div {width}"), F.expr(f"(lat - {lat0}) div {height}")
    return at.groupBy(F.window("at", window).alias("w"), x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
