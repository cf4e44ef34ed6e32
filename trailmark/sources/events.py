"""Points from the `events` table: integer hashing into a fixed box, so that every engine can repeat it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.functions import norm_lat, norm_lon


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, timestamp_sec, lon, lat, pid; reads three columns of the table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    lon = (F.lit(-88000) + (i * 7919 + u * 104729) % 3001) / F.lit(10000.0)
    lat = (F.lit(410000) + (i * 6101 + u * 15485863) % 3001) / F.lit(10000.0)
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        u.cast("int").alias("oid"), seconds.cast("int").alias("timestamp_sec"),
        norm_lon(lon).alias("lon"), norm_lat(lat).alias("lat"), i.alias("pid"),
    )
