"""Query workloads as predicate tables, from CSV or from Python values."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trailmark.functions import norm_lat, norm_lon, to_epoch
from trailmark.sources.points_csv import with_row_numbers


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return with_row_numbers(spark.read.schema(schema).csv(path, header=False), "qid")


def _time(name: str, datetimes: bool):
    return to_epoch(name) if datetimes else F.col(name).try_cast("int")


def read_id_queries(spark: SparkSession, path: str, datetimes: bool = False) -> DataFrame:
    """oid, time_min, time_max; with datetimes the times are date-time texts."""
    raw = _rows(spark, path, ["oid", "time_min", "time_max"])
    return raw.select("qid", F.col("oid").try_cast("int").alias("oid"), *(_time(n, datetimes).alias(n) for n in ("time_min", "time_max")))


def read_st_queries(spark: SparkSession, path: str, datetimes: bool = False) -> DataFrame:
    """time_min, time_max, then the box in degrees."""
    raw = _rows(spark, path, ["time_min", "time_max", "lon_min", "lon_max", "lat_min", "lat_max"])
    d = lambda n: F.col(n).try_cast("double")
    return raw.select(
        "qid", *(_time(n, datetimes).alias(n) for n in ("time_min", "time_max")),
        *(norm_lon(d(n)).alias(n) for n in ("lon_min", "lon_max")), *(norm_lat(d(n)).alias(n) for n in ("lat_min", "lat_max")))


def read_knn_queries(spark: SparkSession, path: str) -> DataFrame:
    """longitude, latitude in degrees, k."""
    raw = _rows(spark, path, ["lon", "lat", "k"])
    return raw.select("qid", norm_lon(F.col("lon").try_cast("double")).alias("lon"), norm_lat(F.col("lat").try_cast("double")).alias("lat"), F.col("k").try_cast("int").alias("k"))


def st_queries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "qid long, time_min int, time_max int, lon_min int, lon_max int, lat_min int, lat_max int")


def id_queries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "qid long, oid int, time_min int, time_max int")


def knn_queries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "qid long, lon int, lat int, k int")
