"""CSV readers of the four supported point layouts. Malformed numbers give null, never an error."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trailmark.functions import norm_lat, norm_lon, to_epoch


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _number(name: str, kind: str) -> Column:
    return F.col(name).try_cast(kind)


def with_row_numbers(df: DataFrame, name: str = "pid") -> DataFrame:
    """Dense row numbers from 0 in the order of partitions: rows are counted once, and each partition starts after those
    before it. The counts, one for each partition, make a broadcast table."""
    part = F.spark_partition_id()
    counts = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, table = 0, []
    for part_id, n in sorted(map(tuple, counts)):
        table.append((part_id, before - (part_id << 33)))
        before += n
    starts = df.sparkSession.createDataFrame(table, "part int, shift long")
    numbered = df.withColumn(name, F.monotonically_increasing_id()).withColumn("part", part)
    return numbered.join(F.broadcast(starts), "part").withColumn(name, F.col(name) + F.col("shift")).drop("part", "shift")


def _points(raw: DataFrame, oid: Column, seconds: Column, row_id: bool) -> DataFrame:
    lon, lat = _number("longitude", "double"), _number("latitude", "double")
    cols = [oid.alias("oid"), seconds.alias("timestamp_sec"), norm_lon(lon).alias("lon"), norm_lat(lat).alias("lat")]
    points = raw.select(*cols)
    return with_row_numbers(points) if row_id else points


def read_porto(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    """trip, call type, taxi, epoch seconds, day type, missing flag, longitude, latitude."""
    names = ["trip_id", "call_type", "taxi_id", "seconds", "day_type", "missing_data", "longitude", "latitude"]
    return _points(_read(spark, path, names), _number("taxi_id", "int"), _number("seconds", "int"), row_id)


def read_nyc(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    """taxi, date-time (UTC), longitude, latitude."""
    raw = _read(spark, path, ["taxi_id", "moment", "longitude", "latitude"])
    return _points(raw, _number("taxi_id", "int"), to_epoch("moment"), row_id)


def read_osm(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    """point id, longitude, latitude, epoch seconds."""
    raw = _read(spark, path, ["point_id", "longitude", "latitude", "seconds"])
    return _points(raw, _number("point_id", "int"), _number("seconds", "int"), row_id)


def read_geolife(spark: SparkSession, path: str, row_id: bool = True) -> DataFrame:
    """epoch seconds, longitude, latitude; the layout has no object id, so oid is null."""
    raw = _read(spark, path, ["seconds", "longitude", "latitude"])
    return _points(raw, F.lit(None).cast("int"), _number("seconds", "int"), row_id)


def row_window(points: DataFrame, offset: int, count: int, by: str = "pid") -> DataFrame:
    """Rows offset .. offset+count-1 by a dense row number column, such as the readers give."""
    return points.where(F.col(by).between(offset, offset + count - 1))
