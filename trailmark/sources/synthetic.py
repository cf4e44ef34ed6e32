"""Generated points: a diagonal line, and a seeded cloud."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the object id that generated points carry.
SYNTHETIC_OID = 12
#: Multipliers of full period modulo the prime.
PRIME, STEPS = 2147483647, (48271, 69621)


def sequential_points(spark: SparkSession, offset: int, count: int) -> DataFrame:
    v = F.col("id").cast("int")
    return spark.range(offset, offset + count).select(
        F.lit(SYNTHETIC_OID).alias("oid"), v.alias("timestamp_sec"), v.alias("lon"), v.alias("lat"), F.col("id").alias("pid"))


def random_points(spark: SparkSession, offset: int, count: int, max_value: int, seed: int = 7) -> DataFrame:
    """Each row's value comes from its number by two multiplicative steps, so that reruns, any partitioning and SQL agree."""
    v = F.expr(f"((id + 1 + {seed} * 7919) % {PRIME} * {STEPS[0]} % {PRIME} + {seed}) % {PRIME} * {STEPS[1]} % {PRIME} % {max_value}").cast("int")
    return spark.range(offset, offset + count).select(
        F.lit(SYNTHETIC_OID).alias("oid"), v.alias("timestamp_sec"), v.alias("lon"), v.alias("lat"), F.col("id").alias("pid"))
