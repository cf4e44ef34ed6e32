"""Mixing sources to target weights by capped water-filling (operator 8); DataFrame functions only.

Sizes are word counts, null texts have none. Every source gets a share of the budget in proportion to its weight, but at
most `max_epochs` times its own size; what a capped source leaves goes to the others by weight, until none is above. The
level at which that settles comes in closed form: with sources in order of cap / weight, it is the first (and largest) at which the
budget that is left divides into less than the next cap.

A source's target is then met by whole repetitions of all its documents and one more repetition of the first documents in
a seeded order, of which the last may be fractional, so that the words taken are the target rounded down. Cumulative
sizes are found without sorting a source in one task: the seeded order is cut into 4,096 ranges by its leading digits,
range totals are added per source, and only the range in which the target falls is sorted.

A null source is a source of its own. Sources without words get target 0, null and empty texts are never taken, and an empty
table gives no rows. Very long texts count whole. Rows whose key and text are equal count each and are interchangeable as to
which of them is taken; the order depends on key and text only, so any partitioning gives the same mix. Extra columns are
ignored by `mix` and carried by `mixed_rows`, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.llm.common import table

WORD_BREAK = r"[\x20\x09-\x0D]+"
# Weights of the sources in code point order, budget in percent of all sizes, most epochs.
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
RANGE_DIGITS = 3


def n_words(text) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D."""
    trimmed = F.trim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, WORD_BREAK))).cast("long")


def _draw(key: Column, text: Column, seed: str) -> Column:
    """The place of a row in the seeded order; rows of equal or null keys with other texts have other places."""
    hashed = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), hashed).cast("binary"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from a table of source, source_size with a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    upto, whole = everything.rowsBetween(Window.unboundedPreceding, -1), everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(budget_percent) / F.lit(100.0))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    w_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    s = s.withColumn("level", left / w_left).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    return s.select("source", "source_size", F.when(first.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), first * F.col("w"))).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """key, source, size, source_size, target, copies (whole repetitions), part (words of one more), taken; with carry
    also the whole input row as the struct `row`."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), _draw(F.col(key), F.col(text), seed).alias("draw"), *row)
    d = d.withColumn("range", F.substring("draw", 1, RANGE_DIGITS))
    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    t = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, budget_percent, max_epochs)
    goal = F.floor("target")
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0))
    t = t.withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0)))
    plan = ranges.join(t, ranges["source"].eqNullSafe(t["source"])).select(ranges["source"], "range", "range_size", "before", "source_size", "target", "whole", "rest")
    cut = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("range_size"))
    plan = plan.withColumn("cut", cut)
    j = d.join(plan, d["source"].eqNullSafe(plan["source"]) & (d["range"] == plan["range"])).drop(plan["source"]).drop(plan["range"])
    whole_range = j.where(~F.col("cut")).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0).cast("long"))
    inside = Window.partitionBy("source", "range").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut_range = j.where("cut").withColumn("part", F.greatest(F.lit(0), F.least("size", left)).cast("long"))
    out = whole_range.unionByName(cut_range)
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.col("whole").cast("long").alias("copies"), "part",
                      (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The input rows as often as the mix takes them: whole repetitions, and one more if half of it or more is taken."""
    m = mix(docs, carry=True, **options)
    more = F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    times = (F.col("copies") + more).cast("int")
    return m.withColumn("n", times).where("n > 0").select("row", F.explode(F.expr("sequence(1, n)"))).select("row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents") -> str:
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CASE rank % 3 WHEN 0 THEN {WEIGHTS[0]}.0::DOUBLE WHEN 1 THEN {WEIGHTS[1]}.0::DOUBLE ELSE {WEIGHTS[2]}.0::DOUBLE END AS w, source_size * {MAX_EPOCHS} AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM c) * {BUDGET_PERCENT}::DOUBLE / 100.0::DOUBLE - coalesce(sum(cap) OVER o, 0))::DOUBLE / ((SELECT sum(w) FROM c) - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(level) FILTER (level * w <= cap) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, f.level * w) END AS target FROM c, f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
g AS (SELECT d.*, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM g"""
