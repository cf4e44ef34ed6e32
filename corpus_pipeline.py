"""A corpus from raw documents: without toxic texts, near copies and benchmark passages, mixed by source, as token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. Rows are identified by doc_id and a hash of the text, so equal ids with different texts stay apart.

Null and empty texts pass the first three stages (rows that are equal in id and text become one) and are left out by the mix, which
takes words. Very long texts are read whole. Of documents that are linked, the one with the smallest id stays, at equal ids that with
the smallest hash. Empty tables give no rows. Extra columns are kept up to the last stage, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.llm import jaccard, mixing, phrases, tokens, toxicity
from trailmark.llm.common import small_batches, table, written

NEAR_WORDS, NEAR_PERCENT = 5, 80


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key column, and its name, which no other column has."""
    name = "_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.clean_rows(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that is linked by a Jaccard similarity of 80 % on five-word shingles."""
    keyed, key = _keyed(docs)
    small_batches(spark)
    groups = jaccard.membership(keyed.select(key, "text"), key=key, words=NEAR_WORDS, percent=NEAR_PERCENT)
    hash_ = F.coalesce(f"{key}.hash", F.lit(0).cast("long"))  # never null; of the type that keyed has, so that the texts move once
    first = groups.where(f"{key} = component_id").select(F.struct(f"{key}.id", hash_.alias("hash")).alias(key))
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).drop(key)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    keyed, key = _keyed(docs)
    small_batches(spark)
    found = phrases.contamination(keyed, table(spark, sf_dir, "benchmark"), key=key).where("contaminated").select(key).distinct()
    return keyed.join(found, key, "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target."""
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; returns what they hold for each row."""
    small_batches(spark)
    return tokens.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("source mixing", mix_sources),
    ("token files", token_files),
]

ORACLE_SQL = None  # tokenizing and the learned grammar have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
