"""URL filtering by association rules (operator 4).

A URL becomes tokens: labels of its host and their hyphenated words, the host without a leading www, m or blog, path words, file ending, query keys. Labelled
URLs go, with a token for their label, through Spark's distributed FP-growth. Rules from tokens to the bad label are kept by
count, confidence and lift; a rule goes if a shorter one that it contains is as sure, and all others remain. Two kinds of
tokens can be left out of the growth, since no rule that remains has them beside others: those that are sure alone, and
those with too few bad URLs. Rules are matched through an inverted index from token to rules: a rule fires when all its tokens are met.

Given rules (allow or block a host with its subdomains and a path beginning) come first; the longest fitting one decides,
block at equal length. Other URLs are blocked if a mined rule fires, else allowed.

Null URLs and URLs without `://` have empty host and path and no tokens: allow. Without bad labels nothing is mined. Repeated
URLs are judged each; a URL without a label teaches nothing. Long URLs are read whole. An empty table gives no rows; extra
columns are ignored. Rules that fire together are named by the surest, then the shortest, then by their tokens.
"""

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from trailmark.llm.common import table, written

LEAST_COUNT = 10
ROWS_PER_PARTITION = 20_000
LEAST_CONFIDENCE = 0.9
LEAST_LIFT = 1.5
BAD = "label=bad"
# The rules that the query is given, as verdict and rule.
GIVEN = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Words of a host that label a URL as bad, for mining.
BAD_WORDS = "adult ads bet bets casino loan loans pills poker porn spam viagra xxx".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def given_rule(host: Column, path: Column, rules=GIVEN) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens of a URL whose host and path are columns."""
    tag = lambda k, arr: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(k + "="), x))
    bare = F.regexp_replace(F.col(host), r"\A(www|m|blog)\.", "")
    words = F.filter(F.split(F.lower(F.col(path)), r"[/._\-]+"), lambda x: ~F.rlike(x, F.lit(r"\A[0-9]*\z")))
    ending = F.array(F.regexp_extract(F.lower(F.col(path)), r"\.([a-z0-9]+)\z", 1))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"\A[^=]*", 0))
    return F.array_distinct(F.concat(tag("host", F.array(bare)), tag("part", F.concat(F.split(F.col(host), r"\."), F.split(F.col(host), r"[.\-]"))), tag("path", words), tag("end", ending), tag("key", keys)))


def _of_tokens(wanted, column: str):
    """Leaves only the wanted tokens."""
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            left = [[t for t in toks or () if t in wanted.value] for toks in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(left, b.schema.field(at).type))

    return run


def _not_implied(kept):
    """Leaves out the rules that contain a kept one as sure."""
    def run(batches):
        index: dict[str, list[int]] = {}
        for i, (a, _, _) in enumerate(kept.value):
            index.setdefault(a[0], []).append(i)  # all tokens must be met, so the first one must
        sets = [frozenset(a) for a, _, _ in kept.value]
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield b.filter(pa.array([not any(kept.value[i][1] >= c and sets[i] <= set(a) for t in a for i in index.get(t, ())) for a, c in rows], pa.bool_()))

    return run


def mine_rules(labelled: DataFrame, least_count: int = LEAST_COUNT, confidence: float = LEAST_CONFIDENCE) -> list[tuple[tuple[str, ...], float, float]]:
    """labelled: tokens array<string>, bad boolean. (tokens, confidence, support) of the rules, surest first: all with
    least_count bad URLs that contain no shorter one as sure."""
    labelled = written(labelled.select("tokens", "bad"), "url-tokens")
    sc = labelled.sparkSession.sparkContext
    n, bad = labelled.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("int"))).first()
    if not bad or n / bad < LEAST_LIFT:
        return []
    alone = labelled.select("bad", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("hits"))
    alone = alone.where(F.col("hits") >= least_count).collect()  # at most the bad URLs' tokens over least_count
    out = [((r["t"],), 1.0, r["hits"] / n) for r in alone if r["hits"] == r["n"]]
    wanted = sc.broadcast({r["t"] for r in alone if r["hits"] < r["n"]})
    if wanted.value:
        rows = labelled.mapInArrow(_of_tokens(wanted, "tokens"), labelled.schema)
        rows = rows.select(F.array_distinct(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))).alias("items"))
        parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")) + n // ROWS_PER_PARTITION
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least_count - 0.5) / n), numPartitions=parts).fit(rows).freqItemsets
        sets = sets.select(F.array_sort(F.array_remove("items", BAD)).alias("a"), F.array_contains("items", BAD).alias("b"), "freq").where(F.size("a") > 0)
        found = sets.groupBy("a").agg(F.sum(F.when(F.col("b"), F.col("freq"))).alias("hits"), F.sum(F.when(~F.col("b"), F.col("freq"))).alias("n")).where("hits IS NOT NULL")
        found = found.select("a", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"))
        found = written(found.where((F.col("confidence") >= confidence) & (F.col("confidence") * n / bad >= LEAST_LIFT)), "url-rules")
        kept = []
        for (size,) in sorted(found.select(F.size("a")).distinct().collect()):
            new = found.where(F.size("a") == size)
            new = new.mapInArrow(_not_implied(sc.broadcast(kept)), found.schema) if kept else new
            kept = kept + [(tuple(r["a"]), r["confidence"], r["support"]) for r in new.collect()]
        out += kept
    return sorted(out, key=lambda r: (-r[1], len(r[0]), r[0]))


def _match(rules, column: str):
    """Adds the tokens, joined, of the surest rule that fires, or null."""
    def run(batches):
        index: dict[str, list[int]] = {}
        for i, (a, _, _) in enumerate(rules.value):
            for t in a:
                index.setdefault(t, []).append(i)
        names = ["+".join(a) for a, _, _ in rules.value]
        need = [len(a) for a, _, _ in rules.value]
        for b in batches:
            fired = []
            for toks in b.column(b.schema.get_field_index(column)).to_pylist():
                met: dict[int, int] = {}
                for t in toks or ():
                    for i in index.get(t, ()):
                        met[i] = met.get(i, 0) + 1
                first = min((i for i, k in met.items() if k == need[i]), default=None)
                fired.append(None if first is None else names[first])
            keep = [i for i, n in enumerate(b.schema.names) if n != column]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(fired, pa.string())], [*(b.schema.names[i] for i in keep), "mined_rule"])

    return run


def judge_urls(urls: DataFrame, rules: list, key: str = "page_id", url: str = "url", given=GIVEN) -> DataFrame:
    """key, host, path, rule, verdict, mined_rule (its tokens joined, or null)."""
    host, path = split_url(url)
    d = urls.select(key, url).withColumn("host", host).withColumn("path", path)
    kind = dict(urls.dtypes)[key]
    d = d.select(key, "host", "path", given_rule(F.col("host"), F.col("path"), given).alias("g"), tokens(url, "host", "path").alias("tokens"))
    shared = urls.sparkSession.sparkContext.broadcast(rules)  # their number is bounded by LEAST_COUNT
    d = d.select(key, "host", "path", "g.rule", "g.verdict", "tokens").mapInArrow(_match(shared, "tokens"), f"`{key}` {kind}, host string, path string, rule string, verdict string, mined_rule string")
    verdict = F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return d.select(key, "host", "path", "rule", verdict.alias("verdict"), "mined_rule")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, bad of the URLs with a label. A URL is labelled through the document that its path names by its first
    number (bad: low quality or toxic), and as bad if its host has one of BAD_WORDS."""
    host, path = split_url("url")
    p = pages.select("url").withColumn("host", host).withColumn("path", path)
    word = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, BAD_WORDS)))
    p = p.select(tokens("url", "host", "path").alias("tokens"), word.alias("word"), F.regexp_extract("path", r"/([0-9]{1,18})(?![0-9])", 1).try_cast("long").alias("doc_id"))
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    joined = p.join(good, "doc_id", "left").where(F.col("word") | F.col("bad").isNotNull())
    return joined.select("tokens", (F.col("word") | F.coalesce("bad", F.lit(False))).alias("bad"))


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge_urls(pages, rules)
