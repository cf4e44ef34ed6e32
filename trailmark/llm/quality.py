"""Distribution divergence as a quality rule (operator 7); DataFrame functions only.

Every text is compared with a reference of each language, learned from all documents of that language: the histogram of
character classes in words, and the histogram of its most common short words with one bin for all others. The distance to
a language is the mean of the two Jensen-Shannon distances (base 2, so 0 to 1); the text's divergence is that of its
nearest language. Texts under MIN_WORDS words are not judged by it: too few words make any histogram far from any other.

Null texts have no words and fail the base rule. Without any reference the base rule alone decides. Repeated rows are
judged each; a null language teaches nothing. Very long texts are counted whole, each within its row. Common words of equal
count come in order of the word. An empty table gives no rows; extra columns are ignored, whatever their names.
"""

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.llm.common import table, written

WHITE = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"
# Fixed values of the base rule: symbols, shortest text, window in words, most repeated words in percent.
SYMBOLS = "#*$%&|<>"
SHORTEST = 20
WINDOW = 8
REPEAT_PERCENT = 30
# The method's own values: words judged from, common words of a language, their most letters, the share of a language's
# words from which a word counts, and the largest divergence that is kept.
MIN_WORDS = 60
COMMON = 24
COMMON_LETTERS = 6
LEAST_SHARE = 0.001
MAX_DIVERGENCE = 0.3
CLASSES = ("lower", "upper", "letter", "digit", "symbol", "other")
CLASS_PATTERNS = ("[a-z]+", "[A-Z]+", r"\p{L}+", r"\p{Nd}+", "[" + SYMBOLS.replace("&", r"\&") + "]+")


def _pairwise(hashes: Column, apart: int) -> Column:
    """Hash of each element with the one `apart` places later."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with words, class counts and the base rule's counts. Each step is a projection of its own, so that
    nothing is computed twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_trim", F.trim(F.col("_t"), F.lit(WHITE)))
    d = d.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", BREAK)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    d = d.withColumn("_lines", lines).withColumn("_r0", F.regexp_replace("_t", BREAK, ""))
    for i, pattern in enumerate(CLASS_PATTERNS):
        d = d.withColumn(f"_r{i + 1}", F.regexp_replace(f"_r{i}", pattern, ""))
    left = [F.char_length(f"_r{i}") for i in range(len(CLASS_PATTERNS) + 1)]
    counts = {c: (left[i] - left[i + 1] if i + 1 < len(left) else left[i]).cast("long") for i, c in enumerate(CLASSES)}
    d = d.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": left[0].cast("long"), **{f"_c_{c}": v for c, v in counts.items()},
                       "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                       "_h1": F.transform("_words", lambda w: F.xxhash64(w))}).withColumn("n_symbols", F.col("_c_symbol"))
    apart = 1
    while apart < WINDOW:
        d = d.withColumn(f"_h{2 * apart}", _pairwise(F.col(f"_h{apart}"), apart))
        apart *= 2
    h = F.col(f"_h{WINDOW}")
    d = d.withColumn("_twice", F.size(F.array_distinct(h)) < F.size(h))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(none))
    m = F.greatest(F.size("_sorted") - 1, F.lit(0))
    equal = F.zip_with(F.slice("_sorted", 1, m), F.slice("_sorted", 2, m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    d = d.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))))
    following = F.concat(F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(0))), F.array(F.lit(2**31 - 1)))
    covered = F.zip_with("_at", following, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
    d = d.withColumn("n_repeat_words", F.when(F.size("_at") > 0, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0).cast("long"))
    failed = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def with_short_words(features: DataFrame) -> DataFrame:
    """Adds the lower-cased words that can be common words of a language, in order."""
    lower = F.transform("_words", lambda w: F.lower(w))
    return features.withColumn("_short", F.filter(lower, lambda w: F.length(w) <= COMMON_LETTERS))


def references_of(features: DataFrame, lang: str) -> dict[str, dict]:
    """For each language that has words: class shares and the shares of its most common words. Counts cover all
    documents; COMMON words at most of each language reach the driver. Takes rows with the class counts, n_words and
    the short words."""
    d = features.where(F.col(lang).isNotNull())
    d = d.select(F.col(lang).alias("lang"), F.col("n_words").alias("words"), F.col("_short").alias("short"), *(F.col(f"_c_{c}").alias(c) for c in CLASSES))
    sums = d.groupBy("lang").agg(F.sum("words").alias("words"), *(F.sum(c).alias(c) for c in CLASSES)).where("words > 0")
    counts = d.select("lang", F.explode("short").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(F.broadcast(sums.select("lang", "words")), "lang").where(F.col("n") >= LEAST_SHARE * F.col("words"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))  # of at most 1 / LEAST_SHARE words
    out = {}
    for r in sorted(sums.collect(), key=lambda r: r["lang"]):
        chars = max(1, sum(r[c] for c in CLASSES))
        out[r["lang"]] = {"classes": [r[c] / chars for c in CLASSES], "words": {}}
    for x in counts.withColumn("place", place).where(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        out[x["lang"]]["words"][x["w"]] = x["n"] / x["words"]
    return out


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict]:
    """References learned from all rows of docs."""
    return references_of(with_short_words(base_features(docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")), "_text")), "_lang")


def _term(p: Column, q: Column) -> Column:
    """One bin's part of twice the Jensen-Shannon divergence, in bits."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return part(p, q) + part(q, p)


def _word_divergence(shares: Column, common: Column, inside: Column) -> Column:
    """Divergence of a text's word shares from a language's: the words that occur one by one, then the bin of all
    others, then what the language has of words that do not occur."""
    zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(a: Column, e: Column) -> Column:
        q = F.try_element_at(common, e["w"])
        return F.when(q.isNull(), a).otherwise(F.struct((a["js"] + _term(e["p"], q)).alias("js"), (a["p"] + e["p"]).alias("p"), (a["q"] + q).alias("q")))

    def end(a: Column) -> Column:
        return (a["js"] + _term(F.greatest(F.lit(0.0), 1 - a["p"]), 1 - inside) + F.greatest(F.lit(0.0), inside - a["q"])) / 2

    return F.aggregate(shares, zero, add, end)


def with_divergence(features: DataFrame, refs: dict[str, dict]) -> DataFrame:
    """Adds divergence: null for texts under MIN_WORDS words, or without references."""
    if not refs:
        return features.withColumn("divergence", F.lit(None).cast("double"))
    vocabulary = sorted({w for r in refs.values() for w in r["words"]})
    d = features.withColumn("_hits", F.sort_array(F.filter("_short", lambda w: w.isin(vocabulary))))
    d = d.withColumn("_uniq", F.array_distinct("_hits"))
    d = d.withColumn("_from", F.concat(F.transform("_uniq", lambda w: F.array_position("_hits", w)), F.array(F.size("_hits").cast("long") + 1)))  # runs of equal words
    counts = F.zip_with("_from", F.slice("_from", F.lit(2), F.size("_from")), lambda a, b: (b - a) / F.col("n_words"))
    d = d.withColumn("_shares", F.zip_with("_uniq", F.slice(counts, F.lit(1), F.size("_uniq")), lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    d = d.withColumn("_classes", F.array(*(F.col(f"_c_{c}") / chars for c in CLASSES)))
    known = [{"classes": r["classes"], "words": r["words"], "inside": sum(r["words"].values())} for r in refs.values()]
    known = F.from_json(F.lit(json.dumps(known)), "array<struct<classes:array<double>,words:map<string,double>,inside:double>>")  # one literal, whatever their number
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x))

    def distance(r: Column) -> Column:
        classes = sum((_term(F.col("_classes")[i], r["classes"][i]) for i in range(len(CLASSES))), F.lit(0.0)) / 2
        return (root(classes) + root(_word_divergence(F.col("_shares"), r["words"], r["inside"]))) / 2

    nearest = F.array_min(F.transform(known, distance))
    return d.withColumn("divergence", F.when(F.col("n_words") >= MIN_WORDS, nearest))


OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "divergence"]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_divergence: float = MAX_DIVERGENCE) -> DataFrame:
    """key, the base counts, base_failed, kept, divergence. The texts are read once: counts and short words are stored,
    and the references and the distances come from there."""
    d = with_short_words(base_features(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")), "_text"))
    stored = written(d.select("_key", "_lang", "_short", *(f"_c_{c}" for c in CLASSES), *(c for c in OUTPUT if c not in ("kept", "divergence"))), "quality")
    d = with_divergence(stored, references_of(stored, "_lang")).withColumnRenamed("_key", key)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("divergence"), F.lit(0.0)) <= max_divergence)
    return d.withColumn("kept", kept).select(key, *OUTPUT)


def op7_quality_divergence(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
