"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 5).

Letters are lower-cased, runs of other characters become one space. Each n-gram of 2 and of 3 characters falls into
one of 2^15 buckets. Tasks count in numpy, Spark adds the counts, and the log-probability matrix (buckets x languages)
goes to the executors in blocks of BLOCK languages. Documents are scored in slices: a block's rows of all n-grams, summed by
document, with the best language and the sum of all likelihoods carried from block to block.

Null texts and texts without a letter are `und` with score 0. Without any labelled row every text is `und`.
Equal scores go to the language that comes first by code point. Very long texts are read whole, as a slice of their own.
Repeated rows teach and are scored each; a null language teaches nothing. An empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trailmark.llm.common import held_out, slices, table, texts_of, written

BITS = 15
ORDERS = (2, 3)
SMOOTHING = 0.5
BLOCK = 256
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point to the lower-case letter, or to a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str], letters: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text that each belongs to (non-decreasing within an order), and whether each
    text has a letter. N-grams never reach over the end of a text."""
    joined = "".join(t + "\n" for t in texts)
    codes = letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    space = codes == 32
    keep = np.empty(len(codes), bool)
    keep[:1] = True
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    codes, doc = codes[keep], doc[keep]
    has = np.bincount(doc[codes != 32], minlength=len(texts)) > 0
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + codes[i : len(codes) - n + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        hashes.append(h[inside])
        owners.append(doc[: len(h)][inside])
    if not hashes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _count(bits: int, text: str):
    def run(batches):
        letters, counts, rows = _letters(), {}, {}

        def counted():
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(c[at], rows[lang]), pa.int64())],
                    ["lang", "bucket", "n"])
            counts.clear()
            rows.clear()

        for part in slices(batches, text):
            texts, langs = texts_of(part, text), part.column(part.schema.get_field_index("lang")).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                h, _, _ = grams(own, letters, bits)
                counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                counts[lang] += np.bincount(h, minlength=1 << bits)
                rows[lang] = rows.get(lang, 0) + len(own)
                if len(counts) >= BLOCK:
                    yield from counted()
        yield from counted()

    return run


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, block: int = BLOCK) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Blocks of languages, in order, with their centred log probabilities [buckets, languages] and log priors."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count(bits, "text"), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    docs = {r["lang"]: r["n"] for r in counted.where("bucket = -1").select("lang", "n").collect()}
    langs, total, blocks, mean = sorted(docs, key=lambda x: x.encode("utf-8", "surrogatepass")), sum(docs.values()), [], 0.0
    for at in range(0, len(langs), block):
        own = langs[at : at + block]
        place = {x: i for i, x in enumerate(own)}
        cells = counted.where((F.col("bucket") >= 0) & F.col("lang").isin(own)).toPandas()
        p = np.full((1 << bits, len(own)), SMOOTHING)
        np.add.at(p, (cells["bucket"].to_numpy(np.int64), cells["lang"].map(place).to_numpy(np.int64)), cells["n"].to_numpy(np.int64))
        p = np.log(p / p.sum(0))
        if not at:
            mean = p.mean(1, keepdims=True)  # one centre for all blocks; it only keeps single precision small
        blocks.append((own, (p - mean).astype(np.float32), np.log(np.array([docs[x] for x in own]) / total)))
    return blocks


def _score(blocks, bits: int, key: str, text: str):
    def run(batches):
        letters = _letters()
        for part in slices(batches, text):
            h, doc, has = grams(texts_of(part, text), letters, bits)
            names, top, mass = np.full(part.num_rows, UNKNOWN, object), np.full(part.num_rows, -np.inf), np.zeros(part.num_rows)
            for block in blocks:
                langs, weights, priors = block.value
                total = np.zeros((part.num_rows, len(langs))) + priors
                step = (1 << 22) // max(16, len(langs))  # 16 MB of weights at a time
                for at in range(0, len(h), step):
                    w, d = weights[h[at : at + step]], doc[at : at + step]
                    start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    np.add.at(total, d[start], np.add.reduceat(w, start, axis=0))
                best = total.argmax(1)
                own = total[np.arange(len(total)), best]
                higher = np.maximum(top, own)
                mass = mass * np.exp(top - higher) + np.exp(total - higher[:, None]).sum(1)
                names[own > top] = np.array(langs, object)[best[own > top]]
                top = higher
            known = has & bool(blocks)
            points = np.where(known, 1 / np.maximum(mass, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(np.where(known, names, UNKNOWN), pa.string()), pa.array(points)], [key, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, blocks: list[tuple[list[str], np.ndarray, np.ndarray]], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key, lang_pred, score: the language and its posterior probability. One pass, no shuffle."""
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]  # each bounded: 2^bits x BLOCK
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(_score(shared, bits, key, text), f"`{key}` {kind}, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out(F.col("doc_id"))))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
