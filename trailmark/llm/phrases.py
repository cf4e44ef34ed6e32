"""Benchmark decontamination with a distributed positional inverted index (operator 10).

The index is dealt by document: each segment (about 2 MB of text) is a row with its documents, their first word positions,
and for each term the sorted positions in the segment. It is stored as Parquet in the shared folder. A search intersects
offset-adjusted posting lists, from the term that is rarest in the segment, and so finds exact phrases without a shuffle;
with `slop`, terms may lie up to that many words from their place (proximity matches).

Test items are searched in blocks of a bounded number of words, each broadcast; a document's spans from several blocks
are then merged. The index may be restricted to the terms of the items, as other terms never match.

Null texts and texts without words have no matches, as do items without words. Equal items match alike, repeated rows are
judged each. Items with a null id count under the empty name. Very long texts are indexed whole, as a segment of their own. An
empty table of documents gives no rows, one of items no hits; extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.common import cut_sql, slices, table, texts_of, written

WINDOW = 10
BLOCK_WORDS = 1_000_000
# Bytes that are part of words once A-Z are lower-cased: 0-9, a-z and all of non-ASCII characters.
WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))


def _byte_table() -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c if c in WORD_BYTES else 32 for c in range(256))


def words_of(text: str | None, table_: bytes) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(table_).split()


def _build(key: str, text: str, terms):
    def run(batches):
        from xxhash import xxh3_64_intdigest

        bytes_, known = _byte_table(), dict(terms.value) if terms else {}
        segment = TaskContext.get().partitionId() << 32
        for part in slices(batches, text):
            docs = [words_of(t, bytes_) for t in texts_of(part, text)]
            if terms is None:
                if len(known) > 500_000:
                    known.clear()
                known.update((w, xxh3_64_intdigest(w) >> 1 or 1) for w in set().union(*docs).difference(known))
            get = known.get
            n = np.array([len(d) for d in docs], np.int64)
            ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, int(n.sum()))
            at = np.flatnonzero(ids)
            at = at[np.argsort(ids[at], kind="stable")]
            term, first = np.unique(ids[at], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), part.column(part.schema.get_field_index(key))),
                 pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([term.astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.append(first, len(at)).astype("<i4").tobytes()], pa.binary()), pa.array([at.astype("<i4").tobytes()], pa.binary())],
                ["segment", "keys", "n_words", "terms", "firsts", "positions"])
            segment += 1

    return run


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a stored table. vocabulary: the terms to post (of a bounded block of items), or None for all."""
    terms = None
    if vocabulary is not None:
        from xxhash import xxh3_64_intdigest

        terms = docs.sparkSession.sparkContext.broadcast({w: xxh3_64_intdigest(w) >> 1 or 1 for w in vocabulary})
    kind = dict(docs.dtypes)[key]
    schema = f"segment long, keys array<{kind}>, n_words array<long>, terms binary, firsts binary, positions binary"
    return written(docs.select(key, text).mapInArrow(_build(key, text, terms), schema), "postings")


def item_windows(items: list[tuple], window: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Each window of an item's words with the ids of the items that hold it; a shorter item is one window."""
    bytes_, out = _byte_table(), {}
    for item, text in items:
        w = words_of(text, bytes_)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i : i + window]), {})[item] = None
    return {x: list(ids) for x, ids in out.items()}


def _intersect(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Positions at which a phrase starts: lists[i] are the positions of its i-th term."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    starts = lists[order[0]].astype(np.int64) - order[0]
    for i in order[1:]:
        p, want = lists[i], starts + i
        at = np.searchsorted(p, want - slop)
        hit = at < len(p)
        hit[hit] = p[at[hit]] <= want[hit] + slop
        starts = starts[hit]
        if not len(starts):
            break
    return starts


def _search(block, slop: int, key: str):
    def run(batches):
        from xxhash import xxh3_64_intdigest

        windows = block.value
        vocabulary = sorted({w for x in windows for w in x})
        place = {w: i for i, w in enumerate(vocabulary)}
        hashes = np.array([xxh3_64_intdigest(w) >> 1 or 1 for w in vocabulary], np.int64)
        phrases = list(windows)
        by_length = {}
        for i, x in enumerate(phrases):
            by_length.setdefault(len(x), []).append(i)
        grids = {n: (np.array(ids), np.array([[place[w] for w in phrases[i]] for i in ids])) for n, ids in by_length.items()}
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_words"], np.int64)
                starts_of = np.concatenate(([0], np.cumsum(n)))
                terms, firsts, positions = (np.frombuffer(r[c], t) for c, t in (("terms", "<i8"), ("firsts", "<i4"), ("positions", "<i4")))
                where = np.searchsorted(terms, hashes)
                there = where < len(terms)
                there[there] = terms[where[there]] == hashes[there]
                spans, found = [[] for _ in n], [{} for _ in n]
                for size, (ids, grid) in grids.items():
                    for row in np.flatnonzero(there[grid].all(1)):
                        lists = [positions[firsts[t] : firsts[t + 1]] for t in where[grid[row]]]
                        at = _intersect(lists, slop)
                        if not len(at):
                            continue
                        doc = np.searchsorted(starts_of, at, side="right") - 1
                        inside = (at >= 0) & (at + size <= starts_of[np.minimum(doc + 1, len(n))])
                        for d, a in zip(doc[inside].tolist(), at[inside].tolist()):
                            spans[d].append((int(a - starts_of[d]), int(a - starts_of[d]) + size))
                            found[d].update(dict.fromkeys(windows[phrases[ids[row]]]))
                merged = [_merge(s) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["segment"]] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(r["keys"], b.schema.field("keys").type.value_type), pa.array(n),
                     pa.array([[x for s in m for x in s] for m in merged], pa.list_(pa.int64())), pa.array([["" if i is None else str(i) for i in f] for f in found], pa.list_(pa.string()))],
                    ["segment", "ordinal", key, "n_words", "spans", "items"])

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, z in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def item_blocks(items: DataFrame, item: str, text: str, block_words: int) -> list[list[tuple]]:
    """The items in blocks of about block_words words, read one block at a time by ranges of a hash of the id."""
    size = items.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0] / 4
    n = max(1, int(-(-size // block_words)))
    part = F.pmod(F.xxhash64(item), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in items.where(part == i).select(item, text).collect()]


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, n_words, spans (starts and ends of merged hits, in words), items (those found, as strings) of every row."""
    sc, kind = docs.sparkSession.sparkContext, dict(docs.dtypes)[key]
    schema = f"segment long, ordinal int, `{key}` {kind}, n_words long, spans array<long>, items array<string>"
    found = []
    for block in item_blocks(items, item, item_text, block_words):
        windows = item_windows(block, window)
        index = build_index(docs, {w for x in windows for w in x}, key, text)
        found.append(index.mapInArrow(_search(sc.broadcast(windows), slop, key), schema))
    if len(found) == 1:
        return found[0].drop("segment", "ordinal")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return out.groupBy("segment", "ordinal").agg(F.first(key).alias(key), F.first("n_words").alias("n_words"), flat("spans"), flat("items")).drop("segment", "ordinal")


def _digest(key: str):
    def run(batches):
        for b in batches:
            spans, items = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("spans", "items"))
            hit = [sum(z - a for a, z in _merge(list(zip(s[::2], s[1::2])))) for s in spans]
            names = [sorted(set(i)) for i in items]
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in names]
            keep = [b.column(b.schema.get_field_index(c)) for c in (key, "n_words")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hit, pa.int64()), pa.array([len(i) for i in names], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])],
                                             [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = dict(docs.dtypes)[key]
    found = search(docs, items, key=key, text=text)
    return found.mapInArrow(_digest(key), f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def hits_sql(window: int = WINDOW) -> str:
    """The rows of op10 by joining every run of words with the windows."""
    cut, last = cut_sql("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), window - 1
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {cut} AS w FROM benchmark),
x AS MATERIALIZED (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[p : p + {last}], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
o AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM x))),
f AS MATERIALIZED (SELECT r, p, n, item FROM o JOIN x USING (n, x)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM f) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""
