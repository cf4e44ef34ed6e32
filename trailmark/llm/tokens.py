"""Encoding with a tokenizer file, exact length histograms, and token files.

Operators 1 (token counts) and 3 (token-ID output). Nulls in the text column count as empty texts; an empty text
has no ids. Rows with equal keys are kept apart; a null key sorts first. Extra columns are ignored.
"""

import os
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trailmark.llm.common import shared_path, slices, table, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CACHED_PIECES = 200_000
ENCODED_BYTES = 3 << 20
JOINED_PIECES = 512
CACHED_BYTES = 48
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
BUCKET = 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space other than a space and a line end, as a class of Arrow's patterns.
WHITE = "".join(f"\\x{{{i:04X}}}" for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")


def _found(pieces: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each piece among the known ones, -1 where there is none, and the pieces without one."""
    at = pc.index_in(pieces, known)
    return pc.fill_null(at, -1).to_numpy().astype(np.int64), pieces.filter(at.is_null())


class PieceEncoder:
    """Encodes columns of texts piece by piece and remembers the pieces.

    The byte-level pre-tokenizer ends a token before every single space between two other characters, and no
    merge crosses such an end; so texts are cut there, and each distinct piece of a column is looked up or encoded
    once by the library; then the ids of all texts are gathered at once. Arrow and numpy do all but the library's part.
    New pieces without white space go to the library many at a time, joined by spaces: only a token at the start of
    a piece starts with a space, so the ids are cut there. Memory is bounded: only short pieces are remembered, and a full
    memory keeps those of the texts at hand.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Letters, then signs without an apostrophe: the pre-tokenizer ends a token between the two.
    SIGNED = r"\A(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<sign>[!-&(-/:-@\[-`{-~]+)\z"
    #: A text without these splits at every space; a line end is fine between two other characters.
    ODD = rf"\A | \z| [ \n]|\n |[{WHITE}]"

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cached = cached
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # how byte-level models write a space
        self.known, self.store = pa.array([], pa.string()), _Runs()  # pieces after a space, and their ids

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text, one at least; null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, self.ODD)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        other = pa.array([self.CUT.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        return pa.concat_arrays([plain, other]).take(pa.array(place))

    def _alone(self, pieces: list[str]) -> "_Runs":
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return _Runs(np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _after_space(self, pieces: list[str]) -> "_Runs":
        """Ids of each piece with a space before it; the pieces have no white space."""
        out = [_Runs()]
        for at in range(0, len(pieces), JOINED_PIECES):
            part = pieces[at : at + JOINED_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            # Otherwise the tokenizer splits in another way.
            out.append(_Runs(ids, np.diff(np.append(starts, len(ids)))) if len(starts) == len(part) else self._alone([" " + p for p in part]))
        return _Runs.of(out)

    def _learn(self, pieces: pa.Array) -> None:
        """Encodes pieces that are not known."""
        split = pc.extract_regex(pieces, self.SIGNED)
        signed, words, signs = pieces.filter(split.is_valid()), *split.drop_null().flatten()
        need, words, before = pieces.filter(split.is_null()), words.dictionary_encode(), len(self.known)
        places, lack = _found(words.dictionary, self.known)
        need = pa.concat_arrays([need, lack.filter(pc.invert(pc.is_in(lack, need)))])
        white = pc.match_substring_regex(need, rf"[ \n{WHITE}]")
        white, need = need.filter(white), need.filter(pc.invert(white))
        self.known = pa.concat_arrays([self.known, need, white])
        self.store = _Runs.of([self.store, self._after_space(need.to_pylist()), self._alone([" " + p for p in white.to_pylist()])])
        if len(signed):
            places[places < 0] = before + _found(lack, self.known.slice(before))[0]
            coded = signs.dictionary_encode()
            both = _Runs.of([self.store, self._alone(coded.dictionary.to_pylist())])
            pairs = np.stack([places[words.indices.to_numpy()], coded.indices.to_numpy() + len(self.known)], 1)
            self.known = pa.concat_arrays([self.known, signed])
            self.store = _Runs.of([self.store, _Runs(both.gather(pairs.ravel()), both.size[pairs].sum(1))])

    def _forget(self, used: np.ndarray) -> None:
        """Leaves the short pieces, and of a full memory only the used ones."""
        keep = pc.binary_length(self.known).to_numpy() <= CACHED_BYTES
        if keep.sum() > self.cached:
            keep &= np.bincount(used, minlength=len(keep)) > 0
        if not keep.all():
            self.known, self.store = self.known.filter(pa.array(keep)), self.store.take(np.flatnonzero(keep))

    def _places(self, texts: pa.Array) -> tuple["_Runs", np.ndarray, np.ndarray]:
        """The store, places in it of all pieces of all texts, and the first piece of each text and the end of all."""
        lists = self.cut(texts)
        edges = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges -= edges[0]
        codes = coded.indices.to_numpy()
        tail = np.ones(len(codes), bool)
        tail[edges[:-1]] = False
        at = np.flatnonzero(np.bincount(codes[tail], minlength=len(coded.dictionary)))
        used = coded.dictionary.take(pa.array(at))
        found, new = _found(used, self.known)
        if len(new):
            before = len(self.known)
            self._learn(new)
            found[found < 0] = before + _found(new, self.known.slice(before))[0]
        place = np.zeros(len(coded.dictionary), np.int64)
        place[at] = found
        places = place[codes]
        first, which = np.unique(codes[edges[:-1]], return_inverse=True)
        store = _Runs.of([self.store, self._alone(coded.dictionary.take(pa.array(first)).to_pylist())])
        places[edges[:-1]] = which + len(self.store.size)
        self._forget(place[at])
        return store, places, edges

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        store, places, edges = self._places(texts)
        return np.add.reduceat(store.size[places], edges[:-1])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's. With `end`, that id follows each text."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        store, places, edges = self._places(texts)
        n = np.add.reduceat(store.size[places], edges[:-1])
        if end is not None:
            places, n = np.insert(places, edges[1:], len(store.size)), n + 1
            store = _Runs.of([store, _Runs(np.array([end], "<u4"), np.ones(1, np.int64))])
        return store.gather(places), n


class _Runs:
    """Runs of ids, numbered."""

    def __init__(self, ids=np.zeros(0, "<u4"), size=np.zeros(0, np.int64)):
        self.ids, self.size = ids, size
        self.start = np.cumsum(size) - size

    @staticmethod
    def of(parts: list["_Runs"]) -> "_Runs":
        return _Runs(np.concatenate([p.ids for p in parts]), np.concatenate([p.size for p in parts]))

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of some runs one after another."""
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[which] - ends + size, size) + np.arange(total)]

    def take(self, which: np.ndarray) -> "_Runs":
        return _Runs(self.gather(which), self.size[which])


@lru_cache(1)
def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a Python worker: later tasks find the pieces of earlier ones."""
    return PieceEncoder(path)


def _doc_lengths(path: str, text: str):
    def run(batches):
        encoder, seen = encoder_of(path), Counter()
        for part in slices(batches, text, ENCODED_BYTES):
            n, docs = np.unique(encoder.lengths(part.column(part.schema.get_field_index(text))), return_counts=True)
            seen.update(dict(zip(n.tolist(), docs.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    return run


def length_histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """length, n_docs: how many texts encode to each number of ids, exactly. Tasks count before the shuffle."""
    counted = docs.select(F.col(text)).mapInArrow(_doc_lengths(path or tokenizer_path(), text), "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: its documents and ids; documents and ids of lengths >= L (suffix sums); ids that
    are left if all texts are cut to L; the share of documents of length <= L.

    Sums run inside ranges of 1,024 lengths in parallel; the ranges' totals are added over a table with a row for
    each range. An empty input gives no row.
    """
    h = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.expr(f"length div {BUCKET}"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("part", zero(F.sum("d").over(later)).alias("d_later"), zero(F.sum("t").over(later)).alias("t_later"),
                         F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(parts, "part").select(
        "length", "n_docs", "n_tokens", (F.sum("n_docs").over(inside) + F.col("d_later")).alias("docs_at_least"),
        (F.sum("n_tokens").over(inside) + F.col("t_later")).alias("tokens_at_least"), "d_all", "t_all")
    return h.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("quantile"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs, docs_over, tokens, tokens_truncated for any context limits, occurring or not."""
    aggs = [F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens")]
    for i, limit in enumerate(limits):
        aggs += [F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)).alias(f"o{i}"),
                 F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")).alias(f"t{i}")]
    one = histogram.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(limit).cast("long").alias("context_limit"), F.col(f"o{i}").alias("docs_over"), F.col(f"t{i}").alias("tokens_truncated")) for i, limit in enumerate(limits)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c.split(".")[-1])
    return one.select("docs", "tokens", F.explode(rows).alias("r")).select("r.context_limit", zero("docs"), zero("r.docs_over"), zero("tokens"), zero("r.tokens_truncated"))


def _encoded(path: str, key: str, text: str, end_id: int):
    def run(batches):
        encoder, shard, at = encoder_of(path), TaskContext.get().partitionId(), 0
        for part in slices(batches, text, ENCODED_BYTES):
            ids, n = encoder.encode(part.column(part.schema.get_field_index(text)), end_id)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), part.column(part.schema.get_field_index(key)), pa.array(starts), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))], ["shard", key, "shard_start", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, out: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                      encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes one Parquet file for each key range: shard, key, shard_start, n_tokens, ids (list<int32>).

    Rows are in ascending key order inside a file and over the files; shard_start is the number of ids before the
    row in its file. encoding is "dictionary" or "delta" (binary packed). Row groups and pages have the sizes
    given; the writer adds column and offset indexes, so readers can skip to the pages of a key range and read
    lengths and positions without ids. Equal keys are ordered by a hash of the text.
    """
    rows = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    kind = dict(docs.dtypes)[key]
    ids = rows.mapInArrow(_encoded(path or tokenizer_path(), key, text, end_id), f"shard int, `{key}` {kind}, shard_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2" if encoding == "delta" else "v1",
               "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd"}
    ids.write.options(**options).parquet(out)


def read_token_files(spark, out: str) -> tuple[DataFrame, DataFrame]:
    """The rows as written, and for each shard the number of ids in the shards before it."""
    schema = spark.read.parquet(out).schema
    rows = spark.read.schema(schema).parquet(out)
    sizes = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    base = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows, base


def select_tokens(spark, out: str, key: str = "doc_id", low=None, high=None, ids: bool = True) -> DataFrame:
    """Rows of token files with low <= key <= high (None: no bound), with or without their ids. The bounds reach the Parquet
    reader, which skips files and row groups by their statistics and pages by the column index; without ids, only keys,
    positions and lengths are read. Rows with a null key come only without bounds."""
    rows = read_token_files(spark, out)[0]
    for bound, fits in ((low, F.col(key) >= low), (high, F.col(key) <= high)):
        rows = rows if bound is None else rows.where(fits)
    return rows if ids else rows.drop("ids")


def _crcs(batches):
    for b in batches:
        ids = b.column(b.schema.get_field_index("ids"))
        offsets, raw = ids.offsets.to_numpy(), memoryview(ids.values.cast(pa.int32()).to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        keep = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "ids"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], [*(n for n in b.schema.names if n != "ids"), "ids_crc32"])


def token_digest(spark, out: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every row of token files, read back."""
    rows, base = read_token_files(spark, out)
    kind = dict(rows.dtypes)[key]
    crc = rows.mapInArrow(_crcs, f"shard int, `{key}` {kind}, shard_start long, n_tokens long, ids_crc32 long")
    return crc.join(base, "shard").select(key, (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_report(written(length_histogram(table(spark, sf_dir, "documents")), "lengths"))  # read twice by the report


def encode_documents(docs: DataFrame) -> DataFrame:
    out = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, out)
    return token_digest(docs.sparkSession, out)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
