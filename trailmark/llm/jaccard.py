"""Exact n-gram Jaccard join by PartEnum signatures (operator 9).

A document's set holds its distinct word shingles as 64-bit hashes; equal sets are one node. Sizes fall into bands; the
instance of a band finds the pairs whose smaller set lies in it, so a set belongs to that of its own band and, unless it is too
large, to that of the one below. Similar sets of an instance with sizes up to h below and a similarity of p percent or more
differ in at most k = h * (100 - p) / p elements.

An instance deals the feature domain by hash into n1 partitions of PARTS parts each. At most k / (DIFFER + 1) partitions hold
more than DIFFER differences; every other one has PARTS - DIFFER parts without any. The signatures are the contents of
all such subsets of parts, so similar sets share one. n1 has `spare` partitions more than that takes, and a set leaves out up to
2/3 of so many that it would share with strangers: first those with an empty subset, in the order of partitions, then the
hottest, those with a subset whose signature HOT nodes or more share, by classes of powers of two. (Passages that many
documents share make such signatures, and the pairs in their buckets grow with the square. Copies share far more than a set may
leave out and keep the rest.) What is left out depends on contents and a limit in an order that is the same for all sets: of
the partitions without differences two sets leave out at most the more generous one's, and of those with one, which add
half a partition each to what they have in common, each its own; so 2/3 and half of 2/3 are lost, and one stays.

Signatures are dealt by hash into places of about PLACE rows, packed: a node is named once for all of its signatures in a place,
which numpy then groups. Hot ones (a third of all rows may be near copies of each other) are dealt in pieces that are put together
by one row for each; of buckets with the same members one is kept. Nodes carry 1,024-bit parity sketches, whose differing
bits never exceed the sets' difference, and fine ones of as many bits as the set has elements; a pair is verified on whole
sets only if both kinds allow it. First every node is tried with the nearest-looking of its
buckets' smallest nodes, and with the smallest node that has the same lowest hash under each of three hashes; links found
make components. Buckets whose nodes are still in different components are then
compared in blocks of bounded size: first only the nearest-looking pairs that would join their components, then all pairs between components that have not been tried. So every link is found or implied by the components,
without all pairs of a group of copies. No step collects links or documents, and no bucket is capped.

Null texts and texts without words have empty sets and link with nothing. A text with fewer words than a shingle is one
shingle. Very long texts are read whole, one at a time. Equal texts are one node, and rows with equal keys are joined like any
others. A null key never names a component that has another key. An empty table gives no rows; extra columns are ignored.
"""

import gc
import math
from functools import partial
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailmark.llm.common import cut_sql, forget, mix64, release, slices, small_batches, table, texts_of, written

WORDS = 4
PERCENT = 85
PARTS = 3
DIFFER = 1
SLACK, LEAST_SPARE = 0.075, 3
LEAST_SHARE = 3  # elements of a set for each that may differ, in bands that are no wider than two steps of similarity
SKETCH_BITS = 1024
BLOCK = 256
BLOOM_BITS = 1 << 24
KNOWN_WORDS = 250_000
SEEN_NODES = 200_000
LOWEST = 3
HOT = 8
#: Bits of a signature: kind (2), parity of the band (1), partition, hash of the contents. The kinds are signatures of up to
#: SMALL and up to LARGE partitions, marks (how many hot partitions a node may leave out), and ones that are never left out.
#: The lowest byte is 0 and isn't sent; signatures that meet by chance only add candidates.
SMALL, LARGE = 1 << 10, 1 << 24
KIND_SMALL, KIND_LARGE, KIND_MARK, KIND_KEPT = range(4)
#: Signatures of one in SAMPLE texts are counted first. Those with SPLIT nodes or more there, and 1/HOTTEST of the counted rows
#: (so that at most HOTTEST are broadcast, 16 bytes each), are dealt in pieces of about SPLIT * SAMPLE nodes.
SAMPLE, SPLIT, HOTTEST = 64, 100, 100_000
PLACE = 1 << 20  # rows of a place, by the sample; one is grouped at a time
PACK = 1 << 17  # rows that are packed at a time
TASKS = 10_000  # that group places, at most; more places share them
FEW_PAIRS = 250_000  # whose at most 500,000 nodes are broadcast, 8 bytes each


class _Hashes(dict):
    """Word to hash, filled as words are asked for."""

    def __init__(self, hash_of):
        self.hash_of = hash_of

    def __missing__(self, word: bytes) -> int:
        self[word] = h = self.hash_of(word)
        return h


class Shingler:
    """Distinct word shingles of texts; remembers hashes of words, up to a bound."""

    def __init__(self, words: int):
        from xxhash import xxh3_64_intdigest

        self.n, self.known = words, _Hashes(xxh3_64_intdigest)

    def _hash(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
        return mix64(s)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingles of each text; all texts are hashed as one sequence, runs over two texts left out."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
        size = np.array([len(c) for c in cut], np.int64)
        h = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.uint64, int(size.sum()))
        runs = self._hash(h, self.n) if len(h) >= self.n else h[:0]
        starts = np.cumsum(size) - size
        out = []
        for a, n in zip(starts.tolist(), size.tolist()):
            if n >= self.n:
                out.append(np.unique(runs[a : a + n - self.n + 1]))
            else:
                out.append(self._hash(h[a : a + n], n) if n else h[:0])
        return out


def node_of(s: np.ndarray) -> int:
    """The identity of a set: a 64-bit digest of its elements and size."""
    total = int(mix64(s, 7).sum(dtype=np.uint64)) ^ len(s) * 0x9E3779B97F4A7C15
    return int(np.array([total & (2**64 - 1)], np.uint64).view(np.int64)[0])


def sketch_of(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    return np.packbits(np.bincount((mix64(s, 11) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def fine_of(s: np.ndarray) -> bytes:
    """A sketch of as many bits as the set has elements or more, a power of two: 1/64 to 1/32 of the set."""
    return sketch_of(s, max(SKETCH_BITS, 1 << (len(s) - 1).bit_length()))


def fine_gap(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two fine sketches, the longer one folded to the shorter; never above the sets' difference."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def bands(percent: int, size: int) -> list[tuple[int, int]]:
    """Bands of sizes, the last one with `size`. They are one to two steps of similarity wide."""
    p = percent / 100
    wide = min(p**-2, max(1 / p, p / (LEAST_SHARE * (1 - p)))) if p < 1 else 2
    out, low = [], 1
    while True:
        high = max(low, int(low * wide))
        out.append((low, high))
        if high >= size:
            return out
        low = high + 1


def instances(percent: int, size: int, known: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(band, k, n1, spare) of the instances that a set of this size belongs to: one or two neighbours; none where k is 0."""
    i = next(i for i, (_, high) in enumerate(known) if size <= high)
    out = []
    for b in (i, i - 1):
        k = known[b][1] * (100 - percent) // percent if b >= 0 else 0
        if k and (b == i or known[b][1] * 100 >= percent * size):
            spare = max(LEAST_SPARE, math.ceil(SLACK * k))
            out.append((b, k, k // (DIFFER + 1) + 1 + spare, spare))
    return out


SUBSETS = list(combinations(range(PARTS), PARTS - DIFFER))


def _bits(kind: int, band: int, number, digest):
    """A signature (or mark) with its partition (or count) and as many bits of the digest as remain."""
    low = 51 if kind == KIND_SMALL else 61 if kind == KIND_KEPT else 37
    head = np.uint64(kind << 62 | (band & 1) << 61)
    place = np.asarray(number, np.uint64) << np.uint64(low) if low < 61 else np.uint64(0)
    return head | place | (np.asarray(digest, np.uint64) >> np.uint64(64 - low)) & ~np.uint64(255)


def signatures(s: np.ndarray, percent: int, known: list[tuple[int, int]], node: int | None = None) -> np.ndarray:
    """node: the set's identity, if it is known."""
    out, mixed = [], mix64(s, 3)
    node = node_of(s) if node is None else node
    for band, _, n1, spare in instances(percent, len(s), known):
        cell = (mix64(s, 101 + band) % np.uint64(n1 * PARTS)).astype(np.int64)
        content = np.zeros(n1 * PARTS, np.uint64)
        np.add.at(content, cell, mixed)
        content = content.reshape(n1, PARTS)
        filled = np.bincount(cell, minlength=n1 * PARTS).reshape(n1, PARTS) > 0
        has = np.stack([filled[:, list(c)].any(1) for c in SUBSETS], 1)
        most = 2 * spare // 3
        empty = np.flatnonzero(~has.all(1))[:most]
        use = np.ones(n1, bool)
        use[empty] = False
        kind = KIND_SMALL if n1 <= SMALL else KIND_LARGE if n1 <= LARGE else KIND_KEPT
        at = np.flatnonzero(use).astype(np.uint64)
        for j, subset in enumerate(SUBSETS):
            sig = at * np.uint64(len(SUBSETS)) + np.uint64(j + (band << 40))
            for c in subset:
                sig = mix64(sig ^ content[use, c], c)
            out.append(_bits(kind, band, at, sig))
        if len(empty) < most:
            out.append(_bits(KIND_MARK, band, [min(most - len(empty), LARGE - 1)], np.array([node]).view(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _nodes(words: int, key: str, text: str):
    def run(batches):
        shingler = Shingler(words)
        for part in slices(batches, text):
            sets = shingler.sets(texts_of(part, text))
            n = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), n, node], [key, "n_shingles", "node"])

    return run


def _rows(words: int, percent: int, text: str, batches):
    """Signatures and nodes of slices of texts; a node may come again."""
    shingler, seen, known = Shingler(words), set(), bands(percent, 1)
    for part in slices(batches, text):
        sig, node = [], []
        for s in shingler.sets(texts_of(part, text)):
            if not len(s) or (x := node_of(s)) in seen:
                continue
            if len(seen) < SEEN_NODES:
                seen.add(x)
            if known[-1][1] < len(s):
                known = bands(percent, len(s))
            sig.append(signatures(s, percent, known, x))
            node.append(np.full(len(sig[-1]), x, np.int64))
        if sig:
            yield np.concatenate(sig), np.concatenate(node)


def _signatures(words: int, percent: int, text: str):
    def run(batches):
        for sig, node in _rows(words, percent, text, batches):
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node)], ["sig", "node"])

    return run


def _pieces(sig: np.ndarray, hot) -> np.ndarray:
    """Pieces of each signature, 0 if it is not hot. hot: signatures in order, and their pieces."""
    sigs, pieces = hot.value
    if not len(sigs):
        return np.zeros(len(sig), np.int64)
    at = np.minimum(np.searchsorted(sigs, sig), len(sigs) - 1)
    return np.where(sigs[at] == sig, pieces[at], 0)


def _cuts(new: np.ndarray) -> np.ndarray:
    """Starts of runs, from where a value differs from the one before."""
    return np.concatenate([[0], np.flatnonzero(new) + 1])


PACKED = "place int, nodes binary, counts binary, sigs binary"


def _pack(sig: np.ndarray, node: np.ndarray, places: int, hot) -> pa.RecordBatch:
    """A row for each place: its nodes, how many signatures follow each (255 at most, then the node comes again), and these."""
    pieces = _pieces(sig, hot)
    piece = mix64(node.view(np.uint64), 5) % np.maximum(pieces, 1).astype(np.uint64) + np.uint64(1)
    place = (mix64(np.where(pieces > 0, sig ^ mix64(piece, 6), sig), 4) % np.uint64(places)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    sig, node, place = sig[order], node[order], place[order]
    run = _cuts((place[1:] != place[:-1]) | (node[1:] != node[:-1]))
    long = np.diff(run, append=len(sig))
    if len(long) and long.max() > 255:
        run = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(run.tolist(), long.tolist())])
        long = np.diff(run, append=len(sig))
    first = _cuts(place[1:] != place[:-1])
    starts = np.searchsorted(run, first)

    def binary(values: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
        offsets = (np.append(at, len(values)) * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

    return pa.RecordBatch.from_arrays(
        [pa.array(place[first]), binary(node[run], starts, 8), binary(long.astype(np.uint8), starts, 1), binary(sig.view(np.uint8).reshape(-1, 8)[:, 1:], first, 7)],
        ["place", "nodes", "counts", "sigs"])


def _packed(rows, places: int, hot):
    """Packs what rows(batches) yields, PACK rows or more at a time."""
    def run(batches):
        parts, size = [], 0
        for part in rows(batches):
            parts.append(part)
            size += len(part[0])
            if size >= PACK:
                yield _pack(*map(np.concatenate, zip(*parts)), places, hot)
                parts, size = [], 0
        if size:
            yield _pack(*map(np.concatenate, zip(*parts)), places, hot)

    return run


def _plain_rows(batches):
    for b in batches:
        if b.num_rows:
            sig, node = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("sig", "node"))
            yield sig.view(np.uint64), node


MEMBERS = "sig long, node long, split boolean, leader long, m long, content long"


def _members(parts: list[pa.RecordBatch], hot) -> pa.RecordBatch:
    """Of the packed rows of a place, the members of signatures with several nodes, of hot ones, and marks."""
    joined = lambda c: b"".join(x for b in parts for x in b.column(b.schema.get_field_index(c)).to_pylist())
    sent = np.frombuffer(joined("sigs"), np.uint8).reshape(-1, 7)
    sig = np.zeros((len(sent), 8), np.uint8)
    sig[:, 1:] = sent
    sent, sig = None, sig.view(np.uint64).ravel()
    ends = np.cumsum(np.frombuffer(joined("counts"), np.uint8), dtype=np.int64)
    order = np.argsort(sig)
    sig = sig[order]
    equal = sig[1:] == sig[:-1]
    keep = np.append(equal, False) | np.append(False, equal)
    keep[slice(*np.searchsorted(sig, np.array([KIND_MARK << 62, KIND_KEPT << 62], np.uint64)))] = True
    at = np.searchsorted(sig, hot.value[0])  # several rows of one signature are kept already
    at = at[at < len(sig)]
    keep[at] |= np.isin(sig[at], hot.value[0])
    sig, order = sig[keep], order[keep]
    node = np.frombuffer(joined("nodes"), np.int64)[np.searchsorted(ends, order, side="right")]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]  # copies in several tasks
    sig, node = sig[once], node[once]
    if len(sig):
        first = _cuts(sig[1:] != sig[:-1])
        m = np.diff(first, append=len(sig))
        content = np.bitwise_xor.reduceat(mix64(node.view(np.uint64), 13), first).view(np.int64)
        leader, m, content = (np.repeat(x, m) for x in (node[first], m, content))  # nodes are in order
    else:
        leader = m = content = node
    split = _pieces(sig, hot) > 0
    keep = (m > 1) | split | (sig >> np.uint64(62) == KIND_MARK)
    return pa.RecordBatch.from_arrays(
        [pa.array(x[keep]) for x in (sig.view(np.int64), node, split, leader, m, content)], ["sig", "node", "split", "leader", "m", "content"])


def _gathered(hot):
    """Members of each place; the packed rows come sorted by place."""
    def run(batches):
        release()
        at, parts = None, []
        for b in batches:
            place = b.column(b.schema.get_field_index("place")).to_numpy()
            first = _cuts(place[1:] != place[:-1]).tolist() if len(place) else []
            for a, z in zip(first, [*first[1:], len(place)]):
                if parts and place[a] != at:
                    yield _members(parts, hot)
                    parts = []
                at = place[a]
                parts.append(b.slice(a, z - a))
        if parts:
            yield _members(parts, hot)
        parts = b = None
        release()

    return run


def _candidate_sets(words: int, text: str, bloom):
    def run(batches):
        shingler, bits = Shingler(words), np.frombuffer(bloom.value, np.uint8)
        for part in slices(batches, text):
            at = part.column(part.schema.get_field_index("bit")).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            texts = texts_of(part.take(pa.array(hit)), text)
            sets = [s for s in shingler.sets(texts) if len(s)] if texts else []
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([sketch_of(s) for s in sets], pa.binary()), pa.array([fine_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([[int(mix64(s, 21 + i).min().view(np.int64)) for i in range(LOWEST)] for s in sets], pa.list_(pa.int64()))],
                    ["node", "n", "sketch", "fine", "elements", "lowest"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            a, z = (b.column(b.schema.get_field_index(c)) for c in ("a_elements", "b_elements"))
            ok = []
            for x, y in zip(a, z):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _gap(bits: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits as a share of what may differ, and whether the pair can be similar enough."""
    apart = np.bitwise_count(bits ^ other).sum(-1, dtype=np.int64) * (100 + percent)
    most = (n + m) * (100 - percent)
    return apart / most, (apart <= most) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)


def _near(percent: int):
    """Of pairs with sketches, those that can be similar enough, and how near they look."""
    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            bits = [np.frombuffer(b"".join(col(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("a_sketch", "b_sketch")]
            gap, ok = _gap(*bits, col("a_n").to_numpy(), col("b_n").to_numpy(), percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep), pa.array(gap[ok])], ["a", "b", "gap"])

    return run


def _finer(percent: int):
    """Of pairs with fine sketches, those that can be similar enough."""
    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            most = (col("a_n").to_numpy() + col("b_n").to_numpy()) * (100 - percent)
            gap = [fine_gap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(col("a_fine"), col("b_fine"))]
            keep = pa.array(np.array(gap, np.int64) * (100 + percent) <= most)
            yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep)], ["a", "b"])

    return run


def _pairs_of(node, label, n, bits, in_first, in_last, same, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.flatnonzero(in_first), np.flatnonzero(in_last)
    may = label[left][:, None] != label[right][None, :]
    may &= node[left][:, None] < node[right][None, :] if same else True
    x, y = np.nonzero(may)
    if not len(x):
        return node[:0], node[:0]
    x, y = left[x], right[y]
    gap, ok = _gap(bits[x], bits[y], n[x], n[y], percent)
    gap, x, y = gap[ok], x[ok], y[ok]
    if forest:
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        kept = []
        for at in np.argsort(gap, kind="stable").tolist():
            p, q = root(int(label[x[at]])), root(int(label[y[at]]))
            if p != q:
                parent[p] = q
                kept.append(at)
        x, y = x[kept], y[kept]
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def _block_pairs(percent: int, forest: bool):
    """Pairs of two blocks of a bucket that lie in different components and can be similar enough. With `forest`, only the
    nearest-looking ones that would join all components that can be joined: fewer than the blocks have components.
    The rows come sorted by (sig, low, high); a group of at most two blocks may lie in two batches."""
    def groups(t: pa.Table, end: bool):
        """The pairs of all groups but the last one, which is returned as rest unless nothing follows."""
        col = {c: t.column(c).to_numpy() for c in ("sig", "low", "high", "node", "label", "n", "block")}
        new = np.flatnonzero(np.any([col[c][1:] != col[c][:-1] for c in ("sig", "low", "high")], axis=0)) + 1
        cuts = [0, *new.tolist(), *([t.num_rows] if end else [])]
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        out = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            first, last = col["low"][a], col["high"][a]
            block = col["block"][a:z]
            out.append(_pairs_of(col["node"][a:z], col["label"][a:z], col["n"][a:z], bits[a:z], block == first, block == last, first == last, percent, forest))
        cat = lambda i: pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(0), cat(1)], ["a", "b"]), t.slice(cuts[-1])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            if rest.num_rows:
                pairs, rest = groups(rest, False)
                yield pairs
        if rest is not None and rest.num_rows:
            yield groups(rest, True)[0]

    return run


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both sets, as a_... and b_...; the sets' other rows aren't shuffled if the pairs are few."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if pairs.count() <= FEW_PAIRS:
        sets = sets.join(F.broadcast(nodes), "node", "left_semi")
    side = lambda c: sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{x}" for x in columns for c in "ab"))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _sides(pairs, sets, "n", "fine").mapInArrow(_finer(percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _sides(pairs, sets, "elements").mapInArrow(_verify(percent), "a long, b long")


def _fixed_bloom(spark: SparkSession, keys: DataFrame):
    """A bitmap of fixed size over the `bit` column, as a broadcast. When it fills up it only lets more rows through."""
    words = keys.groupBy(F.expr("bit div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 32 AS INT)))").alias("b")).toPandas()
    bits = np.zeros(BLOOM_BITS // 32, "<u4")
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype("<u4")
    return spark.sparkContext.broadcast(bits.tobytes())


def components(links: DataFrame, a: str = "a", b: str = "b", store=written) -> DataFrame:
    """node, label (smallest node of its component) for all nodes of the links, by alternating large and small stars;
    every round is written to the shared folder, by `store`."""
    edges = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = store(small, "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _kind(sig: str = "sig") -> Column:
    return F.shiftrightunsigned(sig, 62)


def _without_hottest(hot: DataFrame, marks: DataFrame) -> DataFrame:
    """sig, node of the hot buckets' members without the partitions that the nodes leave out."""
    parity = F.shiftrightunsigned("sig", 61).bitwiseAND(F.lit(1)).alias("parity")
    slot = F.when(_kind() == KIND_SMALL, F.shiftrightunsigned("sig", 51)).otherwise(F.shiftrightunsigned("sig", 37)).alias("slot")
    rows = hot.select("sig", "node", F.floor(F.log2("m")).cast("int").alias("heat"), parity, slot)
    heats = rows.where(_kind() != KIND_KEPT).groupBy("node", "parity", "slot").agg(F.max("heat").alias("heat"))
    heats = heats.groupBy("node", "parity").agg(F.sort_array(F.collect_list("heat"), asc=False).alias("heats"))  # at most a node's partitions
    may = marks.select("node", parity, F.shiftrightunsigned("sig", 37).bitwiseAND(F.lit(LARGE - 1)).cast("int").alias("may"))
    # Classes above the hottest partition that must stay are left out.
    first = heats.join(may, ["node", "parity"]).select("node", "parity", F.coalesce(F.expr("try_element_at(heats, may + 1)"), F.lit(0)).alias("kept"))
    rows = rows.join(first, ["node", "parity"], "left")
    return rows.where(F.col("kept").isNull() | (F.col("heat") <= F.col("kept")) | (_kind() == KIND_KEPT)).select("sig", "node")


def _hot_signatures(sampled: DataFrame):
    """Places to deal to, and signatures that are dealt in pieces with their number, as a broadcast. What the sample holds decides
    where rows go, not which ones."""
    sampled = written(sampled.distinct(), "sampled")
    rows = sampled.count()
    counts = sampled.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= max(SPLIT, math.ceil(rows / HOTTEST)))
    hot = counts.select("sig", F.ceil(F.col("m") / SPLIT).alias("pieces")).toPandas()
    forget(sampled)
    spark = sampled.sparkSession
    _let_go(spark)
    sigs, pieces = hot["sig"].to_numpy(np.int64).view(np.uint64), hot["pieces"].to_numpy(np.int64)
    order = np.argsort(sigs)
    return math.ceil(rows * SAMPLE / PLACE) or 1, spark.sparkContext.broadcast((sigs[order], pieces[order]))


def _grouped(packed: DataFrame, places: int, hot) -> DataFrame:
    """sig, node with leader (smallest node), m (nodes) and content of the bucket, or of a part of it where it is split. Buckets
    with one node are left out, marks and parts are not. Places are dealt in turn, so that each task has as many."""
    return packed.repartitionById(min(places, TASKS), "place").sortWithinPartitions("place").mapInArrow(_gathered(hot), MEMBERS)


def _whole(members: DataFrame) -> DataFrame:
    """Members with what their whole bucket has, of which places have only a part where it is split."""
    split = members.where("split").select("sig", "node")
    total = split.groupBy("sig").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(node))").alias("content"))
    split = split.join(F.broadcast(total), "sig")  # a row for each hot signature
    return members.where("NOT split").drop("split").unionByName(split)


def _distinct_buckets(packed: DataFrame, places: int, hot) -> DataFrame:
    """sig, node, leader (its smallest node) of buckets with several nodes; of buckets with the same members, one. Signatures
    are dealt out once; near copies share many, so that few buckets are left of them."""
    members = written(_grouped(packed, places, hot), "members")
    _let_go(packed.sparkSession)
    whole = _whole(members)
    real, marks = whole.where((_kind() != KIND_MARK) & (F.col("m") > 1)), whole.where(_kind() == KIND_MARK)
    cooled = _without_hottest(real.where(F.col("m") >= HOT), marks).mapInArrow(_packed(_plain_rows, places, hot), PACKED)
    cooled = written(_grouped(cooled, places, hot), "members")
    members_left = real.where(F.col("m") < HOT).unionByName(_whole(cooled).where("m > 1"))
    first = members_left.where("node = leader").groupBy("leader", "m", "content").agg(F.min("sig").alias("sig")).select("sig")
    buckets = written(members_left.join(first, "sig", "left_semi").select("sig", "node", "leader"), "buckets")
    forget(members, cooled)
    return buckets


def _open_blocks(buckets: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, dealt into blocks by hash and these into pairs of blocks. The members
    of a bucket's largest component make blocks of their own, which aren't paired with each other."""
    of = buckets.select("sig", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    size = of.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"))
    size = size.groupBy("sig").agg(F.max(F.struct("k", "label")).alias("main"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = of.join(size, "sig").select("sig", "node", "label", (F.col("label") == F.col("main.label")).alias("in_main"), F.col("main.k").alias("k"), (F.col("m") - F.col("main.k")).alias("others"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    own = F.when(F.col("in_main"), blocks("others") + place("k")).otherwise(place("others"))
    last = F.when(F.col("in_main"), blocks("others")).otherwise(blocks("others") + blocks("k")) - 1
    open_ = open_.withColumn("block", own).withColumn("last", last).join(sketches, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return open_.select("sig", "node", "label", "n", "sketch", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _let_go(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def membership(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id: the smallest key reachable by links of similarity >= percent, itself included."""
    spark, made = docs.sparkSession, []
    small_batches(spark)

    def store(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    docs = docs.select(key, text)
    kind = dict(docs.dtypes)[key]
    nodes = store(docs.mapInArrow(_nodes(words, key, text), f"`{key}` {kind}, n_shingles long, node long"), "nodes")
    sampled = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(text)
    places, hot = _hot_signatures(sampled.mapInArrow(_signatures(words, percent, text), "sig long, node long"))
    buckets = _distinct_buckets(docs.select(text).mapInArrow(_packed(partial(_rows, words, percent, text), places, hot), PACKED), places, hot)
    made.append(buckets)
    _let_go(spark)

    stars = store(buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BLOOM_BITS)).alias("bit")
    reps = nodes.groupBy("node").agg(F.min(key).alias(key)).join(wanted, "node", "left_semi")
    bloom = _fixed_bloom(spark, reps.select(bit).distinct())
    sets = docs.select(text, bit).mapInArrow(_candidate_sets(words, text, bloom), "node long, n long, sketch binary, fine binary, elements binary, lowest array<long>")
    sets = store(sets.join(wanted, "node", "left_semi"), "sets")
    sketches = sets.select("node", "n", "sketch").dropDuplicates(["node"])

    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    near = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(percent), "a long, b long, gap double")
    best = near(stars).groupBy("b").agg(F.min_by("a", F.struct("gap", "a")).alias("a")).select("a", "b")
    alike = sets.select(F.col("node").alias("b"), F.posexplode("lowest").alias("i", "low"))  # similar sets often share a lowest hash
    first = store(alike.groupBy("i", "low").agg(F.min("b").alias("a"), F.max("b").alias("b")).where("a <> b").drop("b"), "first")
    alike = alike.join(first, ["i", "low"]).where("a <> b").select("a", "b").distinct()
    likely = store(best.unionByName(near(alike).select("a", "b")).distinct(), "pairs")
    tested = store(_possible(likely, sets, percent), "pairs")
    links = store(_verified(tested, sets, percent), "links")
    _let_go(spark)
    labels = components(links, store=store)
    for forest in (True, False):
        open_ = _open_blocks(buckets, labels, sketches).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
        pairs = open_.mapInArrow(_block_pairs(percent, forest), "a long, b long").distinct()
        pairs = store(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        pairs = store(_possible(pairs, sets, percent), "pairs")
        if forest:  # one pair is enough to join two components
            of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
            named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
            x, y = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
            pairs = named.groupBy(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
            pairs = store(pairs, "pairs")
        if not pairs.head(1):
            continue
        links, tested = links.unionByName(store(_verified(pairs, sets, percent), "links")), tested.unionByName(pairs)
        _let_go(spark)
        labels = components(links, store=store)

    per_node = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = per_node.groupBy("label").agg(F.min("least").alias("component_id"))
    per_node = per_node.join(ids, "label").select("node", "component_id")
    out = nodes.join(per_node, "node", "left")
    out = written(out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id")), "membership")
    forget(*made)
    return out


def op9_partenum_join(spark, sf_dir: str) -> DataFrame:
    return membership(table(spark, sf_dir, "documents"))


def join_sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """The rows of the join by comparing all sets that share a shingle."""
    cut, last = cut_sql("text", r"[^\x20\x09-\x0D]+"), words - 1
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i : i + {last}], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {last}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT a, b FROM (SELECT s.r AS a, t.r AS b, count(*) AS c FROM s JOIN s AS t ON s.x = t.x AND s.r <> t.r GROUP BY ALL)
  JOIN n ON n.r = a JOIN n AS m ON m.r = b WHERE 100 * c >= {percent} * (n.n + m.n - c)),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.q),
c AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.q GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""
