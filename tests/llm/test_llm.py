import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import assert_same, connect
from trailmark.llm import html, jaccard, language, mixing, phrases, quality, tokens, toxicity, urls
from trailmark.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, label long, n int"
LABEL = "doc_id long, quality int, toxic int"
PAGE = "page_id long, url string, html string, host string"
ITEM = "item_id long, text string, items string"


def words(seed, n, size=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def save(spark, path, docs, labels=(), pages=(), items=()):
    for name, rows, schema in (("documents", docs, DOC), ("labels", labels, LABEL), ("pages", pages, PAGE), ("benchmark", items, ITEM)):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = words(1, 300, 5000)
    near = base.replace("w1", "v1", 3)
    texts = [None, "", " \n\t ", "a", "a b", "A  b", base, base, near, base.upper(), "x" * 30_000, words(2, 20_000), words(3, 9) + "\n" + words(3, 9) + "\n\n" + words(3, 9),
             "ünïcödé 日本語 text " + words(4, 30), base + " idiot. you stupid moron!", "a\x00b \ud7ff \x1c c"]
    docs = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "S"][i % 4], len(t or ""), 1, "k", 2, 3) for i, t in enumerate(texts)]
    docs += [docs[6], docs[6], (None, base, "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    pages = [(0, None, None, "h"), (1, "", "", "h"), (2, "no scheme/x", "<p>x", "h"), (3, "HTTP://A.Example.ORG/es/1?x=//#y", "<article><h1>A &amp; B</h1><p>c\n d<br>e<p>f</article><footer>g</footer>", "h"),
             (4, "http://example.org/en/17", "<!-- x", "h"), (5, "http://notexample.org/es/", "<script>if (a<b) '</p>'", "h"), (5, "http://notexample.org/es/", "<div class='ad'>buy</div>", "h"), (6, "s://x.com#/de/", "<", "h")]
    items = [(1, words(1, 300, 5000).split(" ", 12)[0]), (2, " ".join(words(1, 300, 5000).split()[20:45])), (3, None), (4, "..."), (5, "A b"), (None, "日本語")]
    labels = [(i, i % 2, int(i == 14)) for i in range(10, 16)] + [(None, None, None), (11, None, 1)]
    return save(spark, tmp_path_factory.mktemp("odd"), docs, labels, pages, [(*i, None) for i in items])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), [])


def rows(spark, sf, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_token_counts"}))
def test_odd_rows_each_give_one(spark, odd, name):
    assert QUERIES[name](spark, odd).count() == (8 if name in ("op2_html_blocks", "op4_url_rules") else 20)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, odd, name):
    for sf in (odd, SF):
        assert_same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def order(r):
    return tuple((v is None, str(v)) for v in r)


def test_token_files_and_counts(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    for sf in (odd, SF):
        want, lengths = [], []
        for k, text in sorted(rows(spark, sf), key=lambda r: (r[0] is not None, r[0])):
            ids = t.encode(text or "", add_special_tokens=False).ids
            lengths.append(len(ids))
            want.append((k, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        got = sorted(QUERIES["op3_token_files"](spark, sf).collect(), key=lambda r: r["start"])
        assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got), key=order) == sorted(want, key=order)
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        assert [r["doc_id"] for r in got if r["doc_id"] is not None] == [k for k, *_ in want if k is not None]
        h = {r["length"]: r for r in QUERIES["op1_token_counts"](spark, sf).collect()}
        assert {n: h[n]["n_docs"] for n in h} == {n: lengths.count(n) for n in lengths}
        for n, r in h.items():
            assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
            assert r["tokens_truncated"] == sum(min(x, n) for x in lengths) and math.isclose(r["quantile"], sum(x <= n for x in lengths) / len(lengths))
    got = tokens.totals_at(tokens.length_histogram(spark.read.parquet(f"{SF}/documents.parquet")), [7, 500]).collect()
    assert [tuple(r) for r in got] == [(c, len(lengths), sum(x > c for x in lengths), sum(lengths), sum(min(x, c) for x in lengths)) for c in (7, 500)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_format(spark, tmp_path, encoding):
    import glob

    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens.write_token_files(docs, str(tmp_path / encoding), encoding=encoding, row_group_bytes=64 << 10)
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/{encoding}/*.parquet"))[0]).metadata.row_group(0)
    ids = [meta.column(i) for i in range(meta.num_columns) if "ids" in meta.column(i).path_in_schema][0]
    assert any(("DELTA" if encoding == "delta" else "DICTIONARY") in e for e in ids.encodings) and ids.has_column_index


def test_cuts_never_change_ids():
    import pyarrow as pa

    e = tokens.PieceEncoder(tokens.tokenizer_path(), cached=3)
    texts = ["", " ", " a", "a ", "a  b", "a \n b", "a\n\nb c", "\u3000a b\u00a0 c", "it's 'll  x", "a <|endoftext|> b", "日本 語 12 3", "\x1c a \x1c b"]
    texts += ["word, word; (x) w\u00e9ll!! don't. naïve—x", "z" * 5000 + " " + "z" * 5000, "a\tb c\u2003d e\u0085f", "x y" * 3000]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in [*zip(texts, want)] * 2:
        assert e.encode(pa.array([t]))[0].tolist() == ids
    for end in (None, 0):
        ids, n = e.encode(pa.array([None, *texts, None]).slice(1), end)
        extra = [] if end is None else [end]
        assert ids.tolist() == [i for w in [*want, []] for i in [*w, *extra]] and n.tolist() == [len(w) + len(extra) for w in [*want, []]]
    assert e.lengths(pa.array(texts)).tolist() == [len(w) for w in want]


def test_token_files_are_read_in_part(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of document "), F.col("id")).alias("text"))
    out = str(tmp_path / "tokens")
    tokens.write_token_files(docs, out, page_bytes=1 << 10)
    some = tokens.select_tokens(spark, out, low=1000, high=1009)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(1000, 1010))
    whole = {r["doc_id"]: r["ids"] for r in tokens.select_tokens(spark, out).collect()}
    assert len(whole) == 4000 and all(whole[r["doc_id"]] == r["ids"] for r in some.collect())

    def rows_scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    some = tokens.select_tokens(spark, out, low=1000, high=1009)
    assert rows_scanned(some) < 2000  # pages of the row group are skipped
    lengths = tokens.select_tokens(spark, out, low=1000, high=1009, ids=False)
    assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


@pytest.mark.parametrize("n,percent,sample,split,block", [(4, 85, 64, 100, 256), (5, 80, 64, 100, 256), (2, 60, 64, 100, 256), (4, 85, 1, 2, 2), (2, 60, 3, 1, 3)])
def test_join_finds_every_link(spark, monkeypatch, n, percent, sample, split, block):
    for name, value in (("SAMPLE", sample), ("SPLIT", split), ("BLOCK", block)):  # small ones deal buckets in pieces and blocks
        monkeypatch.setattr(jaccard, name, value)
    rnd, docs = random.Random(n), []
    for g in range(25):
        base = words(g, rnd.randrange(3, 200), 3000).split()
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
            docs.append((len(docs), " ".join(w)))
    got = jaccard.membership(spark.createDataFrame(docs, "doc_id long, text string"), words=n, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute.jaccard_components(docs, n, percent)


def test_signatures_of_similar_sets_meet():
    rnd = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        for size in (3, 7, 13, 40, 150, 700):
            for _ in range(30):
                s = rnd.integers(0, 2**63, size, dtype=np.uint64)
                drop = rnd.integers(0, size // 4 + 1)
                t = np.concatenate([s[drop:], rnd.integers(0, 2**63, rnd.integers(0, size // 8 + 1), dtype=np.uint64)])
                common = size - drop
                if len(t) and set(s) != set(t) and 100 * common >= percent * (len(s) + len(t) - common):
                    known = jaccard.bands(percent, max(len(s), len(t)))
                    assert set(jaccard.signatures(np.unique(s), percent, known)) & set(jaccard.signatures(np.unique(t), percent, known))


def test_left_out_signatures_leave_one_in_common():
    """Whatever is hot: random heats, and the worst ones, on what two sets at the limit of similarity share."""
    rnd = np.random.default_rng(6)
    for percent in (60, 80, 85):
        for size in (13, 60, 300, 900):
            for trial in range(20):
                drop = size * (100 - percent) // (100 + percent)
                s = rnd.integers(0, 2**63, size, dtype=np.uint64)
                t = np.concatenate([s[drop:], rnd.integers(0, 2**63, drop, dtype=np.uint64)])
                known = jaccard.bands(percent, size)
                sigs = [jaccard.signatures(np.unique(x), percent, known) for x in (s, t)]
                shared = set(sigs[0].tolist()) & set(sigs[1].tolist())
                heat = {g: 3 if g in shared or trial % 2 else int(rnd.integers(0, 6)) for x in sigs for g in x.tolist()}
                if trial % 4 == 1:
                    heat = {g: int(rnd.integers(3, 9)) for g in heat}
                left = []
                for x in sigs:
                    real = [g for g in x.tolist() if g >> 62 != jaccard.KIND_MARK]
                    may = {g >> 61 & 1: g >> 37 & (jaccard.LARGE - 1) for g in x.tolist() if g >> 62 == jaccard.KIND_MARK}
                    slots = {}
                    for g in real:
                        slot = g >> 51 if g >> 62 == jaccard.KIND_SMALL else g >> 37
                        if heat[g] >= 3:
                            slots[slot] = max(slots.get(slot, 0), heat[g])
                    kept = {}
                    for parity in (0, 1):
                        order = sorted((h for k, h in slots.items() if k >> (10 if k < 1 << 13 else 24) & 1 == parity), reverse=True)
                        if parity in may:
                            kept[parity] = order[may[parity]] if may[parity] < len(order) else 0
                    left.append({g for g in real if heat[g] < 3 or heat[g] <= kept.get(g >> 61 & 1, 99)})
                assert left[0] & left[1]


class Held:
    def __init__(self, value):
        self.value = value


def test_packed_signatures_are_grouped():
    """Like a plain grouping, whatever the packs, places and pieces are."""
    rnd = np.random.default_rng(7)
    sig = rnd.integers(0, 400, 6000, dtype=np.uint64) << np.uint64(8)
    sig[rnd.random(6000) < 0.05] |= np.uint64(jaccard.KIND_MARK << 62)
    node = rnd.integers(-20, 20, 6000)
    sig, node = np.append(sig, np.arange(1000, 1700, dtype=np.uint64) << np.uint64(8)), np.append(node, np.full(700, 5))  # runs above 255
    for places, hot in ((1, {}), (1, {256: 3, 512: 1}), (7, {256: 3, 512: 1, 1 << 40: 9})):
        held = Held((np.array(sorted(hot), np.uint64), np.array([hot[k] for k in sorted(hot)], np.int64)))
        packs = [jaccard._pack(sig[a : a + 900], node[a : a + 900], places, held) for a in range(0, len(sig), 900)]
        table = pa.Table.from_batches(packs).sort_by("place").combine_chunks()
        got = [r for b in jaccard._gathered(held)(table.to_batches(max_chunksize=3)) for r in b.to_pylist()]
        want = {}
        for s, x in zip(sig.tolist(), node.tolist()):
            want.setdefault(s, set()).add(x)
        found = {}
        for r in got:
            s = r["sig"] % 2**64
            assert r["split"] == (s in hot) and r["node"] not in found.setdefault(s, set())
            assert r["split"] or (r["m"], r["leader"]) == (len(want[s]), min(want[s]))
            found[s].add(r["node"])
        assert found == {s: x for s, x in want.items() if len(x) > 1 or s in hot or s >> 62 == jaccard.KIND_MARK}
        same = {}
        for r in got:
            if not r["split"]:
                same.setdefault(r["content"], set()).add(frozenset(want[r["sig"] % 2**64]))
        assert all(len(x) == 1 for x in same.values())


def test_join_moves_few_bytes_for_a_signature(spark):
    """A node isn't written again for each of its signatures, however many partitions there are."""
    docs = [(i, words(i, 300, 10**6)) for i in range(500)]
    known = jaccard.bands(85, 300)
    count = sum(len(jaccard.signatures(s, 85, known)) for s in jaccard.Shingler(4).sets([t for _, t in docs]))
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    partitions, before = spark.conf.get("spark.sql.shuffle.partitions"), moved()
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        assert jaccard.membership(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert moved() - before < 10 * count


class Spied:
    """A function over batches that notes the bytes of each."""

    def __init__(self, run, path):
        self.run, self.path = run, path

    def __call__(self, batches):
        def noted():
            for b in batches:
                with open(self.path, "a") as f:
                    f.write(f"{b.get_total_buffer_size()}\n")
                yield b

        return self.run(noted())


def test_join_holds_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    nodes, path = jaccard._nodes, f"{tmp_path}/bytes"
    monkeypatch.setattr(jaccard, "_nodes", lambda *a: Spied(nodes(*a), path))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), "id", F.repeat(F.lit("abcd efg "), 500)).alias("text"))
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    try:
        assert jaccard.membership(docs).count() == 3000
    finally:
        spark.conf.unset(conf)
    seen = [int(x) for x in open(path)]
    assert sum(seen) > 12e6 and max(seen) < 5e6


def test_near_copies_move_texts_once(spark, odd):
    import corpus_pipeline as c

    conf = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(conf, "-1")
    try:
        plan = c.drop_near_copies(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(conf)
    assert plan.count("Exchange hashpartitioning") == 2


def test_join_odd_rows(spark, odd):
    keyed = [(k, t) for k, t in rows(spark, odd) if k is not None]
    got = [tuple(r) for r in QUERIES["op9_partenum_join"](spark, odd).collect() if r["doc_id"] is not None]
    assert sorted(got) == brute.jaccard_components(keyed)


def test_phrases(spark, odd):
    for sf in (odd, SF):
        items = [(("" if k is None else k), t) for k, t in rows(spark, sf, "benchmark")]
        want = sorted(brute.contamination([(-1 if k is None else k, t) for k, t in rows(spark, sf)], items))
        docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
        for block in (phrases.BLOCK_WORDS, 40):
            found = phrases.search(docs, bench, block_words=block).mapInArrow(phrases._digest("doc_id"), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
            assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in found.collect()) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "a x x x b c"), (4, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    hit = lambda slop: {r["doc_id"] for r in phrases.search(docs, items, slop=slop).collect() if r["items"]}
    assert hit(0) == {2} and hit(1) == {1, 2}


def test_quality(spark, odd):
    for sf in (odd, SF):
        got = sorted(((r["doc_id"] is None, str(r["doc_id"])), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in QUERIES["op7_quality_divergence"](spark, sf).collect())
        assert got == sorted(((k is None, str(k)), *brute.quality_base(t)) for k, t in rows(spark, sf))
    for r in QUERIES["op7_quality_divergence"](spark, SF).collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_divergence_is_jensen_shannon(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog " * 20, "en"), (2, "XX## 99 " * 40, "en")], "doc_id long, text string, lang string")
    refs = quality.references(docs)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}

    def js(p, q):
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))

    for i, t in ((1, "The cat and the dog " * 20), (2, "XX## 99 " * 40)):
        w, r = t.lower().split(), refs["en"]
        chars = [c for c in t if c not in " "]
        kinds = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: False, str.isdigit, lambda c: c in quality.SYMBOLS]
        p = [sum(map(k, chars)) / len(chars) for k in kinds]
        names = sorted(r["words"])
        pw = [w.count(x) / len(w) for x in names]
        want = (js([*p, 1 - sum(p)], r["classes"]) + js([*pw, 1 - sum(pw)], [*(r["words"][x] for x in names), 1 - sum(r["words"].values())])) / 2
        assert abs(got[i]["divergence"] - want) < 1e-9


def test_every_language_has_a_reference(spark):
    """More languages than 16, and one with less than a thousandth of the rows."""
    common = {i: [f"{a}{chr(97 + i)}" for a in "xyz"] for i in range(20)}
    text = lambda i, j: " ".join(f"{common[i][k % 3]} {'абвгд'[(k + j) % 5] * 9 if i == 19 else 'word' * 3}" for k in range(40))
    docs = [(i * 100 + j, text(i, j), f"l{i}") for i in range(19) for j in range(60)] + [(5000, text(19, 0), "l19")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert set(quality.references(docs)) == {f"l{i}" for i in range(20)}
    assert quality.judge(docs).where("divergence IS NULL OR divergence > 0.05").count() == 0


def test_mix_meets_targets(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        d = spark.read.parquet(f"{sf}/documents.parquet")
        m = mixing.mix(d)
        assert m.where("taken > 2 * size").count() == 0
        for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect():
            assert r["t"] == math.floor(r["g"]) and r["g"] <= 2 * r["s"]
        assert sorted(m.collect()) == sorted(mixing.mix(d.repartition(7)).collect())
    weights = mixing.targets(spark.createDataFrame([("a", 10), ("b", 100), (None, 100)], "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in weights}["a"] == 20.0 and abs(sum(r["target"] for r in weights) - 315) < 1e-9


def test_language(spark, odd):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = QUERIES["op5_language_id"](spark, sf).join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, odd).where("doc_id < 4").collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[3]["lang_pred"] in ("en", "de")


def test_every_language_is_learned(spark):
    """More languages than a block has, the last of them the rarest."""
    rnd = random.Random(3)
    docs = []
    for i in range(300):
        letters = [chr(0x4E00 + 20 * i + k) for k in range(12)]
        docs += [(len(docs), " ".join("".join(rnd.choices(letters, k=5)) for _ in range(12)), f"l{i:03}") for _ in range(2 if i < 299 else 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    blocks = language.train(d)
    assert sum(len(b[0]) for b in blocks) == 300 and [len(b[0]) for b in blocks] == [256, 44]
    want = {k: x for k, _, x in docs}
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(d, blocks).collect()} == want
    few = d.where("doc_id < 24")
    one, many = ({r["doc_id"]: tuple(r)[1:] for r in language.identify(few, language.train(few, block=n)).collect()} for n in (256, 5))
    assert all(one[k][0] == many[k][0] and abs(one[k][1] - many[k][1]) < 1e-3 for k in one)


def test_grammar():
    table = toxicity.compose(toxicity.grammar())
    scorer = toxicity.Scorer({"=idiot": (3.0, 1), "^gloom": (2.0, 2)})
    x = lambda t: dict(zip(scorer.TAPES, np.expm1(scorer.features(t)[:5]).round(6)))
    assert len(table) > 10 and x("an idiot.")["insult"] == 3 and x("you idiot.")["targeted"] == 3 and x("not an idiot.")["negated"] == 3
    assert x("she said: idiot. he said idiot")["reported"] == 3 and x("kill all of them")["threat"] == 1 and x("kill time")["threat"] == 0
    assert x("gloomy day")["insult"] == 0 and x("gloomy glooms")["insult"] == 4 and x("not. idiot")["negated"] == 0


def test_every_word_of_a_text_is_read():
    scorer = toxicity.Scorer({"=idiot": (3.0, 1), "=馬鹿野郎": (3.0, 1)})
    x = lambda t: dict(zip(scorer.TAPES, np.expm1(scorer.features(t)[:5]).round(6)))
    for t in ("l'idiot", "hello,idiot", "he—idiot", "and/idiot", "'idiot'", "(an idiot)", "今日は、馬鹿野郎。天気"):
        assert x(t)["insult"] == 3, t
    assert x("you—idiot")["targeted"] == 3 and x("you,idiot")["targeted"] == 0 and x("not ,idiot")["negated"] == 0 and x("you ' idiot")["targeted"] == 3
    assert scorer.features("idiot, idiot")[-1] == scorer.features("idiot idiot")[-1]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op6_toxicity"](spark, sf).join(lab, "doc_id").where("held_out").collect()
    bad, good = [r["predicted"] for r in got if r["toxic"] == 1], [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(bad) >= 0.6 * len(bad) and sum(good) <= 0.05 * len(good)


def test_urls(spark, odd):
    got = {r["page_id"]: r for r in QUERIES["op4_url_rules"](spark, odd).collect()}
    assert tuple(got[3])[1:5] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert tuple(got[4])[1:5] == ("example.org", "/en/17", "example.org/en/1", "block") and got[5]["rule"] == "org/"
    assert (got[6]["host"], got[6]["path"], got[2]["host"], got[0]["path"]) == ("x.com", "", "", "")
    rows_ = [(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(["b"], False)] * 30 + [(["c", "b"], True)] * 12 + [(["a", "b", "c"], True)] * 5
    rules = urls.mine_rules(spark.createDataFrame(rows_, "tokens array<string>, bad boolean"), least_count=3)
    assert {r[0] for r in rules} == {("c",), ("a", "b")}


def test_rare_bad_hosts_are_blocked_in_large_tables(spark):
    d = spark.range(30_000).selectExpr("array('host=good', concat('p=', id % 900)) tokens", "false bad").unionByName(spark.range(12).selectExpr("array('host=rare', 'p=1') tokens", "true bad"))
    assert ("host=rare",) in {r[0] for r in urls.mine_rules(d)}
    urls_ = [(i, f"http://{h}/x{i}") for i, h in enumerate(["best-casino.example.com", "my-casino.example.net", "casino.com"])]
    host, path = urls.split_url("url")
    d = spark.createDataFrame(urls_, "id int, url string").withColumn("host", host).withColumn("path", path).select(urls.tokens("url", "host", "path").alias("t"))
    assert all("part=casino" in r["t"] for r in d.collect())


def test_rules_below_certainty_are_kept_beside_many_sure_ones(spark):
    sure = [f"t{i:02}" for i in range(12)]
    rows_ = [(sure, True)] * 12 + [(["x", "y"], True)] * 19 + [(["x"], False), (["y"], False)] + [(["z"], False)] * 100 + [(["y"], False)] * 19
    rules = urls.mine_rules(spark.createDataFrame(rows_, "tokens array<string>, bad boolean"))
    assert {(r[0], round(r[1], 2)) for r in rules} == {((t,), 1.0) for t in sure} | {(("x",), 0.95), (("x", "y"), 1.0)}


def test_html(spark):
    model, test = html.train(), html.training_pages(150, 77)
    right = [((html.probabilities([e], model)[0] >= 0.5) == y).all() for e, y in test]
    assert np.mean(right) > 0.97
    page = ("<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy &amp; save</div><article><h1>Head&amp;line</h1>"
            "<p>First <b>bold</b>\n  words&nbsp;here.</p><p>Open <i>one<p>Two</p></article><div class='comments'><p>Nice read, thanks</p></div><footer>&copy; me</footer></body></html>")
    got = html.extract(spark.createDataFrame([(1, page)], "page_id long, html string"), ["page_id"]).first()
    assert got["text"] == "Head&line\nFirst bold words here.\nOpen one\nTwo" and got["n_chars"] == len(got["text"])


@pytest.mark.parametrize("name", ["comments", "sidebar"])
def test_html_reads_whole_paths_and_blocks(name):
    open_ = "<div class='wp-block-group alignwide is-layout-constrained wp-block-group-is-layout-constrained has-global-padding'>"
    deep = lambda x: open_ * 6 + x + "</div>" * 6
    page = ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>" + deep("<h1>Path opens</h1><p>The town opened its new path along the river.</p><p>Many people came.</p>")
            + f"</article><div class='{name}'>" + deep("<p>Nice read, thanks for posting it here.</p><p>I walked there with my dog.</p>") + "</div></body></html>")
    blocks = html.labelled_blocks([page], html.train(), html.PageReader(), html.Encoder())[0]
    assert [t for t, q in blocks if q >= html.KEEP_FROM] == ["Path opens", "The town opened its new path along the river.", "Many people came."]
    size = [len(x) for x in html.Encoder().page([("word " * 5000, ["p"], 0, "p")])[1]]
    assert size == [5000]


def test_html_drops_no_more_than_the_element():
    texts = lambda page: [b[0] for b in html.PageReader().blocks(page)]
    for odd_ in ("<video-js class=x></video-js>", "<object-view>", "<svg class='i'/>", "<svg a='>'/>", "<math/>", "<video src=x>", "<IFRAME src='x'>", "<svg><path d='M0'/></svg>", "<script>a</script>",
                 "<noscript>no</noscript>", "<object><object></object>", "<svg a=\"it's\">x</svg>", "<svg/><svg>x</svg>", "<template x=\">x</template>"):
        assert texts(f"<p>One</p>{odd_}<p>Two</p>") == ["One", "Two"], odd_
    assert texts("<p>One</p><scripted>Two</scripted><p>Three<script>x<p>Four") == ["One", "Two", "Three"]
    assert texts("<p>a</p><style>x") == texts("<p>a</p><!-- x") == ["a"]


def test_html_reads_malformed_and_deep_pages_in_linear_time():
    import time

    reader = html.PageReader(html.path_rows())
    for page in ('<p class="' * 300_000, "<a " * 1_000_000, "<div>x" * 500_000, '<p ">' * 600_001, "<!-- x <p> " * 300_000, "<div class=c%d>x" * 100_000, '<p class="' * 300_000 + ">", "<" * 3_000_000):
        began = time.process_time()
        blocks = reader.blocks(page)
        assert time.process_time() - began < 60, page[:20]
        assert page[:6] != "<div>x" or len(blocks) == 500_000
    texts = lambda page: [b[0] for b in html.PageReader().blocks(page)]
    assert texts("<p>One</p>two <b") == ["One", "two"] and texts("<p>One</p>two < 3") == ["One", "two < 3"]
    assert texts("<p>One</p>two <!-- x") == ["One", "two"] and texts("<p>One<!-- x </p>two") == ["One"]
    assert texts("<p>One<script>x</p>two <b") == ["One"] and texts("<p>One<!-- x -->") == ["One"] and texts("a < b") == ["a < b"] and texts("a <b c") == ["a"]


def test_items_with_one_window_are_listed_in_linear_time():
    found = phrases.item_windows([(i, "the same ten words in each of all these items") for i in range(50_000)] * 2)
    assert [len(v) for v in found.values()] == [50_000]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(4, 3, html.WIDTH)), rng.normal(size=(html.WIDTH + html.HIDDEN, 4 * html.HIDDEN)) * 0.3, rng.normal(size=4 * html.HIDDEN)
    up, kept = rng.normal(size=(4, 3, html.HIDDEN)), []
    html._lstm(x, w, b, kept)
    dx, dw, db = html._lstm_back(up, w, kept, html.WIDTH)
    f = lambda: (html._lstm(x, w, b) * up).sum()
    for arr, grad in ((x, dx), (w, dw), (b, db)):
        at = tuple(rng.integers(0, s) for s in arr.shape)
        arr[at] += 1e-5
        hi = f()
        arr[at] -= 2e-5
        lo = f()
        arr[at] += 1e-5
        assert abs((hi - lo) / 2e-5 - grad[at]) < 1e-4


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as c

    for sf in (empty, odd, SF):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        n = docs.count()
        for name, stage in c.STAGES[:-1]:
            out = c.written(stage(spark, docs, sf), "t")
            assert out.columns == docs.columns
            if name == "benchmark decontamination":
                keep = [r for r in docs.collect() if not brute.contamination([(0, r["text"])], [(k or 0, t) for k, t in rows(spark, sf, "benchmark")])[0][5]]
                assert out.count() == len(keep)
            if name == "near copies":
                texts = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=order)
                parts = brute.jaccard_components([(i, t) for i, (_, t) in enumerate(texts)], 5, 80)
                assert out.count() == len({p[2] for p in parts})
            docs = out
        assert c.run(spark, sf).count() == docs.count() and (n == 0) == (docs.count() == 0)
