"""Toxicity by a weighted finite-state grammar over clauses (operator 6).

Words, all runs of letters and digits, become symbols: insult, threat, target, negation, reporting, other. Five transducers read the symbols of a clause side by
side (their composition is compiled into one table): an insult adds its weight; a target marks the clause; a threat needs a
target within reach; a negation and a reporting word open a scope in which insults count on other tapes. A document's
score is a logistic function of what its clauses gave.

The insult lexicon is learned: whole words and word beginnings of 4 to 7 letters that labelled toxic documents have more often
(once, or twice and more) than others, by a z-score, added to a short fixed list. Lexicon and logistic weights are
fitted on a bounded sample of labelled rows, TRAIN_PER_CLASS of each class by a hash of the key.

Null and empty texts have no clauses; their score is that of a text without any match. Without labels of both classes the
score is 1 - exp(-weight / 4) over the fixed list. Rows with equal keys are scored each, and so are labels with equal keys
learned from. Very long texts are read whole, one at a time. A word with several terms has the heaviest, at equal weight the last
in order. An empty table gives no rows. `score` ignores extra columns, `clean_rows` keeps them all.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trailmark.llm.common import held_out, slices, table, texts_of, written

# The words that the grammar knows without labels.
INSULTS = "idiot idiots moron morons stupid loser losers trash scum pathetic disgusting worthless clown dumb imbecile fool cretin vermin filth".split()
THREATS = "kill hurt destroy beat burn crush stab shoot strangle töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she him her they them u du dich dir ihr euch sie tu te toi vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor nicht kein keine nie pas jamais aucun nunca jamás ni".split()
REPORTS = "said says called quoted wrote claimed alleged reportedly sagte behauptete schrieb dit écrit aurait dijo escribió".split()

TRAIN_PER_CLASS = 4000
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS = 4
LEAST_Z = 5.0
LEAST_WEIGHT = 1.5
SEED_WEIGHT = 3.0
NEGATION_REACH = 3
THREAT_REACH = 4
KNOWN_WORDS = 400_000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
BOUNDARY = ".,;:!?"
RUN = re.compile(r"\w+")
RUN_OR_BOUNDARY = re.compile(rf"\w+|[{BOUNDARY}]+")


class Transducer:
    """States 0..n-1 from 0; arcs[state][symbol] = (next state, tapes that the symbol's weight goes to)."""

    def __init__(self, arcs: list[dict[int, tuple[int, tuple[str, ...]]]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, tuple[str, ...]]:
        return self.arcs[state].get(symbol, self.arcs[state].get(-1, (state, ())))


def grammar() -> list[Transducer]:
    insult = Transducer([{INSULT: (0, ("insult",))}])
    target = Transducer([{TARGET: (1, ())}, {INSULT: (1, ("targeted",))}])
    waiting = [{TARGET: (0, ("threat",)), THREAT: (1, ()), -1: (i + 1 if i < THREAT_REACH else 0, ())} for i in range(1, THREAT_REACH + 1)]
    threat = Transducer([{THREAT: (1, ())}, *waiting])
    scope = [{INSULT: (i + 1 if i < NEGATION_REACH else 0, ("negated",)), NEGATION: (1, ()), -1: (i + 1 if i < NEGATION_REACH else 0, ())} for i in range(1, NEGATION_REACH + 1)]
    negation = Transducer([{NEGATION: (1, ())}, *scope])
    report = Transducer([{REPORT: (1, ())}, {INSULT: (1, ("reported",))}])
    return [insult, target, threat, negation, report]


def compose(parts: list[Transducer], symbols: int = 6) -> list[list[tuple[int, tuple[str, ...]]]]:
    """The product of transducers that read the same symbols, over its reachable states."""
    start = tuple(0 for _ in parts)
    number, out, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(symbols):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], tuple(t for _, tapes in steps for t in tapes)))
        out.append(row)
    return out


def terms_of(core: str) -> list[str]:
    return ["=" + core, *("^" + core[:n] for n in PREFIXES if len(core) >= n)] if len(core) > 2 else []


class Scorer:
    """Features of texts under a lexicon {(term): (weight, least occurrences)}."""

    TAPES = ("insult", "targeted", "negated", "reported", "threat")

    def __init__(self, lexicon: dict[str, tuple[float, int]]):
        self.lexicon, self.table, self.known = lexicon, compose(grammar()), {}
        self.fixed = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

    def entry(self, core: str) -> tuple[int, bool, str, float, int]:
        """symbol of a word or boundary, whether a clause ends with it, its strongest term, weight, least occurrences."""
        best = max(((self.lexicon[t][0], t) for t in terms_of(core) if t in self.lexicon), default=None)
        symbol = INSULT if best else self.fixed.get(core, OTHER)
        return symbol, core[0] in BOUNDARY, best[1] if best else "", best[0] if best else 0.0, self.lexicon[best[1]][1] if best else 0

    def features(self, text: str) -> list[float]:
        words = RUN_OR_BOUNDARY.findall(text.lower())
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.entry(w)
        entries = [known[w] for w in words]
        hot = [i for i, e in enumerate(entries) if e[0] == INSULT or e[0] == THREAT]
        sums = dict.fromkeys(self.TAPES, 0.0)
        n, top, kinds = 0, 0.0, set()
        if hot:
            seen: dict[str, int] = {}
            for i in hot:
                seen[entries[i][2]] = seen.get(entries[i][2], 0) + 1
            strong = {i for i in hot if entries[i][0] == THREAT or seen[entries[i][2]] >= entries[i][4]}
            done = -1
            for i in sorted(strong):
                if i <= done:
                    continue
                a = i
                while a > max(0, done + 1) and not entries[a - 1][1]:
                    a -= 1
                state, j = 0, a
                while j < len(entries):
                    symbol, end, _, weight, _ = entries[j]
                    if symbol == INSULT and j not in strong:
                        symbol = OTHER
                    state, tapes = self.table[state][symbol]
                    for t in tapes:
                        sums[t] += weight if t != "threat" else 1.0
                    if symbol == INSULT:
                        n, top = n + 1, max(top, weight)
                        kinds.add(words[j])
                    if end:
                        break
                    j += 1
                done = j
        per = 100.0 * n / max(1, sum(not e[1] for e in entries)) if n else 0.0
        return [*(float(np.log1p(sums[t])) for t in self.TAPES), float(np.log1p(n)), float(np.log1p(per)), top, float(np.log1p(len(kinds)))]


N_FEATURES = len(Scorer.TAPES) + 4


def _term_counts(text: str):
    """Documents by (term, 1 or 2 occurrences at least)."""
    def run(batches):
        counts = {}
        for part in slices(batches, text):
            for t in texts_of(part, text):
                own: dict[str, int] = {}
                for w in RUN.findall(t.lower()):
                    for x in terms_of(w):
                        own[x] = own.get(x, 0) + 1
                for x, n in own.items():
                    counts[x, 1] = counts.get((x, 1), 0) + 1
                    if n > 1:
                        counts[x, 2] = counts.get((x, 2), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "times", "n"])

    return run


def _features(lexicon, columns: list[str], text: str):
    def run(batches):
        scorer = Scorer(lexicon.value)
        for part in slices(batches, text):
            x = [scorer.features(t) for t in texts_of(part, text)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in columns), pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A stored table of y, text with at most per_class rows of each class, and the sizes of the classes."""
    rows = labels.where(~held_out(F.col("doc_id"))).where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    order = F.xxhash64("_id", F.lit(1))
    picked = rows.where("y = 1").orderBy(order, "_id").limit(per_class).unionByName(rows.where("y = 0").orderBy(order, "_id").limit(per_class))
    d = docs.where(~held_out(F.col(key))).select(F.col(key).alias("_id"), F.col(text).alias("text"))
    return written(d.join(F.broadcast(picked), "_id").select("y", "text"), "toxic-sample"), sizes  # at most 2 * per_class rows


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[float, int]]:
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    seeds = {"=" + w: (SEED_WEIGHT, 1) for w in INSULTS}
    if not n.get(0) or not n.get(1):
        return seeds

    def counted(y: int, name: str) -> DataFrame:
        d = sample.where(F.col("y") == y).select("text").mapInArrow(_term_counts("text"), "term string, times int, n long")
        return d.groupBy("term", "times").agg(F.sum("n").alias(name))

    d = counted(1, "k").where(F.col("k") >= LEAST_DOCS).join(counted(0, "m"), ["term", "times"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    p = (F.col("k") + F.col("m")) / (n[0] + n[1])
    z = (F.col("k") / n[1] - F.col("m") / n[0]) / F.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
    weight = F.log((F.col("k") + 0.5) / (n[1] + 1)) - F.log((F.col("m") + 0.5) / (n[0] + 1))
    d = d.select("term", "times", z.alias("z"), weight.alias("weight")).where((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT))
    found = sorted(((r["z"], r["term"], r["times"], r["weight"]) for r in d.collect()), key=lambda f: (-f[0], f[1], f[2]))  # terms of the bounded sample
    out = dict(seeds)
    for _, term, times, weight in found:
        if term not in out or weight > out[term][0]:
            out[term] = (weight, times)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = TRAIN_PER_CLASS):
    """(lexicon, logistic weights or None) from labels doc_id, toxic; rows of the held-out fold teach nothing."""
    sample, sizes = training_sample(docs, labels, key, text, per_class)
    lexicon = learn_lexicon(sample)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)
    got = sample.mapInArrow(_features(shared, ["y"], "text"), "y int, x array<double>").collect()  # at most 2 * per_class rows
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return lexicon, None
    x = np.array([r["x"] for r in got])
    share = {c: sizes[c] / max(1, (y == c).sum()) for c in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return lexicon, fit_logistic(x[order], y[order], (w * len(y) / w.sum())[order])


def _scores(scorer: Scorer, beta: np.ndarray | None, texts: list[str]) -> np.ndarray:
    x = np.array([scorer.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
    if beta is None:
        return np.round(1 - np.exp(-np.expm1(x[:, 0]) / 4), 12)
    return np.round(1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -35, 35))), 12)


def _clean(model, text: str):
    def run(batches):
        lexicon, beta = model.value
        scorer = Scorer(lexicon)
        for part in slices(batches, text):
            yield part.filter(pa.array(_scores(scorer, beta, texts_of(part, text)) < 0.5))

    return run


def clean_rows(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), text), docs.schema)


def _score(model, key: str, text: str):
    def run(batches):
        lexicon, beta = model.value
        scorer = Scorer(lexicon)
        for part in slices(batches, text):
            score = _scores(scorer, beta, texts_of(part, text))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return run


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: terms of the bounded sample
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(_score(shared, key, text), f"`{key}` {kind}, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
