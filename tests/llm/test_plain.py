"""Learned operators against plain versions of their methods, on small inputs."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tests.llm import brute
from trailmark.llm import language, quality, toxicity, urls


def test_rules_are_all_minimal_ones(spark):
    """Every itemset is counted; a rule stays unless a part of it is as sure."""
    rnd = random.Random(8)
    rows = []
    for _ in range(300):
        t = sorted(rnd.sample("abcdefgh", rnd.randrange(1, 6)))
        sure = {"a", "b"} <= set(t) or "h" in t or {"c", "d", "e"} <= set(t)
        rows.append((t, sure and rnd.random() < 0.97 or rnd.random() < 0.02))
    rows += [(["z", "z"], True)] * 12 + [(None, False), ([], True)]
    n, bad = len(rows), sum(b for _, b in rows)
    hits, seen = Counter(), Counter()
    for t, b in rows:
        for k in range(1, len(set(t or ())) + 1):
            for a in combinations(sorted(set(t)), k):
                seen[a] += 1
                hits[a] += b
    sure = {a: hits[a] / seen[a] for a in seen if hits[a] >= 5 and hits[a] / seen[a] >= 0.9 and hits[a] / seen[a] * n / bad >= 1.5}
    want = {a: (c, hits[a] / n) for a, c in sure.items() if not any(sure.get(p, 0) >= c for k in range(1, len(a)) for p in combinations(a, k))}
    got = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), least_count=5)
    assert {a: (pytest.approx(c), pytest.approx(s)) for a, c, s in got} == want
    assert len(got) == len(want) and any(len(a) > 1 for a in want) and ("z",) in want


def test_urls_are_split_and_judged(spark):
    cases = ["HTTP://A.Example.ORG/es/1?x=//#y", "http://example.org/en/17", "http://notexample.org/es/", "http://x.COM/fr/a", "http://x.com/de/", "https://x.com", "s://x.com#/de/",
             "s://x.com?/de/", "no scheme/x", "", None, "://", "a://b://c/d", "http://example.org/es", "http://example.org/en/1", "http://ÄÖ.Org/", "http://h/" + "p/" * 50_000]
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge_urls(rows, [(("path=p",), 1.0, 0.5)]).collect()}
    for i, url in enumerate(cases):
        host, path, rule, verdict = brute.url_parts(url or "", urls.GIVEN)
        mined = None if path.count("p/") < 2 else "path=p"
        assert tuple(got[i])[1:] == (host, path, rule, verdict or ("block" if mined else "allow"), mined), url


def test_language_is_naive_bayes(spark):
    rnd = random.Random(9)
    alphabets = {"aa": "abcdeÉ ", "bb": "bcdefg- ", "cc": "日本語文字 "}
    text = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    learned = [(text(a, rnd.randrange(200)), lang) for lang, a in alphabets.items() for _ in range(12)] + [(None, "aa"), ("x y", None), ("", "bb")]
    tried = [text(a, n) for a in alphabets.values() for n in (1, 3, 8, 40, 400)] + [None, "", "12 !", "a" * 60_000]
    model = language.train(spark.createDataFrame(learned, "text string, lang string"), block=2)
    got = language.identify(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).collect()
    want = brute.naive_bayes(learned, tried, language.BITS, language.ORDERS, language.SMOOTHING)
    assert len(got) == len(tried)
    for r in got:
        lang, score, gap = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=2e-3)
        assert gap < 1e-3 or r["lang_pred"] == lang


def test_composed_transducers_are_their_product():
    """Each transducer alone over each clause gives the sums of the composed ones."""
    rnd = random.Random(10)
    lexicon = {"=idiot": (3.0, 1), "^mor": (9.0, 1), "^moro": (2.0, 1), "=scum": (1.5, 2)}
    scorer = toxicity.Scorer(lexicon)
    vocabulary = ["idiot", "moron", "scum", "kill", "you", "not", "said", "tree", "blue", ".", ","]
    symbols = {"kill": toxicity.THREAT, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT}
    for n in (0, 1, 5, 30, 400, 30_000):
        words = [rnd.choice(vocabulary) for _ in range(n)]
        weight = {"idiot": 3.0, "moron": 2.0} | ({"scum": 1.5} if words.count("scum") >= 2 else {})
        sums, state = dict.fromkeys(scorer.TAPES, 0.0), None
        parts = toxicity.grammar()
        for w in words:
            state = state or [0] * len(parts)
            symbol = toxicity.INSULT if w in weight else symbols.get(w, toxicity.OTHER)
            for i, p in enumerate(parts):
                state[i], tapes = p.step(state[i], symbol)
                for t in tapes:
                    sums[t] += 1.0 if t == "threat" else weight[w]
            state = None if w in ".," else state
        insults = [w for w in words if w in weight]
        per = 100 * len(insults) / max(1, sum(w not in ".," for w in words))
        want = [*(math.log1p(sums[t]) for t in scorer.TAPES), math.log1p(len(insults)), math.log1p(per), max((weight[w] for w in insults), default=0.0)]
        got = scorer.features(" ".join(words))
        assert got[:-1] == pytest.approx(want)


def test_references_and_verdicts_of_quality(spark):
    rnd = random.Random(11)
    common = {"aa": "the of and to in".split(), "bb": "der die und zu im".split()}
    docs = []
    for i in range(60):
        lang = rnd.choice(["aa", "bb"])
        w = [rnd.choice(common[lang]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdeXYZ019#&.") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.choice([5, 30, 59, 60, 200]))]
        docs.append((i, " ".join(w), lang))
    docs += [(60, None, "aa"), (61, "", "bb"), (62, " ".join("".join(rnd.choice("#%*|") for _ in range(4)) for _ in range(300)), None), (63, "lone words here", "cc"), (63, "lone words here", "cc")]
    rnd.shuffle(docs)
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, lang string, n_words int, kept string")
    refs, want = brute.divergences(docs, quality)
    got_refs = quality.references(d)
    assert got_refs.keys() == refs.keys()
    for lang, r in refs.items():
        assert got_refs[lang]["classes"] == pytest.approx(r["classes"]) and got_refs[lang]["words"] == pytest.approx(r["words"])
    got = sorted(((r["doc_id"], r["base_failed"], r["kept"], r["divergence"]) for r in quality.judge(d).collect()), key=lambda r: r[0])
    assert [g[:3] for g in got] == [w[:3] for w in want] and len({g[2] for g in got if not g[1]}) == 2
    assert all((g[3] is None and w[3] is None) or g[3] == pytest.approx(w[3], abs=1e-9) for g, w in zip(got, want))
