"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=4):
    w = SPACE.findall((text or "").translate(LOWER))
    n = min(words, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def jaccard_components(rows, words=4, percent=85):
    """rows: (id, text). (id, set size, smallest id reachable) of each row."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def contamination(docs, items):
    windows = defaultdict(set)
    for k, t in items:
        w = ITEM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(k)
    sizes, out = {len(x) for x in windows}, []
    for k, t in docs:
        w = ITEM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        names = ",".join(sorted(map(str, found)))
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def quality_base(text):
    t = text or ""
    w = SPACE.findall(t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def url_parts(url, rules):
    """host, path, given rule, its verdict."""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, fits = host.translate(LOWER), []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), verdict, rule))
    return (host, path, *max(fits)[:0:-1]) if fits else (host, path, None, None)


def _grams(text, bits, orders):
    chars = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text + "\n")
    codes = [ord(c) for c in re.sub(" +", " ", chars)]
    for n in orders:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            yield ((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> (32 - bits)


def naive_bayes(learned, texts, bits, orders, smoothing):
    """(language, its posterior, its lead over the next in log probability) of each text."""
    rows, counts = Counter(), defaultdict(Counter)
    for text, lang in learned:
        if text is not None and lang is not None:
            rows[lang] += 1
            counts[lang].update(_grams(text, bits, orders))
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0, 9.0))
            continue
        grams, logs = list(_grams(text, bits, orders)), []
        for lang in sorted(rows):
            total = sum(counts[lang].values()) + smoothing * 2**bits
            logs.append((math.log(rows[lang] / sum(rows.values())) + sum(math.log((counts[lang][g] + smoothing) / total) for g in grams), lang))
        top = sorted(logs, reverse=True)
        out.append((top[0][1], 1 / sum(math.exp(x - top[0][0]) for x, _ in logs), top[0][0] - top[1][0]))
    return out


def _classes(text, symbols):
    kinds = [0] * 6
    for c in "".join(SPACE.findall(text)):
        kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isalpha() else 3 if c.isdecimal() else 4 if c in symbols else 5] += 1
    return kinds


def _js(p, q):
    """Jensen-Shannon distance of two histograms, base 2."""
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def divergences(docs, q):
    """References by language, and (id, base_failed, kept, divergence) by id; q holds the method's values."""
    short = lambda t: [w.lower() for w in SPACE.findall(t or "") if len(w) <= q.COMMON_LETTERS]
    refs, out = {}, []
    for lang in sorted({x for _, _, x in docs if x}):
        texts = [t or "" for _, t, x in docs if x == lang]
        total = sum(len(SPACE.findall(t)) for t in texts)
        if not total:
            continue
        kinds = [sum(c) for c in zip(*(_classes(t, q.SYMBOLS) for t in texts))]
        n = Counter(w for t in texts for w in short(t))
        top = sorted((w for w in n if n[w] >= q.LEAST_SHARE * total), key=lambda w: (-n[w], w))[: q.COMMON]
        refs[lang] = {"classes": [k / max(1, sum(kinds)) for k in kinds], "words": {w: n[w] / total for w in top}}
    for key, text, _ in sorted(docs, key=lambda d: d[0]):
        words, _, _, _, again = quality_base(text)
        failed, far = words < q.SHORTEST or 100 * again > q.REPEAT_PERCENT * words, None
        if words >= q.MIN_WORDS and refs:
            kinds, n, far = _classes(text, q.SYMBOLS), Counter(short(text)), 1.0
            for r in refs.values():
                own = [n[w] / words for w in r["words"]]
                by_word = _js([*own, max(0.0, 1 - sum(own))], [*r["words"].values(), 1 - sum(r["words"].values())])
                far = min(far, (_js([k / max(1, sum(kinds)) for k in kinds], r["classes"]) + by_word) / 2)
        out.append((key, failed, not failed and (far or 0.0) <= q.MAX_DIVERGENCE, far))
    return refs, out
