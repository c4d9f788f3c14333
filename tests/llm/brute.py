"""Plain versions of the text operators, straight from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf8", "surrogatepass")).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}
SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def spans(text, table, match):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(table.items()) for m in re.finditer(p, text or "") if ok(m if match else m[0])]
    return sorted(found)


def digest(found):
    return sha(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found))


def counts(found, kinds):
    n = Counter(kind for *_, kind in found)
    return tuple(n[k] for k in kinds)


def bench_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            wins[tuple(ws[k:k + n])].add(item)
    lengths = sorted({len(w) for w in wins})
    out = []
    for doc, text in docs:
        ws, hit, own = bench_words(text), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k:k + n])) in wins:
                    hit.update(range(k, k + n))
                    own.update(str(x) for x in wins[w] if x is not None)
        out.append((doc, len(ws), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return out


def fingerprint(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[k:k + 3]) for k in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode("utf8", "surrogatepass"), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash(docs):
    fps = [(doc, fingerprint(text)) for doc, text in docs]
    g = Groups()
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                g.join(i, j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(fps):
        least[g.find(i)].append(doc)
    pick = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(doc, f"{fp:016x}", pick[g.find(i)]) for i, (doc, fp) in enumerate(fps)]


def near_vectors(rows, least=0.98):
    ok = []
    for vec, emb, label in rows:
        x = None if emb is None or label is None or not len(emb) or any(v is None for v in emb) else np.array(emb, float)
        ok.append(x if x is not None and np.isfinite(x).all() and (x != 0).any() else None)
    g, n = Groups(), Counter()
    for i in range(len(rows)):
        g.find(i)
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / (np.sqrt(ok[i] @ ok[i]) * np.sqrt(ok[j] @ ok[j])) >= least:
                    g.join(i, j)
                    n[i] += 1
                    n[j] += 1
    low = defaultdict(list)
    for i in range(len(rows)):
        low[g.find(i)].append(rows[i][0])
    return [(rows[i][0], n[i], min(low[g.find(i)]), rows[i][0] == min(low[g.find(i)])) for i in range(len(rows))]


def substrings(docs, window=35):
    split = [(doc, WORD.findall(text or "")) for doc, text in docs]
    seen = Counter(tuple(ws[k:k + window]) for _, ws in split for k in range(len(ws) - window + 1))
    out = []
    for doc, ws in split:
        gone = {p for k in range(len(ws) - window + 1) if seen[tuple(ws[k:k + window])] > 1 for p in range(k, k + window)}
        out.append((doc, len(ws), len(gone), sha(" ".join(w for p, w in enumerate(ws) if p not in gone))))
    return out


def segments_linear(x):
    """The maximal-scoring segments, each candidate joined with those before it."""
    sums = np.concatenate(([0.0], np.cumsum(x)))
    stack = []
    for k, v in enumerate(x):
        if v <= 0:
            continue
        new = [sums[k], sums[k + 1], k, k]
        while True:
            j = next((i for i in reversed(range(len(stack))) if stack[i][0] < new[0]), None)
            if j is None or stack[j][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], k]
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b in stack]


def toxic_scores(docs, sample, prior=1.0, support=2, drift=1.0, rise=0.01):
    """Scores of docs (texts) by the model learnt from sample: (text, y, judge), with a weight of 1 each."""
    from math import exp, lgamma, log

    learn, judge = [(bench_words(t), y) for t, y, j in sample if not j], [(bench_words(t), y) for t, y, j in sample if j]
    n = Counter(y for _, y in learn)
    seen = (Counter(), Counter())
    for ws, y in learn:
        seen[y].update(set(ws))
    share = n[1] / (n[0] + n[1])
    score = {w: log((seen[1][w] + prior * share) / (seen[0][w] + prior * (1 - share))) - log(n[1] / n[0]) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= support}
    scores = lambda ws: [score.get(w, 0.0) - drift for w in ws]
    floors = Counter(np.floor(v * 10) for ws, y in judge if not y for v in np.array(scores(ws)))
    tops = sorted((np.floor(s * 10) for ws, y in judge if not y for s, _, _ in segments_linear(scores(ws))), reverse=True)
    words_ = sum(floors.values())
    value = lambda lam: sum(c / words_ * exp(lam * (f / 10 + 0.05)) for f, c in floors.items()) - 1
    low, high = 1e-6, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    lam = high
    step = tops[max(0, int(np.ceil(len(tops) / 10)) - 1)]
    k = sum(t >= step for t in tops) / words_ * exp(lam * step / 10)

    def evidence(ws):
        x, heights = scores(ws), []
        for _, a, b in segments_linear(x):
            own = {w: v for w, v in zip(ws[a:b + 1], x[a:b + 1])}
            heights.append(lam * (sum(own.values()) - drift * (b - a + 1 - len(own))) - log(k * max(1, len(ws))))
        heights = sorted((h for h in heights if h > 0), reverse=True)
        tried = [0.0]
        for r in range(1, len(heights) + 1):
            t = sum(heights[:r])
            if r == 1 or t > r:
                tried.append(t - (r - 1) * log(t) + lgamma(r + 1) + lgamma(r) - log(r * (r + 1) / 2))
        return max(tried)

    both = sorted((evidence(ws), y) for ws, y in judge)
    x, y = np.array([a for a, _ in both]), np.array([b for _, b in both], float)
    whole = y.mean()
    ranges = [(np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")) for v in np.unique(x)]
    # The isotonic fit by its min-max formula, over the distinct values.
    fit = [max(min(y[a:b].mean() for _, b in ranges[i:]) for a, _ in ranges[:i + 1]) for i in range(len(ranges))]
    level = {}
    for (a, b), p in zip(ranges, fit):
        level.setdefault(round(p, 9), []).append((a, b))
    smooth, last = {}, 0.0
    for p in sorted(level):
        a, b = level[p][0][0], level[p][-1][1]
        last = max(last, (y[a:b].sum() + whole) / (b - a + 1))
        smooth[p] = last
    at, to = np.unique(x), [smooth[round(p, 9)] for p in fit]
    out = []
    for t in docs:
        e = evidence(bench_words(t))
        out.append((1 - rise) * float(np.interp(e, at, to)) + rise * e / (e + 10.0))
    return out


def five_word_shingles(text, n=5):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(ws[k:k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_pairs(texts, least):
    """Pairs (i, j) of texts at a Jaccard similarity of least or more, with it, by an index of shingles."""
    sets = [five_word_shingles(t) for t in texts]
    of, common = defaultdict(list), Counter()
    for i, own in enumerate(sets):
        for sh in own or {None}:
            common.update((j, i) for j in of[sh])
            of[sh].append(i)
    return {(i, j): v for (i, j) in common if (v := jaccard(sets[i], sets[j])) >= least}


def site_posteriors(rows, floor):
    """rows: (host, path, evidence). A function from a document's to its host's and path's posterior means and its score."""
    from math import exp, log

    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    mean = min(1 - floor, max(floor, sum(p for *_, p in rows) / len(rows)))

    def pull(groups):
        """groups: (evidence, prior mean); pseudo-documents by moments."""
        n = sum(len(g) for g, _ in groups)
        if len(groups) < 2:
            return 100.0
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups)
        chance = sum(m * (1 - m) for _, m in groups)
        over = (between - chance) / max(1e-9, n - sum(len(g) ** 2 for g, _ in groups) / n)
        level = sum(len(g) * m * (1 - m) for g, m in groups) / n
        return min(1e4, max(1.0, level / over - 1)) if over > 0 else 1e4

    a = pull([(g, mean) for g in hosts.values()])
    host_of = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    b = pull([(g, host_of[h]) for (h, _), g in paths.items()])
    logit = lambda p: log(p / (1 - p))

    def of(host, path, p):
        g = paths[host, path]
        own = min(1 - floor, max(floor, (sum(g) - p + b * host_of[host]) / (len(g) - 1 + b)))
        return host_of[host], own, 1 / (1 + exp(-(logit(p) + logit(own) - logit(mean))))

    return of
