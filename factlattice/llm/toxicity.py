"""Toxicity: maximum-scoring segments over token log-odds, calibrated as extreme values.

A word's score is its log-odds of toxic against clean documents under a Dirichlet prior that gives each class its share
of PRIOR documents, so that a rare word stays near zero; from every token's score, known or not, DRIFT is taken, which
makes clean text lose by going on. Scores have both signs, and words that lean to clean documents break a segment. A
linear scan finds every maximal-scoring segment. Under clean text the best segment of n tokens follows an extreme-value
law, P(S >= x) = 1 - exp(-K n e^(-lambda x)): segments that the law makes unlikely are the toxic passages. A document's
segments are weighed together by the law of their sums, and an isotonic curve sets this evidence against labels.

Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1, and of those from a sample of at most SAMPLE
documents of each class. No label, language, source or id enters a score.

Defined results: null and empty texts score as texts without a passage; null labels teach nothing; a doc_id with
several labels is toxic if one of them is, one with several texts teaches by that of the least hash; a null doc_id is
not held out; without labels of both kinds every score is the share of toxic labels (0 without any); without judged
documents of both kinds the curve is FALLBACK; repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .decontaminate import words

#: Most labelled documents of a class that are learnt from: those with the least hash of their id.
SAMPLE = 8000
#: Documents' worth of the Dirichlet prior of a word, and the documents that a word needs for a score of its own.
PRIOR, SUPPORT = 1.0, 2
#: What each token costs, whatever its log-odds.
DRIFT = 1.0
#: Share of a score that rises with the evidence itself, so that documents of one step of the curve keep their order.
RISE = 0.01
#: Evidence and probability where nothing can be judged.
FALLBACK = [(0.0, 0.0), (10.0, 1.0)]
THRESHOLD = 0.7


def maximal_segments(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of the scores, in order. Linear: each candidate joins others once."""
    sums = np.concatenate(([0.0], np.cumsum(x)))
    up = np.flatnonzero(x > 0)
    # A candidate: (sum before it, sum at its end, first, last).
    stack: list[tuple[float, float, int, int]] = []
    # For each candidate, the last one below it that starts lower.
    lower: list[int] = []
    for place, left, right in zip(up.tolist(), sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        first = place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = lower[j]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, place))
                lower.append(j)
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:], lower[j:]
    return [(r - l, a, b) for l, r, a, b in stack]


class Model:
    """Token scores, the extreme-value law and the curve."""

    def __init__(self, score: dict[bytes, float], lam: float, k: float, curve: list[tuple[float, float]], prior: float):
        self.score, self.lam, self.k, self.curve, self.prior = score, lam, k, curve, prior

    def scores(self, ws: list[bytes]) -> np.ndarray:
        """The score of each token, each time it stands."""
        return np.fromiter(map(self.score.get, ws, repeat(0.0)), np.float64, len(ws)) - DRIFT

    def passages(self, ws: list[bytes], level: float = 0.05) -> list[tuple[float, int, int]]:
        """(p value, first token, last token) of each significant segment."""
        found = []
        for s, a, b in maximal_segments(self.scores(ws)):
            p = -math.expm1(-math.exp(min(700.0, -self.nats(s, len(ws)))))
            if p <= level:
                found.append((p, a, b))
        return found

    def nats(self, s: float, n: int) -> float:
        """A segment's height over the level that clean text of n tokens reaches."""
        return self.lam * s - math.log(self.k * max(1, n))

    def damped(self, ws: list[bytes]) -> list[float]:
        """Scores of the segments in which a word scores once, and costs DRIFT where it stands again."""
        x = self.scores(ws)
        out = []
        for _, a, b in maximal_segments(x):
            own = dict(zip(ws[a:b + 1], x[a:b + 1].tolist(), strict=True))
            out.append(sum(own.values()) - DRIFT * (b - a + 1 - len(own)))
        return out

    def evidence(self, ws: list[bytes]) -> float:
        """Nats against clean text: -ln P of the r best segments' sum of heights, for the r that tells most.

        P(sum >= t) of the r best is about e^-t t^(r-1) / (r! (r-1)!); trying r of them costs ln(r (r + 1) / 2).
        """
        best = total = 0.0
        for r, s in enumerate(sorted(self.damped(ws), reverse=True), 1):
            height = self.nats(s, len(ws))
            if height <= 0:
                break
            total += height
            if r == 1:
                best = total
            elif total > r:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r * (r + 1) / 2))
        return best

    def probability(self, ws: list[bytes]) -> float:
        if not self.score:
            return self.prior
        at, p = zip(*self.curve, strict=True)
        x = self.evidence(ws)
        return (1 - RISE) * float(np.interp(x, at, p)) + RISE * x / (x + 10.0)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sample(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(_id, y, judge) of the documents learnt from, and how many of each class there are."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = rows.select(F.col("doc_id").alias("_id"), "y", F.xxhash64(F.lit(5), "doc_id").alias("h"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [rows.where(F.col("y") == y).orderBy("h", "_id").limit(SAMPLE) for y in (0, 1)]
    return picked[0].unionAll(picked[1]).select("_id", "y", (F.pmod("h", F.lit(3)) == 0).alias("judge")), counts


def _token_counts(sample: DataFrame) -> DataFrame:
    """(token, clean, toxic): documents that have it; one partial count a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                n[y].update(set(words(text.as_py())))
            both = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([n[0][w] for w in both], pa.int64()), pa.array([n[1][w] for w in both], pa.int64())], ["token", "clean", "toxic"])

    parts = sample.select("text", "y").mapInArrow(count, "token binary, clean long, toxic long")
    return parts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(counts: list[tuple[bytes, int, int]], n_clean: int, n_toxic: int) -> dict[bytes, float]:
    """A word's log-odds of toxic documents beyond the classes' own, from (word, clean, toxic) document counts."""
    share = n_toxic / (n_clean + n_toxic)
    prior = math.log(share / (1 - share))
    return {w: math.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - prior for w, clean, toxic in counts}


def tail(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda of the extreme-value law: the positive root of sum(share * e^(lambda * score)) = 1."""
    total = lambda x: float((share * np.exp(x * scores)).sum()) - 1.0
    if not (scores > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, float]]:
    """Knots (evidence, probability) of the rising curve nearest to the weighted labels, by pooling what falls.

    Each pool is drawn to the whole share by one document's weight, so that no curve says never or always. It rises by
    construction, for separable evidence too, and there is nothing to converge.
    """
    share = float((w * y).sum() / w.sum())
    pools: list[list[float]] = []
    for at in np.unique(x):
        own = x == at
        mass = float(w[own].sum())
        pools.append([float((w[own] * y[own]).sum()), mass, float(at), float(at)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            hits, mass, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + hits, pools[-1][1] + mass, pools[-1][2], last]
    # The pull towards the share may turn small neighbours round; the curve never falls.
    level = np.maximum.accumulate([(hits + share) / (mass + 1) for hits, mass, _, _ in pools]).tolist()
    return [(at, p) for (_, _, first, last), p in zip(pools, level, strict=True) for at in dict.fromkeys((first, last))]


def _law(clean: DataFrame, sent) -> tuple[float, float]:
    """lambda and K by clean documents: lambda from how scores are spread, K from how many segments reach a height.

    Histograms come to the driver, in steps of a tenth, never rows.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, 1.0, 1.0, FALLBACK, 0.0)
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text"):
                x = model.scores(words(text.as_py()))
                for what, values in ((0, x), (1, np.array([s for s, _, _ in maximal_segments(x)]))):
                    step, count = np.unique(np.floor(values * 10).astype(np.int64), return_counts=True)
                    n.update({(what, s): c for s, c in zip(step.tolist(), count.tolist(), strict=True)})
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["what", "step", "n"])

    rows = clean.select("text").mapInArrow(spread, "what int, step long, n long").groupBy("what", "step").agg(F.sum("n").alias("n")).collect()
    own = sorted((r["step"], r["n"]) for r in rows if r["what"] == 0)
    tops = sorted(((r["step"], r["n"]) for r in rows if r["what"] == 1), reverse=True)
    n_words = sum(n for _, n in own)
    if not n_words or not tops:
        return 1.0, 0.5 / max(1, n_words)
    at = np.array([s / 10 + 0.05 for s, _ in own])
    lam = tail(at, np.array([n for _, n in own], float) / n_words)
    beyond, tenth = 0, sum(n for _, n in tops) / 10
    for step, n in tops:
        beyond += n
        if beyond >= tenth:
            break
    return lam, beyond / n_words * math.exp(lam * step / 10)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model. The driver gets the words of at most 2 * SAMPLE documents that SUPPORT of them share, histograms, and
    a number for each judged document."""
    ids, of_class = _sample(labels)
    if not of_class.get(0) or not of_class.get(1):
        return Model({}, 1.0, 1.0, FALLBACK, 1.0 if of_class.get(1) else 0.0)
    # The sample's ids are at most 2 * SAMPLE: they are sent to the texts, not the texts to them.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    sample = stored(sample.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"), F.first("judge").alias("judge")))
    seen = {(r["judge"], r["y"]): r["n"] for r in sample.groupBy("judge", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = seen.get((False, 0), 0), seen.get((False, 1), 0)
    rows = _token_counts(sample.where("not judge")).where(F.col("clean") + F.col("toxic") >= SUPPORT).collect() if n_clean and n_toxic else []
    score = log_odds([(bytes(r["token"]), r["clean"], r["toxic"]) for r in rows], n_clean, n_toxic) if rows else {}
    if not score:
        return Model({}, 1.0, 1.0, FALLBACK, of_class[1] / (of_class[0] + of_class[1]))
    sent = docs.sparkSession.sparkContext.broadcast(score)
    lam, k = _law(sample.where("judge and y = 0"), sent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, lam, k, FALLBACK, 0.0)
        for batch in batches:
            x = [model.evidence(words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    judged = sample.where("judge").select("text", "y").mapInArrow(judge, "y int, x double").collect()
    x, y = np.array([r["x"] for r in judged], float), np.array([r["y"] for r in judged], float)
    # Each class counts as often as it does among all labels, not as in the sample.
    w = np.where(y == 1, of_class[1] / min(SAMPLE, of_class[1]), of_class[0] / min(SAMPLE, of_class[0]))
    return Model(score, lam, k, isotonic(x, y, w) if 0 < y.sum() < len(y) else FALLBACK, 0.0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' columns, then the score, and the first and last token of each significant passage."""
    model = fitted(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.score, model.lam, model.k, model.curve, model.prior))
    names = [*docs.columns, *fresh(docs, "_score", "_passages")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            score, passages = [], []
            for text in batch.column("text"):
                ws = words(text.as_py())
                score.append(own.probability(ws))
                passages.append([{"first": a, "last": b} for _, a, b in own.passages(ws)] if own.score else [])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(passages, kind)], names)

    schema = docs.select("*", F.lit(0.0).alias(names[-2]), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias(names[-1])).schema
    return docs.mapInArrow(scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and n_passages: one row per row of docs."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("_passages").cast("long").alias("n_passages"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic."""
    out = scored(docs, labels)
    return out.where(F.col(out.columns[-2]) < THRESHOLD).select(*docs.columns)
