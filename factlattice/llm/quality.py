"""Quality by hierarchical empirical Bayes: a document's own evidence with its site's and its path's posteriors.

A logistic classifier over shape features gives each document's evidence. The evidence of all documents of a host and of
a path below it makes beta-binomial posteriors; documents have no addresses here, so a source stands for the host, and
a language of a source for a path (both are parameters): a host's mean is shrunk to the
global mean, a path's to its host's, each by as many pseudo-documents as the moments of the groups call for, so that
sparse sites stay near their parents. The document's log-odds are its evidence plus what its path's mean, without
itself, differs from the global mean.

Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1, of those from at most SAMPLE documents: the
ones with the least hash of their id, one text an id.

Defined results: null and empty texts have all features 0 and the evidence of such texts; null sources and languages
are groups of their own; null labels teach nothing; without labels of both kinds all evidence is the share of good
labels (0.5 without any); repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .toxicity import held_out

#: Most labelled documents that are learnt from.
SAMPLE = 16000
KEEP = 0.5
#: A document's evidence is between these odds, so that no site outweighs what a text shows by itself.
FLOOR = 1e-4
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
FEATURES = 8


def features(text: str | None) -> list[float]:
    """Shares of letters, capitals, digits, symbols; distinct words and lines; mean word length and words, both bent to below 1."""
    data = text.encode("utf8", "surrogatepass") if text else b""
    ws = data.split()
    if not ws:
        return [0.0] * FEATURES
    n = len(data)
    letters = n - len(data.translate(None, LETTERS))
    upper = n - len(data.translate(None, UPPER))
    digits = n - len(data.translate(None, DIGITS))
    spaces = n - len(data.translate(None, SPACES))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        letters / n, upper / max(1, letters), digits / n, (n - letters - digits - spaces) / n, len(set(ws)) / len(ws) ** 0.9,
        len(set(lines)) / len(lines), (n - spaces) / (n - spaces + 5 * len(ws)), float(1 - 1 / np.log1p(1 + len(ws))),
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products: junk lies on both sides of ordinary text."""
    a, b = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, a] * x[:, b]], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and weights of a ridge logistic regression, by Newton steps."""
    z = expanded(x)
    centre, spread = z.mean(axis=0), z.std(axis=0)
    centre[0], spread[spread < 1e-9] = 0.0, 1.0
    z = (z - centre) / spread
    w = np.zeros(z.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * v[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return centre, spread, w


def _evidence(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, source, lang, p), host and path under these names: each document's evidence, written once without texts."""
    spark = docs.sparkSession
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    # At most SAMPLE ids are sent to the texts.
    ids = good.select(F.col("doc_id").alias("_id"), "y").orderBy(F.xxhash64(F.lit(6), "_id"), "_id").limit(SAMPLE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    sample = sample.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    sample = sample.select("y", "text").mapInArrow(measure, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in sample], float)
    model = fit(np.array([r["x"] for r in sample], float), y) if 0 < y.sum() < len(y) else None
    share = float(y.mean()) if len(y) else 0.5
    sent = spark.sparkContext.broadcast((model, share))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat = sent.value
        for batch in batches:
            if own is None:
                p = np.full(len(batch), flat)
            else:
                centre, spread, w = own
                x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(len(batch), FEATURES)
                p = 1 / (1 + np.exp(-np.clip(((expanded(x) - centre) / spread) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(np.clip(p, FLOOR, 1 - FLOOR), pa.float64())], ["doc_id", "source", "lang", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select("doc_id", F.col(host).alias("source"), F.col(path).alias("lang"), "text")
    return stored(rows.mapInArrow(judge, f"doc_id {kinds['doc_id']}, source {kinds[host]}, lang {kinds[path]}, p double"))


def pull(groups: DataFrame, mean: str) -> float:
    """Pseudo-documents of a level's prior, by moments: how much less its groups' means vary than chance has them."""
    row = groups.agg(
        F.sum(F.col("n") * (F.col("hits") / F.col("n") - F.col(mean)) ** 2).alias("between"), F.sum(F.col(mean) * (1 - F.col(mean))).alias("chance"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("spread"),
    ).first()
    if not row["n"] or row["g"] < 2:
        return 100.0
    over = (row["between"] - row["chance"]) / max(1e-9, row["n"] - row["nn"] / row["n"])
    level = row["spread"] / row["n"]
    return float(min(1e4, max(1.0, level / over - 1))) if over > 0 else 1e4


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, host, path (posterior means), score and keep, one row per row of docs. host and path name columns."""
    rows = _evidence(docs, labels, host, path)
    logit = lambda p: F.log(p / (1 - p))
    paths = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("hits"))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    mean = min(1 - FLOOR, max(FLOOR, all_["hits"] / all_["n"])) if all_["n"] else 0.5
    a = pull(hosts.withColumn("mean", F.lit(mean)), "mean")
    hosts = hosts.withColumn("host", (F.col("hits") + a * mean) / (F.col("n") + a)).select(F.col("source").alias("h_source"), "host")
    paths = paths.join(hosts, F.col("source").eqNullSafe(F.col("h_source")))
    b = pull(paths, "host")
    paths = paths.select(F.col("source").alias("p_source"), F.col("lang").alias("p_lang"), F.col("n").alias("p_n"), F.col("hits").alias("p_hits"), "host")
    out = rows.join(paths, F.col("source").eqNullSafe(F.col("p_source")) & F.col("lang").eqNullSafe(F.col("p_lang")))
    own = (F.col("p_hits") - F.col("p") + b * F.col("host")) / (F.col("p_n") - 1 + b)
    out = out.withColumn("path", F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), own)))
    score = 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("path")) - logit(F.lit(mean)))))
    out = out.withColumn("score", score)
    return out.select("doc_id", F.col("p").alias("evidence"), "host", "path", "score", (F.col("score") >= keep).alias("keep"))
