"""Embedding near-duplicates: int8 tile products under rigorous error bounds, full precision for what they leave open.

A unit vector u is held as s*q + e: q of int8, e the error, its norm known. So
|u.v - s_u s_v (q_u.q_v)| <= |e_u| + (1 + |e_u|) |e_v|, and only pairs whose product comes that near to the threshold
are computed in double precision. The integer products run as float products, which are exact at these sizes.

Equal vectors of a label are one class, with its count. A label's classes are dealt in chunks, chunk pairs to tasks.
A task gives each class its number of links and a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are their own component; vectors of different lengths don't link; repeated rows are
vectors each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, stored

#: Vectors in a chunk, at most and at least, and the rows of products that a task has at once. A vector is sent to as many
#: tasks as its label has chunks.
CHUNK, FEW, BLOCK = 8192, 1024, 512


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and error norm of each unit vector."""
    scale = np.abs(u).max(axis=1, initial=0.0) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(u / scale[:, None])
    error = np.linalg.norm(u - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, error


def close(u: np.ndarray, x: np.ndarray, v: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows of x and y with cosine >= least; u and v are the unit vectors."""
    qu, su, eu = quantised(u)
    qv, sv, ev = quantised(v)
    exact = np.float32 if u.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = qv.astype(exact).T
    out = []
    for at in range(0, len(u), BLOCK):
        rows = slice(at, at + BLOCK)
        about = (qu[rows].astype(exact) @ right).astype(np.float64) * su[rows, None] * sv[None, :]
        bound = eu[rows, None] + (1 + eu[rows])[:, None] * ev[None, :] + 1e-9
        a, b = np.nonzero(about + bound >= least)
        a += at
        sure = np.empty(len(a), bool)
        for k in range(0, len(a), 1 << 15):
            s = slice(k, k + (1 << 15))
            p, q = x[a[s]], y[b[s]]
            sure[s] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= least
        out.append((a[sure], b[sure]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _tile(table: pa.Table, least: float) -> pa.Table:
    """Links of a chunk pair: (cid, n_links, root) for each class that has one."""
    c = table.column("c").to_numpy()
    order = np.argsort(c, kind="stable")
    table = table.take(pa.array(order))
    c = c[order]
    cid = np.array(table.column("cid").to_pylist(), object)
    weight = table.column("w").to_numpy()
    emb = table.column("embedding").combine_chunks()
    x = np.asarray(emb.flatten(), dtype=np.float64).reshape(len(cid), -1)
    # By powers of two, which change no digit: squares then stay within doubles, and cosines as they were.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    u = x / np.abs(x).max(axis=1)[:, None]
    u = u / np.linalg.norm(u, axis=1)[:, None]
    i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
    n_i = int((c == i).sum())
    if i == j:
        a, b = close(u, x, u, x, least)
        a, b = a[a < b], b[a < b]
    else:
        a, b = close(u[:n_i], x[:n_i], u[n_i:], x[n_i:], least)
        b = b + n_i
    links = np.zeros(len(cid), np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    root = forest(a, b, len(cid))
    own = np.flatnonzero(links > 0)
    return pa.table({"cid": pa.array(cid[own].tolist(), pa.string()), "n_links": pa.array(links[own], pa.int64()), "root": pa.array(cid[root[own]].tolist(), pa.string())})


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label"))
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("cid", F.when(F.coalesce(sound, F.lit(False)), F.md5(F.to_json(F.struct("label", "embedding")))))
    ids = stored(rows.select("vec_id", "cid"))
    classes = stored(rows.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")))
    held = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    part = classes.join(held, ["label", "dim"]).withColumn("chunks", F.ceil(F.col("held") / F.least(F.lit(float(CHUNK)), F.greatest(F.lit(float(FEW)), F.col("held") / 8.0))).cast("int"))
    part = part.withColumn("c", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    part = part.select("cid", "w", "label", "dim", "embedding", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    part = part.withColumn("i", F.least("c", "d")).withColumn("j", F.greatest("c", "d")).drop("d")

    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, least)

    found = stored(part.groupBy("label", "dim", "i", "j").applyInArrow(tile, "cid string, n_links long, root string"))
    links = found.groupBy("cid").agg(F.sum("n_links").alias("linked"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "root")
    rooted = stored(classes.select("cid", "w", "least").join(comp, "cid", "left").join(links, "cid", "left").select("cid", "w", "least", F.coalesce("root", "cid").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    # Written, so that the join on a root that many classes have can be split.
    ids_of = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(ids_of, "root")
    named = named.select("cid", (F.col("linked") + F.col("w") - 1).alias("n_links"), "component_id")
    out = ids.join(named, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
