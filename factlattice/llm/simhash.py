"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

Fingerprints at most 3 bits apart agree in one of 4 blocks; where there are many fingerprints, the rest is split once
more, so that they agree in one of 16 longer keys. Equal fingerprints are one class from the start. A block's rows
are dealt in chunks, and chunk pairs go to tasks: no task holds more than two chunks, and each gives back a spanning
forest of its links, never all pairs. Components come from a distributed star contraction.

For a similarity, ``deduplicated`` takes WIDE bits over the distinct shingles of five words: the share of them that
differs tells the angle between two texts' shingle sets, at 512 bits a Jaccard similarity of 0.8 within 0.04 or so.
Blocks of a few of these bits are chosen so many times that a pair right at the similarity shares one with probability
RECALL, and pairs nearer almost surely; the Hamming distance of all bits decides. With more fingerprints blocks grow
longer, and more: their number grows with about the fourth root of the fingerprints.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id is nobody's
component_id unless the component has no other; repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, fresh, partitions, stored

#: Odd multipliers, one for each 64 bits of a wide fingerprint.
SPREAD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)], np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once, and pairs that are held at once.
CHUNK, HELD = 1 << 14, 1 << 20
#: Bits of a fingerprint that tells similarity, and how surely a pair at the similarity itself shares a block.
WIDE, RECALL = 512, 0.95
#: Fingerprints that share a block by chance, about.
CROWD = 16
#: Above so many distinct fingerprints the keys have 28 bits, not 16.
MANY = 1 << 22


def shingles(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each shingle of n words, lower-cased; of all words where they are fewer."""
    ws = text.encode("utf8", "surrogatepass").translate(LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    n = min(n, len(ws))
    stop = (ends[n - 1:] - 1).tolist()
    start = [0, *ends[: len(ws) - n].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(start, stop, strict=True)), np.uint64, len(stop))


def majority(h: np.ndarray) -> bytes:
    """A bit for each of a row's bits: whether over half of the rows of 64-bit numbers have it; first number, first bit first."""
    sums = np.zeros(64 * h.shape[1], np.int64)
    for k in range(0, len(h), CHUNK):
        sums += np.unpackbits(h[k:k + CHUNK].astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(sums * 2 > len(h)).tobytes()


def fingerprint(text: str | None, n: int = 3) -> int:
    return int.from_bytes(majority(shingles(text, n)[:, None]), "big")


def wide(text: str | None, n: int = 5) -> bytes:
    """WIDE bits over a text's distinct shingles: each hash is spread to that many by odd multipliers."""
    h = np.unique(shingles(text, n))
    h = h[:, None] * SPREAD[None, :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return majority(h)


def row_keys() -> tuple[Column, Column]:
    """128 bits of a row's id and text: rows that agree in both share them, others don't."""
    return tuple(F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()) for seed in (7, 8))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp): the row's keys, and the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "k1", "k2", "fp"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp, pa.int64())], names)

    k1, k2 = row_keys()
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(scan, f"doc_id {kind}, k1 long, k2 long, fp long")


def wide_fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, k1, k2, fp): the row's keys, and the WIDE bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([wide(t.as_py(), n) for t in batch.column(3)], pa.binary())], ["doc_id", "k1", "k2", "fp"])

    k1, k2 = row_keys()
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(scan, f"doc_id {kind}, k1 long, k2 long, fp binary")


def _bits(fp: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers, from longs or from binaries of one length."""
    if pa.types.is_binary(fp.type):
        rows = fp.to_pylist()
        return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    return fp.to_numpy().view(np.uint64).reshape(-1, 1)


def share_apart(least: float) -> float:
    """The share of bits that differ between sets of one size at a Jaccard similarity: their angle over pi."""
    return math.acos(2 * least / (1 + least)) / math.pi


def blocks(n: int, least: float) -> list[list[int]]:
    """The bits of each block for n fingerprints: as long as leaves CROWD of them together by chance, as many as RECALL asks for."""
    length = min(48, max(8, math.ceil(math.log2(max(2, n) / CROWD))))
    meet = (1 - share_apart(least)) ** length
    rng = np.random.default_rng(length)
    return [rng.choice(WIDE, length, replace=False).tolist() for _ in range(math.ceil(math.log(1 - RECALL) / math.log1p(-meet)))]


def similar(fps: DataFrame, n: int, least: float) -> DataFrame:
    """Edges (a, b) between distinct wide fingerprints, with the components of all links that were met."""
    spark = fps.sparkSession
    tables = blocks(n, least)
    most = round(share_apart(least) * WIDE) + WIDE // 64

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, power = np.array(tables), 1 << np.arange(len(tables[0]), dtype=np.int64)
        for whole in batches:
            for k in range(0, len(whole), 2048):
                batch = whole.slice(k, 2048)
                bits = np.unpackbits(_bits(batch.column("fp")).view(np.uint8), axis=1)
                for t, own in enumerate(place):
                    yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(np.full(len(batch), t, np.int32)), pa.array(bits[:, own] @ power)], ["fp", "blk", "key"])

    rows = fps.select("fp").mapInArrow(keyed, "fp binary, blk int, key long")
    chunk = 2048
    # Few blocks hold more than a chunk: this table is small, and Spark broadcasts it only if it is.
    hot = stored(rows.groupBy("blk", "key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > chunk))
    rows = rows.join(hot, ["blk", "key"], "left").withColumn("chunks", F.ceil(F.coalesce("held", F.lit(1)) / float(chunk)).cast("int"))
    return _dealt(rows, most, "a binary, b binary")


def _keys(deep: bool) -> list[tuple[int, int]]:
    """(number, mask) of the keys: each pair at 3 differing bits or fewer agrees on all of one mask."""
    masks = []
    for a in range(4):
        block = 0xFFFF << (16 * a)
        if not deep:
            masks.append(block)
            continue
        rest = [b for b in range(64) if not block >> b & 1]
        for c in range(4):
            masks.append(block | sum(1 << b for b in rest[12 * c:12 * c + 12]))
    return list(enumerate(masks))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (blk, key, i, j): links within each such group, as a spanning forest."""
    left: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        left = pa.concat_tables([left, table]) if left is not None else table
        group = _groups(left)
        # The last group may go on in the next batch.
        if len(group) and group[-1] > 0:
            cut = int(np.searchsorted(group, group[-1]))
            yield _links(left.column("fp").slice(0, cut), group[:cut], most)
            left = left.slice(cut).combine_chunks()
    if left is not None and len(left):
        yield _links(left.column("fp"), _groups(left), most)


def _groups(table: pa.Table) -> np.ndarray:
    change = np.zeros(len(table), bool)
    for c in ("blk", "key", "i", "j"):
        x = table.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _links(fp: pa.ChunkedArray, group: np.ndarray, most: int) -> pa.RecordBatch:
    n = len(fp)
    bits = _bits(fp)
    root = np.arange(n)
    size = np.bincount(group)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    room = size[group] - (np.arange(n) - first[group])
    alive, shift = np.flatnonzero(room > 1), 1
    a_all: list[np.ndarray] = []
    b_all: list[np.ndarray] = []
    count = 0
    while len(alive):
        near = alive[np.bitwise_count(bits[alive] ^ bits[alive + shift]).sum(axis=1, dtype=np.int64) <= most]
        a_all.append(near)
        b_all.append(near + shift)
        count += len(near)
        if count > HELD:
            root = _merged(root, a_all, b_all)
            a_all, b_all, count = [], [], 0
        shift += 1
        alive = alive[room[alive] > shift]
    root = _merged(root, a_all, b_all)
    own = np.flatnonzero(root != np.arange(n))
    return pa.RecordBatch.from_arrays([fp.take(pa.array(own)).combine_chunks(), fp.take(pa.array(root[own])).combine_chunks()], ["a", "b"])


def _merged(root: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    old = np.flatnonzero(root != np.arange(len(root)))
    return forest(np.concatenate([*a, old]).astype(np.int64), np.concatenate([*b, root[old]]).astype(np.int64), len(root))


def linked(fps: DataFrame, n: int, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, with the same components as all links."""
    spark = fps.sparkSession
    keys = _keys(n > MANY)
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("blk"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in keys))).alias("k")).select("fp", "k.blk", "k.key")
    held = rows.groupBy("blk", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rows = rows.join(held, ["blk", "key"])
    chunk = max(64, min(2048, n * len(keys) // (8 * partitions(spark))))
    rows = rows.withColumn("chunks", F.ceil(F.col("held") / float(chunk)).cast("int"))
    return _dealt(rows, most, "a long, b long")


def _dealt(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """Links within the groups of rows (fp, blk, key, chunks): chunk pairs go to tasks."""
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.select("fp", "blk", "key", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    rows = rows.select("fp", "blk", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"))
    rows = rows.repartition("blk", "key", "i", "j").sortWithinPartitions("blk", "key", "i", "j")
    return rows.mapInArrow(lambda it: _pairs(it, most), kind)


def classes(rows: DataFrame, link=linked) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of rows (doc_id, fp); root is the component's least fingerprint.

    link(fingerprints, their number) gives the edges. Only fingerprints and ids are shuffled, never texts.
    """
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(link(fps, fps.count())).select(F.col("node").alias("fp"), "root")
    rooted = stored(fps.join(comp, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Written, so that the join on a root that many fingerprints have can be split.
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of docs."""
    rows = stored(fingerprints(docs))
    return rows.join(classes(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of texts at a Jaccard similarity of least or more over shingles of that many
    words: that of the least doc_id, nulls last, then of the least keys.

    Rows that share a null or other doc_id but no component each stay; of rows that agree in id and text one stays,
    that of the least other columns.
    """
    columns = docs.columns
    a, b, c, d, row = fresh(docs, "_a", "_b", "_c", "_d", "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")
    rows = stored(wide_fingerprints(docs, words))
    comp = classes(rows, lambda fps, n: similar(fps, n, least))
    # By fingerprint before the join: a text that a third of all rows share is one row by then.
    kept = rows.groupBy("fp").agg(first).join(comp, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.k1").alias(a), F.col("first.k2").alias(b))
    k1, k2 = row_keys()
    both = docs.withColumns({c: k1, d: k2}).join(kept, (F.col(c) == F.col(a)) & (F.col(d) == F.col(b)), "left_semi")
    one = both.groupBy(c, d).agg(F.min(F.struct(*columns)).alias(row))
    return one.select(*(F.col(row)[n].alias(n) for n in columns))
