"""Exact substring deduplication: prefix-partitioned suffix trees.

Only suffixes that can begin a repeated window are gathered. Each window of 35 words has an anchor, its least hashed
8-word phrase: equal windows have equal anchors, so an anchor phrase that stands at one place of the corpus has no
repeated window. The suffixes of the others are dealt by that phrase, their prefix as seen from the anchor; runs of the
same words are one leaf, which repeats as a whole if it stands at two places. A group that fits a task's memory becomes a
suffix tree there: a suffix array, the lengths of its neighbours' common prefixes, and the intervals of these, which are
the tree's inner nodes. Those at least 35 words deep are the repeats, and all leaves below them are repeated windows. A
group of more than GROUP leaves is split by its suffixes' own first words, as many as PREFIXES says at a time: a suffix
that shares its prefix with no other is done, a group that fits now becomes a tree, and only larger ones go on to the
next length. At the last, 35 words, a node is a count that needs no gathering.

Texts that are equal as a whole are one text with a count. Texts move once, compressed, and only those with a
candidate are kept for the end. Text identity and the longest prefixes are 128-bit digests; all else compares words.

Defined results: null and empty texts have no words; fewer than 35 words have no window; null doc_ids and repeated rows
keep a row each (a repeated row is a copy); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, GRAM = 35, 8
#: Runs of windows of one prefix that a task takes as a tree, at most 62 words each; text bytes and words that are worked
#: on at once; documents of one text that one task is to join.
GROUP, BYTES, WORDS, COPIES = 1 << 14, 4 << 20, 1 << 20, 4096
#: Words of the prefixes that split a larger group, one after the other; the last is always a whole window.
PREFIXES = (16, 24)
R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
Q = np.uint64(0xC2B2AE3D27D4EB4F)
Q_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the least of the span values from there on is; the first of equals."""
    n = len(h) - span + 1
    at, width = np.arange(len(h)), 1
    while width * 2 <= span:
        a, b = at[:-width], at[width:]
        at = np.where(h[a] <= h[b], a, b)
        width *= 2
    a, b = at[:n], at[span - width: span - width + n]
    return np.where(h[a] <= h[b], a, b)


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and its runs of windows: the anchors' hashes, and first window << 8 | windows of each run,
    with the anchor's distance from the first window << 40. All texts are hashed as one array."""
    whole = b" ".join(texts) + b" "
    data = np.frombuffer(whole, np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(begin, start, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(start) or count.max() < window:
        return count, [none] * len(texts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(R, len(data)), dtype=np.uint64)))
    word = _scrambled((sums[end] - sums[start]) * _powers(R_INV, len(data))[start] + (end - start).astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _powers(Q, len(word)), dtype=np.uint64)))
    phrase = _scrambled((sums[gram:] - sums[:-gram]) * _powers(Q_INV, len(word))[: len(word) - gram + 1])
    at = _least(phrase, window - gram + 1)
    n = len(word) - window + 1
    at = at[:n]
    own = doc[:n] == doc[window - 1:]
    place = np.flatnonzero(own)
    anchor = at[place]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)))
    lead = np.flatnonzero(new)
    size = np.diff(np.concatenate((lead, [len(place)])))
    lead = place[lead]
    by = doc[lead]
    packed = ((at[lead] - lead) << 40) | ((lead - first[by]) << 8) | size
    hashes = phrase[at[lead]].view(np.int64)
    cut = np.searchsorted(by, np.arange(len(texts) + 1))
    return count, [(hashes[a:b], packed[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _sha(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


def _identity(data: bytes) -> tuple[int, int]:
    both = xxhash.xxh128_digest(data)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _bytes(text: pa.Scalar) -> bytes:
    text = text.as_py()
    return text.encode("utf8", "surrogatepass") if text else b""


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    begin, size, texts = 0, 0, []
    for k, text in enumerate(batch.column("text")):
        data = _bytes(text)
        if texts and size + len(data) > BYTES:
            yield begin, texts
            begin, size, texts = k, 0, []
        texts.append(data)
        size += len(data)
    if texts:
        yield begin, texts


def _table(docs: DataFrame) -> DataFrame:
    """A row per document, without its text: identity, words, digest of all words, and its runs of windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _parts(batch):
                count, runs = anchors(texts)
                ids = [_identity(t) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, len(texts)), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()),
                    pa.array(count, pa.int64()), pa.array([_sha(t.split()) for t in texts], pa.string()),
                    pa.array([h for h, _ in runs], pa.list_(pa.int64())), pa.array([p for _, p in runs], pa.list_(pa.int64())),
                ], ["doc_id", "t1", "t2", "n_words", "whole", "hashes", "runs"])

    return stored(docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, t1 long, t2 long, n_words long, whole string, hashes array<long>, runs array<long>"))


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, z): texts compressed, for the one time that they move."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [_bytes(t) for t in batch.column("text")]
            ids = [_identity(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["doc_id", "t1", "t2", "z"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, t1 long, t2 long, z binary")


def _unpacked(z: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z).split()


def _contexts(held: DataFrame) -> DataFrame:
    """(h, t1, t2, at, size, d1, d2, context): the words of each candidate run, and their digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "t1", "t2", "at", "size", "d1", "d2", "context"]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for t1, t2, z, runs in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("z").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ws = _unpacked(z)
                for run in runs:
                    at, n = (run["run"] >> 8) & 0xFFFFFFFF, run["run"] & 0xFF
                    context = b" ".join(ws[at:at + n + WINDOW - 1])
                    rows.append((run["h"], t1, t2, at, n, *_identity(context), context))
                    size += len(context) + 64
                if size > BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return held.select("t1", "t2", "z", "found").mapInArrow(scan, "h long, t1 long, t2 long, at long, size int, d1 long, d2 long, context binary")


def _suffixes(contexts: DataFrame) -> DataFrame:
    """(t1, t2, at, context): the words of each window of the contexts by itself."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for t1, t2, at, n, context in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "at", "size", "context")), strict=True):
                ws = context.split()
                for k in range(n):
                    rows.append((t1, t2, at + k, b" ".join(ws[k:k + WINDOW])))
                    size += len(rows[-1][3]) + 64
                if size > BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["t1", "t2", "at", "context"])

    return contexts.select("t1", "t2", "at", "size", "context").mapInArrow(scan, "t1 long, t2 long, at long, context binary")


def _split(contexts: DataFrame) -> DataFrame:
    """(t1, t2, at, size): the repeated windows of contexts in groups too large for a task, by longer and longer prefixes."""
    one = F.lit(1).cast("long").alias("size")
    spot = F.xxhash64("t1", "t2", "at")
    open_, out = _suffixes(contexts), None
    for length in (*PREFIXES, WINDOW):
        keyed = open_.withColumn("prefix", F.md5(F.substring_index(F.col("context").cast("string"), " ", length)))
        if length == WINDOW:
            keyed = keyed.drop("context")
        # Prefixes at two places; written, so that the join on one that very many suffixes have can be split.
        nodes = stored(keyed.groupBy("prefix").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("prefix", "n"))
        met = keyed.join(nodes, "prefix")
        if length == WINDOW:
            done = met.select("t1", "t2", "at", one)
        else:
            fits = met.where(F.col("n") <= GROUP).select(F.col("prefix").alias("h"), "t1", "t2", "at", F.lit(1).alias("size"), "context")
            done = fits.repartition("h").sortWithinPartitions("h").mapInArrow(_trees, "t1 long, t2 long, at long, size long")
            open_ = stored(met.where(F.col("n") > GROUP).select("t1", "t2", "at", "context"))
        out = done if out is None else out.unionByName(done)
    return out


def suffix_tree(contexts: list[list[bytes]], windows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin each context's first windows[k] windows, numbered through, in the order of their words, and
    how many words each has in common with the next: the leaves of their tree, and the depths at which neighbours part.

    Places are ranked by their first 1, 2, 4 ... words; the ranks give the order, and, from the longest on, the common
    prefixes. A mark of its own ends each context, so that no prefix leads out of it.
    """
    name: dict[bytes, int] = {}
    longest = max(map(len, contexts)) + 1
    flat = np.concatenate([np.fromiter((name.setdefault(w, len(name)) for w in [*ws, b""]), np.int64, len(ws) + 1) for ws in contexts])
    ends = np.cumsum([len(ws) + 1 for ws in contexts]) - 1
    flat[ends] = len(name) + np.arange(len(ends))
    ranks, width = [np.unique(flat, return_inverse=True)[1].astype(np.int64)], 1
    while width < longest:
        rank = ranks[-1]
        after = np.full_like(rank, -1)
        after[: len(rank) - width] = rank[width:]
        ranks.append(np.unique(rank * (rank.max() + 2) + after + 1, return_inverse=True)[1].astype(np.int64))
        width *= 2
    begin = np.concatenate(([0], ends[:-1] + 1))
    size = np.array(windows)
    own = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(ranks[-1][own], kind="stable")
    left, right = own[order][:-1].copy(), own[order][1:].copy()
    common = np.zeros(len(left), np.int64)
    for k in reversed(range(len(ranks))):
        inside = (left < len(flat)) & (right < len(flat))
        same = np.zeros(len(left), bool)
        same[inside] = ranks[k][left[inside]] == ranks[k][right[inside]]
        step = same * (1 << k)
        common, left, right = common + step, left + step, right + step
    return order, common


def inner_nodes(common: np.ndarray, least: int = 1) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of each inner node at least so deep, from the common prefixes of neighbouring leaves."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for place, depth in enumerate([*common.tolist(), 0]):
        first = place
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            if deep >= least:
                out.append((deep, first, place))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def deep_nodes(contexts: list[list[bytes]], windows: list[int], depth: int = WINDOW) -> list[np.ndarray]:
    """Which of each context's first windows[k] suffixes lie below an inner node of the suffix tree at least that deep."""
    order, common = suffix_tree(contexts, windows)
    change = np.zeros(len(order) + 1, np.int64)
    for _, first, last in inner_nodes(np.minimum(common, depth), depth):
        change[first] += 1
        change[last + 1] -= 1
    deep = np.zeros(len(order), bool)
    deep[order] = np.cumsum(change[:-1]) > 0
    return np.split(deep, np.cumsum(windows)[:-1])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix: the repeated windows of each, as (t1, t2, at, size) runs. Groups stay together."""
    held: list[tuple] = []
    words = 0

    def grown(rows: list[tuple]) -> pa.RecordBatch:
        # Rows that agree in id and text bring their runs twice.
        rows = list({r[1:4]: r for r in rows}.values())
        out: list[tuple[int, int, int, int]] = []
        for (_, t1, t2, at, _, _), deep in zip(rows, deep_nodes([r[5].split() for r in rows], [r[4] for r in rows]), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], deep.astype(np.int8), [0]))))
            out += [(t1, t2, at + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t1", "t2", "at", "size"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "t1", "t2", "at", "size", "context")), strict=True):
            if words > WORDS and row[0] != held[-1][0]:
                yield grown(held)
                held, words = [], 0
            held.append(row)
            words += row[4] + WINDOW
    if held:
        yield grown(held)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The document table; the distinct texts with their copies; candidate texts; and (t1, t2, runs) of the repeated windows
    in each distinct text."""
    table = _table(docs)
    places = table.select("t1", "t2", F.explode(F.arrays_zip("hashes", "runs")).alias("x")).select(F.col("x.hashes").alias("h"), "t1", F.col("x.runs").alias("run"))
    # One text's anchor counts once, however many copies of the text there are: a phrase needs two places.
    spot = F.xxhash64("t1", "run")
    prefix = places.select("h", spot.alias("spot")).groupBy("h").agg(F.min("spot").alias("a"), F.max("spot").alias("b"))
    # Written, so that the join below reads both sides from shuffles that can be split at a hot phrase.
    prefix = stored(prefix.where("a <> b").select("h"))
    found = places.join(prefix, "h").groupBy("t1").agg(F.collect_set(F.struct("h", "run")).alias("found"))
    # One document speaks for all that have its text.
    speaker = stored(table.groupBy("t1", "t2").agg(F.min("doc_id").alias("s_id"), F.count(F.lit(1)).alias("copies")))
    known = speaker.join(found, "t1").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "s_id", "found")
    texts = _packed(docs)
    held = texts.join(known, (texts["t1"] == known["k1"]) & (texts["t2"] == known["k2"]) & texts["doc_id"].eqNullSafe(known["s_id"]))
    held = stored(held.select("t1", "t2", "z", "found"))
    contexts = stored(_contexts(held))
    # Runs of the same words are one leaf, and repeat as a whole if they are two: a passage that very many texts share is
    # counted before anything of it is gathered.
    spot = F.xxhash64("t1", "t2", "at")
    same = stored(contexts.groupBy("d1", "d2").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.ceil(F.count(F.lit(1)) / float(COPIES)).cast("int").alias("parts")))
    # Places of a run that very many texts have are dealt in parts, like documents of one text below.
    hot = stored(same.where("parts > 1").select("d1", "d2", "parts"))
    whole = contexts.select("t1", "t2", "at", F.col("size").cast("long").alias("size"), "d1", "d2").join(hot, ["d1", "d2"], "left")
    whole = whole.withColumn("part", F.pmod(spot, F.coalesce("parts", F.lit(1))).cast("int"))
    often = same.where("a <> b").select("d1", "d2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    whole = whole.join(often, ["d1", "d2", "part"], "left_semi").select("t1", "t2", "at", "size")
    leaves = stored(contexts.withColumn("spot", spot).join(same.select("d1", "d2", F.col("a").alias("spot")), ["d1", "d2", "spot"], "left_semi").drop("d1", "d2", "spot"))
    wide = stored(leaves.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h"))
    narrow = leaves.join(wide, "h", "left_anti").select("h", "t1", "t2", "at", "size", "context").repartition("h").sortWithinPartitions("h")
    trees = narrow.mapInArrow(_trees, "t1 long, t2 long, at long, size long")
    runs = trees.unionByName(_split(leaves.join(wide, "h", "left_semi"))).unionByName(whole).groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    return table, speaker, held, runs


def kept_words(ws: list[bytes], runs: list[tuple[int, int]]) -> list[bytes]:
    """ws without the words that the windows of the runs cover."""
    cover = np.zeros(len(ws) + 1, np.int64)
    for at, n in runs:
        cover[at] += 1
        cover[min(len(ws), at + n + WINDOW - 1)] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(ws, gone, strict=True) if not g]


def substrings(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of docs."""
    table, speaker, held, runs = repeats(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for z, own in zip(batch.column("z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                ws = _unpacked(z)
                kept = kept_words(ws, [(r["at"], r["size"]) for r in own])
                n.append(len(ws) - len(kept))
                sha.append(_sha(kept))
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["r1", "r2", "gone", "rest"])

    cleaned = held.join(runs, ["t1", "t2"]).select("t1", "t2", "z", "runs").dropDuplicates(["t1", "t2"]).mapInArrow(cut, "r1 long, r2 long, gone long, rest string")
    known = speaker.select("t1", "t2", "copies").join(cleaned, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")), "left").drop("r1", "r2")
    known = known.withColumn("parts", F.ceil(F.col("copies") / float(COPIES)).cast("int"))
    known = stored(known)
    # Of a text that many documents have, the documents are dealt in parts: there are few such texts, and Spark sends
    # this table to all only if it is small.
    many = stored(known.where("parts > 1").select(F.col("t1").alias("m1"), F.col("t2").alias("m2"), F.col("parts").alias("of")))
    dealt = table.join(many, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("of", F.lit(1))).cast("int")).drop("m1", "m2", "of", "hashes", "runs")
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = dealt.join(known, ["t1", "t2", "part"])
    copy = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )
