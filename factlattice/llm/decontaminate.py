"""Benchmark decontamination: an FM-index per shard of the training documents, searched for test phrases.

A shard is a slice of bounded text of one Arrow batch. Only words that the benchmark has can be part of a phrase, so
the index holds the runs of such words, parted by a symbol that no phrase has; runs shorter than the shortest phrase
are left out. Every phrase is searched backwards, its occurrences are located, and their spans are merged.

The benchmark is a stated query set. It is read in blocks of bounded bytes, each broadcast; with several blocks
the documents pass through them one after the other, so no broadcast grows with the benchmark.

Defined results: null or empty texts have no words; items of no words and null items match nothing; a null item_id
marks words but is no item of n_items; repeated items count once by id; null doc_ids and repeated rows keep a row
each; an empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .fm_index import FMIndex

#: Bytes of a shard's text, and of a benchmark block.
SHARD, BLOCK = 3 << 20, 4 << 20
#: Lower-cases A-Z, and makes a space of each byte that is no word byte.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Owners:
    """Names of the items that have each of some phrases, as arrays."""

    def __init__(self, phrase: np.ndarray, item: np.ndarray, n: int, names: list[str | None]):
        both = np.unique(phrase * (len(names) + 1) + item)
        self.item = (both % (len(names) + 1)).astype(np.int32)
        self.first = np.searchsorted(both // (len(names) + 1), np.arange(n + 1))
        self.names = names

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, k: int) -> list[str]:
        return [self.names[i] for i in self.item[self.first[k]:self.first[k + 1]] if self.names[i] is not None]


class Phrases:
    """The distinct windows of a block of benchmark items, as rows of symbols, with the items that have them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.symbol: dict[bytes, int] = {}
        names = [None if item is None else str(item) for item, _ in items]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(items):
            own = np.array([self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text)], np.int32)
            if len(own):
                found.setdefault(min(window, len(own)), []).append((own, k))
        self.groups: list[tuple[int, np.ndarray, Owners]] = []
        for n in sorted(found):
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(own, n) for own, _ in found[n]])
            item = np.repeat([k for _, k in found[n]], [len(own) - n + 1 for own, _ in found[n]])
            order = np.lexsort(rows.T[::-1])
            rows, item = rows[order], item[order]
            new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
            self.groups.append((n, rows[new], Owners(np.cumsum(new) - 1, item, int(new.sum()), names)))
        self.shortest = min((n for n, _, _ in self.groups), default=0)


#: The phrases that this Python worker has built last, by their block's name: tasks of one worker share them.
_BUILT: dict[tuple[str, int], Phrases] = {}


def built(name: str, block, window: int) -> Phrases:
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = Phrases(block.value, window)
    return _BUILT[name, window]


def hits(texts: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, Owners]]:
    """For each group of equally long phrases: its length, the word places where one starts (over all texts laid end
    to end), which phrase it is, and the phrases' items."""
    if not phrases.groups or not texts:
        return
    get = phrases.symbol.get
    flat = np.concatenate([np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)) for ws in texts])
    ends = np.cumsum([len(ws) for ws in texts])
    # A run ends at a word that the benchmark doesn't have, and with its text.
    breaks = flat == 0
    first = np.zeros(len(flat) + 1, bool)
    first[ends[:-1]] = True
    run = np.cumsum(breaks | first[:-1])
    size = np.bincount(run[~breaks], minlength=run[-1] + 1 if len(run) else 1) if len(run) else np.zeros(1, np.int64)
    place = np.flatnonzero(~breaks & (size[run] >= phrases.shortest)) if len(run) else np.zeros(0, np.int64)
    if not len(place):
        return
    # The runs in a row, 1 between them; where[] leads back to the words.
    shift = np.concatenate(([0], np.cumsum(run[place][1:] != run[place][:-1])))
    seq = np.ones(len(place) + shift[-1], np.int64)
    where = np.full(len(seq), -1, np.int64)
    seq[np.arange(len(place)) + shift] = flat[place]
    where[np.arange(len(place)) + shift] = place
    index = FMIndex(seq, len(phrases.symbol) + 2)
    for n, group, items in phrases.groups:
        lo, hi = index.search(group)
        count = hi - lo
        which = np.repeat(np.arange(len(group)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        if len(rows):
            yield n, where[index.locate(rows)], which, items


def found(texts: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: merged [start, end) word spans of all occurrences, and the items that occur."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    ends = np.cumsum([len(ws) for ws in texts]) if texts else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    cover = np.zeros(total + 1, np.int64)
    for n, starts, which, owners in hits(texts, phrases):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + n, -1)
        doc = np.searchsorted(ends, starts, side="right")
        for pair in np.unique(doc * len(owners) + which):
            items[pair // len(owners)].update(owners[int(pair % len(owners))])
    covered = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    edge = np.diff(covered)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts_at = np.concatenate(([0], ends))
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        # Spans of neighbouring texts may touch: they are cut at the texts' ends.
        while b < e:
            d = int(np.searchsorted(ends, b, side="right"))
            stop = min(e, int(ends[d]))
            spans[d].append((b - int(starts_at[d]), stop - int(starts_at[d])))
            b = stop
    return spans, items


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0), dtype=np.int64)
    begin = size = 0
    for k, n in enumerate(lengths.tolist()):
        if size and size + n > SHARD:
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)


def _blocks(benchmark: DataFrame) -> list:
    """The benchmark's items, a name and a broadcast for each block of about BLOCK bytes."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item_id, r.text) for r in rows.where(part == k).toLocalIterator()])) for k in range(n)]


def spotted(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = (), last=None, schema=None) -> DataFrame:
    """doc_id, text, the columns of keep, then array<struct<s,e>> of hit word spans (merged), and array<string> of items.

    last(batch, spans, items), if given, makes the result's batches, of the schema given, from such a batch and the names of
    its last two columns, in the same Python worker as the last search.
    """
    held = [c for c in dict.fromkeys(("doc_id", "text", *keep))]
    spans_, items_ = fresh(docs, "_spans", "_items")
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)").alias(spans_), F.expr("cast(array() as array<string>)").alias(items_)
    out = docs.select(*held, *empty)
    kind = out.schema
    finish = (lambda batch: last(batch, spans_, items_)) if last else None

    def search(name, block, then):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole):
                    phrases = built(name, block, window)
                    texts = [words(t.as_py()) for t in batch.column("text")]
                    spans, items = found(texts, phrases)
                    old = batch.column(spans_).to_pylist(), batch.column(items_).to_pylist()
                    if any(map(len, old[1])) or any(map(len, old[0])):
                        spans = [merged([*((x["s"], x["e"]) for x in a), *b]) for a, b in zip(old[0], spans, strict=True)]
                        items = [{*a, *b} for a, b in zip(old[1], items, strict=True)]
                    a = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], batch.schema.field(spans_).type)
                    b = pa.array([sorted(x) for x in items], batch.schema.field(items_).type)
                    made = pa.RecordBatch.from_arrays([*batch.columns[:-2], a, b], batch.schema.names)
                    yield then(made) if then else made

        return scan

    blocks = _blocks(benchmark)
    for name, block in blocks[:-1]:
        out = out.mapInArrow(search(name, block, None), kind)
    for name, block in blocks[-1:]:
        out = out.mapInArrow(search(name, block, finish), schema if last else kind)
    if last and not blocks:
        out = out.mapInArrow(lambda batches: map(finish, batches), schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The contract's columns, one row per row of docs. No shuffle: each text passes once through each block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batch: pa.RecordBatch, spans_: str, items_: str) -> pa.RecordBatch:
        n = [len(words(t.as_py())) for t in batch.column("text")]
        spans, items = batch.column(spans_).to_pylist(), batch.column(items_).to_pylist()
        hit = [sum(x["e"] - x["s"] for x in s) for s in spans]
        sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
            pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
        ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return spotted(docs, benchmark, window, last=digest, schema=f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the benchmark's passages: hit words go with what stands between them, n_chars follows.

    Documents with no hit are untouched; those that have no word left go.
    """
    columns = docs.columns

    def cut(batch: pa.RecordBatch, spans_: str, items_: str) -> pa.RecordBatch:
        spans, texts = batch.column(spans_).to_pylist(), batch.column("text")
        out, sizes, keep = [], batch.column("n_chars").to_pylist() if "n_chars" in columns else None, []
        for k, (span, text) in enumerate(zip(spans, texts, strict=True)):
            text = text.as_py()
            if span:
                text = without(text, [(x["s"], x["e"]) for x in span])
                if sizes is not None:
                    sizes[k] = len(text)
            out.append(text)
            keep.append(not span or bool(words(text)))
        new = {"text": out, "n_chars": sizes}
        cols = [pa.array(new[c], batch.schema.field(c).type) if new.get(c) is not None else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(cols, columns).filter(pa.array(keep, pa.bool_()))

    return spotted(docs, benchmark, window, tuple(columns), cut, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans. re's A-Z and the bytes' are the same words."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:places[s][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])
