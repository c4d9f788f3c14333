"""Secrets: fixed patterns, and strings that zstandard can't predict from the code around them.

A candidate is a token of 16 or more characters that a sensitive word stands in or closely before. Its novelty is the
number of bytes that it adds to a zstandard frame primed with a dictionary of identifiers and the text around, over the
bytes that a random string of its length and alphabet adds there: long strings of few characters and short ones in a
frame's overhead are so measured alike. Candidates at or over ``least`` are reported as kind ``novel``.

The identifiers are those that stand around sensitive words anywhere in the corpus, by the documents that have them;
they are shorter than a candidate, so that no string vouches for itself.

Defined results: null or empty text has no spans; null doc_ids and repeated rows keep a row each; an empty table
gives an empty result; other columns are not read; without identifiers the text around is the whole dictionary.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words after which a string may be sensitive, and the candidates themselves.
SENSITIVE = re.compile(r"(?ia:password|passwd|pwd|secret|token|api_?key|credential|bearer|private_?key|auth|signature)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"(?<![A-Za-z_])[A-Za-z_]{4,15}(?![A-Za-z_])")
#: Code points of text before and after a candidate that prime the dictionary, and how far a sensitive word reaches.
AROUND, REACH = 512, 64
#: Bytes of the dictionary, and the documents that an identifier in it needs.
DICTIONARY, SUPPORT = 8192, 3
ALPHABETS = tuple(map(frozenset, ("0123456789", "0123456789abcdef", "0123456789ABCDEF")))
CASES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-")


def assigned(text: str, low: str) -> list[tuple[int, int]]:
    if not ("passw" in low or "secret" in low or "token" in low or "api" in low):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 8]


def alphabet(own: str) -> str:
    """The characters that a string like this is drawn from: digits, hex digits, or the kinds of characters it has."""
    held = set(own)
    for few in ALPHABETS:
        if held <= few:
            return "".join(sorted(few))
    return "".join(kind for kind in CASES if held & set(kind))


def alike(own: str) -> str:
    """A random string of the length and alphabet of own, the same one each time."""
    letters, n = alphabet(own), len(own)
    drawn = hashlib.shake_128(f"{letters}:{n}".encode()).digest(4 * n)
    return "".join(letters[int.from_bytes(drawn[4 * k:4 * k + 4], "big") % len(letters)] for k in range(n))


class Novelty:
    """Marginal compressed bytes of a string over those of a random one, given what stands around it."""

    def __init__(self, identifiers: bytes = b"", level: int = 3):
        self.identifiers, self.level = identifiers, level

    def made(self, primer: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(self.identifiers + primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def share(self, text: str, start: int, end: int) -> float:
        """Bytes that the candidate adds to its line's beginning, over those that a random string adds."""
        lead = text[max(0, start - REACH):start].encode("utf8", "surrogatepass")
        primer = (text[max(0, start - AROUND):max(0, start - REACH)] + text[end:end + AROUND]).encode("utf8", "surrogatepass")
        own = text[start:end]
        made = self.made(primer)
        alone, with_own, with_any = (len(made.compress(lead + more.encode())) for more in ("", own, alike(own)))
        return (with_own - alone) / max(1, with_any - alone)


def sensitive_ends(text: str) -> list[int]:
    return [w.end() for w in SENSITIVE.finditer(text)]


def around(text: str) -> set[str]:
    """Identifiers within AROUND of a sensitive word."""
    windows: list[list[int]] = []
    for end in sensitive_ends(text):
        if windows and end - AROUND <= windows[-1][1]:
            windows[-1][1] = end + AROUND
        else:
            windows.append([max(0, end - AROUND), end + AROUND])
    return {w for start, stop in windows for w in IDENTIFIER.findall(text, start, stop)}


def novel(text: str, novelty: Novelty, least: float) -> list[tuple[int, int]]:
    ends = sensitive_ends(text)
    if not ends:
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        k = bisect_left(ends, m.start() - REACH)
        if k < len(ends) and ends[k] <= m.end() and novelty.share(text, *m.span()) >= least:
            found.append(m.span())
    return found


def spans(text: str | None, novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    if not text:
        return []
    low = text.lower()
    out = [(s, 0, e) for s, e in assigned(text, low)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(s, 3, e) for s, e in novel(text, novelty, least)]
    return sorted(out)


def identifiers(docs: DataFrame) -> bytes:
    """The dictionary: identifiers around sensitive words, the most common last, where they cost least to point to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text"):
                text = text.as_py()
                if text:
                    n.update(around(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    out, size = [], 0
    # No word has under 4 letters, so that these rows fill the dictionary.
    for r in rows.orderBy(F.desc("n"), "word").limit(DICTIONARY // 5).collect():
        size += len(r["word"]) + 1
        if size > DICTIONARY:
            break
        out.append(r["word"])
    return "".join(w + " " for w in reversed(out)).encode()


def secrets(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """The contract's columns, and n_novel: one row per row of docs. Two passes over each text, and only counts of
    identifiers are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = identifiers(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = spans(text.as_py(), novelty, least)
                say = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(x for x, (_, k, _) in zip(say, found, strict=True) if k < 3)
                counts = [0] * 4
                for _, k, _ in found:
                    counts[k] += 1
                rows.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(say), counts[3]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
