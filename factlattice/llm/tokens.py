"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick names every vocabulary piece that ends at a place, longest first; the dynamic programme carries the best
score and its piece count, nothing else. Ties go to the piece that starts first, as the tokenizer's strict comparison
has it: it meets starts in ascending order. A character that no piece covers costs the least score less 10 and counts
as its bytes where the vocabulary has byte pieces, or as one unknown for a run of them.

The vocabulary is the public 32k piece model's pieces and scores, read as a unigram model: no public vocabulary here is
of that kind by itself. Words begin at spaces and are counted apart, so a word's count is kept and used again.

Defined results: null and empty texts have 0 tokens; null doc_ids and repeated rows keep a row each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

PENALTY = 10.0
MARK = "▁"
#: Distinct words whose counts a worker keeps at a time; longer words aren't kept.
KEPT, KEPT_LENGTH = 300_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.known: dict[str, int] = {}

    def word(self, chunk: str) -> int:
        """Pieces of the best segmentation of one chunk."""
        n = len(chunk)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, piece in self.automaton.iter(chunk):
            ending[last + 1].append(piece)
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, score in ending[end]:
                score += best[end - length]
                if top is None or score > top:
                    top, pieces = score, count[end - length] + 1
                single = single or length == 1
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, loose[end] = score, True
                    pieces = count[end - 1] + (len(chunk[end - 1].encode("utf8", "surrogatepass")) if self.bytes else not loose[end - 1])
            best[end], count[end] = top, pieces
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = text.replace(MARK, " ").split(" ")
        if not chunks[0] and len(chunks) > 1:
            del chunks[0]
        known, total = self.known, 0
        for chunk in chunks:
            n = known.get(chunk)
            if n is None:
                n = self.word(MARK + chunk)
                if len(chunk) <= KEPT_LENGTH:
                    if len(known) >= KEPT:
                        known.clear()
                    known[chunk] = n
            total += n
        return total


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens: one row per row of docs. One pass, no shuffle; the vocabulary is a fixed broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(pieces.value)
            n = [counter.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_tokens long")
