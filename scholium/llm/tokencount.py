"""Token counts of a unigram tokenizer by a Viterbi pass that keeps scores and piece counts only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What a character outside the vocabulary scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Counts of chunks that a task remembers at once.
CACHE = 400_000


class UnigramCounter:
    """Counts pieces of the best-scoring segmentation into vocabulary pieces.

    Of segmentations that score the same up to a position the one whose last piece starts first wins. A character
    without a piece of its own may stand for itself at the least score minus UNKNOWN_PENALTY; it counts a token for
    each UTF-8 byte if the vocabulary has the 256 byte pieces, else a run of them counts one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # No piece goes over the edge before a space mark or around a line break: chunks between them are independent.
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in names)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if apart and self.bytes else r"(?s).+").findall
        self.cache: dict[str, tuple[int, float]] = {}

    def _best(self, text: str) -> tuple[int, float]:
        score, count, open_run = [0.0], [0], [False]
        hits = self.pieces.iter(text)
        hit = next(hits, None)
        for end in range(1, len(text) + 1):
            best, n, run, single = None, 0, False, False
            while hit is not None and hit[0] == end - 1:  # longest, so earliest start, first
                size, s = hit[1]
                s += score[end - size]
                if best is None or s > best:
                    best, n = s, count[end - size] + 1
                single = single or size == 1
                hit = next(hits, None)
            if not single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, run = s, True
                    n = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else int(not open_run[end - 1]))
            score.append(best), count.append(n), open_run.append(run)
        return count[-1], score[-1]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of text, spaces written as the space mark and one put in front; (0, 0) if empty."""
        if not text:
            return 0, 0.0
        total, best, cache = 0, 0.0, self.cache
        for chunk in self.chunks(SPACE + text.replace(" ", SPACE)):
            found = cache.get(chunk)
            if found is None:
                found = self._best(chunk)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(chunk) <= 64:
                    cache[chunk] = found
            total += found[0]
            best += found[1]
        return total, best


def vocabulary(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens, score), one row for each row of docs(doc_id, text, ...).

    pieces is the vocabulary, a list of bounded size that is broadcast. Null and empty texts have no tokens;
    repeated rows are counted each; very long texts take memory in proportion to their longest run without white
    space; no rows give no rows; other columns are ignored. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value)
        for part in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            found = [counter.count(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counted, "doc_id long, n_tokens long, score double")
