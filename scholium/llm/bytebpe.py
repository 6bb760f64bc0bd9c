"""Byte-level BPE as a tree reduction: halves are encoded alone and neighbours joined by re-encoding the bytes at their seam."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text, and bytes of a match, that are not halved any more.
LEAF, ATOM = 512, 16
#: Bytes of a window from which on merges are taken from a heap.
WIDE = 128
#: Matches whose encoding a worker remembers at once, and the longest of them.
CACHE, CACHED = 1_000_000, 48
#: How far beyond its own beginning a match of the pattern may look at most, and so what a seam may change before it.
LOOK = 2


class Bpe:
    """Encodes as ranks say: of all neighbours whose union is a token the least rank is merged, of equal ones the first.

    A sequence of tokens is the encoding of its bytes if and only if each two neighbours in it are the encoding of
    theirs (each token being the encoding of its own bytes): the first merge over a border between two tokens would, as both sides are merged independently until
    then, also be made when these two stand alone. So tokens outside a window are proved right as soon as the window's
    encoding begins and ends with the tokens that stood there before; until then the window grows.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a window, merge by merge."""
        if len(data) > WIDE:
            return self._merged_wide(data)
        get, none = self.ranks.get, 1 << 62
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return list(map(self.ranks.__getitem__, parts))

    def _merged_wide(self, data: bytes) -> list[int]:
        """The same in time n log n."""
        get, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place
        whole = [True] * n
        todo = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(todo)
        while todo:
            _, i, stop = heapq.heappop(todo)
            if not whole[i] or (mid := end[i]) >= n or end[mid] != stop:
                continue
            whole[mid], end[i], before[stop] = False, stop, i
            if stop < n and (r := get(data[i : end[stop]])) is not None:
                heapq.heappush(todo, (r, i, end[stop]))
            if (back := before[i]) >= 0 and (r := get(data[back:stop])) is not None:
                heapq.heappush(todo, (r, back, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if whole[i]]

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both, which are encodings, from growing windows over their seam."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(self.decoded(left[-i:]) + self.decoded(right[:j]))
            far_left, far_right = i == len(left) or window[0] == left[-i], j == len(right) or window[-1] == right[j - 1]
            if far_left and far_right:
                return (*left[:-i], *window, *right[j:])
            i, j = i if far_left else 2 * i, j if far_right else 2 * j

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one match. The first half is a power of two, so that halves of a run of equal bytes fit."""
        if len(data) <= ATOM:
            return tuple(self.merged(data))
        half = 1 << (len(data) - 1).bit_length() - 1
        return self.joined(self.piece(data[:half]), self.piece(data[half:]))

    def code(self, match: str, halves: tuple | None = None) -> tuple[int, ...]:
        """The encoding of a match, of which that of two halves may be known."""
        found = self.known.get(match)
        if found is None:
            found = self.joined(*halves) if halves else self.piece(match.encode())
            if len(match) <= CACHED:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[match] = found
        return found

    def tree(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        """Matches of the pattern in text and the encoding of each."""
        if len(text) <= LEAF:
            matches = self.matches(text)
            codes = list(map(self.known.get, matches))
            return matches, codes if all(codes) else [c or self.code(m) for m, c in zip(matches, codes)]
        half = len(text) // 2
        left, right = self.tree(text[:half]), self.tree(text[half:])
        self._sew(left, right)
        return left

    def _sew(self, left: tuple[list, list], right: tuple[list, list]) -> None:
        """Adds right to left. A match of left that ends LOOK characters before the seam stays; from there on matches are
        found again, in a growing window, until one surely ends where one of right's begins or right is at its end."""
        (matches, codes), (after, after_codes) = left, right
        crossing, halves = matches[-1] + after[0], (codes[-1], after_codes[0])
        undone = ""
        while matches and len(undone) < LOOK:
            undone = matches.pop() + undone
            codes.pop()
        j = 2
        while True:
            own = after[:j]
            window = undone + "".join(own)
            sure = len(window) - (LOOK if j < len(after) else 0)
            begins = dict(zip(accumulate(map(len, own), initial=len(undone)), range(len(own) + 1)))
            found = self.matches(window)
            for k, end in enumerate(accumulate(map(len, found), initial=0)):
                if end in begins and end <= sure:
                    matches += found[:k] + after[begins[end] :]
                    codes += [self.code(m, halves if m == crossing else None) for m in found[:k]] + after_codes[begins[end] :]
                    return
            j *= 2

    def encoded(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.tree(text)[1]))

    def decoded(self, ids) -> bytes:
        """The bytes of the tokens, put together up the tree: halves are decoded alone and need nothing at their seam."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


@lru_cache(maxsize=2)
def bpe(ranks: bytes, pattern: str) -> Bpe:
    """The encoder of a file whose lines are a base64 token and its rank; a worker makes and warms it once for all its tasks."""
    return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, back: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of docs(doc_id, text, ...): the token ids of the whole text; with back also
    a binary column decoded, what decode() makes of the ids, worked out by the same task.

    Each match of pattern is encoded by itself, special tokens are ordinary text. Texts are halved down to LEAF characters
    and matches to ATOM bytes; each half is encoded alone. Null and empty texts have no ids; null and repeated doc_ids keep
    their rows; no rows give no rows; other columns are ignored. A very long text, or a run without any border of the
    pattern in it, takes time n log n and memory in proportion to its length. One pass, no shuffle; the file of ranks, of fixed size,
    is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(*shared.value)
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            ids = [encoder.encoded(t or "") for t in part.column(1).to_pylist()]
            out = {"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if back:
                out["decoded"] = pa.array(map(encoder.decoded, ids), pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, ids array<int>" + ", decoded binary" * back
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, schema)


def decode(rows: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """rows(ids array<int>, ...) with a binary column decoded, the bytes of the ids, which need not be whole characters.

    No ids, or null, are no bytes; an id that the file lacks is an error. A column of rows that is called decoded is replaced."""
    kept = rows.drop("decoded")
    place = kept.columns.index("ids")
    shared = rows.sparkSession.sparkContext.broadcast((ranks, pattern))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = bpe(*shared.value)
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            ids = part.column(place)
            flat, sizes = ids.flatten().to_pylist(), pc.fill_null(pc.list_value_length(ids), 0).to_pylist()
            ends = list(accumulate(sizes, initial=0))
            out = pa.array([decoder.decoded(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return kept.mapInArrow(decoded, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))
