"""Removal of byte strings that an earlier document holds, by longest-previous-factor arrays.

A text of any size is never compared with another directly. Every 50-byte window picks the least hash of the
24-byte strings in it, its anchor; equal windows pick equal anchors. The bytes under a run of windows that pick one
anchor are a segment. Equal segments of one anchor are a class, named by 48 bits of anchor hash and 64 of digest; the
least document of a class comes from a grouped minimum, and everything that later documents have of the class goes, as
their longest previous factor is the segment itself. One representative of each class is put into the suffix array of its anchor's
classes: factor lengths come from the previous and the next suffix of a smaller document and the least common prefix on the way
there. Anchors with more classes than a task should sort are split by the bytes that their windows share (see _halves).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import discard, spill

#: Bytes of a match, of an anchor, and the anchors' starts in a window.
MATCH, GRAM = 50, 24
WINDOW = MATCH - GRAM + 1
#: Classes that one suffix array takes of one anchor; a group with more is split by further bytes.
GROUP = 4096
#: Bytes of a suffix, the longest segment rounded up to whole words.
WIDE = 80
#: Bytes of text that are hashed or sorted at once; texts that a task holds as Python objects at once.
PIECE, BLOCK, SLICE = 1 << 16, 1 << 18, 256
_POS = np.uint64((1 << 18) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.RandomState(7).randint(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    with np.errstate(over="ignore"):
        p2, p4, p8 = (_P ** np.uint64(k) for k in (2, 4, 8))
        h1 = _TABLE[buf]
        h2 = h1[:-1] * _P + h1[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h8 = h4[:-4] * p4 + h4[4:]
        h = (h8[:-8] * p8 + h8[8:])[:-8] * p8 + h8[16:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def anchor_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, last window, anchor hash, anchor's place in the first window) of the runs of windows
    that pick one anchor."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        buf = np.frombuffer(b"".join(p for _, _, p in parts), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        n = len(buf) - MATCH + 1
        h = _grams(buf)
        least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 11):  # the least of 2, 4, 8, 16 and then 27
            least = np.minimum(least[:-step], least[step:])
        pick = (least[:n] & _POS).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), np.maximum(sizes - MATCH + 1, 0))
        starts = np.arange(len(part)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(sizes - MATCH + 1, 0))[:-1])), np.maximum(sizes - MATCH + 1, 0))
        place = starts + (ends - sizes)[part]
        pick = pick[place]
        inside = pick - place
        new = np.concatenate(([True], (pick[1:] != pick[:-1]) | (part[1:] != part[:-1])))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(pick)])) - 1
        number, offset = np.array([x[0] for x in parts])[part[first]], np.array([x[1] for x in parts])[part[first]]
        return number, starts[first] + offset, starts[last] + offset, (h[pick[first]] >> np.uint64(16)).view(np.int64), inside[first]

    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - MATCH + 1, 0), PIECE):
            parts.append((k, at, text[at : at + PIECE + MATCH - 1]))
            held += len(parts[-1][2])
            if held >= PIECE:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _taken(columns: list[pa.Array], number: np.ndarray) -> list[pa.Array]:
    own = pa.array(number)
    return [c.take(own) for c in columns]


def _anchors(by: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(by, text) -> the unlike anchors of each text, or of each piece of a long one."""
        for batch in _slices(batches):
            for number, _, _, h, _ in anchor_runs(_texts(batch.column(len(by)))):
                order = np.lexsort((h, number))
                number, h = number[order], h[order]
                new = np.concatenate(([True], (number[1:] != number[:-1]) | (h[1:] != h[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), *_taken(batch.columns[: len(by)], number[new])], ["h", *by])

    return found


def _runs(by: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(by, text, shared anchors) -> digest of the bytes under each run of a shared anchor, and its place: start << 16 | size << 8 |
        the anchor's place in it."""
        for batch in _slices(batches):
            texts, shared = _texts(batch.column(len(by))), batch.column(len(by) + 1)
            hashes, ends = shared.flatten().to_numpy(), shared.offsets.to_numpy()
            ends = ends - ends[0]
            lists = [np.sort(hashes[lo:hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for number, first, last, h, at in anchor_runs(texts):
                cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
                known = np.zeros(len(h), bool)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    own = lists[number[lo]]
                    known[lo:hi] = own[np.minimum(np.searchsorted(own, h[lo:hi]), len(own) - 1)] == h[lo:hi]
                if known.any():
                    number, first, end, h, at = number[known], first[known], last[known] + MATCH, h[known], at[known]
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(texts[k][i:j]) for k, i, j in zip(number.tolist(), first.tolist(), end.tolist())), dtype=np.uint64, count=len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(digest.view(np.int64)), *_taken(batch.columns[: len(by)], number), pa.array(first << 16 | (end - first) << 8 | at)], ["h", "sd", *by, "place"])

    return found


def _cutouts(by: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(by, text, open runs) -> the bytes under each of them."""
        for batch in _slices(batches):
            texts, runs = _texts(batch.column(len(by))), batch.column(len(by) + 1)
            flat, ends = runs.flatten(), runs.offsets.to_numpy()
            ends = ends - ends[0]
            number = np.repeat(np.arange(len(texts)), np.diff(ends))
            h, place, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lo in range(0, len(number), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                start, size, at = place[part] >> 16, place[part] >> 8 & 255, place[part] & 255
                segs = [texts[k][i : i + n] for k, i, n in zip(number[part].tolist(), start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), *_taken(batch.columns[: len(by)], number[part]), pa.array(start, pa.int32()), pa.array(at, pa.int32()), pa.array(segs, pa.binary()), pa.array(hot[part])], ["h", *by, "start", "at", "seg", "hot"])

    return found


def _smaller(doc: np.ndarray, lcp: np.ndarray, step: int) -> np.ndarray:
    """For each suffix in order the common prefix with the nearest one of a smaller document, before it (step -1) or
    after it (step 1); 0 without one. lcp[i] is the common prefix of suffixes i - 1 and i.

    Every suffix points to its neighbour. A pointer to a document that is no smaller is replaced by that suffix's own
    pointer, all at once, until none is left; what lies between has no smaller document. Pointers that have come down
    to a prefix under MATCH are left alone.
    """
    n = len(doc)
    near = np.arange(n) + step
    common = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
    ends = lambda x: (x >= 0) & (x < n)
    while True:
        bad = np.flatnonzero(ends(near) & (common >= MATCH))
        bad = bad[doc[near[bad]] >= doc[bad]]
        if not len(bad):
            break
        via = near[bad]
        common[bad], near[bad] = np.minimum(common[bad], common[via]), near[via]
    return np.where(ends(near) & (common >= MATCH), common, 0)


def longest_previous_factors(segments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment number, start, length) of the longest previous factors of MATCH bytes or more, in order.

    The suffix array covers the suffixes of MATCH bytes or more of all segments, none of which is longer than WIDE. A factor
    is previous if a segment of a smaller document has it: of the nearest suffix of a smaller document before and the
    one after, the longer common prefix is the factor's length.
    """
    sizes = np.array([len(s) for s in segments])
    buf = np.frombuffer(b"".join(segments) + bytes(WIDE), dtype=np.uint8)
    counts = sizes - MATCH + 1
    owner = np.repeat(np.arange(len(segments)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = sizes[owner] - inner
    keys = np.lib.stride_tricks.sliding_window_view(buf, WIDE)[inner + (np.cumsum(sizes) - sizes)[owner]]
    keys[np.arange(WIDE) >= left[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{WIDE}").ravel(), kind="stable")
    keys, left, doc = keys[order], left[order], docs[owner[order]]
    unlike = keys[1:] != keys[:-1]
    prefix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), WIDE)
    lcp = np.concatenate(([0], np.minimum(prefix, np.minimum(left[1:], left[:-1]))))
    length = np.zeros(len(owner), dtype=np.int64)
    length[order] = np.maximum(_smaller(doc, lcp, -1), _smaller(doc, lcp, 1))
    found = np.flatnonzero(length)
    return owner[found], inner[found], length[found]


def _spans(by: list[str]):
    def solved(cols: list[pa.Array]) -> pa.RecordBatch:
        start, seg, doc = cols[-2].to_numpy(), cols[-1], cols[1]
        # Equal segments of one document need one place in the suffix array.
        both = pa.table([doc, seg], ["doc", "seg"]).group_by(["doc", "seg"]).aggregate([]).to_pydict()
        place = {k: i for i, k in enumerate(zip(both["doc"], both["seg"]))}
        number = np.array([place[k] for k in zip(doc.to_pylist(), seg.to_pylist())])
        owner, begin, size = longest_previous_factors(both["seg"], np.array(both["doc"], dtype=np.int64))
        lo, hi = np.searchsorted(owner, number), np.searchsorted(owner, number, side="right")
        rows = np.repeat(np.arange(len(number)), hi - lo)
        each = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[rows]
        start = start[rows] + begin[each]
        end = start + size[each]
        new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (start[1:] > end[:-1])))) if len(rows) else np.zeros(0, int)  # factors of a row that touch are one span
        last = np.maximum.reduceat(end, new) if len(new) else end
        return pa.RecordBatch.from_arrays([*_taken(cols[1:-2], rows[new]), pa.array(start[new], pa.int32()), pa.array(last, pa.int32())], [*by, "start", "end"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, by, start, seg) sorted by h -> removed spans, a bounded number of bytes at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # where the last, maybe unfinished, group begins
            if cut:
                held.append(batch.slice(0, cut))
            elif not len(h) or held and held[-1].column(0)[-1].as_py() == h[0]:
                held.append(batch)
                continue
            if sum(b.nbytes for b in held) >= BLOCK:
                yield solved([pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held))])
                held = []
            held.append(batch.slice(cut))
        if sum(b.num_rows for b in held):
            yield solved([pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held))])

    return found


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs as (doc, [row,] text, rest), and the names of its key. doc: doc_id, null before all others. row is there only where ids repeat,
    and tells rows of one doc_id with unlike texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    unique = docs.select(key.alias("doc")).groupBy("doc").count().where("count > 1").isEmpty()
    row = [] if unique else [F.xxhash64(text).alias("row")]
    rest = [F.struct(*keep).alias("rest")] if keep else []
    return docs.select(key.alias("doc"), *row, text.alias("text"), *rest), ["doc"] if unique else ["doc", "row"]


def _classes(runs: DataFrame) -> DataFrame:
    """(h, sd, first, k) of runs(h, sd, doc, ...): the least document of each class, and how many classes its group has if there are several.
    Both are combined before the shuffle."""
    least = runs.groupBy("h", "sd").agg(F.min("doc").alias("first"))
    several = least.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    return least.join(several.hint("shuffle_hash"), "h", "left")


def _judged(runs: DataFrame, classes: DataFrame, group: int) -> DataFrame:
    """The runs that lose bytes or may: late, if a smaller document is in their class; else those of groups with several
    classes, hot if there are more than `group` of them. A run finds one class; Spark splits the runs of a hot one among tasks, as in any skewed join."""
    rows = runs.join(classes.hint("shuffle_hash"), ["h", "sd"]).where("doc > first or k is not null")
    return rows.select(*runs.columns, (F.col("doc") > F.col("first")).alias("late"), (F.coalesce("k", F.lit(0)) > group).alias("hot"))


def _halves(segments: DataFrame, by: list[str], width: int) -> DataFrame:
    """segments(h, by, start, at, seg) cut into pieces whose windows begin at most `width` places apart, counted
    from the anchor; h becomes the hash of the bytes that all windows of a piece's kind share, sd its digest.

    Equal windows lie at one place from one anchor, so they are in pieces of one kind with the same shared bytes.
    """
    shift = F.lit(WINDOW - 1) - F.col("at")  # of the first window, from the leftmost that picks the anchor
    last = F.length("seg") - MATCH
    cells = F.sequence(F.floor(shift / width).cast("int"), F.floor((shift + last) / width).cast("int"))
    rows = segments.select("h", *by, "start", "at", "seg", shift.alias("shift"), last.alias("last"), F.explode(cells).alias("c"))
    low = F.greatest(F.lit(0), F.col("c") * width - F.col("shift"))
    high = F.least(F.col("last"), (F.col("c") + 1) * width - 1 - F.col("shift"))
    # Shared: from the rightmost window's first byte to the leftmost one's last, whether or not this piece has them.
    right = F.least(F.lit(WINDOW - 1), (F.col("c") + 1) * width - 1) - F.col("shift")
    shared = F.substring("seg", right + 1, F.col("c") * width + MATCH - F.col("shift") - right)
    piece = F.substring("seg", low + 1, high - low + MATCH)
    return rows.select(F.xxhash64("h", "c", shared).alias("h"), F.xxhash64(piece).alias("sd"), *by, (F.col("start") + low).cast("int").alias("start"), (F.col("at") - low).cast("int").alias("at"), piece.alias("seg"))


def removed_spans(keyed: DataFrame, by: list[str], group: int = GROUP) -> list[DataFrame]:
    """Tables (by, late) and (by, spans) for the texts of keyed(by, text) that lose bytes: places of runs, and spans (start, end).

    Each step is written before the next begins, so that its shuffle files and the tables before it can go. Hash joins hold one
    partition of their smaller side, which has one row a key, in memory: spark.sql.shuffle.partitions has to grow with the input, about one for 10 MB.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ", ".join(f"{c} long" for c in by)
    sort = lambda df: df.select("h", *by, "start", "seg").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_spans(by), f"{key}, start int, end int")
    anchors = keyed.select(*by, "text").mapInArrow(_anchors(by), f"h long, {key}")
    shared = spill(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    lists = spill(anchors.join(shared.hint("shuffle_hash"), "h").groupBy(*by).agg(F.collect_list("h").alias("hs")))
    discard(shared)
    runs = spill(keyed.join(lists.hint("shuffle_hash"), by).select(*by, "text", "hs").mapInArrow(_runs(by), f"h long, sd long, {key}, place long"))
    discard(lists)
    classes = spill(_classes(runs))
    late = F.collect_list(F.when(F.col("late"), F.col("place")))
    asked = F.collect_list(F.when(~F.col("late"), F.struct("h", "place", "hot")))
    whole = spill(_judged(runs, classes, group).groupBy(*by).agg(late.alias("late"), asked.alias("open")))
    discard(runs), discard(classes)
    parts = spill(keyed.join(whole.where(F.size("open") > 0).hint("shuffle_hash"), by).select(*by, "text", "open").mapInArrow(_cutouts(by), f"h long, {key}, start int, at int, seg binary, hot boolean"))
    found = [spill(sort(parts.where("not hot")))]
    hot, width, made = parts.where("hot"), 16, [parts]
    while not hot.isEmpty():  # at width 1 a piece is one window, and no group has two classes
        pieces = spill(_halves(hot, by, width))
        judged = spill(_judged(pieces, _classes(pieces), group))
        discard(pieces)
        found.append(spill(judged.where("late").select(*by, "start", (F.col("start") + F.length("seg")).alias("end")).unionAll(sort(judged.where("not late and not hot")))))
        hot, width = judged.where("not late and hot"), width // 4
        made.append(judged)
    spans = found[0]
    for table in found[1:]:
        spans = spans.unionAll(table)
    spans = spill(spans.groupBy(*by).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    for table in made + found:
        discard(table)
    return [whole.select(*by, "late"), spans]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, late, spans, rest) -> (kept, n_bytes, n_removed, n_spans, rest)."""
    for batch in _slices(batches):
        texts = _texts(batch.column(0))
        places, lists = batch.column(1), batch.column(2)
        late, flat = places.flatten().to_numpy(), lists.flatten()
        starts, stops = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        late_ends, ends = places.offsets.to_numpy() - places.offsets[0].as_py(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        kept, gone, runs = [], [], []
        for k, text in enumerate(texts):
            own, lo, hi = late[late_ends[k] : late_ends[k + 1]], int(ends[k]), int(ends[k + 1])
            if not len(own) and lo == hi:
                kept.append(text), gone.append(0), runs.append(0)
                continue
            first = np.concatenate((own >> 16, starts[lo:hi]))
            order = np.argsort(first, kind="stable")
            a, b = first[order], np.maximum.accumulate(np.concatenate(((own >> 16) + (own >> 8 & 255), stops[lo:hi]))[order])
            new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
            begin, end = a[new], b[np.concatenate((new[1:], [len(a)])) - 1]
            kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)])))
            gone.append(int((end - begin).sum())), runs.append(len(new))
        columns = [pa.array(kept, pa.binary()), pa.array(map(len, texts), pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, ["kept", "n_bytes", "n_removed", "n_spans", "rest"])


def remove_earlier(docs: DataFrame, group: int = GROUP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept, n_bytes, n_removed, n_spans, rest), one row for each row of docs(doc_id, text, ...); rest is a struct of
    the columns named by keep.

    Texts are UTF-8 bytes; a byte goes if a 50-byte string over it also starts in a document with a smaller
    doc_id. Strings are judged on the input, overlaps count, and matches never cross documents. kept holds the
    other bytes in order and may cut a character in two. A null text counts as empty; texts under 50 bytes lose
    nothing; very long ones are hashed in pieces that overlap, with the same result; a null doc_id comes before all
    others; rows with one doc_id never remove each other's bytes, and rows that repeat id and text are worked out
    once; no rows give no rows; other columns are ignored, whatever their names.

    Two passes shuffle anchors (about one per 14 bytes); whole texts are joined with their shared anchors, then with
    their open runs, then with their spans, and what a step needed goes before the next. `group` bounds the classes of one
    anchor that one task sorts; it changes the plan, never the rows.
    """
    keyed, by = _keyed(docs, keep)
    texts = keyed.drop("rest")
    whole, found = removed_spans(texts if by == ["doc"] else texts.dropDuplicates(by), by, group)
    joined = keyed.join(whole, by, "left").join(found, by, "left")
    filled = [F.coalesce("late", F.array().cast("array<long>")).alias("late"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")]
    kind = keyed.schema["rest"].dataType.simpleString()
    return joined.select("text", *filled, "rest").mapInArrow(_apply, f"kept binary, n_bytes long, n_removed long, n_spans long, rest {kind}")
