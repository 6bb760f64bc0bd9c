"""Vector codes: each part of a vector is named by its nearest codebook entry, found within a ring of norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import spill, spread
from scholium.llm.yinyang import digest, finite, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that are looked at on either side of the ring's middle before its width is worked out again.
STEP = 6
#: The ring is widened by this share, far over what rounding can do to norms.
SLACK = 1e-9
SLICE = 2048
#: Sums of errors by label are broadcast up to so many labels, and joined by a shuffle beyond.
BROADCAST_LABELS = 100_000


class Book:
    """The entries of one part, in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries**2).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance) of the nearest entry of each row of x, of equally near ones the first.

        Norms of two vectors differ by their distance at most, so an entry at least as near as the best so far has a norm
        between own - best and own + best. Entries are looked at outward from a row's own norm; after each STEP the ring that
        the best leaves open is found by binary search, its edges included, until all within it have been looked at.
        """
        own = np.sqrt((x**2).sum(axis=1).astype(np.float64))
        best, place = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        start = np.searchsorted(self.norms, own)
        low, high = start.copy(), start.copy()  # entries from low to high have been looked at
        first, last = np.zeros(len(x), np.int64), np.full(len(x), len(self.norms))
        rows, offsets = np.arange(len(x)), np.arange(STEP)
        while len(rows):
            down, up = low[rows, None] - 1 - offsets, high[rows, None] + offsets
            at = np.hstack([down, up])
            inside = np.hstack([down >= first[rows, None], up < last[rows, None]])
            self.evaluated += np.count_nonzero(inside)
            at[~inside] = 0
            far = sum((x[rows, i, None] - self.entries[at, i]) ** 2 for i in range(x.shape[1]))
            far[~inside] = np.iinfo(np.int64).max
            d = far.min(axis=1)
            p = np.where(far == d[:, None], self.order[at], len(self.order)).min(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (p < place[rows]))
            best[rows[better]], place[rows[better]] = d[better], p[better]
            low[rows] = np.maximum(low[rows] - STEP, first[rows])
            high[rows] = np.minimum(high[rows] + STEP, last[rows])
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK) + SLACK * (1 + own[rows])
            first[rows] = np.searchsorted(self.norms, own[rows] - reach, side="left")
            last[rows] = np.searchsorted(self.norms, own[rows] + reach, side="right")
            rows = rows[(low[rows] > first[rows]) | (high[rows] < last[rows])]
        return place, best


def _cut(part: pa.RecordBatch, column: int, books: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers by vector, part and position in it."""
    n, _, width = books.shape
    return whole(matrix(part.column(column), n * width), scale).reshape(-1, n, width)


def _tallies(shared, scale: int):
    """Vectors -> number and sums of the parts that fall to each entry, for one task."""

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        made = [Book(b) for b in books]
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            x = _cut(part, 0, books, scale)
            for p, book in enumerate(made):
                place, _ = book.nearest(x[:, p])
                np.add.at(total[p], place, np.hstack([x[:, p], np.ones((len(x), 1), np.int64)]))
        p, e = np.nonzero(total[:, :, -1])
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "gain"])

    return tallies


def _codes(shared, scale: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        made = [Book(b) for b in books]
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            x = _cut(part, 2, books, scale)
            found = [book.nearest(x[:, p]) for p, book in enumerate(made)]
            names = np.stack([place for place, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([row.tobytes().hex() for row in names], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return codes


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row for each kept row of vectors(vec_id, embedding, label, ...).

    Kept are vectors without null, NaN or infinite components, of the length that most of these have among lengths that parts
    divides (of equally frequent ones the least); x becomes floor(scale * x), held within a bound that keeps sums in a long. The first
    codebooks are the parts of the vectors of the `entries` least vec_ids, at most 256; rows that share an id come in the order of their
    vectors, rows without one last; fewer vectors give fewer entries. Each round moves every entry that is used to the floor of
    the mean of its parts; parts then go to their nearest entry once more (ties: the least index). error is the sum of squared
    distances, label_error that over equal labels, nulls together (null where no long holds it). Repeated rows count
    each; no kept rows give no rows; other columns are ignored.

    Each pass reads the vectors once and shuffles parts * entries rows a task at most, added up before they reach the driver, which
    holds the codebooks alone. A label may have any share of the rows: sums are made before the shuffle.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType
    good = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").where(finite(F.col("embedding")))
    length = good.groupBy(F.size("embedding").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").limit(1).collect()
    empty = f"vec_id long, label {kind.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if not length:
        return spark.createDataFrame([], empty)
    dim = length[0]["n"]
    rows = spread(good.where(F.size("embedding") == dim))
    x = F.col("embedding").cast("array<double>")
    first = rows.select("vec_id", x.alias("x")).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    books = whole(np.array([r["x"] for r in first]), scale).reshape(-1, parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("embedding").mapInArrow(_tallies(shared, scale), "part int, entry int, gain array<long>")
        sums = sums.groupBy("part", "entry").agg(F.array(*(F.sum(F.col("gain")[i]) for i in range(dim // parts + 1))).alias("gain"))
        books = books.copy()
        for found in sums.collect():
            *s, n = found["gain"]
            books[found["part"], found["entry"]] = [v // n for v in s]
    shared = spark.sparkContext.broadcast(books)
    coded = spill(rows.select("vec_id", "label", "embedding").mapInArrow(_codes(shared, scale), f"vec_id long, label {kind.simpleString()}, code string, error long"))
    totals = coded.groupBy(F.col("label").alias("own")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = spill(totals.select("own", F.expr("try_cast(total as long)").alias("label_error")))
    side = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    found = coded.join(side, F.col("label").eqNullSafe(F.col("own")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books.ravel().tolist())).alias("codebooks_sha256"))
