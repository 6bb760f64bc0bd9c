"""Quality classifier: random-indexing word vectors pooled per document, and a calibrated two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of words and of word shapes, dimensions of a vector, signed ones in an index vector.
STEMS, SHAPES, DIM, ONES = 8192, 4096, 48, 4
#: Words whose vectors are looked up at once; words that a task remembers.
CHUNK, CACHE = 1 << 16, 300_000
#: Labelled rows that the network is fitted on at most, taken by a hash of doc_id.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH = 32, 60, 256
EXTRA = 4
_CLASS = re.compile(r"([^\W\d_]+)|(\d+)|([^\w]+|_+)")


def index_vectors(seed: int = 11) -> np.ndarray:
    """A sparse vector of ONES signed ones for each bucket."""
    state = np.random.RandomState(seed)
    out = np.zeros((STEMS + SHAPES, DIM), dtype=np.float32)
    rows = np.repeat(np.arange(STEMS + SHAPES), ONES)
    columns = np.argsort(state.rand(STEMS + SHAPES, DIM), axis=1)[:, :ONES].ravel()
    out[rows, columns] = state.choice([-1.0, 1.0], len(rows))
    return out


def _letters(run: str) -> str:
    return "X" if run.isupper() and len(run) > 1 else "Xx" if run[0].isupper() else "x"


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, other runs as their first character, at most eight signs."""
    if word.isalpha():
        return _letters(word)
    if word[:-1].isalpha() and word[-1] in ".,;:!?":  # most of the others
        return _letters(word[:-1]) + word[-1]

    def sign(m: re.Match) -> str:
        letters, digits, other = m.groups()
        return _letters(letters) if letters else "9" if digits else other[0] * min(len(other), 3)

    return _CLASS.sub(sign, word)[:8]


class Buckets:
    """Word -> (stem bucket, shape bucket), remembering a bounded number of words."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def _new(self, word: str) -> int:
        stem, form = (word if word.isalpha() else word.strip("\"'.,;:!?()[]{}#*$%&|<>")).lower(), shape(word)
        place = self.shapes.get(form)
        if place is None:
            place = STEMS + zlib.crc32(form.encode()) % SHAPES
            if len(self.shapes) < SHAPES:
                self.shapes[form] = place
        both = zlib.crc32(stem.encode()) % STEMS << 16 | place
        if len(word) <= 64:
            self.known[word] = both
        return both

    def of(self, words: np.ndarray) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        found = list(map(self.known.get, words))
        both = np.array([self._new(w) if f is None else f for w, f in zip(words, found)], dtype=np.int64)
        return np.stack([both >> 16, both & 0xFFFF], axis=1)


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, words) of up to CHUNK words; a long text goes on in the next chunk."""
    words: list[list[str]] = []
    owner: list[tuple[int, int]] = []
    held = 0
    for k, text in enumerate(texts):
        own = (text or "").split()
        while own:
            part, own = own[: CHUNK - held], own[CHUNK - held :]
            words.append(part), owner.append((k, len(part)))
            held += len(part)
            if held >= CHUNK:
                yield np.repeat(*np.array(owner).T), np.array(list(chain.from_iterable(words)), dtype=object)
                words, owner, held = [], [], 0
    if held:
        yield np.repeat(*np.array(owner).T), np.array(list(chain.from_iterable(words)), dtype=object)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> for each bucket the sum of the index vectors of its neighbours, for one task.

    Sums are made for each unlike word of a chunk from the signed ones of its neighbours, and then added up by bucket."""
    index = index_vectors()
    where = np.nonzero(index)[1].reshape(len(index), ONES)
    signs = np.take_along_axis(index, where, axis=1)
    total = np.zeros((STEMS + SHAPES, DIM), dtype=np.int64)
    buckets = Buckets()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for owner, words in _chunks(batch.column(0).slice(at, 512).to_pylist()):
                codes, unique = pd.factorize(words)
                pair = buckets.of(unique)
                places, ones = np.hstack([where[pair[:, 0]], where[pair[:, 1]]]), np.hstack([signs[pair[:, 0]], signs[pair[:, 1]]])
                same = owner[1:] == owner[:-1]
                left, right = codes[:-1][same], codes[1:][same]
                word, near = np.concatenate((left, right)), np.concatenate((right, left))
                flat = word[:, None] * DIM + places[near]
                sums = np.bincount(flat.ravel(), weights=ones[near].ravel(), minlength=len(unique) * DIM).reshape(-1, DIM).astype(np.int64)
                for k in range(2):
                    by = np.argsort(pair[:, k], kind="stable")
                    first = np.flatnonzero(np.concatenate(([True], np.diff(pair[by, k]) > 0)))
                    total[pair[by[first], k]] += np.add.reduceat(sums[by], first, axis=0)
    seen = np.flatnonzero(total.any(axis=1))
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([r.tobytes() for r in total[seen].astype("<i8")], pa.binary())], ["bucket", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[bucket] = total.get(bucket, 0) + np.frombuffer(sums, dtype="<i8")
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["bucket", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, over all words of all texts.

    Each task sums whole numbers into one table of fixed size, STEMS + SHAPES rows; tables are added by bucket,
    and one table reaches the driver, whatever the corpus's size."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_contexts, "bucket int, sums binary")
    out = np.zeros((STEMS + SHAPES, DIM))
    for row in parts.repartition(min(n, 64), "bucket").mapInArrow(_summed, "bucket int, sums binary").collect():
        out[row["bucket"]] = np.frombuffer(bytes(row["sums"]), dtype="<i8")
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Pooler:
    """Mean word vectors of texts, with a few counts."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.index, self.buckets = vectors, index_vectors(), Buckets()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        sums = np.zeros((len(texts), 3 * DIM))
        words_in, unlike = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, words in _chunks(texts):
            codes, unique = pd.factorize(words)
            pair = self.buckets.of(unique)
            seen, counts = np.unique(owner * len(unique) + codes, return_counts=True)
            doc, code = np.divmod(seen, len(unique))
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            sums[doc[first], :DIM] += np.add.reduceat(self.vectors[pair[code, 0]] * counts[:, None].astype(np.float32), first, axis=0, dtype=np.float64)
            # A text has far fewer shapes than words, so their two vectors are added up by shape.
            shapes, place = np.unique(doc * (STEMS + SHAPES) + pair[code, 1], return_inverse=True)
            often = np.bincount(place, weights=counts).astype(np.float32)
            own, shape_of = np.divmod(shapes, STEMS + SHAPES)
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            both = np.hstack([self.vectors[shape_of], self.index[shape_of]]) * often[:, None]
            sums[own[start], DIM:] += np.add.reduceat(both, start, axis=0, dtype=np.float64)
            words_in[doc[first]] += np.add.reduceat(counts, first)
            unlike[doc[first]] += np.diff(np.concatenate((first, [len(doc)])))
        n = np.maximum(words_in, 1)
        lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
        repeated = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
        extra = np.stack([np.log1p(words_in) / 10, unlike / n, repeated, words_in > 0], axis=1)
        return np.hstack([sums / n[:, None], extra]).astype(np.float32)


class Network:
    """A tanh layer and a logistic output, in numpy; probabilities are softened by a fitted temperature."""

    def __init__(self, width: int, seed: int = 5):
        state = np.random.RandomState(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.params = [state.randn(width, HIDDEN) / np.sqrt(width), np.zeros(HIDDEN), state.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self.state = state

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def fit(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rate: float = 3e-3) -> None:
        """Adam on a shuffled four fifths of the rows; the rest chooses the temperature."""
        order = self.state.permutation(len(x))
        cut = max(1, len(x) // 5)
        held, used = order[:cut], order[cut:] if len(x) > cut else order
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        z, t = (x[used] - self.mean) / self.scale, y[used].astype(float)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(self.state.permutation(len(z)), max(1, len(z) // BATCH)):
                w1, b1, w2, b2 = self.params
                hidden = np.tanh(z[rows] @ w1 + b1)
                error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -60, 60))) - t[rows]) / len(rows)
                back = error[:, None] * w2 * (1 - hidden**2)
                step += 1
                for k, g in enumerate((z[rows].T @ back + decay * w1, back.sum(axis=0), hidden.T @ error + decay * w2, np.array([error.sum()]))):
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.params[k] = self.params[k] - rate * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        logits, target = self.logits(x[held]), y[held].astype(float)
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
        self.temperature = float(min(choices, key=lambda c: np.mean(np.logaddexp(0, logits / c) - target * logits / c)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _pool(shared):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = pooler(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in found], pa.binary())], ["label", "x"])

    return pool


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network | None]:
    """Word vectors over all of docs and a network fitted on at most about max_train labelled rows outside the held-out third.

    Rows are taken by a hash of doc_id, one of each id (of repeated ones the least text and label); without labels of both kinds there is
    no network. The labels that are used are few by that bound and are broadcast, and their features come to the driver."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = usable.count()
    if n > max_train:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    shared = spark.sparkContext.broadcast(vectors)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(usable), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("x")).select("x.label", "x.text").mapInArrow(_pool(shared), "label int, x binary")
    pooled = sorted((r["label"], bytes(r["x"])) for r in rows.collect())
    x = np.array([np.frombuffer(v, dtype=np.float32) for _, v in pooled], dtype=float).reshape(len(pooled), 3 * DIM + EXTRA)
    y = np.array([k for k, _ in pooled])
    if len(set(y.tolist())) < 2:
        return vectors, None
    network = Network(x.shape[1])
    network.fit(x, y)
    return vectors, network


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs(doc_id, text, ...).

    held_out marks the third of rows (crc32 of doc_id as text, mod 3, is 1) whose labels are never read. score is
    the calibrated probability of labels.quality = 1 from the text alone; null and empty texts get the score of a
    text without words; without labels of both kinds all score 0.5. Rows with a null doc_id are scored and not held
    out; repeated rows are scored each; no rows give no rows; other columns are ignored. Three passes over the
    texts, which are never shuffled.
    """
    vectors, network = fit(docs, labels, max_train)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        pooler = Pooler(vectors)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = np.full(part.num_rows, 0.5) if network is None else network.probability(pooler(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
