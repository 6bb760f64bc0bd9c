"""Centroid clustering in whole numbers; Yinyang bounds for groups of centroids spare most distances and change no result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import discard, spill, spread

K, ROUNDS, DIM, SCALE, GROUPS = 16, 3, 64, 64, 4
#: Larger whole numbers count as this, so that a squared distance fits a long.
LIMIT = 1 << 26
#: Bounds are loosened by this share, far over what rounding can do to them.
SLACK = 1e-9
SLICE = 4096
STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower array<double>"


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have the given length and no null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all centres: by a matrix product while every sum in it is a whole number
    that a double holds, else in integers."""
    if 4 * v.shape[1] * max(int(np.abs(v).max(initial=0)), int(np.abs(centres).max(initial=0))) ** 2 < 1 << 53:
        a, b = v.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)


def grouped(centres: np.ndarray, groups: int) -> list[np.ndarray]:
    """Places of centres, in at most the given number of groups of near ones."""
    mid = centres[:: max(1, -(-len(centres) // groups))][:groups].astype(np.float64)
    for _ in range(5):
        own = ((centres[:, None, :] - mid[None]) ** 2).sum(axis=2).argmin(axis=1)
        mid = np.array([centres[own == g].mean(axis=0) if (own == g).any() else mid[g] for g in range(len(mid))])
    return [found for g in range(len(mid)) if len(found := np.flatnonzero(own == g))]


def settle(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, groups: list[np.ndarray], drift: np.ndarray) -> int:
    """Moves each row of v to its nearest centre, of equally near ones the first, and keeps its bounds true, all in place.

    upper is no less than the distance to the row's own centre; lower, by group, no more than that to any other centre of the
    group. drift is how far each centre has moved since these were true. Returns how many distances were worked out.
    """
    upper += drift[cluster]
    lower -= [drift[g].max() for g in groups]
    open_rows = np.flatnonzero(upper >= lower.min(axis=1))  # the filter over all groups
    own = ((v[open_rows] - centres[cluster[open_rows]]) ** 2).sum(axis=1)
    upper[open_rows] = np.sqrt(own) * (1 + SLACK)
    still = upper[open_rows] >= lower[open_rows].min(axis=1)
    worked, rows, own = len(open_rows), open_rows[still], own[still]
    if not len(rows):
        return worked
    scan = lower[rows] <= upper[rows, None]  # the filter by group
    far = np.iinfo(np.int64).max
    found = np.full((len(rows), len(centres)), far)
    for g, members in enumerate(groups):
        at = np.flatnonzero(scan[:, g])
        found[np.ix_(at, members)] = squared(v[rows[at]], centres[members])
        worked += len(at) * len(members)
    before, each = cluster[rows].copy(), np.arange(len(rows))
    found[each, before] = own
    cluster[rows] = found.argmin(axis=1)
    upper[rows] = np.sqrt(found[each, cluster[rows]]) * (1 + SLACK)
    found[each, cluster[rows]] = far
    for g, members in enumerate(groups):
        nearest = np.sqrt(found[:, members].min(axis=1).astype(np.float64)) * (1 - SLACK)
        # Of a group that was not scanned only the row's former centre may be known.
        lower[rows, g] = np.where(scan[:, g], nearest, np.minimum(lower[rows, g], nearest))
    return worked


def _assign(shared, scale: int, last: bool):
    """A pass over raw vectors or over the state of the pass before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, groups, drift = shared.value
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            n = part.num_rows
            if part.num_columns == 2:
                v, before = whole(matrix(part.column(1), centres.shape[1]), scale), pa.nulls(n, pa.int32())
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, len(groups)), -np.inf)
            else:
                v, before = matrix(part.column(1), centres.shape[1]).astype(np.int64), part.column(2)
                cluster, upper, lower = before.to_numpy().astype(np.int64), part.column(4).to_numpy().copy(), matrix(part.column(5), len(groups)).copy()
            settle(v, cluster, upper, lower, centres, groups, drift)
            now = pa.array(cluster.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([part.column(0), now, pa.array(((v - centres[cluster]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])
            else:
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()) for x in (v.astype(np.int32), lower)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists[0], now, before, pa.array(upper), lists[1]], ["vec_id", "v", "cluster", "before", "upper", "lower"])

    return assign


def _changes(k: int, dim: int):
    """Rows that moved -> what each centre's sums and count gain and lose by them, for one task."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            v = matrix(batch.column(0), dim).astype(np.int64)
            v = np.hstack([v, np.ones((len(v), 1), np.int64)])
            np.add.at(total, batch.column(1).to_numpy(), v)
            left = np.flatnonzero(~batch.column(2).is_null().to_numpy(zero_copy_only=False))
            np.subtract.at(total, batch.column(2).drop_null().to_numpy(), v[left])
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "gain"])

    return changes


def digest(numbers) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, groups: int = GROUPS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept row of vectors(vec_id, embedding, ...).

    Kept are vectors of exactly dim components, none null, NaN or infinite; x becomes floor(scale * x), held within LIMIT. The
    first centres are the kept vectors of the k least sha256 digests of `1:<vec_id>`; equal ids come in the order of their
    vectors, rows without an id last; fewer vectors give fewer centres. Each round moves every vector to its
    nearest centre (ties: the smaller number) and every centre that has vectors to the floor of their mean. cluster and
    squared distance are of one more assignment after that. Sums of distances that no long holds are null. Repeated rows count
    each; no kept rows give no rows; other columns are ignored.

    The first centres are grouped once, on the driver (k vectors). A vector carries an upper bound of the distance to its
    centre and a lower bound for each group from pass to pass, so a pass writes the table once and shuffles nothing; sums change
    by the vectors that moved alone: k * (dim + 1) numbers a task, added up before they reach the driver. What is sent to tasks is k centres.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = spread(vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).where((F.size("embedding") == dim) & finite(F.col("embedding"))))
    first = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("digest"), x.alias("x")).orderBy(F.asc_nulls_last("digest"), "x").limit(k)
    centres = whole(np.array([r["x"] for r in first.collect()], dtype=np.float64).reshape(-1, dim), scale)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    by_group, drift = grouped(centres, groups), np.zeros(len(centres))
    totals = np.zeros((len(centres), dim + 1), dtype=object)
    state = rows
    for r in range(rounds + 1):
        shared, last = spark.sparkContext.broadcast((centres, by_group, drift)), r == rounds
        was, state = state, spill(state.mapInArrow(_assign(shared, scale, last), "vec_id long, cluster int, distance long" if last else STATE))
        if r:
            discard(was)
        if not last:
            moved = state.where(F.col("before").isNull() | (F.col("before") != F.col("cluster"))).select("v", "cluster", "before")
            gains = moved.mapInArrow(_changes(len(centres), dim), "cluster int, gain array<long>").select("cluster", F.posexplode("gain").alias("i", "gain"))
            for c, i, gain in gains.groupBy("cluster", "i").agg(F.sum("gain")).collect():
                totals[c, i] += gain
            new = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centres.tolist())], dtype=np.int64).reshape(-1, dim)
            drift = np.sqrt(((new - centres) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            centres = new
    sums = {s["cluster"]: s["s"] for s in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(n) -> int | None:
        return int(n) if n < 1 << 63 else None

    facts = [(c, fits(s), fits(sum(sums.values())), digest(centres[c].tolist())) for c, s in sorted(sums.items())]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
