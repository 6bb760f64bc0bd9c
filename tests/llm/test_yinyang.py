import hashlib
import math

import numpy as np
import pytest

from scholium.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, inertia int"


def brute(rows, k, rounds, dim=64, scale=64):
    kept = [(i, [max(-yinyang.LIMIT, min(yinyang.LIMIT, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for d, _ in found)
    return [(i, n, d, sum(e for e, m in found if m == n), total, digest[n]) for (i, _), (d, n) in zip(kept, found)]


def some(seed, n, spots, dim=64):
    state = np.random.RandomState(seed)
    mid = state.randn(spots, dim)
    return [(i, (mid[state.randint(spots)] + 0.3 * state.randn(dim)).astype(np.float32).tolist()) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 2) for i, v in rows], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("k, rounds, groups", [(16, 3, 4), (5, 2, 1), (3, 0, 2), (40, 4, 7)])
def test_against_plain_rounds(spark, k, rounds, groups):
    rows = some(k, 300, 9)
    found = yinyang.clusters(table(spark, rows), k=k, rounds=rounds, groups=groups)
    assert ordered(map(tuple, found.collect())) == ordered(brute(rows, k, rounds))


def test_odd_rows(spark):
    rows = some(1, 40, 3)
    rows += [(3, rows[3][1]), (3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [0.5] * 64)]  # repeated and missing ids
    rows += [(50, None), (51, []), (52, [0.1] * 63), (53, [0.1] * 65), (54, [0.1] * 63 + [None]), (55, [float("nan")] + [0.1] * 63), (56, [float("-inf")] + [0.1] * 63)]
    rows += [(60, [1e30] + [0.0] * 63), (61, [-1e30] + [0.0] * 63)]  # held within the limit
    rows += [(70 + i, [0.25] * 64) for i in range(20)]  # equally near to several centres
    found = ordered(map(tuple, yinyang.clusters(table(spark, rows)).collect()))
    want = brute(rows, 16, 3)
    assert found == ordered(want)


def test_fewer_vectors_than_centres_and_none(spark):
    rows = some(2, 4, 2)
    assert ordered(map(tuple, yinyang.clusters(table(spark, rows)).collect())) == ordered(brute(rows, 16, 3))
    none = yinyang.clusters(table(spark, [(1, None)]))
    assert none.collect() == [] and none.columns == yinyang.clusters(table(spark, rows)).columns


def test_bounds_spare_distances():
    state = np.random.RandomState(4)
    mid = state.randint(-200, 200, (16, 64))
    v = mid[state.randint(16, size=2000)] + state.randint(-9, 9, (2000, 64))
    centres, drift = mid.astype(np.int64), np.zeros(16)
    groups = yinyang.grouped(centres, 4)
    assert sorted(np.concatenate(groups).tolist()) == list(range(16))
    cluster, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.full((2000, len(groups)), -np.inf)
    yinyang.settle(v, cluster, upper, lower, centres, groups, drift)
    for _ in range(4):
        moved = centres + state.randint(-2, 3, centres.shape)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1)) * (1 + yinyang.SLACK)
        centres = moved
        worked = yinyang.settle(v, cluster, upper, lower, centres, groups, drift)
        far = yinyang.squared(v, centres)
        assert (cluster == far.argmin(axis=1)).all()
        assert worked < 0.25 * far.size
        assert (upper >= np.sqrt(far.min(axis=1))).all()
        others = far.astype(float)
        others[np.arange(len(v)), cluster] = np.inf
        assert all((lower[:, g] <= np.sqrt(others[:, m].min(axis=1))).all() for g, m in enumerate(groups))


def test_distances_in_integers_where_doubles_end():
    v = np.array([[1 << 26] * 64, [-(1 << 26)] * 64], dtype=np.int64)
    assert yinyang.squared(v, v).tolist() == [[0, 1 << 60], [1 << 60, 0]]
