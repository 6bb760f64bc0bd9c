import hashlib
import math

import numpy as np
import pytest

from scholium.llm import vectorcodes
from scholium.llm.yinyang import LIMIT

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, own string"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, l, [max(-LIMIT, min(LIMIT, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in kept if v and len(v) % parts == 0]
    dim = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    kept = [r for r in kept if len(r[2]) == dim]
    w = dim // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, _, v in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for n in range(len(books[p])):
                own = [cut(v)[p] for (_, _, v), f in zip(kept, found) if f[p][1] == n]
                if own:
                    books[p][n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    return [(i, l, "".join(f"{n:02x}" for _, n in f), e, sum(x for x, (_, m, _) in zip(error, kept) if m == l), digest) for (i, l, _), f, e in zip(kept, found, error)]


def some(seed, n, dim=64):
    state = np.random.RandomState(seed)
    mid = state.randn(5, dim)
    return [(i, (mid[state.randint(5)] + 0.4 * state.randn(dim)).astype(np.float32).tolist(), [None, 1, 2][state.randint(3)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 7, "x") for i, v, l in rows], SCHEMA)


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("dim, entries, rounds", [(64, 64, 2), (32, 7, 1), (128, 20, 0)])
def test_against_plain_search(spark, dim, entries, rounds):
    rows = some(dim, 150, dim)
    found = vectorcodes.vector_codes(table(spark, rows), entries=entries, rounds=rounds)
    assert ordered(map(tuple, found.collect())) == ordered(brute(rows, entries=entries, rounds=rounds))


def test_odd_rows(spark):
    rows = some(3, 80)
    rows += [(3, rows[4][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), (None, [0.5] * 64, 9)]
    rows += [(90, None, 1), (91, [], 1), (92, [0.1] * 32, 1), (93, [0.1] * 63, 1), (94, [0.1] * 63 + [None], 1), (95, [float("nan")] + [0.1] * 63, 1), (96, [float("inf")] + [0.1] * 63, 1)]
    rows += [(97, [1e30] + [-1e30] * 63, 4), (98, [0.0] * 64, 4)]
    rows += [(100 + i, [0.25] * 64, 5) for i in range(20)]
    assert ordered(map(tuple, vectorcodes.vector_codes(table(spark, rows)).collect())) == ordered(brute(rows))


def test_fewer_vectors_than_entries_and_none(spark):
    rows = some(6, 5)
    assert ordered(map(tuple, vectorcodes.vector_codes(table(spark, rows)).collect())) == ordered(brute(rows))
    none = vectorcodes.vector_codes(table(spark, [(1, None, 1)]))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_sums_over_the_labels_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    rows = some(8, 60)
    assert ordered(map(tuple, vectorcodes.vector_codes(table(spark, rows)).collect())) == ordered(brute(rows))


@pytest.mark.parametrize("width, spread", [(4, 3), (4, 400), (1, 5), (16, 300)])
def test_rings_are_exact_and_narrow(width, spread):
    state = np.random.RandomState(width)
    entries, x = state.randint(-spread, spread, (64, width)).astype(np.int64), state.randint(-spread, spread, (900, width)).astype(np.int64)
    book = vectorcodes.Book(entries)
    place, far = book.nearest(x)
    plain = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (place == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    if spread == 400 or width == 1:  # among few whole numbers many norms are alike
        assert book.evaluated < 0.8 * plain.size
