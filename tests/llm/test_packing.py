from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import packing


def brute(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["s"].add(source), bins[k]["c"].add(cluster)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c", "d"]), st.sampled_from([None, 1, 2, 3])), max_size=60))
def test_best_fit_against_brute_force(items):
    assert packing.best_fit(items, 20) == brute(items, 20)


def test_pack(make_docs, corpus):
    docs = make_docs(corpus)
    placed = packing.pack(docs, capacity=64, shard=16).collect()
    size = {}
    for i, t in corpus:
        size[i] = size.get(i, 0) + len((t or "").split()) + 1
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in placed:
        total[r.doc_id] += r["size"]
        bins[r.bin_id].append(r)
    assert total == size
    sources = {i: f"s{(i or 0) % 3}" for i, _ in corpus}
    text = dict(corpus)
    for rows in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r["size"]) for r in rows)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 64
        assert len({sources[r.doc_id] for r in rows}) == len(rows)
        assert len({" ".join((text[r.doc_id] or "").lower().split()) for r in rows}) == len(rows)
    again = packing.pack(docs.repartition(3), capacity=64, shard=16).collect()
    assert sorted(map(str, placed)) == sorted(map(str, again))
    assert packing.pack(make_docs([])).collect() == []


def test_null_source_has_no_conflict(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c d", None), (3, None, "x")], "doc_id long, text string, source string")
    assert len({r.bin_id for r in packing.pack(docs, 100).collect()}) == 1
