import numpy as np
import xxhash
from pyspark.sql import functions as F

from scholium.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows of (id, fingerprint) -> the component of each row."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for _, f in rows]


def test_components_against_brute_force(make_docs, corpus):
    rows = [(i, brute_fingerprint(t)) for i, t in corpus]
    expected = sorted(zip([(i is not None, i or 0) for i, _ in rows], [f"{f:016x}" for _, f in rows], map(str, brute_components(rows))))
    found = simhash.simhash_components(make_docs(corpus), leaf=3).select("doc_id", simhash.hex16(F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.fp, str(r.component_id)) for r in found) == expected


def test_empty_table(make_docs):
    assert simhash.simhash_components(make_docs([])).collect() == []


def test_trie_links_find_every_close_pair(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(12)]
    prints = np.unique(np.array(near + [0, 1, 3, 7, 2**64 - 1, 2**64 - 4], dtype=np.uint64))
    ids = {int(f): k for k, f in enumerate(prints)}
    expected = brute_components([(k, f) for f, k in ids.items()])
    classes = spark.createDataFrame([(int(np.array([f], dtype=np.uint64).view(np.int64)[0]), k) for f, k in ids.items()], "fp long, rep long")
    for leaf in (2, 1000):
        found = {r.node: r.component for r in simhash.connected_components(simhash.links(classes, leaf)).collect()}
        assert [found.get(k, k) for _, k in ids.items()] == expected


def test_a_long_path_is_one_component(spark):
    n = 700
    edges = spark.range(n - 1).selectExpr("(id * 389) % 700 as a", "((id + 1) * 389) % 700 as b")
    found = simhash.connected_components(edges.unionAll(spark.createDataFrame([(5, 5), (None, 1), (800, 801), (801, 800)], "a long, b long"))).collect()
    assert sorted((r.node, r.component) for r in found) == [*((k, 0) for k in range(n)), (800, 800), (801, 800)]


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Chains over a fingerprint that only rows without an id have, and ones that no id reaches."""
    rows = [(1, 0b0), (None, 0b11), (3, 0b1111), (None, 0b111111), (7, 1 << 40), (None, 1 << 40 | 1), (None, 1 << 41), (None, 0b111 << 50), (None, 0b101 << 50), (9, -1), (5, -4)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    found = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    unsigned = [(i, f % (1 << 64)) for i, f in rows]
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in found) == sorted((str(i), f, str(c)) for (i, f), c in zip(rows, brute_components(unsigned)))


def test_text_without_an_id_one_bit_from_another(spark, make_docs):
    """Two texts whose fingerprints are near, the first of them without an id."""
    base = " ".join(f"w{k}" for k in range(2000))
    own = simhash.fingerprint(base.encode())
    near = next(t for t in (base + f" tail{k}" for k in range(500)) if 1 <= (simhash.fingerprint(t.encode()) ^ own).bit_count() <= 2)
    found = simhash.simhash_components(make_docs([(None, base), (7, near)])).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(None, 7), (7, 7)}
