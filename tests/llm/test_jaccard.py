import random

import corpus_pipeline
from scholium.llm import jaccard


def test_stage_finds_near_copies(spark, make_docs, tmp_path):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, near = [], []
    for k in range(20):
        base = words(120)
        other = [*base[:60], "changed", *base[61:]]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(other)), (10 * k + 2, " ".join(base).upper()), (10 * k + 3, " ".join(words(120)))]
        near += [10 * k + 1, 10 * k + 2]
    chain = words(200)
    rows += [(1000 + i, " ".join(["x"] * i + chain[3 * i :])) for i in range(4)]
    rows += [(2000, None), (2001, ""), (2002, "two words"), (None, "two words"), (2003, "three other words"), (2004, "same id " * 9), (2004, "same id " * 9)]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    sets = {i: jaccard.shingles((t or "").encode()) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if i < j and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in root if root[i] == i)
    assert kept.count(None) == 1 and not set(near) & set(kept)


def test_large_bands_are_split_without_losing_a_link(spark, make_docs):
    """Groups of near copies whose members are not all similar to each other, with blocks of a few classes."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for g in range(3):
        base = words(150)
        for k in range(60):
            own = list(base)
            for at in rng.sample(range(150), rng.randrange(1, 5)):
                own[at] = f"x{g}-{k}-{at}"
            rows.append((1000 * g + k, " ".join(own)))
    rows += [(5000 + k, " ".join(words(80))) for k in range(20)]
    rng.shuffle(rows)
    docs = make_docs(rows)
    sets = {i: set(jaccard.shingles(t.encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and root[i] != root[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    for block in (5, 64, jaccard.BLOCK):
        assert {r.doc_id: r.component_id for r in jaccard.near_components(docs, block).collect()} == root


def test_keep_one_of_an_empty_table(make_docs):
    assert jaccard.keep_one(make_docs([])).collect() == []
