import random
import zlib

import numpy as np

from scholium.llm import classifier


def labelled(spark, make_docs, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "house", "of", "river", "and", "walks", "bright"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(20, 80))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" if i % 2 else w + "###" for w in words])))
        labels.append((i, int(good), 0))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_held_out_accuracy(spark, make_docs):
    docs, labels, truth = labelled(spark, make_docs)
    rows = classifier.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_are_never_read(spark, make_docs):
    docs, labels, _ = labelled(spark, make_docs, 150)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in classifier.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, make_docs):
    docs, labels, _ = labelled(spark, make_docs, 60)
    odd = docs.unionByName(make_docs([(900, None), (901, ""), (902, "w " * 90_000), (903, "a"), (903, "a"), (None, "b")]))
    rows = classifier.quality_scores(odd, labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], labels.schema))).collect()
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows)
    assert classifier.quality_scores(make_docs([]), labels).collect() == []
    assert {r.score for r in classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_temperature_calibrates():
    rng = np.random.RandomState(0)
    x = rng.randn(3000, 4)
    y = (rng.rand(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    network = classifier.Network(4)
    network.fit(x, y)
    p = network.probability(x)
    assert 0.25 <= network.temperature <= 8 and abs(p.mean() - y.mean()) < 0.03
    top = p > 0.8
    assert abs(p[top].mean() - y[top].mean()) < 0.05


def test_vectors_and_pooling_against_brute_force(make_docs, corpus):
    texts = [t for _, t in corpus]
    index = classifier.index_vectors().astype(float)
    buckets = classifier.Buckets()
    sums = np.zeros_like(index)
    for t in texts:
        pairs = [buckets.of(np.array([w], dtype=object))[0] for w in (t or "").split()]
        for a, b in zip(pairs, pairs[1:]):
            for x in a:
                for y in b:
                    sums[x] += index[y]
                    sums[y] += index[x]
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    found = classifier.word_vectors(make_docs(corpus))
    assert np.allclose(found, unit, atol=1e-6)
    pooled = classifier.Pooler(found)(texts)
    for t, row in zip(texts, pooled):
        words = (t or "").split()
        rows = [np.hstack([unit[a], unit[b], index[b]]) for a, b in (buckets.of(np.array([w], dtype=object))[0] for w in words)]
        mean = np.mean(rows, axis=0) if rows else np.zeros(3 * classifier.DIM)
        lines = [x for x in (t or "").split("\n") if x.strip()]
        extra = [np.log1p(len(words)) / 10, len(set(words)) / max(len(words), 1), 1 - len(set(lines)) / len(lines) if lines else 0.0, float(bool(words))]
        assert np.allclose(row, np.concatenate([mean, extra]), atol=1e-5)


def test_repeated_ids_and_labels_stay_bounded(spark, make_docs):
    docs, labels, _ = labelled(spark, make_docs, 60)
    twice = classifier.fit(docs.unionAll(docs), labels.unionAll(labels))[1]
    once = classifier.fit(docs, labels)[1]
    assert np.allclose(twice.params[0], once.params[0])
