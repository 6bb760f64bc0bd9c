import corpus_pipeline
from scholium.llm.queries import QUERIES, SQL


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(8)
    stops = ["the", "of", "and", "to", "in"]
    words = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.4 else "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    item, passage = words(30), words(40)
    base = words(120)
    docs = [(i, words(60)) for i in range(12)]
    docs += [(20, base), (21, base), (22, base.upper()), (30, words(40) + " " + item + " " + words(30)), (40, words(50) + "\n" + passage + "\n" + words(20)), (41, words(50) + "\n" + passage + "\n" + words(20)), (50, "junk### " * 50), (51, "short"), (52, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in rows.collect()})
    good, single, cut, clean = seen
    assert set(good) == set(range(12)) | {20, 21, 22, 30, 40, 41} - {22} | ({22} & set(good))
    assert set(single) == set(good) - {21, 22} and set(cut) == set(single)
    assert passage in cut[40] and passage[10:-10] not in cut[41] and cut[0] == dict(docs)[0]
    assert set(clean) == set(cut) - {30}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(clean)


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]


def brute_pipeline(docs, benchmark):
    """The pieces that run() packs, by plain Python over (doc_id, text) and benchmark texts: (doc_id, piece, size)."""
    import hashlib
    import re

    from scholium.llm import quality
    from tests.llm.test_quality import brute as measured

    kept = [(i, t) for i, t in docs if measured(t)["kept"]]
    # Near duplicates: five-word Jaccard of 0.8, the least id of each group; rows of one id count once.
    words = lambda t: (t or "").lower().split()
    shingles = lambda t: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))}
    sets = {}
    for i, t in kept:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    seen, single = set(), []
    for i, t in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)):
        if i is None or find(i) == i and i not in seen:
            seen.add(i)
            single.append((i, t))
    # Repeated passages of 50 bytes.
    key = lambda i: -1 if i is None else i
    first = {}
    for i, t in single:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], key(i)), key(i))
    cut = []
    for i, t in single:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        rest = bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore") if any(gone) else t
        if not any(gone) or rest.split():
            cut.append((i, rest))
    # Benchmark texts, as plain words without punctuation.
    bare = lambda t: [w for w in (x.strip(".,;:!?").lower() for x in t.split()) if w]
    windows = lambda t: {tuple(bare(t)[k : k + 5]) for k in range(len(bare(t)) - 4)}
    clean = [(i, t) for i, t in cut if not any(len(windows(x) & windows(t)) >= 0.8 * len(windows(x)) for x in benchmark)]
    pieces = []
    for i, t in clean:
        total = len(t.split()) + 1
        pieces += [(i, k, min(1024, total - 1024 * k)) for k in range(-(-total // 1024))]
    del hashlib, re, quality
    return pieces


def test_run_against_brute_force(spark, tmp_path):
    """All five stages: null ids and sources, repeated rows, copies, passages, benchmark texts, long texts, extra columns."""
    import random

    rng = random.Random(21)
    stops = ["the", "of", "and", "to", "in", "that"]
    words = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.4 else "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    benchmark = [words(30) for _ in range(4)]
    passages = [words(30) for _ in range(3)]
    bases = [words(90) for _ in range(4)]
    docs = [(i, words(rng.randrange(15, 120))) for i in range(30)]
    docs += [(100 + k, b) for k, b in enumerate(bases)] + [(200 + k, b) for k, b in enumerate(bases)] + [(300 + k, " ".join([*b.split()[:70], "changed", *b.split()[71:]])) for k, b in enumerate(bases)]
    docs += [(400 + k, f"{words(40)} {passages[k % 3]} {words(40)}") for k in range(9)] + [(500 + k, f"{words(30)} {benchmark[k % 4]} {words(30)}") for k in range(6)]
    docs += [(None, words(60)), (None, words(60)), (None, None), (600, ""), (601, "junk### " * 50), (602, words(2500)), (5, docs[5][1]), (603, "é " + words(40) + " ü")]
    sources = [None, "a", "a", "a", "b"]
    rng.shuffle(docs)
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", sources[k % 5], len(t or ""), "bin", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, h string, row long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(benchmark)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    placed = corpus_pipeline.run(spark, sf).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert order([(r.doc_id, r.piece, r["size"]) for r in placed]) == order(brute_pipeline(docs, benchmark))
    bins = {}
    for r in placed:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r["size"]) for r in rows)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 1024


def test_run_over_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_near_duplicates_by_fingerprint(spark):
    """Texts of one repeated line with unlike ends have fingerprints within two bits and a Jaccard similarity far below 0.8; c is linked to b by Jaccard
    alone, and through b to a."""
    from scholium.llm.simhash import fingerprint

    line = "one two three four five six seven eight nine ten eleven "
    end = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, other = line * 60 + end("a", 20), line * 60 + end("b", 20), end("x", 60)
    c = line + end("b", 20)
    assert (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() <= 2 < (fingerprint(b.encode()) ^ fingerprint(c.encode())).bit_count()
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (4, other, "en", "s", 1), (None, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["1", "4", "None"]
