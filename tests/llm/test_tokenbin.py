from pathlib import Path

import numpy as np
import pytest

from scholium.llm import tokenbin
from scholium.llm.queries import BPE_END, BPE_PATTERN, TOKENIZERS

RANKS = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="tokenizer files are not here")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = tokenbin.feistel(np.arange(n), n, key=9)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert (out != tokenbin.feistel(np.arange(n), n, key=10)).any() and abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.15


def test_round_trip_through_shards(spark, make_docs, corpus, tmp_path):
    ranks, length, shard = RANKS.read_bytes(), 32, 16
    found = tokenbin.sequences(make_docs(corpus), ranks, BPE_PATTERN, BPE_END, length)
    rows = found.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    tokenbin.write_shards(found, str(tmp_path / "out"), length, shard)
    by_slot = {}
    for folder in (tmp_path / "out").glob("shard=*"):
        files = list(folder.glob("part-*"))
        assert len(files) == 1
        data = files[0].read_bytes()
        assert len(data) % tokenbin.stride(length) == 0
        for k, ids in enumerate(tokenbin.read_shard(data, length)):
            by_slot[int(folder.name[6:]) * shard + k] = ids.tolist()
        assert next(tokenbin.read_shard(data, length, start=1), None) is None or len(data) > tokenbin.stride(length)
    assert sorted(by_slot) == list(range(len(rows)))
    bpe = tokenbin.byte_bpe(ranks, BPE_PATTERN)
    texts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.seq)):
        texts.setdefault(r.doc_id, []).append(by_slot[r.slot])
    for i, t in corpus:
        if i not in (None, 137):
            ids = sum(texts[i], [])
            assert ids[-1] == BPE_END and bpe.decode(ids[:-1]) == (t or "")
    again = tokenbin.sequences(make_docs(corpus).repartition(5), ranks, BPE_PATTERN, BPE_END, length).collect()
    assert {(r.doc_id, r.seq, bytes(r.ids)): None for r in again}.keys() == {(r.doc_id, r.seq, bytes(r.ids)): None for r in rows}.keys()
    assert {r.slot: r.doc_id for r in again} == {r.slot: r.doc_id for r in rows}
    assert tokenbin.sequences(make_docs([]), ranks, BPE_PATTERN, BPE_END).collect() == []


def test_shards_against_brute_force(spark, make_docs, corpus, tmp_path):
    """Every record of every file, in its place, of null and repeated ids too."""
    from pyspark.sql import functions as F

    ranks, length, shard = RANKS.read_bytes(), 16, 8
    rows = [*corpus, (None, "one text without an id"), (None, None), (3, "a repeated id"), (3, "a repeated id")]
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    bpe = tokenbin.byte_bpe(ranks, BPE_PATTERN)
    wanted = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1] or "")):
        ids = [*bpe.encode_ordinary(t or ""), BPE_END]
        wanted += [(i, k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
    slots = tokenbin.feistel(np.arange(len(wanted)), len(wanted), 77).tolist()
    path = str(tmp_path / "out")
    tokenbin.write_shards(tokenbin.sequences(make_docs(rows), ranks, BPE_PATTERN, BPE_END, length, key=77), path, length, shard, waves=3)
    files = {int(f.name[6:]): next(f.glob("part-*")).read_bytes() for f in (tmp_path / "out").glob("shard=*")}
    for (i, seq, ids), s in zip(wanted, slots):
        data, at = files[s // shard], s % shard * tokenbin.stride(length)
        head = [int.from_bytes(data[at + a : at + b]) for a, b in ((0, 8), (8, 16), (16, 20), (20, 24))]
        assert head == [s, i or 0, seq, len(ids) + (tokenbin.NO_DOC if i is None else 0)]
        assert next(tokenbin.read_shard(data, length, s % shard)).tolist() == ids
    back = sorted((r.slot, r.shard, r.byte_offset, r.doc_id, r.seq, r.n_tokens, bytes(r.record)) for r in tokenbin.read_shards(spark, path, length, shard).collect())
    assert [r[:6] for r in back] == [(s, s // shard, s % shard * tokenbin.stride(length), i, seq, len(ids)) for s, (i, seq, ids) in sorted(zip(slots, wanted), key=lambda x: x[0])]
    assert all(files[r[1]][r[2] : r[2] + tokenbin.stride(length)] == r[6] for r in back)


def test_no_rows_write_no_shard(make_docs, tmp_path):
    tokenbin.write_shards(tokenbin.sequences(make_docs([]), RANKS.read_bytes(), BPE_PATTERN, BPE_END), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
