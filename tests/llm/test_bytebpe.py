import hashlib
import random
from pathlib import Path

import pytest

from scholium.llm import bytebpe, queries
from scholium.llm.queries import BPE_PATTERN, TOKENIZERS
from scholium.llm.tokenbin import byte_bpe

RANKS = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="tokenizer files are not here")
KINDS = ["aé 日 \n\t'12.,", "'stremvdl ", "a", " ", "ab", "  \n", "🎉é ", "abcdefghijklmnopqrstuvwxyz", "'re 'll \n x1", "x 　\u001c\u0085 "]


@pytest.fixture(scope="module")
def both():
    return bytebpe.Bpe(dict(bytebpe.bpe(RANKS.read_bytes(), BPE_PATTERN).ranks), BPE_PATTERN), byte_bpe(RANKS.read_bytes(), BPE_PATTERN)


def mixed(rng, n):
    text = ""
    while len(text) < n:
        kind = rng.choice(KINDS)
        text += "".join(rng.choice(kind) for _ in range(rng.randrange(1, 30)))
    return text[:n]


def test_every_token_is_its_own_encoding(both):
    own, _ = both
    assert all(own.merged(token) == [i] for token, i in own.ranks.items())


@pytest.mark.parametrize("leaf", [1, 2, 3, 17])
def test_seams_at_every_place(both, monkeypatch, leaf):
    monkeypatch.setattr(bytebpe, "LEAF", leaf)
    own, library = both
    rng = random.Random(leaf)
    for _ in range(400):
        text = mixed(rng, rng.randrange(0, 120))
        ids = own.encoded(text)
        assert ids == library.encode_ordinary(text), text
        assert own.decoded(ids) == text.encode()


@pytest.mark.parametrize("atom", [1, 2, 5])
def test_joins_of_halves(both, monkeypatch, atom):
    monkeypatch.setattr(bytebpe, "ATOM", atom)
    monkeypatch.setattr(bytebpe, "WIDE", 8)
    own, library = both
    rng = random.Random(atom)
    for _ in range(400):
        letters = rng.choice(["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "日本語é"])
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 90)))
        assert list(own.piece(word.encode())) == library.encode_ordinary(word), word


def test_long_runs_without_a_border(both):
    own, library = both
    rng = random.Random(9)
    for text in ("a" * 20_001, " " * 9_001, "ab" * 7_000, "日本語" * 3_000, "\n" * 4_000 + "x", "'" * 2_000, "".join(rng.choice("abcdefgh") for _ in range(12_000)), "ha" * 777 + "a" * 5_000, "word " * 6_000):
        assert own.encoded(text) == library.encode_ordinary(text)


def test_operator(spark, make_docs, corpus):
    ranks = RANKS.read_bytes()
    library = byte_bpe(ranks, BPE_PATTERN)
    rows = [*corpus, (700, "<|endoftext|> is ordinary"), (701, mixed(random.Random(2), 5_000))]
    docs = make_docs(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = bytebpe.encode(docs, ranks, BPE_PATTERN).withColumn("decoded", bytebpe.F.lit(1))
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = bytebpe.decode(found, ranks, BPE_PATTERN).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=key)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=key) == sorted(((i, (t or "").encode()) for i, t in rows), key=key)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bytebpe.encode(docs, ranks, BPE_PATTERN, back=True).collect()), key=key) == sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key)
    assert bytebpe.decode(bytebpe.encode(make_docs([]), ranks, BPE_PATTERN), ranks, BPE_PATTERN).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bytebpe.decode(nulls, ranks, BPE_PATTERN).collect()] == [b"", b""]


def test_query_against_the_library(spark, tmp_path, make_docs, corpus):
    make_docs(corpus).write.parquet(f"{tmp_path}/documents.parquet")
    library = byte_bpe(RANKS.read_bytes(), BPE_PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in corpus:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    key = lambda r: (r[0] is None, r)
    found = queries.op11_byte_bpe(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
