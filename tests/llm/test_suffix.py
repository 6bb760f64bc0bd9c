import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import suffix


def brute(rows):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def run(docs, group=suffix.GROUP):
    found = suffix.remove_earlier(docs, group=group).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.s) for r in found.collect())


@pytest.mark.parametrize("group", [suffix.GROUP, 3])
def test_against_brute_force(make_docs, corpus, group):
    assert run(make_docs(corpus), group) == brute(corpus)


@pytest.mark.parametrize("group", [suffix.GROUP, 8])
def test_one_very_common_passage(make_docs, group):
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edge = words(140), words(30)
    rows = [(i, words(rng.randrange(60)) + (edge if i % 3 else "") + passage + (words(rng.randrange(60)) if i % 4 else edge)) for i in range(120)]
    rows += [(200 + i, words(20) + passage[i : i + 55] + words(20)) for i in range(0, 80, 3)] + [(300, (passage[:70] + "\0") * 40), (301, "é" + passage + "\0\0")]
    rng.shuffle(rows)
    assert run(make_docs(rows), group) == brute(rows)


def test_factors_against_brute_force():
    rng = random.Random(9)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    segments = [bytes(base[k : k + rng.randrange(50, 77)]) for k in (rng.randrange(14) for _ in range(60))] + [b"a" * 76, b"a" * 50, b"\0" * 60, b"a" * 60 + b"\0"]
    segments = [x for x in segments if len(x) >= 50]
    docs = [rng.randrange(12) for _ in segments]
    expected = {}
    for k, s in enumerate(segments):
        for i in range(len(s) - 49):
            best = 0
            for t, d in zip(segments, docs):
                if d < docs[k]:
                    best = max([best, *(next((m for m in range(min(len(s) - i, len(t) - j)) if s[i + m] != t[j + m]), min(len(s) - i, len(t) - j)) for j in range(len(t)))])
            if best >= 50:
                expected[k, i] = best
    owner, start, length = suffix.longest_previous_factors(segments, np.array(docs))
    assert {(k, i): n for k, i, n in zip(owner.tolist(), start.tolist(), length.tolist())} == expected


def test_repeated_ids_with_unlike_texts(make_docs):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    rows = [(1, a), (2, b + a[20:120]), (2, a[:90]), (2, a[:90]), (3, a), (3, b)]
    assert run(make_docs(rows)) == brute(rows)


def test_text_longer_than_a_piece(make_docs):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(suffix.PIECE + 500))
    rows = [(1, text), (2, "x" + text[100:] + "y"), (3, text[suffix.PIECE - 60 : suffix.PIECE + 60])]
    assert run(make_docs(rows)) == brute(rows)


def test_empty(make_docs):
    assert run(make_docs([])) == []
