from pathlib import Path

import pytest
from tokenizers import Tokenizer, models, normalizers

from scholium.llm import tokencount
from scholium.llm.queries import TOKENIZERS

MODEL = Path(TOKENIZERS, "piece_bpe_32k.model")


def library(pieces):
    made = Tokenizer(models.Unigram(pieces, 0, True))
    made.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return made


BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
SMALL = [("<unk>", 0.0), *BYTES, ("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -4.0), ("ba", -4.0), ("aba", -6.0), ("bab", -5.5), ("▁▁", -3.0), ("c", -9.0), ("abc", -9.0)]


def test_ties_as_the_library_breaks_them(spark):
    counter, whole = tokencount.UnigramCounter(SMALL), library(SMALL)
    texts = ["", "a", "ab", "abab", "aba ab  bab", "a\nb", "zzz", "ébc a", "  ", "abcabc x", "日本ab", "bababababa abababa"]
    for t in texts:
        assert counter.count(t)[0] == len(whole.encode(t).ids), t


@pytest.mark.skipif(not MODEL.exists(), reason="tokenizer files are not here")
def test_corpus_against_the_library(make_docs, corpus):
    pieces = tokencount.vocabulary(MODEL.read_bytes())
    whole = library(pieces)
    rows = [(i, t) for i, t in corpus if i is not None] + [(500, "tab\tand\r\nline  two   blanks "), (501, "émoji 🎉🎉 and ﬁ"), (502, "x" * 500)]
    found = {r.doc_id: r.n_tokens for r in tokencount.token_counts(make_docs(rows), pieces).collect()}
    for i, t in rows:
        assert found[i] == len(whole.encode(t or "").ids), i
    assert tokencount.token_counts(make_docs([(None, None), (None, None)]), pieces).count() == 2
    assert tokencount.token_counts(make_docs([]), pieces).collect() == []


def test_runs_of_unknown_characters_without_byte_pieces():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0)]
    counter = tokencount.UnigramCounter(pieces)
    assert counter.count("xyz a")[0] == 4  # mark, one run, mark, a
