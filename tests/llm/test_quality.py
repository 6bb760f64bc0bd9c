import re
from collections import Counter

from scholium.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in words),
    }
    m["base_failed"] = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    m["kept"] = not m["base_failed"] and all(lo * m[b] <= m[a] <= hi * m[b] for _, a, b, lo, hi in quality.RULES)
    return m


def test_against_brute_force(make_docs, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    rows += [(200, "a b c d e f g h " * 3), (201, "the of and to " * 30), (202, "one\ntwo\none\n\n \none"), (203, "x " * 12), (204, "the cat of a man is in the house and it was to be that for on with"), (205, "# * the " * 40)]
    found = {(r.doc_id, r.n_words): r.asDict() for r in quality.quality_rules(make_docs(rows)).collect()}
    for i, t in rows:
        expected = brute(t) | {"doc_id": i}
        assert found[i, expected["n_words"]] == expected


def test_nulls_empty_and_plan(make_docs):
    rows = quality.quality_rules(make_docs([(1, None), (1, None), (None, "")])).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in rows] == [(0, True, False)] * 3
    assert quality.quality_rules(make_docs([])).collect() == []
    plan = quality.quality_rules(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_keep_good(make_docs):
    good = "the house of the man and the dog is in a field that was for them with a tree on it " * 1
    docs = make_docs([(1, good), (2, "junk### " * 40), (3, None)])
    kept = quality.keep_good(docs)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs.columns
