import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string, n_bytes int, label int, h long, spans string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs((doc_id, text), ...) with extra columns whose names the operators use themselves."""

    def docs(rows):
        full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "fp", "kept", 1, 0, 5, "spans") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def corpus():
    """Small texts with near copies, shared passages, odd characters, nulls, empty, long and repeated rows."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "zeta", "eta", "theta", "iota", "kappa", "the", "of", "and", "Für", "日本", "x"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage = text(30)
    rows = [(i, text(rng.randrange(5, 80))) for i in range(40)]
    base = text(60)
    rows += [(100 + i, base.replace("alpha", "ALPHA", i)) for i in range(3)]
    rows += [(110 + i, base + f" tail{i}") for i in range(4)]
    rows += [(120 + i, text(10) + "\n" + passage + "\n" + text(8)) for i in range(6)]
    rows += [(130, ""), (131, None), (132, "  \n\t "), (133, "one two"), (134, "a" * 200), (135, ("ab" * 300)), (136, "long " * 3000), (137, passage), (137, passage), (138, passage[3:]), (None, passage), (None, None)]
    return rows
