"""Queries against plain folds over the whole tables."""

import hashlib
import math
import re
from collections import defaultdict
from pathlib import Path

import pytest

from scholium.plans import catalog, harness

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def test_chapter_questions_of_all_turns(spark):
    asked = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        asked[str(r.conv_id)].append((r.turn, [w for w in re.split(r"\s+", r.text or "") if w][:2]))
    want = {k: hashlib.md5(" ".join(w for _, q in sorted(v) for w in q).encode()).hexdigest() for k, v in asked.items()}
    assert {r.parent: r.questions_md5 for r in catalog.QUERIES["chapter_questions"](spark, str(SF)).collect()} == want


def test_fixed_effect_with_intervals_of_no_width(spark):
    groups, none = defaultdict(list), 0
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 3").collect():
        es = float(r.l_extendedprice) / 10000
        se = ((es + float(r.l_discount) + float(r.l_tax)) - (es - float(r.l_discount))) / (2 * harness.Z95)
        none += se <= 0
        groups[r.l_returnflag, r.l_linestatus].append((es, 1 / max(se, 1e-6) ** 2))
    assert none
    for r in catalog.QUERIES["meta_fixed_effect"](spark, str(SF)).collect():
        rows = groups.pop((r.l_returnflag, r.l_linestatus))
        sw = math.fsum(w for _, w in rows)
        mu = math.fsum(w * e for e, w in rows) / sw
        number = lambda x: float(x) if x == "0" else float(x.partition("e")[0]) * 10.0 ** (int(x.partition("e")[2]) - 4)
        assert r.k == len(rows) and number(r.pooled_effect) == pytest.approx(mu, rel=1e-4)
        assert number(r.q) == pytest.approx(math.fsum(w * (e - mu) ** 2 for e, w in rows), rel=1e-4)
    assert not groups
