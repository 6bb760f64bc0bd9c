"""Operators against small hand-made cases and plain-Python folds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import chunk, coverage, dedup, gate, markdown, meta, profile, replies, routing, screening, sections, studies
from scholium.plans.review import Run, review_loop, write_sections
from scholium.sources.outline import load_taxonomy, outline_entry, parse_markdown, sections_frame


def fold_chunks(text, most, overlap):
    out, cur, start, pos = [], [], 0, 0
    if not text.strip():
        return out
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        words = sentence.split()
        if words and len(cur) + len(words) > most and cur:
            out.append((" ".join(cur), start, start + len(" ".join(cur))))
            cur = cur[-overlap:] if overlap and len(cur) > overlap else []
            start = pos - len(" ".join(cur)) if cur else pos
        cur = cur + words
        pos += len(sentence) + 1
    return out + [(" ".join(cur), start, start + len(" ".join(cur)))] if cur else out


def test_chunks_against_a_fold(spark):
    rng = random.Random(1)
    texts = ["a b c. d e f. g h i.", "", "  ", "one", "no stop here at all " * 9] + ["".join(rng.choice(["ab", "c", "d.", "e!", " ", "\n", "f? "]) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most, overlap in ((4, 1), (6, 0), (5, 3)):
        found = rows.select("i", chunk.chunk_array(F.col("t"), most, overlap).alias("c")).collect()
        for r in found:
            assert [tuple(c) for c in r.c] == fold_chunks(texts[r.i], most, overlap), (texts[r.i], most, overlap)
    assert fold_chunks("a b c. d e f. g h i.", 4, 1) == [("a b c.", 0, 6), ("c. d e f.", 5, 14), ("f. g h i.", 12, 21)]


def test_exact_titles(spark):
    rows = spark.createDataFrame([(1, "1", " X "), (2, "2", "x"), (3, "3", ""), (4, "4", None)], "pos long, pmid string, title string")
    assert sorted(r.pos for r in dedup.exact_title_dedup(rows).collect()) == [1, 3]
    assert sorted((r.kept_pmid, r.removed_pmid) for r in dedup.exact_title_log(rows).collect()) == [("1", "2"), ("3", "4")]


def test_greedy_against_a_scan(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    gone, log = set(), []
    for a in range(60):
        if a not in gone:
            for x, y in pairs:
                if x == a and y not in gone:
                    gone.add(y), log.append((a, y))
    kept, found = dedup.greedy_dedup(spark.range(60).withColumnRenamed("id", "pos"), spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a long, b long, similarity double"))
    assert {r.pos for r in kept.collect()} == set(range(60)) - gone
    assert sorted((r.kept, r.removed) for r in found.collect()) == sorted(log)


@pytest.mark.parametrize("local", [0, 40, 10_000])
def test_greedy_over_a_long_chain(spark, local):
    n = 300 if local else 24
    nodes = spark.range(n + 5).withColumnRenamed("id", "pos")
    links = spark.range(n - 1).selectExpr("id as a", "id + 1 as b", "0.9D as similarity")
    kept, log = dedup.greedy_dedup(nodes, links, local if local != 40 else 290)
    assert sorted(r.pos for r in kept.collect()) == [*range(0, n, 2), *range(n + (n % 2), n + 5)] if n % 2 == 0 else True
    assert sorted((r.kept, r.removed) for r in log.collect()) == [(k, k + 1) for k in range(0, n - 1, 2)]


def test_similar_pairs_over_several_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T > 0.995, 1))
    found = routing.similar_pairs(rows, 0.995).collect()
    assert len(found) > 100 and sorted((r.a, r.b) for r in found) == sorted(zip(a.tolist(), b.tolist()))
    assert routing.similar_pairs(rows.limit(0), 0.5).collect() == []


def cosine_brute(rows, threshold):
    import numpy as np

    pos, v = [p for p, _ in rows], np.array([x for _, x in rows], dtype=float)
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    a, b = np.nonzero(np.triu(unit @ unit.T > threshold, 1))
    return sorted(tuple(sorted((pos[i], pos[j]))) for i, j in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("threshold, block", [(0.9, 16_384), (0.9, 40), (0.2, 100), (-0.1, 64)])
def test_similar_pairs_of_clusters_copies_and_short_vectors(spark, monkeypatch, threshold, block):
    """A third of the rows in one cluster, exact copies, vectors of no length and of hardly any."""
    import numpy as np

    monkeypatch.setattr(routing, "BLOCK", block)
    rng = np.random.default_rng(7)
    mid = rng.normal(size=(12, 6))
    which = np.where(rng.random(600) < 0.33, 0, rng.integers(12, size=600))
    rows = [(i * 3, (mid[k] + 0.15 * rng.normal(size=6)).tolist()) for i, k in enumerate(which)]
    rows += [(5000 + i, rows[i][1]) for i in range(20)] + [(6000 + i, [0.0] * 6) for i in range(9)] + [(7000 + i, (1e-9 * mid[i]).tolist()) for i in range(3)] + [(7100 + i, (1e-4 * mid[i]).tolist()) for i in range(3)]
    found = routing.similar_pairs(spark.createDataFrame(rows, "pos long, v array<double>").repartition(3), threshold).collect()
    assert sorted((r.a, r.b) for r in found) == cosine_brute(rows, threshold)


def fold_greedy(rows, threshold):
    """The log of the plain scan over (pos, vector), sums in the order of the coordinates."""

    def added(xs):
        total = 0.0
        for x in xs:
            total += x
        return total

    def unit(v):
        norm = added(x * x for x in v) ** 0.5 + 1e-9
        return [x / norm for x in v]

    rows = sorted((p, unit(v)) for p, v in rows if v and None not in v)
    kept, log = [], []
    for pos, v in rows:
        for earlier, w in kept:
            similarity = added(x * y for x, y in zip(v, w))
            if similarity > threshold:
                log.append((earlier, pos, similarity))
                break
        else:
            kept.append((pos, v))
    return sorted(log)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.97, -0.1])
@pytest.mark.parametrize("first, values", [(8_192, 1 << 22), (50, 1 << 22), (150, 600)])
def test_greedy_vectors_against_a_scan(spark, monkeypatch, threshold, first, values):
    """Clusters, copies, cosines at the threshold itself, vectors of no length, and such as have none to be compared by; in one round and in many."""
    import numpy as np

    monkeypatch.setattr(routing, "ROUND", first)
    monkeypatch.setattr(routing, "VALUES", values)
    rng = np.random.default_rng(11)
    mid = rng.normal(size=(9, 6))
    rows = [(int(p), (mid[k] + 0.3 * rng.normal(size=6)).tolist()) for p, k in zip(rng.permutation(400) * 5 - 700, rng.integers(9, size=400))]
    rows += [(3000 + i, rows[i * 7][1]) for i in range(30)] + [(-5000 + i, [0.0] * 6) for i in range(4)] + [(4000 + i, (1e-9 * mid[i]).tolist()) for i in range(4)]
    rows += [(-6000 + i, [float(x) for x in v]) for i, v in enumerate([(3, 4, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (0, 0, 3, 4, 0, 0), (0, 0, 1, 0, 0, 0), (6, 8, 0, 0, 0, 0)])]
    none = [(-7000, None), (-7001, []), (-7002, [1.0, None] + [0.0] * 4), (-7003, [float("nan")] * 6), (-7004, [float("inf")] + [1.0] * 5)]
    kept, log = routing.greedy_vectors(spark.createDataFrame(rows + none, "pos long, v array<double>").repartition(3), threshold)
    wanted = fold_greedy(rows, threshold)
    assert len(wanted) > 40 and sorted(map(tuple, log.collect())) == wanted
    assert sorted(r.pos for r in kept.collect()) == sorted({p for p, _ in rows + none} - {b for _, b, _ in wanted})


def test_greedy_vectors_of_an_empty_table(spark):
    kept, log = routing.greedy_vectors(spark.createDataFrame([(1, None)], "pos long, v array<double>"), 0.5)
    assert log.collect() == [] and [r.pos for r in kept.collect()] == [1]


def test_greedy_vector_dedup_writes_in_proportion_to_its_table(spark, tmp_path):
    """3,000 copies have 4.5 million links; what the query writes grows with the rows."""
    from pathlib import Path

    from scholium.plans import catalog

    spark.range(3_000).selectExpr("id AS vec_id", "array(1.0F, 2.0F, id % 2 / 1e6F) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    written = lambda: sum(p.stat().st_size for p in Path(re.sub("^file:", "", spark.sparkContext._jsc.sc().getCheckpointDir().get())).rglob("part-*"))
    dedup.ensure_checkpoint_dir(spark)
    before = written()
    log = catalog.QUERIES["greedy_vector_dedup"](spark, str(tmp_path)).collect()
    assert written() - before < 3_000 * 1_000
    assert sorted((r.kept, r.removed) for r in log) == [(0, b) for b in range(1, 3_000)]


def test_clustered_vectors_visit_few_groups():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    mid = rng.normal(size=(40, 32))
    v = np.repeat(mid, 50, axis=0) + 0.1 * rng.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = pd.DataFrame({"pos": np.arange(2000), "v": list(v), "length": 1.0})
    pivots = v[rng.choice(2000, 60, replace=False)]
    own, angle, _ = routing._nearest(frame, pivots)
    radius, blocks = np.full(61, -np.inf), np.zeros(61, dtype=np.int64)
    for g in np.unique(own):
        radius[g], blocks[g] = angle[own == g].max(), 1
    assert len(routing._dealt(frame, pivots, radius, blocks, float(np.arccos(0.95)))) < 6 * len(frame)  # of 61


def test_keep_first_and_last(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in studies.keep_first(rows, ["k"], [F.col("o")]).collect()} == {("a", "x"), ("b", None)}
    assert {(r.k, r.v) for r in studies.keep_last(rows, ["k"], [F.col("o")]).collect()} == {("a", "y"), ("b", None)}


def test_keyword_screening(spark):
    rows = spark.createDataFrame([(1, "1", "k1 k2", ""), (2, "2", "k1", ""), (3, "3", "none", ""), (4, "4", "bad", ""), (5, "5", "bad good", "")], "pos long, pmid string, title string, abstract string")
    found = {r.pos: (r.decision, round(r.confidence, 4)) for r in screening.screen_by_keywords(rows, [f"k{i}" for i in range(1, 7)], ["good"], ["bad"]).collect()}
    assert found == {1: ("include", 0.8333), 2: ("ambiguous", 0.1667), 3: ("exclude", 1.0), 4: ("exclude", 0.8), 5: ("include", 0.5)}


def test_phase_flags(spark):
    def flags(phases, t, p):
        row = spark.range(1).select(
            F.lit("id").alias("paper_id"), F.array(*map(F.lit, phases)).alias("phase_regimes"), F.array(F.lit("CO2_R744")).alias("working_fluids"), F.array().cast("array<string>").alias("keywords"),
            F.struct(F.lit(t).cast("double").alias("min"), F.lit(t).cast("double").alias("max")).alias("temperature"), F.struct(F.lit(p).cast("double").alias("min"), F.lit(p).cast("double").alias("max")).alias("pressure"),
        )
        return [f.severity for f in row.select(profile.phase_flags().alias("f")).first().f]

    assert flags(["solid"], 300, None) == ["high"] and flags(["solid"], 218.5, None) == []
    assert flags(["near_triple_point"], 240, 2) == ["high", "medium"]
    assert flags(["supercritical"], 300, 70) == ["high", "high"]
    assert flags(["transcritical"], None, None) == ["high"] and flags(["transcritical"], 310, None) == []


def guard(spark, profile_columns, section, text):
    blank = F.array().cast("array<string>")
    names = {"allowed_domains": blank, "required_phase_regimes": blank, "required_any_terms": blank, "forbidden_terms": blank, "max_foreign_domain_ratio": F.lit(1.0), "routing_strictness": F.lit("soft")}
    prof = {"paper_id": F.lit("p"), "domains": blank, "phase_regimes": blank, "keywords": blank, "working_fluids": blank, "system_topologies": blank}
    arr = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    names |= {k: arr(v) for k, v in section.items()}
    prof |= {k: arr(v) for k, v in profile_columns.items()}
    g = spark.range(1).select(routing.guardrails(names, prof, F.lower(F.lit(text)), T.normalised(F.lit(text)), F.lit("c")).alias("g")).first().g
    return round(g.score, 6), g.eligible, len(g.flags)


def test_guardrails(spark):
    prof = {"domains": ["a", "b"], "phase_regimes": ["solid"]}
    assert guard(spark, {"domains": ["x"]}, {"allowed_domains": ["a"]}, "t") == (0.25, True, 1)
    assert guard(spark, prof, {"allowed_domains": ["a"], "max_foreign_domain_ratio": 0.3}, "t") == (0.2, True, 1)
    assert guard(spark, prof, {"required_phase_regimes": ["liquid"]}, "t") == (0.35, True, 1)
    assert guard(spark, prof, {"required_any_terms": ["heat pump"]}, "t") == (0.2, True, 1)
    assert guard(spark, prof, {"forbidden_terms": ["bad"]}, "a bad text") == (0.1, False, 1)
    assert guard(spark, {"domains": ["x"]}, {"allowed_domains": ["a"], "forbidden_terms": ["bad"], "routing_strictness": "hard"}, "bad") == (0.25, False, 1)
    assert guard(spark, prof, {"allowed_domains": ["A"]}, "t") == (1.0, True, 0)


def test_scan_stops_at_the_first_below_its_threshold(spark):
    outline = spark.createDataFrame([(0, "p", "a", [1.0, 0.0, 0.0], 0.0, "soft"), (1, "p", "b", [0.0, 1.0, 0.0], 0.6, "soft"), (2, "p", "c", [0.0, 0.0, 1.0], 0.0, "soft")], "section_pos int, parent string, folder string, v array<double>, min_similarity double, routing_strictness string")
    rows = spark.createDataFrame([("c1", "s", "s", "", [0.9, 0.5, 0.4])], "chunk_id string, study_pmid string, paper_id string, text string, v array<double>")
    found = routing.route(rows, outline, rows, 0.25, 2, guarded=False).collect()
    assert [(r.folder, r.assigned) for r in found] == [("a", True)]


def test_gate_reasons(spark):
    outline = sections_frame(spark, [outline_entry({"parent": "p", "folder": "f", "prompt": "x", "allowed_domains": ["a"], "forbidden_terms": ["bad"], "required_any_terms": ["good"], "max_foreign_domain_ratio": 0.5, "max_foreign_evidence_share": 0.9})])
    chunks = spark.createDataFrame([(f"c{i}", f"s{i}", f"s{i}", t) for i, t in enumerate(["good", "good", "bad good", "plain", "good", "good", "good", "good x"])], "chunk_id string, study_pmid string, paper_id string, text string")
    domains = {0: ["a"], 1: ["z"], 2: ["a"], 3: ["a"], 4: ["a", "b", "c"], 5: ["a"], 6: ["a"], 7: ["a", "b"]}
    profiles = spark.createDataFrame([(f"s{i}", d, ["solid"], [], [], []) for i, d in domains.items()], "paper_id string, domains array<string>, phase_regimes array<string>, keywords array<string>, working_fluids array<string>, system_topologies array<string>")
    tags = spark.createDataFrame([(f"c{i}", "p", "f", 0.9 - i / 100, 0.1 if i == 5 else 1.0, 0) for i in range(8)] + [("gone", "p", "f", 0.5, 1.0, 0)], "chunk_id string, parent string, folder string, similarity double, eligibility_score double, section_pos int")
    judged = gate.judge_tags(tags, chunks, outline, profiles, spark.createDataFrame([("s6",)], "id string"))
    assert {r.chunk_id: r.reason for r in judged.collect()} == {"c0": None, "c1": "allowed_domains", "c2": "forbidden_terms", "c3": "required_any_terms", "c4": "foreign_domain_ratio", "c5": "low_eligibility", "c6": "high_flags", "c7": None, "gone": "missing_chunk"}
    stats = gate.gate_stats(judged, outline).first()
    assert (stats.after_section_filter, stats.accepted, stats.foreign_evidence_share, stats.rejected_missing_chunk) == (9, 2, 0.5, 1)
    assert [r.chunk_id for r in gate.ranked_evidence(judged, 1).collect()] == ["c0"]


def test_fixed_effect(spark):
    rows = spark.createDataFrame([(0.5, 0.3, 0.7), (0.3, 0.1, 0.5), (0.8, 0.5, 1.1), (None, 0.0, 1.0)], "effect_size double, ci_lower double, ci_upper double")
    r = meta.fixed_effect(rows, []).first()
    assert [round(x, 6) for x in (r.pooled_effect, r.pooled_se, r.ci_lower, r.ci_upper, r.q, r.i_squared, r.tau_squared)] == [0.472727, 0.065267, 0.344807, 0.600648, 7.508306, 73.362833, 0.037113] and r.k == 3
    assert meta.synthesis_kind(rows) == "meta_analysis" and meta.synthesis_kind(rows.limit(2)) == "thematic"


def test_section_scores(spark):
    flags = spark.createDataFrame([("x", "high", "m", ["aaaaaaaa1"])], "flag_type string, severity string, message string, related_ids array<string>")
    rows = spark.createDataFrame([("1", "foul bad [chunk:aaaaaaaa1] /C1 and /C2", ["foul", "bad", "none"])], "section_id string, content string, forbidden_terms array<string>")
    r = sections.section_quality(rows, flags).first()
    assert (r.cross_topic_contamination_score, r.physics_consistency_score, r.table_integrity_score) == (0.333, 0.75, 0.6)
    assert sections.quality_summary(sections.section_quality(rows.limit(0), flags)).first().avg_grounding_score == 1.0


def test_concepts_and_agenda(spark):
    rows = spark.createDataFrame([(1, "Catálise", "first"), (2, "catalise", "second"), (3, " ", "x")], "pos long, concept string, section string")
    assert [(r.concept, r.section) for r in sections.register_concepts(rows).collect()] == [("Catálise", "first")]
    gaps = spark.createDataFrame([(1, "One", "low"), (2, "two ", "High"), (3, "Two", "high"), (4, "", "high")], "pos long, description string, priority string")
    assert [(r["rank"], r.pos) for r in sections.research_agenda(gaps).collect()] == [(1, 2), (2, 1)]


def test_markdown(spark):
    text = "# Title\npre\n\n## One\nbody\n- a\n- b\n### Sub\nmore **bold** 5%\n## Two\n"
    docs = spark.createDataFrame([("k", text)], "k string, text string")
    parts = markdown.split_sections(docs, "k").orderBy("section_no").collect()
    assert [(p.level, p.heading, p.parent) for p in parts] == [(0, "", ""), (2, "One", "One"), (3, "Sub", "One"), (2, "Two", "Two")]
    assert parts[0].body == "# Title\npre" and parts[1].body == "body\n- a\n- b"
    whole = markdown.reassemble(markdown.split_sections(docs, "k"), "k").first().text
    assert whole.endswith("## Two") and "### Sub\n\nmore **bold** 5%" in whole
    tex = markdown.markdown_to_latex(docs, "k", language="pt").first().latex
    assert "\\title{Title}" in tex and "[brazilian]{babel}" in tex and tex.count("\\begin{itemize}") == tex.count("\\end{itemize}") == 1 and r"\textbf{bold} 5\%" in tex
    table = docs.select(markdown.markdown_table(F.lit("cap"), F.array(F.lit("x"), F.lit("y")), F.array(F.create_map(F.lit("x"), F.lit("1|2")))).alias("t")).first().t
    assert table == "**cap**\n\n| x | y |\n| --- | --- |\n| 1\\|2 | — |"
    assert markdown.fill_template("<< a >> <% if b %>yes<% endif %><% if a %>!<% endif %>", {"a": "x"}) == "x !"


def test_taxonomies(tmp_path):
    parsed = parse_markdown("# Topic: T\n## PICO\n- Population: adults\n## Keywords\n- k1\n* k2\n## Inclusion criteria\n1. in\n## Rules\n- include if x\n- exclude if include y\n- other")
    assert parsed["topic"] == "T" and parsed["pico"] == {"population": "adults"} and parsed["keywords"] == ["k1", "k2"] and parsed["inclusion_criteria"] == ["in"]
    assert parsed["classification_rules"] == {"include_if_any": ["include if x"], "exclude_if_any": ["exclude if include y", "other"]}
    (tmp_path / "o.json").write_text('[{"prompt": "p", "folder": "f", "parent": "B", "max_foreign_domain_ratio": 0, "min_similarity": "x", "routing_strictness": "odd"}, {"prompt": "q", "parent": "A"}]')
    data = load_taxonomy(tmp_path / "o.json")
    assert data["type"] == "outline" and data["topic"] == "A / B"
    assert (data["entries"][0]["max_foreign_domain_ratio"], data["entries"][0]["min_similarity"], data["entries"][0]["routing_strictness"]) == (1.0, 0.0, "soft")
    (tmp_path / "bad.json").write_text("{")
    assert load_taxonomy(tmp_path / "bad.json") == load_taxonomy(tmp_path / "none.json") == {}


def test_calls_at_once(spark):
    def client(prompt, options):
        import threading
        import time

        state = threading.__dict__.setdefault("calls_at_once", {"lock": threading.Lock(), "now": 0, "most": 0, "seen": set()})
        with state["lock"]:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
            first = prompt not in state["seen"]
            state["seen"].add(prompt)
        time.sleep(0.02)
        with state["lock"]:
            state["now"] -= 1
        if prompt.endswith("7") and first:
            raise OSError("once")
        if prompt.endswith("9"):
            raise OSError("always")
        return f"{prompt} of {state['most']}"

    rows = spark.createDataFrame([(f"p{i}",) for i in range(40)], "q string").coalesce(1)
    found = replies.ask(rows, F.col("q"), client, parallel=4).collect()
    assert len(found) == 40 and all((r.error == "always") == r.q.endswith("9") for r in found)
    assert all(r.reply.split(" of ")[0] == r.q for r in found if r.reply)
    peak = max(int(r.reply.split(" of ")[1]) for r in found if r.reply)
    assert 1 < peak <= 4


def test_model_calls_and_review_loop(spark, tmp_path):
    def client(prompt, options):
        if "broken" in prompt:
            raise RuntimeError("no answer")
        return f"draft of {len(prompt)}"

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "broken")], "i int, p string")
    found = {r.i: (r.reply, r.error) for r in replies.ask(rows, F.col("p"), client).collect()}
    assert found == {1: ("draft of 1", None), 2: ("draft of 1", None), 3: (None, "no answer")}
    cached = replies.ask(rows.where("i < 3"), F.col("p"), client).select("prompt_hash", F.lit("kept").alias("reply")).distinct()
    assert {r.reply for r in replies.ask(rows.where("i < 3"), F.col("p"), client, cache=cached).collect()} == {"kept"}

    outline = spark.createDataFrame([(0, "P", "F", "prompt"), (1, "P", "G", "other")], "section_pos int, parent string, folder string, prompt string")
    packs = spark.createDataFrame([("P", "F", "[chunk:x] text", 1)], "parent string, folder string, evidence string, n_evidence int")
    drafts = {r.folder: r.content for r in write_sections(packs, outline, replies.offline).collect()}
    assert drafts["G"].startswith("No evidence") and drafts["F"].startswith("Write the section: prompt")

    start = spark.createDataFrame([("a", "x"), ("b", "xxxx"), ("c", "never")], "key string, content string")
    review = lambda d: d.select("key", F.when(F.col("key") != "c", F.length("content") * 2.0).alias("score"), F.lit("longer").alias("feedback"))
    write = lambda d: d.select("key", F.concat("content", F.lit("xx")).alias("content"))
    assert {r.key: (r.content, r.iterations) for r in review_loop(start, write, review).collect()} == {"a": ("xxxxx", 3), "b": ("xxxx", 1), "c": ("never", 1)}

    calls = []
    run = Run(spark, str(tmp_path / "run"))
    for _ in range(2):
        assert run.stage("s", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1 and run.events().count() == 1


def test_reports(spark, tmp_path):
    outline = spark.createDataFrame([(0, "B", "x"), (1, "A", "y"), (2, "B", "z")], "section_pos int, parent string, folder string")
    assert [(r.parent, r.folder) for r in coverage.chapter_order(outline).collect()] == [("B", "x"), ("B", "z"), ("A", "y")]
    tags = spark.createDataFrame([("c1", "B", "x", 0.9, 1.0), ("c2", "B", "x", 0.8, 1.0), ("c3", "B", "x", 0.95, 0.1)], "chunk_id string, parent string, folder string, similarity double, eligibility_score double")
    chunks = spark.createDataFrame([("c1", "s1", "t1"), ("c2", "s1", "t2"), ("c3", "s2", "t3")], "chunk_id string, study_pmid string, text string")
    people = spark.createDataFrame([("s1", "Doe", 2020)], "pmid string, authors string, year int")
    articles = coverage.section_articles(tags, chunks, people)
    assert [(r.pmid, r.citation, r.n_chunks, r.best_excerpt) for r in articles.collect()] == [("s1", "(Doe, 2020)", 2, "t1")]
    coverage.write_sections(articles, str(tmp_path / "out"))
    assert (tmp_path / "out" / "parent_dir=B" / "folder_dir=x").is_dir()
    covered = coverage.coverage(outline, tags)
    assert {r.folder: r.n_chunks for r in covered.collect()} == {"x": 3, "y": 0, "z": 0}
    assert coverage.coverage_summary(covered, chunks).first().sections_without_evidence == 2


@pytest.mark.parametrize("guarded", [True, False])
def test_a_long_outline_is_routed_as_a_short_one(spark, monkeypatch, guarded):
    import numpy as np

    rng = np.random.default_rng(11)
    chunks = spark.createDataFrame([(f"c{i}", "p", "s", f"text {i % 4}", rng.integers(0, 4, 8).astype(float).tolist()) for i in range(60)], "chunk_id string, paper_id string, study_pmid string, text string, v array<double>")
    entries = [{"parent": "A", "folder": f"f{i}", "prompt": "", "min_similarity": [0.0, 0.7, 0.5][i % 3], "routing_strictness": ["soft", "hard"][i % 2], "required_any_terms": [[], ["text 1"]][i % 5 == 0]} for i in range(23)]
    vectors = spark.createDataFrame([(i, rng.integers(0, 4, 8).astype(float).tolist()) for i in range(23)], "section_pos int, v array<double>")
    outline = sections_frame(spark, entries).join(vectors, "section_pos")
    profiles = spark.createDataFrame([("p", [], [], [], [], [])], "paper_id string, domains array<string>, phase_regimes array<string>, keywords array<string>, working_fluids array<string>, system_topologies array<string>")
    key = lambda r: (r.chunk_id, r.section_pos)
    short = sorted(routing.route(chunks, outline, profiles, 0.4, 3, guarded).collect(), key=key)
    monkeypatch.setattr(routing, "MAX_SECTIONS", 5)
    monkeypatch.setattr(routing, "SECTION_BLOCK", 6)
    assert sorted(routing.route(chunks, outline, profiles, 0.4, 3, guarded).collect(), key=key) == short
    assert len(short) > 100 and any(r.assigned for r in short)


def test_cosines_halfway_between_two_numbers_of_nine_places(spark):
    """Nine counts in all against a prompt of four words have a cosine of 0.7499999995, which SQL rounds up; times 0.2 that is just on the soft limit."""
    from scholium.operators import routing

    section = [(0, "p", "f", [1.0, 1.0, 1.0, 1.0, 0.0, 0.0], 0.1, ["english"], None, ["with"], None, 1.0, "soft")]
    outline = spark.createDataFrame(section, "section_pos int, parent string, folder string, v array<double>, min_similarity double, allowed_domains array<string>, required_phase_regimes array<string>, required_any_terms array<string>, forbidden_terms array<string>, max_foreign_domain_ratio double, routing_strictness string")
    rows = spark.createDataFrame([("c", "s", "s", "x", [3.0, 1.0, 3.0, 2.0, 3.0, 2.0]), ("d", "s", "s", "x", None)], "chunk_id string, study_pmid string, paper_id string, text string, v array<double>")
    profiles = spark.createDataFrame([("s", ["english"], [], [], [], [])], "paper_id string, domains array<string>, phase_regimes array<string>, keywords array<string>, working_fluids array<string>, system_topologies array<string>")
    got = routing.route(rows, outline, profiles).collect()
    assert [(r.chunk_id, r.base_similarity, r.assigned) for r in got] == [("c", 0.75, True)]


def test_a_filter_on_decisions_makes_the_text_once(spark):
    """Spark pushes the filter of retained() below the projection that makes title and abstract; they may not be worked out for each keyword."""
    from scholium.operators import studies

    docs = spark.createDataFrame([(1, "A\nk1 good", "s")], "doc_id long, text string, source string")
    kept = screening.screen_by_keywords(studies.from_documents(docs), ["k1", "k2", "k3"], ["good"], ["bad"]).where("decision <> 'exclude'")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert condition.count("split(") <= 2 and kept.head().decision == "include"
