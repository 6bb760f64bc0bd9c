import json


from scholium.operators import synthesis
from scholium.plans import agents, analysis
from scholium.plans.review import Run
from scholium.sources.outline import sections_frame


def test_judged_evidence(spark):
    texts = {"c1": '{"is_relevant": true, "confidence": 0.9, "claim": "x"}', "c2": '{"is_relevant": false}', "c3": '{"is_relevant": true, "confidence": 0.1}', "c4": "hm"}
    rows = spark.createDataFrame([("P", "F", k, c, "(A, 2020)", "about", c) for k, c in enumerate(texts)] + [("P", "F", 9, "c1", "(A, 2020)", "about", "c1")], "parent string, folder string, rank int, chunk_id string, citation string, prompt string, text string")
    client = lambda prompt, options: texts[prompt.rsplit("\n", 1)[1]]
    pieces, counts = synthesis.judged_evidence(rows, client)
    assert [p.chunk_id for p in pieces.collect()] == ["c1"]
    assert counts.first().asDict() == {"parent": "P", "folder": "F", "kept": 1, "dropped_irrelevant": 2, "dropped_low_confidence": 1, "parse_errors": 1}
    assert {p.chunk_id for p in synthesis.judged_evidence(rows, client, drop_unreadable=False)[0].collect()} == {"c1", "c4"}


def test_ungrounded_synthesis_gets_one_more_try(spark):
    def client(prompt, options):
        good = "needs evidence_chunk_ids" in prompt and "theme B" not in prompt or "theme A" in prompt
        return json.dumps({"consensus_points": [{"statement": "s", "strength": "high", "evidence_chunk_ids": ["c1"] if good else []}], "contradictions": [], "knowledge_gaps": []})

    rows = spark.createDataFrame([(f"theme {t}", "text", ["c1"]) for t in "ABC"], "theme string, evidence string, ids array<string>")
    maps = synthesis.synthesise(rows, client)
    found = {r.theme: (len(r.consensus), [g.priority for g in r.gaps]) for r in maps.collect()}
    assert found == {"theme A": (1, []), "theme B": (0, ["high"]), "theme C": (1, [])}
    assert synthesis.theme_totals(maps).first().asDict() == {"themes": 3, "total_consensus": 2, "total_contradictions": 0, "total_gaps": 1}


def test_debates(spark):
    kind = "theme string, contradictions array<struct<point:string,study_a:string,study_b:string,ids:array<string>>>, robustness string"
    rows = spark.createDataFrame([("A", [("p", "", "", []), ("q", "", "", [])], "baixa"), ("B", [("p", "", "", [])], "baixa"), ("C", [("p", "", "", []), ("q", "", "", [])], "alta")], kind)
    assert [(r.theme, r.verdict) for r in synthesis.debates(rows, lambda p, o: p.split()[0]).collect()] == [("A", "Moderate:")]


def test_rewrites_need_the_same_count(spark):
    long = "word " * 25
    own = spark.createDataFrame([("A", 0, "h0", long), ("A", 1, "h1", "short"), ("A", 2, "h2", long), ("B", 0, "h", long), ("B", 1, "i", long)], "chapter string, place int, heading string, body string")
    new = spark.createDataFrame([("A", 0, "n0"), ("A", 1, "n1"), ("A", 2, "n2"), ("B", 0, "n0")], "chapter string, place int, body string")
    found = {(r.chapter, r.place): (r.heading, r.body) for r in synthesis.take_rewrites(own, new).collect()}
    assert found == {("A", 0): ("h0", "n0"), ("A", 1): ("h1", "short"), ("A", 2): ("h2", "n2"), ("B", 0): ("h", long), ("B", 1): ("i", long)}


def test_chapter_questions(spark):
    rows = sections_frame(spark, [{"parent": "A", "folder": "x", "prompt": "", "research_questions": ["1", "2"]}, {"parent": "B", "folder": "y", "prompt": ""}, {"parent": "A", "folder": "z", "prompt": "", "research_questions": ["3"]}])
    assert {r.parent: r.questions for r in synthesis.chapter_questions(rows).collect()} == {"A": ["1", "2", "3"], "B": []}


def heat_studies(spark, n=3):
    return spark.createDataFrame([(i, f"s{i}", f"Heat pump study {i}", "Doe", "", 2020, "Heat pump efficiency was improved in cold storage. " * 3, "", "") for i in range(n)], "pos long, pmid string, title string, authors string, journal string, year int, abstract string, doi string, raw_text string")


SETTINGS = analysis.Settings(vocabulary=("heat", "pump", "cold", "biodiesel"), scope_on=False)


def test_a_whole_review(spark, tmp_path):
    studies = heat_studies(spark)
    outline = sections_frame(spark, [{"parent": "One", "folder": "heat", "prompt": "heat pump"}, {"parent": "One", "folder": "other", "prompt": "unrelated biodiesel"}])

    def client(prompt, options):
        if prompt.startswith("Synthesise"):
            return json.dumps({"consensus_points": [], "contradictions": [], "knowledge_gaps": [{"description": "More data", "priority": "high"}]})
        return '{"score": 9}' if prompt.startswith("Score") else "A draft about heat."

    calls = []
    counted = lambda prompt, options: client(prompt, options)
    text = agents.run_review(Run(spark, str(tmp_path / "r")), studies, outline, SETTINGS, counted)
    assert "# Review" in text and "## One" in text and "A draft about heat." in text and "No evidence met" in text and "1. More data" in text
    assert agents.run_review(Run(spark, str(tmp_path / "r")), studies, outline, SETTINGS, lambda p, o: calls.append(p)) == text and not calls


def test_what_each_phase_of_a_review_is_told(spark, tmp_path):
    studies = heat_studies(spark)
    outline = sections_frame(spark, [{"parent": "One", "folder": "heat", "prompt": "heat pump"}, {"parent": "Two", "folder": "pumps", "prompt": "pump heat", "forbidden_terms": ["zeolite"]}, {"parent": "Two", "folder": "cold", "prompt": "cold heat pump"}])
    asked = tmp_path / "asked"
    asked.mkdir()

    def client(prompt, options):
        import uuid

        (asked / uuid.uuid4().hex).write_text(prompt)
        if prompt.startswith("Extract"):
            return '{"study_design": "trial", "study_scale": "pilot", "funding_source": "public"}'
        if prompt.startswith("Rate the risk"):
            return '[{"domain": "a", "rating": "high"}]'
        if prompt.startswith("Is this excerpt"):
            return json.dumps({"is_relevant": "[s2]" not in prompt and "chunk:s2" not in prompt, "confidence": 0.9, "claim": "judged claim"})
        if prompt.startswith("Judge methods"):
            return '{"summary": "sound methods", "robustness": "baixa"}'
        if prompt.startswith("Synthesise"):
            points = [{"point": p, "evidence_chunk_ids": [prompt.split("[chunk:")[1].split("]")[0]]} for p in ("p", "q")]
            return json.dumps({"consensus_points": [], "contradictions": points, "knowledge_gaps": [{"description": "More data", "priority": "high"}]})
        if prompt.startswith("Name the technical"):
            return '["heat lift", "Frost"]'
        if prompt.startswith("Score"):
            return json.dumps({"overall_score": 9 if "again" in prompt or "/ heat" in prompt else 5, "overall_feedback": "say more"})
        if prompt.startswith("Merge these gaps"):
            return '[{"description": "One merged gap", "priority": "alta"}]'
        if prompt.startswith("Write this section"):
            return ("again " if "Feedback: say more" in prompt else "") + prompt.split("Section: ")[1].split("\n")[0] + " zeolite " + "has many words in a long draft of its own, " * 3
        if prompt.startswith("Polish"):
            return prompt.split("\n", 1)[1]
        return prompt.split("\n")[0] if prompt.startswith("Moderate") else "text"

    run = Run(spark, str(tmp_path / "run"))
    text = agents.run_review(run, studies, outline, SETTINGS, client, together=1, relevance=True, least=1)
    prompts = [p.read_text() for p in asked.iterdir()]
    stages = run.tables()
    critical = next(p for p in prompts if p.startswith("Judge methods") and "One / heat" in p)
    assert "--- (Doe, 2020) | Scale: pilot | RoB: high | Funding: public ---\nHeat pump" in critical
    assert stages["critical"].where("robustness = 'baixa' and summary = 'sound methods'").count() == 3
    assert stages["debates"].count() == 3  # two contradictions and little robustness
    relevant = {r.parent + r.folder: r.evidence for r in stages["relevant_packages"].collect()}
    assert all("judged claim" in e and "s2" not in e for e in relevant.values()) and len(relevant) == 3
    # Sections know the concepts of those before them, in writing order; each concept stays with the first.
    told = {r.folder: r.covered for r in stages["drafts"].collect()}
    assert told == {"heat": "", "pumps": "Frost (see: One / heat); heat lift (see: One / heat)", "cold": "Frost (see: One / heat); heat lift (see: One / heat)"}
    assert sorted((r.concept, r.section) for r in stages["concepts"].collect()) == [("Frost", "One / heat"), ("heat lift", "One / heat")]
    done = {r.folder: r for r in stages["sections"].collect()}
    assert done["pumps"].iterations == 2 and done["pumps"].content.startswith("again Two / pumps") and done["pumps"].score < done["cold"].score
    second = [p for p in prompts if p.startswith("Score") and "again" in p]
    assert second and all("Approved before:\n" in p for p in second)
    assert "1. One merged gap" in text and "agenda" not in stages
    assert stages["profiles"].where("claims is not null").count() >= 0 and stages["articles"].count() > 0
    files = {p.parent.name: p.read_text() for p in (tmp_path / "run" / "files" / "texts").rglob("part-*.txt")}
    assert set(files) == {"folder_dir=heat", "folder_dir=pumps", "folder_dir=cold"} and files["folder_dir=pumps"].startswith("### pumps\n\nagain")
    assert list((tmp_path / "run" / "files" / "articles").rglob("part-*.json"))


def test_scores_of_drafts(spark):
    rows = spark.createDataFrame([("a", "x" * 5), ("b", " "), ("c", "fails"), ("d", "with zeolite [chunk:abcdef12]"), ("e", "no JSON")], "key string, content string")
    about = spark.createDataFrame([("a", "A", "t", []), ("d", "D", "", ["zeolite"])], "key string, theme string, thesis string, forbidden_terms array<string>")
    flags = spark.createDataFrame([("high", ["abcdef12"])], "severity string, related_ids array<string>")

    def client(prompt, options):
        if "fails" in prompt:
            raise OSError("no answer")
        return "as good as any" if "no JSON" in prompt else '{"overall_score": 6, "overall_feedback": "f"}'

    found = {r.key: (r.score, r.feedback) for r in agents.reviewed(rows, about, flags, "", client).collect()}
    assert found["a"] == (7.2, "f")  # 0.7 * 6 + 0.3 * 10
    assert found["b"] == (10.0, "") and found["c"] == (8.0, "Review error: no answer")
    assert found["d"][0] == round(0.7 * 6 + 0.3 * 5, 2) and found["d"][1] == "f" + agents.GUARD
    assert found["e"] == (round(0.7 * 7 + 3, 2), "as good as any")


def test_texts_condensed_by_levels(spark):
    from scholium.operators import reduction

    calls = spark.sparkContext.accumulator(0)

    def client(prompt, options):
        calls.add(1)
        if "x7 " in prompt:
            raise OSError("no answer")
        return f"<{prompt.count(chr(10))}>"

    parts = spark.createDataFrame([(i, f"x{i} " + "y" * 16) for i in range(40)] + [(40, None)], "place int, text string")
    assert reduction.condensed(parts, "T", client, 10_000).first().text.count("\n") == 40 and calls.value == 0
    placed = sorted((r.place, r.batch) for r in reduction.batches(parts.dropna(), 100).collect())
    sizes = [len(f"x{i} ") + 16 for i in range(40)]
    assert [b for _, b in placed] == [sum(sizes[:i]) // 100 for i in range(40)]
    found = reduction.condensed(parts, "T", client, 100).first().text.split("\n")
    assert found[0] == "<6>" and len("\n".join(found)) <= 100
    assert found[1] == "x6 " + "y" * 16  # the second batch's call failed
    assert reduction.condensed(parts.where("place < 0"), "T", client, 100).first().text == ""


def test_agenda_of_all_gaps(spark):
    gaps = spark.createDataFrame([(i, "A", f"gap {i}", "high") for i in range(30)], "pos int, theme string, description string, priority string")
    merge = lambda p, o: json.dumps([{"description": f"{p.count(chr(10))} lines", "priority": "alta"}, {"description": " "}]) if p.startswith("Merge these") else "- [high] merged"
    assert [(r["rank"], r.description, r.suggested_approach) for r in synthesis.consolidated_agenda(gaps, merge, budget=200).collect()] == [(1, "3 lines", "")]
    assert synthesis.consolidated_agenda(gaps, lambda p, o: "no JSON").collect() == []
    assert synthesis.consolidated_agenda(gaps.where("pos < 0"), merge).collect() == []
