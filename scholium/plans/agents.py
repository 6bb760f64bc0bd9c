"""The review by phases: extraction, evidence, relevance, contradictions, critical analysis, synthesis, debates, theses, sections that are
written in waves and reviewed, tables, agenda, a document that is post-processed. Each phase is a stage of a run, so an interrupted
review goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import compose, coverage, markdown, replies, sections, synthesis, waves
from scholium.plans import analysis, review, systematic

#: Sections that a reviewer is shown, and characters of each and of the draft.
APPROVED, PREVIEW, DRAFT = 15, 300, 4_000
# What a draft scores whose review fails, and one that is empty; what stands for sections approved before, and for a thesis.
FAILED, EMPTY = 8.0, 10.0
NONE_APPROVED, NO_THESIS = "(no previous sections approved yet)", "(no thesis provided)"
GUARD = "\n- The section refers to findings with high flags of phase or condition."


def approved_text(done: DataFrame | None, outline: DataFrame) -> str:
    """The beginnings of the first APPROVED settled sections in outline order, a line each."""
    if done is None:
        return NONE_APPROVED
    first = done.join(outline.select(F.col("section_pos").cast("string").alias("key"), "section_pos", T.theme_key(F.col("parent"), F.col("folder")).alias("theme")), "key").where(T.strip(F.col("content")) != "")
    rows = first.orderBy("section_pos").limit(APPROVED).select(F.concat(F.lit("["), "theme", F.lit("]: "), T.strip(F.translate(F.substring("content", 1, PREVIEW), "\n", " ")), F.lit("...")).alias("l"))
    return "\n".join(r["l"] for r in rows.collect()) or NONE_APPROVED


def reviewed(rows: DataFrame, about: DataFrame, flags: DataFrame, approved: str, client, allowed: int = 0) -> DataFrame:
    """(key, score, feedback, model_score and the section's gates) of rows(key, content), drafts whose about(key, theme, thesis,
    forbidden_terms) is known: the model's score blended with the gates of contamination, physics and grounding. A failed call scores FAILED and an
    empty draft EMPTY, both without a blend; a draft with high flags beyond `allowed` is told so."""
    told = rows.join(about.select("key", "theme", "thesis", "forbidden_terms"), "key", "left")
    gates = sections.section_quality(told.select(F.col("key").alias("section_id"), "content", F.coalesce("forbidden_terms", F.array().cast("array<string>")).alias("forbidden_terms")), flags)
    gates = gates.select(F.col("section_id").alias("key"), "cross_topic_contamination_score", "physics_consistency_score", "grounding_score", "physics_high_flag_hits")
    empty = T.strip(T.text_or_empty(F.col("content"))) == ""
    task = compose.prompt_of("Score this section from 0 to 10 as JSON with overall_score, overall_feedback and a score and comment for each criterion.", F.concat(F.lit("Thesis: "), F.coalesce(F.nullif(F.col("thesis"), F.lit("")), F.lit(NO_THESIS))), F.lit(f"Approved before:\n{approved}"), F.substring("content", 1, DRAFT))
    asked = replies.ask(told, task, client).join(gates, "key", "left")
    model = replies.review_reply(F.col("reply"), empty)
    blend = sections.blended_score(model, F.col("cross_topic_contamination_score"), F.col("physics_consistency_score"), F.col("grounding_score"), F.col("physics_high_flag_hits"), allowed)
    said = replies.review_report(F.coalesce("reply", F.lit("")), empty)["overall_feedback"]
    said = F.concat(said, F.when(~empty & (F.col("physics_high_flag_hits") > allowed), GUARD).otherwise(""))
    return asked.select(
        "key", F.when(empty, EMPTY).when(F.col("reply").isNull(), FAILED).otherwise(blend).alias("score"), F.when(F.col("reply").isNull() & ~empty, F.concat(F.lit("Review error: "), "error")).otherwise(said).alias("feedback"),
        model.alias("model_score"), "cross_topic_contamination_score", "physics_consistency_score", "grounding_score", "physics_high_flag_hits",
    )


def run_review(run: review.Run, studies: DataFrame, outline: DataFrame, settings: analysis.Settings, client, title: str = "Review", rounds: int = 2, accept: float = 7.0, language: str = "en", polished: bool = False, relevance: bool = False, least: int = 1, together: int = 8) -> str:
    """The Markdown document of a review of studies over outline. client(prompt, options) is the language model.

    relevance has it judge each piece of evidence first; sections with fewer than `least` pieces say that there is no evidence, without
    a call. `together` sections are written at once, see waves.write_in_waves. polished has sections and chapters revised once more at the end.
    Articles and final sections also lie as files by chapter and section below the run's folder.
    """
    found = analysis.analyse(studies, outline, settings)
    extracted = run.stage("extracted", lambda: systematic.replies_of(studies, client))
    extractions = extracted.where("error is null").drop("error", "raw")
    risk = run.stage("risk_of_bias", lambda: systematic.rated(studies, client))
    evidence = run.stage("evidence", lambda: found.evidence)
    chunks = run.stage("chunks", lambda: found.chunks)
    run.stage("profiles", lambda: found.claimed_profiles)
    flags = run.stage("flags", lambda: found.flags)
    articles = run.stage("articles", lambda: coverage.section_articles(found.tags, chunks, studies))
    packages = run.stage("packages", lambda: analysis.evidence_package(evidence, chunks, studies))
    if relevance:
        pieces = run.stage("relevant", lambda: synthesis.judged_evidence(analysis.evidence_pieces(evidence, chunks, studies, outline), client)[0])
        packages = run.stage("relevant_packages", lambda: synthesis.evidence_text(pieces))
    packages = packages.where(F.col("n_evidence") >= max(least, 1))
    pairs = coverage.candidate_pairs(evidence, chunks)
    run.stage("contradictions", lambda: compose.contradictions(pairs, chunks, studies, client))

    tags = evidence.select("parent", "folder", "study_pmid", "similarity", "chunk_id")
    critical = run.stage("critical", lambda: synthesis.critical_analyses(synthesis.study_lines(tags, chunks, studies, extractions, risk), client))
    ids = evidence.groupBy(T.theme_key(F.col("parent"), F.col("folder")).alias("theme")).agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    themes = packages.select(T.theme_key(F.col("parent"), F.col("folder")).alias("theme"), "evidence").join(ids, "theme")
    maps = run.stage("synthesis", lambda: synthesis.synthesise(themes, client))
    run.stage("debates", lambda: synthesis.debates(maps.join(critical.select("theme", "robustness"), "theme"), client))
    theses = run.stage("theses", lambda: compose.theme_theses(maps.join(critical.select("theme", "summary"), "theme", "left"), client))
    questions = synthesis.chapter_questions(outline.select("parent", "section_pos", "research_questions"))
    chapters = run.stage("chapters", lambda: compose.chapter_theses(questions, client))

    entries = outline.select("section_pos", "parent", "folder", "prompt", "forbidden_terms").withColumn("theme", T.theme_key(F.col("parent"), F.col("folder"))).join(packages.select("parent", "folder", "evidence"), ["parent", "folder"])
    entries = entries.join(chapters.withColumnRenamed("thesis", "chapter_thesis"), "parent", "left").join(theses.select("theme", "thesis"), "theme", "left").join(compose.anchors(maps), "theme", "left")
    entries = entries.withColumn("thesis", F.coalesce(F.nullif(F.col("thesis"), F.lit("")), "chapter_thesis")).withColumn("key", F.col("section_pos").cast("string"))
    bare = outline.join(packages.select("parent", "folder"), ["parent", "folder"], "left_anti").select("section_pos", "parent", "folder", F.lit(review.NO_EVIDENCE).alias("content"), F.lit("").alias("covered"))
    made: list[DataFrame] = []

    def write_once(which: int) -> DataFrame:
        if not made:
            made.extend(waves.write_in_waves(entries, client, together))
        return made[which]

    drafts = run.stage("drafts", lambda: write_once(0).unionByName(bare))
    concepts = run.stage("concepts", lambda: write_once(1).select("concept_key", "concept", "section"))

    def judge(rows: DataFrame, done: DataFrame | None) -> DataFrame:
        return reviewed(rows, entries, flags, approved_text(done, outline), client).select("key", "score", "feedback")

    def rewrite(rows: DataFrame) -> DataFrame:
        again = entries.join(rows.select("key", "feedback"), "key").withColumn("covered", F.lit(waves.covered_text(concepts)))
        return rows.select("key", F.col("content").alias("old")).join(compose.write_entries(again, client).select(F.col("section_pos").cast("string").alias("key"), "content"), "key", "left").select("key", F.coalesce(F.nullif("content", F.lit("")), "old").alias("content"))

    keyed = drafts.select(F.col("section_pos").cast("string").alias("key"), "content")
    final = run.stage("sections", lambda: review.review_loop(keyed, rewrite, judge, rounds, accept).join(outline.select(F.col("section_pos").cast("string").alias("key"), "section_pos", "parent", "folder"), "key"))
    run.stage("quality", lambda: sections.section_quality(final.select(T.theme_key(F.col("parent"), F.col("folder")).alias("section_id"), "content"), flags, outline.select("parent", "folder", "forbidden_terms")))
    tables = run.stage("tables", lambda: compose.tables(packages, client))
    gaps = maps.select("theme", F.posexplode("gaps").alias("i", "g")).select(F.struct("theme", "i").alias("pos"), "theme", "g.description", "g.priority")
    merged = run.stage("agenda_merged", lambda: synthesis.consolidated_agenda(gaps, client))
    agenda = merged if not merged.isEmpty() else run.stage("agenda", lambda: sections.research_agenda(gaps))
    summary = run.stage("summary", lambda: compose.executive_summary(final.select("section_pos", "parent", "folder", "content"), title, client))

    def document() -> DataFrame:
        ordered = coverage.chapter_order(outline.select("section_pos", "parent", "folder")).select("section_pos", "parent_pos", "folder_pos")
        added = tables.groupBy("parent", "folder").agg(F.max("markdown").alias("table"))
        written = compose.place_tables(final.select("section_pos", "parent", "folder", "content"), tables).join(added, ["parent", "folder"], "left").join(ordered, "section_pos")
        written = written.withColumn("content", F.concat_ws("\n\n", T.textual_cleanup(F.col("content")), F.when(~F.contains("content", "table"), F.nullif(F.col("table"), F.lit("")))))
        coverage.write_sections(articles, f"{run.path}/files/articles")
        markdown.write_sections(written, f"{run.path}/files/texts")
        text = markdown.assemble(written, title, summary.first()["summary"], compose.LIMITATIONS.get(language, compose.LIMITATIONS["en"]), [r["description"] for r in agenda.orderBy("rank").collect()])
        docs = run.spark.createDataFrame([(0, text)], "key int, text string")
        return compose.post_process(docs, "key", client, chapters) if polished else docs

    return run.stage("document", document).first()["text"]
