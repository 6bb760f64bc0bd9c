"""Registered queries of what a model writes, with clients that answer by rule, and of rules and renderings over default tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import lexicon
from scholium.functions import text as T
from scholium.operators import chunk, compose, coverage, gate, markdown, meta, profile, reduction, replies, scope, sections, synthesis, waves
from scholium.plans import agents, analysis, oracle, systematic
from scholium.plans.catalog import SQL, digits, maps_of, query, read_table, studies_of


def _last(prompt: str) -> str:
    return prompt.rsplit("\n", 1)[-1]


def digest(prompt: str, options: dict) -> str:
    """A client that answers with the digest of its prompt."""
    return hashlib.md5(prompt.encode()).hexdigest()


def thesis_client(prompt: str, options: dict) -> str:
    if len(_last(prompt)) % 5 == 0:
        raise OSError("no answer")
    return f" {_last(prompt)} "


#: The letters that a stand-in client puts in upper case, as any engine does.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def draft_client(prompt: str, options: dict) -> str:
    last = _last(prompt)
    if prompt.startswith("Polish"):
        if len(last) % 4 == 0:
            raise OSError("no answer")
        return last.translate(str.maketrans(LOWER, UPPER))
    return ("No direct evidence. " if prompt.startswith("Write a short") else "Draft: ") + last


def editor(prompt: str, options: dict) -> str:
    """Refined sections get a word; chapters too, but those of an odd length come back without their last section."""
    task, _, text = prompt.partition("\n")
    if task.startswith("Refine"):
        return text + " refined"
    text = text.partition("\n")[2]
    if task.startswith("Take"):
        return text.replace(" refined", " once")
    return text.rpartition("### ")[0] if len(text) % 2 else text + " coherent"


def contradiction_client(prompt: str, options: dict) -> str:
    mark = hashlib.md5(_last(prompt).encode()).hexdigest()
    return f'{{"contradiction": true, "point": "{mark}", "possible_cause": "c"}}' if mark[0] in "01234" else '{"contradiction": false}' if mark[0] in "56789ab" else "broken"


def theme_client(prompt: str, options: dict) -> str:
    number = int(prompt.split("\n")[1].removeprefix("Theme: "))
    return "broken" if number % 6 == 0 else f'```json\n{{"thesis": "t {_last(prompt)}", "research_priorities": ["a", "b"], "grouped_gaps": [{{"group": "g", "gaps": [{{"description": "d", "priority": "alta", "justification": "j"}}]}}]}}\n```'


TABLE = '{"should_create_table": true, "caption": "c", "columns": ["a", "b"], "rows": [{"a": "x|y", "b": {"k": 1}}, {"a": " "}], "source_studies": ["S1", "S2"]}'


def table_client(prompt: str, options: dict) -> str:
    return (f"Sure: {TABLE}", '{"should_create_table": false}', "no")[len(_last(prompt)) % 3]


def _turns(spark, sf) -> DataFrame:
    return read_table(spark, sf, "conversations")


def _first_turns(spark, sf) -> DataFrame:
    """(section_pos, parent, folder, content): the least text of each conversation's first turn, as a section."""
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("x"))
    return rows.select(F.col("conv_id").alias("section_pos"), F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("parent"), F.concat(F.lit("Part "), F.col("conv_id").cast("string")).alias("folder"), F.col("x.text").alias("content"))


@query
def chapter_theses(spark, sf):
    """Conversations as chapters; some have no questions, some calls fail."""
    asked = F.when(F.col("conv_id") % 3 > 0, F.array_join(F.slice(T.words(F.col("text")), 1, 3), " "))
    rows = _turns(spark, sf).groupBy(F.col("conv_id").cast("string").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("turn", asked.alias("q")))).alias("xs"))
    rows = rows.select("parent", F.array_compact(F.transform("xs", lambda x: x["q"])).alias("questions"))
    return compose.chapter_theses(rows, thesis_client)


@query
def section_drafts(spark, sf):
    """Drafts with and without evidence, polished or not."""
    rows = _first_turns(spark, sf).withColumn("prompt", F.lit("g")).withColumn("evidence", F.when(F.col("section_pos") % 3 > 0, F.array_join(F.slice(T.words(F.col("content")), 1, 6), " "))).drop("content")
    return compose.write_entries(rows, draft_client).select("section_pos", "parent", "folder", F.md5("content").alias("content_md5"))


@query
def executive_summary(spark, sf):
    """J14."""
    return compose.executive_summary(_first_turns(spark, sf), "T", digest)


def _documents(spark, sf) -> DataFrame:
    """Conversations as Markdown: every third turn begins a chapter, the others are sections."""
    part = F.concat(F.when(F.col("turn") % 3 == 0, "## ").otherwise("### "), F.lit("turn "), F.col("turn").cast("string"), F.lit("\n\n"), F.translate("text", "#", ""))
    return _turns(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


@query
def post_processed(spark, sf):
    """Refined sections, then chapters twice over; replies with too few sections are not taken."""
    found = markdown.split_sections(compose.post_process(_documents(spark, sf), "conv_id", editor), "conv_id")
    return found.select("conv_id", F.col("section_no").cast("long").alias("section_no"), "heading", F.md5("body").alias("body_md5"))


@query
def contradiction_checks(spark, sf):
    """Each benchmark text against the next one of another study."""
    rows = read_table(spark, sf, "benchmark")
    chunks = rows.select(F.col("item_id").cast("string").alias("chunk_id"), F.concat(F.lit("s"), (F.col("item_id") % 5).cast("string")).alias("study_pmid"), "text")
    people = spark.createDataFrame([(f"s{k}", None if k == 0 else f"Author {k}") for k in range(5)], "pmid string, authors string")
    pairs = rows.select(F.lit("p").alias("parent"), F.lit("f").alias("folder"), F.col("item_id").cast("string").alias("a"), (F.col("item_id") + 1).cast("string").alias("b"), F.col("item_id").cast("int").alias("pair"))
    return compose.contradictions(pairs, chunks, people, contradiction_client).withColumn("ids", F.array_join("ids", ","))


@query
def theme_theses(spark, sf):
    """A thesis, grouped gaps and priorities of each theme."""
    found = compose.theme_theses(maps_of(spark, sf), theme_client)
    return found.select("theme", "thesis", F.array_join("research_priorities", ",").alias("priorities"), F.array_join(F.transform("grouped_gaps", lambda g: F.concat(g["group"], F.lit(":"), F.size(g["gaps"]).cast("string"))), ",").alias("groups"))


@query
def synthesis_dispatch(spark, sf):
    """Customers with effects are pooled, benchmark texts without are themes."""
    effect = F.col("c_acctbal") / 1000
    many = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pmid"), effect.cast("double").alias("effect_size"), (effect - F.col("c_nationkey") / 10 - 0.1).cast("double").alias("ci_lower"), (effect + F.col("c_nationkey") / 10 + 0.1).cast("double").alias("ci_upper"))
    none = F.lit(None).cast("double")
    few = read_table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("pmid"), F.when(F.col("item_id") < 2, 1.0).alias("effect_size"), F.when(F.col("item_id") < 1, 0.5).alias("ci_lower"), none.alias("ci_upper"), F.lit("d").alias("study_design"), F.md5("text").alias("intervention"), none.cast("string").alias("outcome"))
    rows = compose.synthesise_extractions(many, digest).unionByName(compose.synthesise_extractions(few, digest))
    return rows.select(*(digits(c) if k == "double" else F.col(c) for c, k in rows.dtypes))


@query
def manuscript_texts(spark, sf):
    """The four sections, from all benchmark texts as studies."""
    rows = read_table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("pmid"), F.md5("text").alias("study_design"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") / 8).alias("effect_size"))
    found = spark.range(1).select(F.lit("thematic").alias("type"), F.lit(3).alias("k"), F.lit(None).cast("double").alias("pooled_effect"), F.lit(None).cast("double").alias("i_squared"), F.lit("S").alias("summary"))
    return compose.manuscript_sections({"topic": "t", "population": "p", "query": "q"}, rows, found, {"retrieved": 9, "deduplicated": 8, "included": 7}, digest)


@query
def table_proposals(spark, sf):
    """Tables that a model proposes, with pipes, nested cells and blanks; short evidence is not asked about."""
    rows = _first_turns(spark, sf).select("parent", "folder", F.col("content").alias("evidence"))
    return compose.tables(rows, table_client).select("parent", "folder", "table_id", "caption", F.md5("markdown").alias("markdown_md5"))


@query
def review_reports(spark, sf):
    """Reports of labels, some broken, some of empty drafts."""
    rows = read_table(spark, sf, "labels")
    clean = F.concat(F.lit('{"overall_score": '), (F.col("doc_id") % 11).cast("string"), F.lit(', "hedging": {"score": 4.5, "comment": "h"}, "redundancy": {"comment": "r"}, "overall_feedback": "f"}'))
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Well: "), clean)).otherwise(clean)
    return rows.select("doc_id", replies.review_report(raw, F.col("doc_id") % 9 == 0).alias("r")).select("doc_id", "r.score", "r.overall_feedback", F.col("r.hedging.score").alias("hedging"), F.col("r.hedging.comment").alias("hedging_comment"), F.col("r.redundancy.score").alias("redundancy"), F.col("r.redundancy.comment").alias("redundancy_comment"), F.col("r.critical_depth.score").alias("depth"))


def _measured(spark, sf) -> DataFrame:
    """Labels as texts with temperatures, pressures and signs of a phase."""
    i = F.col("doc_id")
    text = F.concat(
        F.lit("Tests at "), (200 + i % 130).cast("string"), F.lit(","), (i % 10).cast("string"), F.lit(" K and "), (i % 60 - 40).cast("string"), F.lit(" °C, "), F.when(i % 3 == 0, F.concat((i % 12).cast("string"), F.lit(".5 MPa"))).otherwise(F.concat((i % 90).cast("string"), F.lit(" bar"))),
        F.lit(" or "), (i % 700).cast("string"), F.lit(" kPa with CO2, "), F.get(F.array(*map(F.lit, ("solid dry ice", "near the triple point", "supercritical", "transcritical R744", "air"))), (i % 5).cast("int")), F.lit("."),
    )
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("pmid"), text.alias("title"), F.lit("").alias("abstract"), F.lit("").alias("raw_text"), F.lit("").alias("doi"))


@query
def measured_ranges(spark, sf):
    """H2, H3, D13 with the default tables: ranges of temperatures and pressures."""
    t, p = T.value_range(T.temperatures_k(F.col("title"))), T.value_range(T.pressures_bar(F.col("title")))
    return _measured(spark, sf).select("pos", F.round(t["min"], 3).alias("t_min"), F.round(t["max"], 3).alias("t_max"), F.round(p["min"], 3).alias("p_min"), F.round(p["max"], 3).alias("p_max"), F.round(t["confidence"], 3).alias("confidence"))


@query
def phase_flag_counts(spark, sf):
    """H4, D3 with the default tables: flags of phases that temperatures and pressures do not bear out."""
    prof = profile.profile_studies(_measured(spark, sf))
    return prof.select("paper_id", F.explode(profile.phase_flags()).alias("f")).groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("f.severity") == "high").alias("n_high"))


@query
def claims_found(spark, sf):
    """H7: claims of documents whose sentences speak of amounts and comparisons; one is said twice."""
    rows = read_table(spark, sf, "labels")
    amount = F.concat(F.lit("The yield of sample "), (F.col("doc_id") % 50).cast("string"), F.lit(" rose to 45 K in the second run."))
    text = F.concat(amount, F.when(F.col("quality") == 1, F.concat(F.lit(" "), F.upper(amount))).otherwise(""), F.lit(" Nothing is said here about any number at all. It was much higher than all that came before it. Short 5 K."))
    return rows.select("doc_id", F.explode(T.claims(text)).alias("c")).select("doc_id", "c.claim", "c.claim_type")


@query
def text_cleanups(spark, sf):
    """Repeated citations, stray sentences, spellings, table traces and blank lines."""
    text = F.concat(F.lit("In summary, all is well.\nSee (Doe, 2020; doe, 2020; Roe, 2021) on catalise C12 C and "), F.substring(F.translate("text", "()", ""), 1, 200), F.lit("/C45\n\n\n\n\nend"))
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.textual_cleanup(text)).alias("text_md5"))


@query
def thermo_cleanups(spark, sf):
    """Sentences that have the heat of a phase change the wrong way round."""
    one = F.get(F.array(*map(F.lit, ("Sublimation is exothermic here.", "Deposition is endothermic!", "A sublimação é exotérmica?", "Sublimation is endothermic."))), (F.col("doc_id") % 4).cast("int"))
    two = F.get(F.array(*map(F.lit, ("All is well.", "A deposição é endotérmica."))), (F.col("quality")).cast("int"))
    return read_table(spark, sf, "labels").select("doc_id", T.thermo_fixes(F.concat(one, F.lit("\n\n"), two)).alias("r")).select("doc_id", "r.text", "r.fixes")


@query
def writing_order(spark, sf):
    """E5: nations in the order of their regions' first and their names' last place."""
    rows = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("section_pos"), F.col("n_regionkey").cast("string").alias("parent"), F.concat(F.lit("f"), (F.col("n_nationkey") % 7).cast("string")).alias("folder"))
    return coverage.chapter_order(rows)


@query
def evidence_packages(spark, sf):
    """Evidence of two themes with citations, in rank order."""
    rows = read_table(spark, sf, "benchmark")
    chunks = rows.select(F.col("item_id").cast("string").alias("chunk_id"), F.concat(F.lit("s"), (F.col("item_id") % 5).cast("string")).alias("study_pmid"), "text")
    people = spark.createDataFrame([(f"s{k}", None if k == 0 else f"Author {k}", 2000 + k if k % 2 else None) for k in range(4)], "pmid string, authors string, year int")
    ranked = rows.select(F.lit("p").alias("parent"), (F.col("item_id") % 2).cast("string").alias("folder"), (F.col("item_id") * 7 % 1009).cast("int").alias("rank"), F.col("item_id").cast("string").alias("chunk_id"))
    return analysis.evidence_package(ranked, chunks, people).select("parent", "folder", "n_evidence", F.md5("evidence").alias("evidence_md5"))


@query
def outlined_quality(spark, sf):
    """Forbidden terms that come from the outline."""
    rows = _first_turns(spark, sf).select(T.theme_key(F.col("parent"), F.col("folder")).alias("section_id"), "content")
    outline = _first_turns(spark, sf).where("section_pos % 2 = 0").select("parent", "folder", F.array(F.lit("the"), F.lit("AND"), F.lit("zzz")).alias("forbidden_terms"))
    flags = spark.createDataFrame([], profile.FLAG.removeprefix("struct<").removesuffix(">"))
    found = sections.section_quality(rows, flags, outline)
    return found.select("section_id", F.array_join("forbidden_term_hits", ",").alias("hits"), "cross_topic_contamination_score")


@query
def evidence_rows(spark, sf):
    """Studies of a theme with design, effect and risk of bias."""
    rows = read_table(spark, sf, "labels")
    tags = rows.select(F.lit("p").alias("parent"), (F.col("doc_id") % 3).cast("string").alias("folder"), (F.col("doc_id") % 40).cast("string").alias("study_pmid"), ((F.col("doc_id") * 13) % 101 / 128).alias("similarity"), F.col("doc_id").cast("string").alias("chunk_id"))
    ids = spark.range(30).select(F.col("id").cast("string").alias("pmid"), F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("study_design"), (F.col("id") / 4).alias("effect_size"))
    risk = spark.range(20).select(F.col("id").cast("string").alias("pmid"), F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("overall_rating"))
    return meta.evidence_table(tags, ids, risk)


@query
def extraction_replies(spark, sf):
    """Extractions of labels; errors keep the beginning of the reply."""
    i = F.col("doc_id")
    clean = F.concat(F.lit('{"study_design": "rct", "population": null, "sample_size": '), (i % 500).cast("string"), F.lit(', "effect_size": '), (i % 7).cast("string"), F.lit('.25, "ci_lower": "x"}'))
    rows = read_table(spark, sf, "labels").select(i.cast("string").alias("pmid"), F.when(i % 3 == 0, "no JSON").when(i % 3 == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).otherwise(clean).alias("reply"))
    good, bad = replies.extraction_reply(rows)
    none = F.lit(None)
    return good.select("pmid", "study_design", "population", "sample_size", "effect_size", "ci_lower", none.cast("string").alias("raw")).unionByName(bad.select("pmid", none.cast("string").alias("study_design"), none.cast("string").alias("population"), none.cast("int").alias("sample_size"), none.cast("double").alias("effect_size"), none.cast("double").alias("ci_lower"), "raw"))


@query
def query_replies(spark, sf):
    """Questions in parts, from JSON, from chatter, from nothing."""
    i = F.col("doc_id")
    clean = F.concat(F.lit('{"population": "adults", "query": "a AND b'), i.cast("string"), F.lit('"}'))
    raw = F.when(i % 3 == 0, clean).when(i % 3 == 1, F.concat(F.lit('Well, "Outcome": "o" and "query": "q'), i.cast("string"), F.lit('".'))).otherwise(F.concat(F.lit("plain words "), i.cast("string")))
    return read_table(spark, sf, "labels").select("doc_id", replies.query_reply(raw).alias("r")).select("doc_id", "r.*")


@query
def concept_replies(spark, sf):
    """Concepts from arrays, chatter, bullets and comma lists."""
    i = F.col("doc_id")
    n = i.cast("string")
    raw = F.when(i % 4 == 0, F.concat(F.lit('["one", "One", "c'), n, F.lit('"]'))).when(i % 4 == 1, F.concat(F.lit('Here: ["a b", "c'), n, F.lit('"] as asked'))).when(i % 4 == 2, F.concat(F.lit("List\n- first "), n, F.lit("\n* second\n3. third"))).otherwise(F.concat(F.lit("left, right, c"), n))
    return read_table(spark, sf, "labels").select("doc_id", F.array_join(replies.concept_list(raw), "|").alias("concepts"))


@query
def latex_documents(spark, sf):
    """Conversations as LaTeX articles with lists, rules, marks and references."""
    mark = F.when(F.col("turn") == 0, "# ").when(F.col("turn") % 4 == 1, "## ").when(F.col("turn") % 4 == 2, "- ").when(F.col("turn") % 4 == 3, "").otherwise("## References ")
    word = F.concat(F.lit("w"), F.regexp_replace(F.coalesce(F.get(T.words(F.col("text")), F.lit(0)), F.lit("")), r"[^A-Za-z]", ""))
    line = F.concat(mark, F.lit("*"), word, F.lit("* & 5 % **"), F.col("turn").cast("string"), F.lit("**"))
    docs = _turns(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n---\n").alias("text"))
    return markdown.markdown_to_latex(docs, "conv_id").select("conv_id", F.md5("latex").alias("latex_md5"))


@query
def gate_reasons(spark, sf):
    """Tags made of labels so that each of the nine reasons occurs, in the order of the tests."""
    i = F.col("doc_id")
    rows = read_table(spark, sf, "labels").select("doc_id")
    tags = rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("p").alias("parent"), F.lit("f").alias("folder"), F.lit(0).alias("section_pos"), F.when(i % 11 == 0, 0.1).otherwise(0.9).alias("eligibility_score"), F.when(i % 13 == 0, 0.2).otherwise(0.6).alias("similarity"))
    text = F.concat(F.when(i % 3 == 0, "a needed word").otherwise("none"), F.when(i % 29 == 0, " a banned word").otherwise(""))
    chunks = rows.where("doc_id % 17 <> 0").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("paper_id"), F.lit("s").alias("study_pmid"), text.alias("text"))
    domains = F.when(i % 19 == 0, F.array(F.lit("x"))).when(i % 23 == 0, F.array(F.lit("A"), F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("a")))
    nothing = F.array().cast("array<string>")
    profs = rows.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("paper_id"), domains.alias("domains"), F.when(i % 7 == 0, F.array(F.lit("liquid"))).otherwise(F.array(F.lit("Solid"))).alias("phase_regimes"), nothing.alias("keywords"), nothing.alias("working_fluids"), nothing.alias("system_topologies"))
    high = rows.where("doc_id % 5 = 0").select(F.when(i % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("id"))
    outline = spark.createDataFrame([("p", "f", ["a"], ["solid"], ["needed"], ["banned"], 0.5, 0.5, 0.0)], "parent string, folder string, allowed_domains array<string>, required_phase_regimes array<string>, required_any_terms array<string>, forbidden_terms array<string>, min_similarity double, max_foreign_domain_ratio double, max_foreign_evidence_share double")
    return gate.judge_tags(tags, chunks, outline, profs, high).select("chunk_id", "reason")


def screening_client(prompt: str, options: dict) -> str:
    n = len(prompt)
    if n % 7 == 0:
        raise OSError("no answer")
    return f'{{"decision": "{("include", "exclude", "maybe")[n % 3]}", "confidence": 0.{n % 90 + 10}, "justification": "n {n}"}}'


@query
def model_screening(spark, sf):
    """Every document against a question, by replies that fail for some."""
    pico = {"population": "p", "intervention": "i", "comparison": "c", "outcome": "o"}
    rows = systematic.screened(studies_of(spark, sf), pico, screening_client)
    return rows.select("pos", "pmid", "decision", F.floor(F.col("confidence") * 100 + 0.5).cast("long").alias("confidence"), "justification")


@query
def extraction_stage(spark, sf):
    """Extractions and errors of benchmark texts, with their risk of bias."""
    rows = read_table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("pmid"), F.lit("t").alias("title"), F.col("text").alias("abstract"))
    found = systematic.replies_of(rows, extraction_client)
    return found.join(systematic.rated(rows, extraction_client).select("pmid", "overall_rating"), "pmid").select("pmid", "study_design", "sample_size", F.col("error").isNull().alias("read"), "overall_rating")


def extraction_client(prompt: str, options: dict) -> str:
    n = len(prompt)
    if prompt.startswith("Rate"):
        return '[{"domain": "a", "rating": "High"}]' if n % 3 == 0 else '[{"domain": "a", "rating": "low"}, {"domain": "b"}, {"domain": "c"}]' if n % 3 == 1 else "none"
    return "no JSON" if n % 4 == 0 else f'{{"study_design": "d{n % 5}", "sample_size": {n}}}'


PHRASES = (
    "A vapor compression evaporator in cold storage", "nucleate boiling and critical heat flux", "PCM encapsulation", "liquid air energy storage with LAES discharge", "water-gas shift over a catalyst", "pyrolysis of microalgae and biodiesel", "R744 transcritical CO2",
    "dry ice and solid CO2 at the triple point", "ponto triplo supercrítico", "Brayton and TES", "a diesel engine with low-carbon fuels", "direct air capture", "gas cooler with an ejector", "nothing of the kind",
)


def _phrased(spark, sf) -> DataFrame:
    """Labels as texts of two phrases that the default tables know."""
    i = F.col("doc_id")
    phrases = F.array(*map(F.lit, PHRASES))
    text = F.concat(F.get(phrases, (i % len(PHRASES)).cast("int")), F.lit(". "), F.get(phrases, (F.floor(i / 3) % len(PHRASES)).cast("int")), F.lit(" "), F.when(i % 2 == 0, F.get(phrases, (F.floor(i / 7) % len(PHRASES)).cast("int"))).otherwise(""))
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("pmid"), text.alias("title"), F.lit("").alias("abstract"), F.lit("").alias("raw_text"))


@query
def default_labels(spark, sf):
    """H1, G1 with the default tables of domains, fluids, phases and topologies."""
    tables = {"domains": lexicon.DOMAINS, "fluids": lexicon.FLUIDS, "phases": lexicon.PHASES, "topologies": lexicon.TOPOLOGIES}
    return _phrased(spark, sf).select("pos", *(F.array_join(T.labels(F.col("title"), t), ",").alias(n) for n, t in tables.items()))


@query
def default_scope(spark, sf):
    """B3, B4 with the default clusters, anchors and negatives."""
    found = scope.with_scope(scope.scope_features(_phrased(spark, sf)))
    return found.select("pos", F.array_join(F.array_sort(F.map_keys("cluster_hits")), ",").alias("clusters"), "anchor_hits", "negative_hits", "in_scope")


@query
def forest_plot_rows(spark, sf):
    """What a forest plot of customers' balances is drawn from; intervals of no width weigh most."""
    effect = F.col("c_acctbal") / 1000
    rows = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pmid"), effect.cast("double").alias("effect_size"), effect.cast("double").alias("ci_lower"), F.when(F.col("c_nationkey") < 20, effect + F.col("c_nationkey")).cast("double").alias("ci_upper"))
    return meta.forest_rows(rows).select("label", digits("effect"), digits("ci_lower"), digits("ci_upper"), digits("weight"))


def wave_client(prompt: str, options: dict) -> str:
    """Drafts carry a digest of what they are told to be covered; concepts are a draft's last three words."""
    if prompt.startswith("Name"):
        return ", ".join(_last(prompt).split()[-3:]) + ","
    told = next((x for x in prompt.split("\n") if x.startswith("Covered before: ")), "")
    return f"Draft {hashlib.md5(told.encode()).hexdigest()} of a section that is long enough for its concepts to be read from it, namely {_last(prompt)}"


#: Waves of the query of covered concepts.
WAVES = 4


def _wave_entries(spark, sf) -> DataFrame:
    """Conversations as sections of four chapters, about three lettered words of each as evidence; every fifth has none."""
    words = F.filter(F.transform(T.words(F.col("content")), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: F.length(w) > 2)
    rows = _first_turns(spark, sf).withColumn("prompt", F.lit("g")).withColumn("evidence", F.when(F.col("section_pos") % 5 > 0, F.array_join(F.slice(words, 1, 3), " ")))
    return rows.select(F.col("section_pos").cast("int").alias("section_pos"), "parent", "folder", "prompt", "evidence")


def _waves(spark, sf, which: int) -> DataFrame:
    entries = _wave_entries(spark, sf)
    return waves.write_in_waves(entries, wave_client, together=-(-entries.count() // WAVES), polish=False)[which]


@query
def covered_sections(spark, sf):
    """Sections written in four waves, each told what earlier ones have covered."""
    found = _waves(spark, sf, 0)
    return found.select("section_pos", F.md5("content").alias("content_md5"), F.md5("covered").alias("covered_md5"))


@query
def covered_registry(spark, sf):
    """The section that covered each concept first."""
    return _waves(spark, sf, 1).select("concept_key", "concept", "section", F.col("pos.place").alias("place"))


@query
def condensed_texts(spark, sf):
    """Labels as lines, condensed level by level until one prompt holds what is left."""
    rows = read_table(spark, sf, "labels").select(F.col("doc_id").alias("place"), F.concat(F.lit("- ["), "doc_id", F.lit("] quality "), "quality", F.lit(", toxic "), "toxic").alias("text"))
    return reduction.condensed(rows, "Condense", digest, 400)


@query
def merged_agenda(spark, sf):
    """Gaps of all themes merged by the model; the last reply is an array."""
    maps = maps_of(spark, sf)
    gaps = maps.select("theme", F.posexplode("gaps").alias("i", "g")).select(F.struct("theme", "i").alias("pos"), "theme", "g.description", "g.priority")
    return synthesis.consolidated_agenda(gaps, lambda p, o: f'[{{"description": "{digest(p, o)}", "priority": "alta"}}, {{"description": ""}}]' if p.startswith("Merge these") else digest(p, o), budget=900)


@query
def critical_prompts(spark, sf):
    """What a critical analysis is told of the studies of a section: benchmark texts of customers' nations."""
    rows = read_table(spark, sf, "benchmark")
    i = F.col("item_id")
    tags = rows.select(F.lit("p").alias("parent"), (i % 3).cast("string").alias("folder"), F.concat(F.lit("s"), (i % 25).cast("string")).alias("study_pmid"), (i * 7 % 101 / 128).alias("similarity"), i.cast("string").alias("chunk_id"))
    chunks = rows.select(i.cast("string").alias("chunk_id"), "text")
    nations = read_table(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("pmid"), "n_nationkey", "n_name")
    k = F.col("n_nationkey")
    people = nations.select("pmid", F.when(k % 4 > 0, F.col("n_name")).alias("authors"), F.when(k % 3 > 0, 2000 + k).cast("int").alias("year"))
    extracted = nations.where("n_nationkey < 20").select("pmid", F.lit("d").alias("study_design"), F.lit(None).cast("double").alias("effect_size"), F.when(k % 2 == 0, "pilot").otherwise("").alias("study_scale"), F.when(k % 5 == 0, "public").alias("funding_source"))
    risk = nations.where("n_nationkey > 4").select("pmid", F.when(k % 2 == 0, "low").otherwise("high").alias("overall_rating"))
    return synthesis.study_lines(tags, chunks, people, extracted, risk, 10).select("parent", "folder", F.md5("studies").alias("studies_md5"))


@query
def reviewed_drafts(spark, sf):
    """Model scores of first turns blended with their gates; some calls fail, some drafts are empty."""
    rows = _first_turns(spark, sf).select(F.col("section_pos").cast("string").alias("key"), F.when(F.col("section_pos") % 9 > 0, F.concat(F.when(F.col("section_pos") % 2 == 0, "12 K").otherwise("12 K or 13 K"), F.lit(" [chunk:0000000"), F.col("section_pos") % 3, F.lit("] "), F.regexp_replace("content", r"[\d\[\]]", ""))).otherwise(" ").alias("content"))
    about = rows.select("key", F.lit("t").alias("theme"), F.lit("a thesis").alias("thesis"), F.array(F.lit("the"), F.lit("und")).alias("forbidden_terms"))
    flags = spark.createDataFrame([("high", ["00000001"]), ("medium", ["00000002"])], "severity string, related_ids array<string>")

    def client(prompt: str, options: dict) -> str:
        if len(prompt) % 7 == 0:
            raise OSError("no answer")
        return f'{{"overall_score": {len(prompt) % 11}, "overall_feedback": "f"}}'

    found = agents.reviewed(rows, about, flags, "(none)", client)
    return found.select("key", "score", F.md5("feedback").alias("feedback_md5"), F.col("physics_high_flag_hits").cast("long").alias("high_flags"))


def _claim(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {oracle.q('(?i)' + lexicon.QUANTITY)}) THEN 'quant' WHEN regexp_matches({text}, {oracle.q('(?i)' + lexicon.COMPARISON)}) THEN 'qual' END"


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_FIRST = "f AS (SELECT conv_id, min(text) AS t FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn = m GROUP BY conv_id), sec AS (SELECT conv_id AS section_pos, 'p' || (conv_id % 4) AS parent, 'Part ' || conv_id AS folder, t AS content FROM f)"
_PHRASED = f"ph AS (SELECT doc_id AS pos, p[(doc_id % {len(PHRASES)} + 1)::INT] || '. ' || p[(doc_id // 3 % {len(PHRASES)} + 1)::INT] || ' ' || CASE WHEN doc_id % 2 = 0 THEN p[(doc_id // 7 % {len(PHRASES)} + 1)::INT] ELSE '' END AS t FROM (SELECT doc_id, {oracle.terms(PHRASES)} AS p FROM labels))"
_STUDIES = f"WITH {oracle.STUDIES}"
_LAST = lambda x: f"string_split({x}, chr(10))[-1]"
_I = "doc_id"
_NINE = (
    ("low_eligibility", "doc_id % 11 = 0"), ("min_similarity", "doc_id % 13 = 0"), ("missing_chunk", "doc_id % 17 = 0"), ("high_flags", "doc_id % 5 = 0"), ("allowed_domains", "doc_id % 19 = 0"), ("foreign_domain_ratio", "doc_id % 23 = 0"),
    ("required_phase_regimes", "doc_id % 7 = 0"), ("forbidden_terms", "doc_id % 29 = 0"), ("required_any_terms", "doc_id % 3 <> 0"),
)

_SECTIONS = rf"""{_FIRST}, e0 AS (SELECT section_pos, parent, folder, CASE WHEN section_pos % 5 = 0 THEN '' ELSE array_to_string(list_filter(list_transform({_WORDS.replace('text', 'content')}, lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: length(w) > 2)[1:3], ' ') END AS evidence FROM sec),
        e1 AS (SELECT *, min(section_pos) OVER (PARTITION BY parent) AS pp, count(*) OVER () AS n FROM e0), e AS (SELECT *, row_number() OVER (ORDER BY pp, section_pos) AS place FROM e1),
        wv AS (SELECT *, (place - 1) // CAST(ceil(n / {WAVES}) AS BIGINT) AS wave, ' of a section that is long enough for its concepts to be read from it, namely ' AS said FROM e),
        cs AS (SELECT place, wave, parent || ' / ' || folder AS section, list_filter(list_transform(string_split(array_to_string(string_split(said || evidence, ' ')[-3:], ', ') || ',', ','), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 120) AS xs FROM wv WHERE evidence <> ''),
        ci AS (SELECT place, wave, section, unnest(xs) AS concept, generate_subscripts(xs, 1) AS i FROM cs),
        reg AS (SELECT lower(concept) AS concept_key, concept, section, place, wave FROM ci QUALIFY row_number() OVER (PARTITION BY lower(concept) ORDER BY place, i) = 1)"""
_LEVELS = lambda base, task, budget: f"""RECURSIVE base AS ({base}), lv AS (SELECT 0 AS level, CAST(row_number() OVER (ORDER BY place, text) AS BIGINT) AS place, text FROM base UNION ALL
        SELECT level + 1, batch, md5('{task}' || chr(10) || string_agg(text, chr(10) ORDER BY place)) FROM (SELECT *, CAST((sum(length(text)) OVER (ORDER BY place) - length(text)) // {budget} AS BIGINT) AS batch, sum(length(text)) OVER () AS size, count(*) OVER () AS n FROM lv) WHERE size > {budget} AND n > 1 GROUP BY level, batch),
        last AS (SELECT string_agg(text, chr(10) ORDER BY place) AS text FROM lv WHERE level = (SELECT max(level) FROM lv))"""  # noqa: E731
_GAPS = """SELECT CAST(doc_id AS VARCHAR) AS place, '- [' || CASE WHEN doc_id % 7 = 0 THEN 'high' ELSE 'low' END || '] (' || doc_id || '): ' || CASE WHEN doc_id % 7 = 0 THEN 'No evidence for this theme.' WHEN doc_id % 5 = 0 THEN 'The synthesis could not be read.' ELSE 'd' END AS text FROM labels"""

SQL |= {
    "chapter_theses": rf"""WITH w AS (SELECT conv_id, turn, array_to_string({_WORDS}[1:3], ' ') AS x FROM conversations), g AS (SELECT conv_id, arg_max('- ' || x, (turn, x)) AS l FROM w GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS parent, CASE WHEN conv_id % 3 = 0 OR length(l) % 5 = 0 THEN '{compose.NO_THESIS}' ELSE {oracle.strip('l')} END AS thesis FROM g""",
    "section_drafts": rf"""WITH {_FIRST}, e AS (SELECT *, 'Draft: ' || array_to_string({_WORDS.replace('text', 'content')}[1:6], ' ') AS d FROM sec)
        SELECT section_pos, parent, folder, md5(CASE WHEN section_pos % 3 = 0 THEN 'No direct evidence. Guidance: g' WHEN length(d) % 4 = 0 THEN d ELSE translate(d, '{LOWER}', '{UPPER}') END) AS content_md5 FROM e""",
    "executive_summary": f"""WITH {_FIRST}, p AS (SELECT * FROM sec ORDER BY section_pos LIMIT {compose.LEADING})
        SELECT md5('Write an executive summary of this review.' || chr(10) || 'Title: T' || chr(10) || string_agg('## ' || parent || chr(10) || '### ' || folder || chr(10) || substr(content, 1, {compose.PREVIEW}) || '...', chr(10) ORDER BY section_pos)) AS summary FROM p""",
    "post_processed": rf"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 2 ELSE 3 END AS level, 'turn ' || turn AS heading, {oracle.strip("replace(text, '#', '')")} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS section_no FROM conversations),
        c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY conv_id ORDER BY section_no) AS ch, len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS nw FROM p),
        r AS (SELECT *, CASE WHEN level = 3 AND nw >= 20 THEN body || ' refined' ELSE body END AS b1 FROM c),
        d AS (SELECT *, level = 3 AND b1 <> '' AS own, sum((level = 3 AND b1 <> '')::INT) OVER (PARTITION BY conv_id, ch) AS n FROM r),
        o AS (SELECT *, CASE WHEN own AND n >= 2 THEN replace(b1, ' refined', ' once') ELSE b1 END AS b2 FROM d),
        l AS (SELECT *, max(CASE WHEN own THEN section_no END) OVER (PARTITION BY conv_id, ch) AS last, sum(CASE WHEN own THEN 4 + length(heading) + 2 + length(b2) ELSE 0 END) OVER (PARTITION BY conv_id, ch) + 2 * (n - 1) AS size FROM o),
        z AS (SELECT *, CASE WHEN own AND n >= 2 AND section_no = last AND size % 2 = 0 THEN b2 || ' coherent' ELSE b2 END AS b3 FROM l)
        SELECT conv_id, section_no, heading, md5({oracle.strip(r"regexp_replace(b3, '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")}) AS body_md5 FROM z""",
    "contradiction_checks": f"""WITH c AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 's0' ELSE 'Author ' || (item_id % 5) END AS who, substr(text, 1, {compose.EXCERPT}) AS x FROM benchmark),
        p AS (SELECT a.item_id AS i, a.who AS study_a, b.who AS study_b, md5({_LAST("b.who || ': ' || b.x")}) AS m, a.item_id || ',' || b.item_id AS ids FROM c a JOIN c b ON b.item_id = a.item_id + 1)
        SELECT 'p' AS parent, 'f' AS folder, CAST(i AS INTEGER) AS pair, m AS point, study_a, study_b, 'c' AS possible_cause, ids FROM p WHERE m[1] IN ('0', '1', '2', '3', '4')""",
    "theme_theses": """WITH m AS (SELECT doc_id, doc_id % 7 = 0 AS none, doc_id % 5 = 0 AS bad FROM labels),
        l AS (SELECT doc_id, CASE WHEN none THEN '- [high] No evidence for this theme.' WHEN bad THEN '- [low] The synthesis could not be read.' ELSE '- [low] d' END AS g FROM m)
        SELECT CAST(doc_id AS VARCHAR) AS theme, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 't ' || g END AS thesis, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'a,b' END AS priorities, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'g:1' END AS groups FROM l""",
    "synthesis_dispatch": f"""WITH r AS (SELECT (c_acctbal / 1000)::DOUBLE AS es, c_acctbal / 1000 - c_nationkey / 10 - 0.1 AS lo, c_acctbal / 1000 + c_nationkey / 10 + 0.1 AS hi FROM customer), w AS (SELECT es, pow((hi - lo) / (2 * {oracle.H.Z95}), -2)::DOUBLE AS w FROM r),
        m AS (SELECT *, sum(w * es) OVER () / sum(w) OVER () AS mu FROM w), a AS (SELECT any_value(mu) AS mu, sum(w) AS sw, sum(w * w) AS sww, sum(w * (es - mu) * (es - mu)) AS q, count(*) AS k FROM m),
        few AS (SELECT md5('Identify the themes of these studies, where they agree and where they do not.' || chr(10) || string_agg('- [' || item_id || '] d: ' || md5(text) || ' → ', chr(10) ORDER BY CAST(item_id AS VARCHAR))) AS summary, count(*) AS k FROM benchmark)
        SELECT 'meta-analysis' AS type, k, {oracle.sig('mu')} AS pooled_effect, {oracle.sig('1 / sqrt(sw)')} AS pooled_se, {oracle.sig(f'mu - {oracle.H.Z95} / sqrt(sw)')} AS ci_lower, {oracle.sig(f'mu + {oracle.H.Z95} / sqrt(sw)')} AS ci_upper, {oracle.sig('q')} AS q,
          {oracle.sig('CASE WHEN q > 0 THEN greatest(0, (q - greatest(k - 1, 1)) / q * 100) ELSE 0 END')} AS i_squared, {oracle.sig('CASE WHEN q > greatest(k - 1, 1) THEN greatest(0, (q - greatest(k - 1, 1)) / (sw - sww / sw)) ELSE 0 END')} AS tau_squared, NULL AS summary FROM a
        UNION ALL SELECT 'thematic', k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, summary FROM few""",
    "manuscript_texts": """WITH s AS (SELECT string_agg('- PMID ' || item_id || ': ' || md5(text) || ', effect=' || CASE WHEN item_id % 2 = 0 THEN printf('%.3f', item_id / 8) ELSE 'none' END, chr(10) ORDER BY CAST(item_id AS VARCHAR)) AS rows FROM benchmark), n AS (SELECT chr(10) AS n, 'Topic: t' AS t, 'Retrieved 9, after deduplication 8, included 7' AS f, rows FROM s)
        SELECT 'introduction' AS name, md5('Write the introduction of a systematic review, without invented references.' || n || t || n || 'population: p; intervention: ; comparison: ; outcome: ') AS text FROM n
        UNION ALL SELECT 'methods', md5('Write its methods.' || n || 'Query: q' || n || f) FROM n UNION ALL SELECT 'results', md5('Write its results from these data only.' || n || rows || n || 'S') FROM n
        UNION ALL SELECT 'discussion', md5('Write its discussion.' || n || t || n || f || n || 'S') FROM n""",
    "table_proposals": rf"""WITH {_FIRST} SELECT parent, folder, 'table_' || replace(lower(folder), ' ', '_') AS table_id, 'c' AS caption,
        md5('**c**' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| x\|y | {{"k":1}} |' || chr(10) || '| — | — |' || chr(10) || chr(10) || '*Sources: S1; S2*') AS markdown_md5 FROM sec WHERE length(content) >= 200 AND length({_LAST('content')}) % 3 = 0""",
    "review_reports": """WITH r AS (SELECT doc_id, doc_id % 9 = 0 AS e, doc_id % 4 <> 1 AS ok FROM labels)
        SELECT doc_id, CASE WHEN e THEN 10.0 WHEN ok THEN (doc_id % 11)::DOUBLE ELSE 7.0 END::DOUBLE AS score, CASE WHEN e THEN '' WHEN ok THEN 'f' ELSE 'Well: {"overall_score": ' || (doc_id % 11) || ', "hedging": {"score": 4.5, "comment": "h"}, "redundancy": {"comment": "r"}, "overall_feedback": "f"}' END AS overall_feedback,
          CASE WHEN ok AND NOT e THEN 4.5 ELSE 0.0 END::DOUBLE AS hedging, CASE WHEN ok AND NOT e THEN 'h' ELSE '' END AS hedging_comment, 0.0::DOUBLE AS redundancy, CASE WHEN ok AND NOT e THEN 'r' ELSE '' END AS redundancy_comment, 0.0::DOUBLE AS depth FROM r""",
    "measured_ranges": """WITH v AS (SELECT doc_id AS pos, [(200 + doc_id % 130) + (doc_id % 10) / 10, (doc_id % 60 - 40) + 273.15] AS t, [CASE WHEN doc_id % 3 = 0 THEN (doc_id % 12 + 0.5) * 10 ELSE doc_id % 90 END, (doc_id % 700) * 0.01] AS p FROM labels)
        SELECT pos, round(list_min(t), 3)::DOUBLE AS t_min, round(list_max(t), 3)::DOUBLE AS t_max, round(list_min(p), 3)::DOUBLE AS p_min, round(list_max(p), 3)::DOUBLE AS p_max, 0.4::DOUBLE AS confidence FROM v""",
    "phase_flag_counts": f"""WITH v AS (SELECT doc_id, doc_id % 5 AS k, greatest((200 + doc_id % 130) + (doc_id % 10) / 10, (doc_id % 60 - 40) + 273.15) AS t, least(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 12 + 0.5) * 10 ELSE doc_id % 90 END, (doc_id % 700) * 0.01) AS lo, greatest(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 12 + 0.5) * 10 ELSE doc_id % 90 END, (doc_id % 700) * 0.01) AS hi FROM labels),
        f AS (SELECT doc_id, unnest([CASE WHEN k = 0 AND t > {lexicon.CO2_TRIPLE_K + lexicon.SOLID_MARGIN_K} THEN 1 END, CASE WHEN k = 1 AND t > {lexicon.NEAR_TRIPLE_MAX_K} THEN 1 END, CASE WHEN k = 1 AND lo < {lexicon.NEAR_TRIPLE_MIN_BAR} THEN 0 END, CASE WHEN k = 2 AND t < {lexicon.CO2_CRITICAL_K} THEN 1 END,
          CASE WHEN k = 2 AND hi < {lexicon.CO2_CRITICAL_BAR} THEN 1 END, CASE WHEN k = 3 AND t < {lexicon.CO2_CRITICAL_K} AND hi < {lexicon.CO2_CRITICAL_BAR} THEN 1 END]) AS h FROM v)
        SELECT CAST(doc_id AS VARCHAR) AS paper_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS n_high FROM f WHERE h IS NOT NULL GROUP BY doc_id""",
    "claims_found": """SELECT doc_id, 'The yield of sample ' || (doc_id % 50) || ' rose to 45 K in the second run.' AS claim, 'quant' AS claim_type FROM labels UNION ALL SELECT doc_id, 'It was much higher than all that came before it.', 'qual' FROM labels""",
    "text_cleanups": r"""WITH t AS (SELECT doc_id, substr(replace(replace(text, '(', ''), ')', ''), 1, 200) AS x FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(chr(10) || 'See (Doe, 2020; Roe, 2021) on catálise C12 C and ' || x || '/C45' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'end', '/C\d+', '', 'g'), '\bC(\d+)\s+C\b', '\1 C', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS text_md5 FROM t""",
    "thermo_cleanups": """SELECT doc_id, (['Sublimation is endothermic here.', 'Deposition is exothermic!', 'A sublimação é endotérmico?', 'Sublimation is endothermic.'])[(doc_id % 4 + 1)::INT] || chr(10) || chr(10) || (['All is well.', 'A deposição é exotérmico.'])[(quality + 1)::INT] AS text,
        CAST((doc_id % 4 < 3)::INT + quality AS INTEGER) AS fixes FROM labels""",
    "writing_order": """WITH s AS (SELECT n_nationkey::INT AS section_pos, CAST(n_regionkey AS VARCHAR) AS parent, 'f' || (n_nationkey % 7) AS folder FROM nation) SELECT section_pos, parent, folder, min(section_pos) OVER (PARTITION BY parent) AS parent_pos, max(section_pos) OVER (PARTITION BY folder) AS folder_pos FROM s""",
    "evidence_packages": """WITH c AS (SELECT item_id, CAST(item_id % 2 AS VARCHAR) AS folder, item_id * 7 % 1009 AS r, text, item_id % 5 AS k FROM benchmark), l AS (SELECT folder, r, item_id, '[chunk:' || item_id || '] ' || CASE k WHEN 0 THEN '(s0)' WHEN 1 THEN '(Author 1, 2001)' WHEN 2 THEN '(Author 2)' WHEN 3 THEN '(Author 3, 2003)' ELSE '(s4)' END || ' ' || text AS line FROM c)
        SELECT 'p' AS parent, folder, CAST(count(*) AS INTEGER) AS n_evidence, md5(string_agg(line, chr(10) || chr(10) ORDER BY r, line)) AS evidence_md5 FROM l GROUP BY folder""",
    "outlined_quality": f"""WITH {_FIRST}, h AS (SELECT parent || ' / ' || folder AS section_id, CASE WHEN section_pos % 2 = 0 THEN list_filter(['the', 'AND', 'zzz'], lambda z: contains(lower(content), lower(z))) ELSE []::VARCHAR[] END AS h FROM sec)
        SELECT section_id, array_to_string(h, ',') AS hits, round(greatest(0, 1 - len(h) / 3), 3)::DOUBLE AS cross_topic_contamination_score FROM h""",
    "evidence_rows": """WITH t AS (SELECT CAST(doc_id % 3 AS VARCHAR) AS folder, doc_id % 40 AS s, doc_id * 13 % 101 / 128 AS sim, CAST(doc_id AS VARCHAR) AS c FROM labels), b AS (SELECT folder, s, max(sim) AS sim, arg_min(c, (-sim, c)) AS chunk_id FROM t GROUP BY folder, s)
        SELECT 'p' AS parent, folder, CAST(s AS VARCHAR) AS pmid, chunk_id, sim::DOUBLE AS similarity, CASE WHEN s < 30 THEN 'd' || (s % 4) END AS study_design, CASE WHEN s < 30 THEN s / 4 END::DOUBLE AS effect_size, CASE WHEN s < 20 THEN CASE WHEN s % 2 = 0 THEN 'low' ELSE 'high' END END AS overall_rating,
          CAST(row_number() OVER (PARTITION BY folder ORDER BY sim DESC, CAST(s AS VARCHAR)) AS INTEGER) AS rank FROM b QUALIFY rank <= 20""",
    "extraction_replies": """SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 > 0 THEN 'rct' END AS study_design, CASE WHEN doc_id % 3 > 0 THEN '' END AS population, CASE WHEN doc_id % 3 > 0 THEN doc_id % 500 END::INT AS sample_size, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 + 0.25 END::DOUBLE AS effect_size, NULL::DOUBLE AS ci_lower, CASE WHEN doc_id % 3 = 0 THEN 'no JSON' END AS raw FROM labels""",
    "query_replies": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'adults' ELSE '' END AS population, '' AS intervention, '' AS comparison, CASE WHEN doc_id % 3 = 1 THEN 'o' ELSE '' END AS outcome, CASE doc_id % 3 WHEN 0 THEN 'a AND b' || doc_id WHEN 1 THEN 'q' || doc_id ELSE 'plain words ' || doc_id END AS query FROM labels""",
    "concept_replies": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'one|c' || doc_id WHEN 1 THEN 'a b|c' || doc_id WHEN 2 THEN 'first ' || doc_id || '|second|third' ELSE 'left|right|c' || doc_id END AS concepts FROM labels""",
    "latex_documents": rf"""WITH w AS (SELECT conv_id, turn, '\textit{{w' || regexp_replace(coalesce({_WORDS}[1], ''), '[^A-Za-z]', '', 'g') || '}} \& 5 \% \textbf{{' || turn || '}}' AS x FROM conversations),
        l AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '\title{{' || x || '}}' WHEN turn % 4 = 1 THEN '\subsection{{' || x || '}}' WHEN turn % 4 = 2 THEN '\begin{{itemize}}' || chr(10) || '  \item ' || x || chr(10) || '\end{{itemize}}' WHEN turn % 4 = 3 THEN x ELSE '\subsection*{{References ' || x || '}}' END AS y FROM w)
        SELECT conv_id, md5('\documentclass[12pt,a4paper]{{article}}' || chr(10) || '\usepackage[utf8]{{inputenc}}' || chr(10) || '\usepackage[T1]{{fontenc}}' || chr(10) || '\usepackage[english]{{babel}}' || chr(10) || '\usepackage{{booktabs,graphicx,hyperref}}' || chr(10) || max(y) FILTER (turn = 0) || chr(10) || '\begin{{document}}' || chr(10) || '\maketitle'
          || chr(10) || '\tableofcontents' || chr(10) || '\newpage' || chr(10) || chr(10) || coalesce(string_agg(y, chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0), '') || chr(10) || chr(10) || '\end{{document}}' || chr(10)) AS latex_md5 FROM l GROUP BY conv_id""".replace("\\\\", "\\"),
    "model_screening": f"""{_STUDIES}, n AS (SELECT pos, pmid, {len("Does this study fit the question? Answer in JSON with decision, confidence and justification.") + 1 + len("population: p") + 1 + len("intervention: i") + 1 + len("comparison: c") + 1 + len("outcome: o") + len(" Title: ") + len(" Abstract: ")} + length(title) + length(abstract) AS n FROM studies),
        c AS (SELECT *, n % 7 = 0 AS bad, n % 3 AS k, n % 90 + 10 AS c FROM n)
        SELECT pos, pmid, CASE WHEN bad THEN 'ambiguous' WHEN c >= 75 AND k = 0 THEN 'include' WHEN c <= 25 OR k = 1 THEN 'exclude' ELSE 'ambiguous' END AS decision, CASE WHEN bad THEN 50 ELSE c END AS confidence, CASE WHEN bad THEN '' ELSE 'n ' || n END AS justification FROM c""",
    "extraction_stage": f"""WITH n AS (SELECT item_id, {len("Extract design, population, sample size and effect of this study as JSON. Title: t Abstract: ")} + length(text) AS x, {len("Rate the risk of bias of this study by domain, as a JSON array. Title: t Abstract: ")} + length(text) AS r FROM benchmark)
        SELECT CAST(item_id AS VARCHAR) AS pmid, CASE WHEN x % 4 > 0 THEN 'd' || (x % 5) END AS study_design, CASE WHEN x % 4 > 0 THEN x END::INT AS sample_size, x % 4 > 0 AS read, CASE r % 3 WHEN 0 THEN 'high' ELSE 'moderate' END AS overall_rating FROM n""",
    "default_labels": f"""WITH {_PHRASED} SELECT pos, {", ".join(f"array_to_string({oracle.labels('t', table)}, ',') AS {name}" for name, table in (("domains", lexicon.DOMAINS), ("fluids", lexicon.FLUIDS), ("phases", lexicon.PHASES), ("topologies", lexicon.TOPOLOGIES)))} FROM ph""",
    "default_scope": f"""WITH {_PHRASED}, s AS (SELECT pos, list_sort(list_filter([{", ".join(f"CASE WHEN {oracle.any_of('t', p)} THEN {oracle.q(k)} END" for k, p in lexicon.SCOPE_CLUSTERS.items())}], lambda x: x IS NOT NULL)) AS cl, CAST({oracle.count_of('t', lexicon.SCOPE_ANCHORS)} AS INTEGER) AS anchor_hits, CAST({oracle.count_of('t', lexicon.SCOPE_NEGATIVES)} AS INTEGER) AS negative_hits FROM ph)
        SELECT pos, array_to_string(cl, ',') AS clusters, anchor_hits, negative_hits, len(cl) + least(anchor_hits, 3) >= 2 AND NOT ((anchor_hits = 0 AND negative_hits >= 2) OR (anchor_hits > 0 AND negative_hits > 6)) AS in_scope FROM s""",
    "forest_plot_rows": f"""WITH r AS (SELECT c_custkey, (c_acctbal / 1000)::DOUBLE AS e, CASE WHEN c_nationkey < 20 THEN c_acctbal / 1000 + c_nationkey END::DOUBLE AS hi FROM customer WHERE c_nationkey < 20), w AS (SELECT *, pow(CASE WHEN hi - e <= 0 THEN 1e-6 ELSE (hi - e) / (2 * {oracle.H.Z95}) END, -2) AS wt FROM r)
        SELECT CAST(c_custkey AS VARCHAR) AS label, {oracle.sig('e')} AS effect, {oracle.sig('e')} AS ci_lower, {oracle.sig('hi')} AS ci_upper, {oracle.sig('wt')} AS weight FROM w""",
    "gate_reasons": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in _NINE) + " END AS reason FROM labels",
    "covered_sections": rf"""WITH {_SECTIONS}, told AS (SELECT w.wave, string_agg(concept || ' (see: ' || section || ')', '; ' ORDER BY concept, section) AS covered FROM (SELECT DISTINCT wave FROM wv) w JOIN (SELECT w.wave AS of, reg.* FROM (SELECT DISTINCT wave FROM wv) w JOIN reg ON reg.wave < w.wave QUALIFY row_number() OVER (PARTITION BY w.wave ORDER BY concept, section) <= {waves.SHOWN}) r ON r.of = w.wave GROUP BY w.wave)
        SELECT CAST(section_pos AS INTEGER) AS section_pos, md5('Draft ' || md5(CASE WHEN evidence <> '' AND covered IS NOT NULL THEN 'Covered before: ' || covered ELSE '' END) || said || CASE WHEN evidence = '' THEN 'Guidance: g' ELSE evidence END) AS content_md5, md5(coalesce(covered, '')) AS covered_md5 FROM wv LEFT JOIN told USING (wave)""",
    "covered_registry": rf"""WITH {_SECTIONS} SELECT concept_key, concept, section, CAST(place AS INTEGER) AS place FROM reg""",
    "condensed_texts": f"""WITH {_LEVELS("SELECT doc_id AS place, '- [' || doc_id || '] quality ' || quality || ', toxic ' || toxic AS text FROM labels", "Condense", 400)} SELECT text FROM last""",
    "merged_agenda": f"""WITH {_LEVELS(_GAPS, "Merge gaps that are alike. Keep a line for each, with its priority.", 900)}
        SELECT CAST(1 AS INTEGER) AS rank, md5('Merge these gaps into one agenda, highest priority first, as a JSON array of objects with description, priority and suggested_approach.' || chr(10) || text) AS description, 'alta' AS priority, '' AS suggested_approach FROM last""",
    "critical_prompts": f"""WITH t AS (SELECT CAST(item_id % 3 AS VARCHAR) AS folder, item_id % 25 AS k, item_id * 7 % 101 / 128 AS sim, CAST(item_id AS VARCHAR) AS c, substr(text, 1, {synthesis.SHOWN}) AS x FROM benchmark), b AS (SELECT folder, k, 's' || k AS pmid, max(sim) AS sim, arg_min(x, (-sim, c)) AS x FROM t GROUP BY folder, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY sim DESC, pmid) AS rank FROM b),
        l AS (SELECT folder, rank, '--- (' || CASE WHEN k % 4 > 0 THEN n_name ELSE pmid END || ', ' || CASE WHEN k % 3 > 0 THEN CAST(2000 + k AS VARCHAR) ELSE 'n.d.' END || ') | Scale: ' || CASE WHEN k < 20 AND k % 2 = 0 THEN 'pilot' ELSE 'unknown' END || ' | RoB: ' || CASE WHEN k <= 4 THEN 'unclear' WHEN k % 2 = 0 THEN 'low' ELSE 'high' END
          || ' | Funding: ' || CASE WHEN k < 20 AND k % 5 = 0 THEN 'public' ELSE 'unknown' END || ' ---' || chr(10) || x AS line FROM r JOIN nation ON n_nationkey = k WHERE rank <= 10)
        SELECT 'p' AS parent, folder, md5(string_agg(line, chr(10) || chr(10) ORDER BY rank)) AS studies_md5 FROM l GROUP BY folder""",
    "reviewed_drafts": rf"""WITH {_FIRST}, d AS (SELECT section_pos AS i, CASE WHEN section_pos % 9 = 0 THEN ' ' ELSE CASE WHEN section_pos % 2 = 0 THEN '12 K' ELSE '12 K or 13 K' END || ' [chunk:0000000' || (section_pos % 3) || '] ' || regexp_replace(content, '[\d\[\]]', '', 'g') END AS c FROM sec),
        g AS (SELECT i, c, length('Score this section from 0 to 10 as JSON with overall_score, overall_feedback and a score and comment for each criterion.' || chr(10) || 'Thesis: a thesis' || chr(10) || 'Approved before:' || chr(10) || '(none)' || chr(10) || substr(c, 1, {agents.DRAFT})) AS n, i % 9 = 0 AS e,
          round(1 - len(list_filter(['the', 'und'], lambda z: contains(lower(c), z))) / 3, 3) AS con, (i % 9 > 0 AND i % 3 = 1)::BIGINT AS h, CASE WHEN i % 9 = 0 OR i % 2 = 0 THEN 1.0 ELSE 0.5 END AS gr FROM d),
        s AS (SELECT *, 10 * (con + (1 - 0.25 * h) + gr)::DOUBLE / 3 AS gate FROM g)
        SELECT CAST(i AS VARCHAR) AS key, CASE WHEN e THEN {agents.EMPTY} WHEN n % 7 = 0 THEN {agents.FAILED} ELSE round(0.7::DOUBLE * (n % 11) + 0.3::DOUBLE * CASE WHEN h > 0 THEN least(gate, 5.0) ELSE gate END, 2) END::DOUBLE AS score,
          md5(CASE WHEN e THEN '' WHEN n % 7 = 0 THEN 'Review error: no answer' ELSE 'f' || CASE WHEN h > 0 THEN {oracle.q(agents.GUARD)} ELSE '' END END) AS feedback_md5, h AS high_flags FROM s""",
}
