"""Synthesis of themes: judged evidence, grounded maps, debates, totals, and texts that come back from a rewrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import meta, reduction, replies
from scholium.operators.dedup import checkpointed
from scholium.operators.sections import grounded

Client = Callable[[str, dict], str]


def judged_evidence(evidence: DataFrame, client: Client, least: float = 0.6, drop_unreadable: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pieces, counts): evidence(parent, folder, rank, chunk_id, citation, prompt, text) after a relevance judge.

    Each chunk of a section is judged once. Irrelevant and unsure pieces go; unreadable replies go too, or leave the
    text as it stands. counts has kept, dropped_irrelevant, dropped_low_confidence and parse_errors for each section;
    a dropped unreadable piece counts as irrelevant as well.
    """
    once = evidence.groupBy("parent", "folder", "chunk_id").agg(F.min_by(F.struct("rank", "citation", "prompt", "text"), "rank").alias("e")).select("parent", "folder", "chunk_id", "e.*")
    question = F.concat_ws("\n", F.lit("Is this excerpt relevant to the section? Answer in JSON with is_relevant, confidence, why, claim, method, findings."), F.concat(F.lit("Section: "), "parent", F.lit(" / "), "folder", F.lit(". "), "prompt"), F.concat("citation", F.lit(" [chunk:"), "chunk_id", F.lit("]")), F.col("text"))
    asked = checkpointed(replies.ask(once, question, client)).withColumn("r", replies.relevance_reply(F.coalesce("reply", F.lit("")), least))
    verdict = F.col("r.verdict")
    stays = (verdict == "kept") | ((verdict == "unreadable") & F.lit(not drop_unreadable))
    body = F.when(verdict == "kept", F.col("r.brief")).otherwise(F.col("text"))
    pieces = asked.where(stays).select("parent", "folder", "rank", "chunk_id", F.concat(F.lit("["), "citation", F.lit("] [chunk:"), "chunk_id", F.lit("]\n"), body).alias("piece"))
    counts = asked.groupBy("parent", "folder").agg(F.count_if(stays).alias("kept"), F.count_if((verdict == "irrelevant") | ((verdict == "unreadable") & F.lit(drop_unreadable))).alias("dropped_irrelevant"), F.count_if(verdict == "low_confidence").alias("dropped_low_confidence"), F.count_if(verdict == "unreadable").alias("parse_errors"))
    return pieces, counts


def evidence_text(pieces: DataFrame) -> DataFrame:
    """(parent, folder, evidence, n_evidence) of judged pieces(parent, folder, rank, piece), in rank order; a section has top-k pieces at most."""
    found = pieces.groupBy("parent", "folder").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("b"))
    return found.select("parent", "folder", F.array_join(F.transform("b", lambda x: x["piece"]), "\n\n").alias("evidence"), F.size("b").alias("n_evidence"))


#: Characters of a study's chunk that a critical analysis is shown.
SHOWN = 600


def study_lines(tags: DataFrame, chunks: DataFrame, studies: DataFrame, extractions: DataFrame, risk: DataFrame, limit: int = 20) -> DataFrame:
    """(parent, folder, studies): the best tags' studies of each section as one text, each with author, year, scale, risk of bias,
    funding and the beginning of its best chunk. tags(parent, folder, study_pmid, similarity, chunk_id); extractions(pmid, study_design,
    effect_size, study_scale, funding_source); risk(pmid, overall_rating). What is not known is `unknown`, `unclear` or `n.d.`"""
    rows = meta.evidence_table(tags, extractions, risk, limit)
    more = extractions.groupBy("pmid").agg(F.max(F.struct("study_scale", "funding_source")).alias("e")).select("pmid", "e.*")
    people = studies.select("pmid", "authors", "year").dropDuplicates(["pmid"])
    rows = rows.join(more, "pmid", "left").join(people, "pmid", "left").join(chunks.select("chunk_id", F.substring("text", 1, SHOWN).alias("x")), "chunk_id")
    known = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    # Fixed value: the line that heads a study in a critical analysis.
    label = F.concat(F.lit("--- ("), F.coalesce(F.nullif(F.col("authors"), F.lit("")), "pmid"), F.lit(", "), known("year", "n.d."), F.lit(") | Scale: "), known("study_scale", "unknown"), F.lit(" | RoB: "), known("overall_rating", "unclear"), F.lit(" | Funding: "), known("funding_source", "unknown"), F.lit(" ---\n"), "x")
    found = rows.select("parent", "folder", "rank", label.alias("l")).groupBy("parent", "folder").agg(F.array_sort(F.collect_list(F.struct("rank", "l"))).alias("b"))
    return found.select("parent", "folder", F.array_join(F.transform("b", lambda x: x["l"]), "\n\n").alias("studies"))


def critical_analyses(lines: DataFrame, client: Client) -> DataFrame:
    """(parent, folder, theme, summary, robustness) of study_lines(): how good the methods of a section's studies are, where they
    differ and how robust the findings are. A failed call leaves the summary empty. Replies are checkpointed."""
    theme = T.theme_key(F.col("parent"), F.col("folder"))
    task = F.concat_ws("\n", F.lit("Judge methods, contradictions and robustness of these studies, as JSON with summary and robustness."), F.concat(F.lit("Theme: "), theme), F.col("studies"))
    asked = checkpointed(replies.ask(lines, task, client)).withColumn("c", replies.critical_reply(T.text_or_empty(F.col("reply"))))
    return asked.select("parent", "folder", theme.alias("theme"), "c.summary", "c.robustness")


def consolidated_agenda(gaps: DataFrame, client: Client, limit: int = 30, budget: int = reduction.BUDGET) -> DataFrame:
    """(rank, description, priority, suggested_approach) of gaps(pos, theme, description, priority): one agenda that the model merges
    from all of them, level by level where they are more than `budget` characters; no rows if its last reply is no JSON array of objects or
    there are no gaps."""
    line = F.concat(F.lit("- ["), "priority", F.lit("] ("), "theme", F.lit("): "), "description")
    parts = gaps.select(F.struct("pos", line.alias("l")).alias("place"), line.alias("text"))
    asked = checkpointed(replies.ask(reduction.condensed(parts, "Merge gaps that are alike. Keep a line for each, with its priority.", client, budget).where("text <> ''"), F.concat_ws("\n", F.lit("Merge these gaps into one agenda, highest priority first, as a JSON array of objects with description, priority and suggested_approach."), "text"), client))
    items = F.from_json(replies.unfenced(F.col("reply")), "array<struct<description:string,priority:string,suggested_approach:string>>")
    items = F.filter(items, lambda x: T.strip(T.text_or_empty(x["description"])) != "")
    return asked.select(F.posexplode(F.slice(items, 1, limit)).alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.description", F.coalesce("x.priority", F.lit("")).alias("priority"), F.coalesce("x.suggested_approach", F.lit("")).alias("suggested_approach"))


def synthesise(packages: DataFrame, client: Client) -> DataFrame:
    """(theme, consensus, contradictions, gaps) of packages(theme, evidence, ids): ungrounded replies get one more try,
    then a single gap of high priority. A failed call counts as an unreadable reply. First replies are checkpointed, so that no
    model is asked again for a lost executor."""
    question = F.concat(F.lit("Synthesise the theme as JSON with consensus_points, contradictions, knowledge_gaps: "), "theme", F.lit("\n"), "evidence")
    parse = lambda df: df.withColumn("m", replies.theme_reply(T.text_or_empty(F.col("reply")), F.col("ids"), F.size("ids")))
    first = checkpointed(parse(replies.ask(packages, question, client).drop("prompt_hash", "error")).withColumn("ok", grounded(F.col("m.consensus"), F.col("m.contradictions"))))
    again = F.concat(question, F.lit("\n\nEvery consensus point and contradiction needs evidence_chunk_ids, and only ids of the evidence."))
    second = parse(replies.ask(first.where("not ok").drop("reply", "m", "ok"), again, client)).withColumn("ok", grounded(F.col("m.consensus"), F.col("m.contradictions")))
    bare = F.struct(F.slice("m.consensus", 1, 0).alias("consensus"), F.slice("m.contradictions", 1, 0).alias("contradictions"), F.array(F.struct(F.lit("No point of this theme names its evidence").alias("description"), F.lit("high").alias("priority"), F.lit("Gather more evidence and synthesise again").alias("suggested_approach"))).alias("gaps"))
    settled = first.where("ok").select("theme", "m").unionByName(second.select("theme", F.when(F.col("ok"), F.col("m")).otherwise(bare).alias("m")))
    return settled.select("theme", "m.*")


def debates(maps: DataFrame, client: Client, least: int = 2) -> DataFrame:
    """(theme, verdict) of maps(theme, contradictions, robustness) that call for a debate: two advocates, then a moderator."""
    from scholium.operators.sections import needs_debate

    rows = maps.where(needs_debate(F.col("contradictions"), F.col("robustness"), least)).withColumn("points", F.array_join(F.transform("contradictions", lambda c: c["point"]), "; "))
    for side in ("for", "against"):
        rows = checkpointed(replies.ask(rows, F.concat(F.lit(f"Argue {side}: "), "points"), client).withColumnRenamed("reply", side).drop("prompt_hash", "error"))
    rows = replies.ask(rows, F.concat_ws("\n", F.lit("Moderate:"), "points", "for", "against"), client)
    return rows.select("theme", F.col("reply").alias("verdict"))


def theme_totals(maps: DataFrame) -> DataFrame:
    """One row: themes, and how many consensus points, contradictions and gaps they have."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"total_{c}")
    return maps.agg(F.count("*").alias("themes"), total("consensus"), total("contradictions"), total("gaps"))


def chapter_questions(sections: DataFrame) -> DataFrame:
    """(parent, questions): the research questions of a chapter's sections, in outline order."""
    found = sections.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("section_pos", "research_questions"))).alias("all"))
    return found.select("parent", F.flatten(F.transform("all", lambda x: x["research_questions"])).alias("questions"))


def take_rewrites(sections: DataFrame, rewritten: DataFrame, least_words: int = 20, least_sections: int = 2) -> DataFrame:
    """sections(chapter, place, heading, body) with the bodies that rewritten(chapter, place, body) brings back.

    A chapter's rewrites count only if there are as many as it has sections, and at least least_sections; each goes
    to the section of its place in order. Sections under least_words keep their body. Headings never change.
    """
    order = W.partitionBy("chapter").orderBy("place")
    ranked = lambda df, c: df.select("*", F.row_number().over(order).alias("r"), F.count("*").over(W.partitionBy("chapter")).alias(c))
    own = ranked(sections, "n")
    new = ranked(rewritten, "m").select("chapter", "r", "m", F.col("body").alias("new"))
    rows = own.join(new, ["chapter", "r"], "left")
    fits = (F.col("n") == F.col("m")) & (F.col("n") >= least_sections) & (F.size(T.words(F.col("body"))) >= least_words)
    return rows.select("chapter", "place", "heading", F.when(F.coalesce(fits, F.lit(False)), F.col("new")).otherwise(F.col("body")).alias("body"))
