"""Sections written in waves along the outline, each told the concepts that all sections of earlier waves have covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import compose, coverage, replies, sections
from scholium.operators.dedup import checkpointed

#: Characters of a section that concepts are read from, the least that it needs for that, and concepts that a prompt is told.
SNIPPET, LEAST, SHOWN = 3_000, 100, 40
TASK = "Name the technical concepts that this text explains, as a JSON array of strings."


def concepts_of(written: DataFrame, client: compose.Client) -> DataFrame:
    """(pos, concept, section) of written(place, section, content): up to 20 concepts of each section's beginning, pos being the
    section's place and the concept's own; short sections and failed calls give none."""
    asked = compose.answered(written.where(F.length("content") >= LEAST), compose.prompt_of(TASK, F.substring("content", 1, SNIPPET)), client)
    return asked.select("section", "place", F.posexplode(replies.concept_list(T.text_or_empty(F.col("reply")))).alias("i", "concept")).select(F.struct("place", "i").alias("pos"), "concept", "section")


def registered(known: DataFrame | None, mentions: DataFrame) -> DataFrame:
    """The registry (concept_key, concept, section, pos) with the concepts of mentions(pos, concept, section) that it lacks: a concept
    stays with the section that covered it first."""
    fresh = sections.register_concepts(mentions)
    return checkpointed(fresh if known is None else known.unionByName(fresh.join(known, "concept_key", "left_anti")))


def covered_text(registry: DataFrame | None, shown: int = SHOWN) -> str:
    """The first `shown` concepts in alphabetical order, each with its section; empty without any."""
    first = [] if registry is None else registry.orderBy("concept", "section").limit(shown).collect()
    return "; ".join(f"{r['concept']} (see: {r['section']})" for r in first)


def write_in_waves(entries: DataFrame, client: compose.Client, together: int = 8, polish: bool = True) -> tuple[DataFrame, DataFrame]:
    """(written, registry) of entries(section_pos, parent, folder, prompt, evidence[, thesis, anchors]).

    Entries are taken in the order in which they are read: chapters as they first appear, sections by the last place of their folder.
    `together` of them at a time are written at once, by as many tasks as Spark gives them; the concepts that a wave covers are registered before
    the next begins, so with 1 every section knows all earlier ones. written has section_pos, parent, folder, content and the
    `covered` text that the section was told. Sections without evidence cover nothing. Waves are checkpointed, no section is
    written twice."""
    ordered = coverage.chapter_order(entries.select("section_pos", "parent", "folder")).select("section_pos", "parent_pos", "folder_pos").withColumn("all", F.lit(0))
    placed = entries.join(coverage.ranked(ordered, ["all"], [F.col("parent_pos"), F.col("folder_pos"), F.col("section_pos")]).select("section_pos", F.col("rank").alias("place")), "section_pos")
    placed = checkpointed(placed)
    written, registry = None, None
    for first in range(1, placed.count() + 1, together):
        wave = placed.where(F.col("place").between(first, first + together - 1)).withColumn("covered", F.lit(covered_text(registry)))
        texts = compose.write_entries(wave, client, polish).join(wave.select("section_pos", "place", "covered", (T.strip(T.text_or_empty(F.col("evidence"))) != "").alias("grounded")), "section_pos")
        texts = checkpointed(texts)
        registry = registered(registry, concepts_of(texts.where("grounded").select("place", F.concat_ws(" / ", "parent", "folder").alias("section"), "content"), client))
        texts = texts.select("section_pos", "parent", "folder", "content", "covered")
        written = texts if written is None else written.unionByName(texts)
    if written is None:
        written = placed.select("section_pos", "parent", "folder", F.lit("").alias("content"), F.lit("").alias("covered"))
        registry = sections.register_concepts(placed.select(F.struct(F.col("place"), F.lit(0).alias("i")).alias("pos"), F.lit("").alias("concept"), F.lit("").alias("section")))
    return written, registry
