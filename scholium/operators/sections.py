"""Quality of written sections, concepts, agendas and the review's blended score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T


def section_quality(sections: DataFrame, flags: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """One row a section(section_id, content[, forbidden_terms, domain_purity, avg_similarity, foreign_evidence_share]).

    Contamination falls by a third for each forbidden term, physics by a quarter for each high flag that the text
    refers to, table integrity by a fifth for each trace of a broken table. flags(severity, related_ids) are joined
    through the ids that sections refer to.
    """
    defaults = {"forbidden_terms": F.array().cast("array<string>"), "domain_purity": F.lit(1.0), "avg_similarity": F.lit(0.0), "foreign_evidence_share": F.lit(0.0)}
    if outline is not None:
        known = outline.select(T.theme_key(F.col("parent"), F.col("folder")).alias("section_id"), F.col("forbidden_terms").alias("o")).dropDuplicates(["section_id"])
        sections = sections.join(known, "section_id", "left").withColumn("forbidden_terms", F.coalesce("o", defaults["forbidden_terms"])).drop("o")
    for name, value in defaults.items():
        if name not in sections.columns:
            sections = sections.withColumn(name, value)
    text = T.text_or_empty(F.col("content"))
    rows = sections.select("section_id", T.forbidden(text, F.col("forbidden_terms")).alias("forbidden_term_hits"), T.grounding(text).alias("grounding_score"), T.corruption_tokens(text).alias("table_corruption_tokens"), T.references(text).alias("refs"), "domain_purity", "avg_similarity", "foreign_evidence_share")
    high = flags.where("severity = 'high'").select(F.monotonically_increasing_id().alias("flag"), F.explode("related_ids").alias("id"))
    hits = rows.select("section_id", F.explode("refs").alias("id")).distinct().join(high, "id").groupBy("section_id").agg(F.count_distinct("flag").alias("hits"))
    rows = rows.join(hits, "section_id", "left")
    n = F.coalesce("hits", F.lit(0))
    floor = lambda x: F.round(F.greatest(F.lit(0.0), x), 3)
    share = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))), 3)
    return rows.select(
        "section_id", "forbidden_term_hits", floor(1 - F.size("forbidden_term_hits") / 3).alias("cross_topic_contamination_score"), n.alias("physics_high_flag_hits"), floor(1 - 0.25 * n).alias("physics_consistency_score"), "grounding_score",
        share("domain_purity").alias("domain_purity"), floor(F.col("avg_similarity")).alias("avg_similarity"), share("foreign_evidence_share").alias("foreign_evidence_share"), "table_corruption_tokens",
        floor(1 - F.size("table_corruption_tokens") / 5).alias("table_integrity_score"),
    )


def quality_summary(quality: DataFrame) -> DataFrame:
    """One row of averages; without sections 1, and 0 for foreign evidence."""
    mean = lambda c, empty=1.0: F.round(F.coalesce(F.avg(c), F.lit(empty)), 3)
    return quality.agg(
        F.count("*").alias("sections"), mean("cross_topic_contamination_score").alias("avg_cross_topic_contamination_score"), mean("physics_consistency_score").alias("avg_physics_consistency_score"), mean("grounding_score").alias("avg_grounding_score"),
        mean("domain_purity").alias("avg_domain_purity"), mean("avg_similarity").alias("avg_similarity"), mean("foreign_evidence_share", 0.0).alias("avg_foreign_evidence_share"), F.count_if(F.size("table_corruption_tokens") > 0).alias("sections_with_corruption"),
    )


def blended_score(model: Column, contamination: Column, physics: Column, grounding: Column, high_flags: Column, allowed: int = 0) -> Column:
    """0.7 of the model's score and 0.3 of ten times the mean gate, which high flags hold at 5."""
    gate = 10 * (contamination + physics + grounding) / 3
    return F.round(0.7 * model + 0.3 * F.when(high_flags > allowed, F.least(gate, F.lit(5.0))).otherwise(gate), 2)


def register_concepts(mentions: DataFrame) -> DataFrame:
    """(concept_key, concept, section, pos): of mentions(pos, concept, section) the first of each concept, regardless of
    case, accents and white space; blank ones are left out."""
    keyed = mentions.withColumn("concept_key", T.concept_key(F.col("concept"))).where("concept_key <> ''")
    return keyed.groupBy("concept_key").agg(F.min(F.struct("pos", "concept", "section")).alias("f")).select("concept_key", "f.concept", "f.section", "f.pos")


def first_by_key(rows: DataFrame, key: Column, order: str = "pos") -> DataFrame:
    """The first row of each key, which is compared trimmed and in lower case."""
    kept = rows.withColumn("_key", F.lower(T.strip(key))).groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return kept.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns))


def research_agenda(gaps: DataFrame, limit: int = 30) -> DataFrame:
    """The first `limit` unlike gaps(pos, description, priority) by priority (high, medium, low, others), then pos."""
    grade = F.when(F.lower("priority").isin("high", "alta"), 0).when(F.lower("priority").isin("medium", "media", "média"), 1).when(F.lower("priority").isin("low", "baixa"), 2).otherwise(3)
    first = first_by_key(gaps.where(F.trim("description") != ""), F.col("description"))
    return first.withColumn("grade", grade).orderBy("grade", "pos").limit(limit).withColumn("rank", F.row_number().over(W.orderBy("grade", "pos"))).drop("grade")


def grounded(consensus: Column, contradictions: Column) -> Column:
    """Every point names a chunk."""
    named = lambda xs: F.forall(F.coalesce(xs, F.array()), lambda x: F.size(x["ids"]) > 0)
    return named(consensus) & named(contradictions)


def needs_debate(contradictions: Column, robustness: Column, least: int = 2) -> Column:
    return (F.size(contradictions) >= least) & (F.lower(robustness) == "baixa")
