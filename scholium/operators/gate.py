"""The evidence gate: ordered tests with a reason for every rejection, ranking, and a guard over each section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T

REASONS = ("low_eligibility", "min_similarity", "missing_chunk", "high_flags", "allowed_domains", "foreign_domain_ratio", "required_phase_regimes", "forbidden_terms", "required_any_terms")


def _limit(c: Column) -> Column:
    """A share as configured; absent or 0 is no limit."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))))


def judge_tags(tags: DataFrame, chunks: DataFrame, sections: DataFrame, profiles: DataFrame, high_ids: DataFrame | None = None, min_eligibility: float = 0.2) -> DataFrame:
    """tags with `reason`, the first test that a tag fails (null: none), and `foreign`, its share of foreign domains.

    tags(chunk_id, parent, folder, similarity, eligibility_score, section_pos), chunks(chunk_id, paper_id, study_pmid,
    text), profiles(paper_id, ...), high_ids(id). Sections are few and sent to all tasks by Spark's own size check;
    chunks, profiles and ids are joined on their keys.
    """
    parts = chunks.select("chunk_id", F.coalesce(F.nullif(F.col("paper_id"), F.lit("")), F.col("study_pmid")).alias("paper"), F.lower("text").alias("low"))
    rows = tags.join(parts, "chunk_id", "left")
    prof = profiles.select(F.col("paper_id").alias("paper"), "domains", "phase_regimes", "keywords", "working_fluids", "system_topologies")
    rows = rows.join(prof, "paper", "left")
    if high_ids is not None:
        ids = high_ids.select("id").distinct()
        rows = rows.join(ids.select(F.col("id").alias("chunk_id"), F.lit(True).alias("high_chunk")), "chunk_id", "left")
        rows = rows.join(ids.select(F.col("id").alias("paper"), F.lit(True).alias("high_paper")), "paper", "left")
        flagged = F.coalesce("high_chunk", "high_paper", F.lit(False))
    else:
        flagged = F.lit(False)
    rules = sections.select(
        "parent", "folder", *(T.clean_terms(F.col(c)).alias(f"r_{c}") for c in ("allowed_domains", "required_phase_regimes", "required_any_terms", "forbidden_terms")),
        F.coalesce("min_similarity", F.lit(0.0)).alias("r_min"), _limit(F.col("max_foreign_domain_ratio")).alias("r_ratio"), _limit(F.col("max_foreign_evidence_share")).alias("r_share"),
    ).dropDuplicates(["parent", "folder"])
    rows = rows.join(rules, ["parent", "folder"], "left")
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(x))
    allowed, phases, required, banned = (F.coalesce(F.col(f"r_{c}"), none) for c in ("allowed_domains", "required_phase_regimes", "required_any_terms", "forbidden_terms"))
    domains = F.array_distinct(low("domains"))
    foreign = F.when(F.size(domains) == 0, 1.0).otherwise(F.size(F.array_except(domains, allowed)) / F.size(domains))
    blob = F.lower(F.concat_ws(" ", *(F.array_join(F.coalesce(F.col(c), none), " ") for c in ("keywords", "working_fluids", "system_topologies", "domains"))))
    hits = lambda text, terms: T.let(text, lambda s: T.let(T.normalised(s), lambda n: F.size(T.holding(s, n, terms)) > 0))
    tests = (
        F.col("eligibility_score") < min_eligibility,
        F.col("similarity") < F.coalesce("r_min", F.lit(0.0)),
        F.col("low").isNull(),
        flagged,
        (F.size(allowed) > 0) & ~F.arrays_overlap(domains, allowed),
        (F.size(allowed) > 0) & (F.size(domains) > 0) & (foreign > F.coalesce("r_ratio", F.lit(1.0))),
        (F.size(phases) > 0) & ~F.arrays_overlap(low("phase_regimes"), phases),
        (F.size(banned) > 0) & hits(F.col("low"), banned),
        (F.size(required) > 0) & ~hits(F.concat_ws("\n", "low", blob), required),
    )
    reason = F.coalesce(*(F.when(t, F.lit(name)) for name, t in zip(REASONS, tests)))
    return rows.select(
        *tags.columns, "paper", reason.alias("reason"), foreign.alias("foreign"), (F.size(allowed) > 0).alias("has_domains"), (F.size(domains) > 0).alias("profiled"),
        F.arrays_overlap(domains, allowed).alias("on_topic"), F.coalesce("r_share", F.lit(1.0)).alias("share_limit"), F.col("low").isNotNull().alias("has_chunk"),
    )


def rank_tags(judged: DataFrame, top_k: int | None = None) -> DataFrame:
    """Tags without a reason, ranked in their section by similarity (of equal ones by chunk id), cut to top_k, without
    those of sections whose share of foreign evidence is over the limit. `rank` starts at 1.

    The rank window groups one section's surviving tags; with top_k Spark cuts each partition's group before the shuffle.
    """
    section = W.partitionBy("parent", "folder")
    ranked = judged.where("reason is null").withColumn("rank", F.row_number().over(section.orderBy(F.desc("similarity"), "chunk_id")))
    ranked = ranked if top_k is None else ranked.where(F.col("rank") <= top_k)
    is_foreign = F.when(~F.col("profiled") | (F.col("foreign") > 0), 1.0).otherwise(0.0)
    shares = ranked.groupBy("parent", "folder").agg(F.avg(is_foreign).alias("foreign_share"))
    return ranked.join(shares, ["parent", "folder"]).withColumn("closed", F.col("has_domains") & (F.col("foreign_share") > F.col("share_limit")))


def ranked_evidence(judged: DataFrame, top_k: int | None = None) -> DataFrame:
    return rank_tags(judged, top_k).where("not closed")


def gate_stats(judged: DataFrame, sections: DataFrame, top_k: int | None = None, min_eligibility: float = 0.2) -> DataFrame:
    """One row a section: candidates, a count for each reason, what is accepted, similarity and purity."""
    key = ["parent", "folder"]
    passed = F.col("reason").isNull()
    counts = judged.groupBy(key).agg(
        F.count("*").alias("after_section_filter"),
        *(F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in REASONS),
        F.avg(F.when(F.col("has_domains") & (F.col("eligibility_score") >= min_eligibility) & F.col("has_chunk"), F.col("on_topic").cast("double"))).alias("purity"),
        F.avg(F.when(passed & F.col("has_domains") & F.col("profiled"), F.col("foreign"))).alias("foreign_ratio"),
    )
    ranked = rank_tags(judged, top_k).groupBy(key).agg(F.count("*").alias("n"), F.avg("similarity").alias("sim"), F.first("foreign_share").alias("share"), F.max("closed").alias("closed"), F.max("has_domains").alias("guarded"))
    rows = sections.select(*key, (F.size(T.clean_terms(F.col("allowed_domains"))) > 0).alias("limited")).distinct().join(counts, key, "left").join(ranked, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shut = F.coalesce("closed", F.lit(False))
    accepted = F.when(shut, 0).otherwise(zero("n"))
    return rows.select(
        *key, zero("after_section_filter").alias("after_section_filter"), *(zero(f"rejected_{r}").alias(f"rejected_{r}") for r in REASONS),
        F.when(shut, zero("n")).otherwise(0).alias("rejected_section_foreign_evidence_share"), accepted.alias("accepted"),
        F.when(shut, 0.0).otherwise(F.round(F.coalesce("sim", F.lit(0.0)), 3)).alias("avg_similarity"),
        F.when(~F.col("limited"), 1.0).otherwise(F.round(F.coalesce("purity", F.lit(0.0)), 3)).alias("domain_purity"),
        F.when(shut, 0.0).otherwise(F.round(F.coalesce("foreign_ratio", F.lit(0.0)), 3)).alias("avg_foreign_domain_ratio"),
        F.when(F.coalesce("guarded", F.lit(False)), F.round(F.coalesce("share", F.lit(0.0)), 3)).otherwise(0.0).alias("foreign_evidence_share"),
    )
