"""Fixed-effect meta-analysis by inverse variances, and risk of bias."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_effect(rows: DataFrame, by: list[str], effect: str = "effect_size", lower: str = "ci_lower", upper: str = "ci_upper", level: float = 0.95) -> DataFrame:
    """(by, pooled_effect, pooled_se, ci_lower, ci_upper, q, i_squared, tau_squared, k) of each group.

    Rows without an effect or an interval are left out; an interval of no width counts as a standard error of
    1e-6. Two grouped aggregations, both combined before the shuffle: the least effect of each group, then sums of
    what effects have over it, from which Q is found without losing digits. Without `by` the one row of least effects is broadcast.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    se = (F.col(upper) - F.col(lower)) / (2 * z)
    used = rows.dropna(subset=[effect, lower, upper]).select(*by, F.col(effect).cast("double").alias("es"), F.when(se <= 0, 1e-6).otherwise(se).alias("se"))
    w = 1 / (F.col("se") * F.col("se"))
    # Effects are taken from the group's least one, so that Q loses no digits where they are large and alike.
    base = used.groupBy(*by).agg(F.min("es").alias("m")) if by else used.agg(F.min("es").alias("m"))
    joined = used.join(base, by) if by else used.join(F.broadcast(base), F.col("es") >= F.col("m"))
    d = F.col("es") - F.col("m")
    sums = joined.groupBy(*by, "m").agg(F.sum(w).alias("sw"), F.sum(w * d).alias("swd"), F.sum(w * d * d).alias("swdd"), F.sum(w * w).alias("sww"), F.count("*").alias("k"))
    pooled, pooled_se = F.col("m") + F.col("swd") / F.col("sw"), 1 / F.sqrt("sw")
    q = F.greatest(F.lit(0.0), F.col("swdd") - F.col("swd") * F.col("swd") / F.col("sw"))
    df = F.greatest(F.col("k") - 1, F.lit(1))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    out = sums.withColumns({"q": q, "df": df, "c": c})
    return out.select(
        *by, pooled.alias("pooled_effect"), pooled_se.alias("pooled_se"), (pooled - z * pooled_se).alias("ci_lower"), (pooled + z * pooled_se).alias("ci_upper"), "q",
        F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q") * 100)).otherwise(0.0).alias("i_squared"),
        F.when(F.col("q") > F.col("df"), F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.when(F.col("c") != 0, F.col("c")))).otherwise(0.0).alias("tau_squared"), "k",
    )


def forest_rows(rows: DataFrame, label: str = "pmid", effect: str = "effect_size", lower: str = "ci_lower", upper: str = "ci_upper") -> DataFrame:
    """(label, effect, ci_lower, ci_upper, weight) to draw a forest plot from."""
    z = NormalDist().inv_cdf(0.975)
    se = (F.col(upper) - F.col(lower)) / (2 * z)
    return rows.dropna(subset=[effect, lower, upper]).select(F.col(label).alias("label"), F.col(effect).alias("effect"), F.col(lower).alias("ci_lower"), F.col(upper).alias("ci_upper"), (1 / F.pow(F.when(se <= 0, 1e-6).otherwise(se), 2)).alias("weight"))


def synthesis_kind(extractions: DataFrame, least: int = 3) -> str:
    """'meta_analysis' if enough rows have an effect with its interval, else 'thematic'."""
    return "meta_analysis" if extractions.dropna(subset=["effect_size", "ci_lower", "ci_upper"]).limit(least).count() >= least else "thematic"


def overall_rating(domains: Column) -> Column:
    """Of array<struct(domain, rating, ...)>: high if any is, moderate if two or more are unclear, else low."""
    ratings = F.transform(F.coalesce(domains, F.array()), lambda d: F.lower(F.trim(d["rating"])))
    return F.when(F.exists(ratings, lambda r: r == "high"), "high").when(F.size(F.filter(ratings, lambda r: r == "unclear")) >= 2, "moderate").otherwise("low")


def methodology(rating: Column) -> Column:
    return F.when(rating == "low", "high").when(rating == "high", "low").otherwise("medium")


def with_extractions(studies: DataFrame, extractions: DataFrame, order: Column | None = None) -> DataFrame:
    """studies left-joined with the last extraction of their pmid."""
    others = [c for c in extractions.columns if c != "pmid"]
    last = extractions.groupBy("pmid").agg(F.max_by(F.struct(*others), order if order is not None else F.monotonically_increasing_id()).alias("x"))
    return studies.join(last, "pmid", "left").select(*studies.columns, *(F.col(f"x.{c}").alias(c) for c in others if c not in studies.columns))


def evidence_table(tags: DataFrame, extractions: DataFrame, rob: DataFrame, limit: int = 20) -> DataFrame:
    """One row a theme and study: its best tag with the study's design, effect and overall risk of bias."""
    best = tags.groupBy("parent", "folder", F.col("study_pmid").alias("pmid")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "chunk_id")).alias("b"))
    rows = best.select("parent", "folder", "pmid", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.s")).alias("similarity"))
    rows = rows.join(extractions.select("pmid", "study_design", "effect_size").dropDuplicates(["pmid"]), "pmid", "left")
    rows = rows.join(rob.select("pmid", "overall_rating").dropDuplicates(["pmid"]), "pmid", "left")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("parent", "folder").orderBy(F.desc("similarity"), "pmid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)
