"""Screening by keyword rules or by a model's reply, and the flow report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T


def _some(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(text, t))


def screen_by_keywords(studies: DataFrame, keywords: list[str], include_rules: list[str], exclude_rules: list[str]) -> DataFrame:
    """(pos, pmid, decision, confidence, justification): rules first, then the share of keywords that occur.

    Terms are plain substrings of `title abstract` in lower case. An exclusion rule without an inclusion rule
    excludes (0.8); a share of 0.3 or an inclusion rule includes; 0.15 is ambiguous and stays; less excludes.
    """
    n = len(keywords)
    keywords, include_rules, exclude_rules = ([t.lower() for t in ts] for ts in (keywords, include_rules, exclude_rules))
    text = F.lower(F.concat_ws(" ", "title", "abstract"))

    def facts(low: Column) -> Column:
        hits = F.size(F.filter(F.array(*map(F.lit, keywords)).cast("array<string>"), lambda k: F.contains(low, k)))
        return F.struct(hits.alias("hits"), _some(low, include_rules).alias("inc"), _some(low, exclude_rules).alias("exc"))

    # One expression over one text: a filter on the decision, which Spark pushes below what makes the text, makes it once.
    return studies.select("pos", "pmid", T.let(T.let(text, facts), lambda f: _decided(f, n)).alias("d")).select("pos", "pmid", "d.*")


def _decided(facts: Column, n: int) -> Column:
    """struct(decision, confidence, justification) of a study's facts (hits, inc, exc), of n keywords."""
    score = facts["hits"] / max(n, 1)
    out, inc, amb = facts["exc"] & ~facts["inc"], (score >= 0.3) | facts["inc"], score >= 0.15
    shown = F.format_string("%.2f", score)
    return F.struct(
        F.when(out, "exclude").when(inc, "include").when(amb, "ambiguous").otherwise("exclude").alias("decision"),
        F.when(out, 0.8).when(inc, F.least(0.5 + score, F.lit(1.0))).when(amb, score).otherwise(1.0 - score).alias("confidence"),
        # The four justifications.
        F.when(out, "Matched exclusion rule")
        .when(inc, F.concat(F.lit("Keyword match score: "), shown, F.lit(" ("), facts["hits"].cast("string"), F.lit(f"/{n} keywords)")))
        .when(amb, F.concat(F.lit("Low keyword match: "), shown, F.lit(" — flagged for review")))
        .otherwise(F.concat(F.lit("Insufficient keyword match: "), shown)).alias("justification"),
    )


def decide(decision: Column, confidence: Column, include: float = 0.75, exclude: float = 0.25) -> Column:
    """The final word on a reply's decision and confidence; what is ambiguous stays."""
    return F.when((confidence >= include) & (decision == "include"), "include").when((confidence <= exclude) | (decision == "exclude"), "exclude").otherwise("ambiguous")


def flow_counts(decisions: DataFrame) -> DataFrame:
    """One row (total_screened, included, excluded, ambiguous); ambiguous studies are not counted as included."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(F.count("*").alias("total_screened"), of("include").alias("included"), of("exclude").alias("excluded"), of("ambiguous").alias("ambiguous"))


def retained(studies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Studies that are included or ambiguous."""
    return studies.join(decisions.where("decision <> 'exclude'").select("pos"), "pos", "left_semi")
