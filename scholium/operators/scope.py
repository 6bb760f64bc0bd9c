"""Scope of a study: clusters of topic patterns, anchors and negative signs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import lexicon
from scholium.functions import text as T


def scope_features(studies: DataFrame, clusters=None, anchors=None, negatives=None, raw_chars: int = 6000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(pos, pmid, title, cluster_hits map, anchor_hits, negative_hits, positive_score) over title, abstract and the
    first raw_chars characters of the raw text, and the columns of studies that keep names."""
    clusters, anchors, negatives = clusters or lexicon.SCOPE_CLUSTERS, anchors or lexicon.SCOPE_ANCHORS, negatives or lexicon.SCOPE_NEGATIVES
    text = F.concat_ws("\n", T.text_or_empty(F.col("title")), T.text_or_empty(F.col("abstract")), F.substring(T.text_or_empty(F.col("raw_text")), 1, raw_chars))
    rows = studies.select("pos", "pmid", "title", *keep, text.alias("t"))
    hits = F.array(*(F.struct(F.lit(k).alias("k"), T.count_matching(F.col("t"), p).alias("n")) for k, p in clusters.items()))
    rows = rows.select("pos", "pmid", "title", *keep, F.filter(hits, lambda x: x["n"] > 0).alias("h"), T.count_matching(F.col("t"), anchors).alias("anchor_hits"), T.count_matching(F.col("t"), negatives).alias("negative_hits"))
    return rows.select("pos", "pmid", "title", *keep, F.map_from_entries("h").alias("cluster_hits"), "anchor_hits", "negative_hits", (F.size("h") + F.least("anchor_hits", F.lit(3))).alias("positive_score"))


def with_scope(features: DataFrame, min_positive: int = 2, max_negative_without_anchor: int = 2, max_negative_with_anchor: int = 6) -> DataFrame:
    """features with in_scope. A threshold of 0 counts as its default."""
    least, without, most = min_positive or 2, max_negative_without_anchor or 2, max_negative_with_anchor or 6
    anchored = F.col("anchor_hits") > 0
    out = (~anchored & (F.col("negative_hits") >= without)) | (anchored & (F.col("negative_hits") > most))
    return features.withColumn("in_scope", (F.col("positive_score") >= least) & ~out)


def in_scope(studies: DataFrame, tables: dict, limits: dict) -> DataFrame:
    """The studies in scope, by one pass over them."""
    others = tuple(c for c in studies.columns if c not in ("pos", "pmid", "title"))
    return with_scope(scope_features(studies, **tables, keep=others), **limits).where("in_scope").select(studies.columns)


def scope_filter(studies: DataFrame, judged: DataFrame) -> DataFrame:
    """The studies in scope."""
    return studies.join(judged.where("in_scope").select("pos"), "pos", "left_semi")


def scope_report(judged: DataFrame, dropped: int = 500) -> tuple[DataFrame, DataFrame]:
    """(counts, the first `dropped` studies out of scope)."""
    counts = judged.agg(F.count("*").alias("input_studies"), F.count_if("in_scope").alias("kept_studies"), F.count_if(~F.col("in_scope")).alias("dropped_studies"))
    return counts, judged.where("not in_scope").orderBy("pos").limit(dropped)
