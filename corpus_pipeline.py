"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import decontam, jaccard, packing, quality, simhash, suffix
from scholium.llm.common import discard, read, spill, spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash fingerprints, or by five-word Jaccard similarity of 0.8
    where changes leave fingerprints more than two bits apart."""
    return jaccard.keep_one(docs, simhash.simhash_components(docs.where("doc_id is not null")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one holds; characters cut in two go, and so do documents that lost
    bytes and of which nothing but white space is left."""
    found = suffix.remove_earlier(docs, keep=COLUMNS)
    whole = F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    text = F.when(F.col("n_removed") == 0, F.col("rest.text")).otherwise(whole)
    cut = found.select("rest.doc_id", text.alias("text"), "rest.lang", "rest.source", F.length(text).cast("long").alias("n_chars"), "n_removed")
    return cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document left."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]
#: Near duplicates and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written in the checkpoint folder and read again; its table goes as
    soon as the next stage's stands."""
    docs, before = spread(read(spark, sf_dir, "documents")), None
    for _, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
