"""Studies: the view over documents, keep-first and keep-last inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T

COLUMNS = ("pos", "pmid", "title", "authors", "journal", "year", "abstract", "doi", "raw_text")


def title_and_abstract(raw: Column, stem: Column) -> Column:
    """struct(title, abstract) of a plain text: first line that is not blank (else stem), and the others (else all)."""
    lines = F.filter(F.transform(F.split(raw, r"\R"), T.strip_item), lambda x: x != "")
    return T.let(lines, lambda ls: F.struct(F.coalesce(F.get(ls, 0), stem).alias("title"), F.when(F.size(ls) > 1, F.array_join(F.slice(ls, 2, 1_000_000_000), "\n")).otherwise(raw).alias("abstract")))


def from_documents(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, source) as studies, in doc_id order; a null text is empty."""
    raw = T.text_or_empty(F.col("text"))
    named = docs.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("pmid"), title_and_abstract(raw, F.col("doc_id").cast("string")).alias("ta"), F.col("source").alias("authors"), raw.alias("raw_text"))
    return named.select(
        "pos", "pmid", F.col("ta.title").alias("title"), "authors", F.lit("").alias("journal"), F.lit(None).cast("int").alias("year"),
        F.col("ta.abstract").alias("abstract"), F.lit("").alias("doi"), "raw_text",
    )


def _one_per_key(rows: DataFrame, key: list[str], order: list[Column], least: bool) -> DataFrame:
    """One row a key, by a grouped minimum or maximum of (order, row): partial sums before the shuffle, so that a hot
    key costs one row a task."""
    others = [c for c in rows.columns if c not in key]
    packed = F.struct(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("o"), F.struct(*others).alias("row"))
    pick = (F.min_by if least else F.max_by)(packed["row"], packed["o"])
    return rows.groupBy(*key).agg(pick.alias("row")).select(*key, *(F.col(f"row.{c}").alias(c) for c in others)).select(rows.columns)


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or ignore: the first row of each key."""
    return _one_per_key(rows, key, order, True)


def keep_last(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace: the last row of each key."""
    return _one_per_key(rows, key, order, False)
