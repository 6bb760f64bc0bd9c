"""Reports over tags: coverage of the outline, articles of a section, evidence of a theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators.dedup import checkpointed


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with `rank`, from 1 in each group of by. Rows are dealt by ranges of group and order, so that a group of any size is
    sorted by as many tasks as it needs; a row's rank is its place in its partition and what comes before that one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(c) for c in by]
    dealt = checkpointed(rows.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)))
    parts = dealt.groupBy(*by, "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    placed = parts.select(*by, "_p", "_first", before.alias("_before"))
    return dealt.join(placed, [*by, "_p"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"))


def coverage(sections: DataFrame, tags: DataFrame) -> DataFrame:
    """One row an entry of the outline, in outline order, also without tags."""
    found = tags.groupBy("parent", "folder").agg(F.count("*").alias("n"), F.avg("similarity").alias("s"), F.avg("eligibility_score").alias("e"))
    rows = sections.select("section_pos", "parent", "folder").join(found, ["parent", "folder"], "left")
    n = F.coalesce("n", F.lit(0))
    mean = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return rows.select("section_pos", "parent", "folder", n.alias("n_chunks"), mean("s").alias("avg_similarity"), mean("e").alias("avg_eligibility"), F.when(n > 0, "has evidence").otherwise("no evidence").alias("status"))


def coverage_summary(covered: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals."""
    total = chunks.agg(F.count("*").alias("total_chunks"))
    rows = covered.agg(F.count("*").alias("total_sections"), F.count_if(F.col("n_chunks") > 0).alias("sections_with_evidence"), F.count_if(F.col("n_chunks") == 0).alias("sections_without_evidence"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("total_tags"))
    return rows.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")


def section_articles(tags: DataFrame, chunks: DataFrame, studies: DataFrame, min_eligibility: float = 0.2, excerpt: int = 300) -> DataFrame:
    """(parent, folder, pmid, author, year, citation, similarity, n_chunks, best_excerpt, rank): the studies of each
    section by their best tag, of equal ones by pmid, all of them."""
    parts = chunks.select("chunk_id", F.col("study_pmid").alias("pmid"), F.substring("text", 1, excerpt).alias("excerpt"))
    best = tags.where(F.col("eligibility_score") >= min_eligibility).join(parts, "chunk_id").groupBy("parent", "folder", "pmid").agg(F.count("*").alias("n_chunks"), F.min(F.struct((-F.col("similarity")).alias("s"), "chunk_id", "excerpt")).alias("b"))
    people = studies.select("pmid", "authors", "year").dropDuplicates(["pmid"])
    rows = best.join(people, "pmid", "left").withColumn("similarity", F.round(-F.col("b.s"), 4))
    named = (F.coalesce("authors", F.lit("")) != "") & (F.coalesce("year", F.lit(0)) != 0)
    rows = rows.select(
        "parent", "folder", "pmid", F.coalesce("authors", "pmid").alias("author"), "year", F.when(named, T.citation(F.col("authors"), F.col("year"))).otherwise(F.format_string("(%s)", F.col("pmid"))).alias("citation"),
        "similarity", "n_chunks", F.col("b.excerpt").alias("best_excerpt"),
    )
    return ranked(rows, ["parent", "folder"], [F.desc("similarity"), F.asc("pmid")])


def write_sections(articles: DataFrame, path: str) -> None:
    """JSON files below path/parent_dir=.../folder_dir=..., names made safe."""
    rows = articles.withColumns({"parent_dir": T.safe_name(F.col("parent")), "folder_dir": T.safe_name(F.col("folder"))})
    rows.sortWithinPartitions("parent_dir", "folder_dir", "rank").write.mode("overwrite").partitionBy("parent_dir", "folder_dir").json(path)


def theme_evidence(tags: DataFrame, chunks: DataFrame, top: int = 15) -> DataFrame:
    """(parent, folder, n_tags, n_studies, avg_similarity, avg_eligibility) over each theme's best `top` tags."""
    order = W.partitionBy("parent", "folder").orderBy(F.desc("similarity"), "chunk_id")
    best = tags.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(chunks.select("chunk_id", F.col("study_pmid").alias("pmid")), "chunk_id", "left")
    return best.groupBy("parent", "folder").agg(F.count("*").alias("n_tags"), F.count_distinct("pmid").alias("n_studies"), F.round(F.avg("similarity"), 3).alias("avg_similarity"), F.round(F.avg("eligibility_score"), 3).alias("avg_eligibility"))


def chapter_order(sections: DataFrame) -> DataFrame:
    """sections in writing order: parents as they first appear, entries by the last place of their folder."""
    parents = sections.groupBy("parent").agg(F.min("section_pos").alias("parent_pos"))
    folders = sections.groupBy("folder").agg(F.max("section_pos").alias("folder_pos"))
    return sections.join(parents, "parent").join(folders, "folder").orderBy("parent_pos", "folder_pos", "section_pos")


def candidate_pairs(tags: DataFrame, chunks: DataFrame, leading: int = 4, pairs: int = 3) -> DataFrame:
    """(parent, folder, a, b, pair): the first `pairs` pairs of unlike studies among each theme's `leading` best tags."""
    order = W.partitionBy("parent", "folder").orderBy(F.desc("similarity"), "chunk_id")
    top = tags.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leading).join(chunks.select("chunk_id", F.col("study_pmid").alias("pmid")), "chunk_id")
    left = top.select("parent", "folder", F.col("chunk_id").alias("a"), F.col("rank").alias("i"), F.col("pmid").alias("p"))
    right = top.select("parent", "folder", F.col("chunk_id").alias("b"), F.col("rank").alias("j"), F.col("pmid").alias("q"))
    both = left.join(right, ["parent", "folder"]).where("i < j and p <> q")
    return both.withColumn("pair", F.row_number().over(W.partitionBy("parent", "folder").orderBy("i", "j"))).where(F.col("pair") <= pairs).select("parent", "folder", "a", "b", "pair")
