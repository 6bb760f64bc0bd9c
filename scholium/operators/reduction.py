"""One prompt over any number of texts: neighbours are condensed together as far as a prompt holds them, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.operators import replies
from scholium.operators.dedup import checkpointed

#: Characters of texts that one prompt is given.
BUDGET = 24_000


def batches(parts: DataFrame, budget: int) -> DataFrame:
    """parts(place, text) with `batch`: the number of the stretch of `budget` characters in which a text begins when all stand in a row,
    in the order of place. A batch holds less than budget characters and one text more.

    Texts are dealt by ranges of place; a text's beginning is the length of what stands before it in its partition, and of the
    partitions before that one, of which there is a row each."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(parts.repartitionByRange(n, "place").sortWithinPartitions("place", "text").withColumn("_at", F.monotonically_increasing_id()))
    rows = dealt.withColumn("_p", F.shiftright("_at", 33))
    upto = lambda by: by.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_p").agg(F.sum(F.length("text")).alias("_n"))
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(upto(W.orderBy("_p"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(F.length("text")).over(upto(W.partitionBy("_p").orderBy("_at"))), F.lit(0))
    return rows.withColumn("_within", within).join(F.broadcast(sums), "_p").select(*parts.columns, F.floor((F.col("_before") + F.col("_within")) / budget).alias("batch"))


def joined(rows: DataFrame, *by: str) -> DataFrame:
    """(by, text): the texts of rows(by, place, text) of a group, a line each, in the order of place."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))


def condensed(parts: DataFrame, task: str, client: Callable[[str, dict], str], budget: int = BUDGET) -> DataFrame:
    """One row (text) of no more than about `budget` characters that stands for all of parts(place, text).

    While the texts are longer than that, each batch of neighbours is condensed by one call (task, then the texts, a line each), and its
    reply takes its place, cut to half the budget, so that every level is at most about half as long as the one before. A call that fails
    leaves the beginning of its own texts. No row holds more than a batch, and each level is checkpointed: no call is made twice.
    Null texts count as empty; without parts the text is empty."""
    level = parts.select("place", F.coalesce("text", F.lit("")).alias("text"))
    while True:
        size, n = level.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
        if size <= budget or n < 2:
            return joined(level).select(F.coalesce("text", F.lit("")).alias("text"))
        asked = replies.ask(joined(batches(level, budget), "batch"), F.concat_ws("\n", F.lit(task), "text"), client)
        level = checkpointed(asked.select(F.col("batch").alias("place"), F.substring(F.coalesce("reply", "text"), 1, max(1, budget // 2)).alias("text")))
