"""Duplicate studies: equal titles, and greedy removal over a similarity graph."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T


#: Links that are left for one task to scan in order; while there are more, rounds go on.
LOCAL = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The checkpoint folder is the one that the session names. Only a local session that names none gets one of its
    own; on a cluster a missing setting is an error, as executors would not share that folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan gives fewer (a small table in one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def title_key():
    return F.lower(T.strip(T.text_or_empty(F.col("title"))))


def exact_title_log(studies: DataFrame) -> DataFrame:
    """(kept_pmid, removed_pmid, similarity): each study whose title, trimmed and in lower case, an earlier one has.

    Blank titles are one title. The first of each title comes from a grouped minimum and is joined back, so no
    title's studies need to meet in one task."""
    keyed = studies.select("pos", "pmid", title_key().alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("pos", "pmid")).alias("first"))
    return keyed.join(first, "key").where(F.col("pos") > F.col("first.pos")).select(F.col("first.pmid").alias("kept_pmid"), F.col("pmid").alias("removed_pmid"), F.lit(1.0).alias("similarity"))


def exact_title_dedup(studies: DataFrame) -> DataFrame:
    """The first study of each title."""
    first = studies.groupBy(title_key().alias("key")).agg(F.min("pos").alias("pos")).select("pos")
    return studies.join(first, "pos", "left_semi")


def greedy_dedup(nodes: DataFrame, edges: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """(kept, log) of the greedy scan in pos order: a node goes if an earlier one that stays is linked to it.

    nodes(pos), edges(a, b, similarity) with a < b. Each round keeps the undecided nodes to which no undecided
    earlier node is linked, and removes what they reach, until no node is undecided. Rounds end early once no more
    than `local` links between undecided nodes are left: one task scans these in order, which gives the same rows in one step however
    long their chains are. log(kept, removed, similarity) names the first kept node that reaches each removed one. Only counts reach the driver.
    """
    edges = checkpointed(edges.select("a", "b", "similarity"))
    alive = edges.select("a", "b")
    removed = None
    while True:
        if alive.count() <= local:
            gone = checkpointed(alive.coalesce(1).sortWithinPartitions("b", "a").mapInPandas(_scan, "pos long"))
            removed = gone if removed is None else removed.unionAll(gone)
            break
        # A node that no undecided earlier one is linked to stays; what it reaches goes, and with it its links.
        late = alive.select(F.col("b").alias("pos")).distinct()
        stays = alive.select(F.col("a").alias("pos")).distinct().join(late, "pos", "left_anti")
        gone = checkpointed(alive.join(stays, alive.a == stays.pos, "left_semi").select(F.col("b").alias("pos")).distinct())
        removed = gone if removed is None else removed.unionAll(gone)
        alive = checkpointed(alive.join(gone, alive.b == gone.pos, "left_anti").join(gone, alive.a == gone.pos, "left_anti"))
    kept = checkpointed(nodes.select("pos").join(removed, "pos", "left_anti"))
    log = edges.join(removed, edges.a == removed.pos, "left_anti").groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("first"))
    return kept, log.select(F.col("first.a").alias("kept"), F.col("b").alias("removed"), F.col("first.similarity").alias("similarity"))


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) sorted by b -> the nodes that go."""
    gone: set[int] = set()
    for frame in frames:
        fresh = []
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            if b not in gone and a not in gone:
                gone.add(b)
                fresh.append(b)
        yield pd.DataFrame({"pos": fresh}, dtype="int64")
