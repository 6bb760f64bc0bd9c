"""Writing a review over analysed evidence: drafts, reviews with feedback, stages that can be resumed."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from inspect import signature
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import replies
from scholium.operators.dedup import checkpointed

NO_EVIDENCE = "No evidence met this section's requirements."


def write_sections(packages: DataFrame, sections: DataFrame, client: Callable[[str, dict], str], options: dict | None = None, least: int = 1) -> DataFrame:
    """(section_pos, parent, folder, content): a draft for each section from its evidence; sections with fewer than
    `least` pieces get a fixed sentence without a call. Drafts pass the physics and text clean-ups."""
    rows = sections.join(packages, ["parent", "folder"], "left")
    prompt = F.concat_ws("\n\n", F.concat(F.lit("Write the section: "), "prompt"), F.lit("Evidence:"), F.coalesce("evidence", F.lit("")))
    ready = rows.where(F.coalesce("n_evidence", F.lit(0)) >= max(least, 1))
    bare = rows.where(F.coalesce("n_evidence", F.lit(0)) < max(least, 1)).select("section_pos", "parent", "folder", F.lit(NO_EVIDENCE).alias("content"))
    drafts = replies.ask(ready, prompt, client, options).select("section_pos", "parent", "folder", T.textual_cleanup(T.thermo_fixes(T.text_or_empty(F.col("reply")))["text"]).alias("content"))
    return drafts.unionByName(bare)


def review_loop(drafts: DataFrame, write: Callable[[DataFrame], DataFrame], review: Callable[..., DataFrame], rounds: int = 3, accept: float = 7.0) -> DataFrame:
    """drafts(key, content) revised until accepted: review(drafts) -> (key, score, feedback); those below `accept` go with
    their feedback to write(rejected) -> (key, content). A missing score accepts; after `rounds` the last draft stands.
    A review that takes two arguments is also given what is settled so far (None in the first round).
    Only undecided drafts are asked about again, and each round is checkpointed, so that no model is asked twice, not even for a lost executor."""
    done, todo = None, drafts.select("key", "content")
    sees_settled = len(signature(review).parameters) > 1
    for k in range(rounds):
        judged = checkpointed(todo.join(review(todo, done) if sees_settled else review(todo), "key", "left"))
        settled = judged.where(F.coalesce(F.col("score") >= accept, F.lit(True)) | F.lit(k == rounds - 1)).select("key", "content", "score", F.lit(k + 1).alias("iterations"))
        done = settled if done is None else done.unionByName(settled)
        if k == rounds - 1:
            break
        rejected = judged.where(F.col("score") < accept)
        if rejected.isEmpty():
            break
        todo = checkpointed(write(rejected.select("key", "content", "feedback")))
    return done


class Run:
    """A run's folder: one Parquet table for each stage and a log. A stage whose table is whole is read, not run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def has(self, stage: str) -> bool:
        fs, target = self._fs(f"{stage}/_SUCCESS")
        return fs.exists(target)

    def stage(self, name: str, make: Callable[[], DataFrame], before: DataFrame | None = None) -> DataFrame:
        """The stage's table, made if it is not there. The log has its rows and time, and the rows of `before` if given."""
        if not self.has(name):
            began = datetime.now(timezone.utc)
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            took = (datetime.now(timezone.utc) - began).total_seconds()
            counts = {"n_after": self.spark.read.parquet(f"{self.path}/{name}").count()} | ({} if before is None else {"n_before": before.count()})
            self.log(name, "done", took, counts)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        """The tables of all stages that are whole, by name: what an interrupted run has left."""
        fs, target = self._fs("")
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return {n: self.spark.read.parquet(f"{self.path}/{n}") for n in sorted(names) if n != "log" and self.has(n)}

    def log(self, stage: str, event: str, elapsed_s: float = 0.0, payload: dict | None = None) -> None:
        row = [(stage, event, float(elapsed_s), json.dumps(payload or {}, default=str), datetime.now(timezone.utc))]
        self.spark.createDataFrame(row, "stage string, event string, elapsed_s double, payload string, at timestamp").write.mode("append").parquet(f"{self.path}/log")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")


def save_json(value, path: str | Path) -> None:
    """A small report as a JSON file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def load_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"))
