"""The analysis of a collection of studies against an outline, each result made when asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import chunk, coverage, gate, profile, routing, scope
from scholium.operators.dedup import checkpointed, spread


@dataclass(frozen=True)
class Settings:
    """Thresholds and tables; None takes the defaults of scholium.functions.lexicon."""

    max_words: int = 400
    overlap: int = 50
    threshold: float = 0.25
    top_k: int = 3
    evidence: int = 20
    min_eligibility: float = 0.2
    scope_on: bool = True
    guarded: bool = True
    drop_high_flags: bool = True
    scope: dict = field(default_factory=dict)
    scope_limits: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    vocabulary: tuple[str, ...] = ()


class Analysis:
    """Scope, chunks, profiles, flags, tags, gate and coverage of studies against sections (parent, folder, prompt, ...).

    Every result is made when it is first asked for. Studies as given and in scope, chunks, profiles, routed pairs and judged tags, on which
    several results rest, are written to the checkpoint folder then; the others are lazy.
    """

    def __init__(self, studies: DataFrame, sections: DataFrame, settings: Settings, embed: Callable[[Column], Column]):
        self.collected, self.sections, self.settings, self.embed = studies, sections, settings, embed

    @cached_property
    def given(self) -> DataFrame:
        """The studies as they came, written once: Spark would else push the tests of scope below what makes a study and work its title and
        abstract out again for each pattern."""
        return spread(checkpointed(self.collected))

    @cached_property
    def scoped(self) -> DataFrame:
        return scope.with_scope(scope.scope_features(self.given, **self.settings.scope), **self.settings.scope_limits)

    @cached_property
    def studies(self) -> DataFrame:
        return checkpointed(scope.in_scope(self.given, self.settings.scope, self.settings.scope_limits) if self.settings.scope_on else self.given)

    @cached_property
    def chunks(self) -> DataFrame:
        return checkpointed(chunk.chunk_studies(self.studies, self.settings.max_words, self.settings.overlap))

    @cached_property
    def profiles(self) -> DataFrame:
        """Profiles without claims, which no test of routing or gate asks for."""
        return checkpointed(profile.profile_studies(self.studies, None, **self.settings.labels))

    @cached_property
    def claimed_profiles(self) -> DataFrame:
        return profile.with_claims(self.profiles, self.studies, self.chunks)

    @cached_property
    def routed(self) -> DataFrame:
        outline = self.sections.withColumn("v", self.embed(F.col("prompt")))
        s = self.settings
        return checkpointed(routing.route(self.chunks.withColumn("v", self.embed(F.col("text"))), outline, self.profiles, s.threshold, s.top_k, s.guarded))

    @cached_property
    def tags(self) -> DataFrame:
        return routing.tags(self.routed)

    @cached_property
    def flags(self) -> DataFrame:
        return profile.validation_flags(self.studies, self.chunks, self.profiles).unionByName(routing.routing_flags(self.routed))

    @cached_property
    def judged(self) -> DataFrame:
        high = profile.high_flag_ids(self.flags) if self.settings.drop_high_flags else None
        return checkpointed(gate.judge_tags(self.tags, self.chunks, self.sections, self.profiles, high, self.settings.min_eligibility))

    @cached_property
    def stats(self) -> DataFrame:
        return gate.gate_stats(self.judged, self.sections, self.settings.evidence, self.settings.min_eligibility)

    @cached_property
    def evidence(self) -> DataFrame:
        return gate.ranked_evidence(self.judged, self.settings.evidence)

    @cached_property
    def coverage(self) -> DataFrame:
        return coverage.coverage(self.sections, self.tags)


def analyse(studies: DataFrame, sections: DataFrame, settings: Settings = Settings(), embed: Callable[[Column], Column] | None = None) -> Analysis:
    """The analysis of studies. embed(Column) -> Column of array<double> is any text embedding; without one, texts are
    vectors of how often they hold the words of settings.vocabulary."""
    return Analysis(studies, sections, settings, embed or (lambda c: routing.term_vector(c, list(settings.vocabulary))))


def evidence_package(evidence: DataFrame, chunks: DataFrame, studies: DataFrame) -> DataFrame:
    """(parent, folder, evidence): the accepted chunks of each section with citations, in rank order, as one text."""
    parts = chunks.select("chunk_id", "study_pmid", "text")
    people = studies.select(F.col("pmid").alias("study_pmid"), "authors", "year").dropDuplicates(["study_pmid"])
    rows = evidence.select("parent", "folder", "rank", "chunk_id").join(parts, "chunk_id").join(people, "study_pmid", "left")
    line: Column = F.concat(F.lit("[chunk:"), F.col("chunk_id"), F.lit("] "), T.study_citation(F.col("authors"), F.col("year"), F.col("study_pmid")), F.lit(" "), F.col("text"))
    found = rows.select("parent", "folder", "rank", line.alias("line")).groupBy("parent", "folder").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("b"))
    return found.select("parent", "folder", F.array_join(F.transform("b", lambda x: x["line"]), "\n\n").alias("evidence"), F.size("b").alias("n_evidence"))


def evidence_pieces(evidence: DataFrame, chunks: DataFrame, studies: DataFrame, sections: DataFrame) -> DataFrame:
    """(parent, folder, rank, chunk_id, citation, prompt, text): the accepted chunks of each section, one a row, for a judge."""
    people = studies.select(F.col("pmid").alias("study_pmid"), "authors", "year").dropDuplicates(["study_pmid"])
    asked = sections.groupBy("parent", "folder").agg(F.min_by("prompt", "section_pos").alias("prompt"))
    rows = evidence.select("parent", "folder", "rank", "chunk_id").join(chunks.select("chunk_id", "study_pmid", "text"), "chunk_id").join(people, "study_pmid", "left").join(asked, ["parent", "folder"])
    return rows.select("parent", "folder", "rank", "chunk_id", T.study_citation(F.col("authors"), F.col("year"), F.col("study_pmid")).alias("citation"), F.coalesce("prompt", F.lit("")).alias("prompt"), "text")
