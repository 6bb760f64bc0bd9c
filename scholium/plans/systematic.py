"""A systematic review of studies by question: screening, extraction, risk of bias, synthesis, manuscript. Each step is a stage of a
run, so an interrupted review goes on where it stopped; a study that a call fails for is kept as undecided or logged as an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import compose, dedup, meta, replies, screening
from scholium.plans import review
from scholium.sources import search

PICO = ("population", "intervention", "comparison", "outcome")


def question(topic: str, run: review.Run, client) -> dict[str, str]:
    """Population, intervention, comparison, outcome and query of a topic; what a reply leaves open is empty."""
    asked = run.stage("question", lambda: replies.ask(run.spark.range(1), F.lit(f"State population, intervention, comparison, outcome and a search query for this topic, as JSON: {topic}"), client).select(replies.query_reply(T.text_or_empty(F.col("reply"))).alias("q")).select("q.*"))
    return {"topic": topic, **{k: v or "" for k, v in asked.first().asDict().items()}}


def about(pico: dict[str, str]) -> F.Column:
    return F.concat(F.lit("\n".join(f"{k}: {pico.get(k, '')}" for k in PICO)), F.lit("\nTitle: "), T.text_or_empty(F.col("title")), F.lit("\nAbstract: "), T.text_or_empty(F.col("abstract")))


def screened(studies: DataFrame, pico: dict[str, str], client, include: float = 0.75, exclude: float = 0.25) -> DataFrame:
    """(pos, pmid, decision, confidence, justification) by the model's reply for each study; one that the call fails for is
    ambiguous, so it stays for a reader."""
    asked = compose.answered(studies.select("pos", "pmid", "title", "abstract"), F.concat(F.lit("Does this study fit the question? Answer in JSON with decision, confidence and justification.\n"), about(pico)), client)
    rows = asked.withColumn("r", replies.screening_reply(T.text_or_empty(F.col("reply"))))
    decision = F.when(F.col("reply").isNull(), "ambiguous").otherwise(screening.decide(F.col("r.decision"), F.col("r.confidence"), include, exclude))
    return rows.select("pos", "pmid", decision.alias("decision"), F.col("r.confidence").alias("confidence"), F.col("r.justification").alias("justification"))


def extracted(studies: DataFrame, client) -> tuple[DataFrame, DataFrame]:
    """(extractions, errors) of the model's reply for each study."""
    asked = compose.answered(studies.select("pmid", "title", "abstract"), F.concat(F.lit("Extract design, population, sample size and effect of this study as JSON.\nTitle: "), T.text_or_empty(F.col("title")), F.lit("\nAbstract: "), T.text_or_empty(F.col("abstract"))), client)
    return replies.extraction_reply(asked.withColumn("reply", T.text_or_empty(F.col("reply"))))


def rated(studies: DataFrame, client) -> DataFrame:
    """(pmid, domains, overall_rating): the risk of bias of each study; unreadable replies leave every domain unclear."""
    asked = compose.answered(studies.select("pmid", "title", "abstract"), F.concat(F.lit("Rate the risk of bias of this study by domain, as a JSON array.\nTitle: "), T.text_or_empty(F.col("title")), F.lit("\nAbstract: "), T.text_or_empty(F.col("abstract"))), client)
    rows = asked.select("pmid", replies.rob_reply(T.text_or_empty(F.col("reply"))).alias("domains"))
    return rows.select("pmid", "domains", meta.overall_rating(F.col("domains")).alias("overall_rating"))


def run_systematic(run: review.Run, retrieved: DataFrame, topic: str, client, least: int = 3) -> str:
    """The LaTeX manuscript of a systematic review of retrieved(pos, pmid, title, abstract, ...)."""
    pico = question(topic, run, client)
    given = retrieved
    retrieved = run.stage("retrieved", lambda: given)  # so that its rows are counted from a table, and read once
    studies = run.stage("studies", lambda: dedup.exact_title_dedup(retrieved), retrieved)
    decisions = run.stage("decisions", lambda: screened(studies, pico, client))
    kept = run.stage("retained", lambda: screening.retained(studies, decisions), studies)
    found = run.stage("extracted", lambda: replies_of(kept, client))
    extractions = found.where("error is null").drop("error", "raw")
    risk = run.stage("risk_of_bias", lambda: rated(kept, client))
    pooled = run.stage("pooled", lambda: compose.synthesise_extractions(extractions, client, least))
    counts = {"retrieved": retrieved.count(), "deduplicated": studies.count(), "included": kept.count()}
    written = run.stage("manuscript", lambda: compose.manuscript_sections(pico, extractions, pooled, counts, client, risk))
    return compose.manuscript(written, topic, counts["included"])


def run_online(run: review.Run, topic: str, server: search.Server, client, most: int | None = None, least: int = 3, **how) -> str:
    """The manuscript of a topic from its search on: the model states the question, the server's hits for its query are
    fetched page by page (how: see search.articles), and the review goes on with them. Articles and the log of the search are stages, so nothing is
    fetched twice."""
    pico = question(topic, run, client)
    found: list[DataFrame] = []

    def fetch(which: int) -> DataFrame:
        if not found:
            found.extend(search.search_articles(run.spark, pico["query"], server, most, **how))
        return found[which]

    retrieved = run.stage("retrieved", lambda: fetch(0))
    run.stage("search_log", lambda: fetch(1))
    return run_systematic(run, retrieved, topic, client, least)


def replies_of(studies: DataFrame, client) -> DataFrame:
    """Extractions and errors as one table, so that a stage keeps both."""
    good, bad = extracted(studies, client)
    return good.unionByName(bad, allowMissingColumns=True)
