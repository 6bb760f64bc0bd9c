"""Profiles of studies, and flags on physics and on corrupted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import lexicon
from scholium.functions import text as T

FLAG = "struct<flag_type:string,severity:string,message:string,related_ids:array<string>>"


def flag(kind: str, severity, message, ids: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("flag_type"), lit(severity).alias("severity"), lit(message).alias("message"), ids.alias("related_ids"))


def top_keywords(words: Column, limit: int = 15) -> Column:
    """The most frequent words, of equally frequent ones the first to occur. Sorting words with their places brings
    equal ones together, so a text of any length takes one sort."""

    def counted(placed: Column) -> Column:
        first = F.filter(placed, lambda x, i: (i == 0) | (F.get(placed, i - 1)["w"] != x["w"]))
        starts = F.filter(F.transform(placed, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(placed, x["i"] - 1)["w"] != x["w"]))
        runs = T.let(starts, lambda s: F.transform(s, lambda x, k: F.coalesce(F.get(s, k + 1)["i"], F.size(placed)) - x["i"]))
        return F.zip_with(first, runs, lambda x, n: F.struct((-n).alias("n"), x["i"].alias("i"), x["w"].alias("w")))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.transform(F.slice(F.sort_array(T.let(placed, counted)), 1, limit), lambda x: x["w"])


def full_text() -> Column:
    return F.concat_ws("\n", *(T.text_or_empty(F.col(c)) for c in ("title", "abstract", "raw_text")))


def profile_studies(studies: DataFrame, chunks: DataFrame | None = None, domains=None, fluids=None, phases=None, topologies=None, stops=None, max_claims: int = 50) -> DataFrame:
    """One profile a paper id (of studies with one id the last): labels, ranges, keywords and claims.

    Claims are the first two of each chunk, in chunk order, up to max_claims a paper.
    """
    text = F.col("t")
    rows = studies.select("pos", "pmid", T.paper_id(F.col("pmid"), F.col("doi")).alias("paper_id"), full_text().alias("t")).select(
        "pos", "pmid", "paper_id",
        T.labels(text, domains or lexicon.DOMAINS).alias("domains"),
        T.labels(text, fluids or lexicon.FLUIDS).alias("working_fluids"),
        T.labels(text, phases or lexicon.PHASES, "unknown").alias("phase_regimes"),
        T.labels(text, topologies or lexicon.TOPOLOGIES).alias("system_topologies"),
        T.value_range(T.temperatures_k(text)).alias("temperature"),
        T.value_range(T.pressures_bar(text)).alias("pressure"),
        top_keywords(T.keywords(text, stops)).alias("keywords"),
    )
    last = rows.groupBy("paper_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "paper_id")), "pos").alias("p"))
    found = last.select("paper_id", *(F.col(f"p.{c}").alias(c) for c in rows.columns if c not in ("paper_id", "pos", "pmid")))
    return found if chunks is None else with_claims(found, studies, chunks, max_claims)


def with_claims(profiles: DataFrame, studies: DataFrame, chunks: DataFrame, max_claims: int = 50) -> DataFrame:
    """profiles with the claims of their paper's last study: the first two of each chunk, in chunk order, up to
    max_claims. A study's chunks are cut from one text, so its group is as bounded as that."""
    last = studies.groupBy(T.paper_id(F.col("pmid"), F.col("doi")).alias("paper_id")).agg(F.max_by("pmid", "pos").alias("pmid"))
    said = chunks.select("study_pmid", "chunk_index", "chunk_id", T.claims(F.col("text")).alias("cs")).where(F.size("cs") > 0)
    said = said.groupBy(F.col("study_pmid").alias("pmid")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "cs"))).alias("all"))
    spread = F.flatten(F.transform("all", lambda c: F.transform(c["cs"], lambda x: F.struct(x["claim"].alias("claim"), x["claim_type"].alias("claim_type"), F.array(c["chunk_id"]).alias("evidence_chunk_ids")))))
    claims = last.join(said.select("pmid", F.slice(spread, 1, max_claims).alias("claims")), "pmid").select("paper_id", "claims")
    return profiles.join(claims, "paper_id", "left")


def phase_flags(profile: dict[str, Column] | None = None) -> Column:
    """array<flag> of a profile's CO2 phase regimes against its temperature and pressure ranges."""
    p = profile or {c: F.col(c) for c in ("paper_id", "phase_regimes", "working_fluids", "keywords", "temperature", "pressure")}
    has = lambda xs: F.exists(xs, lambda x: F.contains(F.lower(x), F.lit("co2")))
    uses = has(p["working_fluids"]) | has(p["keywords"]) | has(p["phase_regimes"])
    within = lambda r: F.array_contains(F.transform(p["phase_regimes"], lambda x: F.lower(x)), r)
    t_max, p_min, p_max = p["temperature"]["max"], p["pressure"]["min"], p["pressure"]["max"]
    hot, dense = F.coalesce(t_max >= lexicon.CO2_CRITICAL_K, F.lit(False)), F.coalesce(p_max >= lexicon.CO2_CRITICAL_BAR, F.lit(False))
    checks = (
        (within("solid") & (t_max > lexicon.CO2_TRIPLE_K + lexicon.SOLID_MARGIN_K), "high", F.format_string(f"CO2 in a solid regime with Tmax=%.2f K above the triple point ({lexicon.CO2_TRIPLE_K} K).", t_max)),
        (within("near_triple_point") & (t_max > lexicon.NEAR_TRIPLE_MAX_K), "high", "Regime near_triple_point with too high a temperature."),
        (within("near_triple_point") & (p_min < lexicon.NEAR_TRIPLE_MIN_BAR), "medium", "Regime near_triple_point with too low a pressure."),
        (within("supercritical") & (t_max < lexicon.CO2_CRITICAL_K), "high", "Regime supercritical below the critical temperature."),
        (within("supercritical") & (p_max < lexicon.CO2_CRITICAL_BAR), "high", "Regime supercritical below the critical pressure."),
        (within("transcritical") & ~(hot | dense), "high", "Regime transcritical without a sign of crossing the critical point."),
    )
    return F.array_compact(F.array(*(F.when(uses & test, flag("phase_co2", severity, message, F.array(p["paper_id"]))) for test, severity, message in checks)))


def corruption_flags(rows: DataFrame, text: Column, ids: Column, *keep: str) -> DataFrame:
    """(keep, flag fields) of rows whose text shows traces of broken tables."""
    found = rows.select(*keep, T.corruption_tokens(text).alias("tokens"), ids.alias("ids")).where(F.size("tokens") > 0)
    message = F.concat(F.lit("Possibly corrupted text or table: "), F.array_join(F.slice("tokens", 1, 6), ", "))
    return found.select(*keep, F.lit("text_corruption").alias("flag_type"), T.corruption_severity(F.col("tokens")).alias("severity"), message.alias("message"), F.col("ids").alias("related_ids"))


def validation_flags(studies: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """All flags (flag_type, severity, message, related_ids) of profiles, study texts and chunks."""
    physics = profiles.select(F.explode(phase_flags()).alias("f")).select("f.*")
    paper = T.paper_id(F.col("pmid"), F.col("doi"))
    texts = corruption_flags(studies, full_text(), F.array(paper))
    parts = corruption_flags(chunks, F.col("text"), F.array_distinct(F.array("chunk_id", "paper_id")))
    return physics.unionByName(texts).unionByName(parts)


def flag_counts(flags: DataFrame) -> DataFrame:
    """(flag_type, severity, n) for each, and totals with nulls: by severity, by type, and of all. A severity that is
    none of low, medium, high counts as low."""
    known = flags.withColumn("severity", F.when(F.col("severity").isin("low", "medium", "high"), F.col("severity")).otherwise("low"))
    return known.groupingSets([[], ["severity"], ["flag_type"]], "severity", "flag_type").agg(F.count("*").alias("n"))


def high_flag_ids(flags: DataFrame) -> DataFrame:
    """(id) that a high flag names; empty ids are left out."""
    return flags.where("severity = 'high'").select(F.explode("related_ids").alias("id")).where("id <> ''").distinct()
