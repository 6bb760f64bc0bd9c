"""The registered queries: one or more for each operator, over whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import chunk, coverage, dedup, gate, markdown, meta, profile, replies, routing, scope, screening, sections, studies, synthesis
from scholium.plans import analysis, harness, oracle
from scholium.sources import outline

QUERIES: dict = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


read_table = _read


def studies_of(spark: SparkSession, sf: str) -> DataFrame:
    return _studies(spark, sf)


def _studies(spark: SparkSession, sf: str) -> DataFrame:
    return studies.from_documents(_read(spark, sf, "documents"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_studies(_studies(spark, sf), harness.MAX_WORDS, harness.OVERLAP)


def _sections(spark: SparkSession) -> DataFrame:
    return outline.sections_frame(spark, harness.outline())


LABELS = {"domains": harness.DOMAINS, "fluids": harness.FLUIDS, "phases": harness.PHASES, "topologies": harness.TOPOLOGIES, "stops": harness.STOPS}
SETTINGS = analysis.Settings(
    harness.MAX_WORDS, harness.OVERLAP, harness.THRESHOLD, harness.TOP_K, harness.EVIDENCE, scope_on=True,
    scope={"clusters": harness.CLUSTERS, "anchors": harness.ANCHORS, "negatives": harness.NEGATIVES}, labels=LABELS, vocabulary=harness.VOCABULARY,
)


def _analysis(spark: SparkSession, sf: str) -> analysis.Analysis:
    return analysis.analyse(dedup.exact_title_dedup(_studies(spark, sf)), _sections(spark), SETTINGS)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _millionths(name: str):
    """A share as a whole number of millionths, the floor of x * 1e6 + 0.5: engines round ties of decimals apart."""
    return F.floor(F.col(name) * 1e6 + 0.5).cast("long").alias(name)


def digits(name: str):
    """A number to five significant digits, as digits and exponent: intervals of no width weigh 1e12, so places would not do."""
    x = F.col(name)
    power = F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, "0").otherwise(F.concat(F.floor(x / F.pow(F.lit(10.0), power) * 1e4 + 0.5).cast("string"), F.lit("e"), power.cast("int").cast("string"))).alias(name)


@query
def studies_view(spark, sf):
    """Documents as studies."""
    return _studies(spark, sf).select("pos", "pmid", "title", "abstract", "authors")


@query
def exact_title_dedup(spark, sf):
    """The first study of each title."""
    return dedup.exact_title_dedup(_studies(spark, sf)).select("pos", "pmid")


@query
def exact_title_log(spark, sf):
    """Removed studies with the one that stays."""
    return dedup.exact_title_log(_studies(spark, sf))


@query
def keep_first_insert(spark, sf):
    """1.1: the first event of each user and type."""
    return studies.keep_first(_read(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query
def keep_last_replace(spark, sf):
    """1.1: the last turn of each conversation and role."""
    return studies.keep_last(_read(spark, sf, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], [F.col("turn"), F.col("text")])


def _decisions(spark, sf):
    return screening.screen_by_keywords(_studies(spark, sf), harness.KEYWORDS, harness.INCLUDE_RULES, harness.EXCLUDE_RULES)


@query
def keyword_screening(spark, sf):
    """B1."""
    return _rounded(_decisions(spark, sf))


@query
def prisma_counts(spark, sf):
    """D2."""
    return screening.flow_counts(_decisions(spark, sf))


@query
def retained_studies(spark, sf):
    """Studies that screening keeps, ambiguous ones too."""
    return screening.retained(_studies(spark, sf), _decisions(spark, sf)).select("pos", "pmid")


@query
def threshold_screening(spark, sf):
    """B2: labels as replies, their confidence from the id."""
    rows = _read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").when(F.col("toxic") == 1, "exclude").otherwise("maybe").alias("said"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("confidence"))
    return rows.select("doc_id", screening.decide(F.col("said"), F.col("confidence")).alias("decision"))


@query
def chunk_documents(spark, sf):
    """Chunks with their ids and offsets."""
    return _chunks(spark, sf).select("chunk_id", "study_pmid", "chunk_index", "start_char", "end_char", F.md5("text").alias("text_md5"))


@query
def chunk_stats(spark, sf):
    """M2, D-style rollup: chunks and words for each language."""
    rows = _chunks(spark, sf).join(_read(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "lang"), "pos")
    return _rounded(rows.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.count_distinct("study_pmid").alias("n_studies"), F.avg(F.size(T.words(F.col("text")))).alias("avg_words")))


def _scoped(spark, sf):
    return scope.with_scope(scope.scope_features(_studies(spark, sf), harness.CLUSTERS, harness.ANCHORS, harness.NEGATIVES))


@query
def scope_features(spark, sf):
    """Counts of scope patterns and the verdict."""
    return _scoped(spark, sf).select("pos", F.array_join(F.array_sort(F.map_keys("cluster_hits")), ",").alias("clusters"), "anchor_hits", "negative_hits", "positive_score", "in_scope")


@query
def scope_report(spark, sf):
    """B4."""
    return scope.scope_report(_scoped(spark, sf))[0]


@query
def label_match(spark, sf):
    """H1: labels of each study, joined by commas."""
    text = profile.full_text()
    rows = _studies(spark, sf).select("pos", *(F.array_join(T.labels(text, t, d), ",").alias(n) for n, t, d in (("domains", harness.DOMAINS, None), ("fluids", harness.FLUIDS, None), ("phases", harness.PHASES, "unknown"), ("topologies", harness.TOPOLOGIES, None))))
    return rows


@query
def keyword_topk(spark, sf):
    """The 15 most frequent keywords of each study."""
    return _studies(spark, sf).select("pos", F.array_join(profile.top_keywords(T.keywords(F.col("raw_text"), harness.STOPS)), " ").alias("keywords"))


@query
def numeric_ranges(spark, sf):
    """Least and most of the numbers before a sign."""
    rows = _studies(spark, sf).select("pos", T.value_range(T.quantities(F.col("raw_text"), harness.NUMBERS)).alias("r")).select("pos", "r.*")
    return _rounded(rows)


@query
def corruption_tokens(spark, sf):
    """H5: distinct traces in order, and how grave they are."""
    rows = _studies(spark, sf).select("pos", T.corruption_tokens(F.col("raw_text"), harness.TRACES).alias("t")).where(F.size("t") > 0)
    return rows.select("pos", F.array_join("t", " ").alias("tokens"), T.corruption_severity(F.col("t")).alias("severity"))


@query
def sanitized_text(spark, sf):
    """Clean-ups leave a digest."""
    return _studies(spark, sf).select("pos", F.md5(T.sanitize_table(F.col("raw_text"))).alias("table_md5"))


@query
def claims_per_chunk(spark, sf):
    """H7: the first sentences with a quantity or comparison, by type."""
    rows = _chunks(spark, sf).select("chunk_id", F.explode_outer(T.claims(F.col("text"))).alias("c")).where("c is not null")
    return rows.groupBy("c.claim_type").agg(F.count("*").alias("n"), F.sum(F.length("c.claim")).alias("chars"))


@query
def study_citations(spark, sf):
    """Citations from source and id."""
    rows = _studies(spark, sf)
    year = F.when(F.col("pos") % 3 == 0, (F.col("pos") % 60 + 1960).cast("int"))
    return rows.select("pos", T.study_citation(F.when(F.col("pos") % 5 > 0, F.col("authors")), year, F.col("pmid")).alias("citation"), T.paper_id(F.when(F.col("pos") % 2 == 0, F.col("pmid")), F.col("authors")).alias("paper_id"))


def _unit(spark, sf):
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))


@query
def cosine_pairs(spark, sf):
    """Pairs of vectors with a cosine over the threshold, exactly."""
    return _rounded(routing.similar_pairs(_unit(spark, sf), harness.EDGE_SIMILARITY))


@query
def cosine_topk_sections(spark, sf):
    """Vectors routed to sections that are the mean vector of each label, without guardrails."""
    vectors = _unit(spark, sf)
    spread = _read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = spread.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("v"))
    outlined = means.select(F.col("label").cast("int").alias("section_pos"), F.lit("p").alias("parent"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("folder"), "v", (F.col("label") % 4 / 20.0).alias("min_similarity"), F.lit("soft").alias("routing_strictness"))
    rows = vectors.select(F.col("pos").cast("string").alias("chunk_id"), F.col("pos").cast("string").alias("study_pmid"), F.col("pos").cast("string").alias("paper_id"), F.lit("").alias("text"), "v")
    routed = routing.route(rows, outlined, rows, 0.02, 3, guarded=False)
    return _rounded(routed.where("assigned").select("chunk_id", "section_pos", "similarity"))


@query
def greedy_vector_dedup(spark, sf):
    """The log of the greedy scan."""
    return _rounded(routing.greedy_vectors(_unit(spark, sf), harness.EDGE_SIMILARITY)[1])


@query
def routed_tags(spark, sf):
    """Tags of chunks with score and notes."""
    tags = _analysis(spark, sf).tags
    return tags.select("chunk_id", "section_pos", _millionths("similarity"), _millionths("eligibility_score"), F.array_join("routing_notes", ";").alias("notes"))


@query
def validation_report(spark, sf):
    """Flags by severity, by type and in all."""
    a = _analysis(spark, sf)
    return profile.flag_counts(a.flags)


@query
def evidence_gate_stats(spark, sf):
    """A count for each reason and section."""
    return _rounded(_analysis(spark, sf).stats)


@query
def evidence_ranked(spark, sf):
    """Accepted evidence in rank order."""
    return _analysis(spark, sf).evidence.select("parent", "folder", "rank", "chunk_id", _millionths("similarity"))


@query
def flagship_coverage(spark, sf):
    """D1 over the whole analysis."""
    return _analysis(spark, sf).coverage


@query
def coverage_totals(spark, sf):
    """The summary row."""
    a = _analysis(spark, sf)
    return coverage.coverage_summary(a.coverage, a.chunks)


@query
def organizer_rollup(spark, sf):
    """Articles of each section."""
    a = _analysis(spark, sf)
    return coverage.section_articles(a.tags, a.chunks, a.studies).select("parent", "folder", "pmid", "citation", "similarity", "n_chunks", "rank", F.md5("best_excerpt").alias("excerpt_md5"))


@query
def theme_evidence(spark, sf):
    """D8, F2."""
    a = _analysis(spark, sf)
    return coverage.theme_evidence(a.tags, a.chunks)


@query
def candidate_pairs(spark, sf):
    """C10."""
    a = _analysis(spark, sf)
    return coverage.candidate_pairs(a.tags, a.chunks)


@query
def meta_fixed_effect(spark, sf):
    """Pooled prices of each flag and status."""
    rows = _read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 10000).alias("effect_size"), (F.col("l_extendedprice") / 10000 - F.col("l_discount")).alias("ci_lower"), F.when(F.col("l_quantity") > 3, F.col("l_extendedprice") / 10000 + F.col("l_discount") + F.col("l_tax")).alias("ci_upper"))
    found = meta.fixed_effect(rows, ["l_returnflag", "l_linestatus"])
    return found.select(*(digits(c) if k == "double" else F.col(c) for c, k in found.dtypes))


def _rob(spark, sf):
    rating = lambda k: F.get(F.array(F.lit("low"), F.lit("Unclear "), F.lit("high"), F.lit("low"), F.lit("low")), ((F.col("doc_id") * (k + 3) + F.col("quality") + k) % 7 % 5).cast("int"))
    return _read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pmid"), F.array(*(F.struct(F.lit(str(k)).alias("domain"), rating(k).alias("rating")) for k in range(5))).alias("domains"))


@query
def rob_overall(spark, sf):
    """D14, D15."""
    return _rob(spark, sf).select("pmid", meta.overall_rating(F.col("domains")).alias("overall_rating"), meta.methodology(meta.overall_rating(F.col("domains"))).alias("methodology"))


@query
def extraction_join(spark, sf):
    """Studies with the last row of their id."""
    rows = _read(spark, sf, "labels")
    twice = rows.select(F.col("doc_id").cast("string").alias("pmid"), "quality", "toxic", F.lit(1).alias("o")).unionByName(rows.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("pmid"), (1 - F.col("quality")).alias("quality"), "toxic", F.lit(2).alias("o")))
    return meta.with_extractions(_studies(spark, sf).select("pos", "pmid"), twice, F.col("o")).drop("o")


def _written(spark, sf):
    """Conversations as sections with references and numbers."""
    rows = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"), F.count("*").alias("n"))
    ref = F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 16)
    claim = F.concat(F.lit(" Yield was 5.2 bar at 300 K and 10-20 [chunk:"), ref, F.lit("] by [paper:p"), (F.col("conv_id") % 7).cast("string"), F.lit("]. /C12"))
    return rows.select(F.col("conv_id").cast("string").alias("section_id"), F.concat("t", F.when(F.col("n") % 2 == 0, claim).otherwise("")).alias("content"), F.array(F.lit("the"), F.lit("QUE"), F.lit("zzz")).alias("forbidden_terms"))


def _some_flags(spark):
    return spark.createDataFrame([("phase_co2", "high", "m", ["p1", "x"]), ("phase_co2", "high", "m", ["p1"]), ("routing", "medium", "m", ["p2"]), ("routing", "high", "m", ["p3", "p5"])], profile.FLAG.removeprefix("struct<").removesuffix(">"))


@query
def section_quality(spark, sf):
    """H12, H13, H14, C7."""
    found = sections.section_quality(_written(spark, sf), _some_flags(spark))
    return _rounded(found.select("section_id", F.array_join("forbidden_term_hits", ",").alias("forbidden"), "cross_topic_contamination_score", F.col("physics_high_flag_hits").cast("long").alias("physics_hits"), "physics_consistency_score", "grounding_score", "table_integrity_score"))


@query
def quality_report(spark, sf):
    """D10."""
    i = F.col("section_id").cast("int")
    written = _written(spark, sf).withColumns({"domain_purity": i % 5 / 4, "avg_similarity": i % 9 / 8, "foreign_evidence_share": i % 3 / 2})
    return sections.quality_summary(sections.section_quality(written, _some_flags(spark)))


@query
def review_blend(spark, sf):
    """D18."""
    found = sections.section_quality(_written(spark, sf), _some_flags(spark))
    model = F.col("section_id").cast("int") % 11
    blend = sections.blended_score(model, F.col("cross_topic_contamination_score"), F.col("physics_consistency_score"), F.col("grounding_score"), F.col("physics_high_flag_hits"))
    return found.select("section_id", F.round(blend, 1).alias("score"))


@query
def citation_dedup(spark, sf):
    """Groups of citations made from sources."""
    rows = _read(spark, sf, "documents")
    made = F.concat(F.lit("See ("), "source", F.lit(", 2023; "), F.upper("source"), F.lit(", 2023; "), "lang", F.lit(", 2024) and (no year; twice) (x)."))
    return rows.select("doc_id", T.dedup_citations(made).alias("text"))


@query
def markdown_sections(spark, sf):
    """Turns as headings, texts as bodies."""
    mark = F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("### ")
    part = F.concat(mark, "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    docs = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return markdown.split_sections(docs, "conv_id").select("conv_id", F.col("section_no").cast("long").alias("section_no"), F.col("level").cast("int").alias("level"), "heading", "parent", F.md5("body").alias("body_md5"))


@query
def latex_escape(spark, sf):
    """H20."""
    return _read(spark, sf, "documents").select("doc_id", F.md5(T.escape_latex(F.coalesce("text", F.lit("")))).alias("latex_md5"))


@query
def concept_registry(spark, sf):
    """The first conversation that uses each word."""
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("i", "concept"))
    mentions = rows.select((F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000 + F.col("i")).alias("pos"), "concept", F.col("conv_id").cast("string").alias("section"))
    return sections.register_concepts(mentions).drop("concept")


@query
def research_agenda(spark, sf):
    """First sentences as gaps."""
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.get(F.split("text", r"\."), F.lit(0)).alias("description"), F.get(F.array(F.lit("low"), F.lit("High"), F.lit("medium"), F.lit("later")), (F.col("doc_id") % 4).cast("int")).alias("priority"))
    return sections.research_agenda(rows, 30)


def _replies(spark, sf):
    rows = _read(spark, sf, "labels")
    word = F.when(F.col("quality") == 1, "include").otherwise("exclude")
    clean = F.concat(F.lit('{"decision": "'), word, F.lit('", "confidence": 0.'), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(', "justification": "because"}'))
    raw = F.when(F.col("doc_id") % 4 == 0, clean).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Sure: "), clean)).otherwise("I cannot say")
    return rows.select("doc_id", raw.alias("reply"))


@query
def screening_replies(spark, sf):
    """J4."""
    return _rounded(_replies(spark, sf).select("doc_id", replies.screening_reply(F.col("reply")).alias("r")).select("doc_id", "r.*"))


@query
def rob_replies(spark, sf):
    """J6, D14."""
    rows = _read(spark, sf, "labels")
    clean = F.concat(F.lit('[{"domain": "selection", "rating": "'), F.when(F.col("quality") == 1, "low").otherwise("high"), F.lit('", "justification": "x"}]'))
    raw = F.when(F.col("doc_id") % 3 == 0, clean).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).otherwise("none")
    parsed = rows.select("doc_id", replies.rob_reply(raw).alias("d"))
    return parsed.select("doc_id", F.size("d").alias("n_domains"), meta.overall_rating(F.col("d")).alias("overall_rating"))


@query
def rewrites_by_position(spark, sf):
    """The texts of even conversations come back with a word in front, those of every third one short of a turn."""
    rows = _read(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("body")).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("place"), F.lit("h").alias("heading"), "body")
    back = rows.where("chapter % 2 = 0 and not (chapter % 3 = 0 and place = 0)").select("chapter", "place", F.concat(F.lit("new "), "body").alias("body"))
    return synthesis.take_rewrites(rows, back).select("chapter", "place", F.md5("body").alias("body_md5"))


@query
def chapter_questions(spark, sf):
    """Conversations as chapters, the first words of their turns as questions."""
    rows = _read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("parent"), F.col("turn").alias("section_pos"), F.slice(T.words(F.col("text")), 1, 2).alias("research_questions"))
    return synthesis.chapter_questions(rows).select("parent", F.md5(F.array_join("questions", " ")).alias("questions_md5"))


def maps_of(spark, sf):
    """Theme replies made of labels: some broken, some with ids that the evidence does not have."""
    rows = _read(spark, sf, "labels")
    body = F.concat(F.lit('{"consensus_points": [{"statement": "s", "strength": "x", "evidence_chunk_ids": ["c'), (F.col("doc_id") % 4).cast("string"), F.lit('", "c9"]}], "contradictions": ['), F.when(F.col("quality") == 0, '{"point": "p", "evidence_chunk_ids": ["c1"]}').otherwise(""), F.lit('], "knowledge_gaps": [{"description": "d", "priority": "low"}]}'))
    raw = F.when(F.col("doc_id") % 5 == 0, "broken").otherwise(body)
    known = F.array(F.lit("c1"), F.lit("c2"))
    return rows.select(F.col("doc_id").cast("string").alias("theme"), replies.theme_reply(raw, known, F.when(F.col("doc_id") % 7 == 0, 0).otherwise(2)).alias("m")).select("theme", "m.*")


@query
def theme_replies(spark, sf):
    """What is left of each map, and whether every point names a chunk."""
    maps = maps_of(spark, sf)
    return maps.select("theme", F.size("consensus").alias("n_consensus"), F.size("contradictions").alias("n_contradictions"), F.get("gaps", F.lit(0))["priority"].alias("first_priority"), sections.grounded(F.col("consensus"), F.col("contradictions")).alias("grounded"))


@query
def theme_totals(spark, sf):
    """D16."""
    return synthesis.theme_totals(maps_of(spark, sf))


@query
def relevance_replies(spark, sf):
    """Verdicts of the relevance judge."""
    rows = _read(spark, sf, "labels")
    body = F.concat(F.lit('{"is_relevant": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "confidence": 0.'), (F.col("doc_id") % 10).cast("string"), F.lit(', "claim": "c \\p"}'))
    raw = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: "), body)).otherwise("none")
    return rows.select("doc_id", replies.relevance_reply(raw)["verdict"].alias("verdict"))


@query
def page_titles(spark, sf):
    """A12's kind of extraction: title and paragraphs of raw pages."""
    rows = _read(spark, sf, "pages")
    return rows.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<p[ >]")).alias("n_paragraphs"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("n_links"))


@query
def event_windows(spark, sf):
    """Tumbling windows over the audit events, as the stream computes them."""
    rows = _read(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@cache
def _sql() -> dict[str, str]:
    return oracle.queries()


SQL = _sql()

from scholium.plans import reading, writing  # noqa: E402, F401  they register queries and SQL of their own
