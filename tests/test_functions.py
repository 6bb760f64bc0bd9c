"""Golden cases of scalar functions; one job for all of them."""

from pyspark.sql import functions as F

from scholium.functions import lexicon
from scholium.functions import text as T
from scholium.operators import meta, profile, replies, screening, sections

def cases():
    S = F.lit
    return {
        "chunk_id": (T.chunk_id(S("p1"), S(0)), "31121511e83e8fc7"),
        "author": (T.filename_author(S("A._Saravanan_2019")), "A. Saravanan"),
        "year": (T.filename_year(S("A._Saravanan_2019")), 2019),
        "no_year": (T.filename_year(S("unknown_file")), None),
        "stem": (T.filename_author(S("unknown_file")), "unknown file"),
        "kelvin": (F.transform(T.temperatures_k(S("from -56.6 °C to 31,1 ºC")), lambda x: F.round(x, 2)), [216.55, 304.25]),
        "kelvin_quirk": (T.temperatures_k(S("10-20 K, 216,58 K, 5 k items")), [-20.0, 216.58, 5.0]),
        "bar": (T.pressures_bar(S("5 bar, 1 MPa, 200 kPa")), [5.0, 10.0, 2.0]),
        "range_confidence": (T.value_range(T.pressures_bar(S("5 bar, 1 MPa")))["confidence"], 0.4),
        "range_empty": (T.value_range(T.pressures_bar(S("none")))["max"], None),
        "corruption": (T.corruption_tokens(S("/C12 then C30 C and 1/2/3")), ["/C12", "C30 C", "1/2/3"]),
        "corruption_grade": (T.corruption_severity(T.corruption_tokens(S("/C12 then C30 C and 1/2/3"))), "high"),
        "grounding": (T.grounding(S("Yield was 98% at 300 K and 5.2 bar [chunk:31121511e83e8fc7].")), 0.5),
        "grounding_none": (T.grounding(S("No numbers.")), 1.0),
        "citations": (T.dedup_citations(S("(A, 2023; a, 2023; B, 2024)")), "(A, 2023; B, 2024)"),
        "citations_apart": (T.dedup_citations(S("x (one; one) y (C, 2020; C, 2020) z")), "x (one; one) y (C, 2020) z"),
        "cleanup": (T.textual_cleanup(S("catalise /C12 C30 C\nIn summary all is well.\n\n\n\n\nend")), "catálise  30 C\n\nend"),
        "thermo": (T.thermo_fixes(S("Sublimation is exothermic. Other.\n\nDeposition is endothermic."))["text"], "Sublimation is endothermic. Other.\n\nDeposition is exothermic."),
        "thermo_count": (T.thermo_fixes(S("Sublimation is exothermic. Fine."))["fixes"], 1),
        "latex": (T.escape_latex(S("50% of $x_1 & {a}\\")), r"50\% of \$x\_1 \& \{a\}\textbackslash{}"),
        "latex_inline": (T.inline_latex(S("**bold** _it_ a_b")), r"\textbf{bold} \textit{it} a\_b"),
        "labels": (T.labels(S("Dry ice in a supercritical CO₂ snow"), lexicon.FLUIDS), ["CO2_R744", "CO2_solid"]),
        "phases": (T.labels(S("SUBCRÍTICO"), lexicon.PHASES, "unknown"), ["subcritical"]),
        "default_phase": (T.labels(S("plain"), lexicon.PHASES, "unknown"), ["unknown"]),
        "keywords": (profile.top_keywords(T.keywords(S("Beta alpha the beta_1 alpha gamma with beta alpha")), 2), ["alpha", "beta"]),
        "claims": (F.transform(T.claims(S("Too short 5 K. The pressure rose to 73.8 bar in the test rig. Efficiency was improved in every run of it. The pressure rose to 73.8 bar in the test rig.")), lambda c: c["claim_type"]), ["quant", "qual"]),
        "concept": (T.concept_key(S("  Catálise   HETEROGÊNEA ")), "catalise heterogenea"),
        "safe_name": (T.safe_name(S('a: b/c  "d"?')), "a_b_c_d"),
        "safe_empty": (T.safe_name(S("??")), "unnamed"),
        "paper_doi": (T.paper_id(S(""), S(" 10.1/x ")), "10.1/x"),
        "paper_none": (T.paper_id(S(None).cast("string"), S("")), "unknown_paper"),
        "citation_pmid": (T.study_citation(S(""), S(None).cast("int"), S("Some_Name_2020")), "(Some Name 2020)"),
        "holding": (T.holding(S("capsaicin and bio-oil"), T.normalised(S("capsaicin and bio-oil")), F.array(S("psa"), S("bio oil"), S("none"), S(" "))), ["psa", "bio oil"]),
        "cell": (T.cell_text(S("  ")), "—"),
        "rob_high": (meta.overall_rating(F.array(*(F.struct(S(r).alias("rating")) for r in ("High ", "low")))), "high"),
        "rob_moderate": (meta.overall_rating(F.array(*(F.struct(S(r).alias("rating")) for r in ("unclear", "unclear", "low")))), "moderate"),
        "rob_low": (meta.overall_rating(F.array(*(F.struct(S(r).alias("rating")) for r in ("unclear", "low")))), "low"),
        "decide": (F.array(*(screening.decide(S(d), S(c)) for d, c in (("include", 0.75), ("include", 0.5), ("include", 0.25), ("exclude", 0.9), ("maybe", 0.5)))), ["include", "ambiguous", "exclude", "exclude", "ambiguous"]),
        "blend": (sections.blended_score(S(8.0), S(1.0), S(1.0), S(0.5), S(0)), 8.1),
        "blend_flagged": (sections.blended_score(S(8.0), S(1.0), S(0.75), S(1.0), S(1)), 7.1),
        "screen_clean": (replies.screening_reply(S('{"decision": "include", "confidence": 0.9, "justification": "j"}')), ("include", 0.9, "j")),
        "screen_fenced": (replies.screening_reply(S('```json\n{"decision": "include", "confidence": 0.9, "justification": "j"}\n```')), ("include", 0.9, "j")),
        "screen_chatter": (replies.screening_reply(S('Sure: {"decision": "include", "confidence": 0.9, "justification": "j"}')), ("include", 0.9, "j")),
        "screen_bad": (replies.screening_reply(S("no idea")), ("exclude", 0.5, "no idea")),
        "screen_empty": (replies.screening_reply(S("")), ("exclude", 0.5, "")),
        "rob_bad": (F.transform(replies.rob_reply(S("nothing")), lambda x: x["rating"]), ["unclear"] * 5),
        "rob_good": (F.transform(replies.rob_reply(S('[{"domain": "a", "rating": "low", "justification": "x"}]')), lambda x: x["rating"]), ["low"]),
        "query_loose": (replies.query_reply(S('Well, "population": "adults" and "query": "a AND b"'))["query"], "a AND b"),
        "query_raw": (replies.query_reply(S("plain words"))["query"], "plain words"),
        "concepts_json": (replies.concept_list(S('Here: ["a b", "A B", "c"]')), ["a b", "c"]),
        "concepts_bullets": (replies.concept_list(S("- first one\n- second one")), ["first one", "second one"]),
        "concepts_commas": (replies.concept_list(S("one, two")), ["one", "two"]),
        "concepts_none": (replies.concept_list(S("")), []),
        "table_stray": (replies.table_reply(S('Text {"caption": "a \\p", "columns": ["x"], "rows": [{"x": 1}]} end'))["columns"], ["x"]),
        "table_bad": (replies.table_reply(S("none")), None),
        "theme_bad": (replies.theme_reply(S("bad"), F.array(S("c1")), S(3))["gaps"][0]["priority"], "low"),
        "theme_empty": (replies.theme_reply(S("{}"), F.array(S("c1")), S(0))["gaps"][0]["priority"], "high"),
        "theme_ids": (replies.theme_reply(S('{"consensus_points": [{"statement": "s", "strength": "x", "evidence_chunk_ids": ["c1", "c9"]}]}'), F.array(S("c1")), S(1))["consensus"][0]["ids"], ["c1"]),
        "relevance_kept": (replies.relevance_reply(S('{"is_relevant": true, "confidence": 0.9, "claim": "c"}'))["verdict"], "kept"),
        "relevance_low": (replies.relevance_reply(S('Ok {"is_relevant": true, "confidence": 0.5} end'))["verdict"], "low_confidence"),
        "relevance_out": (replies.relevance_reply(S('{"is_relevant": false}'))["verdict"], "irrelevant"),
        "relevance_bad": (replies.relevance_reply(S("yes"))["verdict"], "unreadable"),
        "critical_bad": (replies.critical_reply(S("hm")), ("hm", "média")),
        "review_bad": (replies.review_reply(S("hm"), S(False)), 7.0),
        "review_empty": (replies.review_reply(S(""), S(True)), 10.0),
        "review_criteria": (replies.review_reply(S('{"criteria": [{"score": 6}, {"score": 8}]}'), S(False)), 7.0),
    }


def plain(value):
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    return [plain(x) for x in value] if isinstance(value, list) else value


def test_golden(spark):
    table = cases()
    row = spark.range(1).select(*(c.alias(k) for k, (c, _) in table.items())).first()
    wrong = {k: (plain(row[k]), want) for k, (_, want) in table.items() if plain(row[k]) != want}
    assert not wrong


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark):
    """Patterns of claims and traces take \\b as SQL does: a letter beyond ASCII is no part of a word."""
    text = F.lit("Im Versuch lagen 12 Kübel auf dem Tisch. Der reduß Anteil war im Versuch nicht zu messen. Kein Wert und kein Vergleich in éhigh Satz.")
    got = spark.range(1).select(T.claims(text, 9)["claim_type"].alias("kinds"), T.corruption_tokens(F.lit("éC12 Cé und C3 C")).alias("traces"), T.grounding(F.lit("12 Kübel")).alias("grounding")).head()
    assert got.kinds == ["quant", "qual"] and got.traces == ["C12 C", "C3 C"] and got.grounding == 0.0
