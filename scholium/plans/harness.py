"""Lexicons, outline and settings that the registered queries use over the synthetic tables, which hold no domain vocabulary."""

from __future__ import annotations

KEYWORDS = ["the", "and", "that", "was", "for", "with", "licens", "idiot", "une", "und", "para"]
INCLUDE_RULES = ["released under", "schä"]
EXCLUDE_RULES = ["clown", "!!"]
CLUSTERS = {"english": [r"\bthe\b", r"\bwith\b"], "german": [r"\bund\b", r"\bmit\b"], "french": [r"\bles\b", r"\bune\b"], "spanish": [r"\bque\b", r"\blos\b"]}
ANCHORS = [r"\bthat\b", r"\bder\b", r"\bdes\b"]
NEGATIVES = [r"\bidiot\b", r"\bclown\b", r"\blicensed?\b", "!!"]
DOMAINS = {"english": [r"\bthe\b"], "german": [r"\bund\b", r"\bder\b"], "french": [r"\bles\b", r"\bune\b"], "spanish": [r"\blos\b", r"\bque\b"]}
FLUIDS = {"legal": [r"\blicens"], "loud": ["!!"]}
PHASES = {"dense": [r"\bthat\b", r"\bist\b"], "light": [r"\bpour\b", r"\bpara\b"]}
TOPOLOGIES = {"listed": [r"\|"], "plain": [r"\bis\b", r"\best\b"]}
NUMBERS = [(r"(\d+(?:[\.,]\d+)?)\s*[a-z]", 1.0, 0.0), (r"version (\d+)", 10.0, 0.5)]
TRACES = [r"\*\*\*", r"\d+\.\d+\.\d+", r"!!", r"###"]
VOCABULARY = ("the", "of", "and", "to", "in", "de", "la", "der", "und", "die", "que", "le", "el", "is", "les", "en")
STOPS = ["that", "with", "this", "from"]

#: parent, folder, prompt, domains, phases, required, forbidden, least similarity, foreign ratio, foreign share, strictness
OUTLINE = (
    ("Germanic", "english core", "the of and to", ["english"], [], ["with", "from"], ["idiot"], 0.1, 0.6, 0.9, "soft"),
    ("Germanic", "german core", "der und die in", ["german"], ["dense"], [], ["geen-mit"], 0.0, 0.0, 0.5, "soft"),
    ("Romance", "french core", "de la le les", ["french"], [], [], ["clown"], 0.2, 0.8, 0.0, "hard"),
    ("Romance", "spanish core", "de la que el", ["spanish"], ["light", "unknown"], ["para"], [], 0.0, 0.5, 0.3, "hard"),
    ("Mixed", "open", "the de der", [], [], [], [], 0.3, 0.0, 0.0, "soft"),
    ("Mixed", "strict", "in is en", ["english", "french"], [], ["la"], ["the idiot"], 0.05, 0.9, 0.7, "soft"),
)


def outline() -> list[dict]:
    names = ("parent", "folder", "prompt", "allowed_domains", "required_phase_regimes", "required_any_terms", "forbidden_terms", "min_similarity", "max_foreign_domain_ratio", "max_foreign_evidence_share", "routing_strictness")
    return [dict(zip(names, row)) for row in OUTLINE]


MAX_WORDS, OVERLAP, THRESHOLD, TOP_K, EVIDENCE = 120, 15, 0.25, 3, 20
EDGE_SIMILARITY = 0.3
Z95 = 1.959963984540054
