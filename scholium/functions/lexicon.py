"""Pattern and term tables. Every operator takes its table as a parameter; these are the defaults.

Patterns are Java regular expressions, matched without regard to case, also beyond ASCII.
"""

from __future__ import annotations

# Subject domains.
DOMAINS = {
    "refrigeration": [r"\brefrigeration\b", r"\bcold storage\b", r"\bvcrc\b", r"\bevaporator\b|\bcondenser\b"],
    "heat_transfer": [r"\bboiling\b|\bnucleate\b", r"\bheat transfer\b|\bthermal conductivity\b", r"\bcritical heat flux\b|\bCHF\b"],
    "materials": [r"\bphase change material\b|\bPCM\b", r"\bencapsulation\b|\bcomposite\b", r"\bporous\b|\bmicrostructure\b"],
    "energy_storage": [r"\bthermal energy storage\b|\bTES\b|\bCTES\b|cold thermal energy storage", r"\bLAES\b|\bliquid air\b", r"\bcharge\b|\bdischarge\b"],
    "process_chemical": [
        r"\bWGS\b|water[- ]gas shift",
        r"\bPSA\b|pressure swing adsorption",
        r"\bASU\b|air separation unit",
        r"\bRPlug\b|\bRGibbs\b|\bAspen\b",
        r"\breactor\b|\bcatalyst\b|\bsyngas\b",
        r"\bpyrolysis\b|\bbio[- ]oil\b|\bbiochar\b|\bbiodiesel\b",
        r"\bmicroalgae\b|\banaerobic digestion\b|\bbiogas\b|\bfermentation\b",
        r"\bsteam reforming\b|\bmethanol\b|\bglycerol\b|\btransesterification\b",
        r"\bdiesel engine\b|\bengine emissions?\b|\blow[- ]carbon fuels?\b",
        r"\bdac\b|\bccu\b|\bdirect air capture\b|\bcarbon capture\b",
    ],
}
# Working fluids.
FLUIDS = {
    "CO2_R744": [r"\bR744\b", r"\bCO2\b|\bCO₂"],
    "CO2_solid": [r"\bdry ice\b", r"\bsolid CO2\b|\bCO2 snow\b|\bCO₂ snow\b"],
    "air": [r"\bair\b", r"\bliquid air\b"],
}
# Phase regimes.
PHASES = {
    "solid": [r"\bsolid\b", r"\bdry ice\b"],
    "near_triple_point": [r"\btriple point\b|\bponto triplo\b"],
    "subcritical": [r"\bsubcritical\b|\bsubcr[ií]tico\b"],
    "transcritical": [r"\btranscritical\b|\btranscr[ií]tico\b"],
    "supercritical": [r"\bsupercritical\b|\bsupercr[ií]tico\b"],
}
# System topologies.
TOPOLOGIES = {
    "vcrc": [r"\bvcrc\b|vapou?r compression"],
    "brayton": [r"\bbrayton\b"],
    "laes": [r"\blaes\b|liquid air energy storage"],
    "tes_tank": [r"\bTES\b|thermal energy storage tank"],
    "pcm_module": [r"\bPCM\b|phase change material module"],
}
# Scope clusters.
SCOPE_CLUSTERS = {
    "refrigeration_hp": [r"\br744\b", r"\btranscritical\b|\bsubcritical\b", r"\bgas cooler\b|\bevaporator\b|\bcondenser\b", r"\bejector\b|\bparallel compression\b|\beconomizer\b"],
    "cold_storage_ctes": [
        r"\bctes\b|cold thermal energy storage",
        r"\bcold storage\b|\bcold chain\b",
        r"\bdry ice\b|\bsolid co2\b|\bco2 snow\b",
        r"\bsublimation\b|\bboil[- ]off\b|\bsub[- ]zero\b|\bultra[- ]low temperature\b",
    ],
    "cryogenic_systems": [
        r"\blaes\b|liquid air energy storage",
        r"\bliquid air\b|\bcryogenic (?:energy storage|battery|tank|systems?)\b",
        r"\bcold recovery\b|\bliquefaction\b|\bregasification\b",
    ],
    "co2_phase_thermo": [
        r"\btriple point\b|\bponto triplo\b",
        r"\bphase diagram\b|\bphase equilibrium\b",
        r"\bnucleate boiling\b|\bpool boiling\b|\bcritical heat flux\b|\bchf\b",
    ],
}
# Scope anchors.
SCOPE_ANCHORS = [
    r"\br744\b",
    r"\blaes\b|liquid air energy storage",
    r"\bdry ice\b|\bsolid co2\b|\bco2 snow\b",
    r"\btriple point\b|\bponto triplo\b",
    r"\bnucleate boiling\b|\bpool boiling\b|\bcritical heat flux\b|\bchf\b",
    r"\bcold thermal energy storage\b|\bctes\b",
]
# Signs of other subjects.
SCOPE_NEGATIVES = [
    r"\bpyrolysis\b|\bbio[- ]oil\b|\bbiochar\b",
    r"\bbiodiesel\b|\bmicroalgae\b|\banaerobic digestion\b|\bbiogas\b",
    r"\bfermentation\b|\bsyngas\b|\bsteam reforming\b|\bmethanol\b|\bglycerol\b|\btransesterification\b",
    r"\bwgs\b|\bpsa\b|\basu\b|\brplug\b|\brgibbs\b|\baspen\b",
    r"\breactor\b|\bcatalyst\b|\bhydrotreat(?:ing|ment)\b|\bfischer[- ]tropsch\b",
    r"\bdac\b|\bccu\b|\bdirect air capture\b|\bcarbon capture\b|\bengine emissions?\b|\bice emissions?\b",
    r"\blow[- ]carbon fuels?\b|\bdiesel engine\b|\bspark ignition\b|\bcompression ignition\b",
]
# Words that are no keywords.
KEYWORD_STOPS = ["the", "and", "for", "with", "from", "this", "that", "were", "was", "uma", "para", "com", "dos", "das", "nos", "nas", "como", "sobre"]
# Quantities, signs of a comparison, numeric claims, references.
QUANTITY = r"\b\d+(?:[\.,]\d+)?\s*(?:K|°\s?C|º\s?C|bar|MPa|kPa|%)\b"
COMPARISON = r"\b(?:increase|decrease|improv|redu|enhanc|higher|lower|melhor|pior|aument|reduz)\w*\b"
NUMERIC_CLAIM = r"\b\d+(?:[\.,]\d+)?\s*(?:%|K|°\s?C|º\s?C|bar|MPa|kPa)\b|\b\d+(?:[\.,]\d+)?\s*[-–]\s*\d+(?:[\.,]\d+)?\b"
CHUNK_REF = r"\[chunk:([a-f0-9]{8,32})\]"
PAPER_REF = r"\[paper:([^\]]+)\]"
# Unit patterns with the factor and offset to kelvin or bar, in the order they are tried.
TEMPERATURES = [(r"(-?\d+(?:[\.,]\d+)?)\s*(?:°\s?C|º\s?C|deg\s?C|celsius)", 1.0, 273.15), (r"(-?\d+(?:[\.,]\d+)?)\s*K\b", 1.0, 0.0)]
PRESSURES = [(r"(\d+(?:[\.,]\d+)?)\s*bar\b", 1.0, 0.0), (r"(\d+(?:[\.,]\d+)?)\s*MPa\b", 10.0, 0.0), (r"(\d+(?:[\.,]\d+)?)\s*kPa\b", 0.01, 0.0)]
# Traces of broken tables; the first is matched without regard to case.
CORRUPTION = [r"(?i)/C\d+", r"\bC\d+\s+C\b", r"\b\d+\s*/\s*\d+\s*/\s*\d+\b", r"\|\s*\|\s*\|", "�"]
# Points of CO2 (K, bar) that the phase checks use.
CO2_TRIPLE_K, CO2_CRITICAL_K, CO2_CRITICAL_BAR = 216.58, 304.13, 73.8
NEAR_TRIPLE_MAX_K, NEAR_TRIPLE_MIN_BAR, SOLID_MARGIN_K = 230.0, 3.0, 2.0
# Sentences that a language model leaves in another language.
STRAY_SENTENCES = [
    r"(?m)^\s*Future research directions[^.]*\.\s*$",
    r"(?m)^\s*In summary[^.]*\.\s*$",
    r"(?m)^\s*In conclusion[^.]*\.\s*$",
    r"(?m)^\s*Overall[,;][^.]*\.\s*$",
    r"(?m)^\s*This section (?:discusses|presents|reviews|examines)[^.]*\.\s*$",
]
# Spellings to mend.
SPELLINGS = {
    "catalise": "catálise",
    "catalises": "catálises",
    "Catalise": "Catálise",
    "transesterificaçao": "transesterificação",
    "Transesterificaçao": "Transesterificação",
    "saponificaçao": "saponificação",
    "esterificaçao": "esterificação",
}
# Characters that LaTeX reserves.
LATEX = {
    "\\": r"\textbackslash{}",
    "&": r"\&",
    "%": r"\%",
    "$": r"\$",
    "#": r"\#",
    "_": r"\_",
    "{": r"\{",
    "}": r"\}",
    "~": r"\textasciitilde{}",
    "^": r"\textasciicircum{}",
}
# Domains of a risk of bias.
ROB_DOMAINS = ["selection", "performance", "detection", "attrition", "reporting"]
