"""DuckDB SQL for the registered queries, written from the same lexicons but on its own terms: joins, windows and list
functions over the raw tables."""

from __future__ import annotations

from scholium.functions import lexicon
from scholium.plans import harness as H


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def terms(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


def bounded(pattern: str) -> str:
    """The pattern with its outer word boundaries spelt out, as RE2 takes letters beyond ASCII for no word characters."""
    other = r"[^\p{L}\p{M}\p{N}_]"
    head = pattern.startswith(r"\b")
    tail = pattern.endswith(r"\b")
    return f"(?i){f'(?:^|{other})' if head else ''}{pattern[2 * head : len(pattern) - 2 * tail]}{f'(?:$|{other})' if tail else ''}"


def any_of(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(bounded(p))})" for p in patterns) + ")"


def count_of(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {q(bounded(p))})::INT" for p in patterns) + ")"


def labels(text: str, table: dict[str, list[str]]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {any_of(text, p)} THEN {q(k)} END" for k, p in table.items()) + "], lambda x: x IS NOT NULL))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


STUDIES = rf"""
lined AS (SELECT doc_id, source, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls
          FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
studies AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS pmid, coalesce(ls[1], CAST(doc_id AS VARCHAR)) AS title,
            CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], chr(10)) ELSE t END AS abstract, source AS authors, t AS raw_text FROM lined)"""

TITLE_KEY = f"lower({strip('title')})"
FIRST_TITLES = f"""
titled AS (SELECT * FROM studies QUALIFY row_number() OVER (PARTITION BY {TITLE_KEY} ORDER BY pos) = 1)"""


def chunks(of: str, n: int = H.MAX_WORDS, k: int = H.OVERLAP) -> str:
    """CTEs that end in chunk(pos, study_pmid, chunk_index, text, start_char, end_char, chunk_id)."""
    over = "len(acc.cur) + len(s.ws) > " + str(n) + " AND len(acc.cur) > 0"
    kept = f"CASE WHEN len(acc.cur) > {k} THEN acc.cur[-{k}:] ELSE []::VARCHAR[] END"
    closed = "{'t': array_to_string(acc.cur, ' '), 'a': acc.a}"
    zero = "{'out': []::STRUCT(t VARCHAR, a INTEGER)[], 'cur': []::VARCHAR[], 'a': 0, 'p': 0}"
    return rf"""
whole AS (SELECT pos, pmid, CASE WHEN abstract <> '' THEN title || '. ' || abstract ELSE title END AS t FROM {of}),
cut AS (SELECT pos, pmid, t, list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
          lambda s: {{'n': CAST(length(s) AS INTEGER), 'ws': list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')}}) AS ss FROM whole),
fold AS (SELECT pos, pmid, t, list_reduce(ss, lambda acc, s: CASE
          WHEN len(s.ws) = 0 THEN {{'out': acc.out, 'cur': acc.cur, 'a': acc.a, 'p': acc.p + s.n + 1}}
          WHEN {over} THEN {{'out': list_append(acc.out, {closed}), 'cur': list_concat({kept}, s.ws),
                             'a': CASE WHEN len(acc.cur) > {k} THEN acc.p - CAST(length(array_to_string(acc.cur[-{k}:], ' ')) AS INTEGER) ELSE acc.p END, 'p': acc.p + s.n + 1}}
          ELSE {{'out': acc.out, 'cur': list_concat(acc.cur, s.ws), 'a': acc.a, 'p': acc.p + s.n + 1}} END, {zero}) AS f FROM cut),
closed AS (SELECT pos, pmid, CASE WHEN {strip('t')} = '' THEN [{{'t': t, 'a': 0}}] WHEN len(f.cur) > 0 THEN list_append(f.out, {{'t': array_to_string(f.cur, ' '), 'a': f.a}}) ELSE f.out END AS cs FROM fold),
chunk AS (SELECT pos, pmid AS study_pmid, CAST(i - 1 AS INTEGER) AS chunk_index, cs[i].t AS text, cs[i].a AS start_char, CAST(cs[i].a + length(cs[i].t) AS INTEGER) AS end_char,
          substr(sha256(pmid || '::' || CAST(i - 1 AS VARCHAR)), 1, 16) AS chunk_id FROM (SELECT pos, pmid, cs, unnest(range(1, len(cs) + 1)) AS i FROM closed))"""


FULL = "(title || chr(10) || abstract || chr(10) || raw_text)"
SCOPE_TEXT = "(title || chr(10) || abstract || chr(10) || substr(raw_text, 1, 6000))"


def scoped(of: str) -> str:
    hits = {k: count_of("t", p) for k, p in H.CLUSTERS.items()}
    return f"""
scope1 AS (SELECT pos, pmid, list_sort(list_filter([{", ".join(f"CASE WHEN {n} > 0 THEN {q(k)} END" for k, n in hits.items())}], lambda x: x IS NOT NULL)) AS cl,
           {count_of('t', H.ANCHORS)} AS anchor_hits, {count_of('t', H.NEGATIVES)} AS negative_hits FROM (SELECT pos, pmid, {SCOPE_TEXT} AS t FROM {of})),
scope2 AS (SELECT *, CAST(len(cl) + least(anchor_hits, 3) AS INTEGER) AS positive_score FROM scope1),
scoped AS (SELECT *, positive_score >= 2 AND NOT ((anchor_hits = 0 AND negative_hits >= 2) OR (anchor_hits > 0 AND negative_hits > 6)) AS in_scope FROM scope2)"""


def keyword_list(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[A-Za-zÀ-ÿ0-9_\-]{{4,}}'), lambda w: w NOT IN ({", ".join(map(q, H.STOPS))}))"


KEYWORDS_TOP = f"""
kw1 AS (SELECT pos, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT pos, {keyword_list('raw')} AS ws FROM kw0)),
kw2 AS (SELECT pos, w, count(*) AS n, min(i) AS i FROM kw1 GROUP BY pos, w),
kw3 AS (SELECT pos, w, n, i FROM kw2 QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, i) <= 15),
kw AS (SELECT pos, list(w ORDER BY n DESC, i) AS ks FROM kw3 GROUP BY pos)"""


def sig(x: str) -> str:
    """x to five significant digits, as digits and exponent."""
    return f"(CASE WHEN ({x}) = 0 THEN '0' ELSE CAST(CAST(floor(({x}) / pow(10.0, floor(log10(abs({x})))) * 1e4 + 0.5) AS BIGINT) AS VARCHAR) || 'e' || CAST(CAST(floor(log10(abs({x}))) AS INTEGER) AS VARCHAR) END)"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def held(text: str, ts: str) -> str:
    return f"list_filter({ts}, lambda z: trim(z) <> '' AND (contains({text}, z) OR ({norm('z')} <> '' AND contains(' ' || {norm(text)} || ' ', ' ' || {norm('z')} || ' '))))"


def vector(words: str) -> str:
    return "[" + ", ".join(f"CAST(len(list_filter({words}, lambda w: w = {q(v)})) AS DOUBLE)" for v in H.VOCABULARY) + "]"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda y: y / (sqrt(list_sum(list_transform({v}, lambda z: z * z))) + 1e-9))"


def outline_rows() -> str:
    rows = []
    for i, (parent, folder, prompt, domains, phases, need, ban, least, ratio, share, strict) in enumerate(H.OUTLINE):
        words = prompt.lower().split()
        counts = [float(words.count(v)) for v in H.VOCABULARY]
        limit = lambda x: min(1.0, max(0.0, x or 1.0))
        rows.append(f"({i}, {q(parent)}, {q(folder)}, {terms(domains)}, {terms(phases)}, {terms(need)}, {terms(ban)}, {float(least)}::DOUBLE, {limit(ratio)}::DOUBLE, {limit(share)}::DOUBLE, {q(strict)}, {counts}::DOUBLE[])")
    return ", ".join(rows)


def routed() -> str:
    """CTEs that end in scan (every scanned pair), tag, judged and ranked."""
    low = rf"list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: trim(w, '.,;:!?'))"
    fails = {
        "f1": "len(ad) > 0 AND len(list_intersect(domains, ad)) = 0",
        "f2": "len(ad) > 0 AND len(domains) > 0 AND fr > mr",
        "f3": "len(ph) > 0 AND len(list_intersect(phases, ph)) = 0",
        "f4": "len(need) > 0 AND len(met) = 0",
        "f5": "len(ban) > 0 AND len(hit) > 0",
    }
    # In a hard section a test runs only if none before it failed.
    ran = {k: " AND ".join(["true", *(f"NOT {j}" for j in list(fails)[:i])]) for i, k in enumerate(fails)}
    factor = {"f1": 0.25, "f2": 0.2, "f3": 0.35, "f4": 0.2, "f5": 0.1}
    score = " * ".join(f"CASE WHEN {k} AND (NOT hard OR ({ran[k]})) THEN {factor[k]}::DOUBLE ELSE 1.0::DOUBLE END" for k in fails)
    joined = lambda k, xs: f"{q(k)} || array_to_string({xs}[1:4], ',')"
    note = {
        "f1": "CASE WHEN len(ad) = 0 THEN NULL WHEN f1 THEN 'domain_mismatch' ELSE 'domain_match=' || array_to_string(list_sort(list_filter(ad, lambda z: list_contains(domains, z))), ',') END",
        "f2": "CASE WHEN f2 THEN 'foreign_domain_ratio=' || printf('%.2f', fr) END",
        "f3": "CASE WHEN len(ph) = 0 THEN NULL WHEN f3 THEN 'phase_mismatch' ELSE 'phase_match=' || array_to_string(list_sort(list_filter(ph, lambda z: list_contains(phases, z))), ',') END",
        "f4": f"CASE WHEN len(need) = 0 THEN NULL WHEN f4 THEN 'required_any_terms_missing' ELSE {joined('required_any_terms=', 'met')} END",
        "f5": f"CASE WHEN f5 THEN {joined('forbidden_terms=', 'hit')} END",
    }
    notes = "list_filter([" + ", ".join(f"CASE WHEN NOT hard OR ({ran[k]}) THEN {note[k]} END" for k in fails) + "], lambda z: z IS NOT NULL)"
    flags = "list_filter([" + ", ".join(f"CASE WHEN {k} AND (NOT hard OR ({ran[k]})) THEN {{'t': {q(t)}, 's': {s}}} END" for (k, t, s) in (
        ("f1", "domain_mismatch", "CASE WHEN hard THEN 'high' ELSE 'medium' END"), ("f2", "foreign_domain_ratio", "CASE WHEN hard THEN 'high' ELSE 'medium' END"),
        ("f3", "phase_mismatch", "CASE WHEN hard THEN 'high' ELSE 'medium' END"), ("f4", "required_any_terms_missing", "CASE WHEN hard THEN 'high' ELSE 'medium' END"), ("f5", "forbidden_terms", "'high'"))) + "], lambda z: z IS NOT NULL)"
    return f"""
WITH {STUDIES}, {FIRST_TITLES}, {scoped('titled')},
kept AS (SELECT titled.* FROM titled JOIN scoped USING (pos) WHERE in_scope), {chunks('kept')},
full1 AS (SELECT pos, pmid, {FULL} AS ft FROM kept),
kw0 AS (SELECT pos, ft AS raw FROM full1), {KEYWORDS_TOP},
prof AS (SELECT pos, pmid, domains, CASE WHEN len(p0) = 0 THEN ['unknown'] ELSE p0 END AS phases, lower(array_to_string(coalesce(ks, []::VARCHAR[]), ' ') || ' ' || array_to_string(fluids, ' ') || ' ' || array_to_string(topo, ' ') || ' ' || array_to_string(domains, ' ')) AS blob
         FROM (SELECT pos, pmid, {labels('ft', H.DOMAINS)} AS domains, {labels('ft', H.PHASES)} AS p0, {labels('ft', H.FLUIDS)} AS fluids, {labels('ft', H.TOPOLOGIES)} AS topo FROM full1) LEFT JOIN kw USING (pos)),
outline(section_pos, parent, folder, ad, ph, need, ban, least_sim, mr, share_limit, strict, v) AS (VALUES {outline_rows()}),
vec AS (SELECT chunk_id, study_pmid, text, {unit('v0')} AS v FROM (SELECT chunk_id, study_pmid, text, {vector('ws')} AS v0 FROM (SELECT chunk_id, study_pmid, text, {low} AS ws FROM chunk))),
sim AS (SELECT chunk_id, study_pmid, text, o.* EXCLUDE (v), floor(list_dot_product(vec.v, {unit('o.v')}) * 1e9 + 0.5) / 1e9 AS s FROM vec, outline o),
near AS (SELECT sim.*, domains, phases, blob, strict = 'hard' AS hard, len(list_filter(domains, lambda z: NOT list_contains(ad, z))) / greatest(len(domains), 1) AS fr
         FROM sim JOIN prof ON pmid = study_pmid WHERE s >= {H.THRESHOLD}),
met AS (SELECT *, {held("(lower(text) || chr(10) || blob)", 'need')} AS met, {held('lower(text)', 'ban')} AS hit FROM near),
fails AS (SELECT *, {", ".join(f"{test} AS {k}" for k, test in fails.items())} FROM met),
graded AS (SELECT *, {score} AS score, {notes} AS notes, {flags} AS flags, f1 OR f2 OR f3 OR f4 OR f5 AS failed FROM fails),
cand AS (SELECT *, s * score AS fs, CASE WHEN hard AND failed THEN false ELSE score >= 0.2 END AS ok, max((s < greatest({H.THRESHOLD}, least_sim))::INT) OVER w = 1 AS blocked
         FROM graded WINDOW w AS (PARTITION BY chunk_id ORDER BY s DESC, section_pos DESC ROWS UNBOUNDED PRECEDING)),
cand2 AS (SELECT *, NOT blocked AND ok AND fs >= {H.THRESHOLD} * CASE WHEN hard THEN 1.0 ELSE 0.6 END AS c FROM cand),
scan AS (SELECT * FROM (SELECT *, coalesce(sum(c::INT) OVER (PARTITION BY chunk_id ORDER BY s DESC, section_pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cand2) WHERE NOT blocked AND before < {H.TOP_K}),
tag AS (SELECT * FROM scan WHERE c)"""


def gated() -> str:
    """CTEs after routed() that end in judged and ranked. No physics flags arise from the harness's labels."""
    hits = lambda text, ts: f"len({held(text, ts)}) > 0"
    return f"""{routed()},
high AS (SELECT chunk_id AS id FROM scan WHERE len(list_filter(flags, lambda z: z.s = 'high')) > 0 UNION SELECT study_pmid FROM scan WHERE len(list_filter(flags, lambda z: z.s = 'high')) > 0
         UNION SELECT chunk_id FROM chunk WHERE {n_traces('text')} >= 3 UNION SELECT study_pmid FROM chunk WHERE {n_traces('text')} >= 3 UNION SELECT pmid FROM full1 WHERE {n_traces('ft')} >= 3),
judged AS (SELECT *, CASE WHEN score < 0.2 THEN 'low_eligibility' WHEN fs < least_sim THEN 'min_similarity'
             WHEN chunk_id IN (SELECT id FROM high) OR study_pmid IN (SELECT id FROM high) THEN 'high_flags'
             WHEN len(ad) > 0 AND len(list_intersect(domains, ad)) = 0 THEN 'allowed_domains' WHEN len(ad) > 0 AND len(domains) > 0 AND fr > mr THEN 'foreign_domain_ratio'
             WHEN len(ph) > 0 AND len(list_intersect(phases, ph)) = 0 THEN 'required_phase_regimes' WHEN len(ban) > 0 AND {hits('lower(text)', 'ban')} THEN 'forbidden_terms'
             WHEN len(need) > 0 AND NOT ({hits("(lower(text) || chr(10) || blob)", 'need')}) THEN 'required_any_terms' END AS reason FROM tag),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent, folder ORDER BY fs DESC, chunk_id) AS rank FROM judged WHERE reason IS NULL) WHERE rank <= {H.EVIDENCE}),
shares AS (SELECT parent, folder, count(*) AS n, avg(fs) AS sim, avg((len(domains) = 0 OR fr > 0)::INT) AS share, bool_and(len(ad) > 0) AND avg((len(domains) = 0 OR fr > 0)::INT) > max(share_limit) AS closed FROM top GROUP BY parent, folder)"""


REASONS = ("low_eligibility", "min_similarity", "missing_chunk", "high_flags", "allowed_domains", "foreign_domain_ratio", "required_phase_regimes", "forbidden_terms", "required_any_terms")

WRITTEN = """
w0 AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id),
written AS (SELECT CAST(conv_id AS VARCHAR) AS section_id, t || CASE WHEN n % 2 = 0 THEN ' Yield was 5.2 bar at 300 K and 10-20 [chunk:' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 16) || '] by [paper:p' || CAST(conv_id % 7 AS VARCHAR) || ']. /C12' ELSE '' END AS c FROM w0),
flag(i, ids) AS (VALUES (1, ['p1', 'x']), (2, ['p1']), (3, ['p3', 'p5'])),
seen AS (SELECT section_id, c, list_distinct(list_concat(regexp_extract_all(c, '(?i)\\[chunk:([a-f0-9]{8,32})\\]', 1), regexp_extract_all(c, '(?i)\\[paper:([^\\]]+)\\]', 1))) AS refs FROM written),
hit AS (SELECT section_id, count(*) AS h FROM seen, flag WHERE list_has_any(refs, ids) GROUP BY section_id)""".replace("\\\\", "\\")


def quality() -> str:
    n_claims = f"len(regexp_extract_all(c, {q('(?i)' + lexicon.NUMERIC_CLAIM)}))"
    refs = f"len(list_distinct(regexp_extract_all(c, {q('(?i)' + lexicon.CHUNK_REF)}, 1)))"
    traces = "len(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(c, {q(p)})" for p in lexicon.CORRUPTION) + ")))"
    banned = "list_filter(['the', 'QUE', 'zzz'], lambda z: contains(lower(c), lower(z)))"
    return f"""WITH {WRITTEN},
sq AS (SELECT section_id, array_to_string({banned}, ',') AS forbidden, round(greatest(0.0::DOUBLE, 1 - len({banned})::DOUBLE / 3), 3) AS cross_topic_contamination_score, CAST(coalesce(h, 0) AS BIGINT) AS physics_hits,
       round(greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * coalesce(h, 0)), 3) AS physics_consistency_score, CASE WHEN {n_claims} = 0 THEN 1.0::DOUBLE ELSE round(least({n_claims}, {refs})::DOUBLE / {n_claims}, 3) END AS grounding_score,
       round(greatest(0.0::DOUBLE, 1 - {traces}::DOUBLE / 5), 3) AS table_integrity_score FROM seen LEFT JOIN hit USING (section_id))"""


def n_traces(t: str) -> str:
    return "len(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all({t}, {q(p)})" for p in lexicon.CORRUPTION) + ")))"


def queries() -> dict[str, str]:
    kw_n = len(H.KEYWORDS)
    some = lambda ts: "(" + " OR ".join(f"contains(low, {q(t)})" for t in ts) + ")"
    decided = f"""WITH {STUDIES},
d0 AS (SELECT pos, pmid, lower(title || ' ' || abstract) AS low FROM studies),
d1 AS (SELECT pos, pmid, {" + ".join(f"contains(low, {q(k)})::INT" for k in H.KEYWORDS)} AS hits, {some(H.INCLUDE_RULES)} AS inc, {some(H.EXCLUDE_RULES)} AS exc FROM d0),
d2 AS (SELECT *, hits::DOUBLE / {kw_n} AS sc, printf('%.2f', hits::DOUBLE / {kw_n}) AS sh FROM d1),
decided AS (SELECT pos, pmid, CASE WHEN exc AND NOT inc THEN 'exclude' WHEN sc >= 0.3 OR inc THEN 'include' WHEN sc >= 0.15 THEN 'ambiguous' ELSE 'exclude' END AS decision,
  round(CASE WHEN exc AND NOT inc THEN 0.8 WHEN sc >= 0.3 OR inc THEN least(0.5 + sc, 1.0) WHEN sc >= 0.15 THEN sc ELSE 1.0 - sc END, 6) AS confidence,
  CASE WHEN exc AND NOT inc THEN 'Matched exclusion rule' WHEN sc >= 0.3 OR inc THEN 'Keyword match score: ' || sh || ' (' || hits || '/{kw_n} keywords)'
       WHEN sc >= 0.15 THEN 'Low keyword match: ' || sh || ' — flagged for review' ELSE 'Insufficient keyword match: ' || sh END AS justification FROM d2)"""
    number = lambda p, f, o: f"list_transform(regexp_extract_all(raw_text, {q('(?i)' + p)}, 1), lambda v: CAST(replace(v, ',', '.') AS DOUBLE) * {f} + {o})"
    unit_vec = "u AS (SELECT vec_id, " + unit("list_transform(embedding, lambda y: CAST(y AS DOUBLE))") + " AS v FROM embeddings)"
    pairs = f"{unit_vec}, pair AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS similarity FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) > {H.EDGE_SIMILARITY})"
    latex = "c"
    for k, v in {"\\": "\x01", "{": "\x02", "}": "\x03"}.items():
        latex = f"replace({latex}, {q(k)}, chr({ord(v)}))"
    for k, v in lexicon.LATEX.items():
        if k not in "\\{}":
            latex = f"replace({latex}, {q(k)}, {q(v)})"
    latex = latex.replace("c,", "coalesce(text, ''),", 1)
    for v, to in ((1, r"\textbackslash{}"), (2, r"\{"), (3, r"\}")):
        latex = f"replace({latex}, chr({v}), {q(to)})"
    tokens = "list_concat(" + ", ".join(f"regexp_extract_all(raw_text, {q(p)})" for p in H.TRACES) + ")"
    distinct_in_order = "list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN list_position(x, x[i]) = i THEN x[i] END), lambda z: z IS NOT NULL)"
    clean = """'{"decision": "' || CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END || '", "confidence": 0.' || CAST(doc_id % 90 + 10 AS VARCHAR) || ', "justification": "because"}'"""
    conf = "round(CAST('0.' || CAST(doc_id % 90 + 10 AS VARCHAR) AS DOUBLE), 6)"
    rating = lambda k: f"(['low', 'unclear', 'high', 'low', 'low'])[((doc_id * {k + 3} + quality + {k}) % 7 % 5 + 1)::INT]"
    rating_list = "[" + ", ".join(rating(k) for k in range(5)) + "]"
    claim = lambda c: f"CASE WHEN regexp_matches({c}, {q('(?i)' + lexicon.QUANTITY)}) THEN 'quant' WHEN regexp_matches({c}, {q('(?i)' + lexicon.COMPARISON)}) THEN 'qual' END"
    author, plain = "áàâãäåāăąçćčďéèêëēėęěíìîïīįłñńňóòôõöøōőŕřśšşťțúùûüūůűųýÿžźż", "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"
    meta_w = f"pow(CASE WHEN ci_upper <= ci_lower THEN 1e-6 ELSE (ci_upper - ci_lower) / (2 * {H.Z95}) END, -2)"
    maps = """WITH maps AS (SELECT CAST(doc_id AS VARCHAR) AS theme, CAST(CASE WHEN none OR bad THEN 0 ELSE 1 END AS INTEGER) AS c, CAST(CASE WHEN none OR bad OR quality <> 0 THEN 0 ELSE 1 END AS INTEGER) AS a,
        CASE WHEN none THEN 'high' ELSE 'low' END AS first_priority, none OR bad OR doc_id % 4 IN (1, 2) AS g FROM (SELECT *, doc_id % 7 = 0 AS none, doc_id % 5 = 0 AS bad FROM labels))"""
    out = {
        "studies_view": f"WITH {STUDIES} SELECT pos, pmid, title, abstract, authors FROM studies",
        "exact_title_dedup": f"WITH {STUDIES}, {FIRST_TITLES} SELECT pos, pmid FROM titled",
        "exact_title_log": f"WITH {STUDIES} SELECT kept_pmid, pmid AS removed_pmid, 1.0::DOUBLE AS similarity FROM (SELECT pos, pmid, first_value(pmid) OVER w AS kept_pmid, row_number() OVER w AS rn FROM studies WINDOW w AS (PARTITION BY {TITLE_KEY} ORDER BY pos)) WHERE rn > 1",
        "keep_first_insert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
        "keep_last_replace": "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1",
        "keyword_screening": f"{decided} SELECT * FROM decided",
        "prisma_counts": f"{decided} SELECT count(*) AS total_screened, count(*) FILTER (decision = 'include') AS included, count(*) FILTER (decision = 'exclude') AS excluded, count(*) FILTER (decision = 'ambiguous') AS ambiguous FROM decided",
        "retained_studies": f"{decided} SELECT pos, pmid FROM decided WHERE decision <> 'exclude'",
        "threshold_screening": """SELECT doc_id, CASE WHEN c >= 0.75 AND said = 'include' THEN 'include' WHEN c <= 0.25 OR said = 'exclude' THEN 'exclude' ELSE 'ambiguous' END AS decision
            FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'include' WHEN toxic = 1 THEN 'exclude' ELSE 'maybe' END AS said, (doc_id * 37 % 101) / 100.0::DOUBLE AS c FROM labels)""",
        "chunk_documents": f"WITH {STUDIES}, {chunks('studies')} SELECT chunk_id, study_pmid, chunk_index, start_char, end_char, md5(text) AS text_md5 FROM chunk",
        "chunk_stats": rf"WITH {STUDIES}, {chunks('studies')} SELECT lang, count(*) AS n_chunks, count(DISTINCT study_pmid) AS n_studies, round(avg(len(list_filter(regexp_split_to_array(chunk.text, '\s+'), lambda w: w <> ''))), 6) AS avg_words FROM chunk JOIN documents ON pos = doc_id GROUP BY lang",
        "scope_features": f"WITH {STUDIES}, {scoped('studies')} SELECT pos, array_to_string(cl, ',') AS clusters, anchor_hits, negative_hits, positive_score, in_scope FROM scoped",
        "scope_report": f"WITH {STUDIES}, {scoped('studies')} SELECT count(*) AS input_studies, count(*) FILTER (in_scope) AS kept_studies, count(*) FILTER (NOT in_scope) AS dropped_studies FROM scoped",
        "label_match": f"WITH {STUDIES}, f AS (SELECT pos, {FULL} AS t FROM studies) SELECT pos, array_to_string({labels('t', H.DOMAINS)}, ',') AS domains, array_to_string({labels('t', H.FLUIDS)}, ',') AS fluids, CASE WHEN len({labels('t', H.PHASES)}) = 0 THEN 'unknown' ELSE array_to_string({labels('t', H.PHASES)}, ',') END AS phases, array_to_string({labels('t', H.TOPOLOGIES)}, ',') AS topologies FROM f",
        "keyword_topk": f"WITH {STUDIES}, kw0 AS (SELECT pos, raw_text AS raw FROM studies), {KEYWORDS_TOP} SELECT pos, coalesce(array_to_string(ks, ' '), '') AS keywords FROM studies LEFT JOIN kw USING (pos)",
        "numeric_ranges": f"WITH {STUDIES}, n AS (SELECT pos, list_concat({number(*H.NUMBERS[0])}, {number(*H.NUMBERS[1])}) AS v FROM studies) SELECT pos, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max, least(1.0::DOUBLE, len(v) / 5.0::DOUBLE) AS confidence FROM n",
        "corruption_tokens": f"WITH {STUDIES}, t AS (SELECT pos, {tokens} AS x FROM studies), u AS (SELECT pos, {distinct_in_order} AS x FROM t WHERE len(x) > 0) SELECT pos, array_to_string(x, ' ') AS tokens, CASE WHEN len(x) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM u",
        "sanitized_text": rf"WITH {STUDIES} SELECT pos, md5(replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '/C\d+', '', 'g'), '\bC(\d+)\s+C\b', '\1 C', 'g'), '\|\s*\|\s*\|', '|', 'g'), chr(65533), '')) AS table_md5 FROM studies",
        "claims_per_chunk": rf"""WITH {STUDIES}, {chunks('studies')}, s AS (SELECT chunk_id, unnest(ss) AS c, unnest(range(len(ss))) AS i FROM (SELECT chunk_id, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: {strip('z')}) AS ss FROM chunk)),
            k AS (SELECT chunk_id, c, i, {claim('c')} AS claim_type FROM s WHERE length(c) >= 30), f AS (SELECT * FROM k WHERE claim_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(c) ORDER BY i) = 1),
            g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY i) <= 2) SELECT claim_type, count(*) AS n, CAST(sum(length(substr(c, 1, 240))) AS BIGINT) AS chars FROM g GROUP BY claim_type""",
        "study_citations": f"""WITH {STUDIES} SELECT pos, CASE WHEN pos % 5 > 0 AND coalesce(authors, '') <> '' THEN '(' || authors || CASE WHEN pos % 3 = 0 THEN ', ' || (pos % 60 + 1960) ELSE '' END || ')' ELSE '(' || pmid || ')' END AS citation,
            CASE WHEN pos % 2 = 0 THEN pmid WHEN coalesce(authors, '') <> '' THEN authors ELSE 'unknown_paper' END AS paper_id FROM studies""",
        "cosine_pairs": f"WITH {pairs} SELECT a, b, round(similarity, 6) AS similarity FROM pair",
        "cosine_topk_sections": f"""WITH {unit_vec}, e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i),
            c0 AS (SELECT label, list(x ORDER BY i) AS v0 FROM m GROUP BY label), c AS (SELECT label AS p, {unit('v0')} AS v FROM c0),
            s AS (SELECT CAST(u.vec_id AS VARCHAR) AS chunk_id, p, floor(list_dot_product(u.v, c.v) * 1e9 + 0.5) / 1e9 AS s, (p % 4) / 20.0::DOUBLE AS ms FROM u, c),
            b AS (SELECT *, max((s < greatest(0.02, ms))::INT) OVER (PARTITION BY chunk_id ORDER BY s DESC, p DESC ROWS UNBOUNDED PRECEDING) AS blocked, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, p DESC) AS rn FROM s)
            SELECT chunk_id, CAST(p AS INTEGER) AS section_pos, round(s, 6) AS similarity FROM b WHERE blocked = 0 AND rn <= 3""",
        "greedy_vector_dedup": f"""WITH RECURSIVE {pairs}, edge AS (SELECT a, b FROM pair), ord AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
            adj AS (SELECT ord.rn, ord.vec_id, list(edge.b) FILTER (edge.b IS NOT NULL) AS bs FROM ord LEFT JOIN edge ON edge.a = ord.vec_id GROUP BY ord.rn, ord.vec_id),
            walk(rn, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT adj.rn, CASE WHEN list_contains(gone, adj.vec_id) OR adj.bs IS NULL THEN gone ELSE list_distinct(list_concat(gone, adj.bs)) END FROM walk JOIN adj ON adj.rn = walk.rn + 1),
            last AS (SELECT gone FROM walk ORDER BY rn DESC LIMIT 1)
            SELECT min(a) AS kept, b AS removed, round(arg_min(similarity, a), 6) AS similarity FROM pair, last WHERE NOT list_contains(gone, a) GROUP BY b""",
        "routed_tags": f"{routed()} SELECT chunk_id, section_pos, CAST(floor(fs * 1e6 + 0.5) AS BIGINT) AS similarity, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS eligibility_score, array_to_string(notes, ';') AS notes FROM tag",
        "validation_report": f"""{routed()}, tr AS (SELECT {n_traces('ft')} AS k FROM full1 UNION ALL SELECT {n_traces('text')} FROM chunk),
            fl AS (SELECT f.s AS s, f.t AS t FROM (SELECT unnest(flags) AS f FROM scan) UNION ALL SELECT CASE WHEN k >= 3 THEN 'high' ELSE 'medium' END, 'text_corruption' FROM tr WHERE k > 0)
            SELECT s AS severity, t AS flag_type, count(*) AS n FROM fl GROUP BY GROUPING SETS ((), (s), (t))""",
        "evidence_gate_stats": f"""{gated()},
            cnt AS (SELECT parent, folder, count(*) AS after_section_filter, {", ".join(f"count(*) FILTER (reason = '{r}') AS rejected_{r}" for r in REASONS)},
              avg(CASE WHEN len(ad) > 0 AND score >= 0.2 THEN (len(list_intersect(domains, ad)) > 0)::INT END) AS purity, avg(CASE WHEN reason IS NULL AND len(ad) > 0 AND len(domains) > 0 THEN fr END) AS ratio FROM judged GROUP BY parent, folder)
            SELECT o.parent, o.folder, coalesce(after_section_filter, 0) AS after_section_filter, {", ".join(f"coalesce(rejected_{r}, 0) AS rejected_{r}" for r in REASONS)},
              CASE WHEN closed THEN n ELSE 0 END AS rejected_section_foreign_evidence_share, CASE WHEN closed THEN 0 ELSE coalesce(n, 0) END AS accepted, CASE WHEN closed THEN 0.0 ELSE round(coalesce(sim, 0.0), 3) END AS avg_similarity,
              CASE WHEN len(o.ad) = 0 THEN 1.0 ELSE round(coalesce(purity, 0.0), 3) END AS domain_purity, CASE WHEN closed THEN 0.0 ELSE round(coalesce(ratio, 0.0), 3) END AS avg_foreign_domain_ratio,
              CASE WHEN len(o.ad) > 0 THEN round(coalesce(share, 0.0), 3) ELSE 0.0 END AS foreign_evidence_share FROM outline o LEFT JOIN cnt USING (parent, folder) LEFT JOIN shares USING (parent, folder)""",
        "evidence_ranked": f"{gated()} SELECT parent, folder, CAST(rank AS INTEGER) AS rank, chunk_id, CAST(floor(fs * 1e6 + 0.5) AS BIGINT) AS similarity FROM top JOIN shares USING (parent, folder) WHERE NOT closed",
        "flagship_coverage": f"""{routed()}, c AS (SELECT parent, folder, count(*) AS n, avg(fs) AS s, avg(score) AS e FROM tag GROUP BY parent, folder)
            SELECT section_pos, parent, folder, coalesce(n, 0) AS n_chunks, round(coalesce(s, 0.0), 4) AS avg_similarity, round(coalesce(e, 0.0), 4) AS avg_eligibility, CASE WHEN n > 0 THEN 'has evidence' ELSE 'no evidence' END AS status FROM outline LEFT JOIN c USING (parent, folder)""",
        "coverage_totals": f"""{routed()}, c AS (SELECT parent, folder, count(*) AS n FROM tag GROUP BY parent, folder), o AS (SELECT coalesce(n, 0) AS n FROM outline LEFT JOIN c USING (parent, folder))
            SELECT count(*) AS total_sections, count(*) FILTER (n > 0) AS sections_with_evidence, count(*) FILTER (n = 0) AS sections_without_evidence, CAST(sum(n) AS BIGINT) AS total_tags, (SELECT count(*) FROM chunk) AS total_chunks FROM o""",
        "organizer_rollup": f"""{routed()}, b AS (SELECT parent, folder, study_pmid AS pmid, count(*) AS n_chunks, max(fs) AS m, arg_max(text, (fs, -1)) AS x FROM tag WHERE score >= 0.2 GROUP BY parent, folder, study_pmid),
            e AS (SELECT parent, folder, study_pmid AS pmid, text FROM tag WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY parent, folder, study_pmid ORDER BY fs DESC, chunk_id) = 1)
            SELECT parent, folder, pmid, '(' || pmid || ')' AS citation, round(m, 4) AS similarity, n_chunks, CAST(row_number() OVER (PARTITION BY parent, folder ORDER BY round(m, 4) DESC, pmid) AS INTEGER) AS rank, md5(substr(e.text, 1, 300)) AS excerpt_md5 FROM b JOIN e USING (parent, folder, pmid)""",
        "theme_evidence": f"{routed()}, t AS (SELECT * FROM tag QUALIFY row_number() OVER (PARTITION BY parent, folder ORDER BY fs DESC, chunk_id) <= 15) SELECT parent, folder, count(*) AS n_tags, count(DISTINCT study_pmid) AS n_studies, round(avg(fs), 3) AS avg_similarity, round(avg(score), 3) AS avg_eligibility FROM t GROUP BY parent, folder",
        "candidate_pairs": f"""{routed()}, t AS (SELECT parent, folder, chunk_id, study_pmid, row_number() OVER (PARTITION BY parent, folder ORDER BY fs DESC, chunk_id) AS r FROM tag QUALIFY r <= 4),
            p AS (SELECT x.parent, x.folder, x.chunk_id AS a, y.chunk_id AS b, CAST(row_number() OVER (PARTITION BY x.parent, x.folder ORDER BY x.r, y.r) AS INTEGER) AS pair FROM t x JOIN t y ON x.parent = y.parent AND x.folder = y.folder AND x.r < y.r AND x.study_pmid <> y.study_pmid)
            SELECT * FROM p WHERE pair <= 3""",
        "meta_fixed_effect": f"""WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 10000 AS es, l_extendedprice / 10000 - l_discount AS ci_lower, l_extendedprice / 10000 + l_discount + l_tax AS ci_upper FROM lineitem WHERE l_quantity > 3),
            w AS (SELECT *, {meta_w} AS w FROM r), m AS (SELECT *, sum(w * es) OVER g / sum(w) OVER g AS mu FROM w WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)),
            a AS (SELECT l_returnflag, l_linestatus, any_value(mu) AS mu, sum(w) AS sw, sum(w * w) AS sww, sum(w * (es - mu) * (es - mu)) AS q, count(*) AS k FROM m GROUP BY l_returnflag, l_linestatus)
            SELECT l_returnflag, l_linestatus, {sig('mu')} AS pooled_effect, {sig('1 / sqrt(sw)')} AS pooled_se, {sig(f'mu - {H.Z95} / sqrt(sw)')} AS ci_lower, {sig(f'mu + {H.Z95} / sqrt(sw)')} AS ci_upper, {sig('q')} AS q,
              {sig('CASE WHEN q > 0 THEN greatest(0, (q - greatest(k - 1, 1)) / q * 100) ELSE 0 END')} AS i_squared, {sig('CASE WHEN q > greatest(k - 1, 1) THEN greatest(0, (q - greatest(k - 1, 1)) / (sw - sww / sw)) ELSE 0 END')} AS tau_squared, k FROM a""",
        "rob_overall": f"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, {rating_list} AS x FROM labels), o AS (SELECT pmid, CASE WHEN list_contains(x, 'high') THEN 'high' WHEN len(list_filter(x, lambda z: z = 'unclear')) >= 2 THEN 'moderate' ELSE 'low' END AS overall_rating FROM r)
            SELECT pmid, overall_rating, CASE overall_rating WHEN 'low' THEN 'high' WHEN 'high' THEN 'low' ELSE 'medium' END AS methodology FROM o""",
        "extraction_join": f"WITH {STUDIES} SELECT pos, pmid, CASE WHEN l.doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM studies LEFT JOIN labels l ON l.doc_id = pos",
        "section_quality": f"{quality()} SELECT * FROM sq",
        "quality_report": f"""{quality()} SELECT count(*) AS sections, round(avg(cross_topic_contamination_score), 3) AS avg_cross_topic_contamination_score, round(avg(physics_consistency_score), 3) AS avg_physics_consistency_score,
            round(avg(grounding_score), 3) AS avg_grounding_score, round(avg(CAST(section_id AS INTEGER) % 5 / 4), 3) AS avg_domain_purity, round(avg(CAST(section_id AS INTEGER) % 9 / 8), 3) AS avg_similarity, round(avg(CAST(section_id AS INTEGER) % 3 / 2), 3) AS avg_foreign_evidence_share, count(*) FILTER (table_integrity_score < 1) AS sections_with_corruption FROM sq""",
        "review_blend": f"""{quality()}, g AS (SELECT section_id, CAST(section_id AS INTEGER) % 11 AS m, 10 * (cross_topic_contamination_score + physics_consistency_score + grounding_score) / 3 AS gate, physics_hits FROM sq)
            SELECT section_id, round(round(0.7::DOUBLE * m + 0.3::DOUBLE * CASE WHEN physics_hits > 0 THEN least(gate, 5.0::DOUBLE) ELSE gate END, 2), 1) AS score FROM g""",
        "citation_dedup": "SELECT doc_id, 'See (' || source || ', 2023; ' || lang || ', 2024) and (no year; twice) (x).' AS text FROM documents",
        "markdown_sections": rf"""WITH p AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '## ' ELSE '### ' END || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) ORDER BY turn, CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '## ' ELSE '### ' END || role || ' ' || turn || chr(10) || chr(10) || text) AS t FROM conversations GROUP BY conv_id),
            l AS (SELECT conv_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT conv_id, string_split(t, chr(10)) AS ls FROM p)),
            h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{2,3}}\s+.+$') THEN length(regexp_extract(line, '^(#{{2,3}})\s', 1)) END AS lvl, {strip("regexp_extract(line, '^#{2,3}\\s+(.+)$', 1)")} AS head FROM l),
            s AS (SELECT *, count(lvl) OVER w AS section_no, coalesce(last_value(CASE WHEN lvl = 2 THEN head END IGNORE NULLS) OVER w, '') AS parent FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING))
            SELECT conv_id, section_no, CAST(coalesce(max(lvl), 0) AS INTEGER) AS level, coalesce(max(CASE WHEN lvl IS NOT NULL THEN head END), '') AS heading, arg_max(parent, i) AS parent, md5({strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lvl IS NULL), '')")}) AS body_md5 FROM s GROUP BY conv_id, section_no""",
        "latex_escape": f"SELECT doc_id, md5({latex}) AS latex_md5 FROM documents",
        "concept_registry": rf"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS c, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda z: z <> '') AS ws FROM conversations)),
            k AS (SELECT translate(lower(c), '{author}', '{plain}') AS concept_key, conv_id * 1000000000 + turn * 1000000 + i AS pos, c, CAST(conv_id AS VARCHAR) AS section FROM w)
            SELECT concept_key, section, pos FROM k WHERE concept_key <> '' QUALIFY row_number() OVER (PARTITION BY concept_key ORDER BY pos, c) = 1""",
        "research_agenda": f"""WITH g AS (SELECT doc_id AS pos, string_split(text, '.')[1] AS description, (['low', 'High', 'medium', 'later'])[(doc_id % 4 + 1)::INT] AS priority FROM documents),
            f AS (SELECT * FROM g WHERE trim(description) <> '' QUALIFY row_number() OVER (PARTITION BY lower({strip('description')}) ORDER BY pos) = 1),
            r AS (SELECT *, row_number() OVER (ORDER BY CASE lower(priority) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, pos) AS rank FROM f) SELECT pos, description, priority, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""",
        "screening_replies": f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR quality <> 1 THEN 'exclude' ELSE 'include' END AS decision, CASE WHEN doc_id % 4 = 3 THEN 0.5 ELSE {conf} END AS confidence, CASE WHEN doc_id % 4 = 3 THEN 'I cannot say' ELSE 'because' END AS justification FROM labels""",
        "rob_replies": "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 2 THEN 5 ELSE 1 END AS INTEGER) AS n_domains, CASE WHEN doc_id % 3 = 2 THEN 'moderate' WHEN quality = 1 THEN 'low' ELSE 'high' END AS overall_rating FROM labels",
        "rewrites_by_position": r"""WITH o AS (SELECT conv_id AS chapter, turn AS place, min(text) AS body FROM conversations GROUP BY ALL), b AS (SELECT * FROM o WHERE chapter % 2 = 0 AND NOT (chapter % 3 = 0 AND place = 0)),
            r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY place) AS r, count(*) OVER (PARTITION BY chapter) AS n FROM o), s AS (SELECT chapter, body AS back, row_number() OVER (PARTITION BY chapter ORDER BY place) AS r, count(*) OVER (PARTITION BY chapter) AS m FROM b)
            SELECT chapter, place, md5(CASE WHEN n = m AND n >= 2 AND len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) >= 20 THEN 'new ' || back ELSE body END) AS body_md5 FROM r LEFT JOIN s USING (chapter, r)""",
        "chapter_questions": r"""WITH x AS (SELECT conv_id, turn AS p, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:2] AS q FROM conversations)
            SELECT CAST(conv_id AS VARCHAR) AS parent, md5(array_to_string(flatten(list(q ORDER BY p, q)), ' ')) AS questions_md5 FROM x GROUP BY conv_id""",
        "theme_replies": f"""{maps} SELECT theme, c AS n_consensus, a AS n_contradictions, first_priority, g AS grounded FROM maps""",
        "theme_totals": f"""{maps} SELECT count(*) AS themes, CAST(sum(c) AS BIGINT) AS total_consensus, CAST(sum(a) AS BIGINT) AS total_contradictions, count(*) AS total_gaps FROM maps""",
        "relevance_replies": "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'unreadable' WHEN quality <> 1 THEN 'irrelevant' WHEN doc_id % 10 < 6 THEN 'low_confidence' ELSE 'kept' END AS verdict FROM labels",
        "page_titles": r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS n_paragraphs, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS n_links FROM pages""",
        "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    }
    del clean
    return out
