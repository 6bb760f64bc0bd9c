"""Calls to a language model as a column function, and parsers for its replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import lexicon
from scholium.functions import text as T


def ask(rows: DataFrame, prompt: Column, client: Callable[[str, dict], str], options: dict | None = None, cache: DataFrame | None = None, retries: int = 1, model: Column | None = None, parallel: int = 1) -> DataFrame:
    """rows with prompt_hash, reply and error: client(prompt, options) for each unlike prompt.

    model names a row's own model, which goes to the client as an option. Equal prompts are asked once, and those in cache(prompt_hash, reply) not at all; a call that raises is tried again
    `retries` times and then leaves its message in `error`. The hash covers prompt, options and model. A task makes `parallel` calls at once
    at most, so all make that many times the session's cores; the next rows are taken when a batch's calls have ended. client is
    then called by several threads.
    """
    options = options or {}
    named = F.lit(None).cast("string") if model is None else model
    keyed = rows.withColumn("prompt", prompt).withColumn("prompt_model", named).withColumn("prompt_hash", F.sha2(F.concat(F.col("prompt"), F.lit(repr(sorted(options.items()))), F.coalesce("prompt_model", F.lit(""))), 256))
    asked = keyed.select("prompt_hash", "prompt", "prompt_model").dropDuplicates(["prompt_hash"])
    if cache is not None:
        asked = asked.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")

    def one(key: str, text: str, own: str | None) -> tuple:
        reply, error = None, None
        chosen = {**options, "model": own} if own else options
        for _ in range(retries + 1):
            try:
                reply, error = client(text, chosen), None
                break
            except Exception as e:  # whatever the transport raises becomes a row's error
                error = str(e)
        return key, reply, error

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for frame in frames:
                rows = frame["prompt_hash"], frame["prompt"], frame["prompt_model"]
                out = list(pool.map(one, *rows) if parallel > 1 else map(one, *rows))
                yield pd.DataFrame(out, columns=["prompt_hash", "reply", "error"])

    replies = asked.mapInPandas(call, "prompt_hash string, reply string, error string")
    if cache is not None:
        replies = replies.unionByName(cache.select("prompt_hash", "reply", F.lit(None).cast("string").alias("error")))
    return keyed.join(replies, "prompt_hash", "left").drop("prompt", "prompt_model")


def offline(prompt: str, options: dict) -> str:
    """A client without a network: a short deterministic echo."""
    return " ".join(prompt.split()[:30])


def streaming_client(url: str, model: str, temperature: float = 0.2, seed: int = 42, timeout: float = 120.0, **knobs) -> Callable[[str, dict], str]:
    """A client of a local model server that streams its reply as JSON lines with `response` and `done`.

    options may name another model, temperature or seed for one call; num_ctx, top_p and repeat_penalty go along if given. The timeout
    holds for the silence between two lines. Lines that are no JSON are passed over.
    """
    import json
    import urllib.request

    def call(prompt: str, options: dict) -> str:
        chosen = {"temperature": temperature, "seed": seed, **{k: v for k, v in {**knobs, **options}.items() if k in ("temperature", "seed", "num_ctx", "top_p", "repeat_penalty")}}
        body = json.dumps({"model": options.get("model", model), "prompt": prompt, "stream": True, "options": chosen}).encode()
        request = urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        said = []
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            for line in reply:
                try:
                    data = json.loads(line)
                except ValueError:
                    continue
                said.append(data.get("response") or "")
                if data.get("done"):
                    break
        return "".join(said)

    return call


def unfenced(raw: Column) -> Column:
    return T.strip(F.regexp_replace(T.text_or_empty(raw), r"```(?:json)?", ""))


def _json(raw: Column) -> Column:
    return F.try_parse_json(raw)


def _first_object(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def _mended(raw: Column) -> Column:
    r"""A stray backslash doubled, so that \p and the like do not spoil the reply."""
    # Fixed value: the signs that JSON lets follow a backslash.
    return F.regexp_replace(raw, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")


def lenient_object(raw: Column) -> Column:
    """The reply as a variant: as it stands, mended, or its outermost braces; null if none of them is an object."""
    whole = unfenced(raw)
    tries = (whole, _mended(whole), _first_object(whole), _mended(_first_object(whole)))
    return F.coalesce(*(F.when(F.ltrim(t).startswith("{"), _json(t)) for t in tries))


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def screening_reply(raw: Column) -> Column:
    """struct(decision, confidence, justification): JSON, else what patterns find, else exclude / 0.5 / the first 200 characters."""
    clean = unfenced(raw)
    v = _json(clean)
    found = F.regexp_extract(clean, r'"confidence"\s*:\s*([\d.]+)', 1)
    conf = F.coalesce(found.try_cast("double"), F.lit(0.5))
    why = F.regexp_extract(clean, r'"justification"\s*:\s*"([^"]*)"', 1)
    has_why = clean.rlike(r'"justification"\s*:\s*"[^"]*"')
    loose = F.struct(
        F.when(clean.rlike(r'(?i)"decision"\s*:\s*"include"'), "include").otherwise("exclude").alias("decision"),
        conf.alias("confidence"),
        F.when(has_why, why).otherwise(F.substring(clean, 1, 200)).alias("justification"),
    )
    strict = F.struct(
        F.coalesce(F.lower(_field(v, "$.decision")), F.lit("exclude")).alias("decision"),
        F.coalesce(_field(v, "$.confidence", "double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(_field(v, "$.justification"), F.lit("")).alias("justification"),
    )
    return F.when(v.isNotNull() & clean.startswith("{"), strict).otherwise(loose)


def rob_reply(raw: Column) -> Column:
    """array<struct(domain, rating, justification)>: a JSON array of objects with a domain, else five unclear ones."""
    clean = unfenced(raw)
    items = F.from_json(clean, "array<struct<domain:string,rating:string,justification:string>>")
    items = F.transform(items, lambda x: F.struct(x["domain"].alias("domain"), F.coalesce(x["rating"], F.lit("unclear")).alias("rating"), F.coalesce(x["justification"], F.lit("")).alias("justification")))
    good = clean.startswith("[") & items.isNotNull() & F.forall(items, lambda x: x["domain"].isNotNull())
    fallback = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit("unclear").alias("rating"), F.lit("Could not parse LLM output").alias("justification")) for d in lexicon.ROB_DOMAINS))
    return F.when(good, items).otherwise(fallback)


EXTRACTION_TEXT = ("study_design", "population", "intervention", "comparison", "outcome", "notes", "study_scale", "geographic_scope", "funding_source", "conflict_of_interest", "limitations")
EXTRACTION_NUMBERS = {"sample_size": "int", "effect_size": "double", "ci_lower": "double", "ci_upper": "double", "p_value": "double"}


def extraction_reply(rows: DataFrame, raw: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(extractions, errors): replies that are JSON objects as columns, null texts as empty; the others with their first 500 characters."""
    parsed = rows.withColumn("_v", _json(unfenced(F.col(raw)))).withColumn("_ok", F.col("_v").isNotNull() & unfenced(F.col(raw)).startswith("{"))
    fields = [F.coalesce(_field(F.col("_v"), f"$.{c}"), F.lit("")).alias(c) for c in EXTRACTION_TEXT]
    fields += [_field(F.col("_v"), f"$.{c}", k).alias(c) for c, k in EXTRACTION_NUMBERS.items()]
    return parsed.where("_ok").select("pmid", *fields), parsed.where("not _ok").select("pmid", F.lit("not a JSON object").alias("error"), F.substring(raw, 1, 500).alias("raw"))


def query_reply(raw: Column) -> Column:
    """struct(population, intervention, comparison, outcome, query): JSON, else each key by pattern; query falls back to the first 500 characters."""
    clean = unfenced(raw)
    v = _json(clean)

    def part(key: str) -> Column:
        loose = F.nullif(F.regexp_extract(clean, rf'(?i)"{key}"\s*:\s*"([^"]*)"', 1), F.lit(""))
        value = F.coalesce(_field(v, f"$.{key}"), loose)
        return F.coalesce(value, F.substring(clean, 1, 500) if key == "query" else F.lit("")).alias(key)

    return F.struct(*(part(k) for k in ("population", "intervention", "comparison", "outcome", "query")))


def concept_list(raw: Column, limit: int = 20) -> Column:
    """Up to `limit` unlike concepts: a JSON array (alone or within chatter), else quoted strings, else bullets, else a comma list."""
    clean = unfenced(raw)
    kind = "array<string>"
    array = F.regexp_extract(clean, r"(?s)\[.*\]", 0)
    single = F.regexp_replace(array, "'", '"')
    tries = [F.when(F.ltrim(t).startswith("["), F.from_json(t, kind)) for t in (clean, array, _mended(array), single)]
    tries.append(F.regexp_extract_all(T.text_or_empty(raw), F.lit(r'"([^"\n]{2,120})"'), F.lit(1)))
    tries.append(F.regexp_extract_all(T.text_or_empty(raw), F.lit(r"(?:^|\n)\s*(?:[-*•]|\d+\.)\s+([^\n]{2,120})"), F.lit(1)))
    commas = F.filter(F.transform(F.split(T.text_or_empty(raw), ","), lambda p: F.regexp_replace(p, r"^[ \-\t\r\n]+|[ \-\t\r\n]+$", "")), lambda p: F.length(p).between(2, 120))
    tries.append(F.when(F.contains(T.text_or_empty(raw), F.lit(",")), commas))
    filled = [F.when(F.size(F.filter(t, lambda x: T.strip(T.text_or_empty(x)) != "")) > 0, t) for t in tries]
    found = F.filter(F.transform(F.coalesce(*filled, F.array().cast(kind)), lambda x: T.strip(T.text_or_empty(x))), lambda x: x != "")
    low = F.transform(found, lambda x: F.lower(x))
    return F.slice(T.let(low, lambda ls: F.filter(found, lambda x, i: F.array_position(ls, F.lower(x)) == i + 1)), 1, limit)


POINT = "array<struct<statement:string,strength:string,ids:array<string>>>"
GAP = "array<struct<description:string,priority:string,suggested_approach:string>>"


def theme_reply(raw: Column, known_ids: Column, evidence: Column) -> Column:
    """struct(consensus, contradictions, gaps) with ids kept that the evidence has. Without evidence one gap of high
    priority, without a JSON object one of low priority."""
    clean = unfenced(raw)
    kind = "consensus_points array<struct<statement:string,strength:string,evidence_chunk_ids:array<string>>>, contradictions array<struct<point:string,study_a:string,study_b:string,evidence_chunk_ids:array<string>>>, knowledge_gaps " + GAP
    parsed = F.from_json(F.when(clean.startswith("{"), F.when(_json(clean).isNotNull(), clean)), kind)
    keep = lambda ids: F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.array_contains(known_ids, i))
    consensus = F.transform(F.coalesce(parsed["consensus_points"], F.array().cast("array<struct<statement:string,strength:string,evidence_chunk_ids:array<string>>>")), lambda c: F.struct(c["statement"].alias("statement"), c["strength"].alias("strength"), keep(c["evidence_chunk_ids"]).alias("ids")))
    against = F.transform(F.coalesce(parsed["contradictions"], F.array().cast("array<struct<point:string,study_a:string,study_b:string,evidence_chunk_ids:array<string>>>")), lambda c: F.struct(c["point"].alias("point"), c["study_a"].alias("study_a"), c["study_b"].alias("study_b"), keep(c["evidence_chunk_ids"]).alias("ids")))
    gap = lambda text, priority: F.array(F.struct(F.lit(text).alias("description"), F.lit(priority).alias("priority"), F.lit("").alias("suggested_approach")))
    gaps = F.when(evidence == 0, gap("No evidence for this theme.", "high")).when(parsed.isNull(), gap("The synthesis could not be read.", "low")).otherwise(F.coalesce(parsed["knowledge_gaps"], F.array().cast(GAP)))
    empty = lambda xs: F.when((evidence == 0) | parsed.isNull(), F.slice(xs, 1, 0)).otherwise(xs)
    return F.struct(empty(consensus).alias("consensus"), empty(against).alias("contradictions"), gaps.alias("gaps"))


CRITERIA = ("thesis_clarity", "redundancy", "citation_usage", "hedging", "critical_depth")


def review_report(raw: Column, empty_text: Column) -> Column:
    """struct(score, overall_feedback, and score and comment of each of CRITERIA) of a review reply: a JSON object, else 7.0
    and the reply's first 500 characters. An empty draft has 10.0 whatever the reply says."""
    clean = unfenced(raw)
    v = _json(clean)
    ok = v.isNotNull() & clean.startswith("{")
    score = F.when(empty_text, 10.0).when(ok, F.coalesce(_field(v, "$.overall_score", "double"), F.lit(0.0))).otherwise(7.0)
    feedback = F.when(empty_text, "").when(ok, F.coalesce(_field(v, "$.overall_feedback"), F.lit(""))).otherwise(F.substring(T.text_or_empty(raw), 1, 500))
    marks = (F.struct(F.when(ok & ~empty_text, F.coalesce(_field(v, f"$.{c}.score", "double"), F.lit(0.0))).otherwise(0.0).alias("score"), F.when(ok & ~empty_text, F.coalesce(_field(v, f"$.{c}.comment"), F.lit(""))).otherwise("").alias("comment")).alias(c) for c in CRITERIA)
    return F.struct(score.alias("score"), feedback.alias("overall_feedback"), *marks)


def review_reply(raw: Column, empty_text: Column) -> Column:
    """The score of a review reply alone, of any of its shapes: overall_score, score, or the mean of a list of criteria."""
    v = lenient_object(raw)
    scores = F.from_json(F.to_json(_field(v, "$.criteria", "variant")), "array<struct<score:double>>")
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0))) / F.size(scores)
    return F.when(empty_text, 10.0).otherwise(F.coalesce(_field(v, "$.overall_score", "double"), _field(v, "$.score", "double"), F.when(F.size(scores) > 0, mean), F.lit(7.0)))


def thesis_reply(raw: Column) -> Column:
    """struct(thesis, research_priorities, grouped_gaps) of a strict JSON object; all empty for anything else."""
    clean = unfenced(raw)
    kind = "thesis string, research_priorities array<string>, grouped_gaps array<struct<group:string,gaps:array<struct<description:string,priority:string,justification:string>>>>"
    v = F.from_json(F.when(clean.startswith("{") & _json(clean).isNotNull(), clean), kind)
    return F.struct(F.coalesce(v["thesis"], F.lit("")).alias("thesis"), F.coalesce(v["research_priorities"], F.array().cast("array<string>")).alias("research_priorities"), F.coalesce(v["grouped_gaps"], F.array().cast("array<struct<group:string,gaps:array<struct<description:string,priority:string,justification:string>>>>")).alias("grouped_gaps"))


def contradiction_reply(raw: Column) -> Column:
    """struct(point, possible_cause) of a strict JSON object that says `contradiction`, else null."""
    clean = unfenced(raw)
    v = _json(clean)
    says = clean.startswith("{") & F.coalesce(_field(v, "$.contradiction", "boolean"), F.lit(False))
    return F.when(says, F.struct(F.coalesce(_field(v, "$.point"), F.lit("")).alias("point"), F.coalesce(_field(v, "$.possible_cause"), F.lit("")).alias("possible_cause")))


def critical_reply(raw: Column) -> Column:
    """struct(summary, robustness): JSON, else the first 500 characters and a middling rating."""
    v = _json(unfenced(raw))
    ok = v.isNotNull() & unfenced(raw).startswith("{")
    return F.struct(F.when(ok, T.text_or_empty(_field(v, "$.summary"))).otherwise(F.substring(T.text_or_empty(raw), 1, 500)).alias("summary"), F.when(ok, F.coalesce(_field(v, "$.robustness"), F.lit("média"))).otherwise("média").alias("robustness"))


def table_reply(raw: Column) -> Column:
    """struct(caption, columns, rows) of a lenient JSON object with columns and rows, else null; cells are texts, lists
    and objects in them as JSON."""
    v = lenient_object(raw)
    spec = F.from_json(F.to_json(v), "caption string, columns array<string>, rows array<map<string,string>>")
    return F.when((F.size(spec["columns"]) > 0) & (F.size(spec["rows"]) > 0), spec)


def table_proposal(raw: Column) -> Column:
    """struct(caption, columns, rows, source_studies) of a lenient JSON object that says `should_create_table`, else null."""
    spec = F.from_json(F.to_json(lenient_object(raw)), "should_create_table boolean, caption string, columns array<string>, rows array<map<string,string>>, source_studies array<string>")
    strings = lambda c: F.coalesce(spec[c], F.array().cast("array<string>")).alias(c)
    rows = F.coalesce(spec["rows"], F.array().cast("array<map<string,string>>")).alias("rows")
    return F.when(F.coalesce(spec["should_create_table"], F.lit(False)), F.struct(F.coalesce(spec["caption"], F.lit("")).alias("caption"), strings("columns"), rows, strings("source_studies")))


def relevance_reply(raw: Column, least: float = 0.6) -> Column:
    """struct(verdict, confidence, brief) of a relevance judge's reply: verdict is kept, irrelevant, low_confidence or
    unreadable; brief lists claim, method, findings and reason."""
    v = lenient_object(raw)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_field(v, "$.confidence", "double"), F.lit(1.0))))
    part = lambda k, other: F.coalesce(F.nullif(T.strip(T.text_or_empty(_field(v, f"$.{k}"))), F.lit("")), F.lit(other))
    brief = F.concat(
        F.lit("- Claim: "), part("claim", "Not specified"), F.lit("\n- Method: "), part("method", "Not specified"), F.lit("\n- Findings: "), part("findings", "Not specified"),
        F.lit("\n- Relevance: "), part("why", "Relevant to section scope"), F.lit("\n- Judge confidence: "), F.format_string("%.2f", conf),
    )
    relevant = F.coalesce(_field(v, "$.is_relevant", "boolean"), F.lit(False))
    verdict = F.when(v.isNull(), "unreadable").when(~relevant, "irrelevant").when(conf < least, "low_confidence").otherwise("kept")
    return F.struct(verdict.alias("verdict"), conf.alias("confidence"), brief.alias("brief"))
