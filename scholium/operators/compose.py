"""What a model writes of analysed evidence: theses, drafts and their polish, summaries, chapters that are revised,
contradictions, tables, and the sections of a manuscript. Every call is a row; a call that fails leaves things as they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import markdown, meta, reduction, replies, synthesis
from scholium.operators.dedup import checkpointed

Client = Callable[[str, dict], str]
# Fixed value: what stands for a thesis where there is none.
NO_THESIS = "(no specific thesis — write based on evidence)"
#: Characters of a section that a summary is written from, sections of it, and characters of a chunk in a comparison.
PREVIEW, LEADING, EXCERPT = 300, 8, 500


def prompt_of(task: str, *parts: Column) -> Column:
    """The task, then each part on lines of its own; null parts are left out."""
    return F.concat_ws("\n", F.lit(task), *parts)


def answered(rows: DataFrame, prompt: Column, client: Client) -> DataFrame:
    """rows with `reply`, null where the call failed. Replies are checkpointed: a lost executor asks no model again."""
    return checkpointed(replies.ask(rows, prompt, client).drop("prompt_hash", "error"))


def chapter_theses(chapters: DataFrame, client: Client) -> DataFrame:
    """(parent, thesis) of chapters(parent, questions); without questions or a reply the thesis is NO_THESIS, without a call."""
    asked = answered(chapters.where(F.size("questions") > 0), prompt_of("Formulate a debatable thesis of one or two sentences for this chapter.", F.concat(F.lit("Chapter: "), "parent"), F.array_join(F.transform("questions", lambda q: F.concat(F.lit("- "), q)), "\n")), client)
    return chapters.select("parent").join(asked.select("parent", "reply"), "parent", "left").select("parent", F.coalesce(T.strip(F.col("reply")), F.lit(NO_THESIS)).alias("thesis"))


def anchors(maps: DataFrame, most: int = 6) -> DataFrame:
    """(theme, anchors): the first points of consensus that name chunks, as lines to ground a draft in."""
    named = F.filter(F.slice("consensus", 1, most), lambda c: F.size(c["ids"]) > 0)
    lines = F.transform(named, lambda c: F.concat(F.lit("- "), c["statement"], F.lit(" [chunks:"), F.array_join(c["ids"], ", "), F.lit("]")))
    return maps.select("theme", F.when(F.size(lines) > 0, F.concat(F.lit("### Anchored synthesis hints (must remain grounded)\n"), F.array_join(lines, "\n"))).alias("anchors"))


def write_entries(entries: DataFrame, client: Client, polish: bool = True) -> DataFrame:
    """entries(section_pos, parent, folder, prompt, evidence[, thesis, anchors, covered, feedback]) with `content`.

    An entry with evidence is drafted from it and polished; one without gets a short text that says so, which is not
    polished. A failed polish keeps the draft, a failed draft is empty. Texts pass the physics and text clean-ups.
    """
    for name in ("thesis", "anchors", "covered", "feedback"):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast("string"))
    bare = T.strip(T.text_or_empty(F.col("evidence"))) == ""
    where = F.concat(F.lit("Section: "), T.theme_key(F.col("parent"), F.col("folder")))
    told = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(F.col(c), F.lit("")))
    full = prompt_of("Write this section from its evidence and cite every chunk.", where, told("Guidance", "prompt"), told("Thesis", "thesis"), told("Covered before", "covered"), told("Feedback", "feedback"), F.col("anchors"), F.col("evidence"))
    short = prompt_of("Write a short section that says that no direct evidence was found.", where, told("Guidance", "prompt"))
    drafts = answered(entries.withColumn("bare", bare), F.when(bare, short).otherwise(full), client).withColumn("draft", T.text_or_empty(F.col("reply"))).drop("reply")
    if polish:
        better = answered(drafts.where(~F.col("bare") & (F.col("draft") != "")).select("section_pos", "draft"), prompt_of("Polish this draft. Keep every citation.", F.col("draft")), client).select("section_pos", "reply")
        drafts = drafts.join(better, "section_pos", "left").withColumn("draft", F.coalesce("reply", "draft"))
    return drafts.select("section_pos", "parent", "folder", T.textual_cleanup(T.thermo_fixes(F.col("draft"))["text"]).alias("content"))


def executive_summary(sections: DataFrame, topic: str, client: Client) -> DataFrame:
    """One row (summary) of sections(section_pos, parent, folder, content): written from the beginnings of the first
    LEADING ones; empty if the call fails."""
    first = sections.orderBy("section_pos").limit(LEADING)
    block = F.concat(F.lit("## "), "parent", F.lit("\n### "), "folder", F.lit("\n"), F.substring(T.text_or_empty(F.col("content")), 1, PREVIEW), F.lit("..."))
    preview = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", block.alias("b")))), lambda x: x["b"]), "\n").alias("preview"))
    return answered(preview, prompt_of("Write an executive summary of this review.", F.lit(f"Title: {topic}"), F.col("preview")), client).select(T.strip(T.text_or_empty(F.col("reply"))).alias("summary"))


def refine(parts: DataFrame, key: str, client: Client, least_words: int = 20) -> DataFrame:
    """parts of markdown.split_sections() with the bodies of `###` sections of least_words or more revised one by one."""
    chosen = (F.col("level") == 3) & (F.size(T.words(F.col("body"))) >= least_words)
    back = answered(parts.where(chosen).select(key, "section_no", "body"), prompt_of("Refine this section by theme. Keep every citation.", F.col("body")), client).select(key, "section_no", "reply")
    return parts.join(back, [key, "section_no"], "left").withColumn("body", F.coalesce("reply", "body")).drop("reply")


def revise_chapters(parts: DataFrame, key: str, client: Client, task: str, theses: DataFrame | None = None, least_sections: int = 2) -> DataFrame:
    """parts with each chapter's `###` sections revised together. A reply counts only if it has as many of them; its
    bodies go to their places, headings stay. theses(parent, thesis): only chapters with one are asked about.

    A chapter is one document's sections under one heading, so its text is as bounded as a document's.
    """
    body = T.strip(F.col("body")) != "" if theses is None else F.lit(True)
    own = parts.where((F.col("level") == 3) & body).select(F.struct(key, "parent").alias("chapter"), F.col("section_no").alias("place"), "heading", "body")
    block = F.concat(F.lit("### "), "heading", F.lit("\n\n"), "body")
    texts = own.groupBy("chapter").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text")).where(F.col("n") >= least_sections)
    about = [F.concat(F.lit("Chapter: "), "chapter.parent")]
    if theses is not None:
        known = theses.where(~F.col("thesis").startswith("(no specific thesis")).select(F.col("parent").alias("p"), "thesis").dropDuplicates(["p"])
        texts = texts.join(known, F.col("chapter.parent") == F.col("p")).drop("p")
        about.append(F.concat(F.lit("Thesis: "), "thesis"))
    back = answered(texts, prompt_of(task, *about, F.col("text")), client)
    # Chapters are documents of their own here: their sections come back by the same split.
    new = markdown.split_sections(back.select(F.to_json("chapter").alias("k"), "chapter", F.col("reply").alias("text")), "k").where("level = 3").select("k", F.col("section_no").alias("place"), "body")
    new = new.join(back.select(F.to_json("chapter").alias("k"), "chapter"), "k").select("chapter", "place", "body")
    taken = synthesis.take_rewrites(own, new, least_words=0, least_sections=least_sections).select(F.col(f"chapter.{key}").alias(key), F.col("place").alias("section_no"), F.col("body").alias("new"))
    return parts.join(taken, [key, "section_no"], "left").withColumn("body", F.coalesce("new", "body")).drop("new")


def post_process(docs: DataFrame, key: str, client: Client, theses: DataFrame | None = None) -> DataFrame:
    """(key, text) of Markdown docs(key, text): sections refined, repetitions within a chapter taken out, chapters made
    coherent and, where theses(parent, thesis) has one, held against it; then the text clean-ups."""
    parts = refine(markdown.split_sections(docs, key), key, client)
    parts = revise_chapters(parts, key, client, "Take out what this chapter says twice. Keep its headings.")
    parts = revise_chapters(parts, key, client, "Make this chapter coherent. Keep its headings.")
    if theses is not None:
        parts = revise_chapters(parts, key, client, "Link every paragraph of this chapter to its thesis. Keep its headings.", theses, 1)
    return markdown.reassemble(parts.withColumn("body", T.textual_cleanup(F.col("body"))), key)


def contradictions(pairs: DataFrame, chunks: DataFrame, studies: DataFrame, client: Client) -> DataFrame:
    """(parent, folder, pair, point, study_a, study_b, possible_cause, ids) of candidate pairs(parent, folder, a, b, pair)
    that the model finds to contradict each other; failed and unreadable replies find nothing."""
    people = studies.select("pmid", "authors").dropDuplicates(["pmid"])
    known = chunks.select("chunk_id", "study_pmid", F.substring("text", 1, EXCERPT).alias("x")).join(people, F.col("study_pmid") == F.col("pmid"), "left").select("chunk_id", "x", F.coalesce("authors", "study_pmid").alias("who"))
    side = lambda c: known.select(F.col("chunk_id").alias(c), F.col("x").alias(f"x_{c}"), F.col("who").alias(f"study_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    excerpt = lambda c: F.concat(f"study_{c}", F.lit(": "), f"x_{c}")
    asked = answered(rows, prompt_of("Do these excerpts contradict each other? Answer in JSON with contradiction, point and possible_cause.", excerpt("a"), excerpt("b")), client)
    found = asked.withColumn("r", replies.contradiction_reply(T.text_or_empty(F.col("reply")))).where("r is not null")
    return found.select("parent", "folder", "pair", "r.point", "study_a", "study_b", "r.possible_cause", F.array("a", "b").alias("ids"))


def theme_theses(maps: DataFrame, client: Client) -> DataFrame:
    """(theme, thesis, research_priorities, grouped_gaps) of maps(theme, consensus, contradictions, gaps[, summary])."""
    listed = lambda xs, show: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, show), "\n")).otherwise("(none identified)")
    summary = F.col("summary") if "summary" in maps.columns else F.lit("(no analysis available)")
    parts = [
        F.concat(F.lit("Theme: "), "theme"), summary, F.lit("Consensus"), listed("consensus", lambda c: F.concat(F.lit("- "), c["statement"])), F.lit("Contradictions"), listed("contradictions", lambda c: F.concat(F.lit("- "), c["point"])),
        F.lit("Gaps"), listed("gaps", lambda g: F.concat(F.lit("- ["), g["priority"], F.lit("] "), g["description"])),
    ]
    asked = answered(maps, prompt_of("State a thesis, group the gaps and order research priorities, as JSON with thesis, grouped_gaps and research_priorities.", *parts), client)
    return asked.select("theme", replies.thesis_reply(T.text_or_empty(F.col("reply"))).alias("t")).select("theme", "t.*")


def synthesise_extractions(extractions: DataFrame, client: Client, least: int = 3, level: float = 0.95, budget: int = reduction.BUDGET) -> DataFrame:
    """One row: a meta-analysis if `least` extractions have an effect with its interval, else the model's themes.

    (type, k, pooled_effect, pooled_se, ci_lower, ci_upper, q, i_squared, tau_squared, summary); what does not apply is null. Studies that
    are more than `budget` characters are condensed level by level first, so no row and no prompt holds all of them.
    """
    numbers = ("pooled_effect", "pooled_se", "ci_lower", "ci_upper", "q", "i_squared", "tau_squared")
    if meta.synthesis_kind(extractions, least) == "meta_analysis":
        found = meta.fixed_effect(extractions, [], level=level)
        return found.select(F.lit("meta-analysis").alias("type"), "k", *numbers, F.lit(None).cast("string").alias("summary"))
    line = F.concat(F.lit("- ["), F.col("pmid"), F.lit("] "), T.text_or_empty(F.col("study_design")), F.lit(": "), T.text_or_empty(F.col("intervention")), F.lit(" → "), T.text_or_empty(F.col("outcome")))
    parts = extractions.select(F.struct("pmid", line.alias("l")).alias("place"), line.alias("text"))
    lines = reduction.condensed(parts, "Condense what these studies did and found, and keep their numbers.", client, budget).withColumn("k", F.lit(extractions.count()))
    asked = answered(lines, prompt_of("Identify the themes of these studies, where they agree and where they do not.", F.col("text")), client)
    return asked.select(F.lit("thematic").alias("type"), "k", *(F.lit(None).cast("double").alias(c) for c in numbers), F.col("reply").alias("summary"))


def tables(packages: DataFrame, client: Client, least: int = 200) -> DataFrame:
    """(parent, folder, table_id, caption, markdown) of packages(parent, folder, evidence) for which the model proposes a
    table; sections with less than `least` characters of evidence are not asked about, and a table without columns or rows is empty."""
    asked = answered(packages.where(F.length("evidence") >= least), prompt_of("Would a table help? Answer in JSON with should_create_table, caption, columns, rows and source_studies.", F.concat(F.lit("Theme: "), T.theme_key(F.col("parent"), F.col("folder"))), F.col("evidence")), client)
    spec = asked.withColumn("t", replies.table_proposal(T.text_or_empty(F.col("reply")))).where("t is not null")
    body = F.when((F.size("t.columns") > 0) & (F.size("t.rows") > 0), F.concat(markdown.markdown_table(F.col("t.caption"), F.col("t.columns"), F.col("t.rows")), F.when(F.size("t.source_studies") > 0, F.concat(F.lit("\n\n*Sources: "), F.array_join("t.source_studies", "; "), F.lit("*"))).otherwise(""))).otherwise("")
    return spec.select("parent", "folder", F.concat(F.lit("table_"), F.translate(F.lower("folder"), " ", "_")).alias("table_id"), F.col("t.caption").alias("caption"), body.alias("markdown"))


def place_tables(sections: DataFrame, made: DataFrame) -> DataFrame:
    """sections(section_pos, content, ...) with each `[TABLE: id]` replaced by the Markdown of that id in made(table_id, markdown);
    of tables with one id the last in the order of their Markdown counts, unknown marks stay."""
    mark = r"\[TABLE: ([^\]]*)\]"
    others = [c for c in sections.columns if c != "content"]
    cut = sections.select(*others, F.posexplode(F.arrays_zip(F.split("content", mark, -1).alias("before"), F.concat(F.regexp_extract_all("content", F.lit(mark), F.lit(1)), F.array(F.lit(None).cast("string"))).alias("id"))).alias("i", "x"))
    known = made.groupBy(F.col("table_id").alias("id")).agg(F.max("markdown").alias("markdown"))
    rows = cut.select(*others, "i", F.col("x.before").alias("before"), F.col("x.id").alias("id")).join(known, "id", "left")
    shown = F.concat("before", F.when(F.col("id").isNull(), "").otherwise(F.coalesce("markdown", F.concat(F.lit("[TABLE: "), "id", F.lit("]")))))
    joined = rows.groupBy(*others).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))), lambda x: x["s"]), "").alias("content"))
    return joined.select(*sections.columns)


MANUSCRIPT = r"""\documentclass[11pt]{article}
\usepackage[utf8]{inputenc}
\usepackage[english]{babel}
\usepackage{graphicx,booktabs,hyperref}
\title{<< title >>}
\date{\today}
\begin{document}
\maketitle
\begin{abstract}
A review of << n_studies >> studies.
\end{abstract}
\section{Introduction}
<< introduction >>
\section{Methods}
<< methods >>
\section{Results}
<< results >>
<% if forest %>\begin{figure}[htbp]
\centering
\includegraphics[width=\textwidth]{<< forest >>}
\caption{Effects of the studies and their pooled effect.}
\end{figure}
<% endif %>\section{Discussion}
<< discussion >>
\section*{References}
\end{document}
"""


def manuscript_sections(pico: dict[str, str], extractions: DataFrame, synthesised: DataFrame, counts: dict[str, int], client: Client, risk: DataFrame | None = None, budget: int = reduction.BUDGET) -> DataFrame:
    """(name, text) of introduction, methods, results and discussion. pico has topic, population, intervention,
    comparison, outcome and query; counts has retrieved, deduplicated and included; a failed call leaves a text empty. risk(pmid, overall_rating)
    adds each study's risk of bias to the results; studies over `budget` characters are condensed level by level."""
    row = F.concat(F.lit("- PMID "), "pmid", F.lit(": "), T.text_or_empty(F.col("study_design")), F.lit(", effect="), F.when(F.col("effect_size").isNotNull(), F.format_string("%.3f", "effect_size")).otherwise("none"))
    rows = extractions
    if risk is not None:
        rows = extractions.join(risk.groupBy("pmid").agg(F.max("overall_rating").alias("overall_rating")), "pmid", "left")
        row = F.concat(row, F.lit(", risk of bias="), F.coalesce("overall_rating", F.lit("unclear")))
    parts = rows.select(F.struct("pmid", row.alias("l")).alias("place"), row.alias("text"))
    studies = reduction.condensed(parts, "Condense what these studies did and found, and keep their numbers.", client, budget).withColumnRenamed("text", "studies")
    pooled = F.format_string("Pooled effect = %.3f, k = %d, I² = %.1f%%", "pooled_effect", F.col("k").cast("long"), "i_squared")
    both = studies.join(F.broadcast(synthesised.select(F.coalesce(F.when(F.col("type") == "meta-analysis", pooled), F.col("summary"), F.lit("Thematic analysis performed.")).alias("finding"))))
    topic = F.lit(f"Topic: {pico.get('topic', '')}")
    given = F.lit("; ".join(f"{k}: {pico.get(k, '')}" for k in ("population", "intervention", "comparison", "outcome")))
    flow = F.lit(f"Retrieved {counts['retrieved']}, after deduplication {counts['deduplicated']}, included {counts['included']}")
    prompts = {
        "introduction": prompt_of("Write the introduction of a systematic review, without invented references.", topic, given),
        "methods": prompt_of("Write its methods.", F.lit(f"Query: {pico.get('query', '')}"), flow),
        "results": prompt_of("Write its results from these data only.", F.col("studies"), F.col("finding")),
        "discussion": prompt_of("Write its discussion.", topic, flow, F.col("finding")),
    }
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("task")) for k, v in prompts.items()))).alias("x")).select("x.*")
    return answered(rows, F.col("task"), client).select("name", T.text_or_empty(F.col("reply")).alias("text"))


def manuscript(written: DataFrame, title: str, n_studies: int, forest: str = "", template: str = MANUSCRIPT) -> str:
    """The LaTeX of manuscript_sections(); their texts are escaped. forest names a picture, if there is one."""
    texts = {r["name"]: r["latex"] for r in written.select("name", T.inline_latex(F.col("text")).alias("latex")).collect()}
    return markdown.fill_template(template, {"title": title.title(), "n_studies": str(n_studies), "forest": forest, **texts})


LIMITATIONS = {
    "en": "The choice of sources and search terms may leave relevant studies out. Methods and units of the studies differ, so their numbers compare only in part. Null results are published less often than others. Automated screening, routing and writing can err and were held against fixed rules only.",
    "pt": "A escolha das fontes e dos termos de busca pode deixar de fora estudos relevantes. Métodos e unidades dos estudos diferem, de modo que seus números só se comparam em parte. Resultados nulos são publicados com menos frequência. Triagem, encaminhamento e redação automáticos podem errar e foram conferidos apenas por regras fixas.",
}
