"""Markdown and LaTeX documents as rows: sections of a text, tables, assembly and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T

HEADING = r"^(#{2,3})\s+(.+)$"
REFERENCES = r"(?iu)^#{1,3}\s*(references|referências|bibliography|bibliografia)"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line)"""
    return docs.select(key, F.posexplode_outer(F.split(T.text_or_empty(F.col(text)), r"\R")).alias("line_no", "line")).where("line is not null")


def split_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section_no, level, heading, parent, body): parts of each document at its `##` and `###` headings.

    Section 0 with level 0 is what comes before the first heading. parent is the last `##` heading so far, its own
    for such a section. Windows group one document's lines.
    """
    rows = lines(docs, key, text)
    order = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    level = F.when(F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1)))
    rows = rows.withColumn("lvl", level).withColumn("head", F.when(F.col("lvl").isNotNull(), T.strip(F.regexp_extract("line", HEADING, 2))))
    rows = rows.withColumn("section_no", F.count("lvl").over(order)).withColumn("parent", F.coalesce(F.last(F.when(F.col("lvl") == 2, F.col("head")), ignorenulls=True).over(order), F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lvl").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = rows.groupBy(key, "section_no").agg(F.coalesce(F.max("lvl"), F.lit(0)).alias("level"), F.coalesce(F.max("head"), F.lit("")).alias("heading"), F.max_by("parent", "line_no").alias("parent"), T.strip(body).alias("body"))
    return parts


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, text) of split_sections' rows: headings and bodies in order, a blank line between."""
    block = F.when(F.col("level") == 0, F.col("body")).otherwise(F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading")), F.nullif(F.col("body"), F.lit(""))))
    joined = parts.withColumn("block", block).where("block <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_no", "block"))).alias("b"))
    return joined.select(key, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"))


def markdown_table(caption: Column, columns: Column, rows: Column) -> Column:
    """A pipe table: header, rule, and a line for each map of `rows`; empty cells as a dash."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(columns, lambda c: T.cell_text(F.replace(F.coalesce(r[c], F.lit("")), F.lit("|"), F.lit("\\|"))))))
    rule = line(F.transform(columns, lambda c: F.lit("---")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("**"), caption, F.lit("**")), F.lit("")), F.array(line(columns), rule), body), "\n")


def assemble(sections: DataFrame, title: str, summary: str = "", limitations: str = "", agenda: list[str] | None = None) -> str:
    """One Markdown document of sections(parent_pos, folder_pos, parent, folder, content): a chapter heading whenever
    the parent changes. A document is read by people and held in memory as a whole."""
    out, parent = [f"# {title}"], None
    if summary:
        out.append(f"## Executive summary\n\n{summary}")
    for r in sections.orderBy("parent_pos", "folder_pos").select("parent", "folder", "content").toLocalIterator():
        if r["parent"] != parent:
            parent = r["parent"]
            out.append(f"## {parent}")
        out.append(f"### {r['folder']}\n\n{(r['content'] or '').strip()}")
    if limitations:
        out.append(f"## Limitations\n\n{limitations}")
    if agenda:
        out.append("## Research agenda\n\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(agenda, 1)))
    return "\n\n".join(out) + "\n"


def write_sections(sections: DataFrame, path: str) -> None:
    """sections(parent, folder, content) as Markdown files below path/parent_dir=.../folder_dir=..., names made safe."""
    rows = sections.withColumns({"parent_dir": T.safe_name(F.col("parent")), "folder_dir": T.safe_name(F.col("folder"))})
    rows.select(F.concat(F.lit("### "), "folder", F.lit("\n\n"), T.strip(T.text_or_empty(F.col("content")))).alias("value"), "parent_dir", "folder_dir").write.mode("overwrite").partitionBy("parent_dir", "folder_dir").text(path)


COMMANDS = {1: "section", 2: "subsection", 3: "subsubsection", 4: "paragraph", 5: "subparagraph", 6: "subparagraph"}
LANGUAGES = {"en": "english", "pt": "brazilian"}


def latex_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, kind, latex): every line of the documents as LaTeX; the first level-one heading is the title, list
    items carry their list's begin and end, rules and blank lines are kept apart by kind."""
    rows = lines(docs, key, text)
    order = W.partitionBy(key).orderBy("line_no")
    line = F.col("line")
    level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+.+$", 1))
    kind = F.when(line.rlike(r"^#{1,6}\s+.+$"), "heading").when(line.rlike(r"^\s*[-*+]\s+.+$") & ~line.rlike(r"^\s*([-*_]\s*){3,}$"), "item").when(line.rlike(r"^\s*([-*_]\s*){3,}$"), "rule").when(T.strip(line) == "", "blank").otherwise("text")
    rows = rows.select(key, "line_no", "line", kind.alias("kind"), level.alias("level"))
    tops = F.sum(F.when((F.col("kind") == "heading") & (F.col("level") == 1), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "heading") & (F.col("level") == 1) & (tops == 1), "title").otherwise(F.col("kind")))
    before, after = F.lag("kind").over(order), F.lead("kind").over(order)
    words = F.when(F.col("kind").isin("heading", "title"), F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)).when(F.col("kind") == "item", F.regexp_extract("line", r"^\s*[-*+]\s+(.+)$", 1)).otherwise(F.col("line"))
    rows = rows.withColumn("x", T.inline_latex(T.strip(words))).withColumn("opens", F.coalesce(before != "item", F.lit(True))).withColumn("closes", F.coalesce(after != "item", F.lit(True)))
    command = F.create_map(*(F.lit(v) for pair in COMMANDS.items() for v in pair))[F.col("level")]
    command = F.when(F.col("line").rlike(REFERENCES), F.concat(command, F.lit("*"))).otherwise(command)  # references are not numbered
    latex = (
        F.when(F.col("kind") == "title", F.concat(F.lit("\\title{"), "x", F.lit("}")))
        .when(F.col("kind") == "heading", F.concat(F.lit("\\"), command, F.lit("{"), "x", F.lit("}")))
        .when(F.col("kind") == "item", F.concat(F.when(F.col("opens"), "\\begin{itemize}\n").otherwise(""), F.lit("  \\item "), "x", F.when(F.col("closes"), "\n\\end{itemize}").otherwise("")))
        .when(F.col("kind").isin("rule", "blank"), F.lit(""))
        .otherwise(F.col("x"))
    )
    return rows.select(key, "line_no", "kind", latex.alias("latex"))


def markdown_to_latex(docs: DataFrame, key: str, text: str = "text", language: str = "en", options: str = "12pt,a4paper", contents: bool = True) -> DataFrame:
    """(key, latex): a whole article for each Markdown document, with a page of contents unless it is not wanted."""
    rows = latex_lines(docs, key, text)
    grouped = rows.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("kind") == "title", F.col("latex"))), F.lit("\\title{}")).alias("title"), F.array_sort(F.collect_list(F.when(F.col("kind") != "title", F.struct("line_no", "latex")))).alias("b"))
    body = T.strip(F.regexp_replace(F.array_join(F.transform("b", lambda x: x["latex"]), "\n"), r"\n{3,}", "\n\n"))
    head = f"\\documentclass[{options}]{{article}}\n\\usepackage[utf8]{{inputenc}}\n\\usepackage[T1]{{fontenc}}\n\\usepackage[{LANGUAGES.get(language, 'english')}]{{babel}}\n\\usepackage{{booktabs,graphicx,hyperref}}\n"
    front = "\n\\begin{document}\n\\maketitle\n" + ("\\tableofcontents\n\\newpage\n" if contents else "") + "\n"
    return grouped.select(key, F.concat(F.lit(head), F.col("title"), F.lit(front), body, F.lit("\n\n\\end{document}\n")).alias("latex"))


def fill_template(template: str, values: dict[str, str]) -> str:
    """<< name >> replaced by its value, <% if name %>...<% endif %> kept if the value is not empty."""
    import re

    template = re.sub(r"<%\s*if\s+(\w+)\s*%>(.*?)<%\s*endif\s*%>", lambda m: m.group(2) if values.get(m.group(1)) else "", template, flags=re.DOTALL)
    return re.sub(r"<<\s*(\w+)\s*>>", lambda m: values.get(m.group(1), ""), template)
