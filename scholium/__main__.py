"""Command line: analyse a folder of studies, write a review, convert PDF files, show a run, turn Markdown into LaTeX."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scholium", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyse", help="studies against an outline")
    run.add_argument("--studies", required=True, help="folder of txt, json, csv and bib files")
    run.add_argument("--taxonomy", required=True, help="outline or keyword taxonomy, JSON or Markdown")
    run.add_argument("--run", required=True, help="folder for the stages' tables; stages that are there are not run again")
    run.add_argument("--vocabulary", default="", help="comma-separated words that texts are compared by")
    run.add_argument("--no-scope", action="store_true", help="keep studies that are out of scope")
    tex = commands.add_parser("md2latex", help="a Markdown file as a LaTeX article")
    tex.add_argument("file")
    tex.add_argument("--output")
    tex.add_argument("--lang", choices=("en", "pt"), default="en")
    pdf = commands.add_parser("convert", help="the text of a folder's PDF files; those that are there are left out")
    pdf.add_argument("--input", required=True)
    pdf.add_argument("--output", required=True)
    pdf.add_argument("--force", action="store_true", help="convert again what is there")
    seen = commands.add_parser("stages", help="what a run has done: stages, rows and times")
    seen.add_argument("--run", required=True)
    write = commands.add_parser("review", help="analyse, then write a review with a local model")
    for name, more in {"--studies": {}, "--taxonomy": {"help": "outline"}, "--run": {}, "--output": {"help": "Markdown file"}, "--model": {}}.items():
        write.add_argument(name, required=True, **more)
    write.add_argument("--url", default="http://127.0.0.1:11434")
    write.add_argument("--title", default="Review")
    write.add_argument("--lang", choices=("en", "pt"), default="en")
    write.add_argument("--vocabulary", default="")
    write.add_argument("--no-scope", action="store_true")
    pico = commands.add_parser("systematic", help="screen, extract, rate and pool studies for a topic with a local model; a LaTeX manuscript")
    for name in ("--studies", "--topic", "--run", "--output", "--model"):
        pico.add_argument(name, required=True)
    pico.add_argument("--url", default="http://127.0.0.1:11434")
    online = commands.add_parser("online", help="search for a topic's articles, then as systematic")
    for name in ("--topic", "--email", "--run", "--output", "--model"):
        online.add_argument(name, required=True)
    online.add_argument("--url", default="http://127.0.0.1:11434")
    online.add_argument("--api-key", default="")
    online.add_argument("--most", type=int, help="hits to fetch; all of them if not given")
    online.add_argument("--rate", type=float, default=3.0, help="requests a second that all tasks make at most")
    args = parser.parse_args(args)
    # Checkpoints that nothing refers to any more go, so that a long run does not fill the shared folder.
    spark = SparkSession.builder.appName("scholium").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if args.command == "md2latex":
        from scholium.operators.markdown import markdown_to_latex

        docs = spark.createDataFrame([(args.file, Path(args.file).read_text(encoding="utf-8"))], "key string, text string")
        Path(args.output or Path(args.file).with_suffix(".tex")).write_text(markdown_to_latex(docs, "key", language=args.lang).first()["latex"], encoding="utf-8")
        return 0

    if args.command == "convert":
        from scholium.sources.files import convert_pdfs

        print(convert_pdfs(spark, args.input, args.output, args.force))
        return 0
    if args.command == "stages":
        from scholium.plans.review import Run

        Run(spark, args.run).events().orderBy("at").select("stage", "elapsed_s", "payload").show(200, truncate=False)
        return 0

    if args.command == "systematic":
        from scholium.operators.replies import streaming_client
        from scholium.plans.review import Run
        from scholium.plans.systematic import run_systematic
        from scholium.sources import files

        text = run_systematic(Run(spark, args.run), files.load_studies(spark, args.studies), args.topic, streaming_client(args.url, args.model))
        Path(args.output).write_text(text, encoding="utf-8")
        return 0

    if args.command == "online":
        from scholium.operators.replies import streaming_client
        from scholium.plans.review import Run
        from scholium.plans.systematic import run_online
        from scholium.sources.search import Entrez

        text = run_online(Run(spark, args.run), args.topic, Entrez(args.email, args.api_key), streaming_client(args.url, args.model), args.most, rate=args.rate)
        Path(args.output).write_text(text, encoding="utf-8")
        return 0

    from scholium.operators import dedup, screening
    from scholium.plans import analysis
    from scholium.plans.review import Run
    from scholium.sources import files, outline

    taxonomy = outline.load_taxonomy(args.taxonomy)
    state = Run(spark, args.run)
    studies = state.stage("studies", lambda: dedup.exact_title_dedup(files.load_studies(spark, args.studies)))
    if taxonomy.get("type") != "outline":
        rules = taxonomy.get("classification_rules", {})
        decisions = state.stage("decisions", lambda: screening.screen_by_keywords(studies, taxonomy.get("keywords", []), rules.get("include_if_any", []), rules.get("exclude_if_any", [])))
        screening.flow_counts(decisions).show()
        return 0
    sections = outline.sections_frame(spark, taxonomy["entries"])
    words = [w for w in args.vocabulary.split(",") if w] or sorted({w for e in taxonomy["entries"] for w in e["prompt"].lower().split() if len(w) > 3})
    settings = analysis.Settings(vocabulary=tuple(words), scope_on=not args.no_scope)
    if args.command == "review":
        from scholium.operators.replies import streaming_client
        from scholium.plans.agents import run_review

        text = run_review(state, studies, sections, settings, streaming_client(args.url, args.model), args.title, language=args.lang, polished=True)
        Path(args.output).write_text(text, encoding="utf-8")
        return 0
    found = analysis.analyse(studies, sections, settings)
    for name in ("chunks", "profiles", "tags", "flags", "stats", "evidence", "coverage"):
        state.stage(name, lambda name=name: getattr(found, name))
    state.stage("coverage", lambda: found.coverage).orderBy("section_pos").select("parent", "folder", "n_chunks", F.col("status")).show(200, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
