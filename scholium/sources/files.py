"""Studies from text, JSON, CSV, BibTeX, XML and PDF files. Every reader gives the columns of studies, with `path` and a
place within it to order by, and skips files that cannot be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators.dedup import checkpointed
from scholium.operators.studies import title_and_abstract

FIELDS = ("pmid", "title", "authors", "journal", "year", "abstract", "doi", "raw_text")


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.make_valid_utf8("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"))


def _year(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int"))


def _studies(rows: DataFrame, **columns: Column) -> DataFrame:
    empty = {c: F.lit("") for c in FIELDS} | {"year": F.lit(None).cast("int")}
    return rows.select("path", "place", *((columns.get(c, empty[c]) if c == "year" else T.text_or_empty(columns.get(c, empty[c]))).alias(c) for c in FIELDS))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """*.txt, below path too: first line as title, author and year from the file's name."""
    rows = _whole(spark, path, "*.txt").withColumn("place", F.lit(0).cast("long")).withColumn("ta", title_and_abstract(F.col("content"), F.col("stem")))
    return _studies(rows, pmid=F.col("stem"), title=F.col("ta.title"), abstract=F.col("ta.abstract"), authors=T.filename_author(F.col("stem")), year=T.filename_year(F.col("stem")), raw_text=F.col("content"))


def read_json(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """*.json: an object or an array of objects; `id` wins over `pmid`."""
    rows = _whole(spark, path, glob).select("path", F.try_parse_json("content").alias("v")).where("v is not null")
    rows = rows.select("path", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v")).alias("vs"))
    rows = rows.select("path", F.posexplode("vs").alias("place", "v")).withColumn("place", F.col("place").cast("long"))
    get = lambda k, kind="string": F.try_variant_get("v", f"$.{k}", kind)
    title, abstract = T.text_or_empty(get("title")), T.text_or_empty(get("abstract"))
    return _studies(rows, pmid=F.coalesce(get("id"), get("pmid")), title=title, authors=get("authors"), journal=get("journal"), year=get("year", "int"), abstract=abstract, doi=get("doi"), raw_text=F.coalesce(get("raw_text"), F.concat_ws(" ", title, abstract)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """*.csv, each with a header of its own; columns by name, absent ones empty; `id` wins over `pmid` where a file has it.

    Files are parsed without a header, as wide as the widest first line (which is one line; commas in quotes do not count), and every
    row looks its columns up in its own file's first row, so files may order their columns as they like. The window groups one
    file's rows, which one task reads anyway.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", "true")
    lines = found.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head"))
    width = heads.agg(F.max(1 + F.regexp_count(F.regexp_replace("head", '"(?:[^"]|"")*"', ""), F.lit(",")))).first()[0] or 1
    rows = found.schema(", ".join(f"c{k} string" for k in range(width))).csv(path, header=False, multiLine=True, quote='"', escape='"')
    rows = rows.select(F.array(*(f"c{k}" for k in range(width))).alias("cells"), F.col("_metadata.file_path").alias("path")).withColumn("place", F.monotonically_increasing_id())
    order = W.partitionBy("path").orderBy("place")
    rows = rows.withColumn("head", F.first("cells").over(order)).withColumn("n", F.row_number().over(order)).where("n > 1")
    get = lambda c: F.get("cells", F.array_position("head", c).cast("int") - 1)
    title, abstract = T.text_or_empty(get("title")), T.text_or_empty(get("abstract"))
    ident = F.when(F.array_contains("head", "id"), get("id")).otherwise(get("pmid"))
    return _studies(rows, pmid=ident, title=title, authors=get("authors"), journal=get("journal"), year=_year(get("year")), abstract=abstract, doi=get("doi"), raw_text=F.concat_ws(" ", title, abstract))


def read_bibtex(spark: SparkSession, path: str, glob: str = "*.bib") -> DataFrame:
    """*.bib: entries cut at `@kind{`, fields `name = {...}` without nested braces, the key before the first comma."""
    rows = _whole(spark, path, glob).select("path", F.posexplode(F.split("content", r"@\w+\{")).alias("place", "entry")).withColumn("place", F.col("place").cast("long"))
    rows = rows.withColumn("entry", T.strip(F.col("entry"))).where("entry <> ''")
    get = lambda c: T.strip(F.regexp_extract("entry", rf"(?i){c}\s*=\s*\{{([^}}]*)\}}", 1))
    key = F.when(F.contains("entry", F.lit(",")), T.strip(F.element_at(F.split("entry", ","), 1))).otherwise("unknown")
    return _studies(rows, pmid=key, title=get("title"), authors=get("author"), journal=get("journal"), year=_year(get("year")), abstract=get("abstract"), doi=get("doi"), raw_text=F.concat_ws(" ", get("title"), get("abstract")))


def parse_articles(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """(path, place, studies' columns) of rows(path, place, xml) with one PubmedArticle each."""
    x = F.col(xml)
    one = lambda p: F.xpath_string(x, F.lit(p))
    people = F.regexp_extract_all(x, F.lit(r"(?s)<Author[ >].*?</Author>"), F.lit(0))
    named = F.filter(F.transform(people, lambda a: F.struct(F.xpath_string(a, F.lit("//LastName")).alias("l"), F.xpath_string(a, F.lit("//ForeName")).alias("f"))), lambda p: p["l"] != "")
    authors = F.array_join(F.transform(named, lambda p: F.trim(F.concat_ws(" ", p["l"], p["f"]))), "; ")
    # The string value of an element has its inline marks' words in place; elements are joined by a blank.
    pieces = F.regexp_extract_all(F.regexp_extract(x, r"(?s)<Abstract>(.*?)</Abstract>", 1), F.lit(r"(?s)<AbstractText(?:\s[^>]*)?>.*?</AbstractText>"), F.lit(0))
    abstract = F.array_join(F.transform(pieces, lambda p: T.strip(F.xpath_string(p, F.lit("/AbstractText")))), " ")
    title = one("//ArticleTitle")
    return _studies(rows, pmid=one("//PMID"), title=title, authors=authors, journal=one("//Journal/Title"), year=_year(one("(//PubDate/Year)[1]")), abstract=abstract, doi=one("(//ELocationID[@EIdType='doi'])[1]"), raw_text=F.concat_ws("\n", title, abstract))


def read_pubmed(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """*.xml with PubmedArticle elements, each cut out as text and parsed on its own; inline marks do not end a title."""
    rows = _whole(spark, path, glob).select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"), F.lit(0))).alias("place", "xml"))
    return parse_articles(rows.withColumn("place", F.col("place").cast("long")))


def read_pdf(spark: SparkSession, path: str, done: DataFrame | None = None, extract: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, stem, text) of *.pdf whose stem is not in done(stem). extract(bytes) defaults to PyMuPDF, then pdfminer;
    a file that neither reads has a null text."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1).alias("stem"), "content")
    if done is not None:
        rows = rows.join(done.select("stem"), "stem", "left_anti")
    extract = extract or pdf_text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "stem": frame["stem"], "text": [extract(bytes(c)) for c in frame["content"]]})

    return rows.select("path", "stem", "content").mapInPandas(run, "path string, stem string, text string")


def convert_pdfs(spark: SparkSession, path: str, out: str, force: bool = False, extract: Callable[[bytes], str | None] | None = None) -> int:
    """Writes the text of every *.pdf below path to out/stem=NAME, without those that are there unless force; returns how
    many were converted. Files that cannot be read are left out and tried again the next time."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(out)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    done = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(F.regexp_extract("path", r"stem=([^/]*)/", 1).alias("stem")).where("stem <> ''").distinct() if there and not force else None
    found = checkpointed(read_pdf(spark, path, done, extract).where("text is not null"))
    found.select(F.col("text").alias("value"), "stem").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").text(out)
    return found.count()


def pdf_text(content: bytes) -> str | None:
    """Pages joined by blank lines, by whichever PDF library is installed; null without one or for a broken file."""
    import io

    try:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return "\n\n".join(page.get_text() for page in doc)
    except Exception:  # not installed, or a file it cannot read
        pass
    try:
        from pdfminer.high_level import extract_text

        return extract_text(io.BytesIO(content))
    except Exception:  # as above
        return None


READERS = {"txt": read_text, "json": read_json, "csv": read_csv, "bib": read_bibtex, "xml": read_pubmed}


def load_studies(spark: SparkSession, path: str, formats: tuple[str, ...] = ("txt", "json", "csv", "bib")) -> DataFrame:
    """All studies below path in the order of formats, paths and places; repeated ids stay. `pos` numbers them upwards, with gaps."""
    parts = None
    for rank, kind in enumerate(formats):
        rows = READERS[kind](spark, path).withColumn("format_rank", F.lit(rank))
        parts = rows if parts is None else parts.unionByName(rows)
    dealt = parts.repartitionByRange("format_rank", "path", "place").sortWithinPartitions("format_rank", "path", "place")
    return dealt.withColumn("pos", F.monotonically_increasing_id()).select("pos", *FIELDS)
