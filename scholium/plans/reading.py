"""Registered queries of readers and searches: tables are written as files of each format and read back."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators.dedup import ensure_checkpoint_dir
from scholium.plans import oracle
from scholium.plans.catalog import SQL, query, read_table, studies_of
from scholium.sources import files, search, store


def folder(spark: SparkSession) -> str:
    """A new folder's name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("pmid", *columns, F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"), F.md5("raw_text").alias("raw_md5"))


@query
def read_text_files(spark, sf):
    """A1, A2: each benchmark text as a file of its own, bad file names and all."""
    path = folder(spark)
    read_table(spark, sf, "benchmark").select(F.col("text").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = files.read_text(spark, path)
    return rows.select(F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"), F.md5("raw_text").alias("raw_md5")).groupBy("title_md5", "abstract_md5", "raw_md5").agg(F.count("*").alias("n"))


@query
def read_json_files(spark, sf):
    """A2: documents as arrays of objects, some with id, some with pmid, some without a title."""
    path = folder(spark)
    fields = F.struct(
        F.when(F.col("pos") % 2 == 0, F.col("pos")).alias("id"), F.concat(F.lit("p"), "pmid").alias("pmid"), F.when(F.col("pos") % 5 > 0, F.col("title")).alias("title"), "abstract", "authors",
        F.when(F.col("pos") % 3 == 0, 1900 + F.col("pos") % 100).alias("year"), F.when(F.col("pos") % 7 == 0, F.col("raw_text")).alias("raw_text"),
    )
    made = studies_of(spark, sf).groupBy((F.col("pos") % 64).alias("b")).agg(F.array_join(F.collect_list(F.to_json(fields)), ",").alias("v"))
    made.select(F.concat(F.lit("["), "v", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return _shown(files.read_json(spark, path, "*.txt"), "year", "authors")


@query
def read_csv_files(spark, sf):
    """A3: two headers that order and name the columns apart."""
    path = folder(spark)
    rows = studies_of(spark, sf)
    year = F.when(F.col("pos") % 3 == 0, (1900 + F.col("pos") % 100).cast("string")).otherwise("n.d.").alias("year")
    plain = lambda c: F.translate(c, "\r", "").alias(c)
    for k, columns in enumerate(([F.col("pmid"), plain("title"), year, plain("abstract")], [plain("abstract"), F.concat(F.lit("p"), "pmid").alias("pmid"), F.col("authors"), plain("title"), F.col("pmid").alias("id")])):
        part = rows.where(F.col("pos") % 2 == k).select(columns)
        part.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{k}")
    return _shown(files.read_csv(spark, path), "year", "authors")


@query
def read_bibtex_files(spark, sf):
    """A4: documents as entries."""
    path = folder(spark)
    clean = lambda c: T.strip(F.translate(c, "{}@\r", ""))
    entry = F.concat(F.lit("@article{k"), "pmid", F.lit(",\n title = {"), clean("title"), F.lit("},\n Abstract={ "), clean("abstract"), F.lit(" },\n year={"), F.when(F.col("pos") % 3 == 0, (1900 + F.col("pos") % 100).cast("string")).otherwise("n.d."), F.lit("}\n}"))
    studies_of(spark, sf).select(entry.alias("value")).write.text(path)
    return _shown(files.read_bibtex(spark, path, "*.txt"), "year")


@query
def read_article_files(spark, sf):
    """Benchmark texts as articles, with inline marks and several abstract texts."""
    path = folder(spark)
    clean = F.translate(F.col("text"), "<>&\r", "")
    first, rest = F.regexp_extract(clean, r"(?s)^(.{0,40})", 1), F.regexp_extract(clean, r"(?s)^.{0,40}(.*)$", 1)
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("item_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>CO<sub>2</sub> of "), first, F.lit("</ArticleTitle><AuthorList><Author><LastName>Doe</LastName><ForeName>A</ForeName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate><Year>"),
        (1900 + F.col("item_id") % 100).cast("string"), F.lit("</Year></PubDate></JournalIssue></Journal><Abstract><AbstractText Label='A'> x<i>y</i>z "), first, F.lit("</AbstractText><AbstractText>"), rest, F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"),
    )
    read_table(spark, sf, "benchmark").select(xml.alias("value")).write.text(path)
    return _shown(files.read_pubmed(spark, path, "*.txt"), "year", "authors", "journal")


@query
def filename_fields(spark, sf):
    """Author and year from file names that are made of sources and ids."""
    stem = F.concat(F.translate("source", ".-", "__"), F.when(F.col("doc_id") % 3 == 0, F.lit("_")).otherwise(""), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9000 + 1000).cast("string")).otherwise("_x  y"))
    return read_table(spark, sf, "documents").select("doc_id", T.filename_author(stem).alias("author"), T.filename_year(stem).alias("year"))


class Shelf:
    """A stand-in for the article server with so many articles, numbered from 0, two to a pmid, one published a day. It reaches no
    more than 40 hits of a search, fails once for each page that begins with an odd number, and always for pages whose number of a first article
    leaves 1 when divided by three."""

    reach = 40

    def __init__(self, total: int):
        self.total, self.asked = total, set()

    def search(self, query, first, last):
        lo, hi = 0, self.total
        if first is not None:
            lo, hi = ((d - search.OLDEST).days for d in (first, last + timedelta(days=1)))
        lo, hi = min(lo, self.total), min(hi, self.total)
        return hi - lo, {"first": lo}

    def page(self, handle, start, size):
        first = handle["first"] + start
        again = first in self.asked
        self.asked.add(first)
        if first % 3 == 1 or first % 2 and not again:
            raise OSError("no answer")
        return "".join(f"<PubmedArticle><MedlineCitation><PMID>{i // 2}</PMID><Article><ArticleTitle>T{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in range(first, first + size))


def _search(spark, sf):
    """As many articles as there are users, in pages of 7, of searches cut by date."""
    total = read_table(spark, sf, "events").select("user_id").distinct().count()
    return search.search_articles(spark, "users", Shelf(total), size=7, wait=0.0, today=search.OLDEST + timedelta(days=2 * total))


@query
def stored_studies(spark, sf):
    """Documents in three loads under keys that they share; a fourth is interrupted before its manifest."""
    rows = studies_of(spark, sf).select("pos", (F.col("pos") % 701).cast("string").alias("pmid"), F.md5("title").alias("title_md5"))
    table = store.Store(spark, folder(spark), "pos long, pmid string, title_md5 string", "pmid", buckets=8)
    table.insert(rows.where("pos % 3 = 0"))
    table.insert(rows.where("pos % 3 <> 0"))
    table._load(rows.select("pos", "pmid", F.lit("lost").alias("title_md5")), True)
    table.replace(rows.where("pos % 5 = 1"))
    return table.read()


@query
def article_search(spark, sf):
    """An article for each user, page by page; two share a pmid, so the first of them stays."""
    return _search(spark, sf)[0].select("pmid", "title")


@query
def article_search_log(spark, sf):
    """Hits, articles and failed pages of the search."""
    return _search(spark, sf)[1]


S = f"WITH {oracle.STUDIES}"
_PAGES = f"""RECURSIVE t AS (SELECT count(DISTINCT user_id) AS n FROM events), cut(a, b) AS (SELECT 0::BIGINT, 2 * n FROM t UNION ALL SELECT unnest([a, a + (b - a) // 2 + 1]), unnest([a + (b - a) // 2, b]) FROM cut, t WHERE least(b + 1, n) - least(a, n) > {Shelf.reach}),
        s AS (SELECT a, least(b + 1, n) - least(a, n) AS hits FROM cut, t), p AS (SELECT unnest(range(a, a + hits, 7)) AS first, a + hits AS z FROM s WHERE hits <= {Shelf.reach}), pages AS (SELECT first, least(7, z - first) AS hits, first % 3 <> 1 AS ok FROM p)"""
_CLEAN = lambda c: oracle.strip(f"translate({c}, '{{}}@' || chr(13), '')")
_NO_CR = lambda c: f"replace({c}, chr(13), '')"

SQL |= {
    "read_text_files": rf"""WITH l AS (SELECT text AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: {oracle.strip('x')}), lambda x: x <> '') AS ls FROM (SELECT text || chr(10) AS text FROM benchmark))
        SELECT md5(ls[1]) AS title_md5, md5(CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], chr(10)) ELSE t END) AS abstract_md5, md5(t) AS raw_md5, count(*) AS n FROM l GROUP BY ALL""",
    "read_json_files": f"""{S}, r AS (SELECT *, CASE WHEN pos % 5 > 0 THEN title ELSE '' END AS t2 FROM studies)
        SELECT CASE WHEN pos % 2 = 0 THEN pmid ELSE 'p' || pmid END AS pmid, CAST(CASE WHEN pos % 3 = 0 THEN 1900 + pos % 100 END AS INTEGER) AS year, coalesce(authors, '') AS authors, md5(t2) AS title_md5, md5(abstract) AS abstract_md5,
          md5(CASE WHEN pos % 7 = 0 THEN raw_text ELSE t2 || ' ' || abstract END) AS raw_md5 FROM r""",
    "read_csv_files": f"""{S}, r AS (SELECT pos, pmid, authors, {_NO_CR('title')} AS t, {_NO_CR('abstract')} AS a FROM studies)
        SELECT pmid, CAST(CASE WHEN pos % 2 = 0 AND pos % 3 = 0 THEN 1900 + pos % 100 END AS INTEGER) AS year, CASE WHEN pos % 2 = 1 THEN coalesce(authors, '') ELSE '' END AS authors, md5(t) AS title_md5, md5(a) AS abstract_md5, md5(t || ' ' || a) AS raw_md5 FROM r""",
    "read_bibtex_files": f"""{S}, r AS (SELECT pos, pmid, {_CLEAN('title')} AS t, {_CLEAN('abstract')} AS a FROM studies)
        SELECT 'k' || pmid AS pmid, CAST(CASE WHEN pos % 3 = 0 THEN 1900 + pos % 100 END AS INTEGER) AS year, md5(t) AS title_md5, md5(a) AS abstract_md5, md5(t || ' ' || a) AS raw_md5 FROM r""",
    "read_article_files": rf"""WITH c AS (SELECT item_id, translate(text, '<>&' || chr(13), '') AS t FROM benchmark), p AS (SELECT item_id, substr(t, 1, 40) AS a, substr(t, 41) AS b FROM c),
        r AS (SELECT item_id, 'CO2 of ' || a AS t, {oracle.strip("' xyz ' || a")} || ' ' || {oracle.strip('b')} AS x FROM p)
        SELECT CAST(item_id AS VARCHAR) AS pmid, CAST(1900 + item_id % 100 AS INTEGER) AS year, 'Doe A' AS authors, 'J' AS journal, md5(t) AS title_md5, md5(x) AS abstract_md5, md5(t || chr(10) || x) AS raw_md5 FROM r""",
    "filename_fields": r"""WITH s AS (SELECT doc_id, translate(source, '.-', '__') || CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '' END AS a, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9000 + 1000 AS VARCHAR) ELSE '_x  y' END AS b FROM documents)
        SELECT doc_id, regexp_replace(trim(replace(a || CASE WHEN doc_id % 2 = 0 THEN '' ELSE b END, '_', ' ')), '\s+', ' ', 'g') AS author, CAST(CASE WHEN doc_id % 2 = 0 THEN b END AS INTEGER) AS year FROM s""",
    "stored_studies": f"""{S}, k AS (SELECT pos, CAST(pos % 701 AS VARCHAR) AS pmid, md5(title) AS title_md5 FROM studies), a AS (SELECT * FROM k WHERE pos % 3 = 0 QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY pos) = 1),
        b AS (SELECT * FROM k WHERE pos % 3 <> 0 AND pmid NOT IN (SELECT pmid FROM a) QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY pos) = 1), c AS (SELECT * FROM k WHERE pos % 5 = 1 QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY pos DESC) = 1)
        SELECT * FROM c UNION ALL SELECT * FROM (FROM a UNION ALL FROM b) WHERE pmid NOT IN (SELECT pmid FROM c)""",
    "article_search": f"WITH {_PAGES} SELECT CAST(i // 2 AS VARCHAR) AS pmid, 'T' || min(i) AS title FROM (SELECT unnest(range(first, first + hits)) AS i FROM pages WHERE ok) GROUP BY i // 2",
    "article_search_log": f"WITH {_PAGES} SELECT 'users' AS query, CAST(sum(hits) AS BIGINT) AS total_ids, CAST(sum(hits) FILTER (ok) AS BIGINT) AS fetched, count(*) FILTER (NOT ok) AS failed_batches FROM pages",
}
