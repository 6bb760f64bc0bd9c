"""Articles by search as a Python data source: a partition is a run of pages of a search's hits, and no list of ids is kept anywhere."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholium.operators.dedup import checkpointed
from scholium.operators.studies import keep_first
from scholium.sources.files import parse_articles

ARTICLE = r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"
#: The first day that a search by date begins with.
OLDEST = date(1800, 1, 1)
#: Partitions of a search at most; one with more pages than that gets several pages to a partition, as a task costs more than a page.
PARTITIONS = 512


class Server(Protocol):
    """What answers a search. Both calls may raise; a server is sent to tasks, so it holds no open connection."""

    #: Hits of one search that page() can reach; None for all.
    reach: int | None

    def search(self, query: str, first: date | None, last: date | None) -> tuple[int, dict]:
        """How many articles were published from first to last (None: whenever), and a handle to read them by."""

    def page(self, handle: dict, start: int, size: int) -> str:
        """The XML of hits start, start + 1, ... of a handle, size of them at most."""


@dataclass
class Page:
    number: int
    handle: dict
    start: int
    size: int


@dataclass
class Run(InputPartition):
    pages: list[Page]


def slices(server: Server, query: str, last: date) -> list[tuple[int, dict]]:
    """(hits, handle) of searches that together have every hit once: a search with more hits than the server reaches is cut in
    halves by date of publication, a single day's hits beyond that being an error rather than lost."""
    total, handle = server.search(query, None, None)
    if server.reach is None or total <= server.reach:
        return [(total, handle)]
    found, todo = [], [(OLDEST, last)]
    while todo:
        first, until = todo.pop()
        n, handle = server.search(query, first, until)
        if n <= server.reach:
            found.append((n, handle))
        elif first == until:
            raise ValueError(f"{n} hits on {first}; the server reaches {server.reach}")
        else:
            middle = first + (until - first) // 2
            todo += [(middle + timedelta(days=1), until), (first, middle)]
    return [x for x in found if x[0]]


class Pages(DataSourceReader):
    """Reads (page, xml, error). A page is asked for `retries` more times, after waits that double; what fails then is a row with
    the error. Each task keeps to its share of the requests a second that all may make together."""

    def __init__(self, server: Server, query: str, last: date, most: int | None, size: int, retries: int, wait: float, pause: float):
        self.server, self.query, self.last, self.most, self.size, self.retries, self.wait, self.pause = server, query, last, most, size, retries, wait, pause

    def partitions(self) -> list[Run]:
        pages, left = [], self.most
        for hits, handle in slices(self.server, self.query, self.last):
            hits = hits if left is None else min(hits, left)
            left = None if left is None else left - hits
            pages += [Page(0, handle, at, min(self.size, hits - at)) for at in range(0, hits, self.size)]
        for number, page in enumerate(pages):
            page.number = number
        n = -(-len(pages) // PARTITIONS)
        return [Run(pages[k : k + n]) for k in range(0, len(pages), n or 1)] or [Run([])]  # Spark asks for one at least

    def read(self, run: Run) -> Iterator[tuple]:
        for page in run.pages:
            yield self._read(page)

    def _read(self, page: Page) -> tuple:
        xml = error = None
        for k in range(self.retries + 1):
            began = time.monotonic()
            try:
                xml, error = self.server.page(page.handle, page.start, page.size), None
            except Exception as e:  # whatever the transport raises costs this page only
                error = str(e)
            time.sleep(max(0.0, self.pause - (time.monotonic() - began)) + (self.wait * 2**k if error is not None and k < self.retries else 0.0))
            if error is None:
                break
        return page.number, page.size, xml, error


def articles(spark: SparkSession, server: Server, query: str, most: int | None = None, size: int = 50, retries: int = 3, wait: float = 1.0, rate: float | None = None, today: date | None = None) -> DataFrame:
    """(page, hits, xml, error) of all pages of a search, or of the first `most` hits if given; lazy.

    rate is how many requests a second all tasks make at most: as many run at once as the session has cores, and each waits its
    share. Hits are counted when the plan is made, their ids are never listed."""
    pause = 0.0 if rate is None else spark.sparkContext.defaultParallelism / rate
    last = today or date.today()

    class Articles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scholium_articles"

        def schema(self) -> str:
            return "page long, hits int, xml string, error string"

        def reader(self, schema) -> DataSourceReader:
            return Pages(server, query, last, most, size, retries, wait, pause)

    spark.dataSource.register(Articles)
    return spark.read.format("scholium_articles").load()


def search_articles(spark: SparkSession, query: str, server: Server, most: int | None = None, size: int = 50, **how) -> tuple[DataFrame, DataFrame]:
    """(studies, log) of a search, all its hits unless `most` says how many; how goes to articles().

    A page that fails for good is left out and counted. The first record of each pmid stays, of equal ones the
    earlier. Replies are checkpointed, so that a lost executor does not ask again for what was answered. log is one row:
    query, total_ids, fetched, failed_batches.
    """
    replies = checkpointed(articles(spark, server, query, most, size, **how))
    rows = replies.where("xml is not null").select("page", F.posexplode(F.regexp_extract_all("xml", F.lit(ARTICLE), F.lit(0))).alias("i", "xml"))
    found = checkpointed(parse_articles(rows.select(F.lit("").alias("path"), (F.col("page") * 1_000_000 + F.col("i")).alias("place"), "xml")))
    studies = keep_first(found.drop("path"), ["pmid"], [F.col("place")]).withColumnRenamed("place", "pos")
    log = replies.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("total_ids"), F.count_if(F.col("error").isNotNull()).alias("failed_batches")).join(F.broadcast(found.agg(F.count("*").alias("fetched"))))
    return studies, log.select(F.lit(query).alias("query"), "total_ids", "fetched", "failed_batches")


@dataclass
class Entrez:
    """The public E-utilities. A search's hits stay on the server under a key, and pages are fetched by their place there."""

    email: str
    api_key: str = ""
    base: str = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
    timeout: float = 60.0
    reach: int | None = 9_999

    def _get(self, tool: str, **params: str) -> bytes:
        common = {"db": "pubmed", "email": self.email, **({"api_key": self.api_key} if self.api_key else {})}
        with urllib.request.urlopen(f"{self.base}/{tool}.fcgi?{urllib.parse.urlencode({**common, **params})}", timeout=self.timeout) as reply:
            return reply.read()

    def search(self, query: str, first: date | None, last: date | None) -> tuple[int, dict]:
        dated = {} if first is None else {"datetype": "pdat", "mindate": f"{first:%Y/%m/%d}", "maxdate": f"{last:%Y/%m/%d}"}
        found = json.loads(self._get("esearch", term=query, retmax="0", usehistory="y", retmode="json", **dated))["esearchresult"]
        return int(found["count"]), {"WebEnv": found["webenv"], "query_key": found["querykey"]}

    def page(self, handle: dict, start: int, size: int) -> str:
        return self._get("efetch", retstart=str(start), retmax=str(size), rettype="xml", retmode="xml", **handle).decode("utf-8", errors="replace")
