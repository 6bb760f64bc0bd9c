import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from scholium.plans import systematic
from scholium.plans.review import Run
from scholium.sources import search


def record(i, title=None):
    return f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>{title or f'T{i}'}</ArticleTitle><Abstract><AbstractText>about {i}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"


def Stand(days, reach=None, broken=()):
    """A server with articles by the days after OLDEST on which they came out; its class goes to tasks with it."""
    oldest, show = search.OLDEST, "".join([record(0)]).replace("0", "{0}")

    class Server:
        def __init__(self):
            self.reach = reach

        def search(self, query, first, last):
            ids = [i for i, d in enumerate(days) if first is None or first <= oldest + timedelta(days=d) <= last]
            return len(ids), {"ids": ids}

        def page(self, handle, start, size):
            ids = handle["ids"][start : start + size]
            if set(ids) & set(broken):
                raise OSError("no answer")
            return "".join(show.format(i) for i in ids)

    return Server()


LAST = search.OLDEST + timedelta(days=400)


def test_slices_have_every_hit_once():
    days = [0, 0, 0, 5, 5, 9, 100, 101, 101, 102, 399, 400, 400]
    found = search.slices(Stand(days, reach=3), "q", LAST)
    assert all(n <= 3 for n, _ in found)
    assert [i for _, h in found for i in h["ids"]] == list(range(len(days)))
    assert [n for n, _ in search.slices(Stand(days), "q", LAST)] == [13]
    with pytest.raises(ValueError):  # more hits on a day than the server reaches: an error, not lost rows
        search.slices(Stand([7] * 4, reach=3), "q", LAST)


def test_pages_log_and_failures(spark):
    studies, log = search.search_articles(spark, "q", Stand(list(range(23)), reach=6, broken=(10,)), size=4, retries=1, wait=0.0, today=LAST)
    pages = [set(h["ids"][k : k + 4]) for _, h in search.slices(Stand(list(range(23)), reach=6), "q", LAST) for k in range(0, len(h["ids"]), 4)]
    lost = next(p for p in pages if 10 in p)
    assert sorted(int(r.pmid) for r in studies.collect()) == sorted(set(range(23)) - lost)
    assert log.first().asDict() == {"query": "q", "total_ids": 23, "fetched": 23 - len(lost), "failed_batches": 1}


def test_a_limit_and_no_hits(spark):
    studies, log = search.search_articles(spark, "q", Stand(list(range(23)), reach=6), most=9, size=4, wait=0.0, today=LAST)
    assert sorted(int(r.pmid) for r in studies.collect()) == list(range(9)) and log.first().total_ids == 9
    studies, log = search.search_articles(spark, "q", Stand([]), today=LAST)
    assert studies.collect() == [] and log.first().asDict() == {"query": "q", "total_ids": 0, "fetched": 0, "failed_batches": 0}


def test_waits_double_and_requests_keep_apart(monkeypatch):
    waits = []
    monkeypatch.setattr(search.time, "sleep", waits.append)
    reader = search.Pages(Stand([0], broken=(0,)), "q", LAST, None, 5, 3, 1.0, 2.0)
    rows = list(reader.read(reader.partitions()[0]))
    assert rows == [(0, 1, None, "no answer")]
    assert [round(w) for w in waits] == [3, 4, 6, 2]  # the share of the rate, and 1, 2, 4 seconds before another try


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        url = urlparse(self.path)
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        if url.path.endswith("esearch.fcgi"):
            body = json.dumps({"esearchresult": {"count": "5", "webenv": "W", "querykey": asked["term"]}})
        else:
            assert (asked["WebEnv"], asked["query_key"], asked["email"]) == ("W", "heat", "a@b.c")
            body = "".join(record(i) for i in range(int(asked["retstart"]), min(5, int(asked["retstart"]) + int(asked["retmax"]))))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


def test_entrez_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        entrez = search.Entrez("a@b.c", base=f"http://127.0.0.1:{server.server_port}")
        studies, _ = search.search_articles(spark, "heat", entrez, size=2, wait=0.0)
        assert sorted(r.pmid for r in studies.collect()) == ["0", "1", "2", "3", "4"]
        assert entrez.search("heat", date(2000, 1, 2), date(2001, 1, 1))[0] == 5
    finally:
        server.shutdown()


def test_from_a_topic_to_a_manuscript(spark, tmp_path):
    def answers(prompt, options):
        if prompt.startswith("State population"):
            return '{"population": "p", "query": "heat"}'
        if prompt.startswith("Does this study fit"):
            return json.dumps({"decision": "include" if "T3" not in prompt else "exclude", "confidence": 0.9, "justification": "j"})
        if prompt.startswith("Extract"):
            return '{"study_design": "trial", "effect_size": 1.5, "ci_lower": 1.0, "ci_upper": 2.0}'
        return "text"

    run = Run(spark, str(tmp_path / "run"))
    tex = systematic.run_online(run, "heat", Stand(list(range(6))), answers, size=4, wait=0.0, today=LAST)
    assert "A review of 5 studies" in tex
    stages = run.tables()
    assert stages["retrieved"].count() == 6 and stages["search_log"].first().fetched == 6 and stages["retained"].where(F.col("pmid") == "3").count() == 0
    # A run that is there asks neither server nor model again.
    assert systematic.run_online(run, "heat", None, None) == tex


def test_many_pages_share_partitions(monkeypatch):
    monkeypatch.setattr(search, "PARTITIONS", 3)
    reader = search.Pages(Stand(list(range(23)), reach=6), "q", LAST, None, 2, 0, 0.0, 0.0)
    runs = reader.partitions()
    rows = [r for run in runs for r in reader.read(run)]
    assert len(runs) <= 3 and [r[0] for r in rows] == list(range(len(rows))) and sum(r[1] for r in rows) == 23
