import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from scholium.operators import compose, markdown, replies
from scholium.plans.review import Run
from scholium.sources import files, search


def test_streaming_client(tmp_path):
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200 if asked[-1][1]["prompt"] != "bad" else 500)
            self.end_headers()
            self.wfile.write(b'{"response": "a "}\nnoise\n\n{"response": "b", "done": true}\n{"response": "c"}\n')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = replies.streaming_client(f"http://127.0.0.1:{server.server_port}/", "m", temperature=0.5, num_ctx=99)
    assert client("p", {"model": "other", "seed": 3}) == "a b"
    assert asked[0] == ("/api/generate", {"model": "other", "prompt": "p", "stream": True, "options": {"temperature": 0.5, "seed": 3, "num_ctx": 99}})
    with pytest.raises(OSError):
        client("bad", {})
    server.shutdown()


def test_tables_are_placed(spark):
    rows = spark.createDataFrame([(1, "a [TABLE: t_1] b [TABLE: none] c"), (2, "plain"), (3, "[TABLE: t_1]")], "section_pos int, content string")
    made = spark.createDataFrame([("t_1", "|x|")], "table_id string, markdown string")
    assert {r.section_pos: r.content for r in compose.place_tables(rows, made).collect()} == {1: "a |x| b [TABLE: none] c", 2: "plain", 3: "|x|"}


def test_manuscript(spark):
    written = spark.createDataFrame([("introduction", "A & B"), ("methods", "m"), ("results", "r"), ("discussion", "d")], "name string, text string")
    plain, pictured = compose.manuscript(written, "a title", 3), compose.manuscript(written, "a title", 3, "plot.png")
    assert "\\title{A Title}" in plain and "A \\& B" in plain and "of 3 studies" in plain and "figure" not in plain and "plot.png" in pictured and "<<" not in pictured


def test_failed_calls_change_nothing(spark):
    def fails(prompt, options):
        raise OSError("no answer")

    docs = spark.createDataFrame([(1, "## A\n\n### a\n\n" + "word " * 30 + "\n\n### b\n\ntext")], "k int, text string")
    theses = spark.createDataFrame([("A", "t")], "parent string, thesis string")
    assert compose.post_process(docs, "k", fails, theses).first().text == markdown.reassemble(markdown.split_sections(docs, "k"), "k").first().text
    entries = spark.createDataFrame([(1, "p", "f", "g", "e")], "section_pos int, parent string, folder string, prompt string, evidence string")
    assert compose.write_entries(entries, fails).first().content == ""
    assert compose.executive_summary(spark.createDataFrame([(1, "p", "f", "c")], "section_pos int, parent string, folder string, content string"), "T", fails).first().summary == ""


def test_only_chapters_with_a_thesis_are_held_against_it(spark):
    docs = spark.createDataFrame([(1, "## A\n\n### a\n\none\n\n## B\n\n### b\n\ntwo\n\n## C\n\n### c\n\nthree")], "k int, text string")
    theses = spark.createDataFrame([("A", "t"), ("B", compose.NO_THESIS)], "parent string, thesis string")
    shout = lambda prompt, options: prompt.split("Thesis: t\n")[1].upper()
    parts = compose.revise_chapters(markdown.split_sections(docs, "k"), "k", shout, "Link.", theses, 1)
    assert {r.heading: r.body for r in parts.where("level = 3").collect()} == {"a": "ONE", "b": "two", "c": "three"}


def test_anchors(spark):
    kind = "theme string, consensus array<struct<statement:string,strength:string,ids:array<string>>>"
    rows = spark.createDataFrame([("x", [("s", "", ["c1", "c2"]), ("no ids", "", [])]), ("y", [])], kind)
    found = {r.theme: r.anchors for r in compose.anchors(rows).collect()}
    assert found["y"] is None and found["x"].endswith("- s [chunks:c1, c2]") and "no ids" not in found["x"]


def test_files_with_unlike_headers_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,pmid,abstract\nT1,1,A1\n")
    (tmp_path / "b.csv").write_text('abstract,year,"title",id,pmid\n"A,2",2002,T2,i2,2\n,,"last ""one""",i3,3\n')
    found = sorted((r.pmid, r.title, r.abstract, r.year) for r in files.read_csv(spark, str(tmp_path)).collect())
    assert found == [("1", "T1", "A1", None), ("i2", "T2", "A,2", 2002), ("i3", 'last "one"', "", None)]
    (tmp_path / "x.xml").write_text("<PubmedArticle><PMID>1</PMID><Abstract><AbstractText> CO<sub>2</sub> melts. </AbstractText><AbstractText>More.</AbstractText></Abstract></PubmedArticle>")
    assert files.read_pubmed(spark, str(tmp_path)).first().abstract == "CO2 melts. More."


def test_pdf_conversion_goes_on_where_it_stopped(spark, tmp_path):
    for name in ("a", "b", "broken"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())
    extract = lambda content: None if b"broken" in content else content.decode()[5:]
    out = str(tmp_path / "out")
    assert files.convert_pdfs(spark, str(tmp_path / "in"), out, extract=extract) == 2
    assert files.convert_pdfs(spark, str(tmp_path / "in"), out, extract=extract) == 0
    assert files.convert_pdfs(spark, str(tmp_path / "in"), out, force=True, extract=extract) == 2
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a", "b"]


def test_run_counts_and_tables(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    rows = run.stage("one", lambda: spark.range(5).where("id > 1"), spark.range(5))
    assert rows.count() == 3 and list(run.tables()) == ["one"]
    assert json.loads(run.events().where(F.col("stage") == "one").first().payload) == {"n_after": 3, "n_before": 5}


def test_systematic_review(spark, tmp_path):
    from scholium.plans.systematic import run_systematic

    studies = spark.createDataFrame([(i, f"p{i}", f"Trial {i if i != 4 else 3}", f"Effect {i}.") for i in range(6)], "pos long, pmid string, title string, abstract string")
    calls = []

    def client(prompt, options):
        if prompt.startswith("State"):
            return '{"population": "adults", "query": "q"}'
        if prompt.startswith("Does"):
            if "Trial 5" in prompt:
                raise OSError("no answer")
            return json.dumps({"decision": "exclude" if "Trial 0" in prompt else "include", "confidence": 0.9, "justification": "j"})
        if prompt.startswith("Extract"):
            n = int(prompt.split("Effect ")[1][0])
            return "none" if n == 2 else json.dumps({"study_design": "rct", "effect_size": 1.0 + n, "ci_lower": 0.5 + n, "ci_upper": 1.5 + n})
        return "Text & more." if prompt.startswith("Write") else "[]"

    run = Run(spark, str(tmp_path / "r"))
    text = run_systematic(run, studies, "heat pumps", client)
    assert "\\title{Heat Pumps}" in text and "Text \\& more." in text and "A review of 4 studies." in text
    tables = run.tables()
    assert {r.pmid: r.decision for r in tables["decisions"].collect()} == {"p0": "exclude", "p1": "include", "p2": "include", "p3": "include", "p5": "ambiguous"}
    assert sorted((r.pmid, r.error is None) for r in tables["extracted"].collect()) == [("p1", True), ("p2", False), ("p3", True), ("p5", True)]
    assert tables["pooled"].first().type == "meta-analysis" and tables["pooled"].first().k == 3
    assert run_systematic(Run(spark, str(tmp_path / "r")), studies, "heat pumps", lambda p, o: calls.append(p)) == text and not calls


def test_a_model_for_each_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, m string")
    found = replies.ask(rows, F.lit("p"), lambda prompt, options: options.get("model", "default"), {"seed": 1}, model=F.col("m")).collect()
    assert {r.k: r.reply for r in found} == {1: "a", 2: "b", 3: "default"} and "m" in found[0].asDict()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from scholium.operators.dedup import ensure_checkpoint_dir

    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default)))


def test_stand_in_writer_upper_cases_ascii_letters_alone():
    from scholium.plans.writing import draft_client

    assert draft_client("Polish\nstraße é x", {}) == "STRAßE é X"
