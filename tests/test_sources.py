import json

from scholium.sources import files, outline
from scholium.streaming import ingest

XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle>Effect of <i>X</i> on y</ArticleTitle>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Roe</LastName></Author></AuthorList>
<Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<ELocationID EIdType="pii">p</ELocationID><ELocationID EIdType="doi">10.1/x</ELocationID></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def write(folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "A_Name_2019.txt").write_text("\n First line \n\nsecond\nthird\n")
    (folder / "one.txt").write_text("only")
    (folder / "bad.txt").write_bytes(b"caf\xe9 line\nrest")
    (folder / "a.json").write_text(json.dumps([{"id": 5, "pmid": "p", "title": "T", "abstract": "A", "year": 2001}, {"title": "no id"}]))
    (folder / "b.json").write_text(json.dumps({"pmid": "q", "raw_text": "own"}))
    (folder / "broken.json").write_text("{")
    (folder / "c.csv").write_text('id,title,abstract,year\n1,"a, b","x\ny",1999\n1,dup,,n.d.\n')
    (folder / "d.bib").write_text("% head\n@article{key1, title = {A {B} C}, author={Doe}, year={2010}, booktitle={no}}\n@misc{key2, year={x}}")
    (folder / "e.xml").write_text(XML)


def test_every_format(spark, tmp_path):
    write(tmp_path)
    rows = files.load_studies(spark, str(tmp_path), ("txt", "json", "csv", "bib", "xml")).orderBy("pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r.pmid, r)
    assert by["A_Name_2019"].title == "First line" and by["A_Name_2019"].abstract == "second\nthird" and (by["A_Name_2019"].authors, by["A_Name_2019"].year) == ("A Name", 2019)
    assert by["one"].title == by["one"].abstract == "only" and by["bad"].abstract == "rest"
    assert by["5"].raw_text == "T A" and by["5"].year == 2001 and by["q"].raw_text == "own" and by[""].title == "no id"
    assert by["1"].title == "a, b" and by["1"].year == 1999 and sum(r.pmid == "1" for r in rows) == 2
    assert by["key1"].title == "A {B" and by["key1"].year == 2010 and by["key2"].year is None
    assert by["11"].title == "Effect of X on y" and by["11"].authors == "Doe Ann; Roe" and by["11"].abstract == "One. Two." and (by["11"].doi, by["11"].year, by["11"].journal) == ("10.1/x", 2020, "J")
    assert by["12"].title == "" and all(r.title is not None and r.doi is not None for r in rows)


def test_pdf_with_an_extractor(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())
    done = spark.createDataFrame([("b",)], "stem string")
    found = files.read_pdf(spark, str(tmp_path), done, lambda content: content.decode()[5:]).collect()
    assert [(r.stem, r.text) for r in found] == [("a", "a")]
    assert files.pdf_text(b"no pdf") is None


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"b": 1, "a": {"x": 0}}')
    first = outline.load_config(tmp_path / "c.json")["version"]["config_hash"]
    assert len(first) == 16 and first == outline.config_hash({"a": {"x": 0}, "b": 1}) != outline.config_hash({"a": {"x": 1}, "b": 1})


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"pmid": "a", "title": "first"}\n{"pmid": "a", "title": "again"}\n{"pmid": "b", "title": "other"}\n')
    stream = ingest.first_arrivals(ingest.stream_studies(spark, str(source)))
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (source / "2.json").write_text('{"pmid": "b", "title": "late"}\n{"pmid": "c", "title": "new"}\n')
    q.processAllAvailable()
    q.stop()
    assert sorted(r.pmid for r in spark.sql("select pmid from arrived").collect()) == ["a", "b", "c"]
    events = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'click' as event_type, 2.0 as value union all select timestamp'2024-01-01 00:50:00', 'click', 3.0")
    assert [(r.n, float(r.total)) for r in ingest.event_windows(events).collect()] == [(2, 5.0)]


def test_csv_width_comes_from_first_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,"abstract"\n1,T,' + '"' + "," * 3000 + '"\n2,"x, y",z\n')
    (tmp_path / "b.csv").write_text('"title, and more",pmid,title\nq,7,U\n')
    rows = {r.pmid: (r.title, r.abstract) for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": ("T", "," * 3000), "2": ("x, y", "z"), "7": ("U", "")}
