from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholium.llm import licences


def scan(docs, known=None):
    return sorted((str(r.doc_id), r.line_no, r.license, r.whole) for r in licences.licence_scan(docs, known).collect())


def test_whole_texts_lines_and_spellings(make_docs):
    mit = licences.TEXTS["MIT"]
    docs = make_docs([
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE") + "\nAll rights reserved."),
        (2, "Some words.\nReleased under the MIT Licence.\r\nLicensed under CC BY-NC 4.0. "),
        (3, "This text speaks of the MIT License but is none."),
        (4, None), (5, ""), (6, " .,; \n--"), (7, "SPDX-License-Identifier: GPL-3.0"), (7, "SPDX-License-Identifier: GPL-3.0"), (None, "CC0"),
        (8, "word " * 20_000),
    ])
    found = scan(docs)
    assert ("1", 3, "MIT", True) in found and [f for f in found if f[0] == "2"] == [("2", 2, "MIT", False), ("2", 3, "CC-BY-NC-4.0", False)]
    assert not any(f[0] in "34568" for f in found)
    assert found.count(("7", 1, "GPL-3.0", True)) == 2 and ("None", 1, "CC0-1.0", True) in found
    assert scan(make_docs([])) == []


def test_wrapped_within_other_text_and_without_a_title(make_docs):
    def wrapped(text, width):
        out, line = [], ""
        for w in text.split():
            line = f"{line} {w}".strip()
            if len(line) > width:
                out.append(" * " + line)
                line = ""
        return "\n".join([*out, " * " + line])

    rows = [(k, "Prose before the licence.\n" + wrapped(text, 20 + k) + "\nprose after it") for k, (_, text) in enumerate(licences.known_licences()) if len(text) > 300]
    rows.append((900, "word " * 30_000 + "\n" + licences.TEXTS["ISC"].partition("\n\n")[2] + "\n" + "word " * 10))
    names = [name for name, _ in licences.known_licences()]
    found = licences.licence_scan(make_docs(rows)).where("n_words > 20").collect()
    assert {r.doc_id: r.license for r in found} == {k: names[k] if k < 900 else "ISC" for k, _ in rows}
    assert all(r.line_no == 2 and not r.whole for r in found if r.license != "MIT" or r.doc_id == 0)


def test_parts_of_lines_and_changed_texts_are_none(make_docs):
    isc = licences.TEXTS["ISC"]
    docs = make_docs([(1, isc.replace("or without fee", "without a fee")), (2, "so " + isc.partition("\n\n")[2]), (3, isc.partition("\n\n")[2] + " and more on this line"), (4, "MIT License and so on")])
    assert [f for f in scan(docs) if f[2] != "ISC" or f[1] > 1] == [] and [f[0] for f in scan(docs)] == ["1"]  # the title line alone


def test_a_table_of_the_caller_and_equal_digests(make_docs):
    known = [("b", "One  odd licence"), ("a", "one ODD license!"), ("c", ""), ("d", None), ("e", "copyright holders of all")]
    docs = make_docs([(1, "x\nOne odd licence.\ny"), (2, "the copyright\nowners of all"), (3, "Copyright\nHolders, of all")])
    assert scan(docs, known) == [("1", 2, "a", False), ("3", 1, "e", True)]
    assert scan(docs, []) == []


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "LGPL-2.1"])
def test_long_texts_by_digest(make_docs, name):
    file = Path("/usr/share/common-licenses", name.removesuffix(".0") if "GPL" in name and name.endswith(".0") else name)
    if not file.exists():
        pytest.skip("the text is not here")
    text = file.read_text(encoding="utf-8")
    assert (str(5), 4, name, False) in scan(make_docs([(5, "Some words\nbefore it\n\n" + text.replace("\n", "\r\n").lstrip() + "\nafter")]))


def test_words_agree_with_columns(spark):
    texts = [t for _, t in licences.known_licences()] + ["© 2021 X\nA  licence, B!\nCopyright by X 1999\nc copyright\nholder"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(licences._stream(F.col("t")), lambda x: x["word"]).alias("c")).collect()
    assert all(r.c == licences.canonical_words(r.t) for r in rows)


def test_no_shuffle_and_no_python(make_docs):
    plan = licences.licence_scan(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan
