from scholium.llm import decontam

ITEM = "a train leaves Berlin at 9 and travels 120 km to reach Paris before Alice who bought 4 tickets in Berlin for the journey"


def items(spark, *texts):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id int, h string")


def test_copies_and_changed_parameters(spark, make_docs):
    changed = ITEM.replace("Berlin", "London").replace("Paris", "Dover").replace("Alice", "Bob").replace("120 km", "75 miles").replace("9", "11").replace("4", "6")
    torn = ITEM.replace("in Berlin", "in Madrid").replace("Alice", "Berlin")
    docs = make_docs([
        (1, "before it. " + ITEM + " and after"), (2, "x " + changed), (3, torn), (4, ITEM[: len(ITEM) // 2]), (5, None), (6, ""), (7, "a few words"), (8, "other words " * 5000), (9, ITEM), (9, ITEM), (None, ITEM),
        (10, changed + "\n" + ITEM),
    ])
    found = {r.doc_id: (r.item_id, r.similarity) for r in decontam.contaminated(docs, items(spark, ITEM, "too short", None, "A B C D E F", "one other plain item of seven words")).collect()}
    assert set(found) == {1, 2, 9, 10, None}
    assert all(v == (0, 1.0) for v in found.values())
    kept = decontam.keep_clean(docs, items(spark, ITEM))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "8"]


def test_rows_without_an_id_are_judged_by_their_own_text(spark, make_docs):
    docs = make_docs([(None, ITEM), (None, "clean words only, nothing of the kind"), (None, None), (0, "clean too"), (None, ITEM)])
    assert [r.doc_id for r in decontam.contaminated(docs, items(spark, ITEM)).collect()] == [None]
    assert sorted(str(r.text) for r in decontam.keep_clean(docs, items(spark, ITEM)).collect()) == ["None", "clean too", "clean words only, nothing of the kind"]


def test_a_window_of_all_documents_and_items(spark, make_docs):
    """Every document and item holds one passage; only those with the rest of an item are its copies."""
    import random

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    common = "this is what every document and every item has to say"
    benchmark = [f"{words(12)} {common} {words(12)}" for _ in range(30)] + [common]
    docs = [(i, f"{words(20)} {common} {words(20)}") for i in range(200)] + [(1000 + k, words(9) + " " + benchmark[k]) for k in range(30)] + [(2000, benchmark[3].replace(common, ""))]
    found = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(docs), items(spark, *benchmark)).collect())
    assert found == sorted([(i, 30) for i in range(200)] + [(1000 + k, k) for k in range(30)] + [(1000 + k, 30) for k in range(30)])
    keys = decontam.literal_windows(items(spark, *benchmark)).withColumn("by", decontam.F.lit("plain"))
    reached = decontam._reached(decontam._keyed(make_docs(docs)), keys, 0.8)
    assert reached.count() == len(found)


def test_recall_of_changed_parameters(spark, make_docs):
    """Items with numbers, units and names drawn anew are all found, others none."""
    import random

    rng = random.Random(6)
    words = lambda n: [rng.choice("abcdefgh") + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]

    def fill(frame):
        name = {}
        return " ".join(name.setdefault(w, rng.choice(["Alice", "Berta", "Carla", "Doris", "Emma", "Frieda"]) + str(len(name))) if w[0] == "N" else str(rng.randrange(2, 900)) if w == "#" else w for w in frame)

    frames = []
    for _ in range(40):
        frame = words(30)
        for k in rng.sample(range(30), 5):
            frame[k] = rng.choice(["#", "N1", "N2"])
        frames.append(frame)
    benchmark = [fill(f) for f in frames]
    docs = [(k, " ".join(words(10)) + " " + fill(f)) for k, f in enumerate(frames)] + [(100 + k, " ".join(words(60))) for k in range(40)]
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(docs), items(spark, *benchmark)).collect()}
    assert found == {(k, k) for k in range(40)}


def test_without_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert [r.doc_id for r in decontam.contaminated(make_docs([(1, ITEM), (2, "no")]), items(spark, ITEM)).collect()] == [1]


def test_empty_tables_and_plan(spark, make_docs):
    assert decontam.contaminated(make_docs([]), items(spark, ITEM)).collect() == []
    assert decontam.contaminated(make_docs([(1, ITEM)]), items(spark, ITEM).limit(0)).collect() == []
    plan = decontam.contaminated(make_docs([(1, ITEM)]), items(spark, ITEM))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_copies_in_other_case(spark, make_docs):
    docs = make_docs([(1, "before it " + ITEM.upper() + " and after"), (2, ITEM.lower()), (3, ITEM.title()), (4, ITEM.upper()[: len(ITEM) // 2]), (5, "Straße " + ITEM)])
    found = {r.doc_id: r.similarity for r in decontam.contaminated(docs, items(spark, ITEM)).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 1.0, 5: 1.0}
    street = "die alte straße führt am großen fluß entlang bis zur stadt"
    assert [r.doc_id for r in decontam.contaminated(make_docs([(1, street.upper())]), items(spark, street)).collect()] == [1]
    names = "Berlin Paris London Madrid Rome Dover"
    assert [r.doc_id for r in decontam.contaminated(make_docs([(1, "x " + names), (2, "Bonn Kiel Ulm Trier Mainz Jena")]), items(spark, names)).collect()] == [1]


def test_odd_slots_cost_their_own_windows_only(spark, make_docs):
    item = "Alice picked 12 apples from the tree and then 7 apples from the ground before Bob came home to bake a fine cake for all of the guests"
    renamed = item.replace("Alice", "Carol").replace("Bob", "Dave")
    long = item + " while Bob sang and nobody else in the whole house could sleep at all that night or even the next morning after the party was over"
    mixed = long.replace("Alice", "Carol").replace("while Bob", "while Eve")
    docs = make_docs([(1, renamed.replace("12", "5").replace("7", "5")), (2, long.replace("while Bob", "while Eve")), (3, mixed)])
    found = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in decontam.contaminated(docs, items(spark, item, long)).collect()}
    assert found[1, 0][0] == found[1, 0][1]
    assert {2, 3} <= {d for d, i in found if i == 1} and found[2, 1][0] < found[2, 1][1]
