import pytest

from scholium.sources.store import Store

SCHEMA = "pos long, pmid string, title string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def seen(store, version=None):
    return {r.pmid: r.title for r in store.read(version).collect()}


def test_loads_in_a_row(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, "pmid", buckets=4)
    assert store.read().collect() == [] and store.version() == 0
    assert store.insert(table(spark, (2, "a", "late"), (1, "a", "first"), (3, "b", "B"), (4, None, "none"), (5, "", "empty"))) == 1
    assert seen(store) == {"a": "first", "b": "B", None: "none"}
    assert store.insert(table(spark, (0, "a", "ignored"), (9, "c", "C"))) == 2
    assert store.replace(table(spark, (1, "b", "old"), (2, "b", "new"), (3, "d", "D"))) == 3
    assert seen(store) == {"a": "first", "b": "new", "c": "C", "d": "D", None: "none"}
    assert seen(store, 1) == {"a": "first", "b": "B", None: "none"}  # earlier versions stay
    assert store.insert(table(spark).limit(0)) == 3
    assert seen(Store(spark, str(tmp_path), SCHEMA, "pmid", buckets=4)) == seen(store)


def test_an_interrupted_load_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, "pmid", buckets=4)
    store.insert(table(spark, (1, "a", "A")))
    store._load(table(spark, (2, "a", "half"), (3, "z", "half")), True)  # written, but its manifest is not
    assert seen(store) == {"a": "A"} and store.version() == 1
    store.replace(table(spark, (4, "z", "Z")))
    assert seen(store) == {"a": "A", "z": "Z"}


def test_two_loads_from_one_version(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path), SCHEMA, "pmid", buckets=2) for _ in range(2))
    one._load(table(spark, (1, "a", "one")), False)
    two._load(table(spark, (1, "b", "two")), False)
    one._commit()
    with pytest.raises(Exception, match="exists"):
        two._commit()
    assert seen(one) == {"a": "one"}
    two.insert(table(spark, (1, "b", "two")))
    assert seen(one) == {"a": "one", "b": "two"}


def test_untouched_buckets_are_not_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, "pmid", buckets=16)
    store.insert(table(spark, *((i, f"k{i}", "x") for i in range(60))))
    before = store.places()
    store.replace(table(spark, (0, "k7", "y")))
    changed = [b for b, folder in store.places().items() if before[b] != folder]
    assert len(changed) == 1 and sum(t == "y" for t in seen(store).values()) == 1 and len(seen(store)) == 60
