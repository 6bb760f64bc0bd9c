"""Benchmark decontamination by template windows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholium.llm.common import cut, let, words_of
from scholium.llm.quality import STOP_WORDS

WORDS, SIMILARITY = 5, 0.8
#: A window of a benchmark text counts only with this many words that are no placeholders.
LITERALS = 2
#: Rows of one or two whole numbers (window hashes or candidate ids, 4 MB at most) that may be broadcast; beyond it the
#: join is left to a shuffle.
BROADCAST_ROWS = 200_000

EDGES = "\"'`.,;:!?()[]{}<>*#$%&|-_…«»“”‘’¿¡"
# Units of measure that follow a number.
UNITS = (
    "km m cm mm mi ft in yd kg g mg lb lbs oz l ml s sec h hr hrs min ms day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars euro euros cent cents usd eur percent degree degrees c f k hz khz mhz w kw v a n pa kpa bar mol kb mb gb tb"
).split()
NUMBER = r"^[+\-]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?$"
NAME = r"^\p{Lu}"


def cleaned(text: Column) -> Column:
    """Words without punctuation at their ends; those of punctuation only are left out."""
    return F.array_remove(F.transform(words_of(text), lambda w: F.btrim(w, F.lit(EDGES))), "")


def template(words: Column) -> Column:
    """Each word in lower case, or <num>, <unit> after a number, or <name> for a capitalised word that is no stop word."""
    typed = F.transform(words, lambda w: F.when(w.rlike(NUMBER), F.lit("<num>")).when(w.rlike(NAME) & ~F.lower(w).isin(STOP_WORDS), F.lit("<name>")).otherwise(F.lower(w)))
    return let(typed, lambda t: F.transform(t, lambda x, i: F.when((F.get(t, i - 1) == "<num>") & x.isin(UNITS), F.lit("<unit>")).otherwise(x)))


def window_hashes(templates: Column) -> Column:
    """A hash of each window of WORDS template words, in order; none for shorter texts."""

    def merge(a: Column, b: Column, by: int, n: Column) -> Column:
        return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))

    def windows(h1: Column) -> Column:
        n = F.size(h1)
        return let(merge(h1, h1, 1, n - 1), lambda h2: let(merge(h2, h2, 2, n - 3), lambda h4: merge(h4, h1, 4, n - 4)))

    return let(F.transform(templates, lambda t: F.xxhash64(t)), lambda h1: F.when(F.size(h1) < WORDS, F.array().cast("array<bigint>")).otherwise(windows(h1)))


def folded(words: Column) -> Column:
    """Each word in lower case; ß as ss, its upper case."""
    return F.transform(words, lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))


def literal_windows(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, n_windows) of the unlike windows of plain words."""
    hashes = F.array_distinct(window_hashes(folded(cleaned(F.col("text").cast("string")))))
    rows = benchmark.where("item_id is not null").select("item_id", F.explode_outer(hashes).alias("h")).where("h is not null").distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n_windows")), "item_id").select("h", "item_id", "n_windows")


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _reached(docs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """(d, alt, item_id, by, n_windows, n_matched): which of docs(d, alt, text) hold `similarity` of the windows of an item of
    keys(h, item_id, by, n_windows).

    One pass over the texts finds which known windows each document has. Such a document has one at least of any n - need + 1
    of an item's n windows, so only the rarest of these, by the documents that have them, name candidates; a window that is in every document or
    item names none unless the item has nothing rarer. Candidates are then counted in full.
    """
    # Most texts have no ß, and need no second look at each word.
    plain = lambda w: F.when(F.col("text").rlike("[ßẞ]"), folded(w)).otherwise(F.transform(w, lambda x: F.lower(x)))
    both = let(cleaned(F.col("text")), lambda w: F.concat(window_hashes(template(w)), window_hashes(plain(w))))
    hashes = docs.select("d", "alt", F.explode_outer(both).alias("h"))
    held = cut(hashes.join(_small(keys.select("h").distinct()), "h", "left_semi").distinct())
    seen = held.groupBy("h").agg(F.count("*").alias("n_docs"))
    order = W.partitionBy("item_id", "by").orderBy("n_docs", "h")
    need = F.ceil(similarity * F.col("n_windows"))
    rare = keys.join(seen, "h").withColumn("unseen", F.col("n_windows") - F.count("*").over(W.partitionBy("item_id", "by"))).withColumn("r", F.row_number().over(order))
    rare = rare.where(F.col("r") + F.col("unseen") <= F.col("n_windows") - need + 1).select("h", "item_id", "by")
    pairs = held.join(_small(rare), "h").select("d", "alt", "item_id", "by").distinct()
    asked = pairs.join(keys, ["item_id", "by"]).join(held, ["d", "alt", "h"], "left_semi")
    return asked.groupBy("d", "alt", "item_id", "by", "n_windows").agg(F.count("*").alias("n_matched")).where(F.col("n_matched") >= similarity * F.col("n_windows"))


def _windows(rows: DataFrame, *key: str) -> DataFrame:
    """(key, pos, h, slots): slots holds the lower-cased words behind the placeholders of a window, by place."""

    def windows(w: Column, t: Column, hs: Column) -> Column:
        def held(i: Column) -> Column:
            return F.zip_with(F.slice(t, i + 1, WORDS), F.slice(w, i + 1, WORDS), lambda x, y: F.when(x.isin("<num>", "<unit>", "<name>"), F.lower(y)))

        return F.transform(hs, lambda h, i: F.struct(i.alias("pos"), h.alias("h"), held(i).alias("slots")))

    whole = let(cleaned(F.col("text").cast("string")), lambda w: let(template(w), lambda t: let(window_hashes(t), lambda hs: windows(w, t, hs))))
    # Outer, as Spark would else work the windows out a second time to leave out empty arrays.
    return rows.select(*key, F.explode_outer(whole).alias("x")).where("x is not null").select(*key, "x.*")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, q, h, slots, n_windows) of the windows with LITERALS words at least; n_windows counts unlike ones."""
    rows = _windows(benchmark.where("item_id is not null"), "item_id").where(F.size(F.filter("slots", lambda s: s.isNull())) >= LITERALS)
    counts = rows.groupBy("item_id").agg(F.count_distinct("h").alias("n_windows"))
    return rows.withColumnRenamed("pos", "q").join(counts, "item_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, alt, text, rest): alt is 0 and d the doc_id, or else d is 0 and alt a hash of the text, which no id names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.when(unnamed, F.xxhash64(text).bitwiseOR(F.lit(1))).otherwise(0).alias("alt"), text.alias("text"))


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """contaminated() with d and alt for the doc_id."""
    items = cut(benchmark_windows(benchmark))
    template_keys = items.select("h", "item_id", "n_windows").distinct().withColumn("by", F.lit("template"))
    keys = cut(template_keys.unionByName(literal_windows(benchmark).withColumn("by", F.lit("plain"))))
    docs = _keyed(docs)
    reached = cut(_reached(docs, keys, similarity))
    pairs = reached.where("by = 'template'").select("d", "alt", "item_id")
    asked = pairs.join(items, "item_id")
    candidates = _small(pairs.select("d", "alt").distinct())
    found = _windows(docs.join(candidates, ["d", "alt"], "left_semi"), "d", "alt").withColumnRenamed("slots", "held").join(asked, ["d", "alt", "h"]).withColumn("diagonal", F.col("pos") - F.col("q"))
    group = ["d", "alt", "item_id", "diagonal"]
    slots = F.filter(F.arrays_zip(F.col("slots").alias("slots"), F.col("held").alias("held")), lambda p: p["slots"].isNotNull())
    images = found.select(*group, F.explode_outer(F.array_distinct(slots)).alias("p")).where("p is not null").select(*group, "p.*").distinct()
    odd = images.groupBy(*group, "slots").agg(F.collect_set("held").alias("images")).where(F.size("images") > 1)
    odd = odd.groupBy(group).agg(F.collect_set("slots").alias("values"), F.array_distinct(F.flatten(F.collect_list("images"))).alias("images"))
    bad = F.exists(slots, lambda p: (p["slots"] != p["held"]) & F.array_contains("images", p["held"]))
    same = F.forall(slots, lambda p: p["slots"] == p["held"])
    torn = F.exists(slots, lambda p: F.array_contains("values", p["slots"]))
    matched = found.join(odd, group, "left").where(F.col("values").isNull() | same | ~(bad | torn)).groupBy("d", "alt", "item_id", "n_windows").agg(F.count_distinct("h").alias("n_matched"))
    matched = matched.where(F.col("n_matched") >= similarity * F.col("n_windows")).withColumn("by", F.lit("template")).unionByName(reached.where("by = 'plain'"))
    best = matched.groupBy("d", "alt", "item_id").agg(F.max_by(F.struct("n_matched", "n_windows"), "by").alias("best"))
    return best.select("d", "alt", "item_id", "best.*", (F.col("best.n_matched") / F.col("best.n_windows")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, similarity): documents that hold a benchmark text, in any case, or a re-parameterised one.

    Texts become templates of typed placeholders; windows of five template words of docs(doc_id, text, ...) are
    hash-joined to those of benchmark(item_id, text, ...). Matches on one diagonal (one copy of the item) count if
    their slots are literally equal, or else if each value of the item stands for one value of the document all over
    the diagonal. Where one stands for several, only the windows with it or with one of these several values are lost;
    two values of the item may become equal. A pair is returned if `similarity` of the item's unlike windows are matched by such diagonals, or else if
    as many of its unlike windows of plain words are found whatever their case, as a text in other case gets other
    placeholders; the counts are those of the templates where these suffice. Null texts are empty; texts under five
    words match nothing, and items without a window of two literal words only as plain words; very long texts are
    looked at whole. Rows of one doc_id are judged together; rows without one each by their own text, with a null doc_id in the
    result; items without an id are left out; empty tables give no rows; other columns are ignored.

    The first pass reads each text once and shuffles known windows only; the second looks at candidate documents alone.
    """
    found = _found(docs, benchmark, similarity)
    return found.select(F.when(F.col("alt") == 0, F.col("d")).alias("doc_id"), "item_id", "n_matched", "n_windows", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark text, rows without a doc_id too."""
    gone = _found(docs, benchmark, SIMILARITY).select("d", "alt").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alt = F.when(F.col("doc_id").isNull(), F.xxhash64(text).bitwiseOR(F.lit(1))).otherwise(0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), alt.alias("alt"))
    return rows.join(gone, ["d", "alt"], "left_anti").select("row.*")
