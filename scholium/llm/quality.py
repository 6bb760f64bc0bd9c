"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by not but what all were we when your can said there an which their if "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou "
    "que el y los las se con no una su para es al lo como mas o pero sus le ha me si sin sobre este ya entre"
).split()

#: name, numerator, denominator, least, most: a text is kept if every ratio lies within its bounds.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 1.5, 15.0),
    ("symbols_per_word", "n_symbols", "n_words", 0.0, 0.25),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.05, 1.0),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.50),
    ("words_per_line", "n_words", "n_lines", 2.5, 1e9),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more. Windows are compared by 64-bit hashes of hashes
    of 1, 2, 4 and 8 words; only texts with a repeated window are sorted."""

    def merge(hashes: Column, by: int) -> Column:
        return F.zip_with(F.slice(hashes, 1, F.size(hashes) - by), F.slice(hashes, by + 1, F.size(hashes) - by), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))), F.lit(0), lambda a, b: a + b))

    once = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: let(merge(h1, 1), lambda h2: let(merge(h2, 2), lambda h4: let(merge(h4, 4), lambda h8: F.when(F.size(F.array_distinct(h8)) == F.size(h8), 0).otherwise(covered(h8))))),
    )
    return F.when(n < WINDOW, 0).otherwise(once)


def measure(text: Column) -> Column:
    """A struct of the counts of one text; null counts as the empty text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        n = F.size(w)
        return let(
            lines,
            lambda ls: F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeated(w, n).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words_of(text), counted)


def judge(text: Column, rules=RULES) -> Column:
    """measure(text) with base_failed and kept."""

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        within = F.lit(True)
        for _, over, under, least, most in rules:
            within = within & (m[over] >= least * m[under]) & (m[over] <= most * m[under])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
        return F.struct(*(m[x].alias(x) for x in names), failed.alias("base_failed"), (~failed & within).alias("kept"))

    return let(measure(text), verdict)


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id and the fields of judge(text).

    A null or empty text has no words and fails the base rule; very long texts are judged whole; repeated rows are
    judged alike; no rows give no rows; other columns are ignored. A ratio with denominator zero is within its bounds only if its numerator
    is zero too, which the base rule precludes. One projection, no shuffle and no user function.
    """
    return docs.select("doc_id", judge(F.col("text").cast("string"), rules).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs whose text is kept, in one scan."""
    return docs.where(judge(docs["text"], rules)["kept"])
