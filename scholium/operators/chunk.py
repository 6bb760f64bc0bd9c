"""Sentence-aware overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T


def _state(chunks: Column, cur: Column, start: Column, pos: Column) -> Column:
    return F.struct(chunks.alias("chunks"), cur.alias("cur"), start.alias("start"), pos.alias("pos"))


def chunk_array(text: Column, max_words: int = 400, overlap: int = 50) -> Column:
    """array<struct(text, start_char, end_char)> of the chunks of one text, none for a blank one.

    Whole sentences are gathered until the next would exceed max_words; the next chunk begins with the last
    `overlap` words if the closed one had more. A long sentence is never cut. Offsets take one character for each
    separator. overlap = 0 carries nothing over.
    """
    kind = "array<struct<text:string,start_char:int,end_char:int>>"

    def closed(s: Column) -> Column:
        joined = F.array_join(s["cur"], " ")
        return T.let(joined, lambda j: F.struct(j.alias("text"), s["start"].alias("start_char"), (s["start"] + F.length(j)).alias("end_char")))

    def step(s: Column, sentence: Column) -> Column:
        def gather(ws: Column) -> Column:
            full = (F.size(s["cur"]) + F.size(ws) > max_words) & (F.size(s["cur"]) > 0)
            carried = F.when((F.size(s["cur"]) > overlap) & F.lit(overlap > 0), F.slice(s["cur"], F.size(s["cur"]) - (overlap - 1), max(overlap, 1))).otherwise(F.array().cast("array<string>"))
            after = s["pos"] + F.length(sentence) + 1

            def flushed(kept: Column) -> Column:
                start = F.when(F.size(kept) > 0, s["pos"] - F.length(F.array_join(kept, " "))).otherwise(s["pos"])
                return _state(F.concat(s["chunks"], F.array(closed(s))), F.concat(kept, ws), start, after)

            return F.when(F.size(ws) == 0, _state(s["chunks"], s["cur"], s["start"], after)).when(full, T.let(carried, flushed)).otherwise(_state(s["chunks"], F.concat(s["cur"], ws), s["start"], after))

        return T.let(T.words(sentence), gather)

    zero = _state(F.array().cast(kind), F.array().cast("array<string>"), F.lit(0), F.lit(0))
    done = F.aggregate(T.sentences(text), zero, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["chunks"], F.array(closed(s)))).otherwise(s["chunks"]))
    return F.when(T.strip(text) == "", F.array().cast(kind)).otherwise(done)


def chunk_studies(studies: DataFrame, max_words: int = 400, overlap: int = 50, metadata: DataFrame | None = None) -> DataFrame:
    """(pos, chunk_id, study_pmid, chunk_index, text, start_char, end_char, paper_id[, study_metadata]).

    The text is `title. abstract`, or the title alone without an abstract; a blank one is one chunk as it stands.
    metadata(pmid, study_metadata map) is joined if given.
    """
    full = F.when(F.col("abstract") != "", F.concat("title", F.lit(". "), "abstract")).otherwise(F.col("title"))
    whole = lambda t: F.array(F.struct(t.alias("text"), F.lit(0).alias("start_char"), F.length(t).alias("end_char")))
    found = T.let(full, lambda t: T.let(chunk_array(t, max_words, overlap), lambda cs: F.when(F.size(cs) == 0, whole(t)).otherwise(cs)))
    # Outer, as Spark would else work the chunks out a second time to leave out empty arrays; there are none.
    rows = studies.select("pos", "pmid", F.posexplode_outer(found).alias("chunk_index", "c"))
    rows = rows.select("pos", T.chunk_id(F.col("pmid"), F.col("chunk_index")).alias("chunk_id"), F.col("pmid").alias("study_pmid"), "chunk_index", "c.text", "c.start_char", "c.end_char", F.col("pmid").alias("paper_id"))
    return rows if metadata is None else rows.join(metadata.withColumnRenamed("pmid", "study_pmid"), "study_pmid", "left")
