"""Near duplicates by exact Jaccard similarity of word shingles, with MinHash bands as candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, discard, spill
from scholium.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 share one band of ROWS equal minima but for (1 - 0.8 ** ROWS) ** BANDS, 7 in 100,000.
BANDS, ROWS = 24, 5
#: Classes that one task compares of one band; a band with more is split around some of them.
BLOCK, PIVOTS = 512, 8
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted unlike hashes of the five-word shingles of text, or of all its words if they are fewer."""
    words = text.lower().split()
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(5)), dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            x = found[at : at + 1024, None] * _MUL + _ADD
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [shingles(t.as_py() or b"") for t in part.column(1).cast(pa.binary())]
            keys = [np.array(bands(x), dtype=np.uint64).view(np.int64).tolist() for x in sets]
            columns = [part.column(0), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            raw = [shingles(t.as_py() or b"").tobytes() for t in batch.slice(at, 64).column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["digest", "shingles"])


def _forest(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join every similar pair of a bucket; pairs that are joined already are not compared."""
    groups: list[list[int]] = []
    links = []
    for i in range(len(ids)):
        joined, apart = [i], []
        for group in groups:
            hit = next((j for j in group if similar(sets[i], sets[j])), None)
            if hit is None:
                apart.append(group)
            else:
                links.append((ids[i], ids[hit]))
                joined = group + joined
        groups = [*apart, joined]
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, rep, shingles) sorted by band -> links (a, b) of similar texts of a band."""
    band, ids, sets = None, [], []

    def solved() -> pa.RecordBatch:
        return _batch(_forest(ids, sets))

    for batch in batches:
        for k, rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k != band and ids:
                yield solved()
                ids, sets = [], []
            band = k
            ids.append(rep)
            sets.append(np.frombuffer(raw, dtype=np.uint64))
    if ids:
        yield solved()


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, rep, shingles, pivots) -> (band, rep, shingles, reps of the similar pivots)."""
    known: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            near = []
            for band, raw, pivots in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if band not in known:
                    known = {band: [(p["rep"], np.frombuffer(p["shingles"], dtype=np.uint64)) for p in pivots]}
                own = np.frombuffer(raw, dtype=np.uint64)
                near.append([rep for rep, p in known[band] if similar(own, p)])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(near, pa.list_(pa.int64()))], ["band", "rep", "shingles", "near"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, odd, rep, shingles) sorted by cell, the odd ones first -> a forest of links of odd ones to others."""
    cell, odd, rest = None, [], []

    def solved() -> pa.RecordBatch:
        root = {k: k for k, _ in [*odd, *rest]}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for a, x in odd:
            for b, y in rest:
                if a != b and find(a) != find(b) and similar(x, y):
                    root[find(a)] = find(b)
                    links.append((a, b))
        return _batch(links)

    for batch in batches:
        for *own, is_odd, rep, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if own != cell and odd:
                yield solved()
            if own != cell:
                cell, odd, rest = own, [], []
            (odd if is_odd else rest).append((rep, np.frombuffer(raw, dtype=np.uint64)))
    if odd:
        yield solved()


def _hot_links(rows: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that join every similar pair of rows(band, rep, shingles), for bands too large for one task.

    PIVOTS classes of each band are compared with all others of it, a row at a time. The pivot that most are similar to links these;
    all that are not similar to it are odd, and every odd one is compared with every other of its band, in cells of two blocks of about `block` classes. A band of near
    copies has few odd ones, so this grows with the band and not with its square; the comparisons are exact and complete in any case.
    """
    pick = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "shingles")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = cut(rows.groupBy("band").agg(F.count("*").alias("n"), *pick).select("band", "n", F.array_distinct(F.array(*(F.struct(F.col(f"p{k}.rep").alias("rep"), F.col(f"p{k}.shingles").alias("shingles")) for k in range(PIVOTS)))).alias("pivots")))
    seen = spill(rows.join(chosen.select("band", "pivots"), "band").select("band", "rep", "shingles", "pivots").mapInArrow(_near_pivots, "band long, rep long, shingles binary, near array<long>"))
    links = seen.select(F.col("rep").alias("a"), F.explode("near").alias("b")).where("a <> b")
    votes = seen.select("band", F.explode("near").alias("best")).groupBy("band", "best").agg(F.count("*").alias("c"))
    best = votes.groupBy("band").agg(F.max(F.struct("c", (-F.col("best")).alias("best"))).alias("v")).select("band", (-F.col("v.best")).alias("best"), "v.c")
    few = best.join(chosen.select("band", "n"), "band").where("c < n").select("band", "best", "n", (F.col("n") - F.col("c")).alias("n_odd"))  # a row for each band
    dealt = spill(seen.join(few, "band").select("band", "rep", "shingles", "n", "n_odd", (~F.array_contains("near", F.col("best"))).alias("odd")))
    blocks, odd_blocks = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("n_odd") / block).cast("int")
    place = lambda k, of: F.pmod(F.xxhash64("rep", F.lit(k)), of).cast("int")
    every = dealt.select("band", place(101, blocks).alias("i"), F.explode(F.sequence(F.lit(0), odd_blocks - 1)).alias("j"), F.lit(False).alias("odd"), "rep", "shingles")
    others = dealt.where("odd").select("band", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), place(102, odd_blocks).alias("j"), F.lit(True).alias("odd"), "rep", "shingles")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = every.unionByName(others).repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", F.desc("odd"))
    return links.unionAll(cells.select("band", "i", "j", "odd", "rep", "shingles").mapInArrow(_across, "a long, b long"))


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of docs(doc_id, text, ...), linked at a Jaccard similarity of SIMILARITY of their sets of
    five-word shingles, A-Z in lower case; component_id is the smallest doc_id reachable.

    Candidates share a band of minima; every link is checked exactly. Texts of equal sets are one class, and bands
    that hold the same classes are looked at once. A null or blank text has the one empty shingle; texts of fewer than five words
    have one of all their words; very long texts are cut whole; rows that repeat an id are linked through it; rows without a doc_id are left
    out; no rows give no rows; other columns are ignored. The classes of a band meet in one task if they are no more than `block`, and are split
    otherwise (see _hot_links); either gives a forest of their links, never their pairs.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    rows = spill(texts.mapInArrow(_digested, "doc_id long, digest binary, bands array<long>"))
    classes = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    named = rows.join(classes, "digest").where("doc_id = rep")
    keys = cut(named.select("rep", "digest", F.explode("bands").alias("band")).distinct())
    full = keys.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("members")).where("n > 1")
    once = full.groupBy("n", "members").agg(F.min("band").alias("band")).select("band", (F.col("n") > block).alias("hot"))
    met = cut(keys.join(once, "band"))
    sets = texts.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets, "digest binary, shingles binary").dropDuplicates(["digest"])
    met = spill(met.join(sets, "digest").select("band", "hot", "rep", "shingles"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = met.where("not hot").select("band", "rep", "shingles").repartition(n, "band").sortWithinPartitions("band").mapInArrow(_linked, "a long, b long")
    hot = met.where("hot").select("band", "rep", "shingles")
    if not hot.isEmpty():
        links = links.unionAll(_hot_links(hot, block))
    found = connected_components(links)
    discard(met)
    whole = classes.join(found, classes.rep == found.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(whole, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose doc_id names their component; of rows that repeat one doc_id a single one stays, and rows
    without a doc_id stay. others(doc_id, component_id) are components by another method: both methods' links count, together."""
    found = cut(near_components(docs))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    if others is not None:
        links = found.select("doc_id", "component_id").unionAll(others.select("doc_id", "component_id")).where("doc_id <> component_id")
        gone = connected_components(links.toDF("a", "b")).where("node <> component").select(F.col("node").alias("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionAll(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
