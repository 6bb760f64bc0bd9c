"""SimHash near-duplicates by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut
from scholium.llm.components import connected_components, forest

SHINGLE = 3
ERRORS = 2
#: Bits of the prefix that a block of the trie shares exactly: with ERRORS + 1 blocks one of them has no error.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A node pair with more fingerprints is split into its child pairs, this many bits lower, before it goes to a task.
LEAF, STEP = 4096, 6
_LANE = np.arange(8, dtype=np.int64) * 256
_BITS = np.array([[byte >> bit & 1 for bit in range(8)] for byte in range(256)], dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of text, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _pairs(lo_a, hi_a, lo_b, hi_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the ranges a x b, a bounded number at a time."""
    n_a, n_b = hi_a - lo_a, hi_b - lo_b
    ends = np.cumsum(n_a * n_b)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 21), side="right")))
        own = np.repeat(np.arange(start, stop), (n_a * n_b)[start:stop])
        k = np.arange(len(own)) - (np.concatenate(([0], ends))[own] - base)
        yield lo_a[own] + k // n_b[own], lo_b[own] + k % n_b[own]
        start = stop


def trie_links(keys: np.ndarray, roots: list[tuple[int, int, int, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of keys that differ in at most ERRORS bits, below the given pairs of trie nodes.

    keys: uint64, each node being a sorted range of it. roots: (lo_a, hi_a, lo_b, hi_b, depth, differing bits so
    far); a node may be paired with itself. Both nodes of a pair step down a bit together; children on unlike
    bits cost one error, and a pair over the budget is dropped with everything below it.
    """
    stack = [tuple(np.array(x, dtype=np.int64) for x in zip(*roots))] if roots else []
    while stack:
        lo_a, hi_a, lo_b, hi_b, depth, err = stack.pop()
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= 64) | (depth >= 64)
        if small.any():
            for i, j in _pairs(lo_a[small], hi_a[small], lo_b[small], hi_b[small]):
                near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= ERRORS)
                if near.any():
                    yield i[near], j[near]
        lo_a, hi_a, lo_b, hi_b, depth, err = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, depth, err))
        for d in np.unique(depth).tolist():
            at = depth == d
            la, ha, lb, hb, e = (x[at] for x in (lo_a, hi_a, lo_b, hi_b, err))
            ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1)))).astype(np.int64)
            ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
            own = la == lb  # a node with itself: its two unlike children need to meet once only
            children = [(la, ma, lb, mb, e, np.ones(len(e), bool)), (ma, ha, mb, hb, e, np.ones(len(e), bool)), (la, ma, mb, hb, e + 1, np.ones(len(e), bool)), (ma, ha, lb, mb, e + 1, ~own)]
            level = [np.concatenate(x) for x in zip(*((a, b, c, f, g, w) for a, b, c, f, g, w in children))]
            live = level[5] & (level[4] <= ERRORS) & (level[1] > level[0]) & (level[3] > level[2])
            level = [x[live] for x in level[:5]]
            for k in range(0, len(level[0]), 1 << 18):  # depth first over bounded pieces of the frontier
                part = [x[k : k + (1 << 18)] for x in level]
                stack.append((*part[:4], np.full(len(part[0]), d + 1), part[4]))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, pa, pb, depth, perm, rep) of node pairs -> a spanning forest of their links (a, b)."""

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        block, node_a, node_b, depth, perm, rep = cols
        n = len(perm)
        edge = np.flatnonzero((block[1:] != block[:-1]) | (node_a[1:] != node_a[:-1]) | (node_b[1:] != node_b[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        keys = perm.view(np.uint64)
        roots = []
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            d = int(depth[lo])
            if node_a[lo] == node_b[lo]:
                roots.append((lo, hi, lo, hi, d, 0))
            else:
                a, b = int(node_a[lo]) & (1 << 64) - 1, int(node_b[lo]) & (1 << 64) - 1
                if keys[lo] >> np.uint64(64 - d) != keys[hi - 1] >> np.uint64(64 - d):
                    mid = lo + int(np.argmax(keys[lo:hi] >> np.uint64(64 - d) != keys[lo] >> np.uint64(64 - d)))
                    roots.append((lo, mid, mid, hi, d, (a ^ b).bit_count()))
        parent = np.arange(n)
        for i, j in trie_links(keys, roots):
            parent = forest(i, j, parent)
        linked = np.flatnonzero(parent != np.arange(n))
        if len(linked):
            return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[parent[linked]])], ["a", "b"])
        return None

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if len(held[4]) >= 1 << 16:
            same = np.ones(len(held[4]), bool)  # rows of the last, maybe unfinished, node pair
            for c in held[:4]:
                same &= c == c[-1]
            whole = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if whole:
                if (out := solve([c[:whole] for c in held])) is not None:
                    yield out
                held = [c[whole:] for c in held]
    if held is not None and len(held[4]) and (out := solve(held)) is not None:
        yield out


def _prefix(bits) -> F.Column:
    return F.expr(f"shiftrightunsigned(perm, 64 - {bits})")


def links(classes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """classes(fp, rep), fp distinct -> edges (a, b) between reps that join every pair of fingerprints with at most
    two differing bits into one component.

    Three turned copies of each fingerprint start at the trie nodes of their first block: of two linked
    fingerprints one block is equal. Node pairs over `leaf` rows step down STEP bits at a time, every fingerprint
    going to each child pair still within the error budget, until all pairs fit a task.
    """
    turned = [classes.select(F.lit(k).alias("block"), (F.expr(f"shiftleft(fp, {off}) | shiftrightunsigned(fp, {64 - off})") if off else F.col("fp")).alias("perm"), "rep").withColumn("na", _prefix(width)).withColumn("nb", F.col("na")).withColumn("depth", F.lit(width)) for k, (off, width) in enumerate(BLOCKS)]
    columns = ["block", "na", "nb", "depth", "perm", "rep"]
    rows = turned[0].unionAll(turned[1]).unionAll(turned[2]).select(columns)
    node = ["block", "na", "nb", "depth"]
    done = None
    for _ in range(64 // STEP + 1):
        hot = rows.where(F.col("depth") + STEP <= 64).groupBy(node).count().where(F.col("count") > leaf).drop("count")
        if hot.isEmpty():
            break
        hot = cut(hot)
        part = cut(rows.join(hot, node, "left_semi"))
        rest = rows.join(hot, node, "left_anti")
        done = rest if done is None else done.unionAll(rest)
        masks = F.array(*(F.lit(m) for m in sorted(range(1 << STEP), key=lambda m: (m.bit_count(), m)) if m.bit_count() <= ERRORS))
        step = part.withColumn("m", F.explode(F.filter(masks, lambda m: F.bit_count(m) + F.bit_count(F.expr("na ^ nb")) <= ERRORS)))
        step = step.withColumn("first", _prefix("depth") == F.col("na")).withColumn("own", _prefix(f"(depth + {STEP})"))
        other = F.expr(f"shiftleft(if(first, nb, na), {STEP}) | ((own & {(1 << STEP) - 1}) ^ m)")
        step = step.withColumn("other", other).withColumn("twin", F.expr("na = nb"))
        rows = step.select(
            "block",
            F.expr("case when twin then least(own, other) when first then own else other end").alias("na"),
            F.expr("case when twin then greatest(own, other) when first then other else own end").alias("nb"),
            (F.col("depth") + STEP).alias("depth"), "perm", "rep",
        )
    rows = rows if done is None else done.unionAll(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *node).withColumn("order", F.expr("perm ^ (-9223372036854775807L - 1L)")).sortWithinPartitions(*node, "order")
    return dealt.select(columns).mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs(doc_id, text, ...).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a bit of the fingerprint is set if over
    half the XXH64 values (seed 42) of the 3-word shingles set it. Documents are linked at two or fewer differing
    bits; component_id is the smallest doc_id reachable. A null or blank text has fingerprint 0 and is linked like
    any other; rows that repeat stay; rows with a null doc_id are kept and link others, give no component a name, and get a null
    component only where no other id is reachable; no rows give no rows. Other columns are ignored.

    Only (doc_id, fp) pairs are shuffled, never texts; equal fingerprints are one class, named by its fingerprint, so a group of copies of
    any size costs one trie leaf. Documents are joined back with the one row of their class; a class that holds much of the table is a
    skewed join, which Spark splits. A very long text is hashed in pieces of bounded size.
    """
    fps = cut(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), leaf))
    joined = cut(classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"))
    smallest = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    named = joined.join(smallest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
