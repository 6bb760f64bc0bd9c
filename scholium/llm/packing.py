"""Best-fit packing of documents into fixed-size bins under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import words_of

#: Words of a bin, an end mark for each document included; rows that one task packs together on average.
CAPACITY, SHARD = 1024, 8192


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size <= capacity, source, cluster), in the order given.

    Open bins are ordered by what room they have left, and carry a bitmap of their sources and one of their
    duplicate clusters. The search starts at the tightest bin that has room and goes on to its successors until
    one shares no bit with the item; of bins with equal room the oldest comes first. None puts no bit.
    """
    clusters = Counter(c for _, _, c in items if c is not None)
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    open_bins: list[tuple[int, int]] = []
    sources: list[int] = []
    twins: list[int] = []
    placed = []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster is not None and clusters[cluster] > 1 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & s or twins[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            room, k = open_bins.pop(at)
        else:
            room, k = capacity, len(sources)
            sources.append(0), twins.append(0)
        sources[k] |= s
        twins[k] |= c
        placed.append((k, capacity - room))
        if room > size:
            insort(open_bins, (room - size, k))
    return placed


def _packer(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, size, source, cluster, doc_id, piece) sorted by shard -> placed rows."""

        def out(rows):
            places = best_fit([r[1:4] for r in rows], capacity)
            shard, size, _, _, doc, piece = zip(*rows)
            bins, offsets = zip(*places)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array([(s << 24) + b for s, b in zip(shard, bins)], pa.int64()), pa.array(offsets, pa.int32()), pa.array(size, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "bin_id", "bin_offset", "size"])

        rows: list = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[0] != rows[-1][0]:
                    yield out(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield out(rows)

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: F.Column | None = None) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, size): where each piece of each row of docs(doc_id, text, source, ...) lies.

    A document takes its words and an end mark; longer ones are cut into pieces of `capacity`, the last being
    shorter. No bin holds two pieces of one source or of one duplicate cluster (default: equal words after A-Z are
    lower-cased), which pieces of one document are too. Rows are dealt by a hash of doc_id and piece to shards of
    bounded size, each packed largest first, so one hot source or cluster spreads over all shards and the result
    does not depend on the number of executors. A null text takes an end mark only; a null source conflicts with
    none; repeated rows are packed as often as they occur; no rows give no rows; other columns are ignored. Only
    ids, sizes and hashes are shuffled.
    """
    words = words_of(F.col("text").cast("string"))
    if cluster is None:
        cluster = F.xxhash64(F.translate(F.array_join(words, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    shards = max(1, -(-docs.count() // shard))
    sized = docs.select(F.col("doc_id").cast("long"), (F.size(words) + 1).alias("total"), F.col("source").cast("string"), cluster.alias("cluster"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / capacity).cast("int"))))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    n = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.repartition(n, "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "piece", "cluster")
    return dealt.select("shard", "size", "source", "cluster", "doc_id", "piece").mapInArrow(_packer(capacity), "doc_id long, piece int, bin_id long, bin_offset int, size int")
