"""Token sequences in training order, as fixed-stride binary shards."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import discard, spill, with_cleanup

#: Tokens of a sequence; sequences of a shard.
LENGTH, SHARD = 1024, 65_536
#: Bytes of a record before its token ids: slot (8), doc_id (8), number of the sequence (4) and of its tokens (4), big-endian; the
#: last number's highest bit marks a null doc_id. A line feed ends each record.
HEAD, TAIL = 24, 1
NO_DOC = 1 << 31
ROUNDS = 6
#: Writes that the shards are dealt to, so that the shuffle files of one can go before the next.
WAVES = 8


def stride(length: int = LENGTH) -> int:
    return HEAD + 2 * length + TAIL


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n): ROUNDS keyed rounds over the least even number of bits that holds n, walked on
    from each value outside the range until it is inside."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
            left, right = right, left ^ (_mix(right ^ salt) & mask)
        out[todo] = (left << shift) | right
        todo[todo] = out[todo] >= np.uint64(n)
    return out.astype(np.int64)


def byte_bpe(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE whose lines of ranks are a base64 token and its id."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def sequences(docs: DataFrame, ranks: bytes, pattern: str, end: int, length: int = LENGTH, key: int = 20240229) -> DataFrame:
    """(slot, doc_id, seq, n_tokens, ids): the sequences of docs(doc_id, text, ...), each at its global slot.

    The token ids of a text (two little-endian bytes each) and the end id are cut into sequences of `length`; the
    last may be shorter. Numbered by doc_id, of equal ids by a hash of the text, and seq, they go to slots 0, 1, ... without gaps by a keyed Feistel
    permutation, so the order depends on the key and the rows alone. Null and empty texts give the end id only; a
    null doc_id comes first; repeated rows have sequences each; very long texts have as many sequences as they need; no
    rows give no rows; other columns are ignored.

    Texts are dealt by ranges of doc_id once, so that the order of partitions and rows is the numbering; token ids are
    then written, and only a count for each partition reaches the driver. Slots are worked out from a row's place
    alone, without a join.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast((ranks, pattern))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*bpe.encode_ordinary(text or ""), end], dtype="<u2")
                    for seq in range(0, len(ids), length):
                        piece = ids[seq : seq + length]
                        for c, v in zip(out, (doc, seq // length, len(piece), piece.tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "seq", "n_tokens", "ids"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    # Null ids lie in one range; a hash of the text spreads them, as it does rows that repeat an id. Rows alike in both
    # may stand in any order, so their own number spreads them too.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    rows = dealt.mapInArrow(encoded, "doc_id long, seq int, n_tokens int, ids binary")
    rows = spill(rows.withColumn("at", F.monotonically_increasing_id()))  # partition << 33 | row
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(counts):
        base[p], total = total, total + counts[p]

    @F.pandas_udf("long")
    def slot(at: pd.Series) -> pd.Series:
        place = at.to_numpy()
        first = np.array([base[p] for p in (place >> 33).tolist()], dtype=np.int64)
        return pd.Series(feistel(first + (place & (1 << 33) - 1), total, key))

    placed = rows.select(slot("at").alias("slot"), "doc_id", "seq", "n_tokens", "ids")
    placed.made_of = rows
    return placed


def records(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(slot, record) of sequences(): head, token ids padded with zeros to one stride, and a line feed."""

    def big(x: Column, size: int) -> Column:
        return F.lpad(F.right(F.hex(x), F.lit(2 * size)), 2 * size, "0")

    count = F.col("n_tokens").cast("long") + F.when(F.col("doc_id").isNull(), NO_DOC).otherwise(0)
    head = F.unhex(F.concat(big(F.col("slot"), 8), big(F.coalesce("doc_id", F.lit(0)), 8), big(F.col("seq").cast("long"), 4), big(count, 4)))
    return found.select("slot", F.concat(head, F.rpad("ids", 2 * length, F.lit(b"\0")), F.lit(b"\n")).alias("record"))


def write_shards(found: DataFrame, path: str, length: int = LENGTH, shard: int = SHARD, waves: int = WAVES, spent: DataFrame | None = None) -> None:
    """Writes one file a shard below path/shard=N, by Spark's own committer: a lost task is written anew, whole files
    only appear. Slot s lies at stride * (s mod shard) of shard s div shard.

    Each shard is one range of slots, sorted in one task. The sequences are first written by waves of shards; then each
    wave is read, shuffled and written, and its part and its shuffle files go before the next, so the disk holds the sequences
    once more than the shards at most. A write that is interrupted as a whole begins anew, in another folder. spent is a table of spill() that
    found reads; it goes as soon as the waves are written.
    """
    spark = found.sparkSession
    n = -(-found.count() // shard)
    if not n:
        return
    each = -(-n // waves)
    parts = min(each, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.floor(F.col("slot") / shard)
    by_wave = spill(found.select("slot", "doc_id", "seq", "n_tokens", "ids", F.floor(number / each).alias("wave")), "wave")
    if spent is not None:
        discard(spent)
    for wave in range(-(-n // each)):
        rows = records(by_wave.where(F.col("wave") == wave), length).select(number.alias("shard"), "slot", F.substring("record", 1, stride(length) - TAIL).cast("string").alias("value"))
        dealt = rows.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "slot")
        with_cleanup(spark, lambda dealt=dealt: dealt.select("value", "shard").write.mode("append").partitionBy("shard").option("lineSep", "\n").text(path))
        discard(by_wave, f"wave={wave}")
    discard(by_wave)


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(shard, slot, byte_offset, doc_id, seq, n_tokens, record) of the files below path, in record-sized steps: a file may be
    of any size and is read by several tasks, each from a multiple of the stride on.

    shard is the file's folder, the rest is what each record's head says; byte_offset is the place of its slot in that file.
    """
    sc = spark.sparkContext
    raw = sc._jsc.sc().binaryRecords(f"{path}/shard=*/part-*", stride(length), sc._jsc.hadoopConfiguration())
    kind = sc._jvm.org.apache.spark.sql.Encoders.BINARY()
    rows = DataFrame(spark._jsparkSession.createDataset(raw, kind).toDF(), spark).toDF("record")

    def number(at: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("record", at + 1, size)), 16, -10).cast("long")

    rows = rows.select(F.regexp_extract(F.input_file_name(), r"shard=(\d+)/[^/]*$", 1).cast("long").alias("shard"), "record", number(0, 8).alias("slot"), number(8, 8).alias("doc"), number(16, 4).cast("int").alias("seq"), number(20, 4).alias("count"))
    return rows.select(
        "shard", "slot", ((F.col("slot") - F.col("shard") * shard) * stride(length)).alias("byte_offset"), F.when(F.col("count") < NO_DOC, F.col("doc")).alias("doc_id"), "seq",
        (F.col("count") % NO_DOC).cast("int").alias("n_tokens"), "record",
    )


def read_shard(data: bytes, length: int = LENGTH, start: int = 0) -> Iterator[np.ndarray]:
    """The token ids of each record of a shard file from its start-th record on."""
    for at in range(start * stride(length), len(data), stride(length)):
        n = int.from_bytes(data[at + HEAD - 4 : at + HEAD]) % NO_DOC
        yield np.frombuffer(data, dtype="<u2", count=n, offset=at + HEAD)
