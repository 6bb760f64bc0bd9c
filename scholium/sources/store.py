"""A stored table with one row a key, which loads add to or replace in; a load is seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.studies import keep_first, keep_last

BUCKETS = 32


class Store:
    """Rows in buckets by a hash of their key. Each load writes the buckets that it touches to a folder of its own, then a manifest that
    says for every bucket which folder holds it now; readers go by the last manifest. A load that is interrupted leaves a
    folder that no manifest names, and of two loads that began from the same manifest the later one fails instead of undoing the other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _file(self, name: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of the last manifest, 0 before the first load."""
        fs, path = self._file("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def places(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder, as the last or the given manifest has it."""
        version = self.version() if version is None else version
        if not version:
            return {}
        found = self.spark.read.text(f"{self.path}/manifest/{version:08d}.json", wholetext=True).first()["value"]
        return {int(b): folder for b, folder in json.loads(found).items()}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of the last or the given load."""
        return self._rows(self.places(version))

    def _rows(self, places: dict[int, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(places.items())))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int"))

    def _load(self, new: DataFrame, replace: bool) -> str | None:
        """Writes the touched buckets as they are to be; returns their folder, with the manifest that would name it left to _commit."""
        begun = self.version()
        places = self.places(begun)
        touched = sorted(r["bucket"] for r in self._bucketed(new).select("bucket").distinct().collect())  # as many as there are buckets at most
        if not touched:
            return None
        old = self._rows({b: places[b] for b in touched if b in places})
        keys = F.coalesce(F.col(self.key).cast("string"), F.lit(""))
        mine, theirs = old.withColumn("_k", keys), new.withColumn("_k", keys)
        if replace:
            mine = mine.join(theirs.select("_k"), "_k", "left_anti")
        else:
            theirs = theirs.join(mine.select("_k"), "_k", "left_anti")
        folder = uuid.uuid4().hex
        self._bucketed(mine.unionByName(theirs).drop("_k")).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._pending = (begun, places | dict.fromkeys(touched, folder))
        return folder

    def _commit(self) -> int:
        begun, places = self._pending
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        fs, aside = self._file(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        _, final = self._file(f"manifest/{begun + 1:08d}.json")
        # A rename of this kind fails if its target is there.
        nothing = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), sc._jsc.hadoopConfiguration()).rename(aside, final, nothing)
        return begun + 1

    def insert(self, rows: DataFrame, order: str = "pos") -> int:
        """Adds the first row, by `order`, of each key that the table does not have; returns the version. Null keys count as empty ones."""
        return self._put(keep_first(self._keyed(rows), ["_k"], [F.col(order)]), False)

    def replace(self, rows: DataFrame, order: str = "pos") -> int:
        """Puts the last row, by `order`, of each key in place of the table's; returns the version."""
        return self._put(keep_last(self._keyed(rows), ["_k"], [F.col(order)]), True)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.coalesce(F.col(self.key).cast("string"), F.lit("")))

    def _put(self, rows: DataFrame, replace: bool) -> int:
        return self._commit() if self._load(rows.select(*self.schema.names), replace) else self.version()
