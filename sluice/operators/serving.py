"""Serving tables: rows stored under a partition key and a sort key, read by key and written again only where they change.

Rows lie in folders by a hash of the partition key, each file sorted by both keys and with a bloom filter of the partition key. A
comparison with a key becomes a folder and a filter of the scan, so a read touches one folder and, in it, the files and row
groups that can hold the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sluice.operators.tables import keyed_upsert
from sluice.sources.shared import exists, remove, written

PARTS = 32


class ServingTable:
    """A table of a schema under (pk, sk) columns; `sk` may be empty where pk alone is the key."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, pk: str, sk: Sequence[str] = (), parts: int = PARTS):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.pk, self.sk, self.parts = pk, list(sk), parts
        self._finish()

    @property
    def keys(self) -> list[str]:
        return [self.pk, *self.sk]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("part", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], schema)

    @property
    def rows(self) -> DataFrame:
        return self._stored().drop("part")

    def write(self, rows: DataFrame) -> ServingTable:
        """Store rows; the folders of their keys are replaced, all others stay."""
        return self._save(self._dealt(rows.select(*self.schema.names)))

    def write_sums(self, rows: DataFrame, *sums: Column) -> ServingTable:
        """Store one row a key, with sums over all of its rows. Rows are dealt over the ranges in which they are stored before they
        are added up, so that they are shuffled once; for keys of few rows each."""
        return self._save(self._dealt(rows).groupBy("part", *self.keys).agg(*sums).select(*self.schema.names, "part"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", self._part(F.col(self.pk))).repartitionByRange("part", *self.keys)

    def _save(self, dealt: DataFrame) -> ServingTable:
        made = dealt.sortWithinPartitions("part", *self.keys)
        writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{self.pk}", "true")
        writer.partitionBy("part").parquet(self.folder)
        return self

    def get(self, pk: str, **sk: object) -> DataFrame:
        """Rows of one partition key; of sort keys one value or a list of them."""
        rows = self._stored().where((F.col("part") == self._part(F.lit(pk))) & (F.col(self.pk) == pk))
        for name, value in sk.items():
            rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
        return rows.drop("part")

    def get_many(self, ids: DataFrame) -> DataFrame:
        """Rows of a table of partition keys (of the key's name); folders without any are not read."""
        asked = ids.select(self.pk).distinct()
        return self._of_parts(asked).join(asked, self.pk, "left_semi").drop("part")

    def _of_parts(self, rows: DataFrame) -> DataFrame:
        parts = [r["p"] for r in rows.select(self._part(F.col(self.pk)).alias("p")).distinct().collect()]  # self.parts at most
        return self._stored().where(F.col("part").isin(parts))

    def upsert(self, new: DataFrame, order: Sequence[str] = ()) -> None:
        """Rows of `new` in the place of those with the same keys; of several new rows of a key the last by `order`, then by a hash.

        Rows that are stored as they are change nothing, and only folders with a change are written: they are read, merged in the
        shared folder and then replaced.
        """
        one = written(keyed_upsert(new.limit(0), new, *self.keys, order=order).select(*self.schema.names), "upsert")
        old = self._of_parts(one).select(*(F.col(c).alias(f"old_{c}") for c in self.schema.names))
        alike = [one[c].eqNullSafe(old[f"old_{c}"]) for c in self.schema.names]
        fresh = written(one.join(old, alike, "left_anti"), "fresh")
        if not fresh.isEmpty():
            self._put(keyed_upsert(self._of_parts(fresh).drop("part"), fresh, *self.keys))

    def insert_new(self, new: DataFrame, order: Sequence[str] = ()) -> None:
        """Rows of keys that are not stored; of several the first by `order`. What is stored stays as it is."""
        ties = F.struct(*(F.col(c) for c in order), F.xxhash64(*(F.col(c) for c in self.schema.names)))
        first = new.groupBy(*self.keys).agg(F.min_by(F.struct(*self.schema.names), ties).alias("row")).select("row.*")
        first = written(first, "insert")
        fresh = written(first.join(self._of_parts(first).select(*self.keys), self.keys, "left_anti"), "fresh")
        if not fresh.isEmpty():
            self._put(self._of_parts(fresh).drop("part").unionByName(fresh))

    def _put(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/_pending")
        self._finish()

    def _finish(self) -> None:
        """Put folders that are ready in their places. A driver that died meanwhile leaves it to whoever opens the table next."""
        path = f"{self.folder}/_pending"
        if exists(self.spark, f"{path}/_SUCCESS"):
            self.write(self.spark.read.schema(self.schema).parquet(path))
        if exists(self.spark, path):
            remove(self.spark, path)
