"""Keyed tables: upserts, gets, pages, deletes and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.functions.expressions import index_partition, lookup_partition


def keyed_upsert(old: DataFrame, new: DataFrame, *keys: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of both, a key's row from `new` if it has one; of several new rows the last by `order`, then by a hash."""
    def held(rows: DataFrame, batch: int) -> DataFrame:
        ties = F.xxhash64(*(F.col(c) for c in rows.columns))  # rows that `order` doesn't tell apart, by a hash of all columns
        return rows.select(F.struct(*old.columns).alias("row"), F.struct(F.lit(batch), *(F.col(c) for c in order), ties).alias("turn"))

    both = held(old, 0).union(held(new, 1))
    return both.groupBy(*(F.col("row").getField(k) for k in keys)).agg(F.max_by("row", "turn").alias("row")).select("row.*")


def insert_new_keys(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old, with the rows of `new` whose keys it does not have."""
    return old.unionByName(new.join(old, list(keys), "left_anti"))


def get_object(table: DataFrame, **key: object) -> DataFrame:
    """Rows by key; the comparison reaches the Parquet scan."""
    made = table
    for name, value in key.items():
        made = made.where(F.col(name) == value)
    return made


def get_years(table: DataFrame, cycles: Sequence[int], **key: object) -> DataFrame:
    """Rows of one key over several cycles; cycles without a row are left out."""
    return get_object(table, **key).where(F.col("cycle").isin(*cycles))


def save(table: DataFrame, folder: str, *by: str) -> None:
    """Write a table by the columns `by`; only the folders of its own values are replaced, so a rerun changes nothing."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def load(spark: SparkSession, folder: str, schema: StructType, **key: object) -> DataFrame:
    """A saved table, or the folders of a key."""
    return get_object(spark.read.schema(schema).parquet(folder), **key)


def append_log(rows: DataFrame, folder: str, batch: int) -> None:
    """Add a batch of rows to a log; a batch that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def batch_get(table: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Found rows, and the asked ids that are missing."""
    asked = ids.select(key).distinct()
    return table.join(asked, key, "left_semi"), asked.join(table, key, "left_anti")


def keyset_page(table: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next `size` rows in key order, after a key."""
    rows = table if after is None else table.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def next_key(page: DataFrame, key: str, size: int) -> DataFrame:
    """One row: the key to go on after, empty after the last page."""
    return page.agg(F.when(F.count("*") == size, F.max(key)).otherwise("").alias("next_key"))


def read_defaults(table: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return table.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", value).otherwise(F.col(c)) for c, value in defaults.items()})


def without(table: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet the condition; rows for which it is unknown stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def serving_rows(table: DataFrame, partition: Column, sort: str) -> DataFrame:
    """Rows with their serving keys pk and sk, in ranges of both, so that a partition key with many rows fills several."""
    made = table.withColumns({"pk": F.when(F.coalesce(partition, F.lit("")) == "", "???").otherwise(partition), "sk": F.col(sort).cast("string")})
    return made.repartitionByRange("pk", "sk").sortWithinPartitions("pk", "sk")


def write_serving(rows: DataFrame, path: str) -> None:
    """One folder a partition key; a rerun replaces what it wrote."""
    rows.write.mode("overwrite").partitionBy("pk").parquet(path)


def export_index(shards: DataFrame) -> DataFrame:
    """(pk, sk, ...): shards under their first letter and number."""
    return shards.withColumns({"pk": F.concat_ws(".", index_partition(F.col("term")), F.col("shard").cast("string")), "sk": F.col("term")})


def export_lookup(lookup: DataFrame) -> DataFrame:
    return lookup.withColumns({"pk": lookup_partition(F.col("id")), "sk": F.col("id")})


def ranked_individuals(table: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """Rows of individuals on any ranking list."""
    ids = ranks.where("bucket = 'individuals'").select(F.col("entity_id").alias(key)).distinct()
    return table.join(ids, key, "left_semi")


def bucket_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("bucket").agg(F.count("*").alias("keys"))
