"""The given star-schema tables, seen as filings of money flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of committees by the remainder of their nation; the others have codes that are no states.
STATE_CODES = ("CA", "TX", "NY")
#: Cycles that the given tables cover.
LOADED_CYCLES = (1996, 1998, 2000, 2002)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _pick(remainder: Column, values: tuple[str, ...]) -> Column:
    """The value at the remainder; the last one beyond. A lookup keeps expressions made of it, and filters on them, short."""
    return F.coalesce(F.get(F.array(*map(F.lit, values)), remainder.cast("int")), F.lit(values[-1]))


def _cycle(date: str) -> Column:
    year = F.year(date)
    return (year + year % 2).cast("int")


def committees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered committees: cmte_id, name, city, state, party."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("C"), _padded(key, 8)).alias("cmte_id"), F.col("s_name").alias("name"), F.concat(F.lit("CITY "), nation).alias("city"),
        F.coalesce(F.get(F.array(*map(F.lit, STATE_CODES)), (F.col("s_nationkey") % 5).cast("int")), F.concat(F.lit("S"), nation)).alias("state"),
        _pick(key % 6, ("REP", "DEM", "NPA", "LIB", "", "UN")).alias("party"),
    )


def _candidate_id(key: Column) -> Column:
    return F.concat(F.substring(F.lit("HSP"), (key % 3 + 1).cast("int"), F.lit(1)), _padded(key, 8))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered candidates: cand_id, name, city, state, party, pcc."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").where((key % 4 == 1) & (key % 5 != 0)).select(
        _candidate_id(key).alias("cand_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("city"), F.col("p_type").alias("state"),
        _pick(key % 7, ("REP", "DEM", "IND", "GRE", "", "DEM")).alias("party"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("C"), _padded(key % 10, 8))).alias("pcc"),
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contributions, before earmarks are rewritten and persons named."""
    # Only what is filed of a line, in its shortest form, is shuffled.
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 10 == 0).alias("is_memo"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("tx_amt"), _cycle("l_shipdate").alias("cycle"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    # Orders meet their customers first, so that the many lines are shuffled once.
    rows = lines.join(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey")
    types = ("10", "15", "15E", "15Z", "16R", "17R", "18", "18G", "20Y", "22Y", "24I", "24K", "24T", "30K")
    other = (
        F.when(part % 97 == 0, F.concat(F.lit("C9"), _padded(part % 5, 7)))
        .when(part % 4 == 0, F.concat(F.lit("C"), _padded(part % 9, 8)))
        .when(part % 4 == 1, _candidate_id(part))
        .otherwise("")
    )
    return rows.select(
        F.concat(F.lit("C"), _padded(F.col("l_suppkey"), 8)).alias("filer_id"),
        _pick((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + part) % 14, types).alias("tx_type"),
        F.when(F.col("is_memo"), "X").otherwise("").alias("memo_code"), other.alias("other_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("employer"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("occupation"),
        _padded(F.col("c_nationkey"), 5).alias("zip"), "tx_amt",
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx_id"), "cycle",
    )


def disbursements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating expenses; sub_id is unique."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("C"), _padded(F.col("o_custkey") % 10, 8)).alias("cmte_id"), F.col("c_name").alias("name"), _padded(F.col("c_nationkey"), 5).alias("zip"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("tx_amt"), F.col("o_orderkey").alias("sub_id"), _cycle("o_orderdate").alias("cycle"),
    )
