"""What is shuffled and written of tables that grow: plans of shared steps, with broadcast joins as large tables have them."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import search
from sluice.operators.index_store import IndexStore
from sluice.operators.serving import ServingTable
from sluice.plans.book import Book
from sluice.sources import fixtures

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sums_are_stored_after_one_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{n % 7}", n % 3, 1.0 * n) for n in range(200)] + [("k1", 0, None)], "k string, c int, v double").repartition(5)
    want = rows.groupBy("k", "c").agg(F.sum("v").alias("v"))
    table = ServingTable(spark, f"{tmp_path}/sums", want.schema, "k", ["c"], parts=8)
    assert _plan(table._dealt(rows).groupBy("part", *table.keys).agg(F.sum("v"))).count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning" not in _plan(table._dealt(rows).groupBy("part", *table.keys).agg(F.sum("v")))
    assert _same(table.write_sums(rows, F.sum("v").alias("v")).rows, want)
    assert table.get("k3", c=1).count() == 1


def test_index_takes_a_row_for_each_id_and_shuffles_no_terms_for_it(spark, tmp_path):
    b = Book(spark, SF)
    assert "Exchange" not in _plan(b.postings) and "Exchange" not in _plan(b.lookup)
    assert b.postings.count() == b.postings.distinct().count()
    buckets = b.indexed.select("id", F.explode("buckets").alias("bucket"), "years").select("id", "bucket", F.explode("years").alias("cycle"))
    assert _same(buckets, b.yearly_entities.select("id", "bucket", "cycle"))
    assert b.indexed.where(F.size("buckets") > 1).count() > 0
    made = IndexStore(spark, f"{tmp_path}/index", size=7, pieces=4, slot_shards=3).build(b.postings)
    assert _same(made.postings.select("term", "id"), b.postings)
    want = search.shard_postings(b.postings, 7).groupBy("term", "shard").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("entries"))
    assert _same(made.shards.drop("piece"), want)


def test_postings_are_not_shuffled_again_to_be_cut(spark):
    rows = spark.range(3000).select(F.concat(F.lit("t"), F.col("id") % 1000).alias("term"), F.col("id").cast("string").alias("id"))
    assert "Exchange hashpartitioning" not in _plan(search.shard_postings(rows, 100))


def test_only_what_is_filed_of_a_line_meets_orders(spark, no_broadcast):
    plan = fixtures.contributions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert not any(c in above for c in ("l_quantity", "l_shipdate", "l_extendedprice"))


def test_entities_of_some_ids_are_those_of_all(spark):
    b = Book(spark, SF)
    asked = b.entities.select("id").where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    assert asked.count() > 20
    assert _same(b.entities_of(asked), b.entities.join(asked.distinct(), "id", "left_semi"))
