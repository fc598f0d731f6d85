"""Measures of entities, rankings and yearly totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.codes import INDIVIDUAL_LIMIT, LIST_TITLES, PARTIES, PARTY_TITLES, RANKING_LIMIT, TOTAL_TITLES
from sluice.functions.expressions import party_bucket
from sluice.operators.edges import ranked

#: Parts in which the longest lists are cut first.
LIST_PARTS = 32
CATEGORIES = {"individuals": ("donor", "rec"), "cmte_tx_data": ("rec", "donor", "exp"), "candidates": ("rec", "donor", "exp")}


def committee_measures(totals: DataFrame, filers: DataFrame) -> DataFrame:
    """(cycle, bucket, category, entity_id, party, total)."""
    rows = totals.join(filers.select("cmte_id", "party"), "cmte_id", "left")
    rows = rows.select("cycle", F.col("cmte_id").alias("entity_id"), party_bucket(F.coalesce("party", F.lit(""))).alias("party"), F.col("total_in_amt").alias("rec"), F.col("transfers_amt").alias("donor"), F.col("expenditures_amt").alias("exp"))
    return _long(rows, "cmte_tx_data")


def individual_measures(totals: DataFrame) -> DataFrame:
    return _long(totals.select("cycle", F.col("indv_id").alias("entity_id"), F.lit("ALL").alias("party"), F.col("in_amt").alias("rec"), F.col("out_amt").alias("donor")), "individuals")


def candidate_pcc_totals(candidates: DataFrame, direct: DataFrame, committee_totals: DataFrame, cycles: Sequence[int]) -> DataFrame:
    """(cycle, cand_id, party, rec, donor, exp): the principal committee's totals in place of the direct ones, where there is one."""
    every = candidates.select(F.explode(F.array(*(F.lit(c).cast("int") for c in cycles))).alias("cycle"), "cand_id", "party", "pcc")
    own = committee_totals.select("cycle", F.col("cmte_id").alias("pcc"), "total_in_amt", "transfers_amt", F.col("expenditures_amt"), F.lit(True).alias("has_pcc"))
    rows = every.join(own, ["cycle", "pcc"], "left").join(direct.select("cycle", "cand_id", "in_amt", "out_amt"), ["cycle", "cand_id"], "left")
    zero = F.lit(0.0)
    return rows.select(
        "cycle", "cand_id", party_bucket(F.col("party")).alias("party"),
        F.when(F.col("has_pcc"), F.col("total_in_amt")).otherwise(F.coalesce("in_amt", zero)).alias("rec"),
        F.when(F.col("has_pcc"), F.col("transfers_amt")).otherwise(F.coalesce("out_amt", zero)).alias("donor"),
        F.when(F.col("has_pcc"), F.col("expenditures_amt")).otherwise(zero).alias("exp"),
    )


def candidate_measures(pcc_totals: DataFrame) -> DataFrame:
    return _long(pcc_totals.withColumnRenamed("cand_id", "entity_id"), "candidates")


def _long(rows: DataFrame, bucket: str) -> DataFrame:
    made = rows.unpivot(["cycle", "entity_id", "party"], list(CATEGORIES[bucket]), "category", "total")
    return made.select("cycle", F.lit(bucket).alias("bucket"), "category", "entity_id", "party", "total")


def rankings(measures: DataFrame, limit: int | None = None, cycle: str = "cycle") -> DataFrame:
    """(ranking_id, cycle, bucket, category, party, rank, entity_id, total) for each party and for all; totals of 0 are left out."""
    parties = F.when(F.col("party") == "ALL", F.array(F.lit("ALL"))).otherwise(F.array(F.col("party"), F.lit("ALL")))
    rows = measures.where("total <> 0").withColumn("party", F.explode(parties))
    group = ("cycle", "bucket", "category", "party")
    person = F.col("bucket") == "individuals"
    # Limits are literals, so that each task keeps no more than a list's length before rows are shuffled. Long lists are
    # first cut in parts, which bounds what meets in one task.
    parts = rows.where(person).withColumn("part", F.pmod(F.xxhash64("entity_id"), F.lit(LIST_PARTS)))
    people = parts if (limit or INDIVIDUAL_LIMIT) <= RANKING_LIMIT else ranked(parts, INDIVIDUAL_LIMIT, *group, "part", amount="total", key="entity_id")
    made = ranked(people.drop("part", "rank"), limit or INDIVIDUAL_LIMIT, *group, amount="total", key="entity_id")
    made = made.unionByName(ranked(rows.where(~person), limit or RANKING_LIMIT, *group, amount="total", key="entity_id"))
    return made.select(F.concat_ws("-", F.col("cycle").cast("string"), "bucket", "category", "party").alias("ranking_id"), "cycle", "bucket", "category", "party", "rank", "entity_id", "total")


def preview(ranks: DataFrame, size: int = 10) -> DataFrame:
    return ranks.where(F.col("rank") <= size).withColumn("ranking_id", F.concat("ranking_id", F.lit("-pre")))


def clip(ranks: DataFrame, size: int = RANKING_LIMIT) -> DataFrame:
    return ranks.where(F.col("rank") <= size)


def threshold(rows: DataFrame, size: int, *group: str, amount: str = "amt", key: str = "cp_id", least: int = 10) -> DataFrame:
    """The `least` smallest rows of each list that has `size` of them."""
    order = Window.partitionBy(*group)
    made = rows.withColumn("from_end", F.row_number().over(order.orderBy(amount, F.desc(key)))).withColumn("held", F.count("*").over(order))
    return made.where((F.col("held") >= size) & (F.col("from_end") <= least)).drop("held")


def yearly_totals(committee_measures_: DataFrame) -> DataFrame:
    """(total_id, cycle, category, party, total), each party and ALL. Sums are of decimals."""
    rows = committee_measures_.select("cycle", "category", "party", F.col("total").cast("decimal(28,2)").alias("total"))
    sums = rows.groupingSets([["cycle", "category", "party"], ["cycle", "category"]], "cycle", "category", "party").agg(F.sum("total").cast("double").alias("total"))
    sums = sums.withColumn("party", F.coalesce("party", F.lit("ALL")))
    return sums.select(F.concat_ws("-", F.col("cycle").cast("string"), "category", "party").alias("total_id"), "cycle", "category", "party", "total")


def all_time(measures: DataFrame) -> DataFrame:
    """Measures summed over all cycles; their cycle is `all_time`."""
    sums = measures.groupBy("bucket", "category", "entity_id", "party").agg(F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("total"))
    return sums.select(F.lit("all_time").alias("cycle"), "bucket", "category", "entity_id", "party", "total")


def grid(spark: SparkSession, cycles: Sequence[int]) -> DataFrame:
    """Every ranking list, empty ones too: (ranking_id, cycle, bucket, category, party)."""
    rows = [(f"{c}-{b}-{k}-{p}", c, b, k, p) for c in cycles for b, cats in CATEGORIES.items() for k in cats for p in (PARTIES if b != "individuals" else ("ALL",))]
    return spark.createDataFrame(rows, "ranking_id string, cycle int, bucket string, category string, party string")


def grid_sizes(lists: DataFrame, ranks: DataFrame) -> DataFrame:
    held = ranks.groupBy("ranking_id").agg(F.count("*").alias("held"))
    return lists.join(held, "ranking_id", "left").select("ranking_id", "cycle", "bucket", "category", "party", F.coalesce("held", F.lit(0)).alias("entries"))


def lists_of(measures: DataFrame) -> DataFrame:
    """(ranking_id, bucket, category, party) of the lists that have entries, without ranking anything."""
    parties = F.when(F.col("party") == "ALL", F.array(F.lit("ALL"))).otherwise(F.array(F.col("party"), F.lit("ALL")))
    held = measures.where("total <> 0").select("cycle", "bucket", "category", "party").distinct().withColumn("party", F.explode(parties)).distinct()
    return held.select(F.concat_ws("-", F.col("cycle").cast("string"), "bucket", "category", "party").alias("ranking_id"), "bucket", "category", "party")


def labels(lists: DataFrame) -> DataFrame:
    """Titles of ranking lists and of their parties."""
    spark = lists.sparkSession
    titles = spark.createDataFrame([(*k.split("-"), t) for k, t in LIST_TITLES.items()], "bucket string, category string, title string")
    parties = spark.createDataFrame(list(PARTY_TITLES.items()), "party string, party_title string")
    return lists.join(F.broadcast(titles), ["bucket", "category"]).join(F.broadcast(parties), "party").select("ranking_id", "title", "party_title")


def shown_totals(totals: DataFrame, cycle: int | str, category: str) -> DataFrame:
    """The six parties of a cycle and category in their fixed order; 0 where there is no total."""
    spark = totals.sparkSession
    order = spark.createDataFrame([(k, p, PARTY_TITLES[p]) for k, p in enumerate(PARTIES)], "position int, party string, party_title string")
    found = totals.where((F.col("cycle") == cycle) & (F.col("category") == category)).select("party", "total")
    return F.broadcast(order).join(found, "party", "left").select("position", "party", "party_title", F.lit(TOTAL_TITLES[category]).alias("title"), F.coalesce("total", F.lit(0.0)).alias("total")).orderBy("position")


def enrich(ranks: DataFrame, entities: DataFrame) -> DataFrame:
    """Ranks with the entity's name, city and state; an unknown entity keeps its id and amount."""
    words = entities.select(F.col("id").alias("entity_id"), "name", "city", "state")
    return ranks.join(words, "entity_id", "left").withColumns({"name": F.coalesce("name", F.lit("Unknown")), "city": F.coalesce("city", F.lit("???")), "state": F.coalesce("state", F.lit("???"))})
