"""The ledger: contributions with earmarks rewritten, counterparties named and every row classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import entity_bucket, is_contribution, is_earmark, is_incoming, is_transfer, organisation_key, person_key
from sluice.sources.shared import written


def normalize(contributions: DataFrame) -> DataFrame:
    """cycle, filer_id, tx_type, is_memo, other_id, bucket, tx_amt, tx_id and the counterparty's own words.

    An earmark passed on (24I) belongs to the committee it names and becomes 15E, before anything else is looked
    up. Rows without a counterparty, and all earmarks, are given to a person, identified by hashed attributes.
    """
    passed_on = F.col("tx_type") == "24I"
    unnamed = (F.col("other_id") == "") | is_earmark(F.col("tx_type"))
    return contributions.select(
        "cycle", F.when(passed_on & (F.col("other_id") != ""), F.col("other_id")).otherwise(F.col("filer_id")).alias("filer_id"),
        F.when(passed_on, "15E").otherwise(F.col("tx_type")).alias("tx_type"), (F.col("memo_code") == "X").alias("is_memo"),
        F.when(unnamed, person_key(F.col("name"), F.col("employer"), F.col("occupation"), F.col("zip"))).otherwise(F.col("other_id")).alias("other_id"),
        F.when(unnamed, "individual").otherwise(entity_bucket(F.col("other_id"))).alias("bucket"),  # a hashed id is a person's, whatever its letters
        "tx_amt", "tx_id", "name", "employer", "occupation", "zip",
    )


def classify(normalized: DataFrame) -> DataFrame:
    """Adds incoming, transfer, contribution, and counted (false for outgoing 24T, which nothing posts)."""
    kind = F.col("tx_type")
    return normalized.select(
        "*", is_incoming(kind).alias("incoming"), is_transfer(kind).alias("transfer"),
        (is_incoming(kind) & is_contribution(kind)).alias("contribution"), (is_incoming(kind) | (kind != "24T")).alias("counted"),
    )


def expense_ledger(disbursements: DataFrame) -> DataFrame:
    """cycle, cmte_id, person, tx_amt, name, zip, sub_id: operating expenses with their receivers named."""
    return disbursements.select("cycle", "cmte_id", organisation_key(F.col("name"), F.col("zip")).alias("person"), "tx_amt", "name", "zip", "sub_id")


def resolve_filers(ledger: DataFrame, expenses: DataFrame, committees: DataFrame) -> DataFrame:
    """All committees with their attributes: registered ones, and placeholders for filers that are not registered."""
    filers = ledger.select(F.col("filer_id").alias("cmte_id")).union(expenses.select("cmte_id")).distinct()
    return _with_placeholders(committees.select("cmte_id", "name", "city", "state", "party"), filers, "cmte_id")


def _with_placeholders(registered: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    missing = wanted.join(registered, key, "left_anti")
    unknown = missing.select(key, F.lit("Unknown").alias("name"), F.lit("???").alias("city"), F.lit("???").alias("state"), F.lit("UNK").alias("party"), F.lit(False).alias("registered"))
    return registered.withColumn("registered", F.lit(True)).unionByName(unknown)


def named_persons(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """(indv_id, name, employer, occupation, zip, tx_key): persons as each transaction names them; contributions come before expenses."""
    given = ledger.where("bucket = 'individual'").select(F.col("other_id").alias("indv_id"), "name", "employer", "occupation", "zip", F.concat(F.lit("0"), "tx_id").alias("tx_key"))
    paid = expenses.select(F.col("person").alias("indv_id"), "name", F.lit("").alias("employer"), F.lit("").alias("occupation"), "zip", F.concat(F.lit("1"), F.col("sub_id").cast("string")).alias("tx_key"))
    return given.union(paid)


def individuals(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """indv_id, name, employer, occupation, zip: the attributes that the first transaction by its key gives, contributions first."""
    # Nearly all persons are named in one way, so that no keys need to be compared; only rows of the others are sorted by key.
    who = ("name", "employer", "occupation", "zip")
    named = named_persons(ledger, expenses)
    source = F.when(F.col("tx_key").isNull(), 2).otherwise(F.substring("tx_key", 1, 1).cast("int"))
    ways = named.select("indv_id", *(F.when(F.col("tx_key").isNotNull(), F.col(c)).alias(c) for c in who), source.alias("source")).distinct()
    own = Window.partitionBy("indv_id")
    ways = ways.withColumn("place", F.rank().over(own.orderBy("source"))).where("place = 1").withColumn("ways", F.count("*").over(own))
    ways = written(ways.drop("place", "source"), "persons")
    single, several = ways.where("ways = 1").select("indv_id", *who), ways.where("ways > 1").select("indv_id").distinct()
    if several.isEmpty():
        return single
    rows = named.join(several, "indv_id", "left_semi").groupBy("indv_id").agg(F.min_by(F.struct(*who), "tx_key").alias("who"))
    return single.union(rows.select("indv_id", "who.*"))


def resolve_counterparties(ledger: DataFrame, filers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, bucket, name, registered) of each counterparty that is a committee or a candidate, placeholders too."""
    wanted = ledger.where("bucket <> 'individual'").select(F.col("other_id").alias("id"), "bucket").distinct()
    known = filers.select(F.col("cmte_id").alias("id"), "name", "registered").union(candidates.select(F.col("cand_id").alias("id"), "name", F.lit(True)))
    return wanted.join(known, "id", "left").select("id", "bucket", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("registered", F.lit(False)).alias("registered"))


def unresolved(ledger: DataFrame, committees: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose filer, or whose committee or candidate, is not registered."""
    known = committees.select(F.col("cmte_id").alias("id")).union(candidates.select(F.col("cand_id"))).distinct()
    filers = ledger.join(known, ledger["filer_id"] == known["id"], "left_anti").withColumn("side", F.lit("filer"))
    others = ledger.where("bucket <> 'individual'").join(known, ledger["other_id"] == known["id"], "left_anti").withColumn("side", F.lit("counterparty"))
    return filers.unionByName(others)


def entities(filers: DataFrame, candidates: DataFrame, people: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, bucket, name, city, state, employer): one table of all entities; party stands in for employer of the registered kinds."""
    wanted = ledger.where("bucket = 'candidate'").select(F.col("other_id").alias("cand_id")).distinct()
    runners = _with_placeholders(candidates.select("cand_id", "name", "city", "state", "party"), wanted, "cand_id")
    return (
        filers.select(F.col("cmte_id").alias("id"), F.lit("committee").alias("bucket"), "name", "city", "state", F.col("party").alias("employer"))
        .union(runners.select("cand_id", F.lit("candidate"), "name", "city", "state", "party"))
        .union(people.select("indv_id", F.lit("individual"), "name", F.lit(""), F.lit(""), "employer"))
    )
