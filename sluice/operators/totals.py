"""Totals of committees, individuals and candidates. Sums are decimals and become doubles last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.codes import SHARD_IDS
from sluice.functions.expressions import ratio
from sluice.operators.search import shard_postings

#: Name of each measure of a committee, by the flag of the posting.
MEASURES = ("contributions", "other", "transfers", "expenditures")


def _amount(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("tx_amt"))), F.lit(0).cast("decimal(28,2)"))


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, 1)), F.lit(0))


def committee_postings(ledger: DataFrame, expenses: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(cycle, cmte_id, measure, tx_amt): what counts for a committee, memo rows and 24T left out. Seeds have no measure."""
    kind = F.when(F.col("incoming"), F.when(F.col("contribution"), "contributions").otherwise("other")).otherwise(F.when(F.col("transfer"), "transfers").otherwise("expenditures"))
    rows = ledger.where("not is_memo and counted").select("cycle", F.col("filer_id").alias("cmte_id"), kind.alias("measure"), "tx_amt")
    if expenses is not None:
        rows = rows.union(expenses.select("cycle", "cmte_id", F.lit("expenditures"), "tx_amt"))
    if seeds is not None:
        rows = rows.union(seeds.select("cycle", "cmte_id", F.lit(None).cast("string"), F.lit(0).cast("decimal(18,2)")))
    return rows


def committee_sums(postings: DataFrame) -> DataFrame:
    """(cycle, cmte_id, measure, amt, txs): one sum and one count for each measure, which can be added to others of the kind."""
    return postings.groupBy("cycle", "cmte_id", "measure").agg(F.sum("tx_amt").alias("amt"), F.count("*").alias("txs"))


def committee_totals(postings: DataFrame) -> DataFrame:
    """(cycle, cmte_id): amounts, counts and averages of each measure, of all incoming and outgoing money, and their balance."""
    return totals_of_sums(committee_sums(postings))


def totals_of_sums(measured: DataFrame) -> DataFrame:
    """Committee totals of sums by measure, one row a measure: the few rows of a committee are put side by side."""
    zero = {"amt": F.lit(0).cast("decimal(28,2)"), "txs": F.lit(0)}
    sums = [F.coalesce(F.max(F.when(F.col("measure") == m, F.col(n))), zero[n]).alias(f"{m}_{n}") for m in MEASURES for n in ("amt", "txs")]
    made = measured.groupBy("cycle", "cmte_id").agg(*sums)
    made = made.withColumns({f"total_{side}_{n}": F.col(f"{a}_{n}") + F.col(f"{b}_{n}") for side, a, b in (("in", "contributions", "other"), ("out", "transfers", "expenditures")) for n in ("amt", "txs")})
    parts = (*MEASURES, "total_in", "total_out")
    columns = [c for p in parts for c in (F.col(f"{p}_amt").cast("double").alias(f"{p}_amt"), F.col(f"{p}_txs").cast("long").alias(f"{p}_txs"), ratio(F.col(f"{p}_amt"), F.col(f"{p}_txs")).alias(f"{p}_avg"))]
    return made.select("cycle", "cmte_id", *columns, (F.col("total_in_amt") - F.col("total_out_amt")).cast("double").alias("net_balance"))


def cycle_seeds(entities: DataFrame, key: str, cycles: Sequence[int]) -> DataFrame:
    """A row of every entity in each loaded cycle, so that those without money have totals of 0."""
    return entities.select(F.explode(F.array(*(F.lit(c).cast("int") for c in cycles))).alias("cycle"), key)


def _in_out(postings: DataFrame, key: str) -> DataFrame:
    made = postings.groupBy("cycle", key).agg(_amount(F.col("out")).alias("o"), _count(F.col("out")).alias("n"), _amount(~F.col("out")).alias("i"), _count(~F.col("out")).alias("m"))
    return _in_out_columns(made, key)


def _in_out_columns(made: DataFrame, key: str) -> DataFrame:
    return made.select(
        "cycle", key, F.col("o").cast("double").alias("out_amt"), F.col("n").cast("long").alias("out_txs"), ratio(F.col("o"), F.col("n")).alias("out_avg"),
        F.col("i").cast("double").alias("in_amt"), F.col("m").cast("long").alias("in_txs"), ratio(F.col("i"), F.col("m")).alias("in_avg"), (F.col("i") - F.col("o")).cast("double").alias("net_balance"),
    )


def in_out_of_sums(sums: DataFrame, key: str) -> DataFrame:
    """Totals of sums (cycle, key, measure, amt, txs), one row for `out` and one for `in`."""
    zero = F.lit(0).cast("decimal(28,2)")
    held = [F.coalesce(F.max(F.when(F.col("measure") == m, F.col(c))), z).alias(n) for m, c, z, n in (("out", "amt", zero, "o"), ("out", "txs", F.lit(0), "n"), ("in", "amt", zero, "i"), ("in", "txs", F.lit(0), "m"))]
    return _in_out_columns(sums.groupBy("cycle", key).agg(*held), key)


def individual_postings(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """(cycle, indv_id, out, tx_amt): money given to and received from committees, expenses included."""
    rows = ledger.where("bucket = 'individual' and not is_memo and counted").select("cycle", F.col("other_id").alias("indv_id"), F.col("incoming").alias("out"), "tx_amt")
    return rows.union(expenses.select("cycle", F.col("person"), F.lit(False), "tx_amt"))


def individual_totals(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """(cycle, indv_id): totals of persons and organisations."""
    return _in_out(individual_postings(ledger, expenses), "indv_id")


def candidate_postings(ledger: DataFrame) -> DataFrame:
    """(cycle, cand_id, out, tx_amt): money that candidates gave to and received from committees directly."""
    return ledger.where("bucket = 'candidate' and not is_memo and counted").select("cycle", F.col("other_id").alias("cand_id"), F.col("incoming").alias("out"), "tx_amt")


def candidate_totals(ledger: DataFrame) -> DataFrame:
    """(cycle, cand_id): direct totals of candidates."""
    return _in_out(candidate_postings(ledger), "cand_id")


def candidate_affiliates(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cycle, cand_id, affiliates): committees other than the principal one that received from the candidate."""
    given = ledger.where("bucket = 'candidate' and incoming and not is_memo").select("cycle", F.col("other_id").alias("cand_id"), "filer_id").distinct()
    other = given.join(candidates.select("cand_id", "pcc"), "cand_id", "left").where(F.coalesce(F.col("pcc") != F.col("filer_id"), F.lit(True)))
    return other.groupBy("cycle", "cand_id").agg(F.array_sort(F.collect_set("filer_id")).alias("affiliates"))


def transaction_list(ledger: DataFrame, condition: str, key: str, name: str) -> DataFrame:
    """(cycle, name, transactions): sorted ids of the rows that meet the condition, one row an owner; transaction_rows has them in long form."""
    return ledger.where(condition).groupBy("cycle", F.col(key).alias(name)).agg(F.array_sort(F.collect_list("tx_id")).alias("transactions"))


#: Which rows the two lists hold, and whose they are.
LISTED = {
    "individual": ("bucket = 'individual' and incoming and not is_memo", "other_id", "indv_id"),
    "committee": ("bucket = 'committee' and not incoming and transfer and counted and not is_memo", "filer_id", "cmte_id"),
}


def transaction_rows(ledger: DataFrame, kind: str, size: int = SHARD_IDS) -> DataFrame:
    """(cycle, owner, shard, tx_id): the rows of a list, in order and cut every `size`, for owners with very many of them."""
    condition, key, name = LISTED[kind]
    rows = ledger.where(condition).select(F.concat_ws("|", F.col("cycle").cast("string"), key).alias("term"), F.col("tx_id").alias("id"))
    made = shard_postings(rows, size)
    return made.select(F.split_part("term", F.lit("|"), F.lit(1)).cast("int").alias("cycle"), F.split_part("term", F.lit("|"), F.lit(2)).alias(name), "shard", F.col("id").alias("tx_id"))


def individual_transactions(ledger: DataFrame) -> DataFrame:
    return transaction_list(ledger, *LISTED["individual"])


def committee_transfers(ledger: DataFrame) -> DataFrame:
    return transaction_list(ledger, *LISTED["committee"])
