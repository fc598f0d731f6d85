"""Counterparty lists as one long table: (cycle, list_name, owner_id, cp_id, amt, txs). Memo rows count here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.codes import COUNTERPARTY_LIMIT
from sluice.functions.expressions import ratio

#: Lists with a limit, largest amounts first.
LIMITED = ("top_indv_contributors", "top_cmte_contributors", "top_exp_recipients")


def postings(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """(cycle, list_name, owner_id, cp_id, tx_amt): each row of the ledger in every list that it belongs to."""

    def entry(name: str, owner: str, cp: str):
        return F.struct(F.lit(name).alias("list_name"), F.col(owner).alias("owner_id"), F.col(cp).alias("cp_id"))

    own, other = "filer_id", "other_id"
    incoming = (
        F.when(F.col("bucket") == "individual", F.array(entry("indv_recipients", other, own), entry("top_indv_contributors", own, other)))
        .when(F.col("bucket") == "candidate", F.array(entry("cand_recipients", other, own), entry("top_indv_contributors", own, other)))
        .otherwise(F.array(entry("top_cmte_contributors", own, other)))
    )
    outgoing = (
        F.when(F.col("bucket") == "individual", F.array(entry("indv_senders", other, own), entry("top_exp_recipients", own, other)))
        .when((F.col("bucket") == "candidate") & F.col("transfer"), F.array(entry("cand_senders", other, own), entry("transfer_recipients", own, other)))
        .when(F.col("bucket") == "candidate", F.array(entry("cand_senders", other, own), entry("top_exp_recipients", own, other)))
        .otherwise(F.array(entry("transfer_recipients", own, other)))
    )
    rows = ledger.where("counted").select("cycle", F.explode(F.when(F.col("incoming"), incoming).otherwise(outgoing)).alias("e"), "tx_amt")
    paid = expenses.select("cycle", F.explode(F.array(entry("indv_senders", "person", "cmte_id"), entry("top_exp_recipients", "cmte_id", "person"))).alias("e"), "tx_amt")
    return rows.union(paid).select("cycle", "e.*", "tx_amt")


def single_edges(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """All lists with a row for each transaction, in the form of `edges`, for those who add them up themselves."""
    return postings(ledger, expenses).select("cycle", "list_name", "owner_id", "cp_id", F.col("tx_amt").alias("amt"), F.lit(1).cast("long").alias("txs"))


def edges(ledger: DataFrame, expenses: DataFrame) -> DataFrame:
    """All lists, without their limits; amounts are decimals."""
    return postings(ledger, expenses).groupBy("cycle", "list_name", "owner_id", "cp_id").agg(F.sum("tx_amt").alias("amt"), F.count("*").alias("txs"))


def ranked(rows: DataFrame, limit: int | None, *group: str, amount: str = "amt", key: str = "cp_id") -> DataFrame:
    """Rows with their rank in the group, by amount and then id, up to the limit."""
    order = Window.partitionBy(*group).orderBy(F.desc(amount), key)
    made = rows.withColumn("rank", F.row_number().over(order))
    return made if limit is None else made.where(F.col("rank") <= limit)


def edges_of(ledger: DataFrame, expenses: DataFrame, owner: str, names: Sequence[str]) -> DataFrame:
    """The named lists of one owner with doubles and ranks (null without a limit), from that owner's rows alone."""
    own = edges(ledger.where((F.col("filer_id") == owner) | (F.col("other_id") == owner)), expenses.where((F.col("cmte_id") == owner) | (F.col("person") == owner)))
    rows = ranked(own.where((F.col("owner_id") == owner) & F.col("list_name").isin(*names)), None, "cycle", "list_name", "owner_id")
    limited = F.col("list_name").isin(*LIMITED)
    rows = rows.where(~limited | (F.col("rank") <= COUNTERPARTY_LIMIT))
    return rows.select("cycle", "list_name", "owner_id", "cp_id", F.col("amt").cast("double").alias("amt"), "txs", F.when(limited, F.col("rank")).alias("rank"))


def edge_list(all_edges: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """One list with doubles; a list with a limit keeps each owner's largest counterparties."""
    rows = all_edges.where(F.col("list_name") == name)
    limit = limit or (COUNTERPARTY_LIMIT if name in LIMITED else None)
    if limit:
        rows = ranked(rows, limit, "cycle", "owner_id")
    return rows.select("cycle", "owner_id", "cp_id", F.col("amt").cast("double").alias("amt"), "txs", *(["rank"] if limit else []))


def counterparty_averages(all_edges: DataFrame) -> DataFrame:
    return all_edges.select("cycle", "list_name", "owner_id", "cp_id", ratio(F.col("amt"), F.col("txs")).alias("avg_amt"))
