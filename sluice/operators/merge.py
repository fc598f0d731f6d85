"""Several cycles of one entity taken together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import ratio
from sluice.operators.edges import ranked
from sluice.operators.totals import MEASURES


def _chosen(rows: DataFrame, cycles: Sequence[int] | None) -> DataFrame:
    return rows if cycles is None else rows.where(F.col("cycle").isin(*cycles))


def _sum(name: str):
    return F.sum(F.col(name).cast("decimal(28,2)")).alias(name)


def merge_in_out(totals: DataFrame, key: str, cycles: Sequence[int] | None = None) -> DataFrame:
    """Individuals or candidates: sums, averages made anew, balance."""
    made = _chosen(totals, cycles).groupBy(key).agg(_sum("out_amt"), F.sum("out_txs").alias("out_txs"), _sum("in_amt"), F.sum("in_txs").alias("in_txs"))
    return made.select(
        key, F.col("out_amt").cast("double").alias("out_amt"), "out_txs", ratio(F.col("out_amt"), F.col("out_txs")).alias("out_avg"),
        F.col("in_amt").cast("double").alias("in_amt"), "in_txs", ratio(F.col("in_amt"), F.col("in_txs")).alias("in_avg"), (F.col("in_amt") - F.col("out_amt")).cast("double").alias("net_balance"),
    )


def merge_committees(totals: DataFrame, cycles: Sequence[int] | None = None) -> DataFrame:
    parts = (*MEASURES, "total_in", "total_out")
    made = _chosen(totals, cycles).groupBy("cmte_id").agg(*(x for p in parts for x in (_sum(f"{p}_amt"), F.sum(f"{p}_txs").alias(f"{p}_txs"))))
    columns = [c for p in parts for c in (F.col(f"{p}_amt").cast("double").alias(f"{p}_amt"), f"{p}_txs", ratio(F.col(f"{p}_amt"), F.col(f"{p}_txs")).alias(f"{p}_avg"))]
    return made.select("cmte_id", *columns, (F.col("total_in_amt") - F.col("total_out_amt")).cast("double").alias("net_balance"))


def merge_transactions(lists: DataFrame, key: str, cycles: Sequence[int] | None = None) -> DataFrame:
    """Transaction lists joined, sorted."""
    return _chosen(lists, cycles).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("transactions"))).alias("transactions"))


def merge_edges(all_edges: DataFrame, cycles: Sequence[int] | None = None) -> DataFrame:
    """(list_name, owner_id, cp_id, amt, txs): the lists' keys together, values added."""
    return _chosen(all_edges, cycles).groupBy("list_name", "owner_id", "cp_id").agg(F.sum("amt").alias("amt"), F.sum("txs").alias("txs"))


def top_merged(merged: DataFrame, limit: int = 100) -> DataFrame:
    return ranked(merged, limit, "list_name", "owner_id")
