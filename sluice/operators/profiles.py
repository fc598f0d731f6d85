"""Profiles of entities over chosen cycles, read from stored tables by the entity's id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.codes import COUNTERPARTY_LIMIT
from sluice.functions.expressions import ratio
from sluice.operators.edges import LIMITED, ranked
from sluice.operators.merge import merge_committees, merge_edges, merge_in_out
from sluice.operators.serving import ServingTable

#: Lists of each kind of entity.
LISTS = {
    "committee": ("top_indv_contributors", "top_cmte_contributors", "transfer_recipients", "top_exp_recipients"),
    "candidate": ("cand_recipients", "cand_senders"),
    "individual": ("indv_recipients", "indv_senders"),
}


class Profiles:
    """Entities, totals and counterparties, each stored under the entity's id: an entity's rows lie together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tables: dict[str, ServingTable] = {}

    def build(self, entities: DataFrame, edges: DataFrame, committees: DataFrame, individuals: DataFrame, candidates: DataFrame) -> Profiles:
        """Store the tables. `edges` are the lists without their limits, of which rows with the same keys are added up; the others have one row an id (and cycle)."""
        totals = individuals.withColumnRenamed("indv_id", "id").select(F.lit("individual").alias("kind"), "*").unionByName(candidates.withColumnRenamed("cand_id", "id").select(F.lit("candidate").alias("kind"), "*"))
        self._store("entities", entities, "id", "bucket")
        keys = ("owner_id", "list_name", "cycle", "cp_id")
        schema = edges.select(*keys, F.col("amt").cast("decimal(28,2)").alias("amt"), F.col("txs").cast("long").alias("txs")).schema
        adjacency = ServingTable(self.spark, f"{self.folder}/adjacency", schema, keys[0], keys[1:])
        self.tables["adjacency"] = adjacency.write_sums(edges, F.sum("amt").cast("decimal(28,2)").alias("amt"), F.sum("txs").alias("txs"))
        self._store("committees", committees, "cmte_id", "cycle")
        self._store("totals", totals, "id", "kind", "cycle")
        return self

    def _store(self, name: str, rows: DataFrame, pk: str, *sk: str) -> None:
        self.tables[name] = ServingTable(self.spark, f"{self.folder}/{name}", rows.schema, pk, sk).write(rows)

    def lists(self, kind: str, owner: str, cycles: Sequence[int]) -> DataFrame:
        """(list_name, owner_id, cp_id, cp_name, amt, txs, avg_amt, rank) of one owner, the cycles added up; limited lists are cut after that."""
        held = self.tables["adjacency"].get(owner, list_name=list(LISTS[kind]), cycle=list(cycles))
        rows = ranked(merge_edges(held), None, "list_name", "owner_id")
        limited = F.col("list_name").isin(*LIMITED)
        rows = rows.where(~limited | (F.col("rank") <= COUNTERPARTY_LIMIT))
        names = self.tables["entities"].get_many(rows.select(F.col("cp_id").alias("id"))).groupBy(F.col("id").alias("cp_id")).agg(F.max("name").alias("cp_name"))
        made = rows.join(names, "cp_id", "left")
        return made.select("list_name", "owner_id", "cp_id", F.coalesce("cp_name", F.lit("Unknown")).alias("cp_name"), F.col("amt").cast("double").alias("amt"), "txs", ratio(F.col("amt"), F.col("txs")).alias("avg_amt"), "rank")

    def _with_owner(self, rows: DataFrame, kind: str, owner: str, own: DataFrame) -> DataFrame:
        who = self.tables["entities"].get(owner, bucket=kind).select(F.col("id").alias("owner_id"), "name", "city", "state", "employer")
        return who.join(own, "owner_id", "left").join(rows, "owner_id", "left")

    def committee(self, owner: str, cycles: Sequence[int]) -> DataFrame:
        """A committee's four lists beside its totals, its name and party; a row without a list where it has none, no row for an unknown id."""
        own = merge_committees(self.tables["committees"].get(owner, cycle=list(cycles))).withColumnRenamed("cmte_id", "owner_id").select("owner_id", "total_in_amt", "total_out_amt", "net_balance")
        return self._with_owner(self.lists("committee", owner, cycles), "committee", owner, own)

    def candidate(self, owner: str, cycles: Sequence[int]) -> DataFrame:
        """A candidate's two lists beside the direct totals."""
        return self._person("candidate", owner, cycles)

    def individual(self, owner: str, cycles: Sequence[int]) -> DataFrame:
        """A person's two lists beside their totals."""
        return self._person("individual", owner, cycles)

    def _person(self, kind: str, owner: str, cycles: Sequence[int]) -> DataFrame:
        own = merge_in_out(self.tables["totals"].get(owner, kind=kind, cycle=list(cycles)), "id").withColumnRenamed("id", "owner_id").select("owner_id", "in_amt", "out_amt", "net_balance")
        return self._with_owner(self.lists(kind, owner, cycles), kind, owner, own)
