"""All derived tables of one data set, each made when it is first asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import edges, ledger, rankings, search, totals
from sluice.sources import fixtures
from sluice.sources.shared import once, shuffles_removed


class Book:
    """Lazy frames over one set of filings. Filed rows, which all others are made of many times, are stored once a session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.cycles = fixtures.LOADED_CYCLES

    @cached_property
    def committees(self) -> DataFrame:
        return fixtures.committees(self.spark, self.sf_dir)

    @cached_property
    def candidates(self) -> DataFrame:
        return fixtures.candidates(self.spark, self.sf_dir)

    def _filed(self, kind: str, rows: Callable[[], DataFrame]) -> DataFrame:
        def make(folder: str) -> DataFrame:
            made = rows()
            with shuffles_removed(self.spark):
                made.write.mode("overwrite").option("compression", "zstd").parquet(folder)
            return self.spark.read.schema(made.schema).parquet(folder)

        return once(self.spark, self.sf_dir, kind, make)

    @cached_property
    def contributions(self) -> DataFrame:
        return self._filed("contributions", lambda: fixtures.contributions(self.spark, self.sf_dir))

    @cached_property
    def disbursements(self) -> DataFrame:
        return self._filed("disbursements", lambda: fixtures.disbursements(self.spark, self.sf_dir))

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.classify(ledger.normalize(self.contributions))

    @cached_property
    def expenses(self) -> DataFrame:
        return ledger.expense_ledger(self.disbursements)

    @cached_property
    def filers(self) -> DataFrame:
        return ledger.resolve_filers(self.ledger, self.expenses, self.committees)

    @cached_property
    def people(self) -> DataFrame:
        return ledger.individuals(self.ledger, self.expenses)

    @cached_property
    def entities(self) -> DataFrame:
        return ledger.entities(self.filers, self.candidates, self.people, self.ledger)

    def entities_of(self, asked: DataFrame) -> DataFrame:
        """Entities of a table of ids (id); of all rows only those of the asked persons are compared."""
        given = self.ledger.join(asked.select(F.col("id").alias("other_id")), "other_id", "left_semi")
        paid = self.expenses.join(asked.select(F.col("id").alias("person")), "person", "left_semi")
        return ledger.entities(self.filers, self.candidates, ledger.individuals(given, paid), self.ledger).join(asked, "id", "left_semi")

    @cached_property
    def committee_totals(self) -> DataFrame:
        seeds = totals.cycle_seeds(self.committees, "cmte_id", self.cycles)
        return totals.committee_totals(totals.committee_postings(self.ledger, self.expenses, seeds))

    @cached_property
    def individual_totals(self) -> DataFrame:
        return totals.individual_totals(self.ledger, self.expenses)

    @cached_property
    def candidate_totals(self) -> DataFrame:
        return totals.candidate_totals(self.ledger)

    @cached_property
    def edges(self) -> DataFrame:
        return edges.edges(self.ledger, self.expenses)

    @cached_property
    def committee_measures(self) -> DataFrame:
        return rankings.committee_measures(self.committee_totals, self.filers)

    @cached_property
    def individual_measures(self) -> DataFrame:
        return rankings.individual_measures(self.individual_totals)

    @cached_property
    def pcc_totals(self) -> DataFrame:
        return rankings.candidate_pcc_totals(self.candidates, self.candidate_totals, self.committee_totals, self.cycles)

    @cached_property
    def candidate_measures(self) -> DataFrame:
        return rankings.candidate_measures(self.pcc_totals)

    @cached_property
    def measures(self) -> DataFrame:
        return self.committee_measures.union(self.individual_measures).union(self.candidate_measures)

    @cached_property
    def rankings(self) -> DataFrame:
        return rankings.rankings(self.measures)

    @cached_property
    def yearly_totals(self) -> DataFrame:
        return rankings.yearly_totals(self.committee_measures)

    @cached_property
    def active(self) -> DataFrame:
        """(id, cycle): the cycles in which an entity has money, or is registered."""
        paid = self.ledger.select(F.col("other_id").alias("id"), "cycle").union(self.ledger.select("filer_id", "cycle"))
        paid = paid.union(self.expenses.select("cmte_id", "cycle")).union(self.expenses.select("person", "cycle"))
        return paid.distinct()

    @cached_property
    def yearly_entities(self) -> DataFrame:
        """Entities by cycle, as the index takes them."""
        return self.entities.join(self.active, "id")

    @cached_property
    def known_ids(self) -> DataFrame:
        """(id): the ids of the lookup, without their attributes: all that is active but committees that neither file nor are registered."""
        other = self.ledger.select(F.col("other_id").alias("id"), "bucket")
        registered = self.committees.select(F.col("cmte_id").alias("id")).union(self.candidates.select("cand_id"))
        ids = self.ledger.select(F.col("filer_id").alias("id")).union(self.expenses.select("cmte_id")).union(self.expenses.select("person"))
        ids = ids.union(other.where("bucket <> 'committee'").select("id"))
        return ids.union(other.where("bucket = 'committee'").select("id").distinct().join(registered, "id", "left_semi")).distinct()

    @cached_property
    def search_texts(self) -> DataFrame:
        return search.search_texts(self.yearly_entities)

    @cached_property
    def indexed(self) -> DataFrame:
        """What the index takes of all entities that are active in some cycle, one row an id."""
        return self._filed("indexed", lambda: search.indexed(self.entities, self.active))

    @cached_property
    def postings(self) -> DataFrame:
        """Terms of all entities that are active in some cycle; an entity's texts are the same in each."""
        return search.tokenize_once(self.indexed)

    @cached_property
    def lookup(self) -> DataFrame:
        return self.indexed.drop("buckets", "texts")

    @cached_property
    def documents(self) -> DataFrame:
        return fixtures.read(self.spark, self.sf_dir, "documents")

    @cached_property
    def document_postings(self) -> DataFrame:
        """(term, id) over whole documents: the index operators at volume."""
        return search.tokenize(self.documents.select(F.col("doc_id").alias("id"), F.array(F.coalesce("text", F.lit(""))).alias("texts")))
