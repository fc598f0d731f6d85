"""Tables that are stored once for a session and data set, and then read by every query that asks for them."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import functions as F

from sluice.operators import edges
from sluice.operators.index_store import IndexStore
from sluice.operators.profiles import Profiles
from sluice.operators.serving import ServingTable
from sluice.plans.book import Book
from sluice.sources import filings, shared
from sluice.streaming.rollup import Loader

T = TypeVar("T")
#: Ids of a shard of the index of whole documents.
DOCUMENT_SHARD = 100


def once(b: Book, kind: str, make: Callable[[str], T]) -> T:
    """What `make` writes for the book's data set, once a session."""
    return shared.once(b.spark, b.sf_dir, kind, make)


def entity_index(b: Book) -> IndexStore:
    """The index of all entities with their lookup rows."""
    def make(folder: str) -> IndexStore:
        done = b.indexed.select(F.explode("buckets").alias("bucket"), "years").select("bucket", F.explode("years").alias("cycle")).distinct()
        return IndexStore(b.spark, folder).build(b.postings, b.lookup, done)

    return once(b, "index", make)


def document_index(b: Book) -> IndexStore:
    """The index of whole documents; ids are of twelve digits, so that their order as text is that of the numbers."""
    rows = b.document_postings.withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    return once(b, "documents", lambda folder: IndexStore(b.spark, folder, size=DOCUMENT_SHARD).build(rows))


def profiles(b: Book) -> Profiles:
    """All entities, totals and counterparties under the entities' ids."""
    return once(b, "profiles", lambda folder: Profiles(b.spark, folder).build(b.entities, edges.single_edges(b.ledger, b.expenses), b.committee_totals, b.individual_totals, b.candidate_totals))


def committee_table(b: Book) -> ServingTable:
    """Totals of committees under id and cycle."""
    made = b.committee_totals
    return once(b, "committee-table", lambda folder: ServingTable(b.spark, folder, made.schema, "cmte_id", ["cycle"]).write(made))


def streamed(b: Book) -> Loader:
    """All contributions and disbursements loaded as lines of files in three runs; the later runs are given lines of the one before again."""
    kinds = {
        "contributions": (b.contributions, ("filer_id", "tx_type", "name", "employer", "occupation", "zip", "tx_amt", "other_id", "tx_id", "memo_code")),
        "disbursements": (b.disbursements, ("cmte_id", "name", "zip", "tx_amt", "sub_id")),
    }

    def make(folder: str) -> Loader:
        loader = Loader(b.spark, f"{folder}/incoming", f"{folder}/loaded")
        loader.rollup.seed(b.committees, b.cycles)
        lines = {kind: filings.to_lines(rows, kind, {c: c for c in columns}, "cycle") for kind, (rows, columns) in kinds.items()}
        turn = F.pmod(F.xxhash64("value"), F.lit(6))
        for run in range(3):
            for kind, rows in lines.items():
                filings.write_lines(rows.where(turn.between(2 * run - (run > 0), 2 * run + 1)), f"{folder}/incoming/{kind}/run={run}")
            loader.fetch()
            shared.remove(b.spark, f"{folder}/incoming")  # what is fetched is not read again
            loader.add_up()
            if run == 1:
                loader.rollup.fold()
        return loader

    return once(b, "streamed", make)
