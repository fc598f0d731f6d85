"""The keyword index as stored tables: written once, searched by reading the query's terms alone, updated where it changes.

Postings (term, shard, id) lie in folders by `piece`, a hash of the term, and by `slot`, a number of a term's shards in order, each file
sorted by (term, id). A directory of shards has the smallest and largest id and the number of entries of each. A search
finds its terms in the directory, takes the term with fewest entries first, and of the other terms reads only the slots
whose shards overlap with the ranges of that one.

An update changes the shards of a term from the first one whose range an added id falls into; an id beyond all closed shards
fills the open one, which is the last. Only folders that hold a changed shard are written again. A batch that is added
again finds its ids and writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.codes import MAX_RESULTS, SHARD_IDS
from sluice.functions.expressions import canonical_id, lookup_partition, terms
from sluice.operators.search import index_metadata, lookup_by_ids, result_order, shard_postings, tokenize
from sluice.sources.shared import exists, remove, written

#: Folders by hash of the term, and shards of one term that share a folder.
PIECES, SLOT_SHARDS = 32, 64
#: Ranges of the rarest term that are sent to the scans of the others; closest ones are joined beyond.
RANGES = 64
OPEN = "!"
_POSTINGS = "term string, shard long, id string, piece int, slot int"
_SHARDS = "term string, shard long, min_id string, max_id string, entries long, piece int"
_LOOKUP = "id string, name string, city string, state string, employer string, bucket string, years array<int>, partition string"


class Term(NamedTuple):
    """What the directory has of a query's term."""

    term: str
    shards: int
    entries: int
    low: str
    high: str


class IndexStore:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, size: int = SHARD_IDS, pieces: int = PIECES, slot_shards: int = SLOT_SHARDS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.size, self.pieces, self.slot_shards = size, pieces, slot_shards
        self._finish()

    # Tables

    def _table(self, name: str, schema: str) -> DataFrame:
        """A stored table; an empty one before it is first written."""
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", _POSTINGS)

    @property
    def shards(self) -> DataFrame:
        """(term, shard, min_id, max_id, entries, piece), with the largest id of open shards too."""
        return self._table("shards", _SHARDS)

    @property
    def lookup(self) -> DataFrame:
        return self._table("lookup", _LOOKUP)

    @property
    def done(self) -> DataFrame:
        """(bucket, cycle) that are indexed."""
        return self._table("done", "bucket string, cycle int")

    def directory(self) -> DataFrame:
        """(term, shard, min_id, max_id, entries) as they are shown: the last shard of a term is open, with max_id `!`."""
        last = F.max("shard").over(Window.partitionBy("term")) == F.col("shard")
        return self.shards.select("term", "shard", "min_id", F.when(last, OPEN).otherwise(F.col("max_id")).alias("max_id"), "entries")

    def metadata(self) -> DataFrame:
        return index_metadata(self.directory(), self.lookup)

    def _piece(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.pieces)).cast("int")

    def _write(self, rows: DataFrame, name: str, *by: str, dealt: bool = False) -> None:
        """Rows in ranges, so that a frequent term fills several files; folders without rows stay as they are."""
        order = [*by, *(c for c in ("term", "id", "shard") if c in rows.columns and c not in by)]
        rows = (rows if dealt else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"piece": self._piece(F.col("term")), "slot": F.floor(F.col("shard") / self.slot_shards).cast("int")})

    @staticmethod
    def _ranges(postings: DataFrame) -> DataFrame:
        return postings.groupBy("term", "shard", "piece").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("entries")).select("term", "shard", "min_id", "max_id", "entries", "piece")

    # Building and updating

    def build(self, postings: DataFrame, lookup: DataFrame | None = None, done: DataFrame | None = None) -> IndexStore:
        """Write the index of distinct (term, id); what the folder held before is replaced, if it was built before."""
        # Rows are dealt over ranges in the order of the folders, and stay there when they are written.
        rows = shard_postings(postings.select("term", F.col("id").cast("string").alias("id")), self.size, self._piece(F.col("term")))
        self._write(self._placed(rows), "postings", "piece", "slot", dealt=True)
        self._write(self._ranges(self.postings), "shards", "piece")
        if lookup is not None:
            self.store_lookup(lookup)
        if done is not None:
            done.select("bucket", F.col("cycle").cast("int").alias("cycle")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done")
        return self

    def store_lookup(self, lookup: DataFrame) -> None:
        """Write lookup rows by their partition; partitions without rows stay as they are."""
        self._write(lookup.select("id", "name", "city", "state", "employer", "bucket", F.col("years").cast("array<int>").alias("years"), "partition"), "lookup", "partition")

    def update(self, postings: DataFrame) -> None:
        """Add (term, id). Only folders with a changed shard are written; of a term, shards before the first new id stay.

        The added rows that are new, and the rows of changed shards, are written to the shared folder once; nothing is read
        of terms that the batch doesn't have but the other rows of the folders that are written again.
        """
        added = self._placed(postings.select("term", F.col("id").cast("string").alias("id"), F.lit(0).alias("shard"))).select("term", "id", "piece").distinct()
        added = written(added, "added")
        pieces = [r["piece"] for r in added.select("piece").distinct().collect()]  # self.pieces at most
        here = F.col("piece").isin(pieces)
        fresh = written(added.join(self.postings.where(here).select("term", "id", "piece"), ["term", "id", "piece"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return
        # The first shard of a term that changes: the first closed one that does not end before the smallest new id, or else the open one.
        lowest = fresh.groupBy("term", "piece").agg(F.min("id").alias("low"))
        known = self.shards.where(here).join(lowest, ["term", "piece"])
        closed = F.col("entries") == self.size
        first = known.groupBy("term", "piece").agg(F.coalesce(F.min(F.when(F.col("max_id") >= F.col("low"), F.col("shard"))), F.max(F.col("shard") + F.when(closed, 1).otherwise(0))).alias("first"))
        first = written(lowest.select("term", "piece").join(first, ["term", "piece"], "left").select("term", "piece", F.coalesce("first", F.lit(0)).alias("first")), "first")
        tail = self.postings.where(here).join(first, ["term", "piece"]).where("shard >= first").select("term", "id")
        cut = shard_postings(tail.union(fresh.select("term", "id")), self.size)
        changed = written(self._placed(cut.join(first.select("term", "first"), "term").select("term", "id", (F.col("shard") + F.col("first")).alias("shard"))), "changed")
        self._replace(changed, first, here)

    def _replace(self, changed: DataFrame, first: DataFrame, here: Column) -> None:
        """Make the folders that hold changed shards ready, their other rows with the changed ones, and put them in place."""
        touched = changed.select("piece", "slot").distinct()
        stays = self.postings.where(here).join(touched, ["piece", "slot"], "left_semi").join(first, ["term", "piece"], "left").where("first is null or shard < first").select("term", "id", "shard", "piece", "slot")
        rows = stays.unionByName(changed.select("term", "id", "shard", "piece", "slot"))
        old = self.shards.where(here).join(first, ["term", "piece"], "left").where("first is null or shard < first").select("term", "shard", "min_id", "max_id", "entries", "piece")
        ranges = old.unionByName(self._ranges(changed))
        for name, made in (("postings", rows), ("shards", ranges)):
            made.write.mode("overwrite").parquet(f"{self.folder}/_pending/{name}")
        self._finish()

    def _finish(self) -> None:
        """Move what an update has ready into its folders. A driver that died meanwhile leaves it to whoever opens the index next."""
        tables = (("postings", _POSTINGS, ("piece", "slot")), ("shards", _SHARDS, ("piece",)))
        if not exists(self.spark, f"{self.folder}/_pending"):
            return
        if all(exists(self.spark, f"{self.folder}/_pending/{name}/_SUCCESS") for name, _, _ in tables):
            for name, schema, by in tables:
                self._write(self.spark.read.schema(schema).parquet(f"{self.folder}/_pending/{name}"), name, *by)
        remove(self.spark, f"{self.folder}/_pending")

    def update_texts(self, texts: DataFrame) -> None:
        """Add rows (id, bucket, cycle, texts) of buckets and cycles that are not done, and mark these as done."""
        fresh = texts.join(F.broadcast(self.done), ["bucket", "cycle"], "left_anti")  # one row a bucket and cycle
        self.update(tokenize(fresh))
        done = written(self.done.union(fresh.select("bucket", F.col("cycle").cast("int")).distinct()), "done")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done")

    # Searching

    def _of(self, table: DataFrame, words: Sequence[str]) -> DataFrame:
        """Rows of the terms; both comparisons are with constants, which reach folders and files."""
        piece = reduce(lambda a, b: a | b, (F.col("piece") == self._piece(F.lit(t)) for t in words))
        return table.where(piece & F.col("term").isin(list(words)))

    def _plans(self, texts: Sequence[str]) -> dict[str, list[Term]]:
        """The terms of each text in the order in which they are met, rarest first; none if one of them has no entries."""
        asked = self.spark.createDataFrame([(t,) for t in texts], "q string")
        wanted = {r["q"]: r["terms"] for r in asked.select("q", terms(F.array("q")).alias("terms")).collect()}  # the queries' own words
        every = sorted({t for own in wanted.values() for t in own})
        if not every:
            return dict.fromkeys(texts, [])
        sums = self._of(self.shards, every).groupBy("term").agg(F.count("*").alias("shards"), F.sum("entries").alias("entries"), F.min("min_id").alias("low"), F.max("max_id").alias("high"))
        found = {r["term"]: Term(*r) for r in sums.collect()}  # a row a term of the queries
        return {t: sorted((found[w] for w in own), key=lambda x: (x.shards, x.entries, x.term)) if all(w in found for w in own) else [] for t, own in wanted.items()}

    def plan(self, text: str) -> list[tuple[str, int, int]]:
        """(term, shards, entries) of a query's terms in the order in which they are met, rarest first; empty if one of them has none."""
        return [(x.term, x.shards, x.entries) for x in self._plans([text])[text]]

    def _ranges_of(self, term: Term) -> list[tuple[str, str]]:
        """Up to RANGES ranges that hold all ids of the term: those of its shards, neighbours joined."""
        if term.shards == 1:
            return [(term.low, term.high)]
        part = F.floor(F.col("shard") * RANGES / max(term.shards, RANGES)) if term.shards > RANGES else F.col("shard")
        rows = self._of(self.shards, [term.term]).groupBy(part.alias("part")).agg(F.min("min_id").alias("low"), F.max("max_id").alias("high"))
        return [(r["low"], r["high"]) for r in rows.orderBy("part").collect()]

    def match(self, text: str) -> DataFrame:
        """(id): what holds all terms of the query; none for a query without terms."""
        return self._met(self._plans([text])[text])

    def _met(self, order: list[Term]) -> DataFrame:
        if not order:
            return self.spark.createDataFrame([], "id string")
        found = self._of(self.postings, [order[0].term]).select("id")
        if len(order) == 1:
            return found
        ranges = self._ranges_of(order[0])
        meets = self._any(ranges, lambda low, high: (F.col("max_id") >= low) & (F.col("min_id") <= high))
        within = self._any(ranges, lambda low, high: F.col("id").between(low, high))
        for term in order[1:]:
            rows = self._of(self.postings, [term.term])
            if term.shards > self.slot_shards:
                slots = self._of(self.shards, [term.term]).where(meets).select(F.floor(F.col("shard") / self.slot_shards).cast("int").alias("slot")).distinct().collect()
                rows = rows.where(F.col("slot").isin([r["slot"] for r in slots]))  # RANGES and a term's slots at most
            found = rows.where(within).select("id").join(found, "id")
        return found

    @staticmethod
    def _any(ranges: list[tuple[str, str]], test) -> Column:
        made = F.lit(False)
        for low, high in ranges:
            made = made | test(low, high)
        return made

    def status(self, texts: Sequence[str], limit: int = MAX_RESULTS) -> DataFrame:
        """(query, results, status) of each text: OK, NO_RESULTS, or MAX_LENGTH beyond the limit. A single term is counted in the directory."""
        made = None
        for text, order in self._plans(texts).items():
            count = self.spark.createDataFrame([(order[0].entries if order else 0,)], "results long") if len(order) < 2 else self._met(order).agg(F.count("*").alias("results"))
            row = count.select(F.lit(text).alias("query"), "results")
            made = row if made is None else made.union(row)
        return made.withColumn("status", F.when(F.col("results") == 0, "NO_RESULTS").when(F.col("results") > limit, "MAX_LENGTH").otherwise("OK"))

    def search(self, text: str, limit: int = MAX_RESULTS) -> DataFrame:
        """Lookup rows of the query's results, in their order; none beyond the limit."""
        found = written(self.match(text).limit(limit + 1), "found")
        if found.count() > limit:
            found = found.limit(0)
        return result_order(self.rows_of(found))

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """Lookup rows of a table of ids; partitions without any are not read."""
        parts = [r["p"] for r in ids.select(lookup_partition(F.col("id")).alias("p")).distinct().collect()]  # two characters, so few hundred
        return self.lookup.where(F.col("partition").isin(parts)).join(ids.select("id"), "id", "left_semi").select("id", "name", "city", "state", "employer", "bucket", "years", "partition")

    def by_ids(self, ids: Sequence[str]) -> DataFrame:
        """(position, id, ...) in the order of the request; an unknown id gives a row named Unknown. Only the asked rows' files are read."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string").select(canonical_id(F.col("id")).alias("id"))
        known = asked.select("id", lookup_partition(F.col("id")).alias("p")).collect()
        rows = self.lookup.where(F.col("partition").isin(sorted({r["p"] for r in known})) & F.col("id").isin([r["id"] for r in known]))
        return lookup_by_ids(rows.select("id", "name", "city", "state", "employer", "bucket", "years", "partition"), ids)

    def term_entities(self, term: str, limit: int = 200) -> DataFrame:
        """Lookup rows of one term, by id, up to the limit; the term's first shards are all that is read."""
        few = self._of(self.postings, [term]).where((F.col("shard") * self.size < limit) & (F.col("slot") * self.slot_shards * self.size < limit))
        return self.rows_of(few.select("id").orderBy("id").limit(limit))
