"""Keyword search: an inverted index over entities, the lookup of their rows, and queries on both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.codes import MAX_RESULTS, PARTY_NAMES, SHARD_IDS
from sluice.functions.expressions import canonical_id, index_partition, is_entity_id, lookup_partition, state_name, terms
from sluice.sources.shared import written


def _texts() -> Column:
    codes = F.create_map(*[F.lit(x) for pair in PARTY_NAMES.items() for x in pair])
    words = F.when(F.col("bucket") == "individual", F.col("employer")).otherwise(F.coalesce(F.try_element_at(codes, F.col("employer")), F.lit("")))
    return F.array(*(F.coalesce(c, F.lit("")) for c in (F.col("name"), F.col("city"), state_name(F.col("state")), words)))


def search_texts(entities: DataFrame) -> DataFrame:
    """(id, bucket, cycle, texts): what an entity is found by: name, city, state and employer, or its party's name."""
    return entities.select("id", "bucket", "cycle", _texts().alias("texts"))


def tokenize(rows: DataFrame, key: str = "id") -> DataFrame:
    """(term, id), distinct: each row's terms once, before they are shuffled."""
    return tokenize_once(rows, key).distinct()


def tokenize_once(rows: DataFrame, key: str = "id") -> DataFrame:
    """(term, id) of rows with keys of their own, which nothing needs to be shuffled for."""
    return rows.select(F.explode(terms(F.col("texts"))).alias("term"), F.col(key).alias("id"))


def inverted_index(postings: DataFrame) -> DataFrame:
    """(partition, term, ids): sorted distinct ids of each term. For terms with very many ids, see posting_shards."""
    made = postings.groupBy("term").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return made.select(index_partition(F.col("term")).alias("partition"), "term", "ids")


def shard_postings(postings: DataFrame, size: int = SHARD_IDS, lead: Column | None = None) -> DataFrame:
    """(term, id, shard): ids in order, cut every `size`; no term's ids meet in one task.

    Rows are dealt over ranges of (term, id) and written in order, so a frequent term fills ranges of its own. A row's
    rank is its place in its range, less where the term begins there, after what the term has in the ranges before. Only
    terms of more than one shard need it, a row for each `size` postings at most, so that the others are not shuffled again.
    With `lead`, made of the term, terms lie in the order of that first.
    """
    order = ["lead", "term", "id"]
    ordered = postings.select((F.lit(0) if lead is None else lead).alias("lead"), "term", "id").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.select("term", "id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")), "postings")
    sizes = rows.groupBy("term", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    own = Window.partitionBy("term")
    held = sizes.withColumns({"held": F.sum("n").over(own), "before": F.sum("n").over(own.orderBy("range")) - F.col("n")}).where(F.col("held") > size)
    long = written(held.select("term", "range", (F.col("first") - F.col("before")).alias("base")), "long-terms")
    shard = F.coalesce(F.floor((F.col("place") - F.col("base")) / size), F.lit(0)).cast("long")
    return rows.join(long, ["term", "range"], "left").select("term", "id", shard.alias("shard"))


def posting_shards(postings: DataFrame, size: int = SHARD_IDS) -> DataFrame:
    """(term, shard, min_id, max_id, entries); the last shard of a term is open at its end, with max_id `!`."""
    made = shard_postings(postings, size).groupBy("term", "shard").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("entries"))
    last = F.max("shard").over(Window.partitionBy("term")) == F.col("shard")
    return made.select("term", "shard", "min_id", F.when(last, "!").otherwise(F.col("max_id").cast("string")).alias("max_id"), "entries")


def term_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy(index_partition(F.col("term")).alias("partition"), "term").agg(F.count("*").alias("ids"))


def partitions(postings: DataFrame) -> DataFrame:
    return postings.select(index_partition(F.col("term")).alias("partition")).distinct()


def build_lookup(entities: DataFrame) -> DataFrame:
    """(id, name, city, state, employer, bucket, years): attributes of the newest cycle; a row named Unknown gives way to an older one."""
    words = F.struct("name", "city", "state", "employer", "bucket")
    order = F.struct(F.col("name") != "Unknown", "cycle", "bucket")
    made = entities.groupBy("id").agg(F.max_by(words, order).alias("w"), F.sort_array(F.collect_set("cycle"), False).alias("years"))
    return made.select("id", "w.*", "years", lookup_partition(F.col("id")).alias("partition"))


def indexed(entities: DataFrame, active: DataFrame) -> DataFrame:
    """A row for each id with what the index takes of it: its lookup row, all buckets that it is in, and its texts in each of them.

    Attributes are the same in all cycles of `active` (id, cycle); years are collected before they meet them.
    """
    years = active.groupBy("id").agg(F.sort_array(F.collect_set("cycle"), False).alias("years"))
    own = Window.partitionBy("id")
    rows = entities.join(years, "id").withColumn("texts", _texts())
    every = own.orderBy(F.desc(F.col("name") != "Unknown"), F.desc("bucket"))
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each bucket at most
    rows = rows.withColumns({"place": F.row_number().over(every), "texts": F.flatten(F.collect_list("texts").over(whole)), "buckets": F.collect_list("bucket").over(whole)})
    return rows.where("place = 1").select("id", "name", "city", "state", "employer", "bucket", "years", lookup_partition(F.col("id")).alias("partition"), "buckets", "texts")


def index_stats(postings: DataFrame, lookup: DataFrame, size: int = SHARD_IDS) -> DataFrame:
    """One row: terms, postings, shards, lookup rows, cycles."""
    per_term = postings.groupBy("term").agg(F.count("*").alias("n"))
    index = per_term.agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.sum(F.ceil(F.col("n") / size)).cast("long").alias("shards"))
    rows = lookup.agg(F.count("*").alias("lookup_rows"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))), ",").alias("cycles"))
    return index.join(F.broadcast(rows), F.lit(True))  # one row each


def index_metadata(shards: DataFrame, lookup: DataFrame) -> DataFrame:
    """(kind, partition, terms, shards, entries): what each part of the index holds, and each part of the lookup."""
    index = shards.groupBy(index_partition(F.col("term")).alias("partition")).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("shards"), F.sum("entries").alias("entries"))
    rows = lookup.groupBy("partition").agg(F.count("*").alias("entries"))
    zero = F.lit(0).cast("long")
    return index.select(F.lit("index").alias("kind"), "partition", "terms", "shards", "entries").unionByName(rows.select(F.lit("lookup").alias("kind"), "partition", zero.alias("terms"), zero.alias("shards"), "entries"))


def query_terms(spark, text: str) -> DataFrame:
    """The query's terms, by the rules of the index."""
    return spark.createDataFrame([(text,)], "q string").select(F.explode(terms(F.array("q"))).alias("term"))


def match(postings: DataFrame, text: str) -> DataFrame:
    """(id): entities that hold all terms of the query; none for a query without terms."""
    wanted = query_terms(postings.sparkSession, text)
    counted = wanted.agg(F.count("*").alias("wanted"))
    hits = postings.join(F.broadcast(wanted), "term").groupBy("id").agg(F.count_distinct("term").alias("held"))
    return hits.join(F.broadcast(counted), F.col("held") == F.col("wanted")).select("id")


def search(postings: DataFrame, lookup: DataFrame, text: str, limit: int = MAX_RESULTS) -> DataFrame:
    """Lookup rows of the query's results, newest first, then those with most years, then by id; none beyond the limit."""
    found = match(postings, text)
    few = found.limit(limit + 1).agg(F.count("*").alias("results")).where(F.col("results") <= limit).select(F.lit(True).alias("few"))
    return result_order(found.join(F.broadcast(few), F.col("few")).drop("few").join(lookup, "id"))  # one row at most


def result_order(rows: DataFrame) -> DataFrame:
    """Lookup rows as results are shown: newest first, then those with most years, then by id."""
    return rows.orderBy(F.desc(F.col("years")[0]), F.desc(F.size("years")), "id")


def search_status(postings: DataFrame, texts: Sequence[str], limit: int = MAX_RESULTS) -> DataFrame:
    """(query, results, status): OK, NO_RESULTS, or MAX_LENGTH beyond the limit."""
    spark = postings.sparkSession
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    wanted = queries.select("query", F.explode(terms(F.array("query"))).alias("term"))
    need = wanted.groupBy("query").agg(F.count("*").alias("wanted"))
    hits = postings.join(F.broadcast(wanted), "term").groupBy("query", "id").agg(F.count("*").alias("held"))
    full = hits.join(F.broadcast(need), "query").where("held = wanted").groupBy("query").agg(F.count("*").alias("results"))
    made = queries.join(full, "query", "left").select("query", F.coalesce("results", F.lit(0)).alias("results"))
    return made.withColumn("status", F.when(F.col("results") == 0, "NO_RESULTS").when(F.col("results") > limit, "MAX_LENGTH").otherwise("OK"))


def lookup_by_ids(lookup: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(position, id, ...) in the order of the request; an unknown id gives a row named Unknown.

    The lookup is cut to the asked ids first, which are sent to its scan; only their rows meet the request.
    """
    asked = lookup.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "position int, asked string").withColumn("id", canonical_id(F.col("asked"))).drop("asked")
    found = lookup.join(F.broadcast(asked.select("id").distinct()), "id", "left_semi")  # a request's ids
    return asked.join(F.broadcast(found), "id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown"))).orderBy("position")


def missing_ids(lookup: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(lookup, "id", "left_anti")


def term_entities(postings: DataFrame, lookup: DataFrame, term: str, limit: int = 200) -> DataFrame:
    """Lookup rows of one term, by id, up to the limit."""
    found = postings.where(F.col("term") == term).select("id").orderBy("id").limit(limit)
    return found.join(lookup, "id")


def update_index(old: DataFrame, old_done: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and done markers after adding rows (id, bucket, cycle, texts); buckets and cycles that are done are passed over."""
    fresh = texts.join(old_done, ["bucket", "cycle"], "left_anti")
    return old.union(tokenize(fresh)).distinct(), old_done.union(fresh.select("bucket", "cycle").distinct())


def id_queries(texts: DataFrame) -> DataFrame:
    return texts.withColumn("is_id", is_entity_id(F.col("text")))
