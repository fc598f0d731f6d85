"""Registered queries by name; each takes (spark, sf_dir). Lists come as sorted text, so that rows compare in any engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import codes
from sluice.functions import expressions as X
from sluice.operators import edges, graph, ledger, merge, rankings, search, tables, totals
from sluice.operators.index_store import IndexStore
from sluice.operators.serving import ServingTable
from sluice.plans import stored
from sluice.plans.book import Book
from sluice.sources import filings, fixtures
from sluice.sources.shared import new_folder, written
from sluice.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEARCHES = ("customer 000000001", "The Supplier", "supplier#000000007", "the of", "automobile building", "zzz nothing")
TERM = "building"
DOCUMENT_SEARCH = "De La"
VIEWED_COMMITTEE, VIEWED_CANDIDATE, VIEWED_NAME = "C00000003", "S00000085", "Customer#000000007"
MERGED_CYCLES = (1998, 2000)
REACH_ROOTS = ("C00000011", "C00000012")


def query(function: Callable[[Book], DataFrame]) -> Callable[[Book], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Book(spark, sf_dir))
    return function


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


# Scans -----------------------------------------------------------------------------------------------------------


@query
def split_rows(b: Book) -> DataFrame:
    """Fields of lines made of orders, with empty and missing ones."""
    o = fixtures.read(b.spark, b.sf_dir, "orders")
    lines = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit(""), F.col("o_orderstatus"))).otherwise(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(""))).alias("value"))
    v = F.col("value")
    return lines.select("o_orderkey", *(filings.field(v, k).alias(f"f{k}") for k in range(4)), F.size(filings.split_fields(v)).cast("long").alias("fields"))


@query
def scan_candidates(b: Book) -> DataFrame:
    return filings.scan(filings.to_lines(b.candidates, "candidates", {c: c for c in ("cand_id", "name", "party", "pcc", "city", "state")}), "candidates")


@query
def scan_committees(b: Book) -> DataFrame:
    return filings.scan(filings.to_lines(b.committees, "committees", {c: c for c in ("cmte_id", "name", "city", "state", "party")}), "committees")


@query
def scan_campaign_financials(b: Book) -> DataFrame:
    p = fixtures.read(b.spark, b.sf_dir, "part")
    bad = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    lines = filings.to_lines(p, "campaign_financials", {"cand_id": F.col("p_partkey"), "name": F.col("p_name"), "party": F.col("p_brand"), "total_receipts": bad, "indv_conts": F.col("p_size"), "general_pct": F.lit("51.5"), "coverage_end": F.lit("12/31/2000")})
    made = filings.scan(lines, "campaign_financials")
    return made.select("cand_id", "name", "party", F.col("total_receipts").cast("double").alias("total_receipts"), F.col("indv_conts").cast("double").alias("indv_conts"), F.col("general_pct").cast("double").alias("general_pct"), F.col("total_disb").cast("double").alias("total_disb"), F.col("coverage_end").cast("string").alias("coverage_end"))


@query
def scan_committee_financials(b: Book) -> DataFrame:
    s = fixtures.read(b.spark, b.sf_dir, "supplier")
    lines = filings.to_lines(s, "committee_financials", {"cmte_id": F.col("s_suppkey"), "type": F.lit("Q"), "total_receipts": F.col("s_acctbal").cast("decimal(18,2)"), "total_loans": F.lit("12.5x"), "party_exp": F.col("s_nationkey")})
    made = filings.scan(lines, "committee_financials")
    return made.select("cmte_id", "type", *(F.col(c).cast("double").alias(c) for c in ("total_receipts", "total_loans", "party_exp", "debts_owed")))


@query
def scan_contributions(b: Book) -> DataFrame:
    """Two files of one layout."""
    columns = {c: c for c in ("filer_id", "tx_type", "name", "employer", "occupation", "zip", "tx_amt", "other_id", "tx_id", "memo_code")}
    own = b.contributions
    parts = {"itoth": own.where("other_id <> ''"), "itcont": own.where("other_id = ''")}
    made = filings.scan_many({k: filings.to_lines(v, "contributions", columns, "cycle") for k, v in parts.items()}, "contributions", "cycle")
    return made.groupBy("source_file", "cycle", "filer_id", "tx_type", "memo_code").agg(F.sum("tx_amt").cast("double").alias("amt"), F.count("*").alias("txs"), F.min("tx_id").alias("first_tx"), F.max("name").alias("last_name"))


@query
def scan_disbursements(b: Book) -> DataFrame:
    lines = filings.to_lines(b.disbursements, "disbursements", {**{c: c for c in ("cmte_id", "name", "zip", "tx_amt", "sub_id")}, "tx_date": F.lit("02/29/2000")}, "cycle")
    made = filings.scan(lines, "disbursements", "cycle")
    return made.select("cycle", "cmte_id", "name", "zip", F.col("tx_amt").cast("double").alias("tx_amt"), "sub_id", F.col("tx_date").cast("string").alias("tx_date"), "purpose")


@query
def parse_tx_date(b: Book) -> DataFrame:
    o = fixtures.read(b.spark, b.sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMddyyyy").alias("digits"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("slashes"))
    bad = F.when(F.col("o_orderkey") % 7 == 0, "13452000").otherwise(F.col("digits"))
    return o.select("o_orderkey", X.filing_date(bad).cast("string").alias("tx_date"), X.filing_date(F.col("slashes"), "MM/dd/yyyy").cast("string").alias("paid"))


@query
def numeric_coercion(b: Book) -> DataFrame:
    c = fixtures.read(b.spark, b.sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("t"))
    text = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, F.concat("t", F.lit("x"))).otherwise(F.col("t"))
    return c.select("c_custkey", X.money(text).cast("double").alias("amount"))


# Ledger ----------------------------------------------------------------------------------------------------------


@query
def identity_keys(b: Book) -> DataFrame:
    c = b.contributions.select("name", "employer", "occupation", "zip").distinct()
    return c.select("*", X.person_key(F.col("name"), F.col("employer"), F.col("occupation"), F.col("zip")).alias("indv_id"), X.organisation_key(F.col("name"), F.col("zip")).alias("org_id"))


@query
def earmark_rewrite(b: Book) -> DataFrame:
    return b.ledger.groupBy("cycle", "filer_id", "tx_type", "bucket").agg(F.count("*").alias("txs"), F.sum("tx_amt").cast("double").alias("amt"))


@query
def id_bucket(b: Book) -> DataFrame:
    return b.ledger.select("other_id", "bucket").distinct()


@query
def classify_tx(b: Book) -> DataFrame:
    return b.ledger.groupBy("tx_type", "bucket", "incoming", "transfer", "contribution", "is_memo", "counted").agg(F.count("*").alias("txs"), F.sum("tx_amt").cast("double").alias("amt"))


@query
def resolve_filers(b: Book) -> DataFrame:
    return b.filers


@query
def resolve_counterparties(b: Book) -> DataFrame:
    return ledger.resolve_counterparties(b.ledger, b.filers, b.candidates)


@query
def individuals_dim(b: Book) -> DataFrame:
    return b.people


@query
def individuals_kept(b: Book) -> DataFrame:
    """Persons after two loads, the first of the later cycles: known ones stay as the first load named them."""
    named = ledger.named_persons(b.ledger, b.expenses)
    early = ledger.named_persons(b.ledger.where("cycle > 1998"), b.expenses.where("cycle > 1998"))
    table = ServingTable(b.spark, new_folder(b.spark, "people"), named.drop("tx_key").schema, "indv_id")
    for load in (early, named):
        table.insert_new(load, order=["tx_key"])
    return table.rows


@query
def unresolved_tx(b: Book) -> DataFrame:
    rows = ledger.unresolved(b.ledger, b.committees, b.candidates)
    return rows.groupBy("side", "cycle", "filer_id", "other_id").agg(F.count("*").alias("txs"), F.sum("tx_amt").cast("double").alias("amt"))


# Totals ----------------------------------------------------------------------------------------------------------


@query
def cmte_incoming(b: Book) -> DataFrame:
    made = totals.committee_totals(totals.committee_postings(b.ledger.where("incoming")))
    return made.select("cycle", "cmte_id", *(f"{p}_{n}" for p in ("contributions", "other", "total_in") for n in ("amt", "txs", "avg")))


@query
def cmte_outgoing(b: Book) -> DataFrame:
    made = totals.committee_totals(totals.committee_postings(b.ledger.where("not incoming")))
    return made.select("cycle", "cmte_id", *(f"{p}_{n}" for p in ("transfers", "expenditures", "total_out") for n in ("amt", "txs", "avg")))


@query
def cmte_opex(b: Book) -> DataFrame:
    made = totals.committee_totals(totals.committee_postings(b.ledger.where("false"), b.expenses))
    return made.select("cycle", "cmte_id", *(f"{p}_{n}" for p in ("expenditures", "total_out") for n in ("amt", "txs", "avg")))


@query
def cmte_tx_data(b: Book) -> DataFrame:
    return b.committee_totals


@query
def individual_totals(b: Book) -> DataFrame:
    return b.individual_totals


@query
def candidate_direct_totals(b: Book) -> DataFrame:
    return b.candidate_totals


@query
def candidate_affiliates(b: Book) -> DataFrame:
    return totals.candidate_affiliates(b.ledger, b.candidates).select("cycle", "cand_id", joined("affiliates"))


@query
def individual_tx_list(b: Book) -> DataFrame:
    return totals.individual_transactions(b.ledger).select("cycle", "indv_id", joined("transactions"))


@query
def cmte_transfer_list(b: Book) -> DataFrame:
    return totals.committee_transfers(b.ledger).select("cycle", "cmte_id", joined("transactions"))


@query
def individual_tx_rows(b: Book) -> DataFrame:
    """The same as rows, in shards."""
    return totals.transaction_rows(b.ledger, "individual")


@query
def cmte_transfer_rows(b: Book) -> DataFrame:
    return totals.transaction_rows(b.ledger, "committee")


# Edges -----------------------------------------------------------------------------------------------------------

for _query, _list in {
    "edges_indv_recipients": "indv_recipients", "edges_indv_senders": "indv_senders", "edges_cand_recipients": "cand_recipients", "edges_cand_senders": "cand_senders",
    "edges_transfer_recipients": "transfer_recipients", "top_indv_contributors": "top_indv_contributors", "top_cmte_contributors": "top_cmte_contributors", "top_exp_recipients": "top_exp_recipients",
}.items():
    QUERIES[_query] = lambda spark, sf_dir, name=_list: edges.edge_list(Book(spark, sf_dir).edges, name)


@query
def counterparty_averages(b: Book) -> DataFrame:
    return edges.counterparty_averages(b.edges)


@query
def sorted_counterparties(b: Book) -> DataFrame:
    """Counterparties of each owner as one text, largest first."""
    rows = edges.edge_list(b.edges, "top_cmte_contributors")
    made = rows.groupBy("cycle", "owner_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cp_id"))).alias("l"))
    return made.select("cycle", "owner_id", F.array_join(F.col("l.cp_id"), ",").alias("counterparties"))


# Rankings --------------------------------------------------------------------------------------------------------


@query
def entry_top_committees(b: Book) -> DataFrame:
    """The ten committees with most money received, by cycle, over all parties."""
    ranks = rankings.rankings(b.committee_measures.where("category = 'rec'"), 10).where("party = 'ALL'")
    return rankings.enrich(ranks, b.filers.withColumnRenamed("cmte_id", "id"))


@query
def party_bucket(b: Book) -> DataFrame:
    rows = b.committees.select(F.col("cmte_id").alias("id"), "party").union(b.candidates.select("cand_id", "party"))
    return rows.select("id", "party", X.party_bucket(F.col("party")).alias("party_bucket"))


@query
def party_names(b: Book) -> DataFrame:
    names = codes.code_table(b.spark, codes.PARTY_NAMES, "party", "party_name")
    return b.candidates.select("cand_id", "party").join(F.broadcast(names), "party", "left").select("cand_id", "party", F.coalesce("party_name", F.lit("")).alias("party_name"))


@query
def committee_codes(b: Book) -> DataFrame:
    s = fixtures.read(b.spark, b.sf_dir, "supplier")
    pick = lambda text, n: F.substring(F.lit(text), (F.col("s_suppkey") % n + 1).cast("int"), F.lit(1))
    rows = s.select("s_suppkey", pick("ABDJPUX", 7).alias("designation"), pick("CLMTVWX", 7).alias("org_type"))
    rows = rows.join(F.broadcast(codes.code_table(b.spark, codes.DESIGNATIONS, "designation", "designation_name")), "designation", "left")
    rows = rows.join(F.broadcast(codes.code_table(b.spark, codes.ORGANISATIONS, "org_type", "org_name")), "org_type", "left")
    return rows.select("s_suppkey", "designation", "org_type", F.coalesce("designation_name", F.lit("")).alias("designation_name"), F.coalesce("org_name", F.lit("")).alias("org_name"))


@query
def candidate_codes(b: Book) -> DataFrame:
    rows = b.candidates.select("cand_id", F.substring("cand_id", 1, 1).alias("office"))
    return rows.join(F.broadcast(codes.code_table(b.spark, codes.OFFICES, "office", "office_name")), "office", "left")


@query
def candidate_pcc_totals(b: Book) -> DataFrame:
    return b.pcc_totals


@query
def entity_measures(b: Book) -> DataFrame:
    return b.measures


@query
def rankings_cmte(b: Book) -> DataFrame:
    return rankings.rankings(b.committee_measures)


@query
def rankings_indv(b: Book) -> DataFrame:
    return rankings.rankings(b.individual_measures)


@query
def rankings_cand(b: Book) -> DataFrame:
    return rankings.rankings(b.candidate_measures)


@query
def rankings_preview(b: Book) -> DataFrame:
    return rankings.preview(b.rankings)


@query
def rankings_clip(b: Book) -> DataFrame:
    return rankings.clip(b.rankings)


@query
def ranking_threshold(b: Book) -> DataFrame:
    rows = edges.ranked(b.edges.where("list_name = 'top_indv_contributors'"), codes.COUNTERPARTY_LIMIT, "cycle", "owner_id")
    made = rankings.threshold(rows, codes.COUNTERPARTY_LIMIT, "cycle", "owner_id")
    return made.select("cycle", "owner_id", "cp_id", F.col("amt").cast("double").alias("amt"), "from_end")


@query
def ranking_grid(b: Book) -> DataFrame:
    return rankings.grid_sizes(rankings.grid(b.spark, b.cycles), b.rankings)


@query
def ranking_labels(b: Book) -> DataFrame:
    return rankings.labels(rankings.lists_of(b.measures))


@query
def yearly_totals(b: Book) -> DataFrame:
    return b.yearly_totals


@query
def view_yearly_totals(b: Book) -> DataFrame:
    return rankings.shown_totals(b.yearly_totals, 1998, "rec")


@query
def all_time_totals(b: Book) -> DataFrame:
    return rankings.yearly_totals(rankings.all_time(b.committee_measures))


@query
def all_time_rankings(b: Book) -> DataFrame:
    return rankings.rankings(rankings.all_time(b.measures))


@query
def enrich_rankings(b: Book) -> DataFrame:
    return rankings.enrich(rankings.rankings(b.committee_measures.where("category = 'exp'")), b.entities)


@query
def ranking_entities(b: Book) -> DataFrame:
    ids = b.rankings.select(F.col("entity_id").alias("id")).distinct()
    return b.entities.join(ids, "id", "left_semi")


# Several cycles --------------------------------------------------------------------------------------------------


@query
def merge_individual_years(b: Book) -> DataFrame:
    return merge.merge_in_out(b.individual_totals, "indv_id", MERGED_CYCLES)


@query
def merge_committee_years(b: Book) -> DataFrame:
    return merge.merge_committees(b.committee_totals, MERGED_CYCLES)


@query
def merge_candidate_years(b: Book) -> DataFrame:
    return merge.merge_in_out(b.candidate_totals, "cand_id", MERGED_CYCLES)


@query
def merge_tx_lists(b: Book) -> DataFrame:
    return merge.merge_transactions(totals.individual_transactions(b.ledger), "indv_id", MERGED_CYCLES).select("indv_id", joined("transactions"))


@query
def merge_edges_years(b: Book) -> DataFrame:
    return merge.merge_edges(b.edges, MERGED_CYCLES).withColumn("amt", F.col("amt").cast("double"))


@query
def merge_top_edges(b: Book) -> DataFrame:
    return merge.top_merged(merge.merge_edges(b.edges, MERGED_CYCLES)).withColumn("amt", F.col("amt").cast("double"))


# Search ----------------------------------------------------------------------------------------------------------


@query
def search_terms(b: Book) -> DataFrame:
    return b.search_texts.select("id", "bucket", "cycle", F.array_join("texts", "|").alias("texts"))


@query
def tokenize(b: Book) -> DataFrame:
    return b.postings


@query
def index_partitions(b: Book) -> DataFrame:
    return search.partitions(b.document_postings)


@query
def lookup_partition(b: Book) -> DataFrame:
    return b.entities.select("id", X.lookup_partition(F.col("id")).alias("partition"))


@query
def is_entity_id(b: Book) -> DataFrame:
    texts = b.entities.select(F.lower("id").alias("text")).union(b.entities.select(F.col("name"))).distinct()
    return search.id_queries(texts).withColumn("canonical", X.canonical_id(F.col("text")))


@query
def inverted_index(b: Book) -> DataFrame:
    return search.inverted_index(b.postings).select("partition", "term", joined("ids"))


@query
def posting_rows(b: Book) -> DataFrame:
    """The index in long form: a row for each term and id, with its shard."""
    return stored.entity_index(b).postings.select("term", "shard", "id")


@query
def lookup_overlay(b: Book) -> DataFrame:
    """Stored lookup rows after those of committees are overlaid by newer ones, twice."""
    lookup = written(b.lookup, "lookup-rows")
    table = ServingTable(b.spark, new_folder(b.spark, "lookup"), lookup.schema, "id").write(lookup)
    for _ in range(2):
        table.upsert(lookup.where("bucket = 'committee'").withColumn("city", F.lit("MOVED")))
    return table.rows.withColumn("years", joined("years"))


@query
def posting_shards(b: Book) -> DataFrame:
    return search.posting_shards(b.postings)


@query
def document_shards(b: Book) -> DataFrame:
    """Shards of the terms of whole documents, from the directory of the stored index; ids in text order."""
    return stored.document_index(b).directory()


@query
def term_frequencies(b: Book) -> DataFrame:
    return search.term_frequencies(b.document_postings)


@query
def build_lookup(b: Book) -> DataFrame:
    return b.lookup.withColumn("years", joined("years"))


@query
def index_stats(b: Book) -> DataFrame:
    return search.index_stats(b.postings, b.lookup)


@query
def index_update(b: Book) -> DataFrame:
    """Postings after the first two cycles are stored, and all of them are added: equal to one build."""
    return _updated_index(b).postings.select("term", "id")


@query
def index_update_shards(b: Book) -> DataFrame:
    """The directory of shards after the same update."""
    return _updated_index(b).directory()


def _updated_index(b: Book) -> IndexStore:
    """An index of the first two cycles to which the texts of all cycles are added, twice."""
    def make(folder: str) -> IndexStore:
        texts = written(b.search_texts, "texts")
        old = texts.where("cycle <= 1998")
        made = IndexStore(b.spark, folder).build(search.tokenize(old), done=old.select("bucket", "cycle").distinct())
        for _ in range(2):
            made.update_texts(texts)
        return made

    return stored.once(b, "updated-index", make)


@query
def search_keywords(b: Book) -> DataFrame:
    return stored.entity_index(b).search(SEARCHES[0]).withColumn("years", joined("years"))


@query
def search_status(b: Book) -> DataFrame:
    return stored.entity_index(b).status(SEARCHES)


@query
def search_documents(b: Book) -> DataFrame:
    """Documents that hold all terms of a query, from the stored index."""
    return stored.document_index(b).match(DOCUMENT_SEARCH).select(F.col("id").cast("long").alias("id"))


@query
def search_order(b: Book) -> DataFrame:
    """Terms of the queries in the order in which their postings are met: fewest shards first, then fewest entries."""
    index = stored.entity_index(b)
    rows = [(text, place, *one) for text in SEARCHES for place, one in enumerate(index.plan(text))]
    return b.spark.createDataFrame(rows, "query string, place int, term string, shards long, entries long")


@query
def lookup_by_ids(b: Book) -> DataFrame:
    return stored.entity_index(b).by_ids(["c00000007", "C00000001", "nothing", "C90000001"]).withColumn("years", joined("years"))


@query
def missing_lookup_ids(b: Book) -> DataFrame:
    asked = b.ledger.select(F.col("other_id").alias("id")).union(b.committees.select(F.concat("cmte_id", F.lit("X"))))
    return search.missing_ids(b.known_ids, asked)


@query
def term_entities(b: Book) -> DataFrame:
    return stored.entity_index(b).term_entities(TERM).withColumn("years", joined("years"))


# Graph -----------------------------------------------------------------------------------------------------------


@query
def direct_pct(b: Book) -> DataFrame:
    return graph.shares(b.edges, b.committee_totals)


@query
def total_pct(b: Book) -> DataFrame:
    """Every committee's total ownership of every other, in every cycle, over all simple paths."""
    weighted = written(graph.shares(b.edges, b.committee_totals).where(X.entity_bucket(F.col("src")) == "committee"), "shares")
    return graph.total_share(weighted, weighted.select("cycle", F.col("src").alias("source")).distinct())


@query
def graph_edges(b: Book) -> DataFrame:
    return graph.flow_edges(b.edges, graph.received(b.committee_totals, b.individual_totals, b.candidate_totals))


@query
def graph_nodes(b: Book) -> DataFrame:
    return graph.nodes(graph.flows(b.edges), b.candidates)


@query
def graph_reach(b: Book) -> DataFrame:
    """All that money of two committees can have reached, over edges of every type, apart for each cycle."""
    return graph.reach(graph.flows(b.edges), REACH_ROOTS, keys=["cycle"])


# Tables ----------------------------------------------------------------------------------------------------------


@query
def keyed_upsert(b: Book) -> DataFrame:
    """Stored committees after an upsert, which is done twice."""
    new = b.committees.where("party = 'REP'").withColumn("city", F.lit("MOVED"))
    table = ServingTable(b.spark, new_folder(b.spark, "committees"), b.committees.schema, "cmte_id").write(b.committees)
    for _ in range(2):
        table.upsert(new)
    return table.rows


@query
def insert_new_keys(b: Book) -> DataFrame:
    return tables.insert_new_keys(b.committees, b.filers.drop("registered").withColumn("name", F.upper("name")), "cmte_id")


@query
def get_object(b: Book) -> DataFrame:
    return stored.committee_table(b).get("C00000003", cycle=1998).select("cycle", "cmte_id", "total_in_amt", "total_out_amt", "net_balance")


@query
def batch_get_found(b: Book) -> DataFrame:
    return tables.batch_get(b.committees, b.ledger.select(F.col("other_id").alias("cmte_id")), "cmte_id")[0]


@query
def batch_get_missing(b: Book) -> DataFrame:
    return tables.batch_get(b.committees, b.ledger.where("bucket = 'committee'").select(F.col("other_id").alias("cmte_id")), "cmte_id")[1]


@query
def keyset_page(b: Book) -> DataFrame:
    return tables.keyset_page(b.filers, "cmte_id", "C00000005", 25)


@query
def keyset_next(b: Book) -> DataFrame:
    return tables.next_key(tables.keyset_page(b.filers, "cmte_id", "C00000005", 25), "cmte_id", 25)


@query
def bucket_counts(b: Book) -> DataFrame:
    return tables.bucket_counts(b.entities)


@query
def read_defaults(b: Book) -> DataFrame:
    return tables.read_defaults(b.candidates, {"party": "???", "state": "???", "pcc": "0000"})


@query
def drop_cycle(b: Book) -> DataFrame:
    return tables.without(b.yearly_totals, (F.col("cycle") == 1998) & (F.col("category") == "rec"))


@query
def export_serving(b: Book) -> DataFrame:
    kept = b.committee_totals.join(b.filers.select("cmte_id", "party"), "cmte_id").select("cycle", "cmte_id", "party", "total_in_amt", "total_out_amt")
    return tables.serving_rows(kept, F.col("party"), "cmte_id")


@query
def export_index(b: Book) -> DataFrame:
    return tables.export_index(search.posting_shards(b.postings)).select("pk", "sk", "term", "shard", "entries")


@query
def export_lookup(b: Book) -> DataFrame:
    return tables.export_lookup(b.lookup).select("pk", "sk", "id", "name")


@query
def export_top_individuals(b: Book) -> DataFrame:
    ranks = rankings.rankings(b.individual_measures, 50)
    return tables.ranked_individuals(b.people, ranks, "indv_id")


@query
def incremental_totals(b: Book) -> DataFrame:
    """Totals of two overlapping batches of expenses; rows of both count once."""
    d = b.disbursements.select("cycle", "cmte_id", "sub_id", "tx_amt")
    first, second = d.where("sub_id % 3 <> 2"), d.where("sub_id % 3 <> 0")
    stored = first.groupBy("cycle", "cmte_id").agg(F.sum("tx_amt").alias("amt"), F.count("*").alias("txs"))
    return ingest.add_totals(stored, second, ["cycle", "cmte_id"], first, "sub_id").withColumn("amt", F.col("amt").cast("double"))


@query
def stream_ingest(b: Book) -> DataFrame:
    """Events loaded as a file stream and summed by user; a second run over the same files adds nothing."""
    events = fixtures.read(b.spark, b.sf_dir, "events").select("event_id", "user_id", "value")
    root = new_folder(b.spark, "stream")
    events.repartition(4, "user_id").write.parquet(f"{root}/in")
    for _ in range(2):
        ingest.ingest(b.spark, f"{root}/in", events.schema, f"{root}/out", f"{root}/checkpoint", "event_id", 2)
    rows = ingest.stored_rows(b.spark, f"{root}/out")
    return rows.groupBy("user_id").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"))


@query
def streamed_ledger(b: Book) -> DataFrame:
    """Rows and money of what was loaded from growing files, by kind and cycle."""
    book, paid = stored.streamed(b).stored()
    rows = book.select(F.lit("contributions").alias("kind"), "cycle", "tx_amt").union(paid.select(F.lit("disbursements"), "cycle", "tx_amt"))
    return rows.groupBy("kind", "cycle").agg(F.count("*").alias("txs"), F.sum("tx_amt").cast("double").alias("amt"))


@query
def streamed_committee_totals(b: Book) -> DataFrame:
    return stored.streamed(b).rollup.committee_totals()


@query
def streamed_individual_totals(b: Book) -> DataFrame:
    return stored.streamed(b).rollup.individual_totals()


@query
def streamed_candidate_totals(b: Book) -> DataFrame:
    return stored.streamed(b).rollup.candidate_totals()


@query
def streamed_lists(b: Book) -> DataFrame:
    """All eight lists, limited ones with the ranks that each run gave the owners that it met."""
    return stored.streamed(b).rollup.lists().withColumn("amt", F.col("amt").cast("double"))


# Profiles --------------------------------------------------------------------------------------------------------


def _shown(b: Book, owner: str, *names: str) -> DataFrame:
    """Lists of one owner with the names of the counterparties."""
    rows = written(edges.edges_of(b.ledger, b.expenses, owner, names), "shown")
    asked = written(rows.select(F.col("cp_id").alias("id")).distinct(), "asked")
    words = b.entities_of(asked).select(F.col("id").alias("cp_id"), F.col("name").alias("cp_name"))
    return rows.join(words, "cp_id", "left").select("cycle", "list_name", "owner_id", "cp_id", F.coalesce("cp_name", F.lit("Unknown")).alias("cp_name"), "amt", "txs", X.ratio(F.col("amt").cast("decimal(28,2)"), F.col("txs")).alias("avg_amt"))


@query
def view_committee(b: Book) -> DataFrame:
    """A committee's four lists beside its totals."""
    made = _shown(b, VIEWED_COMMITTEE, "top_indv_contributors", "top_cmte_contributors", "transfer_recipients", "top_exp_recipients")
    rows = totals.committee_postings(b.ledger, b.expenses).where(F.col("cmte_id") == VIEWED_COMMITTEE)
    own = totals.committee_totals(rows).select("cycle", "total_in_amt", "total_out_amt", "net_balance")
    names = b.filers.where(F.col("cmte_id") == VIEWED_COMMITTEE).select(F.col("cmte_id").alias("owner_id"), "name", "party")
    return made.join(own, "cycle").join(names, "owner_id")


@query
def view_candidate(b: Book) -> DataFrame:
    """A candidate's two lists beside the direct totals."""
    made = _shown(b, VIEWED_CANDIDATE, "cand_recipients", "cand_senders")
    own = b.candidate_totals.where(F.col("cand_id") == VIEWED_CANDIDATE).select("cycle", "in_amt", "out_amt", "net_balance")
    return made.join(own, "cycle", "left")


@query
def view_candidate_profile(b: Book) -> DataFrame:
    """Candidates' own rows by cycle: name, party, office, state, direct totals and those that their principal committee stands for."""
    offices = codes.code_table(b.spark, codes.OFFICES, "office", "office_name")
    who = b.candidates.select("cand_id", "name", "party", "city", "state", "pcc", F.substring("cand_id", 1, 1).alias("office")).join(F.broadcast(offices), "office", "left")
    direct = b.candidate_totals.select("cycle", "cand_id", "in_amt", "out_amt", "net_balance")
    shown = b.pcc_totals.select("cycle", "cand_id", "rec", "donor", "exp")
    zero = F.lit(0.0)
    rows = who.join(shown, "cand_id").join(direct, ["cycle", "cand_id"], "left")
    return rows.select("cycle", "cand_id", "name", "party", F.coalesce("office_name", F.lit("")).alias("office_name"), "city", "state", "pcc", *(F.coalesce(c, zero).alias(c) for c in ("in_amt", "out_amt", "net_balance")), "rec", "donor", "exp")


@query
def view_individual(b: Book) -> DataFrame:
    """Lists and totals of all persons of one name."""
    who = b.contributions.where("name = 'Customer#000000007'").select(X.organisation_key(F.col("name"), F.col("zip")).alias("owner_id")).distinct()
    rows = b.edges.where("list_name in ('indv_recipients', 'indv_senders')").join(who, "owner_id", "left_semi")
    names = b.filers.select(F.col("cmte_id").alias("cp_id"), F.col("name").alias("cp_name"))
    own = b.individual_totals.select("cycle", F.col("indv_id").alias("owner_id"), "in_amt", "out_amt", "net_balance")
    made = rows.join(names, "cp_id", "left").join(own, ["cycle", "owner_id"], "left")
    return made.select("cycle", "owner_id", "list_name", "cp_id", "cp_name", F.col("amt").cast("double").alias("amt"), "txs", "in_amt", "out_amt", "net_balance")


@query
def profile_committee(b: Book) -> DataFrame:
    """A committee by its id over two cycles, from stored tables."""
    return stored.profiles(b).committee(VIEWED_COMMITTEE, MERGED_CYCLES)


@query
def profile_candidate(b: Book) -> DataFrame:
    """A candidate by id over two cycles, from stored tables."""
    return stored.profiles(b).candidate(VIEWED_CANDIDATE, MERGED_CYCLES)


@query
def profile_individual(b: Book) -> DataFrame:
    """A person by id over two cycles, from stored tables; the id is that of the first person of a name."""
    made = stored.profiles(b)
    found = made.tables["entities"].rows.where((F.col("bucket") == "individual") & (F.col("name") == VIEWED_NAME)).agg(F.min("id")).first()[0]
    return made.individual(found or "", MERGED_CYCLES)


# Files, saved tables and exports ---------------------------------------------------------------------------------


@query
def read_filing_files(b: Book) -> DataFrame:
    """Disbursements written as text files by cycle, and read back from them."""
    columns = {c: c for c in ("cmte_id", "name", "zip", "tx_amt", "sub_id")}
    folder = new_folder(b.spark, "filings")
    filings.write_lines(filings.to_lines(b.disbursements, "disbursements", columns, "cycle"), folder)
    made = filings.scan(filings.read_lines(b.spark, folder), "disbursements", "cycle")
    return made.select("cycle", "cmte_id", "name", "zip", F.col("tx_amt").cast("double").alias("tx_amt"), "sub_id", "category")


@query
def year_gates(b: Book) -> DataFrame:
    """Lines by file and cycle, for the cycles in which a file is published."""
    lines = {"contributions": b.contributions, "disbursements": b.disbursements, "committee_financials": totals.cycle_seeds(b.committees, "cmte_id", b.cycles)}
    parts = [filings.published(rows.select("cycle"), file).groupBy("cycle").agg(F.count("*").alias("lines")).withColumn("file", F.lit(file)) for file, rows in lines.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def get_years(b: Book) -> DataFrame:
    return stored.committee_table(b).get(VIEWED_COMMITTEE, cycle=list(MERGED_CYCLES)).select("cycle", "cmte_id", "total_in_amt", "total_out_amt", "net_balance")


@query
def saved_rankings(b: Book) -> DataFrame:
    """Rankings of committees saved by cycle, one cycle saved again, and a cycle's list of one category loaded."""
    ranks = rankings.rankings(b.committee_measures)
    folder = new_folder(b.spark, "rankings")
    tables.save(ranks, folder, "cycle", "category")
    saved = tables.load(b.spark, folder, ranks.schema, cycle=1998, category="rec")
    tables.save(written(saved, "one-list"), folder, "cycle", "category")
    return tables.load(b.spark, folder, ranks.schema, cycle=1998).select(*ranks.columns)


@query
def saved_yearly_totals(b: Book) -> DataFrame:
    """Yearly totals saved and loaded."""
    made, folder = b.yearly_totals, new_folder(b.spark, "totals")
    tables.save(made, folder, "cycle")
    return tables.load(b.spark, folder, made.schema).select(*made.columns)


@query
def get_caches(b: Book) -> DataFrame:
    """Previews, full lists and yearly totals in one answer: (kind, id, rank, entity_id, total)."""
    ranks = written(b.rankings, "rankings")
    columns = ("ranking_id", "rank", "entity_id", "total")
    lists = rankings.preview(ranks).select(F.lit("preview").alias("kind"), *columns).union(ranks.select(F.lit("list"), *columns))
    sums = b.yearly_totals.select(F.lit("total"), "total_id", F.lit(0), F.lit(""), "total")
    return lists.union(sums).withColumnRenamed("ranking_id", "id")


@query
def export_entities(b: Book) -> DataFrame:
    """Every entity under its bucket and id."""
    return tables.serving_rows(b.entities, F.col("bucket"), "id").select("pk", "sk", "name", "city", "state", "employer")


@query
def export_rankings(b: Book) -> DataFrame:
    """Entries of the rankings under their list and rank."""
    return tables.serving_rows(b.rankings.withColumn("place", F.lpad(F.col("rank").cast("string"), 6, "0")), F.col("ranking_id"), "place").select("pk", "sk", "entity_id", "total")


@query
def export_totals(b: Book) -> DataFrame:
    """Yearly totals under their cycle."""
    return tables.serving_rows(b.yearly_totals, F.col("cycle").cast("string"), "total_id").select("pk", "sk", "category", "party", "total")


@query
def export_index_metadata(b: Book) -> DataFrame:
    return search.index_metadata(search.posting_shards(b.postings), b.lookup)


@query
def missing_item_log(b: Book) -> DataFrame:
    """Ids that two rounds of lookups missed, from a log that both were added to, the second twice."""
    folder = new_folder(b.spark, "missing")
    asked = b.ledger.select(F.col("other_id").alias("id"), "cycle")
    missing = written(search.missing_ids(b.known_ids, asked.select("id").union(b.committees.select(F.concat("cmte_id", F.lit("X"))))), "asked")
    tables.append_log(missing, folder, 0)
    late = search.missing_ids(b.known_ids, b.committees.select(F.concat("cmte_id", F.lit("Y")).alias("id")))
    for _ in range(2):
        tables.append_log(late, folder, 1)
    return b.spark.read.schema("id string, batch int").parquet(folder).groupBy("id").agg(F.count("*").alias("times"), F.min("batch").alias("first_batch"))
