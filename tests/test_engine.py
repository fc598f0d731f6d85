"""The money-flow engine on hand-made rows, and its invariants on the smallest tables."""

import decimal
import itertools
import math

import pytest
from pyspark.sql import functions as F

from sluice.functions import expressions as X
from sluice.operators import edges, graph, ledger, merge, rankings, search, tables, totals
from sluice.plans.book import Book
from sluice.sources import filings
from sluice.streaming import ingest

SF = "/root/testdata/sf0.001"
PERSON = ("DOE, JO", "ACME", "CLERK", "12345")


@pytest.fixture(scope="module")
def book(spark):
    return Book(spark, SF)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def contribution(filer, kind, other, amount, memo="", person=PERSON, tx="1", cycle=2000):
    return (cycle, filer, kind, memo, other, *person, decimal.Decimal(amount), tx)


def ledger_of(spark, *rows):
    schema = "cycle int, filer_id string, tx_type string, memo_code string, other_id string, name string, employer string, occupation string, zip string, tx_amt decimal(18,2), tx_id string"
    return ledger.classify(ledger.normalize(spark.createDataFrame(list(rows), schema)))


def test_split_rows(spark):
    lines = spark.createDataFrame([("test0|test1|test2|test3",), ("test0|test1|test2",), ("test0||test2|test3",), ("|||",), ('a"b|c',)], "value string")
    got = [tuple(r) for r in lines.select(*(filings.field(F.col("value"), k) for k in range(4))).collect()]
    assert got == [("test0", "test1", "test2", "test3"), ("test0", "test1", "test2", ""), ("test0", "", "test2", "test3"), ("", "", "", ""), ('a"b', "c", "", "")]


def test_scan_candidates_keeps_quotes_and_empty_fields(spark):
    lines = spark.createDataFrame([('H0XX01001|DOE, JANE A "JAY" JR|DEM|2008|XX|H|05||P|C00000101|PO BOX 1||TOWNSVILLE|XX|35804',), ("S0XX00003|POE, PAT||2018|XX|S",)], "value string")
    first, second = filings.scan(lines, "candidates").collect()
    assert (first.name, first.pcc, first.city) == ('DOE, JANE A "JAY" JR', "C00000101", "TOWNSVILLE")
    assert (second.party, second.pcc, second.state) == ("", "", "")


def test_earmarks_are_rewritten_before_persons_are_named(spark):
    got = ledger_of(spark, contribution("C1", "24I", "C2", "5"), contribution("C1", "24I", "", "5", tx="2"), contribution("C1", "15E", "C9", "5", tx="3"), contribution("C1", "15", "C9", "5", tx="4"))
    by = {r.tx_id: r for r in got.collect()}
    assert (by["1"].filer_id, by["1"].tx_type, by["1"].bucket) == ("C2", "15E", "individual")
    assert (by["2"].filer_id, by["2"].tx_type) == ("C1", "15E")
    assert by["3"].bucket == "individual" and by["4"].bucket == "committee"


def test_identity_depends_on_occupation(spark):
    a = ledger_of(spark, contribution("C1", "15", "", "5"), contribution("C1", "15", "", "5", person=("DOE, JO", "ACME", "", "12345"))).collect()
    b = ledger_of(spark, contribution("C1", "15", "", "5", person=("DOE, JO", "OTHER", "", "12345"))).collect()
    assert a[0].other_id != a[1].other_id and a[1].other_id == b[0].other_id and len(a[0].other_id) == 32


@pytest.mark.parametrize(
    ("kind", "incoming", "transfer", "contribution_", "counted"),
    [("10", True, False, True, True), ("15Z", True, True, True, True), ("16R", True, True, False, True), ("17R", True, True, False, True), ("18", True, False, False, True), ("18G", True, True, True, True), ("20Y", False, False, False, True), ("24K", False, True, False, True), ("24T", False, False, False, False), ("30K", True, True, True, True), ("33", False, False, False, True)],
)
def test_types_are_classified_as_text(spark, kind, incoming, transfer, contribution_, counted):
    r = ledger_of(spark, contribution("C1", kind, "C2", "1")).first()
    assert (r.incoming, r.transfer, r.contribution, r.counted) == (incoming, transfer, contribution_, counted)


def test_long_ids_are_individuals(spark):
    ids = spark.createDataFrame([("C" + "0" * 15,), ("C00000001",), ("H1",), ("x",), ("",)], "id string")
    assert [r[0] for r in ids.select(X.entity_bucket(F.col("id"))).collect()] == ["individual", "committee", "candidate", "individual", "individual"]


def test_memo_rows_count_in_lists_only(spark):
    own = ledger_of(spark, contribution("C1", "15", "C2", "7"), contribution("C1", "15", "C2", "3", memo="X", tx="2"), contribution("C1", "24T", "C2", "9", tx="3"))
    none = spark.createDataFrame([], "cycle int, cmte_id string, person string, tx_amt decimal(18,2)")
    total = totals.committee_totals(totals.committee_postings(own)).first()
    assert (total.contributions_amt, total.contributions_txs, total.total_out_amt) == (7.0, 1, 0.0)
    listed = edges.edge_list(edges.edges(own, none), "top_cmte_contributors").collect()
    assert [(r.cp_id, r.amt, r.txs) for r in listed] == [("C2", 10.0, 2)]


def test_top_list_keeps_a_hundred_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(2000, "top_cmte_contributors", "C1", f"C{k:03d}", decimal.Decimal(1), 1) for k in range(130)], "cycle int, list_name string, owner_id string, cp_id string, amt decimal(18,2), txs int")
    kept = [r.cp_id for r in edges.edge_list(rows, "top_cmte_contributors").orderBy("rank").collect()]
    assert kept == [f"C{k:03d}" for k in range(100)]


def test_receipts_add_up(book):
    t = book.committee_totals.agg(F.sum(F.abs(F.col("total_in_amt") - F.col("contributions_amt") - F.col("other_amt"))).alias("d"), F.count("*").alias("n")).first()
    assert t.n > 0 and t.d < 1e-3


def test_yearly_parties_add_up_to_all(book):
    sums = book.yearly_totals.groupBy("cycle", "category").agg(F.sum(F.when(F.col("party") == "ALL", F.col("total"))).alias("a"), F.sum(F.when(F.col("party") != "ALL", F.col("total"))).alias("p"))
    assert all(abs(r.a - r.p) < 1e-3 for r in sums.collect())


def test_one_cycle_merged_is_itself(book):
    one = book.individual_totals.where("cycle = 1998").drop("cycle")
    assert rows_of(merge.merge_in_out(book.individual_totals, "indv_id", [1998])) == rows_of(one)


def test_rankings_leave_zero_out(spark):
    rows = spark.createDataFrame([(2000, "candidates", "rec", "H1", "DEM", 0.0), (2000, "candidates", "rec", "H2", "DEM", 2.0)], "cycle int, bucket string, category string, entity_id string, party string, total double")
    assert {(r.party, r.entity_id) for r in rankings.rankings(rows).collect()} == {("DEM", "H2"), ("ALL", "H2")}


def test_tokens_drop_stop_words_after_lower_case(spark):
    got = spark.createDataFrame([(["O'Neil, The MR X-1", "", "of  to"],)], "t array<string>").select(X.terms(F.col("t"))).first()[0]
    assert got == ["oneil", "x", "1"]


def test_search_status_and_stop_word_queries(spark):
    postings = spark.createDataFrame([("a1", str(k)) for k in range(501)] + [("b2", "1"), ("b2", "2")], "term string, id string")
    got = {r.query: (r.results, r.status) for r in search.search_status(postings, ["a1", "A1 b2", "the of", "zz"]).collect()}
    assert got == {"a1": (501, "MAX_LENGTH"), "A1 b2": (2, "OK"), "the of": (0, "NO_RESULTS"), "zz": (0, "NO_RESULTS")}


def test_posting_shards_are_cut_in_order(spark):
    postings = spark.createDataFrame([("t", f"{k:05d}") for k in range(25)] + [("u", "9")], "term string, id string")
    got = rows_of(search.posting_shards(postings, 10))
    assert got == [("t", 0, "00000", "00009", 10), ("t", 1, "00010", "00019", 10), ("t", 2, "00020", "!", 5), ("u", 0, "9", "!", 1)]


def test_reach_goes_on_to_the_end_in_every_cycle(spark):
    chain = [(2000, f"C{k}", f"C{k + 1}", "cmte_out") for k in range(6)]
    rows = spark.createDataFrame([*chain, (2000, "C6", "C0", "cmte_out"), (2000, "C6", "P1", "exp_out"), (2002, "C0", "C5", "cmte_out")], "cycle int, src string, dst string, edge_type string")
    assert rows_of(graph.reach(rows.where("cycle = 2000"), ["C0"])) == [*((f"C{k}", k) for k in range(7)), ("P1", 7)]
    assert rows_of(graph.reach(rows, ["C0"], keys=["cycle"])) == [*((2000, f"C{k}", k) for k in range(7)), (2000, "P1", 7), (2002, "C0", 0), (2002, "C5", 1)]


def test_total_share_takes_every_simple_path(spark):
    ids = [f"C{k:08d}" for k in range(6)]
    share = {(a, b): (i + 1) / (i + j + 7) for i, a in enumerate(ids) for j, b in enumerate(ids) if a != b and b != ids[0]}
    want = {}
    for n in range(1, 6):
        for path in itertools.permutations(ids[1:], n):
            steps = list(zip((ids[0], *path), path))
            pct, paths = want.get(path[-1], (0, 0))
            want[path[-1]] = (pct + math.prod(share[s] for s in steps), paths + 1)
    rows = spark.createDataFrame([(2000, a, b, w) for (a, b), w in share.items()], "cycle int, src string, dst string, weight double")
    got = {r.target: (r.pct, r.paths) for r in graph.total_share(rows, spark.createDataFrame([(2000, ids[0])], "cycle int, source string")).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()} == dict.fromkeys(ids[1:], 65)
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_upsert_takes_the_last_row(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert rows_of(tables.keyed_upsert(old, new, "k", order=["v"])) == [("a", 1), ("b", 3), ("c", 1)]
    assert rows_of(tables.insert_new_keys(old, new.where("v <> 3"), "k")) == [("a", 1), ("b", 1), ("c", 1)]


def test_pages_are_exclusive(spark):
    rows = spark.createDataFrame([(f"k{n}",) for n in range(5)], "k string")
    first = tables.keyset_page(rows, "k", None, 2)
    after = tables.next_key(first, "k", 2).first()[0]
    assert [r.k for r in tables.keyset_page(rows, "k", after, 10).collect()] == ["k2", "k3", "k4"]


def test_a_stream_equals_a_batch_and_replays_add_nothing(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 AS g")
    rows.where("id < 60").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "id", 1)
    rows.where("id >= 50").write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "id", 1)
    assert rows_of(ingest.stored_rows(spark, f"{tmp_path}/out").select("id", "g")) == rows_of(rows)


def test_queries_and_sql_have_the_same_names():
    from sluice.plans.oracle import ORACLE_SQL
    from sluice.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
