"""Files, saved tables, logs, exports, shards and streams: what a rerun, a replay, a tie or an empty table gives."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import expressions as X
from sluice.functions.codes import STOP_WORDS
from sluice.operators import graph, search, tables
from sluice.sources import filings
from sluice.streaming import ingest


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_lines_written_as_files_are_read_back(spark, tmp_path):
    given = spark.createDataFrame([(2004, "C1", 'A "B" C', "12345"), (2004, "C2", "", None), (2006, "C3", "É, X", "0")], "cycle int, cmte_id string, name string, zip string")
    folder = f"{tmp_path}/files"
    for _ in range(2):
        filings.write_lines(filings.to_lines(given, "disbursements", {c: c for c in ("cmte_id", "name", "zip")}, "cycle"), folder)
    assert sorted(n for n in os.listdir(folder) if "=" in n) == ["cycle=2004", "cycle=2006"]
    got = filings.scan(filings.read_lines(spark, folder), "disbursements", "cycle")
    assert rows_of(got.select("cycle", "cmte_id", "name", "zip")) == rows_of(given.fillna(""))
    assert "PartitionFilters: [isnotnull(cycle" in plan_of(filings.published(filings.read_lines(spark, folder), "disbursements"))


def test_files_are_read_from_their_first_cycle_on(spark):
    assert [filings.exists_in("disbursements", c) for c in (2002, 2004)] == [False, True] and filings.exists_in("contributions", 1980)
    lines = spark.createDataFrame([(c,) for c in (1994, 1996, 2004)], "cycle int")
    assert rows_of(filings.published(lines, "campaign_financials")) == [(1996,), (2004,)]


def test_saving_again_replaces_own_folders_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1998, "a", 1), (1998, "b", 2), (2000, "a", 3)], "cycle int, list string, v int")
    folder = f"{tmp_path}/t"
    tables.save(rows, folder, "cycle", "list")
    tables.save(spark.createDataFrame([(1998, "a", 9)], rows.schema), folder, "cycle", "list")
    loaded = tables.load(spark, folder, rows.schema, cycle=1998)
    assert rows_of(loaded.select(*rows.columns)) == [(1998, "a", 9), (1998, "b", 2)] and "PartitionFilters: [isnotnull(cycle" in plan_of(loaded)
    assert rows_of(tables.load(spark, folder, rows.schema).select("v")) == [(2,), (3,), (9,)]
    assert rows_of(tables.get_years(rows, [1998, 2000, 2002], list="a").select("cycle", "v")) == [(1998, 1), (2000, 3)]


def test_a_log_takes_a_batch_once(spark, tmp_path):
    for batch, ids in ((0, "ab"), (1, "bc"), (1, "bc")):
        tables.append_log(spark.createDataFrame([(i,) for i in ids], "id string"), f"{tmp_path}/log", batch)
    assert rows_of(spark.read.parquet(f"{tmp_path}/log").select("id", "batch")) == [("a", 0), ("b", 0), ("b", 1), ("c", 1)]


def test_serving_rows_are_written_by_partition_key(spark, tmp_path):
    rows = spark.createDataFrame([("REP", "C2"), ("REP", "C1"), ("", "C3"), (None, "C4")], "party string, id string")
    made = tables.serving_rows(rows, F.col("party"), "id")
    assert rows_of(made.select("pk", "sk")) == [("???", "C3"), ("???", "C4"), ("REP", "C1"), ("REP", "C2")]
    for _ in range(2):
        tables.write_serving(made, f"{tmp_path}/out")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out").where("pk = 'REP'").select("sk")) == [("C1",), ("C2",)]


def test_upserts_of_equal_turns_and_clashing_names(spark):
    schema = "k string, row int, turn int, held int"
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1)], schema)
    new = spark.createDataFrame([("b", n, n, n) for n in range(2, 9)], schema)
    want = rows_of(tables.keyed_upsert(old, new, "k"))
    assert [r[0] for r in want] == ["a", "b"] and want == rows_of(tables.keyed_upsert(old, new.repartition(5).orderBy(F.desc("row")), "k"))
    assert rows_of(tables.keyed_upsert(old.limit(0), new.limit(0), "k")) == []


def test_gets_of_missing_keys_and_empty_pages(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    found, missing = tables.batch_get(table, spark.createDataFrame([("a",), ("a",), ("z",), ("z",)], "k string"), "k")
    assert rows_of(found) == [("a", 1)] and rows_of(missing) == [("z",)]
    page = tables.keyset_page(table, "k", "b", 5)
    assert page.collect() == [] and tables.next_key(page, "k", 5).first()[0] == ""
    assert rows_of(tables.without(spark.createDataFrame([(1,), (None,)], "v int"), F.col("v") == 1)) == [(None,)]


def test_a_frequent_term_fills_several_ranges(spark):
    """Shards are right where a term's postings begin and end inside ranges, and fill some of their own."""
    terms = [("hot", f"{n:06d}") for n in range(9000)] + [(t, f"{n:06d}") for t in ("a", "hos", "hou", "zz") for n in range(random.Random(t).randrange(1, 700))]
    random.Random(7).shuffle(terms)
    want = {}
    for term, i in sorted(terms):
        want.setdefault(term, []).append(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        postings = spark.createDataFrame(terms, "term string, id string")
        rows = search.shard_postings(postings, 100)
        got = {(r.term, r.id): r.shard for r in rows.collect()}
        shown = rows_of(search.posting_shards(postings, 100))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(t, i): n // 100 for t, ids in want.items() for n, i in enumerate(ids)}
    cut = [(t, n, ids[100 * n : 100 * n + 100]) for t, ids in sorted(want.items()) for n in range(-(-len(ids) // 100))]
    assert shown == [(t, n, part[0], "!" if part[-1] == want[t][-1] else part[-1], len(part)) for t, n, part in cut]


def test_terms_equal_a_plain_split(spark):
    signs = random.Random(3)
    texts = ["".join(signs.choice("aAbZ09 ',.-_\n\tÉß") for _ in range(signs.randrange(30))) for _ in range(300)] + ["", "the", "OF The,", "Mr. X mrs."]
    got = [r.t for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").repartition(3).select("n", X.terms(F.array("t")).alias("t")).orderBy("n").collect()]
    assert got == [list(dict.fromkeys(w for w in re.split("[^a-z0-9]", re.sub("[',]", "", t.lower())) if w not in STOP_WORDS)) for t in texts]


def test_reach_of_unknown_roots_and_without_edges(spark):
    rows = spark.createDataFrame([(2000, "A", "B"), (2000, "B", "A")], "cycle int, src string, dst string")
    assert rows_of(graph.reach(rows, ["Z"])) == [("Z", 0)] and rows_of(graph.reach(rows, ["A", "A"])) == [("A", 0), ("B", 1)]
    assert rows_of(graph.reach(rows.limit(0), ["A"])) == [("A", 0)] and rows_of(graph.reach(rows.limit(0), ["A"], keys=["cycle"])) == []
    assert rows_of(graph.reach(rows, ["A"], hops=0)) == [("A", 0)]


def test_total_share_states_its_bound(spark):
    ids = [f"C{k:08d}" for k in range(4)]
    rows = spark.createDataFrame([(2000, a, b, 0.5) for a, b in zip(ids, ids[1:])], "cycle int, src string, dst string, weight double")
    sources = spark.createDataFrame([(2000, ids[0])], "cycle int, source string")
    assert rows_of(graph.total_share(rows, sources, hops=2).select("target", "pct", "paths", "max_hops")) == [(ids[1], 0.5, 1, 2), (ids[2], 0.25, 1, 2)]
    assert rows_of(graph.total_share(rows, sources).select("target", "pct", "max_hops")) == [(ids[1], 0.5, None), (ids[2], 0.25, None), (ids[3], 0.125, None)]


@pytest.fixture
def stream(spark, tmp_path):
    def load(*ids):
        if ids:
            spark.createDataFrame([(i, 1) for i in ids], "id long, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", spark.createDataFrame([], "id long, v int").schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "id", 1)
        return [r.id for r in ingest.stored_rows(spark, f"{tmp_path}/out").orderBy("id").collect()]

    return load


def test_a_stream_keeps_each_key_once(spark, stream):
    before = spark.conf.get(ingest.STATE_STORE)
    assert stream(1, 2, 2, None) == [None, 1, 2]
    assert stream(2, 3, None) == [None, 1, 2, 3]
    assert stream() == [None, 1, 2, 3]
    assert spark.conf.get(ingest.STATE_STORE) == before


def test_a_batch_that_ran_without_being_recorded_replaces_itself(spark, stream, tmp_path):
    stream(1, 2)
    stream(2, 3)
    commits = f"{tmp_path}/checkpoint/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.rename(f"{commits}/{name}", f"{tmp_path}/{name}")
    assert stream() == [1, 2, 3] and stream(4) == [1, 2, 3, 4]


def test_transaction_rows_are_the_lists_in_shards(spark):
    from sluice.operators import totals

    columns = "cycle int, filer_id string, other_id string, bucket string, incoming boolean, is_memo boolean, transfer boolean, counted boolean, tx_id string"
    rows = [(2000, "C1", "p", "individual", True, False, False, True, f"{n:02d}") for n in range(7)] + [(2002, "C1", "p", "individual", True, False, False, True, "x")] * 2 + [(2000, "C1", "p", "individual", True, True, False, True, "memo")]
    ledger = spark.createDataFrame(rows, columns)
    got = sorted(map(tuple, totals.transaction_rows(ledger, "individual", 3).collect()))
    assert got == [*((2000, "p", n // 3, f"{n:02d}") for n in range(7)), (2002, "p", 0, "x"), (2002, "p", 0, "x")]
    assert {(r.cycle, len(r.transactions)) for r in totals.individual_transactions(ledger).collect()} == {(2000, 7), (2002, 2)}
    assert totals.transaction_rows(ledger, "committee").collect() == []
