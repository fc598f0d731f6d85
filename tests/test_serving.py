"""Serving tables and profiles: what is read, what is written, and what the cycles add up to."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators import ledger
from sluice.operators.profiles import Profiles
from sluice.operators.serving import ServingTable

SCHEMA = "k string, c int, v string, w array<int>"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{n:04d}", c, "old", [n]) for n in range(500) for c in (2000, 2002)], SCHEMA)
    return ServingTable(spark, f"{tmp_path}/table", rows.schema, "k", ["c"], parts=16).write(rows)


def test_reads_by_key_reach_folders_and_files(spark, table, capsys):
    found = table.get("k0007", c=[2000, 2002])
    assert sorted((r.k, r.c) for r in found.collect()) == [("k0007", 2000), ("k0007", 2002)]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,k0007), In(c, [2000,2002])]" in plan or ("EqualTo(k,k0007)" in plan and "In(c" in plan)
    assert "PartitionFilters: [isnotnull(part" in plan and "Filter (" in plan
    scanned = spark.read.parquet(table.folder).where(f"part = {found.sparkSession.range(1).select(table._part(F.lit('k0007'))).first()[0]}")
    assert 0 < scanned.count() < 1_000 / 4  # a part of the rows is all that the folder holds
    assert table.get("nothing").collect() == []
    ids = spark.createDataFrame([("k0001",), ("k0499",), ("none",), ("k0001",)], "k string")
    assert sorted((r.k, r.c) for r in table.get_many(ids).collect()) == [("k0001", 2000), ("k0001", 2002), ("k0499", 2000), ("k0499", 2002)]


def test_an_upsert_writes_only_folders_with_a_change(spark, table):
    before = files(table.folder)
    table.upsert(table.get("k0003"))  # as they are stored
    assert files(table.folder) == before
    new = spark.createDataFrame([("k0003", 2000, "new", [1]), ("k0003", 2000, "newer", None), ("zz", 2000, None, []), ("k0004", 2002, "old", [4])], SCHEMA)
    for _ in range(2):
        table.upsert(new, order=["v"])
        after = files(table.folder)
        assert len({os.path.dirname(f) for f in set(after) ^ set(before)}) == 2
        assert {f for f in before if f not in after} != set() and sum(before.get(f) == t for f, t in after.items()) >= len(before) - 4
    first = files(table.folder)
    table.upsert(new, order=["v"])
    assert files(table.folder) == first
    assert [(r.v, r.w) for r in table.get("k0003", c=2000).collect()] == [("newer", None)] and table.rows.count() == 1_001
    table.upsert(new.limit(0))
    assert files(table.folder) == first


def test_an_upsert_that_was_cut_off_is_finished_when_the_table_is_opened(spark, table, monkeypatch):
    put = ServingTable.write
    monkeypatch.setattr(ServingTable, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(spark.createDataFrame([("k0003", 2000, "new", [1])], SCHEMA))
    monkeypatch.setattr(ServingTable, "write", put)
    again = ServingTable(spark, table.folder, table.schema, "k", ["c"], parts=16)
    assert [r.v for r in again.get("k0003").orderBy("c").collect()] == ["new", "old"] and again.rows.count() == 1_000


def test_ten_keys_leave_other_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{n:05d}", 0, "old", [n]) for n in range(5_000)], SCHEMA)
    table = ServingTable(spark, f"{tmp_path}/wide", rows.schema, "k", parts=64).write(rows)
    before = files(table.folder)
    table.upsert(spark.createDataFrame([(f"k{n:05d}", 0, "new", [n]) for n in range(10)], SCHEMA))
    after = files(table.folder)
    changed = {os.path.dirname(f) for f in set(after) ^ set(before)}
    assert 1 <= len(changed) <= 10 and all(before[f] == after[f] for f in before if os.path.dirname(f) not in changed)


def test_first_rows_stay_over_loads(spark, tmp_path):
    schema = "k string, v string, tx string"
    table = ServingTable(spark, f"{tmp_path}/people", spark.createDataFrame([], "k string, v string").schema, "k")
    for load in ([("a", "b", "2"), ("a", "z", "1")], [("a", "0", "0"), ("c", "y", "3"), ("c", "x", "4")], []):
        table.insert_new(spark.createDataFrame(load, schema), order=["tx"])
    assert sorted(map(tuple, table.rows.collect())) == [("a", "z"), ("c", "y")]


def test_persons_are_named_by_their_first_transaction(spark):
    columns = "cycle int, filer_id string, tx_type string, memo_code string, other_id string, name string, employer string, occupation string, zip string, tx_amt decimal(18,2), tx_id string"
    given = spark.createDataFrame([(2000, "C00000001", "15", "", "", "ANN", employer, "", "1", Decimal(1), key) for employer, key in (("AAA", "5"), ("ZZZ", "2"), ("MMM", "9"))], columns)
    none = spark.createDataFrame([], "cycle int, cmte_id string, name string, zip string, tx_amt decimal(18,2), sub_id string")
    book = ledger.classify(ledger.normalize(given))
    assert [r.employer for r in ledger.individuals(book, ledger.expense_ledger(none)).collect()] == ["ZZZ"]
    paid = spark.createDataFrame([(2000, "C1", "ANN", "1", Decimal(2), "0"), (2000, "C1", "SHOP", "1", Decimal(2), "1")], none.schema)
    assert sorted((r.name, r.employer) for r in ledger.individuals(book, ledger.expense_ledger(paid)).collect()) == [("ANN", "ZZZ"), ("SHOP", "")]


def test_profiles_add_the_chosen_cycles(spark, tmp_path):
    entities = spark.createDataFrame([("C1", "committee", "One", "X", "CA", "REP"), ("H1", "candidate", "Hen", "Y", "TX", "DEM"), ("p", "individual", "Ann", "", "", "Acme")], "id string, bucket string, name string, city string, state string, employer string")
    amounts = [(2000, "top_indv_contributors", "C1", "p", 5), (2002, "top_indv_contributors", "C1", "p", 7), (2004, "top_indv_contributors", "C1", "p", 100), (2000, "transfer_recipients", "C1", "H1", 3), (2000, "indv_recipients", "p", "C1", 5), (2002, "indv_recipients", "p", "gone", 9)]
    edges = spark.createDataFrame([(c, n, o, k, Decimal(a), 1) for c, n, o, k, a in amounts], "cycle int, list_name string, owner_id string, cp_id string, amt decimal(28,2), txs long")
    from sluice.operators.totals import MEASURES

    parts = [f"{p}_{n}" for p in (*MEASURES, "total_in", "total_out") for n in ("amt", "txs", "avg")]
    committees = spark.createDataFrame([(c, "C1", *([float(c)] * len(parts)), 0.0) for c in (2000, 2002)], "cycle int, cmte_id string, " + ", ".join(f"{p} double" for p in parts) + ", net_balance double")
    sides = "cycle int, {} string, out_amt double, out_txs long, out_avg double, in_amt double, in_txs long, in_avg double, net_balance double"
    persons = spark.createDataFrame([(2000, "p", 5.0, 1, 5.0, 0.0, 0, 0.0, -5.0), (2002, "p", 9.0, 1, 9.0, 1.0, 1, 1.0, -8.0)], sides.format("indv_id"))
    made = Profiles(spark, f"{tmp_path}/profiles").build(entities, edges, committees, persons, persons.limit(0).withColumnRenamed("indv_id", "cand_id"))
    got = {(r.list_name, r.cp_id): (r.cp_name, r.amt, r.txs, r.avg_amt, r["rank"], r.total_in_amt) for r in made.committee("C1", [2000, 2002]).collect()}
    assert got == {("top_indv_contributors", "p"): ("Ann", 12.0, 2, 6.0, 1, 4002.0), ("transfer_recipients", "H1"): ("Hen", 3.0, 1, 3.0, 1, 4002.0)}
    assert [(r.cp_id, r.cp_name, r.amt, r.in_amt, r.out_amt) for r in made.individual("p", [2002]).collect()] == [("gone", "Unknown", 9.0, 1.0, 9.0)]
    assert [(r.name, r.list_name, r.in_amt) for r in made.candidate("H1", [2000]).collect()] == [("Hen", None, None)]
    assert made.individual("nobody", [2000]).collect() == [] and [r.list_name for r in made.committee("C1", []).collect()] == [None]
