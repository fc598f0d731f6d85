"""The stored index: equal to one build after any updates, reading and writing only what it has to."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import search
from sluice.operators.index_store import IndexStore


def postings(spark, rows):
    return spark.createDataFrame(sorted(rows), "term string, id string")


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def shown(store):
    return sorted(map(tuple, store.postings.select("term", "shard", "id").collect()))


def cut(rows, size):
    out, place = [], {}
    for term, i in sorted(rows):
        place[term] = place.get(term, -1) + 1
        out.append((term, place[term] // size, i))
    return sorted(out)


def test_updates_equal_one_build(spark, tmp_path):
    rnd = random.Random(4)
    rows = {("hot", f"{k:04d}") for k in range(0, 300, 3)} | {(f"t{rnd.randrange(40)}", f"{rnd.randrange(500):04d}") for _ in range(200)}
    store = IndexStore(spark, f"{tmp_path}/index", size=10, pieces=8, slot_shards=3).build(postings(spark, rows))
    assert shown(store) == cut(rows, 10)
    batches = [{("hot", f"{k:04d}") for k in range(300, 312)}, {("hot", "0001"), ("t1", "0002"), ("new", "0009")}, {("hot", "0150"), *list(rows)[:20]}, {(f"t{rnd.randrange(60)}", f"{rnd.randrange(900):04d}") for _ in range(80)}]
    for batch in batches:
        rows |= batch
        for _ in range(2):
            store.update(postings(spark, batch))
        assert shown(store) == cut(rows, 10)
    assert sorted(map(tuple, store.directory().collect())) == sorted(map(tuple, search.posting_shards(postings(spark, rows), 10).collect()))
    want = sorted(i for t, i in rows if t == "hot" and ("t1", i) in rows)
    assert sorted(r.id for r in store.match("HOT t1").collect()) == want


def test_an_update_that_was_cut_off_is_finished_when_the_index_is_opened(spark, tmp_path, monkeypatch):
    rows, new = {("a", f"{k:03d}") for k in range(0, 60, 2)}, {("a", "001"), ("b", "7")}
    store = IndexStore(spark, f"{tmp_path}/index", size=5, pieces=4, slot_shards=2).build(postings(spark, rows))
    put = IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, frame, name, *by: put(self, frame, name, *by) if name == "postings" else (_ for _ in ()).throw(OSError(name)))
    with pytest.raises(OSError, match="shards"):
        store.update(postings(spark, new))
    monkeypatch.setattr(IndexStore, "_write", put)
    store = IndexStore(spark, f"{tmp_path}/index", size=5, pieces=4, slot_shards=2)
    assert shown(store) == cut(rows | new, 5) and not os.path.exists(f"{tmp_path}/index/_pending")
    assert sorted(map(tuple, store.directory().collect())) == sorted(map(tuple, search.posting_shards(postings(spark, rows | new), 5).collect()))


def test_a_small_batch_leaves_other_files(spark, tmp_path):
    rows = {("hot", f"{k:05d}") for k in range(1_000)} | {(f"t{k}", "00001") for k in range(64)}
    store = IndexStore(spark, f"{tmp_path}/index", size=10, pieces=16, slot_shards=4).build(postings(spark, rows))
    before = files(f"{tmp_path}/index/postings")
    assert len(before) > 30
    store.update(postings(spark, {("hot", "00007"), ("t3", "00001")}))  # both are there already
    assert files(f"{tmp_path}/index/postings") == before
    store.update(postings(spark, {("hot", "99999")}))  # a new last shard, as the one before is closed
    after = files(f"{tmp_path}/index/postings")
    assert sum(before.get(f) == t for f, t in after.items()) >= len(before) - 1 and len(set(after) - set(before)) == 1
    store.update(postings(spark, {("hot", "00900x")}))  # from its shard to the end, and none before
    again = files(f"{tmp_path}/index/postings")
    assert 2 <= len(set(again) - set(after)) <= 4
    assert shown(store) == cut(rows | {("hot", "99999"), ("hot", "00900x")}, 10)


def test_searches_read_the_terms_folders(spark, tmp_path, capsys):
    rows = {("hot", f"{k:05d}") for k in range(2_000)} | {("rare", "01234"), ("rare", "01236"), ("other", "01236")}
    store = IndexStore(spark, f"{tmp_path}/index", size=10, pieces=16, slot_shards=4).build(postings(spark, rows))
    assert [(t, n) for t, n, _ in store.plan("hot rare other")] == [("other", 1), ("rare", 1), ("hot", 200)]
    found = store.match("hot rare")
    assert sorted(r.id for r in found.collect()) == ["01234", "01236"]
    found.explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert all("piece" in line for line in filters) and sum("slot" in line and "IN" in line or "slot#" in line and "=" in line for line in filters) >= 1
    found.explain("formatted")
    assert "GreaterThanOrEqual(id,01234)" in capsys.readouterr().out
    assert store.match("the of").collect() == [] and store.match("hot nowhere").collect() == []
    assert sorted(map(tuple, store.status(["hot", "rare hot", "the", "none"], limit=500).collect())) == [("hot", 2000, "MAX_LENGTH"), ("none", 0, "NO_RESULTS"), ("rare hot", 2, "OK"), ("the", 0, "NO_RESULTS")]


def test_done_cycles_are_passed_over(spark, tmp_path):
    texts = spark.createDataFrame([("a", "committee", 2000, ["red"]), ("b", "committee", 2002, ["red blue"])], "id string, bucket string, cycle int, texts array<string>")
    store = IndexStore(spark, f"{tmp_path}/index").build(search.tokenize(texts.where("cycle = 2000")), done=texts.where("cycle = 2000").select("bucket", "cycle"))
    store.update_texts(texts.withColumn("texts", F.when(F.col("cycle") == 2000, F.array(F.lit("green"))).otherwise(F.col("texts"))))
    assert shown(store) == [("blue", 0, "b"), ("red", 0, "a"), ("red", 0, "b")]
    assert sorted(map(tuple, store.done.collect())) == [("committee", 2000), ("committee", 2002)]


def test_the_lookup_is_cut_before_it_is_joined(spark, capsys):
    lookup = spark.createDataFrame([("C00000001", "ONE")], "id string, name string")
    search.lookup_by_ids(lookup, ["c00000001", "C2"]).explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


@pytest.fixture(autouse=True)
def _shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
