"""Reversible line dedup: exact reference-count tables behind sharded cuckoo filters.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. The state of a corpus is the
table of references (key, doc_id), the counts made from it (documents that hold a key, and the largest of them), and
a cuckoo filter for each shard of the keys. Documents come and go in batches. An insert writes the batch's own rows
and nothing else: keys that the filters don't know are new and go straight into the table of counts, only the others
are looked up there. A delete takes the leaving documents from the counts of their keys, and a key leaves its filter with
its last reference. When the keys outgrow their shards, the filters are made anew with more of them.

Lines are removed by exact counts only: a filter's false positive costs time, never a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lean, lower_ascii, whole_text

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = " \t\n\x0b\x0c\r"
#: Keys that a shard's filter is made for; the shards are doubled when they hold twice as many on average.
SHARD_KEYS = 32_768
#: Of a hundred documents, how many come with the first batch of line_report, and how many of them are withdrawn again.
FIRST_BATCH, WITHDRAWN = 50, 5
#: The most keys that are sent to all tasks.
OFTEN = 10_000
SLOTS = 4
KICKS = 500
_U64 = np.uint64


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U64(29))


class CuckooFilter:
    """A set of 128-bit keys with deletion: 15-bit fingerprints in buckets of four, and what doesn't fit in a stash.

    A key may be held several times; delete() removes one copy and must only be called for a key that is held.
    """

    def __init__(self, expected: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, expected) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.stash: dict[tuple[int, int], int] = {}  # (the lower of its buckets, fingerprint): copies

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (_spread(k2.view(_U64)) >> _U64(49)).astype(np.uint16) | np.uint16(1 << 15)
        first = (_spread(k1.view(_U64) ^ _U64(0x9E3779B97F4A7C15)) >> _U64(20)) & _U64(self.buckets - 1)
        return prints, first.astype(np.int64), self._other(first.astype(np.int64), prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ ((_spread(np.asarray(prints, dtype=_U64)) >> _U64(7)) & _U64(self.buckets - 1)).astype(np.int64)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        prints, at, second = self._places(k1, k2)
        left = self._put(at, prints)
        prints, at = prints[left], second[left]
        for turn in range(KICKS):
            left = self._put(at, prints)
            prints, at = prints[left], at[left]
            if not len(at):
                return
            # One fingerprint in each full bucket makes room, and goes on to its other bucket.
            full, one = np.unique(at, return_index=True)
            moved = self.table[full, turn % SLOTS].copy()
            self.table[full, turn % SLOTS] = prints[one]
            stay = np.ones(len(at), dtype=bool)
            stay[one] = False
            prints, at = np.concatenate([prints[stay], moved]), np.concatenate([at[stay], self._other(full, moved)])
        for key in self._stashed(at, prints):
            self.stash[key] = self.stash.get(key, 0) + 1

    def _stashed(self, at: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        return list(zip(np.minimum(at, self._other(at, prints)).tolist(), prints.tolist(), strict=True))

    def _put(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; the places of those that found none."""
        order = np.argsort(at, kind="stable")
        own = at[order]
        turn = np.arange(len(own)) - np.searchsorted(own, own)  # among those that want the same bucket
        used = self.table[own] != 0
        fits = turn < SLOTS - used.sum(axis=1)
        slot = np.argsort(used, axis=1, kind="stable")[np.arange(len(own)), np.minimum(turn, SLOTS - 1)]
        self.table[own[fits], slot[fits]] = prints[order[fits]]
        return np.sort(order[~fits])

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(k1, k2)
        found = ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)
        if self.stash:
            found |= np.fromiter((key in self.stash for key in self._stashed(first, prints)), bool, len(prints))
        return found

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        prints, first, second = self._places(k1, k2)
        for print_, a, b, key in zip(prints.tolist(), first.tolist(), second.tolist(), self._stashed(first, prints), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == print_)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                self.stash[key] -= 1
                if not self.stash[key]:
                    del self.stash[key]

    def to_bytes(self) -> bytes:
        stash = np.array([(a, b, n) for (a, b), n in sorted(self.stash.items())], dtype="<i8").tobytes()
        return int(self.buckets).to_bytes(8, "little") + self.table.astype("<u2").tobytes() + stash

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.buckets = int.from_bytes(data[:8], "little")
        end = 8 + 2 * SLOTS * made.buckets
        made.table = np.frombuffer(data[8:end], "<u2").reshape(-1, SLOTS).copy()
        made.stash = {(a, b): n for a, b, n in np.frombuffer(data[end:], "<i8").reshape(-1, 3).tolist()}
        return made


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def references(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, place, k1, k2) of each line whose key has `min_chars` code points or more, with a hash of its text.

    k1 and k2 are 128 bits of the key, by which keys are told apart. Rows without doc_id hold no references.
    """
    text = whole_text(text_col)
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keys = lines.select("doc_id", "tie", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "tie", "place", F.xxhash64(F.lit(1), "key").alias("k1"), F.xxhash64(F.lit(2), "key").alias("k2"))


def reference_counts(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, max_doc): how many documents hold a key, and the largest of them."""
    return refs.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).alias("shard")


@dataclass(frozen=True)
class LineState:
    """Exact tables and filters of a corpus. Every operation returns a new state, so each can be taken back.

    Tables are runs: what an insert or a delete has written. Of several rows of counts the newest holds.
    """

    scratch: Scratch
    runs: tuple[tuple[int, DataFrame], ...] = ()  # version, references
    gone: tuple[tuple[int, DataFrame], ...] = ()  # version, doc_ids that left
    tables: tuple[DataFrame, ...] = ()  # k1, k2, n_docs, max_doc, version
    filters: DataFrame | None = None  # shard, filter
    keys: int = 0
    shards: int = 1
    version: int = 0

    @property
    def refs(self) -> DataFrame:
        """The references of all documents that are in."""
        alive = [reduce(lambda r, g: r.join(g, "doc_id", "left_anti"), [ids for v, ids in self.gone if v > version], run) for version, run in self.runs]
        return reduce(DataFrame.unionByName, alive)

    @property
    def counts(self) -> DataFrame:
        """(k1, k2, n_docs, max_doc) of every key that is held."""
        every = reduce(DataFrame.union, self.tables)
        newest = every.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "max_doc"), "version").alias("now"))
        return newest.select("k1", "k2", "now.*").where("n_docs > 0")


def empty_state(docs: DataFrame) -> LineState:
    """The state of no documents; its tables are written to the session's shared folder."""
    return LineState(Scratch(docs.sparkSession, "line-state"))


def insert_documents(state: LineState, docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """Add documents. One that is in already changes nothing: take it out first to change its text."""
    refs = references(docs, min_chars, id_col, text_col)
    if state.runs:
        refs = refs.join(state.refs.select("doc_id").distinct(), "doc_id", "left_anti")
    return insert_references(state, state.scratch.keep(refs, f"refs-{state.version + 1}"))


def insert_references(state: LineState, refs: DataFrame) -> LineState:
    """Add the references of documents that are not in; `refs` is a table that stays."""
    n, keep = state.version + 1, state.scratch.keep
    added = reference_counts(refs)
    if state.filters is None:
        fresh = keep(added.withColumn("version", F.lit(n)), f"counts-{n}")
        new = fresh.select("k1", "k2")
    else:
        probed = keep(_probe(added, state), f"probed-{n}")
        known = probed.where("maybe").join(state.counts.select("k1", "k2", F.col("n_docs").alias("had"), F.col("max_doc").alias("had_max")), ["k1", "k2"], "left")
        known = known.select("k1", "k2", (F.col("n_docs") + F.coalesce("had", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "had_max").alias("max_doc"), F.col("had").isNull().alias("new"))
        fresh = keep(known.union(probed.where("not maybe").select("k1", "k2", "n_docs", "max_doc", F.lit(True))).withColumn("version", F.lit(n)), f"counts-{n}")
        state.scratch.drop(f"probed-{n}")
        new = fresh.where("new").select("k1", "k2")
    made = replace(state, runs=(*state.runs, (n, refs)), tables=(*state.tables, fresh.select("k1", "k2", "n_docs", "max_doc", "version")), keys=state.keys + new.count(), version=n)
    shards = made.shards
    while made.keys > 2 * SHARD_KEYS * shards:
        shards *= 2
    if state.filters is None or shards > made.shards:
        made = replace(made, shards=shards, filters=None)
        return replace(made, filters=keep(_changed(made, made.counts.select("k1", "k2"), add=True), f"filters-{n}"))
    return replace(made, filters=keep(_changed(state, new, add=True), f"filters-{n}"))


def delete_documents(state: LineState, doc_ids: DataFrame) -> LineState:
    """Take documents (doc_id) out again; keys without references leave their filter. Unknown ids change nothing."""
    n, keep = state.version + 1, state.scratch.keep
    ids = keep(doc_ids.select("doc_id").where("doc_id is not null").distinct(), f"gone-{n}")
    left = reference_counts(state.refs.join(ids, "doc_id", "left_semi")).select("k1", "k2", F.col("n_docs").alias("left"), F.col("max_doc").alias("top_left"))
    rest = state.counts.join(left, ["k1", "k2"]).withColumn("n_docs", F.col("n_docs") - F.col("left"))
    touched = keep(rest.select("k1", "k2", "n_docs", "max_doc", ((F.col("top_left") == F.col("max_doc")) & (F.col("n_docs") > 0)).alias("headless")), f"touched-{n}")
    made = replace(state, gone=(*state.gone, (n, ids)), version=n)
    # Only keys whose largest document left are looked up among the references that stay.
    headless = touched.where("headless").select("k1", "k2")
    heads = made.refs.join(headless, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("head"))
    again = touched.join(heads, ["k1", "k2"], "left").select("k1", "k2", "n_docs", F.coalesce("head", "max_doc").alias("max_doc"), F.lit(n).alias("version"))
    again = keep(again, f"counts-{n}")
    state.scratch.drop(f"touched-{n}")
    last = again.where("n_docs = 0").select("k1", "k2")
    made = replace(made, tables=(*state.tables, again), keys=state.keys - last.count())
    return replace(made, filters=keep(_changed(state, last, add=False), f"filters-{n}"))


def _behind_filters(keys: DataFrame, state: LineState) -> DataFrame:
    """Distinct keys dealt by shard behind their shard's filter; keys are hashed, so no shard is much larger."""
    rows = keys.select(_shard(state.shards), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("filter"), *keys.columns)
    if state.filters is not None:
        rows = rows.unionByName(state.filters.select("shard", F.lit(0).alias("kind"), "filter", *(F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in keys.columns)))
    return rows.repartition("shard").sortWithinPartitions("shard", "kind")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(shard, kind, from, to) of rows that belong together."""
    shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(shard) | np.diff(kind)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(shard[a]), int(kind[a]), a, b


def _probe(keys: DataFrame, state: LineState) -> DataFrame:
    """keys with `maybe`: whether their shard's filter may hold them."""
    columns = keys.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            for shard, kind, a, b in _stretches(batch):
                if kind == 0:
                    at, one = shard, CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
                elif shard == at:
                    maybe[a:b] = one.contains(batch.column("k1")[a:b].to_numpy(), batch.column("k2")[a:b].to_numpy())
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(maybe)], names=[*columns, "maybe"])
            yield made.filter(pa.array(batch.column("kind").to_numpy() == 1))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)
    return _behind_filters(keys, state).mapInArrow(lean(probe), f"{types}, maybe boolean")


def _changed(state: LineState, keys: DataFrame, add: bool) -> DataFrame:
    """The filters after inserting or deleting the keys (k1, k2), one for each shard that has had any."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([one.to_bytes()], pa.binary())], names=["shard", "filter"])

        at, one = None, None
        for batch in batches:
            for shard, kind, a, b in _stretches(batch):
                if shard != at:
                    if at is not None:
                        yield made()
                    at, one = shard, None
                if kind == 0:
                    one = CuckooFilter.from_bytes(batch.column("filter")[a].as_py())
                    continue
                one = one or CuckooFilter(2 * SHARD_KEYS)
                (one.insert if add else one.delete)(batch.column("k1")[a:b].to_numpy(), batch.column("k2")[a:b].to_numpy())
        if at is not None:
            yield made()

    return _behind_filters(keys, state).mapInArrow(lean(change), "shard long, filter binary")


def _drops(state: LineState, min_docs: int) -> DataFrame:
    """(doc_id, tie, drop): the places of the lines that a text loses."""
    common = state.scratch.keep(state.counts.where(F.col("n_docs") >= min_docs), f"common-{state.version}")
    # A key that a ten-thousandth of all references hold is joined where they lie; there are 10,000 of these at most.
    often = F.col("n_docs") >= state.refs.count() / OFTEN
    refs, hot = state.refs, F.broadcast(common.where(often).select("k1", "k2", "max_doc"))
    rare = refs.join(hot, ["k1", "k2"], "left_anti").join(common.where(~often).select("k1", "k2", "max_doc"), ["k1", "k2"])
    columns = ["doc_id", "tie", "place", "max_doc"]
    lost = refs.join(hot, ["k1", "k2"]).select(*columns).union(rare.select(*columns)).where("doc_id <> max_doc")
    return lost.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("drop"))


def _rewritten(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, lines, kept): the row of docs as a struct, its lines, and those that stay."""
    text = whole_text(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.split(text, "\n").alias("lines"))
    joined = rows.join(drops, ["doc_id", "tie"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(places, lambda k: F.get("lines", k)))
    return joined.select("row", "lines", kept.alias("kept"))


def _batches(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> LineState:
    """The state after the documents have come in two batches, and a part of the first was withdrawn and came again."""
    state = empty_state(docs)
    refs = state.scratch.keep(references(docs, min_chars, id_col, text_col), "refs")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(100))
    state = insert_references(state, refs.where(turn < FIRST_BATCH))
    state = delete_documents(state, refs.where(turn < WITHDRAWN))
    return insert_references(state, refs.where((turn < WITHDRAWN) | (turn >= FIRST_BATCH)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text without its common lines; other columns, named as they may be, stay.

    A key of `min_chars` code points or more that `min_docs` documents hold loses all its lines but those of the
    largest doc_id that holds it. Null text counts as one empty line and becomes the empty text. Rows that share a
    doc_id are one document. Rows without doc_id hold no references and lose nothing. An empty table stays empty.
    """
    return state_report(_batches(docs, min_chars, id_col, text_col), docs, min_docs, id_col, text_col)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of dedup_lines, one row per input row; the same cases."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = _rewritten(narrow, _drops(_batches(narrow, min_chars, "doc_id", "text"), min_docs), "doc_id", "text")
    n, m = F.size("lines").cast("long"), F.size("kept").cast("long")
    return kept.select("row.doc_id", n.alias("n_lines"), (n - m).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def state_report(state: LineState, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as dedup_lines gives them, by the counts of a state that holds these texts."""
    kept = _rewritten(docs, _drops(state, min_docs), id_col, text_col)
    return kept.select(*(F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
