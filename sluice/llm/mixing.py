"""Mixing sources to target weights: block quotas split over output shards by a multivariate-hypergeometric tree.

Every source has a target of words. A target of 1.4 times the source's size takes the source whole and then two fifths
of it in a second order. Orders are hashes of documents, so no rows are sorted to draw them; a source's order is cut into
blocks, and its quota is the number of blocks up to its target. The tree splits the quotas of all sources at once: at each node
the left half of the output shards gets a multivariate-hypergeometric draw of what the node has, so every shard gets its
exact number of blocks and every way of dealing them is equally likely. A shard then holds, of each source, a range of the
source's blocks that no other shard has, and its documents are shuffled among themselves.

Draws are seeded by the node, so a task finds the shard of a block by walking down the tree, without asking other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, whole_text

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has so many words for each word of the sources, and no source more than so many times its own.
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 65_536
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 8
#: Bits of an order's keys, and how many of them one pass tells apart.
KEY_BITS, PASS_BITS = 60, 12
#: A source that misses more than this part of its target has so many documents around the end of its order chosen anew, longer ones left out.
NEAR, AROUND, LONGEST_AROUND = 1e-4, 40, 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row a source, which is kept in one task.

    Sources weigh in turn as `weights` say, by code point, a null source last. All targets make `share` times all sizes; a target stops at `most` times its
    source's size, and what is beyond goes to the others by weight until none is above: in the order of size to weight,
    the sources that stop are those before the first that can take its part of what the ones before it leave.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    rows = sizes.select("source", "source_size", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn).alias("weight"))
    cap = F.col("source_size") * F.lit(most)
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("cap", cap).withColumns({
        "left": F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(after),
    })
    rows = rows.withColumn("rate", F.col("left") / F.col("weights")).withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    rate = F.first(F.when(F.col("fits"), F.col("rate")), ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("rate_all").isNull() | (F.col("rate_all") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("rate_all") * F.col("weight"))
    return rows.withColumn("rate_all", rate).select("source", "source_size", target.alias("target"))


def _order_key(content: Column, epoch: Column) -> Column:
    """A document's place in the order of one epoch: KEY_BITS random bits."""
    return F.shiftrightunsigned(F.xxhash64(content, epoch), 64 - KEY_BITS)


def _compact(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, content): what the plan is made of, about 40 bytes a document."""
    text, source = whole_text(text_col), F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text), source).alias("content"))


@dataclass
class Mixture:
    """What tasks need of all sources, one entry a source: whole epochs, the last epoch's end, blocks and quotas."""

    sources: dict[str | None, int]
    whole: np.ndarray
    below: np.ndarray  # documents below this key of the last epoch are taken
    turned: frozenset[tuple[int, int]]  # but for these (source, key), which are taken if they lie beyond and left if they don't
    blocks: np.ndarray
    quotas: np.ndarray
    shards: int
    seed: int
    halves: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def half(self, low: int, high: int, counts: np.ndarray) -> np.ndarray:
        """Blocks of each source that the left half of the shards from `low` to `high` gets, of the node's `counts`."""
        if (low, high) not in self.halves:
            slots = _slots(int(self.quotas.sum()), self.shards, low, (low + high) // 2)
            drawn = np.random.default_rng((self.seed, low, high)).multivariate_hypergeometric(counts, slots, method="marginals")
            self.halves[low, high] = drawn
        return self.halves[low, high]

    def shard_of(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """Shards of the blocks by their source and their number in the source's draws."""
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.shards, self.quotas, np.zeros_like(self.quotas), np.arange(len(source)))]
        while todo:
            low, high, counts, offset, rows = todo.pop()
            if not len(rows):
                continue
            if high - low == 1:
                out[rows] = low
                continue
            left = self.half(low, high, counts)
            is_left = draw[rows] - offset[source[rows]] < left[source[rows]]
            middle = (low + high) // 2
            todo += [(low, middle, left, offset, rows[is_left]), (middle, high, counts - left, offset + left, rows[~is_left])]
        return out

    def block(self, source: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The block of a key: its part of the order's range."""
        return ((key >> 29) * self.blocks[source]) >> (KEY_BITS - 29)

    def draws(self, source: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, epoch, draw) of each time that a document is taken. keys: of each document in each epoch."""
        taken = []
        for epoch in range(keys.shape[1]):
            key, whole = keys[:, epoch], self.whole[source]
            last = key < self.below[source]
            for row in np.flatnonzero(np.isin(key, [k for _, k in self.turned])):
                last[row] ^= (int(source[row]), int(key[row])) in self.turned
            last &= epoch == whole
            rows = np.flatnonzero((epoch < whole) | last)
            number = self.block(source[rows], key[rows]) + epoch * self.blocks[source[rows]]
            taken.append((rows, np.full(len(rows), epoch), np.minimum(number, self.quotas[source[rows]] - 1)))
        return tuple(np.concatenate(x) for x in zip(*taken, strict=True))


def _slots(total: int, shards: int, low: int, high: int) -> int:
    """Blocks of the shards from `low` to `high`, when all shards have the same number but for one."""
    return total * high // shards - total * low // shards


def _ends(compact: DataFrame, targets: list, most: int) -> dict[str | None, tuple[int, int, float, frozenset[int]]]:
    """By source: whole epochs, the key up to which the last epoch's documents are taken, the words still missing, and no turned keys.

    The key where a source's words reach what its whole epochs leave of the target is narrowed by PASS_BITS in each
    pass over the compact table, until a range holds one document (or equal ones, which stay together).
    """
    spark = compact.sparkSession
    schema = "source string, epoch int, low long, need double"
    state: dict[str | None, list] = {}
    for t in targets:
        size = t["source_size"]
        whole = int(min(most, t["target"] // size)) if size else 0
        need = t["target"] - whole * size if whole < most and size else 0.0
        state[t["source"]] = [whole, 0, need]
    open_ = [s for s, (_, _, need) in state.items() if need > 0]
    for shift in range(KEY_BITS - PASS_BITS, -1, -PASS_BITS):
        if not open_:
            break
        now = spark.createDataFrame([(s, *state[s]) for s in open_], schema).withColumnRenamed("source", "s")
        rows = compact.join(now, F.col("source").eqNullSafe(F.col("s")))
        rows = rows.withColumn("key", _order_key(F.col("content"), F.col("epoch"))).where(F.shiftright("key", shift + PASS_BITS) == F.shiftright("low", shift + PASS_BITS))
        parts = rows.groupBy("s", "need", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("held"))
        before = F.sum("words").over(Window.partitionBy("s").orderBy("part")) - F.col("words")
        ends = parts.withColumn("before", before).where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words")))
        found = ends.select("s", "part", "before", "held").collect()  # one row a source
        # A source whose words end before its need, which rounding alone can cause, is taken up to the end of its range.
        for s in set(open_) - {r["s"] for r in found}:
            state[s][1] += 1 << (shift + PASS_BITS)
        open_ = []
        for r in found:
            one = state[r["s"]]
            one[1], one[2] = r["part"] << shift, one[2] - r["before"]
            if r["held"] > 1:
                open_.append(r["s"])
    return {s: (whole, low, need, frozenset()) for s, (whole, low, need) in state.items()}


def nearest_sum(words: list[int], wanted: float) -> list[bool]:
    """Which of the numbers to take so that their sum comes nearest to the wanted one; of two equally near the lower."""
    reached, bits = [1], 1
    for w in words:
        bits |= bits << w
        reached.append(bits)
    floor = max(0, int(wanted))
    low = (bits & ((1 << (floor + 1)) - 1)).bit_length() - 1
    above = bits >> (floor + 1)
    total = low
    if above:
        high = floor + (above & -above).bit_length()
        total = high if high - wanted < wanted - low else low
    taken = [False] * len(words)
    for k in range(len(words) - 1, -1, -1):
        if not reached[k] >> total & 1:
            taken[k], total = True, total - words[k]
    return taken


def _adjusted(compact: DataFrame, ends: dict, targets: list) -> dict:
    """The ends with the documents around them chosen anew, where a source misses more than NEAR of its target.

    Of such a source, the AROUND documents next to the end of its order come to the driver as (key, size), and those are
    taken that bring its words nearest to the target.
    """
    by_source = {t["source"]: t["target"] for t in targets}
    todo = [(s, whole, low, need) for s, (whole, low, need, _) in ends.items() if abs(need) > NEAR * by_source[s]]
    if not todo:
        return ends
    now = compact.sparkSession.createDataFrame(todo, "source string, epoch int, low long, need double").withColumnRenamed("source", "s")
    rows = compact.where(F.col("size").between(1, LONGEST_AROUND)).join(now, F.col("source").eqNullSafe(F.col("s"))).withColumn("key", _order_key(F.col("content"), F.col("epoch")))
    near = rows.withColumn("place", F.rank().over(Window.partitionBy("s").orderBy(F.abs(F.col("key") - F.col("low")), "key"))).where(F.col("place") <= AROUND)
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in near.groupBy("s", "key").agg(F.sum("size").alias("words")).where(F.col("words") <= LONGEST_AROUND).collect():  # AROUND rows a source; equal rows stay together
        found.setdefault(r["s"], []).append((r["key"], r["words"]))
    for s, own in found.items():
        whole, low, need, _ = ends[s]
        own.sort()
        wanted = need + sum(w for key, w in own if key < low)
        taken = nearest_sum([w for _, w in own], wanted)
        ends[s] = (whole, low, wanted - sum(w for (_, w), t in zip(own, taken, strict=True) if t), frozenset(key for (key, _), t in zip(own, taken, strict=True) if t != (key < low)))
    return ends


def _mixture(compact: DataFrame, targets: list, most: int, block_words: int, shard_words: int, seed: int) -> Mixture:
    ends = _adjusted(compact, _ends(compact, targets, most), targets)
    sizes = np.array([t["source_size"] for t in targets], np.int64)
    whole = np.array([ends[t["source"]][0] for t in targets], np.int64)
    below = np.array([ends[t["source"]][1] for t in targets], np.int64)
    turned = frozenset((k, key) for k, t in enumerate(targets) for key in ends[t["source"]][3])
    blocks = np.maximum(1, -(-sizes // block_words))
    made = Mixture({t["source"]: k for k, t in enumerate(targets)}, whole, below, turned, blocks, np.zeros(len(targets), np.int64), 1, seed)
    part = np.where(below > 0, made.block(np.arange(len(targets)), np.maximum(below - 1, 0)) + 1, 0)
    made.quotas = whole * blocks + np.maximum(part, np.isin(np.arange(len(targets)), [k for k, _ in turned]).astype(np.int64))
    made.shards = int(max(LEAST_SHARDS, -(-sum(t["target"] for t in targets) // shard_words)))
    return made


_DRAWS = pa.list_(pa.struct([("epoch", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("place", pa.int64())]))


def _planned(compact: DataFrame, mixture: Mixture, epochs: int) -> DataFrame:
    """The compact table with its draws."""
    shared = compact.sparkSession.sparkContext.broadcast(mixture)
    keyed = compact.withColumn("keys", F.array(*(_order_key(F.col("content"), F.lit(e)) for e in range(epochs))))
    keyed = keyed.withColumn("place", F.xxhash64("content", F.lit(mixture.seed)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            names = batch.column("source").dictionary_encode()
            numbers = np.array([m.sources[x] for x in names.dictionary.to_pylist()] + [m.sources.get(None, 0)], np.int64)
            source = numbers[names.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.int64)
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(n, epochs)
            rows, epoch, number = m.draws(source, keys)
            order = np.argsort(rows, kind="stable")
            rows, epoch, number = rows[order], epoch[order], number[order]
            place = batch.column("place").to_numpy(zero_copy_only=False)[rows] ^ (epoch * 0x5851F42D4C957F2D)
            parts = [pa.array(epoch, pa.int32()), pa.array(number), pa.array(m.shard_of(source[rows], number)), pa.array(place, pa.int64())]
            ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            draws = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_DRAWS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("size"), batch.column("content"), draws], names=["doc_id", "source", "size", "content", "draws"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(deal, f"doc_id {kind}, source string, size long, content long, draws array<struct<epoch: int, block: long, shard: long, place: long>>")


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 13,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, content, source_size, target, draws) for each row: draws are the times it is taken, as (epoch, block, shard, place).

    A null text has no words, and a null source is a source of its own, the last. Rows of one doc_id, text and source are
    taken together; a text without words has draws, but adds none. An empty table, or one without words, gives targets of 0. Other columns
    are not read. The table of sources, one row each, is held by the driver and by each task; texts are read once.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    compact = scratch.keep(_compact(docs, id_col, text_col, source_col), "compact")
    sizes = compact.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.keep(source_targets(sizes, weights, share, most), "targets")
    mixture = _mixture(compact, targets.collect(), most, block_words, shard_words, seed)
    planned = _planned(compact, mixture, most)
    named = targets.withColumnRenamed("source", "s")
    return planned.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each row, repeats counted."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of docs and mix_shard, mix_epoch, each shard in one range of rows and in its shuffled order."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = plan.select("content", "draws").dropDuplicates(["content"]).select("content", F.explode("draws").alias("d"))
    text, source = whole_text(text_col), F.col(source_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text), source).alias("content"))
    rows = rows.join(taken, "content").repartitionByRange(F.col("d.shard"), F.col("d.place")).sortWithinPartitions("d.shard", "d.place", "content")
    return rows.select("row.*", F.col("d.shard").alias("mix_shard"), F.col("d.epoch").alias("mix_epoch"))
