"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: best-two-fit. A bin is filled greedily, longest piece first; then its smallest piece is given up for two
unpacked pieces whose sum fits the widened gap more tightly. Pieces of one length are interchangeable, so the fill
is planned over the histogram of lengths (at most `capacity` rows, whatever the corpus), and one planned bin is
repeated for as long as every length in it lasts: the same bins as when each is filled on its own. The plan is a
small table; giving the pieces their places is distributed work.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lean, whole_text

CAPACITY = 4096
END_ID = 1
#: Runs of text remembered by a Python worker, in each of two halves; longer runs go through the library.
REMEMBERED_RUNS = 600_000
#: About how many bytes the runs of one half of what is remembered may take, besides those of the last block.
REMEMBERED_BYTES = 24 << 20
LONGEST_RUN = 64
#: Bytes of texts that are tokenised together.
BLOCK_BYTES = 4 << 20
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _steady() -> str:
    """Code points of the basic plane whose category has not changed since Unicode 3.2, as ranges of a pattern."""
    old, code = unicodedata.ucd_3_2_0.category, [chr(c) for c in range(0x10000)]
    flags = np.array([old(c) == unicodedata.category(c) and old(c) not in ("Cn", "Cs", "Co") for c in code])
    turns = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y - 1))}" for x, y in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


@dataclass
class Ragged:
    """Lists of ids, one behind the other."""

    starts: np.ndarray  # one more than there are lists
    values: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, values: np.ndarray) -> Ragged:
        return cls(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), values)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Ragged:
        starts, lengths = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        made = Ragged.of(lengths, self.values[:0])
        made.values = self.values[np.arange(made.starts[-1]) + np.repeat(starts - made.starts[:-1], lengths)]
        return made

    def grouped(self, counts: np.ndarray) -> Ragged:
        """The lists joined, `counts` of them each."""
        return Ragged(self.starts[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)], self.values)

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.starts, other.starts[1:] + self.starts[-1]]), np.concatenate([self.values, other.values]))


_NOTHING = Ragged(np.zeros(1, np.int64), np.zeros(0, "<u4"))


class WordMerger:
    """Ids of many words at once. Words of one size are the rows of a matrix, and each step joins the leftmost pair of
    lowest rank in every row, so the rows lose one symbol each and stay a matrix."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = [vocab[a] * self.size + vocab[b] for a, b in merges]
        self.ranks = pd.Index(np.array(keys, dtype=np.int64))
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # Bytes are written as printable signs: those that are printable stand for themselves, the others follow from 256 on.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in set(printable)]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[signs[b] + "</w>"] for b in range(256)], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.get_indexer((left * self.size + right).ravel()).reshape(left.shape)
        return np.where(found < 0, len(self.made), found)

    def __call__(self, words: list[bytes]) -> Ragged:
        """The ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(order)]
        places, lengths, values = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and sizes[order[a]]:
                for at, ids in self._of_size([words[k] for k in order[a:b].tolist()], int(sizes[order[a]])):
                    places.append(order[a:b][at])
                    lengths.append(np.full(len(at), ids.shape[1]))
                    values.append(ids.ravel().astype("<u4"))
        made = Ragged.of(np.concatenate([*lengths, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, "<u4")]))
        back = np.zeros(len(words), dtype=np.int64)
        back[np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)] = np.arange(len(made))
        return made.take(back)

    def _of_size(self, words: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the words that are done after each step, with their ids."""
        data = np.frombuffer(b"".join(words), np.uint8).reshape(-1, size)
        ids = np.concatenate([self.inner[data[:, :-1]], self.last[data[:, -1:]]], axis=1)
        none = len(self.made)
        # A column without pairs at the end, so that the last symbol is no special case.
        rank = np.concatenate([self._rank(ids[:, :-1], ids[:, 1:]), np.full((len(ids), 1), none)], axis=1)
        at = np.arange(len(ids))
        while True:
            best = rank.argmin(axis=1)
            lowest = rank[np.arange(len(at)), best]
            going = lowest < none
            if not going.all():
                yield at[~going], ids[~going]
                at, ids, rank, best, lowest = (x[going] for x in (at, ids, rank, best, lowest))
            if not len(at):
                return
            each = np.arange(len(at))
            ids[each, best] = self.made[lowest]
            stay = np.ones(ids.shape, dtype=bool)
            stay[each, best + 1] = False
            ids = ids[stay].reshape(len(at), -1)
            rank = rank[stay].reshape(len(at), -1)
            rank[each, best] = none
            right = np.flatnonzero(best + 1 < ids.shape[1])
            rank[right, best[right]] = self._rank(ids[right, best[right]], ids[right, best[right] + 1])
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self._rank(ids[left, best[left] - 1], ids[left, best[left]])


class WordTokenizer:
    """Ids of a word-level BPE file as little-endian unsigned 32-bit bytes, equal to the library's own.

    The file lower-cases, splits at white space and into words, and merges inside a word, so a word's ids do not
    depend on its neighbours. Runs without white space are looked up first; the words of all runs that a block of
    texts brings anew are merged together. Runs with a character that Unicode versions may tell apart otherwise, and
    very long ones, go through the library; so do whole texts that hold a special token's string, which the library
    matches before splitting, or a separator that only Python counts as white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merger = WordMerger(json.load(f)["model"])
        whole = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.whole = "|".join([*whole, r"[\x1c-\x1f]"])
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.unsteady = re.compile(f"[^{_steady()}]")
        self.rows: dict[str, int] = {}  # of each run in `known`
        self.known = _NOTHING
        self.held = 0  # bytes of `known`, about
        self.older: tuple[dict[str, int], Ragged] = ({}, _NOTHING)

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts are taken in blocks of bounded size."""
        if not len(texts):
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._block(texts.slice(a, b - a))

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole)
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        runs = split.flatten().dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        self._learn(distinct)
        rows = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))
        own = self.known.take(rows[runs.indices.to_numpy()]).grouped(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        for k, by_library in enumerate(whole.to_pylist()):
            yield self._library_ids(texts[k].as_py()) if by_library else own.values[own.starts[k] : own.starts[k + 1]]

    def _learn(self, runs: list[str]) -> None:
        if len(self.rows) > REMEMBERED_RUNS or self.held > REMEMBERED_BYTES:  # what is met again comes back from the older half
            self.older, self.rows, self.known, self.held = (self.rows, self.known), {}, _NOTHING, 0
        rows, (old, held) = self.rows, self.older
        fresh = [run for run in runs if run not in rows]
        again = [run for run in fresh if run in old]
        self._add(again, held.take(np.fromiter(map(old.__getitem__, again), np.int64, len(again))))
        fresh = [run for run in fresh if run not in old] if again else fresh
        words: list[str] = []
        counts, plain, other = [], [], []
        for run in fresh:
            own = self._split(run) if len(run) <= LONGEST_RUN else None
            if own is None:
                other.append(run)
            else:
                plain.append(run)
                words += own
                counts.append(len(own))
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        merged = self.merger([w.encode() for w in number])
        self._add(plain, merged.take(np.fromiter(map(number.__getitem__, words), np.int64, len(words))).grouped(np.array(counts, dtype=np.int64)))
        found = [self._library_ids(run) for run in other]
        self._add(other, Ragged.of(np.array([len(x) for x in found], dtype=np.int64), np.concatenate([*found, _NOTHING.values])))

    def _add(self, runs: list[str], ids: Ragged) -> None:
        self.rows.update(zip(runs, range(len(self.rows), len(self.rows) + len(runs)), strict=True))
        self.known = self.known + ids
        self.held += 150 * len(runs) + 2 * sum(map(len, runs)) + ids.values.nbytes

    def _split(self, run: str) -> list[str] | None:
        """The run's words, normalised as the library does it; none for a run that the library has to split."""
        if run.isascii():
            run = run.lower()
        elif self.unsteady.search(run):
            return None
        else:  # unlike str.lower(), the library lower-cases a final sigma without looking at its neighbours
            run = unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower()
        if not run:
            return []
        if run.isalpha():  # the most common forms need no pattern
            return [run]
        if run[-1] in ".," and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.words.findall(run)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null or empty text: the end id alone."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, found in zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1)), strict=True):
                ids = found.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(lean(cut), PIECE_SCHEMA)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, pieces of that length), ...]) that use up the histogram."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    present = sorted(int(x) for x in np.flatnonzero(left))
    plan = []
    while present:
        used: dict[int, int] = {}
        gap, top = capacity, len(present)
        while top := bisect_right(present, gap, 0, top):
            length = present[top - 1]
            n = int(min(gap // length, left[length] - used.get(length, 0)))
            used[length] = used.get(length, 0) + n
            gap -= n * length
            top -= 1
        if gap and len(used) + sum(used.values()) > 2:
            _two_for_smallest(used, gap, left, present)
        times = int(min(left[length] // n for length, n in used.items()))
        plan.append((times, sorted(used.items(), reverse=True)))
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                present.remove(length)
    return plan


def _two_for_smallest(used: dict[int, int], gap: int, left: np.ndarray, present: list[int]) -> None:
    """Replace the bin's smallest piece by two unpacked ones, if their sum fits the widened gap more tightly."""
    smallest = min(used)
    room = smallest + gap
    free = np.array([x for x in present if x < room and left[x] > used.get(x, 0)], dtype=np.int64)
    if not len(free):
        return
    # For each first piece, the largest partner that still fits; a length pairs with itself only if two are free.
    at = np.searchsorted(free, room - free, side="right") - 1
    alone = (at >= 0) & (free[at] == free) & (left[free] - np.array([used.get(int(x), 0) for x in free]) < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, free + free[at], 0)
    best = int(np.argmax(total))
    if total[best] <= smallest:
        return
    used[smallest] -= 1
    if not used[smallest]:
        del used[smallest]
    for length in (int(free[best]), int(free[at[best]])):
        used[length] = used.get(length, 0) + 1


def _places(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset), by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, used in plan:
        offset = 0
        for length, n in used:
            rows.setdefault(length, []).append((rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence_id and offset; the sequences are gapless from 0 and hold `capacity` tokens at most.

    Every row of the table is packed, repeated rows too; a long text is cut into pieces of `capacity` tokens, null and
    empty texts have the end id alone. Pieces of one length are interchangeable: which of them comes into which
    sequence follows a hash of (doc_id, piece), then these. Rows without doc_id are packed as well. An empty table
    gives an empty result, and other columns than the id and the text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    # At most `capacity` rows reach the driver, however large the corpus is. The n pieces of one length are ranked in
    # about sqrt(n) salts of as many pieces, so neither a length that many pieces share nor its salts are one large task.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(length, math.isqrt(n - 1) + 1) for length, n in histogram.items()], "length long, salts long")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    places = spark.sparkContext.broadcast(_places(plan_bins(histogram, capacity), capacity))

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                rows = places.value[int(length)]
                rows = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
                within = ranks[mine] - rows[:, 0]
                sequence[mine] = rows[:, 1] + within // rows[:, 2]
                offset[mine] = rows[:, 3] + within % rows[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), PIECE_SCHEMA + ", sequence_id long, offset long")
