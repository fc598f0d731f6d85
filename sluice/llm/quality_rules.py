"""Quality rules: counts per document, and an isolation forest on the statistics made of them.

The base rules fail a text for fixed reasons. The forest isolates the statistics of every other text with random
splits: odd ones need few. Its trees draw their rows, as the method has it, from all of one half of the labelled rows,
whatever their labels; its threshold is calibrated on all rows of the other half, with a wrongly rejected clean row costing
far more than a kept bad one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lean, whole_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The forest is fitted on one half of the labelled rows and its threshold on the other; with fewer than so many in a half,
#: the base rules decide alone.
LEAST_ROWS = 16
TREES = 200
SUBSAMPLE = 256
#: Rows that all trees draw together; a half with more of them deals each tree rows of its own.
SAMPLE_ROWS = TREES * SUBSAMPLE
#: Parts of the scores' range in each of which rejected rows are added up from the highest score.
SCORE_BINS = 1 << 14
#: A clean row rejected weighs so many times a bad row kept.
CLEAN_WEIGHT = 100.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARK = bytes(c for c in range(256) if not (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126))
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            repeated += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated, _repeat_words(words)


def _repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    held = Counter(windows)
    covered = np.zeros(len(words), dtype=bool)
    again = np.fromiter((held[w] > 1 for w in windows), dtype=bool, count=len(windows))
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics(text: str, counts: tuple[int, ...]) -> list[float]:
    """Ratios that don't grow with the length of the text."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = counts
    data = text.encode()
    words, size = max(1, n_words), max(1, len(data))
    return [
        word_chars / words,
        min(2.0, n_symbols / words),
        n_dup_lines / (text.count("\n") + 1),
        n_repeat / words,
        len(data.translate(None, _NOT_UPPER)) / size,
        len(data.translate(None, _NOT_MARK)) / size,
        len(data.translate(None, _NOT_DIGIT)) / size,
    ]


def average_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees of random splits, as arrays: feature (-1 in a leaf), split, first child, path length added in a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    subsample: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> IsolationForest:
        random = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        depth = int(np.ceil(np.log2(max(2, size)))) + 2
        return cls([cls._tree(rows[random.choice(len(rows), size, replace=False)], depth, random) for _ in range(trees)], size)

    @classmethod
    def fit_dealt(cls, rows: np.ndarray, trees: int = TREES, seed: int = 7) -> IsolationForest:
        """Each tree from rows of its own: the k-th of `trees` from every `trees`-th row after the k-th."""
        random = np.random.default_rng(seed)
        size = len(rows) // trees
        depth = int(np.ceil(np.log2(max(2, size)))) + 2
        return cls([cls._tree(rows[k::trees][:size], depth, random) for k in range(trees)], size)

    @staticmethod
    def _tree(rows: np.ndarray, depth: int, random: np.random.Generator):
        nodes: list[list[float]] = []
        todo = [(rows, 0, 0)]
        nodes.append([-1, 0.0, 0, 0.0])
        while todo:
            mine, level, at = todo.pop()
            if level >= depth or len(mine) <= 1:
                nodes[at] = [-1, 0.0, 0, level + float(average_path(len(mine)))]
                continue
            low, high = mine.min(axis=0), mine.max(axis=0)
            usable = np.flatnonzero(high > low)
            if not len(usable):
                nodes[at] = [-1, 0.0, 0, level + float(average_path(len(mine)))]
                continue
            feature = int(random.choice(usable))
            split = random.uniform(low[feature], high[feature])
            child = len(nodes)
            nodes[at] = [feature, split, child, 0.0]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            left = mine[:, feature] < split
            todo += [(mine[left], level + 1, child), (mine[~left], level + 1, child + 1)]
        table = np.array(nodes)
        return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (rows[each, np.maximum(f, 0)] >= split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(average_path(self.subsample))))


def base_failed(counts: tuple[int, ...], min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> bool:
    return counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]


@dataclass
class RuleModel:
    forest: IsolationForest | None
    threshold: float

    def keeps(self, texts: list[str], counts: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: base_failed, kept, the forest's score."""
        failed = np.fromiter((base_failed(c) for c in counts), bool, len(counts))
        if self.forest is None or not texts:
            return failed, ~failed, np.zeros(len(texts))
        score = self.forest.scores(np.array([statistics(t, c) for t, c in zip(texts, counts, strict=True)]))
        return failed, ~failed & (score < self.threshold), score


def calibrate(scores: np.ndarray, clean: np.ndarray, weight: float = CLEAN_WEIGHT) -> float:
    """The threshold from which rows are rejected: most bad rows at the least cost of clean ones; inf without gain."""
    if clean.all() or not clean.any():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    bad, good = np.cumsum(~clean[order]) / (~clean).sum(), np.cumsum(clean[order]) / clean.sum()
    last = np.append(np.diff(scores[order]) != 0, True)
    gain = np.where(last, bad - weight * good, -np.inf)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    below = scores[order][best + 1] if best + 1 < len(order) else scores[order][best]
    return float((scores[order][best] + below) / 2)


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(id, label): a label given twice counts with its largest value; null labels and ids are left out."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(text, label, id): at most `rows` labelled rows, chosen and ordered by a hash of their ids, then by their text.

    A label given twice counts with its largest value; null labels and ids are left out, and so are labels without a
    text.
    """
    chosen = _known(labels, label).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    # `chosen` has at most `rows` rows of two numbers.
    return texts.join(F.broadcast(chosen), "id").select("text", "label", "id").orderBy(F.xxhash64("id"), "text").limit(rows)


def _measured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stats, failed, clean, h, t) of all labelled rows; h and t are hashes of the id and the text, by which they are ordered.

    Texts are measured where they are read, and only what is measured meets the labels.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [rule_counts(t) for t in texts]
            stats = pa.array([statistics(t, c) for t, c in zip(texts, counts, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([stats, pa.array([base_failed(c) for c in counts], pa.bool_()), *batch.columns[1:]], names=["stats", "failed", "id", "t"])

    text = whole_text(text_col)
    rows = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t")).where("id is not null")
    measured = rows.mapInArrow(lean(measure), "stats array<double>, failed boolean, id long, t long")
    return measured.join(_known(labels, "quality"), "id").select("stats", "failed", (F.col("label") == 1).alias("clean"), F.xxhash64("id").alias("h"), "t")


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with their number, from 0, in the order of (h, t): a row's place in its range, after the ranges before."""
    ordered = rows.repartitionByRange("h", "t").sortWithinPartitions("h", "t")
    placed = scratch.keep(ordered.withColumns({"piece": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "placed")
    starts, before = [], 0
    for r in placed.groupBy("piece").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("piece").collect():  # one row a range
        starts.append((r["piece"], before - r["first"]))
        before += r["n"]
    shift = rows.sparkSession.createDataFrame(starts, "piece int, shift long")
    return placed.join(F.broadcast(shift), "piece").withColumn("number", F.col("place") + F.col("shift")).drop("piece", "place", "shift")


def calibrate_rows(scored: DataFrame, scratch: Scratch, weight: float = CLEAN_WEIGHT) -> float:
    """The threshold of calibrate(), for scores from 0 to 1 in a table (score, clean): rows are added up in bins of the score, after the bins above."""
    each = scored.groupBy("score").agg(F.sum(F.when(F.col("clean"), 0).otherwise(1)).alias("bad"), F.sum(F.when(F.col("clean"), 1).otherwise(0)).alias("good"))
    each = scratch.keep(each.withColumn("bin", F.floor(F.col("score") * SCORE_BINS).cast("int")), "scores")
    bins = each.groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("score").alias("top")).orderBy(F.desc("bin")).collect()  # SCORE_BINS + 1 at most
    all_bad, all_good = sum(r["bad"] for r in bins), sum(r["good"] for r in bins)
    if not all_bad or not all_good:
        return np.inf
    starts, bad, good = [], 0, 0
    for r, below in zip(bins, [*bins[1:], None], strict=True):
        starts.append((r["bin"], bad, good, below["top"] if below else None))
        bad, good = bad + r["bad"], good + r["good"]
    above = scored.sparkSession.createDataFrame(starts, "bin int, bad_above long, good_above long, next double")
    down = Window.partitionBy("bin").orderBy(F.desc("score"))
    rejected = [(F.col(f"{c}_above") + F.sum(c).over(down)) / F.lit(n) for c, n in (("bad", all_bad), ("good", all_good))]
    gains = each.join(F.broadcast(above), "bin").select((rejected[0] - F.lit(weight) * rejected[1]).alias("gain"), "score", F.coalesce(F.lead("score").over(down), "next", "score").alias("below"))
    best = gains.orderBy(F.desc("gain"), F.desc("score")).first()
    return float((best["score"] + best["below"]) / 2) if best["gain"] > 0 else np.inf


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """A forest and its threshold from all labelled rows; without enough of them the base rules alone.

    Labelled rows are numbered by a hash of their ids. Trees draw from all rows of even number, SUBSAMPLE each; every row of
    odd number that the base rules pass counts for the threshold.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    try:
        rows = scratch.keep(_measured(docs, labels, id_col, text_col), "measured")
        rows = _numbered(rows, scratch)
        first, other = rows.where("number % 2 = 0"), rows.where("number % 2 = 1 and not failed")
        n_first, n_other = first.count(), other.count()
        if min(n_first, n_other) < LEAST_ROWS:
            return RuleModel(None, np.inf)
        drawn = np.random.default_rng(7).choice(n_first, SAMPLE_ROWS, replace=False) if n_first > SAMPLE_ROWS else None
        if drawn is not None:
            mine = docs.sparkSession.createDataFrame([(2 * int(k), place) for place, k in enumerate(drawn)], "number long, turn int")
            first = first.join(F.broadcast(mine), "number").withColumn("number", F.col("turn"))  # SAMPLE_ROWS of two numbers
        found = first.select("number", "stats").orderBy("number").collect()  # SAMPLE_ROWS at most, of seven numbers
        stats = np.array([r["stats"] for r in found])
        forest = IsolationForest.fit(stats) if drawn is None else IsolationForest.fit_dealt(stats)
        shared = docs.sparkSession.sparkContext.broadcast(forest)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    held = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value.scores(held)), batch.column(1)], names=["score", "clean"])

        return RuleModel(forest, calibrate_rows(other.select("stats", "clean").mapInArrow(lean(score), "score double, clean boolean"), scratch))
    finally:
        scratch.remove()


def rule_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, anomaly (the forest's score); one row per input row.

    Null and empty texts have no words and fail the base rules. Long texts are counted whole, repeated rows each; a
    score equal to the threshold rejects. Without enough labelled rows the base rules decide alone and the score is
    0. An empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, id_col, text_col))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [rule_counts(t) for t in texts]
            failed, kept, score = model.value.keeps(texts, counts)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(lean(report), schema)


def keep_rows(docs: DataFrame, verdict: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the verdict keeps."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "").to_pylist()
            yield batch.filter(pa.array(verdict(texts), pa.bool_()))

    return docs.mapInArrow(lean(filtered), docs.schema)


def filter_by_rules(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the base rules or the forest reject; `known` holds the labelled texts, if not docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_rules(docs if known is None else known, labels, id_col, text_col))
    return keep_rows(docs, lambda texts: model.value.keeps(texts, [rule_counts(t) for t in texts])[1], text_col)
