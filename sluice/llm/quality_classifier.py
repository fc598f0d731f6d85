"""Quality classifier: random-indexing word vectors, pooled per document, then a small calibrated network.

Every token has a sparse ternary index vector made from its hash. A token's word vector is the sum of the index
vectors around its occurrences; a document is the mean of its words' vectors, with the mean likeness of neighbours.
A network of two layers, trained with numpy, gives a probability whose temperature is calibrated on held-back rows
of the training part. All of it is fitted on a bounded sample of labelled rows, and nothing but the text is read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean, whole_text
from sluice.llm.quality_rules import keep_rows, labelled_sample

DIMENSIONS = 48
NONZERO = 6
WINDOW = 2
#: Words with a vector of their own; rarer ones share the vector of their shape.
VOCABULARY = 20_000
#: Labelled rows that the vectors and the network are fitted on, with their whole texts.
SAMPLE_ROWS = 3_000
HIDDEN = 24
THRESHOLD = 0.3
REMEMBERED_WORDS = 400_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"(.)\1+")


def _class(c: str) -> str:
    return "9" if c.isnumeric() else c if not c.isalpha() else "X" if c.isupper() else "x"


def shape(word: str) -> str:
    """The word with runs of small letters, capitals and digits as x, X and 9; of more than 8 signs, those at its ends."""
    signs = _RUN.sub(r"\1", "".join(map(_class, word)))
    return signs if len(signs) <= 8 else signs[:4] + signs[-4:]


def index_vector(token: str) -> np.ndarray:
    """A sparse ternary vector that depends on the token only."""
    random = np.random.default_rng(xxhash.xxh3_64_intdigest(token))
    made = np.zeros(DIMENSIONS, dtype=np.float32)
    made[random.choice(DIMENSIONS, NONZERO, replace=False)] = np.tile([1.0, -1.0], NONZERO // 2)
    return made


@dataclass
class WordVectors:
    """Vectors by token; a token is a word, or the shape of a word that has no vector."""

    rows: dict[str, int]
    vectors: np.ndarray  # unit length; the last one, of an unknown shape, is 0

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "vectors": self.vectors, "known": {}}

    def _row(self, word: str) -> int:
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        row = self.rows.get(word)
        if row is None:
            row = self.rows.get(" " + shape(word), len(self.vectors) - 1)
        self.known[word] = row
        return row

    def pool(self, text: str) -> np.ndarray:
        """The document's vector: mean and spread of its words' vectors, and the likeness of neighbours."""
        known, row = self.known, self._row
        at = np.array([known[w] if w in known else row(w) for w in WORD.findall(text)], dtype=np.int64)
        out = np.zeros(2 * DIMENSIONS + 3, dtype=np.float32)
        if len(at):
            own = self.vectors[at]
            out[:DIMENSIONS] = own.mean(axis=0)
            out[DIMENSIONS : 2 * DIMENSIONS] = own.std(axis=0)
            out[-1] = 1
        if len(at) > 1:
            out[-2] = np.einsum("ij,ij->i", own[1:], own[:-1]).mean()
            out[-3] = (at[1:] == at[:-1]).mean()
        return out


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where `at` repeats."""
    if len(at):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)


def fit_vectors(texts: list[str], vocabulary: int = VOCABULARY) -> WordVectors:
    """Random indexing over the texts."""
    split = [WORD.findall(t) for t in texts]
    counts = Counter(w for words in split for w in words)
    top = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:vocabulary]
    rows = {w: k for k, w in enumerate(top)}
    marks = {w: " " + shape(w) for w in counts}  # a shape's key starts with a blank, which no word holds
    for mark in sorted(set(marks.values())):
        rows[mark] = len(rows)
    of_shape = {w: rows[mark] for w, mark in marks.items()}
    of_word = {w: rows.get(w, k) for w, k in of_shape.items()}
    index = np.stack([*(index_vector(w) for w in rows), np.zeros(DIMENSIONS, np.float32)])
    total = np.zeros_like(index)
    for words in split:
        own = np.array([of_word[w] for w in words], dtype=np.int64)
        shapes = np.array([of_shape[w] for w in words], dtype=np.int64)
        single = index[shapes] + 0.5 * index[own]
        near = np.zeros_like(single)
        for step in range(1, WINDOW + 1):
            near[step:] += single[:-step]
            near[:-step] += single[step:]
        _add_rows(total, np.concatenate([own, shapes]), np.concatenate([near, near]))
    # What all tokens share, by their number, tells nothing.
    seen = np.array([counts.get(k, 0) for k in rows] + [0], dtype=np.float64)
    total -= (seen[:, None] * total).sum(axis=0) / max(seen.sum(), 1)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    # A token is known by itself as well as by what stands around it.
    total += 0.5 * np.stack([*(index[of_shape.get(k, rows[k])] for k in rows), index[-1]]) / np.sqrt(NONZERO)
    return WordVectors(rows, (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32))


@dataclass
class Network:
    """Two layers on standardised inputs; temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.maximum(x @ w1 + b1, 0)
        return hidden, hidden @ w2 + b2

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        """Standardised, and bounded: a text of one word over and over lies far outside in every direction."""
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logit = self._layers(self._inputs(rows))[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, seed: int = 11, steps: int = 600) -> Network:
        random = np.random.default_rng(seed)
        rows = rows.astype(np.float64)
        held = np.arange(len(rows)) % 5 == 4
        made = cls(rows.mean(axis=0), rows.std(axis=0) + 1e-3, [random.normal(0, rows.shape[1] ** -0.5, (rows.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
        x, y = made._inputs(rows[~held]), labels[~held].astype(float)
        # Both labels weigh the same in all, halfway: the rarer one would else hardly count.
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        weight = np.where(y > 0, share**-0.5, (1 - share) ** -0.5)
        weight /= max(weight.sum(), 1e-9)
        first, second = ([np.zeros_like(w) for w in made.weights] for _ in range(2))
        for step in range(1, steps + 1):
            hidden, logit = made._layers(x)
            error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
            back = np.outer(error, made.weights[2]) * (hidden > 0)
            slopes = [x.T @ back + 1e-4 * made.weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * made.weights[2], np.array([error.sum()])]
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                made.weights[k] = made.weights[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, y = made._layers(made._inputs(rows[held]))[1], labels[held].astype(float)
            loss = lambda t: np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit) / t))
            made.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        return made


@dataclass
class QualityModel:
    vectors: WordVectors | None
    network: Network | None
    constant: float = 0.5

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text."""
        if self.network is None or not texts:
            return np.full(len(texts), self.constant)
        return self.network.probabilities(np.stack([self.vectors.pool(t) for t in texts]).astype(np.float64))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id's decimal text leaves 0; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from at most `sample_rows` labelled rows that are not held out. One label alone, or none: a constant."""
    known = labels.where(~held_out(F.col("doc_id")))
    found = labelled_sample(docs, known, sample_rows, id_col, text_col).collect()
    texts, y = [r["text"] for r in found], np.array([r["label"] for r in found], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(None, None, float(np.clip((y.sum() + 1) / (len(y) + 2), 0, 1)))
    vectors = fit_vectors(texts)
    return QualityModel(vectors, Network.fit(np.stack([vectors.pool(t) for t in texts]), y))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row, null and empty texts too.

    A text without words has the score of the zero vector. Repeated rows are scored each and alike, long texts whole;
    a score equal to the threshold predicts 1. Labels of one kind alone give every text the same score, none at all
    0.5. A null doc_id is held out. An empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def filter_by_quality(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is below the threshold; `known` holds the labelled texts, if not docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs if known is None else known, labels, id_col, text_col))
    return keep_rows(docs, lambda texts: model.value.scores(texts) >= threshold, text_col)


def crc_remainder(doc_id: int, folds: int = 5) -> int:
    """The same remainder in plain Python."""
    return zlib.crc32(str(doc_id).encode()) % folds
