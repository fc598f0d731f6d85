"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded difference score.

Every byte with two of the three bytes before it is hashed to one of 128 buckets. The digest holds, for each
bucket, which quarter of the counts it lies in (two bits), the logarithm of the text's length, and the ratios of the
quartiles. Two digests differ by the distance of these parts; the likeness is 1 less the difference over its bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, whole_text

BUCKETS = 128
#: Which bytes before a byte make a triplet with it.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
LENGTH_STEP = 1.3
#: The difference from which two digests count as wholly unlike.
BOUND = 300
#: Bytes of text in a range of ids at most, on average; ranges for each core at least; rows sampled for each range.
RANGE_BYTES = 64 << 20
RANGES_A_CORE = 4
OVERSAMPLE = 16
#: What a row weighs beside its text, in bytes.
ROW_BYTES = 256
#: Bytes that are hashed together.
CHUNK = 1 << 20
_KEY = np.dtype([("at", "i8"), ("tie", "i8")])
_U32 = np.uint32


def digest(data: bytes) -> str:
    """64 hex digits of bucket quarters, 2 of length, 2 of quartile ratios. Equal bytes have equal digests."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), CHUNK):
        from_ = max(0, at - 3)
        b = np.frombuffer(data[from_ : at + CHUNK], dtype=np.uint8).astype(_U32)
        for k, (first, second) in enumerate(TRIPLETS):
            skip = max(second, at - from_)  # the bytes that end a triplet of this chunk
            if len(b) > skip:
                code = b[skip:] << _U32(16) | b[skip - first : len(b) - first] << _U32(8) | b[skip - second : len(b) - second]
                hashed = (code + _U32(k << 24)) * _U32(0x9E3779B1)
                counts += np.bincount(hashed >> _U32(25), minlength=BUCKETS)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quarter[::4] << 6 | quarter[1::4] << 4 | quarter[2::4] << 2 | quarter[3::4]
    length = min(255, round(np.log(len(data) + 1) / np.log(LENGTH_STEP)))
    ratios = (16 * q1 // q3 % 16 if q3 else 0) << 4 | (16 * q2 // q3 % 16 if q3 else 0)
    return packed.astype(np.uint8).tobytes().hex() + f"{length:02x}{ratios:02x}"


def difference(a: str, b: str) -> int:
    """Distance of two digests: a quarter counts 1, two 3, three 6; length and ratios count their steps, to a bound."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = 0
    if x[:-2] != y[:-2]:
        u, v = (np.frombuffer(z[:-2], dtype=np.uint8) for z in (x, y))
        for shift in (0, 2, 4, 6):
            total += int(_STEPS[(u >> shift & 3).astype(np.int64) * 4 + (v >> shift & 3)].sum())
    total += 4 * min(12, max(0, abs(x[-2] - y[-2]) - 1))
    for shift in (0, 4):
        total += max(0, min((x[-1] >> shift & 15) - (y[-1] >> shift & 15) & 15, (y[-1] >> shift & 15) - (x[-1] >> shift & 15) & 15) - 1)
    return min(BOUND, total)


_STEPS = np.array([(0, 1, 3, 6)[abs(a - b)] for a in range(4) for b in range(4)])


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal digests."""
    return 1.0 - difference(a, b) / BOUND


@dataclass
class Ranges:
    """Ranges of the key (at, tie) by their upper ends, which are keys of rows; the last is the largest.

    A key that fills several ranges, rows of one id and text, has them all: `parts` of them, of which the lowest
    also takes the smaller keys down to the next end.
    """

    ends: np.ndarray
    parts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.parts)])


def _ranges(rows: DataFrame) -> Ranges:
    """Ends that deal about the same number of bytes to each range, from a sample.

    The sampled keys are put in order and counted by Spark; only the ends come to the driver, as columns: 24 bytes for RANGE_BYTES of text.
    """
    weight = F.octet_length("text") + ROW_BYTES
    size, top = rows.agg(F.sum(weight), F.max("at")).first()
    if top is None:
        return Ranges(np.zeros(0, _KEY), np.zeros(0, np.int64))
    wanted = max(-(-size // RANGE_BYTES), RANGES_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    unit = max(1, size // (wanted * OVERSAMPLE))
    sampled = rows.where(F.rand(9) * unit < weight).select("at", "tie")  # only the sizes of ranges depend on chance
    last = rows.where(F.col("at") == top).agg(F.max("tie")).first()[0]
    scratch = Scratch(rows.sparkSession, "ranges")
    held = sampled.groupBy("at", "tie").agg(F.count("*").alias("n")).repartitionByRange("at", "tie").sortWithinPartitions("at", "tie")
    held = scratch.keep(held.withColumn("piece", F.spark_partition_id()), "sample")
    pieces = held.groupBy("piece").agg(F.sum("n").alias("total"))
    pieces = pieces.withColumn("ahead", F.sum("total").over(Window.orderBy("piece")) - F.col("total")).drop("total")  # a row a partition
    before = F.col("ahead") + F.sum("n").over(Window.partitionBy("piece").orderBy("at", "tie")) - F.col("n")
    counted = held.join(pieces, "piece").withColumn("before", before)
    parts = F.floor((F.col("before") + F.col("n")) / OVERSAMPLE) - F.floor(F.col("before") / OVERSAMPLE)
    made = counted.select("at", "tie", parts.alias("parts")).where("parts > 0").toArrow().sort_by([("at", "ascending"), ("tie", "ascending")])
    scratch.remove()
    ends = np.empty(made.num_rows + 1, _KEY)
    ends["at"], ends["tie"] = np.append(made["at"].to_numpy(), top), np.append(made["tie"].to_numpy(), last)
    parts = np.append(made["parts"].to_numpy(), 1).astype(np.int64)
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends, parts = ends[:-1], parts[:-1]
    return Ranges(ends, parts)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited text, and the next document, by descending doc_id, compared.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per input row.
    Null text is the empty text. Rows with one doc_id, or with none, which come last, follow each other by a hash of
    their text, so equal ones follow each other. A table's only row is its own next. An empty table gives no rows, and
    other columns are not read. A very long text lies in one task, where it is hashed in pieces of bounded size.

    The texts are shuffled once, into ranges of ids; the first row of each range is also sent to the range before.
    """
    doc_id = F.col(id_col).cast("long")
    text = whole_text(text_col)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("at"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found = _ranges(rows)
    ranges_, n = docs.sparkSession.sparkContext.broadcast(found), len(found.ends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ranges = 0, ranges_.value
        firsts = ranges.firsts
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.empty(batch.num_rows, _KEY)
            key["at"], key["tie"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            group = np.searchsorted(ranges.ends, key)
            ends = np.flatnonzero(ranges.ends[group] == key)
            part = firsts[group]
            # Rows of an end's key are dealt over its ranges, the first of a batch to the lowest.
            held, first, which = np.unique(group[ends], return_index=True, return_inverse=True)
            part[ends] += (np.arange(len(ends)) + turn) % ranges.parts[group[ends]]
            part[ends[first]] = firsts[held]
            turn += len(ends)
            # In descending order, a range begins with its end, which follows the range above; the lowest is followed by the highest.
            index = np.concatenate([np.arange(len(key)), ends[first]])
            parts = np.concatenate([part, firsts[(held + 1) % n]])
            guest = np.arange(len(index)) >= len(key)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(guest), *batch.take(pa.array(index)).columns], names=["part", "guest", "doc_id", "at", "tie", "text"])

    dealt = rows.mapInArrow(deal, "part long, guest boolean, doc_id long, at long, tie long, text string")
    dealt = dealt.repartitionById(max(1, int(found.firsts[-1])), F.col("part").cast("int")).sortWithinPartitions("part", "guest", F.desc("at"), F.desc("tie")).select("part", "guest", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, doc_id, text, fingerprint
        closed = None

        def last() -> tuple:
            # Only a range that one key has beside others ends without a guest: the row that follows is the same again.
            if held[0] in ranges_.value.firsts[:-1]:
                raise ValueError("a range has no next row")
            return _compared(*held[1:], *held[2:])

        for batch in batches:
            out: list[tuple] = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == closed:
                    continue  # guests after the first
                mark = held[3] if held is not None and held[2] == text else digest(text.encode())
                if held is not None:
                    out.append(last() if held[0] != part else _compared(held[1], held[2], held[3], text, mark))
                held = None if guest else (part, doc_id, text, mark)
                closed = part if guest else closed
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], names=_NAMES)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last(), _TYPES, strict=True)], names=_NAMES)

    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(doc_id: int | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    edited_mark = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)
