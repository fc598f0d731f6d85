"""Fingerprints against an independent digest, and ranges of large, equal and missing ids."""

import collections
import hashlib
import math
import random

import xxhash

from sluice.llm import fingerprints

SCHEMA = "doc_id long, text string, part string, tie string"


def digest(data):
    """The digest by its definition, one triplet after the other."""
    counts = [0] * 128
    for end in range(len(data)):
        for k, (a, b) in enumerate(((1, 2), (1, 3), (2, 3))):
            if end >= b:
                code = data[end] << 16 | data[end - a] << 8 | data[end - b]
                counts[(code + (k << 24)) * 0x9E3779B1 % 2**32 >> 25] += 1
    ordered = sorted(counts)
    q1, q2, q3 = ordered[31], ordered[63], ordered[95]
    bits = "".join(format((c > q1) + (c > q2) + (c > q3), "02b") for c in counts)
    ratio = lambda q: 16 * q // q3 % 16 if q3 else 0
    length = min(255, round(math.log(len(data) + 1) / math.log(1.3)))
    return f"{int(bits, 2):064x}{length:02x}{ratio(q1):x}{ratio(q2):x}"


def likeness(a, b):
    bits = [format(int(x[:64], 16), "0256b") for x in (a, b)]
    total = sum((0, 1, 3, 6)[abs(int(bits[0][k : k + 2], 2) - int(bits[1][k : k + 2], 2))] for k in range(0, 256, 2))
    total += 4 * min(12, max(0, abs(int(a[64:66], 16) - int(b[64:66], 16)) - 1))
    for k in (66, 67):
        apart = abs(int(a[k], 16) - int(b[k], 16))
        total += max(0, min(apart, 16 - apart) - 1)
    return 1 - min(300, total) / 300


def expected(rows):
    """Rows by descending id, equal ids by a descending hash of their text, the next one after each, the first after the last."""
    key = lambda r: (r[0] if r[0] is not None else -(2**63), (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64)
    rows = sorted(((d, t or "") for d, t in rows), key=key, reverse=True)
    made = []
    for k, (doc_id, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = [digest(x.encode()) for x in (text, edited, after)]
        made.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], likeness(marks[0], marks[1]), likeness(marks[0], marks[2])))
    return made


def check(spark, rows, ranges):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in fingerprints.fingerprint_report(frame).collect()]
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, expected(rows)))
    assert ranges is None or len({r for r in spread(frame)}) >= ranges


def spread(frame):
    """The ranges that have rows."""
    from pyspark.sql import functions as F

    plan = fingerprints.fingerprint_report(frame).select(F.spark_partition_id().alias("p")).distinct()
    return [r["p"] for r in plan.collect()]


def test_digests_equal_their_definition(monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 7)
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 7, 8, 50, 400):
        data = bytes(rnd.randrange(256) for _ in range(n))
        assert fingerprints.digest(data) == digest(data)
    a, b = (digest(bytes(rnd.randrange(97, 123) for _ in range(900))) for _ in range(2))
    assert fingerprints.likeness(a, b) == likeness(a, b) < 1


def test_ranges_of_any_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4_000)
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 80)))
    check(spark, [(2**60 + rnd.randrange(50), text()) for _ in range(200)], 4)
    check(spark, [(7, text()) for _ in range(200)], 4)
    check(spark, [(7, "the same text for all of them, as it happens") for _ in range(200)], 4)
    check(spark, [(None, "one text without an id") for _ in range(120)] + [(k, text()) for k in range(-40, 40)] + [(40, "")] * 60 + [(-(2**63), "low"), (2**63 - 1, None)], 4)
    check(spark, [(2**63 - 1, "top")] * 90 + [(5, "a"), (None, None)], None)
    check(spark, [(3, "alone")], None)
