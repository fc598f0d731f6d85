"""Bounded memory and steps on texts of megabytes, and on many edits at one place."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from test_operators import ODD, SCHEMA

from sluice.llm import packing, piece_codec, token_counts

RANKS, WORDS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(RANKS, public_tokenizers.PATTERN)


def check_sums(counted):
    for node in range(1, counted.width):
        assert (counted.sums[node] == counted.sums[2 * node] + counted.sums[2 * node + 1]).all()
    assert len(counted.leaves) == counted.width and max(len(p) for p, _ in counted.leaves) <= 4 * token_counts.LEAF


def test_ten_thousand_edits_at_one_place_spread_few(counter):
    counted = token_counts.CountedText("word " * 20_000, counter)
    at = 50_000
    for k in range(10_000):
        counted.edit(at, at, f" w{k % 7}")
    check_sums(counted)
    assert counted.spread < 10_000 * 20 * 10  # a logarithm's worth for each pre-token, and far from the whole text each time
    text = "word " * 10_000 + "".join(f" w{k % 7}" for k in reversed(range(10_000))) + "word " * 10_000
    assert counted.text() == text and counted.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_edits_at_the_end_and_large_ones(counter):
    rnd, counted, text = random.Random(2), token_counts.CountedText("", counter), ""
    for k in range(400):
        new = rnd.choice(["a b", " the end.", "x" * 50, " many words" * rnd.choice([1, 300])])
        start = len(text) if k % 3 else rnd.randint(0, len(text))
        end = min(len(text), start + rnd.choice([0, 0, 4, 2_000]))
        counted.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert counted.n_chars == len(text)
    check_sums(counted)
    assert counted.text() == text and counted.n_tokens == len(counter.encoding.encode_ordinary(text))
    counted.edit(0, len(text), "")
    assert (counted.n_chars, counted.n_tokens, counted.text()) == (0, 0, "")


def test_long_runs_are_not_remembered(counter):
    rnd = random.Random(7)
    run = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    token_counts.CountedText(run[:200_000], counter)
    assert max(map(len, counter.known), default=0) <= token_counts.LONGEST_REMEMBERED
    codec = piece_codec.PieceCodec(PIECES)
    n, ids, _ = codec.digest(run)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [*library.encode(run), library.eos_id()]
    assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert not codec.known and not codec.held


def test_remembered_runs_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 100_000)
    monkeypatch.setattr(piece_codec, "REMEMBERED_BYTES", 100_000)
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=rnd.choice([3, 9, 60]))) for _ in range(300)) for _ in range(12)] * 2
    words, codec = packing.WordTokenizer(WORDS), piece_codec.PieceCodec(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts:
        assert next(iter(words.ids(pa.array([text])))).tolist() == words.library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == library.encode(text)
        assert words.held < 100_000 + 400 * len(text) and codec.held < 110_000


def test_digests_of_odd_rows_are_those_of_the_library(spark):
    odd = spark.createDataFrame([(*r, "clash", 1) for r in ODD], SCHEMA + ", ids_sha256 string, n_tokens long")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for doc_id, text in ODD:
        ids = [*library.encode(text or ""), library.eos_id()]
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_codec.encoding_digests(odd, PIECES).collect()), key=str) == sorted(want, key=str)
    assert piece_codec.encoding_digests(odd.limit(0), PIECES).collect() == []
