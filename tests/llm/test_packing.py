"""Best-fit packing: ids against the library over all planes, bins against filling each one piece by piece."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from sluice.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library_over_all_planes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_RUNS", 5_000)  # runs come back from the older half
    monkeypatch.setattr(packing, "BLOCK_BYTES", 20_000)
    tokenizer = packing.WordTokenizer(WORDS)
    rnd = random.Random(8)

    def sign():
        kind = rnd.random()
        code = ord(rnd.choice("ab'stREled 1.,!ßİΣς́՘₽\x1c\x85<|endoftext|>")) if kind < 0.5 else rnd.randrange(0x10000) if kind < 0.8 else rnd.randrange(0x110000)
        return "" if 0xD800 <= code < 0xE000 else chr(code)

    texts = ["".join(sign() for _ in range(rnd.randint(0, 12))) for _ in range(60_000)]
    texts += ["՘₽", "₏‱", "₰₏", "word " * 300, "x" * 5_000, "It's WE'LL they'd 'tis o'clock", "<|endoftext|>a <|startoftext|>", "", " \n "]
    want = [e.ids for e in tokenizer.library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in tokenizer.ids(pa.array(texts))] == want
    assert not list(tokenizer.ids(pa.array([], pa.string())))


def bin_by_bin(lengths, capacity):
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            held.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(held) > 1:
            room = min(held) + gap
            pairs = [(x + y, -x) for i, x in enumerate(left) for y in left[i + 1 :] if x + y <= room]
            if pairs and max(pairs)[0] > min(held):
                total, x = max(pairs)
                left.append(min(held))
                held.remove(min(held))
                for piece in (-x, total + x):
                    left.remove(piece)
                    held.append(piece)
                left.sort()
        bins.append(sorted(held, reverse=True))
    return bins


def test_the_plan_is_that_of_single_bins():
    rnd = random.Random(4)
    for _ in range(400):
        capacity = rnd.randint(4, 40)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 50))]
        if rnd.random() < 0.3:
            lengths += [rnd.randint(1, capacity)] * rnd.randint(5, 60)
        plan = packing.plan_bins({x: lengths.count(x) for x in set(lengths)}, capacity)
        made = [sorted((x for x, n in used for _ in range(n)), reverse=True) for times, used in plan for _ in range(times)]
        assert made == bin_by_bin(lengths, capacity)


def test_many_pieces_of_one_length_and_clashing_names(spark):
    rows = [(k % 5 if k % 11 else None, "two words", k, "s", 1.5) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, salt long, rank string, length double")
    got = packing.pack(frame, WORDS, capacity=10).collect()
    assert len(got) == 300 and {r.length for r in got} == {3}
    places = {(r.sequence_id, r.offset) for r in got}
    assert places == {(s, o) for s in range(100) for o in (0, 3, 6)}
    assert np.array_equal(sorted(r.doc_id is None for r in got), sorted(k % 11 == 0 for k in range(300)))
