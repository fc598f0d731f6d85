"""What Python workers hold between tasks and stages."""

import pyarrow as pa
import public_tokenizers
import pytest

from sluice.llm import common, packing


def test_workers_return_unused_memory_when_a_task_begins_and_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (2 * x for x in batches))(iter([1, 2, 3]))) == [2, 4, 6] and len(calls) == 2

    def fails(batches):
        yield next(batches)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        list(common.lean(fails)(iter([1])))
    assert len(calls) == 4


def test_packing_remembers_few_runs_and_stays_right():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(0, 450_000, 50_000):
        list(tokenizer.ids(pa.array([" ".join(f"w{n}" for n in range(k, k + 50_000))])))
    assert len(tokenizer.rows) + len(tokenizer.older[0]) <= 2 * (24 << 20) // 150 + 50_000
    text = "W1 w449999 new, words w77"
    assert next(tokenizer.ids(pa.array([text]))).tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids
