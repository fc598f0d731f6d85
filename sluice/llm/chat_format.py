"""Chat formatting with a compiled template, and reading the result back.

Control strings inside roles and texts are escaped: every `<` followed by backslashes and `|` gets one backslash
more, so no text can hold `<|`, and taking one backslash away gives the text back.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.template import Name, Output, Template

TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | name }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
#: Characters of turns that are formatted and sent on together, where a conversation lies in several tasks.
CHUNK_CHARS = 1 << 20


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_name(role: str) -> str:
    """A role is one line: its line ends and percent signs are written as %0A and %25."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_name(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


FILTERS = {"escape": escape, "name": escape_name}
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of each formatted turn; a text that is not wholly made of turns is refused."""
    turns, at = [], 0
    for found in _TURN.finditer(text):
        if found.start() != at:
            break
        turns.append((unescape_name(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return turns


class Reader:
    """Digests of a formatted conversation, taken part by part."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        for role, said in read_back(text):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{said}\n".encode())
        for a, b in spans:
            loss = unescape(text[a:b])
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


_REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text, in ranges: a long conversation lies in several tasks, in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _numbered(node: object) -> bool:
    """Whether a part of a template's tree asks for the number of the turn."""
    if isinstance(node, tuple):
        return any(map(_numbered, node))
    if isinstance(node, Name):
        return node.name == "loop"
    return dataclasses.is_dataclass(node) and any(_numbered(getattr(node, f.name)) for f in dataclasses.fields(node))


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, at, formatted, spans: each conversation's text, in parts of bounded size by (part, at).

    The spans are (start, end) in characters of the part's text. Turns with a null number come first, turns of one
    number by role and text, repeated rows all stay; null roles and texts are empty; a null conv_id is a
    conversation of its own. Only templates without a head or tail beside the loop, and without the number of the
    turn, are formatted by parts.
    """
    compiled = Template(template, FILTERS)
    if len(compiled.tree) != 1:
        raise ValueError("the template writes something beside its turns")
    if _numbered(compiled.tree):
        raise ValueError("the template asks for the number of a turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, template_ = TaskContext.get().partitionId(), Template(template, FILTERS)
        now, out, at, first = None, Output(), 0, True

        def made() -> pa.RecordBatch:
            spans = pa.array([[{"start": a, "end": b} for a, b in out.spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([out.text()], pa.string()), spans], names=["conv_id", "part", "at", "formatted", "spans"])

        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not first and (conv != now or out.size > CHUNK_CHARS):
                    yield made()
                    out, at = Output(), at + 1
                now, first = conv, False
                template_.turns(out, [{"role": role, "text": text}])
        if not first:
            yield made()

    return _ordered(conversations).mapInArrow(run, "conv_id long, part int, at long, formatted string, spans array<struct<start: long, end: long>>")


def conversation_report(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its formatted text: turns and loss text, counted and hashed.

    The digest of a conversation needs its parts in order, so they meet in one task, which holds one part at a time.
    """
    parts = format_turns(conversations, template).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            done = []
            for conv, _, _, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    now, reader = conv, Reader()
                reader.add(text, [(s["start"], s["end"]) for s in spans])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(_TYPES)], names=_NAMES)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, *reader.row()), _TYPES, strict=True)], names=_NAMES)

    return parts.mapInArrow(run, _REPORT)
