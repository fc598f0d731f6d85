"""SentencePiece encoding and decoding of merge-type models, by backtracking.

Merging is replaced by a search from the left: at each place the longest pieces that start there (Aho-Corasick) are
tried first, and a piece may follow another only if merging the two texts together gives back just these two. A text's
encoding is the one sequence of pieces whose neighbours are all compatible: the first merge across a border would
also happen when the two pieces stand alone. Whether a prefix ends in such a sequence depends on its length only,
so a bit for each failed place bounds the search.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole_text

SPACE = "▁"
#: Runs of text remembered by a task, in each of two halves; pairs of pieces known to fit or not.
#: Runs in each of two halves of what is remembered, and about how many bytes they may take; longer runs are not remembered.
REMEMBERED_RUNS, REMEMBERED_BYTES, LONGEST_REMEMBERED = 400_000, 192 << 20, 256
REMEMBERED_PAIRS = 2_000_000
#: What a remembered run takes besides its characters.
ENTRY_BYTES = 300


class PieceModel:
    """The pieces of a model file of merge type: normal ones with their scores, byte pieces, and the flags used here."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with an identity normalizer are supported")
        if any(p.type == kinds.USER_DEFINED or p.type == kinds.UNUSED for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.texts = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_values = {k: value for value, k in self.bytes.items()}
        self.silent = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_surface = train.unk_surface
        self.end = next(k for k, p in enumerate(proto.pieces) if p.piece == (train.eos_piece or "</s>"))
        # Where no piece has a space sign behind another sign, nothing merges across the start of a run.
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)


class PieceCodec:
    """Exact encoding and decoding with a model."""

    def __init__(self, path: str):
        import ahocorasick

        self.model = PieceModel(path)
        self.longest = max(map(len, self.model.ids))
        self.matcher = ahocorasick.Automaton()
        for text in self.model.ids:
            self.matcher.add_word(text, len(text))
        self.matcher.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.held = 0  # bytes of `known`, about
        self.older: dict[str, tuple[int, str, str]] = {}
        # A line end is no piece of its own in most models; runs then end there, and are met again more often.
        single = "\n" if not any("\n" in t for t in self.model.ids) else ""
        self.runs = re.compile(f"{SPACE}+[^{SPACE}{single}]*|[^{SPACE}{single}]+" + (f"|{single}" if single else "")) if self.model.splits else re.compile(r"(?s).+")

    def _merged(self, text: str) -> list[str]:
        """The text after merging: the best-scored neighbours first, of equal ones the leftmost."""
        parts, scores = list(text), self.model.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > REMEMBERED_PAIRS:
                self.fits.clear()
            got = self.fits[a, b] = self._merged(a + b) == [a, b]
        return got

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text; a character that is no piece stands alone."""
        found: list[list[int]] = [[] for _ in text]
        for end, length in self.matcher.iter(text):
            found[end - length + 1].append(length)
        for lengths in found:
            lengths.sort()
        failed = 0  # a bit for each place that no compatible sequence goes on from
        path: list[str] = []
        todo: list[list[int]] = [found[0] or [1]] if text else []
        at, size = 0, len(text)
        tried = [len(todo[0])] if text else []
        while at < size:
            lengths, n = todo[-1], tried[-1]
            step = 0
            while n:
                n -= 1
                to = at + lengths[n]
                if not failed >> to & 1:
                    piece = text[at:to]
                    if self._own(piece) and (not path or self._compatible(path[-1], piece)):
                        step = to
                        break
            tried[-1] = n
            if step:
                path.append(text[at:step])
                at = step
                if at < size:
                    todo.append(found[at] or [1])
                    tried.append(len(todo[-1]))
            else:
                failed |= 1 << at
                todo.pop()
                tried.pop()
                if not path:
                    raise ValueError("no compatible sequence of pieces")
                at -= len(path.pop())
        return path

    def _own(self, piece: str) -> bool:
        """Whether merging the piece's own text gives the piece."""
        if len(piece) == 1:
            return True
        got = self.fits.get((piece, ""))
        if got is None:
            got = self.fits[piece, ""] = self._merged(piece) == [piece]
        return got

    def _ids(self, pieces: list[str]) -> list[int]:
        ids, model = [], self.model
        for piece in pieces:
            if piece in model.ids:
                ids.append(model.ids[piece])
            elif model.bytes:
                ids += [model.bytes[b] for b in piece.encode()]
            else:
                ids.append(model.unknown)
        return ids

    def _run(self, run: str) -> tuple[int, str, str]:
        """Of a run: number of ids, the ids each after a blank, and their decoded text."""
        got = self.older.get(run)
        if got is None:
            ids = self._ids(self.pieces(run))
            got = len(ids), "".join(f" {i}" for i in ids), self._surface(ids)
        if len(run) > LONGEST_REMEMBERED:
            return got
        if len(self.known) > REMEMBERED_RUNS or self.held > REMEMBERED_BYTES:  # what is met again comes back from the older half
            self.older, self.known, self.held = self.known, {}, 0
        self.known[run] = got
        self.held += ENTRY_BYTES + 2 * len(run) + len(got[1]) + 2 * len(got[2])
        return got

    def _encoded_runs(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        known, run_of = self.known, self._run
        runs = self.runs.findall(self.model.prefix + text.replace(" ", SPACE))
        return [known[r] if r in known else run_of(r) for r in runs]

    def encode(self, text: str, add_end: bool = False) -> list[int]:
        """Ids of the text."""
        ids = [int(i) for _, own, _ in self._encoded_runs(text) for i in own.split()]
        return [*ids, self.model.end] if add_end else ids

    def _surface(self, ids: list[int]) -> str:
        """The ids' text before a leading blank goes; runs of byte pieces are read as UTF-8."""
        model, out, held = self.model, [], bytearray()
        for i in [*ids, -1]:
            if i in model.byte_values:
                held.append(model.byte_values[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if i == model.unknown:
                out.append(model.unknown_surface)
            elif i >= 0 and i not in model.silent:
                out.append(model.texts[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the blank that encoding put first."""
        return self._unprefixed(self._surface(ids))

    def _unprefixed(self, surface: str) -> str:
        return surface[1:] if self.model.prefix and surface.startswith(" ") else surface

    def digest(self, text: str) -> tuple[int, str, str]:
        """With the end id: number of ids, sha256 of the decimal ids joined by blanks, sha256 of the decoded text."""
        runs = self._encoded_runs(text)
        # A run is whole characters, so its bytes are read alike alone and beside others.
        ids = "".join([r[1] for r in runs]) + f" {self.model.end}"
        decoded = self._unprefixed("".join([r[2] for r in runs]))
        return sum([r[0] for r in runs]) + 1, hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and decoded, one row per input row; null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            ids = [codec.encode(t, add_end=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row; null text is the empty text, with the end id alone.

    Repeated rows are encoded each, long texts whole, in one task; ties between matches are those of the library. An
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            got = [codec.digest(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(np.array([g[0] for g in got], dtype=np.int64)), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
