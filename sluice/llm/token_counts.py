"""Token counts that follow edits.

A document is kept as its pre-tokens under a segment tree: leaves hold a few dozen pre-tokens, inner nodes the sums
of characters and tokens below them. An edit splits again only from a pre-token whose match cannot have seen the
edited place, up to the first border that both splits share behind it; only these pre-tokens are counted again, and
only the sums above them change.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole_text

#: Pre-tokens in a leaf when a tree is made; a leaf that grows beyond four times that is spread over its neighbours.
LEAF = 32
#: Patterns whose matches look at most LOOKAHEAD characters past their end: `'re` needs two, a run of blanks one. With
#: any other pattern every edit splits the whole text again.
LOCAL_PATTERNS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])
LOOKAHEAD = 2
#: Pre-tokens in each of two halves of what is remembered; longer ones are counted each time.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64


class Counter:
    """Tokens of a pre-token, by a rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.local = pattern in LOCAL_PATTERNS
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _count(self, piece: str) -> int:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        if len(piece) > LONGEST_REMEMBERED:
            return len(self.encoding.encode_ordinary(piece))
        got = self.older.get(piece)
        self.known[piece] = got = len(self.encoding.encode_ordinary(piece)) if got is None else got
        return got

    def counts(self, pieces: list[str]) -> list[int]:
        known, count = self.known, self._count
        return [known[p] if p in known else count(p) for p in pieces]


class CountedText:
    """A text with its number of tokens, kept right under edits."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.recounted = 0  # pre-tokens counted again by edits
        self.spread = 0  # pre-tokens moved to other leaves
        pieces = counter.split(text)
        self._make(pieces, counter.counts(pieces))

    def _make(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [([], []) for _ in range(self.width - len(self.leaves))]
        at = np.arange(0, len(pieces), LEAF)
        self.sums = np.zeros((2 * self.width, 3), dtype=np.int64)  # characters, tokens, pre-tokens
        if len(pieces):
            own = self.sums[self.width : self.width + len(at)]
            own[:, 0] = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
            own[:, 1] = np.add.reduceat(np.array(counts, dtype=np.int64), at)
            own[:, 2] = np.diff(np.append(at, len(pieces)))
        self._sum_above(self.width, 2 * self.width)

    def _sum_above(self, low: int, high: int) -> None:
        """Sums of all nodes above those from `low` to `high`, which are all the leaves below one node."""
        while high - low > 1:
            low, high = low // 2, high // 2
            self.sums[low:high] = self.sums[2 * low : 2 * high : 2] + self.sums[2 * low + 1 : 2 * high : 2]
        while low := low // 2:
            self.sums[low] = self.sums[2 * low] + self.sums[2 * low + 1]

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)

    def _find(self, char: int) -> tuple[int, int, int]:
        """Leaf, pre-token in it, and start of the pre-token that holds the character; at the end, the place behind the last."""
        node, start = 1, 0
        if char >= self.n_chars:
            while node < self.width:  # to the last leaf that holds anything
                node = 2 * node + (self.sums[2 * node + 1, 2] > 0)
            return node - self.width, len(self.leaves[node - self.width][0]), self.n_chars
        while node < self.width:
            node *= 2
            if char >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        leaf = node - self.width
        for k, piece in enumerate(self.leaves[leaf][0]):
            if char < start + len(piece):
                return leaf, k, start
            start += len(piece)
        raise AssertionError("sums don't fit the leaves")

    def _from(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            pieces = self.leaves[leaf][0]
            while k < len(pieces):
                yield leaf, k, pieces[k]
                k += 1
            leaf, k = leaf + 1, 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by `new`."""
        size = self.n_chars
        start, end = max(0, min(start, size)), max(0, min(end, size))
        end = max(start, end)
        if not self.counter.local:
            text = self.text()
            pieces = self.counter.split(text[:start] + new + text[end:])
            self.recounted += len(pieces)
            return self._make(pieces, self.counter.counts(pieces))
        # The first pre-token whose match may have looked at the edited place.
        leaf, k, begin = self._find(max(0, start - LOOKAHEAD - 1))
        old: list[str] = []  # pre-tokens from there on
        borders: dict[int, int] = {}  # character behind the edit where an old pre-token begins: how many come before it
        at, reach, more = begin, end, self._from(leaf, k)
        window = 8
        while True:
            whole = True
            for _, _, piece in more:
                old.append(piece)
                at += len(piece)
                if at >= end:
                    borders[at] = len(old)
                    if at > reach + window:
                        whole = False
                        break
            joined = "".join(old)
            changed = joined[: start - begin] + new + joined[end - begin :]
            pieces = self.counter.split(changed)
            shift = start + len(new) - end
            place, last = begin, begin + len(changed)
            for n, piece in enumerate(pieces):
                # A border is sure if its matches didn't look beyond the window.
                if place >= start + len(new) and place - shift in borders and n and (whole or place + LOOKAHEAD < last):
                    return self._replace(leaf, k, borders[place - shift], pieces[:n])
                place += len(piece)
            if whole:
                return self._replace(leaf, k, len(old), pieces)
            window *= 4

    def _replace(self, leaf: int, k: int, n: int, pieces: list[str]) -> None:
        """Put the pre-tokens in the place of the n ones from the k-th of the leaf on."""
        counts = self.counter.counts(pieces)
        self.recounted += len(pieces)
        own, own_counts = self.leaves[leaf]
        taken = min(n, len(own) - k)
        self.leaves[leaf] = own[:k] + pieces + own[k + taken :], own_counts[:k] + counts + own_counts[k + taken :]
        self._sum(leaf)
        n -= taken
        after = leaf
        while n:
            after += 1
            own, own_counts = self.leaves[after]
            taken = min(n, len(own))
            self.leaves[after] = own[taken:], own_counts[taken:]
            self._sum(after)
            n -= taken
        if len(self.leaves[leaf][0]) > 4 * LEAF:
            self._spread(leaf)

    def _spread(self, leaf: int) -> None:
        """Deal the pre-tokens of a leaf that is too full evenly over the leaves below the lowest node that has room for them.

        A node's leaves may be the less full the higher it stands, so a place that grows on and on costs few steps for
        each pre-token. Where even the root has no room, a tree with more leaves is made.
        """
        height, top = 0, max(1, self.width.bit_length() - 1)
        while (self.sums[(leaf + self.width) >> height, 2]) > (4 * LEAF - 2 * LEAF * height / top) * (1 << height):
            height += 1
            if 1 << height > self.width:
                return self._make([p for x, _ in self.leaves for p in x], [c for _, x in self.leaves for c in x])
        size = 1 << height
        low = leaf >> height << height
        pieces = [p for x, _ in self.leaves[low : low + size] for p in x]
        counts = [c for _, x in self.leaves[low : low + size] for c in x]
        for k in range(size):
            a, b = len(pieces) * k // size, len(pieces) * (k + 1) // size
            self.leaves[low + k] = pieces[a:b], counts[a:b]
            self.sums[self.width + low + k] = sum(map(len, pieces[a:b])), sum(counts[a:b]), b - a
        self.spread += len(pieces)
        self._sum_above(self.width + low, self.width + low + size)

    def _sum(self, leaf: int) -> None:
        pieces, counts = self.leaves[leaf]
        node = leaf + self.width
        self.sums[node] = sum(map(len, pieces)), sum(counts), len(pieces)
        while node := node // 2:
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


@functools.lru_cache(maxsize=2)
def _counter(ranks_path: str, pattern: str) -> Counter:
    return Counter(ranks_path, pattern)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits made of the text itself, each for the text after those before: a cut at a quarter, its beginning put into the middle, another end."""
    n = len(text)
    cut = min(12, n - n // 4)
    m = n - cut
    head = text[:24]
    return [(n // 4, n // 4 + cut, ""), (m // 2, m // 2, head), (max(0, m + len(head) - 8), m + len(head), "(edited)")]


def apply_edit(text: str, edit: Sequence) -> str:
    start, end, new = edit
    return text[:start] + new + text[max(start, end) :]


def count_edited(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, edited_chars, edited_tokens, n_pretokens, recounted; one row per input row.

    Edits come from `edits_col`, an array of (start, end, new) structs applied in order, null for none; without
    such a column they are made of each text (sample_edits). Places are code points and are cut to the text.
    Null text is the empty text. recounted is the number of pre-tokens that edits had counted again. Repeated rows are
    counted each; long texts are counted whole, in one task. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks_path, pattern)
        for batch in batches:
            out: list[tuple] = []
            given = batch.column(2).to_pylist() if edits_col else None
            for n, text in enumerate(batch.column(1).to_pylist()):
                counted = CountedText(text, counter)
                before = counted.n_chars, counted.n_tokens, sum(len(p) for p, _ in counted.leaves)
                edits = [tuple(e.values()) for e in given[n] or ()] if given is not None else sample_edits(text)
                for start, end, new in edits:
                    counted.edit(start, end, new)
                out.append((*before[:2], counted.n_chars, counted.n_tokens, before[2], counted.recounted))
            names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "n_pretokens", "recounted"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(6))], names=["doc_id", *names])

    columns = [F.col(id_col).cast("long"), whole_text(text_col), *([F.col(edits_col)] if edits_col else [])]
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, n_pretokens long, recounted long")
