"""Source divergence audit: how far the words of each source lie from those of the others of its language.

Terms are counted by length-bucketed packing. Texts of one slice are one byte array; terms of up to 8 bytes become one
uint64 word and those of up to 16 bytes two, which are radix-sorted by 16 bits at a time and run-counted in numpy; longer terms are sorted
as bytes, in buckets of doubling widths. A task sends each term of a slice and group once, and Spark adds them up.

All arithmetic is in integers. Shares are in parts of a thousand millions with one added to each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Parts in which a group's terms are ranked first.
RANK_PARTS = 32
#: Bytes of text that are packed and sorted at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Numbers of the dense tables of shares that are compared at once.
BLOCK_CELLS = 1 << 18

_BYTE = np.arange(256)
_IS_TERM = ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def _radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by several unsigned columns, the first of them most significant, 16 bits at a time."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = ((column >> column.dtype.type(shift)) & column.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms as big-endian uint64 words, filled up with zeros, so that their order is that of their bytes. `data` goes on 16 bytes beyond the last term."""
    at_byte = np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))
    out = []
    for k in range(words):
        word = at_byte[starts + 8 * k].astype(np.uint64)
        rest = np.minimum(lengths - 8 * k, 8)  # bytes of the term in this word
        out.append((word >> ((8 - rest) * 8).astype(np.uint64)) << ((8 - rest) * 8).astype(np.uint64))
    return out


def _texts(terms: np.ndarray) -> pa.StringArray:
    """Terms of fixed width, filled up with zeros, as an Arrow array."""
    cells = terms.view(np.uint8).reshape(len(terms), -1)
    held = cells != 0
    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(terms), pa.py_buffer(ends), pa.py_buffer(cells[held]))


def _runs(changed: np.ndarray) -> np.ndarray:
    """First places of runs; changed[k] says that row k+1 differs from row k."""
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _counted(keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n, docs) of each term and group of sorted rows: a row that shows them, occurrences, documents."""
    same = np.ones(len(doc) - 1, bool)
    for k in (*keys, group):
        same &= k[1:] == k[:-1]
    first = _runs(~same)
    new_doc = np.concatenate([[True], ~same | (doc[1:] != doc[:-1])])
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(new_doc.astype(np.int64), first)


def count_slice(data: np.ndarray, doc_ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, n, docs) of each bucket of lengths, of texts that lie one after the other in `data`."""
    size = len(data)
    data = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    # A text's end separates terms as well: 0 is no byte of a term.
    flags = np.zeros(size + 2, bool)
    flags[1:-1] = _IS_TERM[data[:size]]
    edge = np.zeros(size + 1, bool)
    edge[doc_ends[:-1]] = True
    starts = np.flatnonzero(flags[1:-1] & (~flags[:-2] | edge[:-1]))
    ends = np.flatnonzero(flags[1:-1] & (~flags[2:] | edge[1:])) + 1
    lengths = ends - starts
    doc = np.searchsorted(doc_ends, starts, side="right").astype(np.uint32)
    group = groups[doc].astype(np.uint32)
    low = 0
    width = 8
    while len(lengths) and low < lengths.max():
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        if len(rows):
            own_group, own_doc = group[rows], doc[rows]
            if width <= 16:
                keys = _packed(data, starts[rows], lengths[rows], width // 8)
                order = _radix_order([*keys, own_group])
                keys, own_group, own_doc = [k[order] for k in keys], own_group[order], own_doc[order]
                first, n, docs = _counted(keys, own_group, own_doc)
                terms = np.stack([k[first] for k in keys], axis=1).astype(">u8").view(f"S{width}").ravel()
            else:
                # Long terms are few; their bytes are cut from the array one by one.
                raw = np.array([data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)], dtype=f"S{lengths[rows].max()}")
                order = np.lexsort((own_group, np.unique(raw, return_inverse=True)[1]))
                raw, own_group, own_doc = raw[order], own_group[order], own_doc[order]
                first, n, docs = _counted([raw], own_group, own_doc)
                terms = raw[first]
            yield terms, own_group[first], n, docs
        low, width = width, width * 2


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each slice; a row without a term for each group that occurs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        pairs, group = _groups(batch)
        yield pa.RecordBatch.from_arrays([pairs[0], pairs[1], pa.nulls(len(pairs[0]), pa.string()), *[pa.array(np.zeros(len(pairs[0]), np.int64))] * 2], schema=_COUNTS)
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
            ends = offsets[low + 1 : high + 1] - offsets[low]
            # Equal ends of empty texts are told apart by nothing that matters: no term begins in them.
            for terms, which, n, docs in count_slice(data[offsets[low] : offsets[high]], ends, group[low:high]):
                at = pa.array(which.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pairs[0].take(at), pairs[1].take(at), _texts(terms), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)
            low = high


def _groups(batch: pa.RecordBatch) -> tuple[tuple[pa.Array, pa.Array], np.ndarray]:
    """The languages and sources of the batch's groups, and the group of each row."""
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
    met, group = np.unique(both, return_inverse=True)
    return (lang.dictionary.take(pa.array(met // len(source.dictionary))), source.dictionary.take(pa.array(met % len(source.dictionary)))), group


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for counts of any size."""
    if not len(counts) or int(counts.max()) + 1 < 2**63 // SCALE:
        return 1 + SCALE * (counts.astype(np.int64) + 1) // (total + kept)
    return np.array([1 + SCALE * (int(c) + 1) // (total + kept) for c in counts.ravel()], np.int64).reshape(counts.shape)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_VALUES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compared(sources: dict[str, list[str]], totals: dict[tuple[str, str], int], kept: dict[str, int]):
    """Of rows (lang, term, held): sums of distances between the sources of a language, and the terms that may rank for a source."""

    def block(lang: str, terms: pa.Array, held: pa.ListArray, sums: np.ndarray) -> tuple[list, list, list]:
        names = sources[lang]
        place = {s: k for k, s in enumerate(names)}
        met, n = held.flatten().flatten()
        met = met.dictionary_encode()
        column = np.array([place[s] for s in met.dictionary.to_pylist()], np.int64)[met.indices.to_numpy(zero_copy_only=False)]
        counts = np.zeros((len(terms), len(names)), np.int64)
        counts[np.repeat(np.arange(len(terms)), held.value_lengths().to_numpy(zero_copy_only=False)), column] = n.to_numpy(zero_copy_only=False)
        p = np.stack([shares(counts[:, k], totals[lang, s], kept[lang]) for k, s in enumerate(names)], axis=1)
        q = shares(counts.sum(axis=1), sum(totals[lang, s] for s in names), kept[lang])
        out: tuple[list, list, list] = [], [], []
        for k, source in enumerate(names):
            sums[k] += _distance(p[:, k, None], p).sum(axis=0)
            rows = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
            value = _distance(p[rows, k], q[rows])
            if len(rows) > TERM_RANKS:  # ties of the last rank stay
                stays = value >= np.partition(value, -TERM_RANKS)[-TERM_RANKS]
                rows, value = rows[stays], value[stays]
            out[0].extend([source] * len(rows))
            out[1].extend(terms.take(pa.array(rows)).to_pylist())
            out[2].extend(value.tolist())
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros((len(s), len(s)), np.int64) for lang, s in sources.items()}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                size = max(1, BLOCK_CELLS // len(sources[lang]))
                for at in range(0, len(own), size):
                    part = batch.take(pa.array(own[at : at + size]))
                    names, items, values = block(lang, part.column("term"), part.column("held"), sums[lang])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(["term"] * len(names), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_VALUES)
        rows = [(lang, a, "pair", b, int(sums[lang][i, j])) for lang, names in sources.items() for i, a in enumerate(names) for j, b in enumerate(names) if i != j and sums[lang][i, j]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_VALUES)], schema=_VALUES)

    return compare


def kept_terms(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, term, held) of the terms that each language keeps, held being (source, n) of the sources that have it; and (lang, source, total, kept) of the groups.

    A row without a term holds all sources of its language.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = named.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    terms = scratch.keep(terms.where((F.col("docs") >= LEAST_DOCS) | F.col("term").isNull()).select("lang", "term", "held"), "terms")
    sums = terms.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("term").alias("kept"))
    return terms.where("term is not null"), sums.join(sizes, "lang").select("lang", "source", "total", "kept")


def divergence_report(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each source, the other sources of its language and the terms that it has too often.

    Null text, lang and source are ''. Each row is a document; an empty table gives no rows, a language with one source no
    pairs, one without kept terms pairs of value 0. Other columns are not read. A text is packed whole, so the largest slice is the longest text.
    The groups (lang, source), whose pairs within a language are the result, are held by the driver and by each task.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    terms, groups = kept_terms(docs, scratch, text_col, lang_col, source_col)
    rows = sorted((r["lang"], r["source"], r["total"], r["kept"]) for r in scratch.keep(groups, "groups").collect())
    sources: dict[str, list[str]] = {}
    for lang, source, _, _ in rows:
        sources.setdefault(lang, []).append(source)
    compare = _compared(sources, {(a, b): n for a, b, n, _ in rows}, {a: v for a, _, _, v in rows})
    values = scratch.keep(terms.mapInArrow(compare, "lang string, source string, part string, item string, value long"), "values")
    none = docs.sparkSession.createDataFrame([(lang, a, "pair", b, 0) for lang, names in sources.items() for a in names for b in names if a != b], "lang string, source string, part string, item string, value long")
    pairs = values.where("part = 'pair'").union(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Each task gives as many terms as are ranked, so a group's terms are first cut in parts.
    first = _ranked(values.where("part = 'term'"), F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS)))
    return _ranked(pairs, limit=None).unionByName(_ranked(first.drop("rank")))


def _ranked(values: DataFrame, *parts: Column, limit: int | None = TERM_RANKS) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part", *parts).orderBy(F.desc("value"), "item")
    rows = values.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def oracle() -> str:
    share = f"1 + {SCALE} * (coalesce({{}}, 0) + 1) // ({{}} + {{}})"
    p = share.format("c.n", "g.total", "g.kept")
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        found AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
        counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
        groups AS (SELECT d.lang, d.source, coalesce(t.total, 0) AS total, coalesce(v.kept, 0) AS kept, coalesce(v.n, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM docs) d
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source LEFT JOIN (SELECT lang, count(*) AS kept, sum(n) AS n FROM kept GROUP BY lang) v ON v.lang = d.lang),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST({p} AS BIGINT) AS p, CAST({share.format("k.n", "g.lang_total", "g.kept")} AS BIGINT) AS q
            FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
        WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
