"""Spelling variant grouping by reduced-alphabet generation.

Letters are mapped to eight symbols, so a word becomes a short word of symbols. Words that differ by one edit have reduced
words that are equal or differ by one edit, so each word meets all its near words under the one-edit neighbourhood of its
reduced word: the word itself, and every deletion, replacement and insertion of a symbol. That is 16 times its length
and 9 more, whatever the alphabet of the words. Neighbourhoods are joined with the reduced vocabulary by a hash of the reduced word, and
each meeting is verified on the original words.

Hashes of a neighbourhood are made from the hashes of the word's prefixes and suffixes, each in one step. Equal reduced words have equal
hashes, so no near word is lost; unequal words that meet by chance are told apart like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lower_ascii, whole_text

RUN = r"[A-Za-zÀ-ÿ]+"
MISSPELT = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Symbols of the reduced alphabet; a letter's is its code point modulo their number.
SYMBOLS = 8
#: Words of more code points are joined by number and looked up again, not carried with every neighbour.
CARRIED = 48
#: Hashes of neighbours that are made at once.
BLOCK = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each run of letters, lower-cased, one letter less where its checksum with the document's id says so."""
    found = F.explode(F.regexp_extract_all(lower_ascii(whole_text(text_col)), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _FACTOR))]).astype(np.uint64)


def reduced(words: list[str]) -> np.ndarray:
    """Symbols of words of one length, from 1; a row for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return (codes % SYMBOLS + 1).astype(np.uint64)


def _hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words' prefixes and suffixes of every length, and the powers of the factor."""
    rows, length = symbols.shape
    powers = _powers(length + 1)
    before, after = np.zeros((rows, length + 1), np.uint64), np.zeros((rows, length + 1), np.uint64)
    for k in range(length):
        before[:, k + 1] = before[:, k] * _FACTOR + symbols[:, k]
        after[:, length - k - 1] = after[:, length - k] + symbols[:, length - k - 1] * powers[k]
    return before, after, powers


def word_keys(symbols: np.ndarray) -> np.ndarray:
    return _hashes(symbols)[0][:, -1]


def neighbour_keys(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the distinct words within one edit of each reduced word, in blocks of bounded size.

    Of a run of equal symbols only the first is deleted, and a symbol is inserted only where the one before is another:
    the other edits make the same words.
    """
    rows, length = symbols.shape
    before, after, powers = _hashes(symbols)
    row = np.arange(rows)
    yield row, before[:, -1]
    previous = np.concatenate([np.zeros((rows, 1), np.uint64), symbols], axis=1)  # of a place, what stands before it; 0 at the start
    step = max(1, BLOCK // max(1, rows * SYMBOLS))
    letters = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    for low in range(0, length + 1, step):
        high = min(length, low + step)
        own = symbols[:, low:high]
        left = before[:, low:high]
        rest = after[:, low + 1 : high + 1]
        shift = powers[length - 1 - np.arange(low, high)]
        at = own != previous[:, low:high]
        yield np.nonzero(at)[0], (left * shift + rest)[at]  # deletions
        made = (left[..., None] * _FACTOR + letters) * shift[:, None] + rest[..., None]
        other = own[..., None] != letters
        yield np.nonzero(other)[0], made[other]  # replacements
        high = min(length + 1, low + step)
        left, rest, shift = before[:, low:high], after[:, low:high], powers[length - np.arange(low, high)]
        made = (left[..., None] * _FACTOR + letters) * shift[:, None] + rest[..., None]
        other = previous[:, low:high, None] != letters
        yield np.nonzero(other)[0], made[other]  # insertions


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols) of words of one length, few enough at a time that their prefixes stay small."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, BLOCK // (16 * length))
        for low in range(0, len(at), step):
            part = at[low : low + step]
            yield part, reduced([words[k] for k in part.tolist()])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = np.zeros(len(words), np.uint64)
        for at, symbols in _by_length(words):
            keys[at] = word_keys(symbols)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=["id", "word", "n", "key"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, symbols in _by_length(batch.column("word").to_pylist()):
            for rows, keys in neighbour_keys(symbols):
                ids = batch.column("id").take(pa.array(at[rows]))
                words = batch.column("word").take(pa.array(at[rows])) if symbols.shape[1] <= CARRIED else pa.nulls(len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(keys.view(np.int64))], names=["id", "word", "key"])


def _is_near(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(vocab: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): every two words of a vocabulary (word, n) that differ by one edit, in both directions."""
    numbered = scratch.keep(vocab.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered")
    keyed = scratch.keep(numbered.mapInArrow(_keyed, "id long, word string, n long, key long"), "keyed")
    # Spark sizes neighbourhoods like the words that they are made of, a hundred times too low, and would broadcast them.
    edits = numbered.select("id", "word").mapInArrow(_neighbours, "id long, word string, key long").hint("merge")
    short = F.length("word") <= CARRIED + 1
    others = keyed.where(short).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The word of a neighbour is null where it is not carried, and then meets nothing here.
    carried = edits.where("word is not null").join(others, "key").where(_is_near("word", "near")).select("word", "near", "near_n")
    long = numbered.where(F.length("word") > CARRIED)
    far = long.select("id", "word").mapInArrow(_neighbours, "id long, word string, key long").select("id", "key").hint("merge")
    meeting = keyed.where(F.length("word") >= CARRIED)
    met = far.join(meeting.select("key", F.col("id").alias("near_id")), "key").select("id", "near_id").distinct().hint("merge")
    named = met.join(long.select("id", "word"), "id").hint("merge").join(meeting.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    return carried.union(named.where(_is_near("word", "near")).select("word", "near", "near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Every step leads to the end of twice as many."""
    now, step = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        made = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        made = scratch.keep(made, f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
        now = made.drop("moved")
        if made.where("moved").isEmpty():
            return now


def group_variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n): words are distinct, of one letter or more.

    A word's form is its near word of largest n, of several the smallest in code-point order, if it has `ratio` times
    the word's n or more; else null. The root is what the forms lead to, the word itself without a form. A word far longer than
    others has neighbours like any other, but is looked up again rather than sent with each of them.
    """
    scratch = Scratch(vocab.sparkSession, "spelling")
    vocab = scratch.keep(vocab.select("word", "n"), "vocabulary")
    best = near_words(vocab, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = vocab.join(best, "word", "left")
    counts = F.col("n") * ratio <= -F.col("best.less")
    rows = rows.select("word", F.when(counts, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, -F.col("best.less")).alias("form_n"))
    rows = scratch.keep(rows, "forms")
    ends = roots(rows.where("form is not null").select("word", "form"), scratch)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of documents, some of them misspelt by their checksum.

    Null text has no words; a null id counts as the empty text; rows of one id are documents of their own. An empty table
    gives no rows, and other columns are not read.
    """
    return group_variants(vocabulary(occurrences(docs, id_col, text_col)))


def oracle() -> str:
    """All pairs of words are compared; checksums are made byte by byte from the table of their polynomial."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    eight = "list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: " + bit.format("c") + ")"
    return rf"""
        WITH bytes AS (SELECT list(t ORDER BY i) AS tbl FROM (SELECT i, {eight} AS t FROM range(256) r(i))),
        runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        summed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))),
            lambda a, b: xor(a >> 8, tbl[xor(a & 255, b) + 1]))) AS h FROM runs, bytes),
        words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM summed)
            WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
        cut AS (SELECT word, n, length(word) AS size, k, substr(word, 1, k) || substr(word, k + 2) AS less FROM words, range(length(word)) r(k)),
        near AS (
            SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.k = b.k AND a.size = b.size AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word),
        best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'form': near}}) AS best FROM near GROUP BY word),
        forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * w.n THEN best.form END AS form, CASE WHEN -best.less >= {RATIO} * w.n THEN -best.less END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (
            WITH RECURSIVE walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NOT NULL)
            SELECT w.word, w.at AS root FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NULL) r ON f.word = r.word"""
