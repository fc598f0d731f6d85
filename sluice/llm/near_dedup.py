"""Near-duplicate groups by b-bit MinHash.

Every text becomes the set of its word shingles (64-bit hashes) and a signature of minima. Bands of whole minima
propose candidates; of each minimum only the low bits are kept, packed, and the similarity of a candidate pair is
estimated from the number of equal places, corrected for places that agree by chance. Pairs well below the
threshold are left there; all others are confirmed on the full sets.

Texts with equal sets form one class, and only the class's smallest document goes on. Within a bucket of a band,
documents are first compared with the bucket's smallest one only. Once the confirmed links are joined to
components, every bucket that still holds several components is compared across them, in blocks of bounded size:
by signatures first, so that texts are sent only of documents that have a likely partner in another component.
A block joins components as it finds links, so it gives back fewer links than it has documents: no candidate link
between components is lost, and a bucket of copies is never expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lean, whole_text
from sluice.llm.components import components

BANDS = 32
ROWS = 4
#: Low bits kept of each minimum.
BITS = 4
#: Pairs estimated this far below the threshold (over five standard deviations of 128 places) can't reach it.
MARGIN = 0.2
#: Documents in a block of a large bucket; confirmations for one copy of a hub's text.
BLOCK = 512
HUB_MEMBERS = 256
#: Parts that the members of one component in one large bucket are dealt to where they are counted.
SALTS = 64
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Shingler:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words, of the whole sequence; without, none.

    A-Z count as a-z, and words are divided by the bytes 20 and 09-0D (hexadecimal). A word's hash is a polynomial
    in its bytes, each taken through a random table, so that all words are hashed at once from running sums.
    """

    def __init__(self, shingle_words: int):
        self.k = shingle_words
        self.factors = _mix(np.arange(1, shingle_words + 1, dtype=_U64)) | _U64(1)
        self.table = _mix(np.arange(77_000, 77_256, dtype=_U64))
        self.blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        self.base = 0x9E3779B97F4A7C15
        self._powers(4096)

    def _powers(self, n: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        ones = np.ones(n, dtype=_U64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = _U64(self.base), _U64(inverse)
        self.up, self.down = np.cumprod(up, dtype=_U64), np.cumprod(down, dtype=_U64)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode().lower(), dtype=np.uint8)  # bytes.lower() changes A-Z only
        turns = np.flatnonzero(np.diff(self.blank[data], prepend=True, append=True))
        if not len(turns):
            return np.zeros(0, _U64)
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        running = np.zeros(len(data) + 1, dtype=_U64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=running[1:])
        starts, ends = turns[::2], turns[1::2]
        hashes = _mix((running[ends] - running[starts]) * self.up[starts])
        n = max(1, len(hashes) - self.k + 1)
        total = np.full(n, min(len(hashes), self.k), dtype=_U64)
        for j in range(min(self.k, len(hashes))):
            total += hashes[j : j + n] * self.factors[j]
        return np.unique(_mix(total))


class Signer:
    """Band keys and packed low bits of the minima of a set."""

    def __init__(self) -> None:
        seeds = _mix(np.arange(1000, 1000 + 2 * BANDS * ROWS, dtype=_U64))
        self.flips = (seeds[: BANDS * ROWS] >> _U64(32)).astype(np.uint32)[:, None]
        self.factors = (seeds[BANDS * ROWS :] >> _U64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.row = _mix(np.arange(1, ROWS + 1, dtype=_U64)) | _U64(1)
        self.band = _mix(np.arange(5000, 5000 + BANDS, dtype=_U64))

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        minima = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
        short = (shingles >> _U64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            minima = np.minimum(minima, ((short[at : at + 2048] ^ self.flips) * self.factors).min(axis=1))
        keys = _mix((minima.reshape(BANDS, ROWS).astype(_U64) * self.row).sum(axis=1, dtype=_U64) + self.band)
        low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
        return keys.view(np.int64), (low[::2] | low[1::2] << 4).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (uint64 words in the last axis)."""
    differ = a ^ b
    differ |= differ >> _U64(1)
    differ |= differ >> _U64(2)
    places = BANDS * ROWS
    equal = 1 - np.bitwise_count(differ & _U64(0x1111111111111111)).sum(axis=-1) / places
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, s1, s2, keys, sig): set size, a 128-bit sum of the set, band keys and packed low bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(shingle_words), Signer()
        for batch in batches:
            sizes, first, second, keys, sigs = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingler(text)
                sizes.append(len(found))
                first.append(int(found.sum(dtype=_U64).view(np.int64)))
                second.append(int(_mix(found ^ _U64(0x9E3779B97F4A7C15)).sum(dtype=_U64).view(np.int64)))
                k, s = signer(found) if len(found) else (np.zeros(0, np.int64), b"")
                keys.append(k)
                sigs.append(s)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "keys", "sig"],
            )

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(lean(sign), "doc_id long, n long, s1 long, s2 long, keys array<long>, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is `least` or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _U64).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least))

    sided = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return sided.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(keep), "a long, b long").distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on their full shingle sets.

    Each pair belongs to its side a (the hub). A hub with many partners is copied to several parts.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    hubs = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    members = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.lit(1).alias("side"))
    wanted = hubs.unionByName(members).join(texts, "id").select("a", "part", "side", "id", "text")
    wanted = wanted.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle_words)
        at, hub = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, part, side, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part) != at:
                    at, hub = (a, part), []
                own = shingler(text)
                if not side:
                    hub.append(own)
                elif any(_linked(x, own, percent) for x in hub):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return wanted.mapInArrow(lean(compare), "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(shared: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame, shingle_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join all components that have a link between them in some bucket.

    shared: (key, id); labels: (id, component), ids without a link left out. Buckets of equal members count once.
    Large ones are cut into blocks: a component that fills a block has blocks of its own, which are not compared
    with each other; the others share blocks, and any two blocks meet in one group.
    """
    rows = shared.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)]
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("all"), *marks).where("low < high")
    once = mixed.groupBy("x1", "x2", "all").agg(F.min("key").alias("key")).select("key", "all")
    members = scratch.keep(rows.join(once, "key"), "members")
    small = members.where(F.col("all") <= BLOCK).select("key", F.lit("").alias("pair"), F.lit(0).alias("side"), "id", "component")
    many = members.where(F.col("all") > BLOCK)
    held = many.groupBy("key", "component").agg(F.count("*").alias("own"))
    apart = F.col("own") > BLOCK // 2
    pools = held.where(~apart).groupBy("key").agg(F.ceil(F.sum("own") / BLOCK).alias("pools"))
    salted = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = many.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, ["key", "component", "salt"]).join(pools, "key", "left")
    name = F.when(apart, F.concat_ws("/", "component", F.pmod(F.hash("id"), F.ceil(F.col("own") / BLOCK)).cast("string")))
    name = F.coalesce(name, F.concat(F.lit("/"), F.pmod(F.hash("component"), F.col("pools")).cast("string")))
    dealt = dealt.select("key", "id", "component", name.alias("name"), F.when(apart, F.col("component")).alias("of"))
    names = dealt.groupBy("key", "name").agg(F.first("of").alias("of"))
    other = names.select("key", F.col("name").alias("name_2"), F.col("of").alias("of_2"))
    met = names.join(other, "key").where((F.col("name") <= F.col("name_2")) & F.coalesce(F.col("of") != F.col("of_2"), F.lit(True)))
    pair = F.concat_ws("|", "name", "name_2").alias("pair")
    ends = met.select("key", "name", pair, F.lit(0).alias("side")).union(met.where("name <> name_2").select("key", F.col("name_2").alias("name"), pair, F.lit(1).alias("side")))
    groups = small.unionByName(dealt.join(ends, ["key", "name"]).select("key", "pair", "side", "id", "component"))
    signed = groups.join(sigs.select("id", "sig"), "id").select("key", "pair", "side", "id", "component", "sig").repartition("key", "pair").sortWithinPartitions("key", "pair")
    kind = "key long, pair string, side int, id long, component long"

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a likely partner in their group."""
        at, parts = None, []

        def flush() -> pa.RecordBatch:
            rows = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
            return rows.select(range(5)).filter(pa.array(_partnered(rows, percent / 100 - MARGIN)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, pairs = batch.column(0).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(pairs) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = int(keys[a]), batch.column(1)[a].as_py()
                if own != at and parts:
                    yield flush()
                    parts = []
                at = own
                parts.append(batch.slice(a, b - a))
        if parts:
            yield flush()

    groups = signed.mapInArrow(lean(sift), kind).join(texts, "id").select("key", "pair", "side", "id", "component", "text").repartition("key", "pair").sortWithinPartitions("key", "pair")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(shingle_words), Signer()
        at, group = None, []

        def flush() -> pa.RecordBatch:
            found = _joining(group, signer, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, pair, side, i, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, pair) != at:
                    if group:
                        yield flush()
                    at, group = (key, pair), []
                group.append((i, component, side, shingler(text)))
        if group:
            yield flush()

    return groups.mapInArrow(lean(scan), "a long, b long").distinct()


def _partnered(rows: pa.RecordBatch, least: float) -> np.ndarray:
    """Which rows (key, pair, side, id, component, sig) of a group have a partner estimated at `least` or more in
    another component, across sides if there are two."""
    side, component = rows.column(2).to_numpy(), rows.column(4).to_numpy()
    sigs = np.frombuffer(b"".join(rows.column(5).to_pylist()), _U64).reshape(len(side), -1)
    near, far = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    far = far if len(far) else near
    found = np.zeros(len(side), dtype=bool)
    for at in range(0, len(near), 64):
        mine = near[at : at + 64]
        likely = (estimate(sigs[mine][:, None], sigs[far][None]) >= least) & (component[mine][:, None] != component[far][None])
        found[mine] |= likely.any(axis=1)
        found[far] |= likely.any(axis=0)
    return found


def _joining(group: list[tuple[int, int, int, np.ndarray]], signer: Signer, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a group; rows are (id, component, side, set), compared across sides if there are two."""
    root = {row[1]: row[1] for row in group}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sigs = np.stack([np.frombuffer(signer(row[3])[1], _U64) for row in group])
    sides = np.array([row[2] for row in group])
    far = np.flatnonzero(sides == 1)
    links = []
    for i in np.flatnonzero(sides == 0).tolist():
        to = far if len(far) else np.arange(i + 1, len(group))
        own = top(group[i][1])
        to = to[[top(group[j][1]) != own for j in to.tolist()]] if len(to) else to
        likely = estimate(sigs[to], sigs[i])
        for j in to[np.argsort(-likely, kind="stable")][: int((likely >= percent / 100 - MARGIN).sum())].tolist():
            if top(group[j][1]) != top(group[i][1]) and _linked(group[i][3], group[j][3], percent):
                links.append((min(group[i][0], group[j][0]), max(group[i][0], group[j][0])))
                root[top(group[j][1])] = top(group[i][1])
    return links


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Null or wordless texts have no shingles and no links. Rows that share a doc_id are one document, linked if any
    of them is. Rows without doc_id are returned with a null component_id and kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed = scratch.keep(signatures(docs, shingle_words, id_col, text_col), "signed")
    some = signed.where("n > 0 and doc_id is not null")
    classes = scratch.keep(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id")), "classes")
    sigs = some.withColumnRenamed("doc_id", "id").join(classes, ["s1", "s2", "n", "id"], "left_semi").dropDuplicates(["id", "s1", "s2", "n"])
    sigs = scratch.keep(sigs.select("id", "keys", "sig"), "sigs")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    rows = sigs.select("id", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("held")).where("held > 1").select("key", "a")
    shared = scratch.keep(rows.join(hubs, "key"), "shared")
    # Texts are shuffled once; later joins meet only the few that share a bucket.
    texts = scratch.keep(texts.join(shared.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    pairs = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = scratch.keep(_likely(pairs, sigs, percent / 100 - MARGIN), "pairs")
    links = scratch.keep(_confirm(pairs, texts, shingle_words, percent), "links")
    # A doc_id with rows of several texts joins their classes.
    several = some.groupBy("doc_id").agg(F.count("*").alias("held")).where("held > 1").select("doc_id")
    same_id = some.join(several, "doc_id").join(classes, ["s1", "s2", "n"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = links.union(same_id.where("a <> b").distinct())
    labels = components(links, scratch, "first")
    across = scratch.keep(_across(shared.select("key", "id"), labels, sigs, texts, shingle_words, percent, scratch), "across")
    # The first labels stand for the links that made them.
    labels = components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).union(across), scratch, "all")

    of_class = classes.join(labels, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    mine = signed.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return mine.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest doc_id of each group only, with all their columns, named as they may be.

    Rows without doc_id stay, and so do rows that share a kept one. An empty table stays empty.
    """
    report = near_duplicates(docs, shingle_words, percent, id_col, text_col)
    kept = report.where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    named = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").select("row")
    return named.union(rows.where("doc_id is null").select("row")).select("row.*")
