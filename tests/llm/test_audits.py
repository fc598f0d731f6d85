"""Spelling variants, divergence of sources and mixing, against brute force and on odd tables."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

from sluice.llm import divergence, mixing, spelling
from sluice.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [
    (1, "", "en", "a"), (2, None, "en", "b"), (3, "one", None, None), (4, "A" * 50_000, "en", "a"), (5, "word Words " * 20_000, "en", None),
    (6, "naïve ΑΣ 日本語 🎉 \x00 straße×÷ Éa", "", "a"), (7, "lonely", "xx", "a"), (None, "word words wordz", "en", "b"), (None, None, None, "c"),
    (8, "word words wordz", "en", "b"), (8, "word words wordz", "en", "b"), (9, "word supercalifragilistic supercalifragilistics", "en", "c"), (10, " \t\n ", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in ODD], SCHEMA + ", word string, n long, size long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def in_duckdb(frame, sql):
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    return con.sql(sql).fetchall()


# 11 --------------------------------------------------------------------------------------------------------------


def words_of(docs):
    counts = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: f if f is not None and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def test_variants_equal_a_comparison_of_all_words(docs):
    assert rows(spelling.variant_report(docs)) == grouped(words_of(docs))


def test_variants_of_a_chain_of_forms_and_of_ties(spark):
    words = {"abcdefg": 625, "abcdef": 125, "abcde": 25, "abcd": 5, "xbcdef": 25, "zzzzzz": 9, "zzzzzy": 45, "zzzzzx": 45, "éaéaéa": 4, "éaéaé": 20}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(frame)) == grouped(words)


def test_variants_of_words_too_long_to_be_carried(spark, monkeypatch):
    stem = "abcabdacbdefgh" * 5
    words = {stem: 100, stem[:-1]: 20, "z" + stem: 3, stem.replace("f", "g", 1): 4, "q" * 3_000: 5, "q" * 2_999: 30, "r" * 48: 50, "r" * 49: 10, "r" * 50: 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "BLOCK", 1 << 12)
    assert rows(spelling.group_variants(frame)) == grouped(words)


def test_neighbourhoods_are_never_broadcast(spark):
    """They are sized by the words that they are made of, so a small vocabulary would have them all pass through the driver."""
    scratch = Scratch(spark, "spelling")
    frame = spark.range(2_000).selectExpr("concat(repeat('abcdefgh', if(id % 100 = 0, 7, 1)), chr(97 + id % 26), chr(97 + id div 26 % 26), id) AS word", "id + 5 AS n")
    assert "BroadcastExchange" not in spelling.near_words(frame, scratch)._jdf.queryExecution().executedPlan().toString()
    scratch.remove()


def test_neighbours_are_distinct_and_all_there():
    symbols = np.array([[1, 1, 2, 3, 3, 3], [8, 8, 8, 8, 8, 8]], np.uint64)
    made = collections.defaultdict(list)
    for at, keys in spelling.neighbour_keys(symbols):
        for r, key in zip(at.tolist(), keys.tolist(), strict=True):
            made[r].append(key)
    for r, word in enumerate(symbols.tolist()):
        wanted = {tuple(word)} | {(*word[:k], *word[k + 1 :]) for k in range(6)} | {(*word[:k], c, *word[k + 1 :]) for k in range(6) for c in range(1, 9)} | {(*word[:k], c, *word[k:]) for k in range(7) for c in range(1, 9)}
        keys = [int(spelling.word_keys(np.array([w], np.uint64))[0]) for w in wanted]
        assert sorted(made[r]) == sorted(keys)


def test_variants_of_odd_tables(odd, empty):
    assert rows(spelling.variant_report(odd)) == grouped(words_of(odd))
    assert rows(spelling.variant_report(empty)) == []


def test_variants_in_sql(docs, odd):
    for frame in (docs, odd):
        assert rows(spelling.variant_report(frame)) == sorted(in_duckdb(frame.select("doc_id", "text"), spelling.oracle()), key=str)


# 12 --------------------------------------------------------------------------------------------------------------


def audited(docs):
    texts = [(r.text or "", r.lang or "", r.source or "") for r in docs.select("text", "lang", "source").collect()]
    counts, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in texts:
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        groups = {s: c for (k, s), c in counts.items() if k == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), collections.Counter()))
        for s, c in groups.items():
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out, key=str)


def test_divergence_equals_exact_integers(docs):
    assert rows(divergence.divergence_report(docs)) == audited(docs)


def test_divergence_of_odd_tables(odd, empty):
    assert rows(divergence.divergence_report(odd)) == audited(odd)
    assert rows(divergence.divergence_report(empty)) == []


def test_divergence_in_sql(docs, odd):
    for frame in (docs, odd):
        assert rows(divergence.divergence_report(frame)) == sorted(in_duckdb(frame.select("doc_id", "text", "lang", "source"), divergence.oracle()), key=str)


def test_terms_of_every_width_are_counted():
    rnd = np.random.default_rng(5)
    texts = [" ".join("".join(rnd.choice(list("abAé日"), rnd.integers(1, 40))) for _ in range(30)) for _ in range(20)] + ["", "", "x" * 5_000, "a" * 8, "b" * 9, "c" * 16, "d" * 17]
    data = [t.encode() for t in texts]
    groups = np.arange(len(data)) % 3
    found = collections.Counter()
    docs_of = collections.Counter()
    for terms, group, n, docs_ in divergence.count_slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), groups):
        assert terms.tolist() == sorted(terms.tolist())
        for t, g, a, b in zip(terms.tolist(), group.tolist(), n.tolist(), docs_.tolist(), strict=True):
            found[t.decode(), g] += a
            docs_of[t.decode(), g] += b
    wanted, wanted_docs = collections.Counter(), collections.Counter()
    for text, g in zip(texts, groups.tolist(), strict=True):
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        wanted.update((t, g) for t in terms)
        wanted_docs.update((t, g) for t in set(terms))
    assert found == wanted and docs_of == wanted_docs


def test_shares_of_very_large_counts_are_exact():
    counts = np.array([0, 7, 2**50], np.int64)
    assert divergence.shares(counts, 2**51, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (2**51 + 3) for c in counts]


# 13 --------------------------------------------------------------------------------------------------------------


def wanted_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while True:
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not above:
            return target | {s: rate * weight[s] for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above


def check_mix(frame, near=None):
    made = {(r.doc_id, r.size): r for r in mixing.mix_report(frame).collect()}
    given = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in frame.select("doc_id", "text", "source").collect()]
    sizes, taken = collections.Counter(), collections.Counter()
    for doc_id, size, source in given:
        sizes[source] += size
        row = made[doc_id, size]
        assert row.taken in (0, size, 2 * size)
        taken[source] += row.taken
    target = wanted_targets(sizes)
    for doc_id, size, source in given:
        row = made[doc_id, size]
        assert row.source_size == sizes[source] and row.target == pytest.approx(target[source])
    longest = max((size for _, size, _ in given), default=0)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= (near * target[source] if near else longest)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_comes_near_its_targets(spark, docs):
    check_mix(docs, near=0.05)
    check_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), near=0.01)


def test_sums_come_nearest():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        words = rnd.integers(0, 60, rnd.integers(0, 9)).tolist()
        wanted = float(rnd.integers(-20, 300)) + 0.3
        sums = [sum(w for k, w in enumerate(words) if n >> k & 1) for n in range(1 << len(words))]
        got = sum(w for w, t in zip(words, mixing.nearest_sum(words, wanted), strict=True) if t)
        assert abs(got - max(0.0, wanted)) == pytest.approx(min(abs(x - max(0.0, wanted)) for x in sums)) or wanted < 0 and got == 0


def test_mix_of_odd_tables(odd, empty):
    check_mix(odd)
    assert rows(mixing.mix_report(empty)) == []
    assert [r.taken for r in mixing.mix_report(odd.where("size(split(text, ' ')) < 0")).collect()] == []
    assert {(r.target, r.taken) for r in mixing.mix_report(odd.where("text is null or text = ''")).collect()} == {(0.0, 0)}


def test_mix_is_the_same_again_and_holds_each_draw_once(docs):
    options = {"block_words": 512, "shard_words": 4096}
    plan = mixing.mix_plan(docs, **options)
    first = rows(plan.select("doc_id", "draws"))
    assert first == rows(mixing.mix_plan(docs.repartition(7), **options).select("doc_id", "draws"))
    made = mixing.mixed(docs, **options).select("doc_id", "mix_shard", "mix_epoch").collect()
    wanted = collections.Counter((d, x.shard, x.epoch) for d, draws in first for x in draws)
    assert collections.Counter(map(tuple, made)) == wanted and len({s for _, s, _ in wanted}) > 8
    # A block lies in one shard, and the shards have the same number of blocks but for one.
    blocks = {(r.source, x.epoch, x.block, x.shard) for r in plan.collect() for x in r.draws}
    assert len({b[:3] for b in blocks}) == len(blocks)


def test_quotas_are_split_exactly():
    quotas = np.array([40, 0, 7, 1_000])
    mixture = mixing.Mixture({}, quotas, quotas, frozenset(), quotas, quotas, 13, 5)
    source = np.repeat(np.arange(4), quotas)
    draw = np.concatenate([np.arange(q) for q in quotas])
    shard = mixture.shard_of(source, draw)
    held = np.bincount(shard, minlength=13)
    assert held.sum() == quotas.sum() and held.max() - held.min() <= 1
    for k in range(4):  # a shard's blocks of a source lie together
        assert (np.diff(shard[source == k]) >= 0).all()
    assert (mixture.shard_of(source[::-1], draw[::-1]) == shard[::-1]).all()
