"""The training-data operators against brute force, libraries and round trips, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat_format, fingerprints, license_scan, line_dedup, near_dedup, packing, piece_codec, quality_classifier, quality_rules, template, token_counts

SF = "/root/testdata/sf0.001"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, ""), (2, None), (3, "one"), (4, "A" * 50_000), (5, "word " * 20_000), (6, "The MIT License, again.\nThe MIT License, again.\n \n"),
    (7, "a line that several documents hold\nown seven\n"), (8, "own eight\n  A line that SEVERAL documents hold \t"), (9, "a line that several documents hold"),
    (9, "a line that several documents hold"), (None, "a line that several documents hold"), (10, "naïve ΑΣ 日本語 🎉 \x00 \x1c x\u0085y <|endoftext|>"), (11, "  \n\t "),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", True) for r in ODD], SCHEMA + ", score string, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(frame):
    return [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------------------------


def test_edited_counts_equal_a_new_count():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd, letters = random.Random(3), "ab'st reled  \n\t1é.!"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 60, 900])))
        counted = token_counts.CountedText(text, counter)
        for _ in range(5):
            a = rnd.randint(0, len(text))
            edit = (a, rnd.randint(a, min(len(text), a + 30)), "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 9, 300]))))
            text = token_counts.apply_edit(text, edit)
            counted.edit(*edit)
            assert counted.text() == text
            assert counted.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_edits_under_any_pattern():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")
    rnd = random.Random(7)
    for _ in range(200):
        text = "".join(rnd.choice("ab 1\n\r.") for _ in range(rnd.randint(0, 60)))
        counted = token_counts.CountedText(text, counter)
        for _ in range(4):
            a = rnd.randint(0, len(text))
            edit = (a, rnd.randint(a, len(text)), "".join(rnd.choice("a \n1") for _ in range(rnd.randint(0, 5))))
            text = token_counts.apply_edit(text, edit)
            counted.edit(*edit)
            assert [p for own, _ in counted.leaves for p in own] == counter.split(text)
            assert counted.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_long_texts_are_counted_again_near_edits_only():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counted = token_counts.CountedText("some words here. " * 5_000, counter)
    counted.edit(40_000, 40_004, "other")
    assert counted.recounted < 20


def test_token_counts_on_tables(docs, odd, empty):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    counter = token_counts.Counter(*args)
    for frame in (docs, odd):
        expected = []
        for doc_id, text in pairs(frame):
            after = text
            for edit in token_counts.sample_edits(text):
                after = token_counts.apply_edit(after, edit)
            expected.append((doc_id, len(text), len(counter.encoding.encode_ordinary(text)), len(after), len(counter.encoding.encode_ordinary(after))))
        assert sorted((tuple(r)[:5] for r in token_counts.count_edited(frame, *args).collect()), key=str) == sorted(expected, key=str)
    assert token_counts.count_edited(empty, *args).count() == 0


# 2 and 6 ---------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels.where(quality_classifier.held_out(labels["doc_id"])), "doc_id").select("doc_id", "text", "quality")
    model = quality_classifier.fit_quality(docs, labels)
    rows = known.collect()
    got = model.scores([r.text or "" for r in rows]) >= quality_classifier.THRESHOLD
    truth = np.array([r.quality == 1 for r in rows])
    assert (got == truth).mean() > 0.97
    assert got[truth].mean() > 0.99


def test_scores_on_odd_tables(odd, empty, docs, labels, spark):
    got = quality_classifier.score_documents(odd.unionByName(docs, allowMissingColumns=True), labels).collect()
    assert len(got) == len(ODD) + docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (quality_classifier.crc_remainder(r.doc_id) == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in quality_classifier.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert quality_classifier.filter_by_quality(odd, labels, known=docs).columns == odd.columns


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    held = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = [any(held[tuple(words[s : s + 3])] > 1 for s in range(max(0, k - 2), min(k + 1, len(words) - 2))) for k in range(len(words))]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(inside)


def test_rule_counts(docs, labels, odd, empty):
    for frame in (docs, odd):
        got = quality_rules.rule_report(frame, labels).collect()
        expected = sorted(((d, *brute_counts(t)) for d, t in pairs(frame)), key=str)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == expected
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.rule_report(empty, labels).count() == 0
    assert quality_rules.filter_by_rules(odd, labels, known=docs).columns == odd.columns


def test_the_forest_finds_odd_rows():
    # Splits lie between the fitted rows, so the odd ones have to be among them.
    rows = np.random.default_rng(0).normal(0, 1, (1000, 3))
    odd_ = np.array([[9.0, 0, 0], [0, -8.0, 0], [7.0, 7.0, 7.0]])
    forest = quality_rules.IsolationForest.fit(np.concatenate([rows, np.tile(odd_, (5, 1))]))
    assert (forest.scores(odd_) > np.quantile(forest.scores(rows), 0.99)).all()
    scores, clean = np.array([0.9, 0.8, 0.3, 0.2]), np.array([False, False, True, True])
    assert 0.3 < quality_rules.calibrate(scores, clean) <= 0.8
    assert quality_rules.calibrate(scores, np.array([True] * 4)) == np.inf


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_places(text):
    words = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({label for _, label in found}))


def test_license_places(spark, docs, odd, empty):
    extra = spark.createDataFrame([(100, "CC-BY 4.0; gnu General-Public license. apache\nlicense, MIT License MIT license"), (101, " ".join(license_scan.TEMPLATES[5][1].upper().split()))], SCHEMA)
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        got = license_scan.scan_licenses(frame).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((d, *brute_places(t)) for d, t in pairs(frame)), key=str)
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    by = {r.doc_id: r for r in license_scan.scan_licenses(extra).collect()}
    assert "mit-notice" in by[101].labels and by[101].n_base == 0
    assert license_scan.scan_licenses(empty).count() == 0


def brute_labels(text):
    """Labels of templates by trying every start, and the score."""
    words = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    index = collections.defaultdict(list)
    for word, label, base, position, anchors, _, _ in license_scan.postings():
        if not base:
            index[label].append((position, word, anchors))
    phrases = {label: (t.split(), p.split()) for label, t, p in license_scan.TEMPLATES}
    labels, best = {x for x in brute_places(text)[4].split(",") if x}, 0.0
    for label, rows in index.items():
        whole, phrase = phrases[label]
        inside = next(k for k in range(len(whole)) if whole[k : k + len(phrase)] == phrase)
        for start in range(-len(whole), len(words)):
            share = sum(0 <= start + p < len(words) and words[start + p] == w for p, w, _ in rows) / rows[0][2]
            stands = share > 0 and start + inside >= 0 and words[start + inside : start + inside + len(phrase)] == phrase
            best = max(best, share if stands else share / 2)
            if stands and share >= license_scan.COVERAGE:
                labels.add(label)
    return ",".join(sorted(labels)), 1.0 if brute_places(text)[1] else best


def test_license_labels_equal_trying_every_start(spark, odd):
    rnd = random.Random(6)
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    rows = [(1, " ".join(notices)), (2, None), (3, "")]
    for k in range(60):
        words = [w for t in rnd.sample(notices, rnd.randint(1, 4)) for w in t.split()]
        for _ in range(rnd.randint(0, 12)):  # words left out, put in and changed
            at = rnd.randrange(len(words))
            words[at : at + rnd.randint(0, 2)] = rnd.choice([[], ["license"], [rnd.choice(words)], ["The", "copyright"]])
            words = words or ["x"]
        rows.append((10 + k, rnd.choice([" ", ", ", "\n"]).join(words)))
    rows += rows[:5]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.labels, r.score) for r in got), key=str) == sorted(((d, *brute_labels(t or "")) for d, t in rows), key=str)
    assert set(next(r for r in got if r.doc_id == 1).labels.split(",")) >= {label for label, _, _ in license_scan.TEMPLATES}


def test_texts_with_many_licence_words_keep_all_labels(spark):
    notice = {label: text for label, text, _ in license_scan.TEMPLATES}
    common = sorted({p[0] for p in license_scan.postings()} - {"apache"})
    texts = {1: list(notice), 2: ["gpl-notice", "mit-notice", "bsd", "isc", "mit-release"]}
    rows = [(k, ". ".join(notice[label] for label in labels)) for k, labels in texts.items()]
    rows.append((3, f"{' '.join(common)}. {notice['apache-2.0']}"))
    by = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(set(labels) <= set(by[k].labels.split(",")) for k, labels in texts.items())
    assert "apache-2.0" in by[3].labels.split(",")


def test_license_scans_run_no_python(docs):
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, docs, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.PieceCodec(PIECES)
    rnd = random.Random(1)
    texts = [t for _, t in pairs(docs)] + [t or "" for _, t in ODD] + ["".join(rnd.choice("abcdethin  \nñéλ🎉▁.,'") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode([*ids, 2]) == library.decode([*ids, 2])
    got = {r.doc_id: r for r in piece_codec.encoding_digests(docs, PIECES).collect()}
    for doc_id, text in pairs(docs):
        ids = [*library.encode(text), 2]
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_documents(odd, PIECES).count() == len(ODD) and piece_codec.encoding_digests(empty, PIECES).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for line in text.split("\n"):
                if len(key(line)) >= 20:
                    held[key(line)].add(doc_id)
    return sorted(((d, "\n".join(x for x in t.split("\n") if d is None or len(held[key(x)]) < 3 or max(held[key(x)]) == d)) for d, t in rows), key=str)


def test_line_dedup(docs, odd, empty):
    for frame in (docs, odd):
        got = line_dedup.dedup_lines(frame)
        assert got.columns == frame.columns
        assert sorted(pairs(got), key=str) == brute_lines(pairs(frame))
        report = line_dedup.line_report(frame).collect()
        assert sorted((str(r.doc_id), r.kept_sha256) for r in report) == sorted((str(d), hashlib.sha256(t.encode()).hexdigest()) for d, t in brute_lines(pairs(frame)))
    assert line_dedup.line_report(empty).count() == 0


def test_inserts_and_deletes_are_reversible(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)  # the shards grow on the way
    parts = [docs.where(f"doc_id % 4 = {k}") for k in range(4)]
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    states = [line_dedup.insert_documents(line_dedup.empty_state(docs), parts[0])]
    for part in parts[1:]:
        states.append(line_dedup.insert_documents(states[-1], part))
    assert states[-1].shards > states[0].shards > 1
    whole = line_dedup.insert_documents(line_dedup.empty_state(docs), docs)
    assert rows(states[-1].counts) == rows(whole.counts) and rows(states[-1].refs) == rows(whole.refs)
    assert sorted(pairs(line_dedup.state_report(states[-1], docs)), key=str) == brute_lines(pairs(docs))
    back = line_dedup.delete_documents(line_dedup.delete_documents(states[-1], parts[3]), parts[2].union(parts[3]))
    assert rows(back.counts) == rows(states[1].counts) and rows(back.refs) == rows(states[1].refs) and back.keys == states[1].keys
    again = line_dedup.insert_documents(line_dedup.insert_documents(back, parts[3]), docs)
    assert rows(again.counts) == rows(whole.counts) and again.keys == whole.keys
    # The filters know every key that is held, and hardly any other.
    held, other = again.counts.select("k1", "k2"), again.counts.select(F.expr("k1 + 1").alias("k1"), "k2")
    assert line_dedup._probe(held, again).where("not maybe").isEmpty()
    assert line_dedup._probe(other, again).where("maybe").count() < 0.02 * other.count()
    assert line_dedup._probe(whole.counts.join(back.counts, ["k1", "k2"], "left_anti").select("k1", "k2"), back).where("maybe").count() < 0.02 * again.keys


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line that several documents hold"
    rows = [(k, f"{line}\nown {k}", k, "x", [f"{k}"], k * 10) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id long, drop string, __lines array<string>, tie long")
    got = sorted(map(tuple, line_dedup.dedup_lines(frame).collect()))
    assert got == [(k, t if k == 4 else f"own {k}", *more) for k, t, *more in rows]


def test_cuckoo_filters_hold_and_forget():
    random_ = np.random.default_rng(5)
    keys = random_.integers(-(2**63), 2**63 - 1, (2, 5000))
    held = line_dedup.CuckooFilter(4000)
    held.insert(*keys[:, :4000])
    again = line_dedup.CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(*keys[:, :4000]).all() and again.contains(*keys[:, 4000:]).mean() < 0.01
    again.delete(*keys[:, :2000])
    small = line_dedup.CuckooFilter(100)
    small.insert(*keys[:, :300])  # far beyond its size: the rest is stashed
    small = line_dedup.CuckooFilter.from_bytes(small.to_bytes())
    assert small.stash and small.contains(*keys[:, :300]).all()
    small.delete(*keys[:, :300])
    assert not small.stash and not small.table.any()
    assert again.contains(*keys[:, 2000:4000]).all() and again.contains(*keys[:, :2000]).mean() < 0.01


# 7 ---------------------------------------------------------------------------------------------------------------


def test_conversations_read_back(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (1, 1, "assistant", said), (2, None, "a%0A\nb<|", "x"), (None, 0, "user", "n"), (3, 0, None, "")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(3000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat_format.conversation_report(frame).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
    assert chat_format.conversation_report(frame.limit(0)).count() == 0


def test_templates_that_need_the_turns_number_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    for bad in ("{% for m in messages %}{{ loop.index0 }}{% endfor %}", "{% for m in messages %}{% if not loop.first %}-{% endif %}{{ m.text }}{% endfor %}", "head {% for m in messages %}{{ m.text }}{% endfor %}"):
        with pytest.raises(ValueError):
            chat_format.format_turns(rows, bad)


def test_the_template_language():
    made = template.Template("{% for m in messages %}{% if not m.role == 'x' and true %}<{{ 'a' + 'b' | up }}{{ loop.index0 }}{% generation %}{{ m.text }}{% endgeneration %}{% elif loop.first %}F{% else %}-{% endif %}{% endfor %}!", {"up": str.upper})
    out = made.render([{"role": "x", "text": "1"}, {"role": "y", "text": "2"}, {"role": "x", "text": "3"}])
    assert out.text() == "F<aB12-!" and [out.text()[a:b] for a, b in out.spans] == ["2"]
    assert template.parse("{{ 'a' + 'b' }}c{% if 'x' == 'y' %}no{% endif %}", {}) == (template.Write(template.Const("abc")),)
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{{ m | nope }}", "{% import x %}", "{% if true %}", "{{ (1 }}"):
        with pytest.raises(template.TemplateError):
            template.parse(bad, {})


# 8 ---------------------------------------------------------------------------------------------------------------


def brute_groups(rows, k, percent=80):
    sets = collections.defaultdict(list)
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d].append(frozenset(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(d, s) for d, own in sets.items() for s in own if s]
    for n, (a, x) in enumerate(flat):
        for b, y in flat[:n]:
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                top[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in sets}


def chain(n):
    """Texts of which only neighbours are near: their first and last words shift."""
    return [(1000 + k, " ".join(f"w{j}" for j in range(6 * k, 6 * k + 120))) for k in range(n)]


def test_near_duplicates(spark, docs, odd, empty):
    many = spark.createDataFrame(chain(40) + [(2000 + k, "same text for all of them here") for k in range(200)] + [(3000, "Same TEXT for all of them here")], SCHEMA)
    for frame in (docs.select("doc_id", "text"), odd.where("doc_id is not null").select("doc_id", "text"), many):
        got = near_dedup.near_duplicates(frame, 2).collect()
        expected = brute_groups(pairs(frame), 2)
        assert len(got) == frame.count()
        assert {r.doc_id: r.component_id for r in got} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.drop_near_duplicates(odd, 2)
    assert left.columns == odd.columns and left.where("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(empty, 2).count() == 0


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "HUB_MEMBERS", 3)
    rnd = random.Random(9)
    rows = chain(25)
    for family in range(4):  # versions of one text: near, nearly near and far ones share buckets
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(40):
            own = list(base)
            for at in rnd.sample(range(60), rnd.randint(0, 9)):
                own[at] = f"x{rnd.randrange(10**6)}"
            rows.append((5000 + len(rows), " ".join(own)))
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", component string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, 2).collect()} == brute_groups(rows, 2)
    clashing = docs.limit(60).withColumns({"__id": F.lit(3), "id": F.col("doc_id") * 2, "row": F.lit("r"), "n_shingles": F.lit(1)})
    left = near_dedup.drop_near_duplicates(clashing, 2)
    assert left.columns == clashing.columns and all(r["id"] == 2 * r.doc_id and r["row"] == "r" for r in left.collect())


def test_estimates_are_close_to_the_similarity():
    shingle, sign = near_dedup.Shingler(2), near_dedup.Signer()
    words = [f"w{k}" for k in range(1000)]
    a, b = shingle(" ".join(words)), shingle(" ".join(words[:900] + [f"x{k}" for k in range(100)]))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = near_dedup.estimate(*(np.frombuffer(sign(x)[1], np.uint64) for x in (a, b)))
    assert abs(got - truth) < near_dedup.MARGIN


# 9 ---------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), odd.where("doc_id = 3").select("doc_id", "text")):
        rows = sorted(pairs(frame), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
        expected = []
        for k, (doc_id, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            marks = [fingerprints.digest(x.encode()) for x in (text, edited, after)]
            expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2])))
        assert sorted((tuple(r) for r in fingerprints.fingerprint_report(frame).collect()), key=str) == sorted(expected, key=str)
    assert fingerprints.fingerprint_report(empty).count() == 0


def test_likeness_is_bounded():
    a, b = fingerprints.digest(b"some text " * 50), fingerprints.digest(bytes(range(256)) * 9)
    assert fingerprints.likeness(a, a) == 1 and 0 <= fingerprints.likeness(a, b) < 0.5
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)


# 10 --------------------------------------------------------------------------------------------------------------


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for frame in (docs, odd):
        expected = []
        for doc_id, text in pairs(frame):
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                part = np.array(ids[k : k + 4096], dtype="<u4")
                expected.append((doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
        got = packing.pack(frame, WORDS).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
    assert packing.pack(empty, WORDS).count() == 0


def test_bins_are_tight():
    random_ = np.random.default_rng(2)
    histogram = dict(collections.Counter(random_.integers(1, 4097, 5000).tolist()))
    plan = packing.plan_bins(histogram)
    used = collections.Counter()
    for times, held in plan:
        assert sum(length * n for length, n in held) <= 4096
        for length, n in held:
            used[length] += times * n
    assert used == collections.Counter(histogram)
    least = -(-sum(k * n for k, n in histogram.items()) // 4096)
    assert sum(times for times, _ in plan) <= 1.02 * least
    assert packing.plan_bins({6: 1, 3: 2, 4: 1, 2: 1}, 10)  # widened gaps and single pieces
