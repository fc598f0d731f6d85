"""The classifier and the forest against computing them word by word and split by split."""

import math
import re

import numpy as np
import pytest
import xxhash

from sluice.llm import quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_scores_are_those_of_the_pooled_words(tables):
    docs, labels = tables
    model = quality_classifier.fit_quality(docs, labels)
    rows, vectors = model.vectors.rows, model.vectors.vectors.tolist()
    w1, b1, w2, b2 = (w.tolist() for w in model.network.weights)
    n = quality_classifier.DIMENSIONS

    def score(text):
        at = [rows.get(w, rows.get(" " + quality_classifier.shape(w), len(vectors) - 1)) for w in words_of(text)]
        own = [vectors[k] for k in at]
        mean = [sum(v[d] for v in own) / max(1, len(own)) for d in range(n)]
        spread = [math.sqrt(sum((v[d] - mean[d]) ** 2 for v in own) / max(1, len(own))) for d in range(n)]
        pairs = max(1, len(own) - 1)
        same = sum(a == b for a, b in zip(at, at[1:], strict=False)) / pairs
        near = sum(sum(x * y for x, y in zip(u, v, strict=True)) for u, v in zip(own, own[1:], strict=False)) / pairs
        row = [*mean, *spread, same, near, float(bool(own))]
        x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(row, model.network.mean, model.network.scale, strict=True)]
        hidden = [max(0, sum(v * w1[i][k] for i, v in enumerate(x)) + b1[k]) for k in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        return 1 / (1 + math.exp(-min(40, max(-40, logit / model.network.temperature))))

    sample = [r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()] + ["", " ", "x" * 3000, "a-1" * 400]
    assert np.allclose(model.scores(sample), [score(t) for t in sample], atol=2e-4)


def test_word_vectors_are_sums_around_the_words():
    texts = ["alpha beta gamma Delta 12", "beta alpha beta", "alpha solo"]
    made = quality_classifier.fit_vectors(texts)
    shape, index = quality_classifier.shape, quality_classifier.index_vector
    counts = {}
    for text in texts:
        for w in words_of(text):
            counts[w] = counts.get(w, 0) + 1
    token = lambda w: w if counts[w] > 1 else " " + shape(w)
    keys = list(made.rows)
    total = {k: np.zeros(quality_classifier.DIMENSIONS) for k in keys}
    for text in texts:
        words = words_of(text)
        for k, w in enumerate(words):
            for j in range(max(0, k - quality_classifier.WINDOW), min(len(words), k + quality_classifier.WINDOW + 1)):
                if j != k:
                    around = index(" " + shape(words[j])) + 0.5 * index(token(words[j]))
                    total[token(w)] += around
                    total[" " + shape(w)] += around
    seen = {k: counts.get(k, 0) for k in keys}
    shared = sum(seen[k] * total[k] for k in keys) / sum(seen.values())
    for k in keys:
        v = total[k] - shared
        v = v / max(np.linalg.norm(v), 1e-9)
        v = v + 0.5 * index(" " + shape(k) if k in counts else k) / math.sqrt(quality_classifier.NONZERO)
        assert np.allclose(made.vectors[made.rows[k]], v / np.linalg.norm(v), atol=1e-5), k


def test_the_temperature_is_the_best_of_its_grid():
    random = np.random.default_rng(3)
    rows, labels = random.normal(0, 1, (300, 5)), (random.random(300) < 0.5).astype(np.int64)
    labels[:200] = rows[:200, 0] > 0
    net = quality_classifier.Network.fit(rows, labels, steps=80)
    held = np.arange(300) % 5 == 4

    def loss(t):
        p = 1 / (1 + np.exp(-net._layers(net._inputs(rows[held]))[1] / t))
        return -np.mean(np.log(np.where(labels[held] == 1, p, 1 - p)))

    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 41))


def test_verdicts_follow_the_paths(tables):
    docs, labels = tables
    model = quality_rules.fit_rules(docs, labels)
    known = sorted(((r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] is not None), key=lambda r: ((xxhash.xxh64_intdigest(int(r[0]).to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64, r[0]))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def score(stats):
        total = 0.0
        for feature, split, child, path in model.forest.trees:
            at = 0
            while feature[at] >= 0:
                at = child[at] + (stats[feature[at]] >= split[at])
            total += path[at]
        n = model.forest.subsample
        usual = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        return 2 ** (-total / len(model.forest.trees) / usual)

    verdicts = {r["doc_id"]: r for r in quality_rules.rule_report(docs, labels).collect()}
    checked = [d for d, _ in known if d in texts][:300]
    for doc_id in checked:
        counts = quality_rules.rule_counts(texts[doc_id])
        own = score(quality_rules.statistics(texts[doc_id], counts))
        assert abs(own - verdicts[doc_id]["anomaly"]) < 1e-9
        assert verdicts[doc_id]["kept"] == (not verdicts[doc_id]["base_failed"] and own < model.threshold)
    # The forest has seen one half of the labelled rows, the threshold the other.
    label = dict(known)
    order = [d for d, _ in known if d in texts][: quality_rules.SAMPLE_ROWS]
    rows = [(d, quality_rules.rule_counts(texts[d])) for d in order]
    fitted = np.array([quality_rules.statistics(texts[d], c) for k, (d, c) in enumerate(rows) if k % 2 == 0])
    again = quality_rules.IsolationForest.fit(fitted)
    assert all((x == y).all() for a, b in zip(again.trees, model.forest.trees, strict=True) for x, y in zip(a, b, strict=True))
    other = [(d, c) for k, (d, c) in enumerate(rows) if k % 2 and not quality_rules.base_failed(c)]
    scores = np.array([score(quality_rules.statistics(texts[d], c)) for d, c in other])
    clean = np.array([label[d] == 1 for d, _ in other])
    cost = lambda t: (scores[~clean] < t).mean() + quality_rules.CLEAN_WEIGHT * (scores[clean] >= t).mean()
    assert all(cost(model.threshold) <= cost(t) + 1e-9 for t in [*scores, np.inf])


def test_trees_split_between_their_rows():
    rows = np.random.default_rng(1).normal(0, 1, (64, 2))
    feature, split, child, path = quality_rules.IsolationForest.fit(rows, trees=1, subsample=64).trees[0]
    todo = [(0, rows, 0)]
    while todo:
        at, mine, level = todo.pop()
        if feature[at] < 0:
            more = 0 if len(mine) < 2 else 1 if len(mine) == 2 else 2 * (math.log(len(mine) - 1) + 0.5772156649) - 2 * (len(mine) - 1) / len(mine)
            assert abs(path[at] - level - more) < 1e-9
            continue
        assert mine[:, feature[at]].min() <= split[at] <= mine[:, feature[at]].max()
        left = mine[:, feature[at]] < split[at]
        todo += [(child[at], mine[left], level + 1), (child[at] + 1, mine[~left], level + 1)]


def test_the_forest_is_fitted_on_all_labelled_rows(spark, tmp_path, monkeypatch):
    """Threshold and trees come from every labelled row, not from the 4,000 that hashes put first."""
    rows = [(k, "".join("word%d " % (k * 7 % 997 + j) for j in range(60)) + "#" * (k % 50)) for k in range(9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 50 < 40)) for k, _ in rows], "doc_id long, quality int")
    seen = []
    own = quality_rules.calibrate_rows

    def calibrated(scored, scratch, *more):
        held = scored.collect()
        scores, clean = np.array([r["score"] for r in held]), np.array([r["clean"] for r in held])
        seen.append((len(held), quality_rules.calibrate(scores, clean), own(scored, scratch, *more)))
        return seen[-1][2]

    monkeypatch.setattr(quality_rules, "calibrate_rows", calibrated)
    quality_rules.fit_rules(docs, labels)
    assert seen[0][0] == 4_500
    assert abs(seen[0][1] - seen[0][2]) < 1e-12
    monkeypatch.setattr(quality_rules, "SAMPLE_ROWS", quality_rules.TREES * 16)  # fewer than there are: each tree has rows of its own
    model = quality_rules.fit_rules(docs, labels)
    assert model.forest.subsample == 16 and len(model.forest.trees) == quality_rules.TREES
