"""Each stage of the pipeline against brute force over what it was given."""

import corpus_pipeline
from test_operators import ODD, brute_groups, brute_lines, pairs

from sluice.llm import quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(ODD, "doc_id long, text string").where("doc_id > 9 or doc_id is null"), allowMissingColumns=True)
    rules, classifier = quality_rules.fit_rules(docs, labels), quality_classifier.fit_quality(docs, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs(given)
        stage(spark, given, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        texts = [t for _, t in before]
        if name == "quality rules":
            kept = rules.keeps(texts, [quality_rules.rule_counts(t) for t in texts])[1]
            assert sorted(pairs(after), key=str) == sorted((r for r, ok in zip(before, kept, strict=True) if ok), key=str)
        elif name == "quality classifier":
            kept = classifier.scores(texts) >= quality_classifier.THRESHOLD
            assert sorted(pairs(after), key=str) == sorted((r for r, ok in zip(before, kept, strict=True) if ok), key=str)
        elif name == "line dedup":
            assert sorted(pairs(after), key=str) == brute_lines(before)
        elif name == "MinHash near-dedup":
            group = brute_groups([r for r in before if r[0] is not None], corpus_pipeline.SHINGLE_WORDS)
            assert sorted(pairs(after), key=str) == sorted((r for r in before if r[0] is None or group[r[0]] == r[0]), key=str)
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {d for d, _ in before}
        if k < 4:
            assert after.columns == given.columns
        given = after


def test_the_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_the_whole_pipeline_leaves_one_stage_behind(spark):
    import pathlib

    root = pathlib.Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.length for r in rows} <= set(range(1, 4097)) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    left = {p.name.rsplit("-", 1)[0]: sorted(x.name for x in p.iterdir()) for p in set(root.iterdir()) - before}
    assert left == {"pipeline": ["stage-3"], "packing": ["pieces"]}
