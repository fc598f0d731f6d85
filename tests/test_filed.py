import shutil

from sluice.operators import search
from sluice.plans.book import Book

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filed_rows_are_joined_once_a_session_and_again_when_files_change(spark, tmp_path):
    folder = f"{tmp_path}/sf"
    shutil.copytree(SF, folder)
    first = Book(spark, folder)
    assert "Join" not in _plan(first.contributions) and "Join" not in _plan(first.ledger)
    n = first.contributions.count()
    assert n == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert Book(spark, folder).contributions.inputFiles() == first.contributions.inputFiles()
    fewer = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_linenumber = 1")
    shutil.rmtree(f"{folder}/lineitem.parquet", ignore_errors=True)
    (tmp_path / "sf" / "lineitem.parquet").unlink(missing_ok=True)
    fewer.write.parquet(f"{folder}/lineitem.parquet")
    assert 0 < Book(spark, folder).contributions.count() == fewer.count() < n


def test_persons_are_named_without_sorting_all_rows(spark):
    b = Book(spark, SF)
    assert "SortAggregate" not in _plan(b.people)
    assert b.people.count() == b.people.select("indv_id").distinct().count()


def test_lookup_and_known_ids_are_those_of_the_yearly_entities(spark):
    b = Book(spark, SF)
    whole = search.build_lookup(b.yearly_entities)
    assert b.lookup.columns == whole.columns
    assert b.lookup.exceptAll(whole).isEmpty() and whole.exceptAll(b.lookup).isEmpty()
    ids = whole.select("id")
    assert b.known_ids.exceptAll(ids).isEmpty() and ids.exceptAll(b.known_ids).isEmpty()
    terms = search.tokenize(search.search_texts(b.yearly_entities))
    assert b.postings.exceptAll(terms).isEmpty() and terms.exceptAll(b.postings).isEmpty()
    assert "SortAggregate" not in _plan(b.lookup)
