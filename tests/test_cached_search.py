import pytest
from pyspark.sql import functions as F

from crivo.operators.cached_search import CachedSearch
from crivo.operators.criteria import compile_criterion


def at(day):
    return F.lit(f"2024-01-{day:02d} 12:00:00").cast("timestamp")


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, updated string").withColumn("updated", F.col("updated").cast("timestamp"))


def found(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def search(tmp_path):
    return CachedSearch(str(tmp_path / "c"), date_col="updated")


def test_a_second_search_tests_what_changed(spark, search):
    c = compile_criterion("casa ADJ2 papel")
    docs = corpus(spark, [(1, "casa de papel", "2024-01-01"), (2, "casa", "2024-01-01"), (3, None, "2024-01-01"), (None, "casa papel", "2024-01-01"), (4, "casa papel casa", None)])
    assert search.unsettled(docs, c, at(2)).count() == 4
    assert found(search.search(docs, c, at(2))) == [(4, 3), (1, 2)]
    assert search.unsettled(docs, c, at(3)).count() == 0
    assert {(r.id, r.status) for r in search.rows(spark).collect()} == {(1, "F"), (2, "X"), (3, "X"), (4, "F")}
    later = corpus(spark, [(1, "muro", "2024-01-03"), (2, "casa", "2024-01-01"), (4, "casa papel casa", None), (5, "casa e papel", "2024-01-01")])
    assert sorted(r.doc_id for r in search.unsettled(later, c, at(4)).collect()) == [1, 5]
    assert found(search.search(later, c, at(4))) == [(4, 3), (5, 2)]
    # Another criterion has comparisons of its own; equal ones written otherwise share them.
    assert search.unsettled(later, compile_criterion("casa"), at(4)).count() == 4
    assert search.unsettled(later, compile_criterion("(casa) ADJ2 (papel)"), at(4)).count() == 0


def test_use_keeps_comparisons_alive_and_purge_drops_the_rest(spark, search):
    docs = corpus(spark, [(1, "casa", "2023-01-01"), (2, "muro", "2023-01-01")])
    now = lambda text: F.lit(text).cast("timestamp")
    search.search(docs, "casa", now("2023-02-01"))
    search.search(docs, "muro", now("2023-02-01"))
    search.search(docs, "casa", now("2023-06-01"))
    assert search.unsettled(docs, compile_criterion("casa"), now("2023-11-01")).count() == 0
    assert search.unsettled(docs, compile_criterion("muro"), now("2023-11-01")).count() == 2
    assert search.purge(spark, now("2023-11-01")) == 1
    assert search.rows(spark).count() == 2 and search.generation(spark) == 1
    assert found(search.search(docs, "muro", now("2023-11-02"))) == [(2, 1)]
    assert search.rows(spark).count() == 4


def test_sessions_of_all_modes(spark, search):
    docs = corpus(spark, [(1, "casa papel", "2024-01-01"), (2, "casa", "2024-01-01"), (3, "papel", "2024-01-01")])
    first = search.session("s", docs, "casa", now=at(2))
    assert sorted((r.id, r.status) for r in first.collect()) == [(1, "F"), (2, "F")]
    more = search.session("s", docs, "papel", first, "union", at(2))
    assert sorted(r.id for r in more.collect()) == [1, 2, 3]
    fewer = search.session("s", docs, "casa E papel", more, "filter", at(2))
    assert [r.id for r in fewer.collect()] == [1]


def test_patterns_empty_tables_and_errors(spark, search):
    docs = corpus(spark, [(1, "casa 123", "2024-01-01"), (2, "muro", "2024-01-01")])
    assert found(search.search(docs, "r:[0-9]{3}", at(2))) == [(1, 0)]
    assert found(search.search(docs, "muro remover(123)", at(2))) == [(2, 0)]
    assert found(search.search(corpus(spark, []), "casa", at(2))) == []
    with pytest.raises(ValueError):
        search.search(docs, "casa E E muro", at(2))
