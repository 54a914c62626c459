import math

import pytest
from pyspark.sql import functions as F

from crivo.operators.criteria import compile_criterion, matching
from crivo.sources.store import TokenStore


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, updated string").withColumn("updated", F.col("updated").cast("timestamp"))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_refresh_reads_only_what_changed(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"), date_col="updated")
    first = corpus(spark, [(1, "casa de papel", "2024-01-01"), (2, "casa de telha", "2024-01-01"), (3, None, "2024-01-01"), (None, "casa", "2024-01-01")])
    assert store.refresh(first) == 1
    assert ids(store.search(first, "casa ADJ2 papel")) == [1]
    assert ids(store.search(first, "NAO casa")) == [3]
    assert ids(store.search(first, "<vazio>")) == [3]
    assert ids(store.search(first, "tel$")) == [2]
    # 1 changes, 2 is removed, 4 is new
    second = corpus(spark, [(1, "muro", "2024-01-02"), (3, None, "2024-01-01"), (4, "casa de papel", "2024-01-01")])
    assert ids(store.outdated(second).select("doc_id")) == [1, 4]
    assert store.refresh(second) == 2
    assert ids(store.search(second, "casa OU muro")) == [1, 4]
    assert ids(store.search(second, "casa")) == [4]
    assert store.outdated(second).count() == 0


def test_a_batch_that_is_not_in_the_index_does_not_count(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"), date_col="updated")
    docs = corpus(spark, [(1, "casa", "2024-01-01")])
    store.refresh(docs)
    # what a refresh leaves that died before the index was written
    store.write(spark.sql("SELECT 1L AS doc_id, 'muro' AS w, 0 AS t, 0 AS p, '' AS c"), 2)
    assert ids(store.search(docs, "muro OU mur$")) == []
    more = corpus(spark, [(1, "casa", "2024-01-01"), (2, "muro", "2024-01-01")])
    assert store.refresh(more) == 2
    assert ids(store.search(more, "mur$")) == [2] and ids(store.search(more, "casa")) == [1]


def test_empty_and_unindexed(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"))
    none = corpus(spark, [])
    with pytest.raises(ValueError):
        store.postings(spark)
    store.refresh(none)
    assert ids(store.search(none, "casa")) == []
    docs = corpus(spark, [(1, "casa", "2024-01-01")])
    store.refresh(docs)
    assert ids(store.search(docs, "casa")) == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many(spark, n=200):
    return corpus(spark, [(k, f"casa palavra{k} numero x{k} " + ("muro " * 500 if k % 3 == 0 else ""), "2024-01-01") for k in range(n)])


def test_a_search_reads_the_shards_of_its_words_and_shuffles_no_postings(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"), buckets=4)
    store.refresh(many(spark))
    c = compile_criterion("casa ADJ2 numero")
    plan = plan_of(store.gathered(spark, c))
    assert "shard" in plan.split("PartitionFilters")[1].split("]")[0] and "Exchange" not in plan
    assert store.gathered(spark, c).count() == 200
    # A frequent word is dealt like the documents: no bucket's file holds much more than its share.
    sizes = [r["n"] for r in store.postings(spark, ["muro"]).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4


def test_a_wildcard_reads_the_shards_of_matching_words(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"), buckets=2)
    docs = corpus(spark, [(1, "amburgado x", "2024-01-01"), (2, "ambos tombados", "2024-01-01"), (3, "ab cd ef gh ij kl mn op qr", "2024-01-01")])
    store.refresh(docs)
    for wild, words in (("amb$ado", ["amburgado"]), ("?mb$", ["ambo", "amburgado", "tombado"]), ("a?b", ["ab", "ambo", "amburgado", "tombado"])):
        c = compile_criterion(wild)
        assert sorted(r.w for r in store.wild_words(spark, c.node).collect()) == [w for w in words if w in {r.w for r in store.wild_words(spark, c.node).collect()}]
        assert ids(store.search(docs, wild)) == ids(matching(docs, wild).select("doc_id"))
    found = store.wild_words(spark, compile_criterion("amb$ado").node).collect()
    assert [r.w for r in found] == ["amburgado"]
    filters = plan_of(store.needed(spark, compile_criterion("amb$ado"))).split("PartitionFilters")[1].split("]")[0]
    assert f"shard#" in filters and f"= {found[0].shard})" in filters


def test_comparisons_read_the_numbers_that_can_fit(spark, tmp_path):
    rows = [(k, {"ano": f"n {k * 37} x", "texto": f"casa {k}"}) for k in range(60)] + [(60, {"ano": "sem"}), (61, {"ano": "007"})]
    docs = spark.createDataFrame(rows, "doc_id long, campos map<string,string>")
    store = TokenStore(str(tmp_path / "s"), document="campos", buckets=2)
    store.refresh(docs)
    for criterion in ("@ano>=1000", "@ano<37", "@ano<>74", "@ano=007", "@ano>n", "casa E @ano<=370", "NAO @ano>100"):
        assert ids(store.search(docs, criterion)) == ids(matching(docs, criterion, "campos").select("doc_id")), criterion
    plan = plan_of(store.numbers(spark, compile_criterion("@ano>=1000").node))
    filters = plan.split("PartitionFilters")[1].split("]")[0]
    assert "digits" in filters and "ANO" in filters and "GreaterThanOrEqual(number,1000)" in plan


def test_one_writer_at_a_time(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"))
    docs = corpus(spark, [(1, "casa", "2024-01-01")])
    with store.alone(spark), pytest.raises(RuntimeError, match="another refresh"):
        store.refresh(docs)
    assert store.refresh(docs) == 1


def test_compaction_leaves_one_batch(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"), date_col="updated", buckets=2)
    store.refresh(corpus(spark, [(1, "casa", "2024-01-01"), (2, "muro", "2024-01-01"), (3, "telha", "2024-01-01")]))
    second = corpus(spark, [(1, "papel", "2024-01-02"), (2, "muro", "2024-01-01")])
    store.refresh(second)
    assert len(store.live(spark)) == 2
    assert store.compact(second) == 3
    # The document that is gone has an older batch only, which later searches by ids leave out.
    assert ids(store.search(second, "casa OU papel OU muro")) == [1, 2]
    assert store.postings(spark).where("doc_id < 3").count() == 2
    assert ids(store.outdated(second).select("doc_id")) == []


def test_ranking_weighs_rare_words_and_short_texts(spark, tmp_path):
    store = TokenStore(str(tmp_path / "s"))
    docs = corpus(spark, [(1, "casa casa papel", "2024-01-01"), (2, "casa papel " + "telha " * 30, "2024-01-01"), (3, "casa muro", "2024-01-01"), (4, "casa", "2024-01-01"), (5, "papel casa", "2024-01-01")])
    store.refresh(docs)
    got = [tuple(r) for r in store.ranked(docs, "casa E papel", 2).collect()]
    n, mean = 5, (3 + 32 + 2 + 1 + 2) / 5
    weight = lambda tf, df, size: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    want = sorted(((weight(a, 5, s) + weight(1, 3, s), k) for k, a, s in ((1, 2, 3), (2, 1, 32), (5, 1, 2))), reverse=True)[:2]
    assert [k for k, _ in got] == [k for _, k in want] and [s for _, s in got] == pytest.approx([s for s, _ in want])
