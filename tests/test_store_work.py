"""What a refresh reads and makes once."""

import pytest
from pyspark.sql import functions as F

from crivo.functions.tokens import postings, with_tokens
from crivo.sources.store import TokenStore

ROWS = [(1, "cars of the 12 cars", "2"), (2, "", "15"), (3, None, None), (4, "- .", "1"), (5, "a\nb", "")]


@pytest.mark.parametrize("document", ["text", "fields"])
def test_sizes_are_counted_without_tokenising_again(spark, tmp_path, monkeypatch, document):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("fields", F.create_map(F.lit("source"), "source", F.lit("text"), "text"))
    plans, finish = [], TokenStore.finish

    def watched(self, documents, batch):
        plans.append(documents._jdf.queryExecution().optimizedPlan().toString())
        finish(self, documents, batch)

    monkeypatch.setattr(TokenStore, "finish", watched)
    store = TokenStore(str(tmp_path / "s"), document=document)
    store.refresh(docs)
    assert len(plans) == 1 and "regexp_extract_all" not in plans[0]
    want = {r.doc_id: r.n for r in with_tokens(docs, document).select("doc_id", F.size("tok").alias("n")).collect()}
    assert {r.doc_id: r.n_tokens for r in store.index(spark).collect()} == want


@pytest.mark.parametrize("document", ["text", "fields"])
def test_postings_tokenise_once(spark, document):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("fields", F.create_map(F.lit("source"), "source", F.lit("text"), "text"))
    rows = postings(with_tokens(docs.repartition(2), document))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted(tuple(r) for r in rows.where("doc_id = 1 AND c <> 'SOURCE'").select("w", "t").collect()) == [("12", 3), ("cars", 0), ("cars", 4), ("of", 1), ("the", 2)]
