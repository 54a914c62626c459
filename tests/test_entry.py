import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from crivo import queries

ROOT = Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLE_SQL:
        return
    want = tables.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_entry_without_the_optional_parts():
    """The entry point imports where the training-data folder and the pipeline are absent."""
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['crivo', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name='.'.join(name.split('.')[:2]))
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert 'adj' in e.queries() and 'adj' in e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_stream_of_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from crivo.operators.rules import compile_rules
    from crivo.streaming.rules import label_counts, label_stream

    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word of "), F.col("id")).alias("text"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    labelled = label_stream(stream, compile_rules(queries.RULES))
    query = label_counts(labelled, "ts").writeStream.outputMode("complete").format("memory").queryName("label_counts").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("label_counts").where("label = 'english'").agg(F.sum("n")).first()[0] == 20
