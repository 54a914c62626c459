import hashlib
import time

import pytest
from pyspark.sql import functions as F

from crivo.operators.rules import Rule, compile_rules
from crivo.operators.session import digest, last_rows, mini_digest
from crivo.operators.timing import append_log, rule_times, slow, within
from crivo.sources.ingest import read_examples, read_pages
from crivo.sources.tables import SCHEMAS, create_tables


def pages_of(content: bytes):
    if b"broken" in content:
        raise ValueError("bad cross references")
    return [*content.decode().split("\f")[1:], None]


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\fone\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.pdf").write_bytes(b"plain text")
    (tmp_path / "d.txt").write_bytes("ação<<pg>>b".encode("latin-1"))
    (tmp_path / "e.txt").write_bytes(b"")  # no row
    rows = lambda df: {r.path.rsplit("/", 1)[1]: (r.pages, r.error) for r in df.collect()}
    want = {"a.pdf": (["one", "two", ""], None), "b.pdf": (None, "extraction failed: bad cross references"), "c.pdf": (None, "not a pdf"), "d.txt": (["ação", "b"], None)}
    assert rows(read_pages(spark, str(tmp_path), pages_of)) == want
    assert rows(read_pages(spark, str(tmp_path)))["a.pdf"] == (None, "no parser for pdf files")


def test_examples(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"exemplos": [{"texto": "uma casa de papel", "criterios": "casa"}, {"texto": ""}, {"criterios": "papel", "outro": 1}]}')
    got = [(r.n, r.label, r.text, r.criterion) for r in read_examples(spark, str(tmp_path / "x.json")).orderBy("n").collect()]
    assert got == [(0, "uma casa de pap...", "uma casa de papel", "casa"), (2, "...", None, "papel")]


def test_digests(spark):
    row = spark.createDataFrame([("ação", "b")], "x string, y string").select(digest(F.col("x"), F.col("y")).alias("d"), mini_digest(F.col("x")).alias("m")).first()
    assert row.d == hashlib.sha1("ação|b".encode()).hexdigest()
    assert row.m == hashlib.sha1("ação".encode()).hexdigest()[::4]


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE crivo_tables_test LOCATION '{tmp_path}/tables'")
    names = create_tables(spark, "crivo_tables_test")
    assert len(names) == 9 and create_tables(spark, "crivo_tables_test") == names
    try:
        for name in SCHEMAS:
            want = {c.split()[0] for c in SCHEMAS[name].split(", ")}
            assert set(spark.table(f"crivo_tables_test.{name}").columns) == want
    finally:
        spark.sql("DROP DATABASE crivo_tables_test CASCADE")


def test_times_of_rules(spark, tmp_path):
    docs = spark.createDataFrame([(1, "casa de papel"), (2, "muro")], "doc_id long, text string").cache()
    times = rule_times(docs, compile_rules([Rule("g", "a", "casa", 1), Rule("g", "b", "r:muro", 2), Rule("g", "c", "casa E E muro", 3)]))
    append_log(times, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [(r.label, r.n_matched, r.error is None) for r in log.orderBy("label").collect()] == [("a", 1, True), ("b", 1, True), ("c", None, False)]
    assert slow(log, 3600).count() == 0 and slow(log.where("error IS NULL"), 0).count() == 2
    assert last_rows(log, 1).count() == 1


def test_a_time_limit_cancels_the_job(spark):
    def sleep(batches):
        for b in batches:
            time.sleep(30)
            yield b

    started = time.monotonic()
    with pytest.raises(TimeoutError):
        within(spark, 3, lambda: spark.range(1).mapInPandas(sleep, "id long").count())
    assert time.monotonic() - started < 25
    assert within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)
