"""Queries on made texts where an engine's reading of a pattern could part from SQL's."""

import duckdb
import pytest

from crivo import queries
from crivo.functions.ambiguity import ambiguous
from crivo.functions.patterns import MACROS, ascii_only, compiled, expand


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents whose first 200 characters, or which themselves, are one line and its line feed, and others."""
    folder = tmp_path_factory.mktemp("odd")
    line = "The " + "a" * 195
    texts = [f"{line}\n", f"{line}\nthing 123 the b of", f"{line}a\nthing", "The a\n", "The a", "the a\nthe b\n", f"{line}\n\n"]
    rows = [(k, t, "en", f"src{k}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in sorted(p.name for p in folder.iterdir()):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, str(folder)).toPandas()
    key = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).values.tolist()))
    assert len(want) and key(got) == key(want)


@pytest.mark.parametrize("name", ["rules_all", "rule_labels", "rules_detail", "rules_first_of_group", "rules_index_mixed", "rules_tag_key_filter"])
def test_a_last_line_feed_counts_in_like(spark, made, name):
    equals_sql(spark, made, name)


@pytest.mark.parametrize("name", ["macro_oab", "macro_cpf", "macro_cnpj", "macro_num", "macro_oab_value"])
def test_registrations_are_ascii(spark, tmp_path, name):
    """A letter that folding leaves (a sharp s) or a foreign digit is neither part of a registration nor of a word beside it."""
    texts = ["12 ßse x", "großes 12 x", "12 maß", "sp 12ß", "sp \u0663\u0663", "ßsp 123", "123 spß", "sp 12 x", "ß123.456.789-09", "123.456.789-0\u0663", "42.318.949/0001-84ß", "1.000ß", "ſp 123"]
    rows = [(5 * k + 4, t, "de", "src", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, name)


def test_only_ready_made_registrations_are_narrowed():
    assert ascii_only(r"[\d.]\w\.\\b") == r"(?-i:[0-9.][a-z0-9_]\.\\b)"
    assert compiled("r:<TERMO>").endswith(rf"({MACROS['TERMO']})") and compiled("r:<OAB>", {"OAB": r"\w"}).endswith(r"(\w)")
    assert ambiguous(compiled("r:<OAB>")) == ambiguous(expand("<OAB>"))
