"""Token positions of a document: array<struct<w, t, p, c>>.

``w`` is the singular of the word, ``t`` its index in the field, ``p`` the number of line feeds before it
and ``c`` the upper-case name of the field (empty for plain and paged documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.normalize import full, singular

TOKEN = "array<struct<w:string,t:int,p:int,c:string>>"
WORDS = "[0-9]+|[a-z]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once (an operand inside a lambda is computed for every element)."""
    return F.transform(F.array(value), body)[0]


def where_once(df: DataFrame, test: Column) -> DataFrame:
    """The rows that pass a costly test.

    A plain filter is moved below what stands under it, be it a repartition that deals the work, or
    repeated where its parts are used again; a generated column holds the result, computed once a row.
    """
    return df.select("*", F.explode_outer(F.array(test)).alias("_passes")).where("_passes").drop("_passes")


def words(text: Column) -> Column:
    """Words of a text and its line feeds, in order."""
    return F.transform(F.regexp_extract_all(full(text), F.lit(WORDS + "|\n"), 0), singular)


def of_text(text: Column, field: Column | None = None) -> Column:
    name = F.lit("") if field is None else F.upper(field)
    lines = F.split(full(text), "\n", -1)
    placed = F.flatten(F.transform(lines, lambda line, p: F.transform(F.regexp_extract_all(line, F.lit(WORDS), 0), lambda w: F.struct(singular(w).alias("w"), p.alias("p")))))
    return F.transform(placed, lambda x, t: F.struct(x["w"].alias("w"), t.alias("t"), x["p"].alias("p"), name.alias("c")))


def page_text(pages: Column) -> Column:
    """Pages are evaluated as if joined by line feeds."""
    return F.array_join(F.transform(pages, lambda x: F.coalesce(x, F.lit(""))), "\n")


def token_array(document: Column, kind: T.DataType) -> Column:
    """Positions of a plain (string), paged (array) or fielded (map, struct) document; null counts as empty."""
    if isinstance(kind, T.ArrayType):
        return of_text(F.coalesce(page_text(document), F.lit("")))
    if isinstance(kind, T.StructType):
        document = F.create_map(*[x for f in kind.fields for x in (F.lit(f.name), document[f.name].cast("string"))])
        kind = T.MapType(T.StringType(), T.StringType())
    if isinstance(kind, T.MapType):
        value = (lambda v: page_text(v)) if isinstance(kind.valueType, T.ArrayType) else (lambda v: v)
        parts = F.transform(F.map_entries(document), lambda e: of_text(F.coalesce(value(e["value"]), F.lit("")), e["key"]))
        return F.coalesce(F.flatten(parts), F.array().cast(TOKEN))
    return of_text(F.coalesce(document.cast("string"), F.lit("")))


def with_tokens(docs: DataFrame, document: str = "text", name: str = "tok") -> DataFrame:
    """``docs`` with the positions of the column ``document``, whatever its shape."""
    return docs.withColumn(name, token_array(F.col(document), docs.schema[document].dataType))


def unique_words(tok: Column) -> Column:
    return F.array_distinct(F.transform(tok, lambda x: x["w"]))


def postings(docs: DataFrame, id_col: str = "doc_id", tok: str = "tok") -> DataFrame:
    """(id, w, t, p, c): one row a token; write it bucketed by id or w to search a stored corpus."""
    # Not a plain inline: the filter that it brings along would make the tokens a second time.
    return docs.select(id_col, F.inline_outer(tok)).where("t IS NOT NULL")


def posting_lists(docs: DataFrame, id_col: str = "doc_id", tok: str = "tok") -> DataFrame:
    """The text map of each document: one row a word, its positions in order."""
    return postings(docs, id_col, tok).groupBy(id_col, "w").agg(F.sort_array(F.collect_list(F.struct("c", "t", "p"))).alias("at"))
