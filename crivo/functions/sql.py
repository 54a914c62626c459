"""The normaliser as a function of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from crivo.functions.normalize import BREAK, COMBINING, NOT_PLURAL, PLURAL_ENDINGS, PLURAL_EXCEPTIONS, PLURAL_KEPT_VOWEL, QUOTES, SECTION_WORD, fold_table
from crivo.functions.tokens import WORDS


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def full_sql(text: str) -> str:
    """``normalize.full`` as an expression of SQL."""
    source, target = fold_table()
    x = f"lower(regexp_replace(translate({text}, {literal(source)}, {literal(target)}), {literal(COMBINING)}, ''))"
    x = f"replace(replace({x}, '<br>', '\\n'), '§', {literal(SECTION_WORD)})"
    x = f"translate(translate({x}, '{{[}}]', '(())'), {literal(QUOTES)}, {literal('"' * len(QUOTES))})"
    x = f"regexp_replace(regexp_replace({x}, '([0-9])[.,]+([0-9])', '$1$2'), '([0-9])[.,]+ ', '$1 ')"
    return f"regexp_replace({x}, {literal(BREAK)}, '\\n')"


def singular_sql(word: str) -> str:
    """``normalize.singular`` as an expression of SQL."""
    kept = ", ".join(literal(x) for x in PLURAL_EXCEPTIONS)
    endings = "".join(f" WHEN {word} RLIKE {literal(e)} THEN regexp_replace({word}, {literal(e)}, {literal(i.replace(chr(92), '$'))})" for e, i in PLURAL_ENDINGS)
    return f"CASE WHEN NOT endswith({word}, 's') OR {word} IN ({kept}) OR {word} RLIKE {literal(NOT_PLURAL)} OR NOT {word} RLIKE '[aeiou]' THEN {word} WHEN {word} RLIKE {literal(PLURAL_KEPT_VOWEL)} THEN regexp_replace({word}, 's$', ''){endings} ELSE {word} END"


def register_normaliser(spark: SparkSession, name: str = "normalised") -> None:
    """A function name(text, with_br) for this session's SQL: the words of a text in the singular and its line
    feeds, which are ``<br>`` if asked for, separated by spaces."""
    words = f"transform(regexp_extract_all({full_sql('text')}, {literal(WORDS + '|' + chr(10))}, 0), w -> {singular_sql('w')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, with_br BOOLEAN) RETURNS STRING RETURN array_join(transform({words}, w -> if(with_br AND w = '\\n', '<br>', w)), ' ')")
