"""Texts, pages and rules from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.functions.tokens import let
from crivo.operators.rules import RULE_SCHEMA, Rule, rule_of

PAGE_MARK = "<<pg>>"
# --- fixed values: abbreviations after which a line goes on although it ends in a dot ----------------
ABBREVIATIONS = (
    r"sra?s?|exm[ao]s?|ns?|nos?|doc|ac|publ?|ex|lv|vlr?|vls?|exmo\(a\)|ilmo\(a\)|av|of|min|livr?|co?ls?|univ|resp|cli|lb|dra?s?|"
    r"[a-z]+r\(as?\)|ed|pa?g|cod|prof|op|plan|edf?|func|ch|arts?|artigs?|artg|pars?|rel|tel|res|[a-z]|gab|bel|ilm[oa]|parc|proc|"
    r"adv|vols?|cels?|pp|ex[ao]|eg|pl|ref|reg|f[ilí]s?|inc|par|alin|fts|v. em|v.rev|des|des\(a\)|desemb"
)
#: A character for private use that stands for the end of a paragraph.
STOP = "\uf8fe"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files: UTF-8, and where that fails Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def write_texts(texts: DataFrame, path: str, text_col: str = "text", append: bool = False) -> None:
    texts.select(F.col(text_col).alias("value")).write.mode("append" if append else "overwrite").text(path)


def split_pages(text: Column) -> Column:
    """Pages of a text that holds page marks after its start; otherwise the text as one page."""
    return F.when(F.instr(text, PAGE_MARK) > 1, F.split(text, PAGE_MARK, -1)).otherwise(F.array(text))


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """(path, pages, error) of PDF and text files; one of pages and error is null.

    ``parse`` gives the pages of a PDF's bytes and runs in the tasks, a file at a time: bring a library of
    your own.  A file called .pdf that doesn't hold one is ``not a pdf``; what the parser raises is
    ``extraction failed``; both are rows, so one bad file doesn't end the job.  Other files are texts.  Files
    without a byte have no row: Spark's file sources leave them out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # The mark may stand anywhere in the first 1024 bytes.
    holds = F.instr(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "%PDF-") > 0
    named = F.lower("path").endswith(".pdf")
    utf8 = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    plain = files.where(~holds).select("path", F.when(~named, split_pages(utf8)).alias("pages"), F.when(named, F.lit("not a pdf")).alias("error"))
    held = files.where(holds)
    if parse is None:
        return plain.unionByName(held.select("path", F.lit(None).cast("array<string>").alias("pages"), F.lit("no parser for pdf files").alias("error")))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = name, [x or "" for x in parse(bytes(content))], None
                except Exception as error:  # whatever the given parser raises belongs to its file
                    row = name, None, f"extraction failed: {error}"
                yield pd.DataFrame([row], columns=["path", "pages", "error"])

    return plain.unionByName(held.mapInPandas(run, "path string, pages array<string>, error string"))


def turns_as_pages(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One paged document for each id, its pages in order."""
    ordered = F.sort_array(F.collect_list(F.struct(order_col, text_col)))
    return turns.groupBy(id_col).agg(F.transform(ordered, lambda x: x[text_col]).alias("pages"))


def rejoin_lines(text: Column) -> Column:
    """Lines that were broken inside a sentence are one paragraph again.

    A line goes on in the next one unless it ends with a full stop, a question or an exclamation mark; it
    does go on after a known abbreviation.  A paragraph's lines are joined by spaces without the white
    space at their ends, blank ones left out; its last line stays as it is.
    """
    bare = lambda x: F.regexp_replace(x, STOP, "")

    def marked(line: Column) -> Column:
        ends = line.rlike(r"[.?!]\s*$") & ~line.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{ABBREVIATIONS})\.\s*$")
        return F.concat(bare(line), F.when(ends, F.lit(STOP)).otherwise(F.lit("\n")))

    def paragraph(part: Column) -> Column:
        """Lines that all end in a line feed, but for the last of a part that a mark has ended."""

        def joined(lines: Column) -> Column:
            last = F.element_at(lines, -1)
            before = F.filter(F.slice(lines, 1, F.size(lines) - 1), lambda x: x.rlike(r"\S"))
            start = F.regexp_replace(F.array_join(F.transform(before, lambda x: F.regexp_replace(x, r"\s+$", "")), " "), r"^\s+", "")
            return F.when(F.size(lines) == 1, last).otherwise(F.concat(start, F.lit(" "), last))

        return let(F.split(part, "\n", -1), joined)

    lines = F.array_join(F.transform(F.split(text, "\n", -1), marked), "")
    # The last line has a mark of its own, whichever it is.
    parts = F.split(F.substring(lines, F.lit(1), F.length(lines) - 1), STOP, -1)
    return F.array_join(F.transform(parts, paragraph), "\n")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON file: a list, or an object that holds one under ``regras``."""
    table = spark.read.option("multiLine", True).json(path)
    if "regras" in table.columns:
        table = table.select(F.explode("regras").alias("r")).select("r.*")
    return [rule_of({k: v for k, v in r.asDict(recursive=True).items() if v is not None}) for r in table.collect()]


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(n, label, text, criterion) of a JSON file that holds a list under ``exemplos``.

    Entries with neither text nor criterion are left out; ``n`` is the place in the file's list.
    """
    schema = "exemplos array<struct<texto: string, criterios: string>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("exemplos").alias("n", "e"))
    text, criterion = F.col("e.texto"), F.col("e.criterios")
    kept = found.where((F.coalesce(text, F.lit("")) != "") | (F.coalesce(criterion, F.lit("")) != ""))
    return kept.select("n", F.concat(F.substring(F.coalesce(text, F.lit("")), 1, 15), F.lit("...")).alias("label"), text.alias("text"), criterion.alias("criterion"))


__all__ = ["PAGE_MARK", "RULE_SCHEMA", "read_examples", "read_pages", "read_rules", "read_texts", "rejoin_lines", "split_pages", "turns_as_pages", "write_texts"]
