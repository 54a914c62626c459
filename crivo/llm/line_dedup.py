"""Line dedup by site-relative frequency: lines that stand on too many of a host's pages are dropped.

A line's ratio is the number of the host's pages that hold it (once or more) over the number of the
host's pages.  Lines above ``ratio`` that stand on ``min_held`` pages or more are boilerplate: on a small
host one page, or a page and its copy, is already a large part.  Lines are compared without surrounding
white space; blank lines are kept as they are and counted nowhere.

Counting takes one row for each distinct line of a page, summed on the scan's side first.  A host has at
most (lines a page / ratio) boilerplate lines, whatever its size, so they fit in one array a host, and
pages meet that array in a join by host.  That join is always shuffled and left to Spark's skew handling,
which reads the pages of a large host in as many tasks as its size asks for.

Defined cases: a null text stays null and has no lines; a null host is a host of its own; rows that
repeat are pages each; a page that loses all lines keeps an empty text; an empty table gives an empty
result; columns of any names are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm._common import cut, free_name

RATIO = 0.1
MIN_HELD = 3
#: White space: what is trimmed off lines, and what blank lines consist of.
BLANKS = " \t\n\x0b\x0c\r"
#: Elements that end a line of text, and entities that stand for one character (fixed values).
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """Lower-cased host of an address, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def one_of(words: list[str]) -> str:
    """A pattern of the words that tells them apart letter by letter instead of trying one after another."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    ways = [letter + one_of(rest) for letter, rest in by.items() if letter]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)}){'?' if '' in by else ''}" if len(ways) > 1 or "" in by else ways[0]


def html_lines(html: Column) -> Column:
    """Text of a page, one line a block element: without scripts, styles, comments and tags."""
    # Every pattern starts with one character, which an engine looks for much faster than for alternatives.
    text = F.regexp_replace(html, r"(?is)<(?:(?:script|style)\b.*?</(?:script|style)\s*>|!--.*?-->)", "")
    text = F.regexp_replace(text, rf"(?i)</?{one_of(BLOCKS.split('|'))}\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def boilerplate(pages: DataFrame, text: str, ratio: float, min_held: int) -> DataFrame:
    """(host_key, boilerplate): hashes of the lines above the ratio, for hosts that have any."""
    totals = pages.groupBy("host_key").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n", -1), lambda x: ~is_blank(x)), line_key))
    held = pages.select("host_key", F.explode(lines).alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= min_held)
    return held.join(totals, "host_key").where(F.col("held") > ratio * F.col("pages")).groupBy("host_key").agg(F.sort_array(F.collect_list("line")).alias("boilerplate"))


def drop_site_lines(pages: DataFrame, host: Column, text_col: str, ratio: float = RATIO, min_held: int = MIN_HELD, counts: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``.

    With ``counts`` two columns follow: n_lines (lines that aren't blank) and n_dropped.
    """
    named = {c: f"in_{k}" for k, c in enumerate(pages.columns)}
    rows = pages.select(host.cast("string").alias("host"), *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    rows = rows.withColumn("host_key", F.concat(F.when(F.col("host").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("host", F.lit(""))))
    text = named[text_col]
    # A written table is shuffled for the join, and only a join between two shuffles is split where it is skewed.
    found = cut(boilerplate(rows.select("host_key", F.col(text)), text, ratio, min_held), "boilerplate")
    met = rows.hint("merge").join(found, "host_key", "left")
    lines = F.split(F.col(text), "\n", -1)
    known = lambda x: F.array_contains(F.col("boilerplate"), line_key(x))
    none = F.col("boilerplate").isNull() | F.col(text).isNull()
    kept = F.filter(lines, lambda x: is_blank(x) | ~known(x))
    out = met.withColumn("kept", F.when(~none, kept)).withColumn("n_lines", F.coalesce(F.size(F.filter(lines, lambda x: ~is_blank(x))), F.lit(0)).cast("long") if counts else F.lit(0))
    clean = F.when(none, F.col(text)).otherwise(F.array_join("kept", "\n"))
    columns = [(clean if c == text_col else F.col(n)).alias(c) for c, n in named.items()]
    if counts:
        dropped = F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("long")
        columns += [F.col("n_lines").alias(free_name(pages, "n_lines")), dropped.alias(free_name(pages, "n_dropped"))]
    return out.select(*columns)


def page_line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_held: int = MIN_HELD) -> DataFrame:
    """One row a web page: id, host, text (lines left), n_lines, n_dropped."""
    plain = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("text"))
    return drop_site_lines(plain, F.col("host"), "text", ratio, min_held)
