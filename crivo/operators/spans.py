"""Spans of matches in a text and their highlighting.

A span is struct<start, end, text, page, field>: character offsets in its page or field, the end
exclusive; page counts from 1 and is null for other documents, field likewise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.normalize import BREAK, aligned, in_step, light
from crivo.functions.patterns import compiled
from crivo.functions.scan import blocks, piece, running_max, running_sums
from crivo.functions.tokens import let
from crivo.plans.parser import parse
from crivo.plans.syntax import words_of

SPAN = "array<struct<start:int,end:int,text:string,page:int,field:string>>"
PLACES = "array<struct<start:int,end:int>>"
#: Characters for private use that stand around matches; a text's own count as unknown characters.
OPEN, CLOSE, STAND_IN = "\uf8fe", "\uf8ff", "\ufffd"


def offsets(text: Column, pattern: str) -> Column:
    """(start, end) of the matches in order, empty ones too: every match is put between two marks, and the
    lengths of what lies between marks are summed."""
    plain = F.translate(text, OPEN + CLOSE, STAND_IN * 2)
    marked = F.regexp_replace(plain, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    sizes = F.transform(F.split(marked, f"[{OPEN}{CLOSE}]", -1), F.length)

    def paired(at: Column) -> Column:
        found = F.filter(F.transform(at, lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("start"), F.get(at, i + 1).alias("end")))), lambda s: s["end"].isNotNull())
        return F.when(F.size(at) > 1, found).otherwise(F.array().cast(PLACES))

    return let(let(sizes, lambda n: F.when(F.size(n) > 1, running_sums(n)).otherwise(n)), paired)


def spans_of_text(text: Column, pattern: str, page: Column | None = None, field: Column | None = None) -> Column:
    """Spans of a pattern: found on the folded text, their text taken from the original."""

    def taken(z: Column) -> Column:
        return F.transform(
            z["at"],
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), piece(z["parts"], s["start"], s["end"]).alias("text"), (F.lit(None).cast("int") if page is None else page.cast("int")).alias("page"), (F.lit(None).cast("string") if field is None else field).alias("field")),
        )

    return let(F.struct(offsets(light(text), pattern).alias("at"), blocks(in_step(text)).alias("parts")), taken)


def extract(document: Column, kind: T.DataType, criterion: str, macros: dict[str, str] | None = None) -> Column:
    """All spans of a regex or LIKE criterion in a plain, paged or fielded document."""
    pattern = compiled(criterion, macros)
    if isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(document, lambda x, k: spans_of_text(F.coalesce(x, F.lit("")), pattern, page=k + 1)))
    elif isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_entries(document), lambda e: spans_of_text(F.coalesce(e["value"], F.lit("")), pattern, field=e["key"])))
    else:
        found = spans_of_text(F.coalesce(document, F.lit("")), pattern)
    return F.coalesce(found.cast(SPAN), F.array().cast(SPAN))


def with_meta(meta: Column):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), meta.alias("meta"))


def extract_many(text: Column, criteria: Sequence[Mapping[str, str]], key: str = "regex", drop: Sequence[str] = ()) -> Column:
    """Spans of several criteria, each with its criterion's other keys as a map, sorted by their start."""
    parts = []
    for c in criteria:
        meta = [F.lit(x) for k, v in c.items() if k != key and k not in drop for x in (k, str(v))]
        labels = F.create_map(*meta) if meta else F.create_map().cast("map<string,string>")
        parts.append(F.transform(spans_of_text(text, compiled("r:" + c[key])), with_meta(F.to_json(labels))))
    return F.sort_array(F.flatten(F.array(*parts)))


def merged(spans: Column) -> Column:
    """(start, end) of spans in order, with overlapping and touching ones made one."""

    def joined(z: Column) -> Column:
        at, upto = z["at"], z["upto"]
        # A span begins where the earlier ones have all ended, and ends where the next one begins.
        firsts = F.filter(F.transform(at, lambda s, i: F.when((i == 0) | (s["start"] > F.get(upto, i - 1)), s["start"])), lambda x: x.isNotNull())
        lasts = F.filter(F.transform(upto, lambda e, i: F.when((i == F.size(upto) - 1) | (F.get(at, i + 1)["start"] > e), e)), lambda x: x.isNotNull())
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    plain = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    ends = let(plain, lambda at: F.struct(at.alias("at"), running_max(F.transform(at, lambda s: s["end"])).alias("upto")))
    return let(ends, joined)


def between(parts: Column, spans: Column, size: Column, inside) -> Column:
    """The pieces of a text in blocks around sorted spans that don't overlap, joined by what ``inside`` makes of each span."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(piece(parts, before(i), s["start"]), inside(s)))
    return F.concat(F.array_join(pieces, ""), piece(parts, before(F.size(spans)), size))


def spliced(text: Column, spans: Column, before: str, after: str) -> Column:
    """``text`` with marks around sorted spans that don't overlap."""
    bound = F.struct(spans.alias("at"), blocks(text).alias("parts"), F.length(text).alias("size"))
    return let(bound, lambda z: between(z["parts"], z["at"], z["size"], lambda s: F.concat(F.lit(before), piece(z["parts"], s["start"], s["end"]), F.lit(after))))


def highlight_spans(text: Column, spans: Column, before: str = "<mark>", after: str = "</mark>", line_break: str = "<br>") -> Column:
    return F.replace(spliced(in_step(text), merged(spans), before, after), F.lit("\n"), F.lit(line_break))


def highlight_extractions(docs: DataFrame, criterion: str, document: str = "text", name: str = "highlighted", macros: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the spans of a regex or LIKE criterion marked in each page or field, in the document's shape."""
    pattern, kind, column = compiled(criterion, macros), docs.schema[document].dataType, F.col(document)

    def one(x: Column) -> Column:
        return highlight_spans(x, spans_of_text(x, pattern))

    if isinstance(kind, T.ArrayType):
        return docs.withColumn(name, F.transform(column, one))
    if isinstance(kind, T.MapType):
        return docs.withColumn(name, F.transform_values(column, lambda _, x: one(x)))
    return docs.withColumn(name, one(column))


def term_pattern(term: str) -> str:
    """Where a normalised term stands in aligned text; digits and letters bound one another."""
    body = term.strip()
    edge = "[a-z \\n]" if term[:1].isdigit() and term[-1:].isdigit() else "[0-9 \\n]"
    if edge.startswith("[a"):
        body = "".join(c if k == 0 or not (body[k - 1].isdigit() and c.isdigit()) else f"_*{c}" for k, c in enumerate(body))
    body = body.replace(" ", "[ ~]*").replace("?", "[a-z0-9]{0,1}").replace("$", "[a-z0-9]*")
    return f"(?<={edge})~*{body}~*(?={edge})"


def highlight_terms(text: Column, terms: Sequence[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Mark normalised terms, the words of a phrase as one."""
    spaced = F.concat(F.lit(" "), F.translate(F.regexp_replace(text, BREAK, "\n"), "\r", "\n"), F.lit(" "))
    if not terms:
        return text
    marked = let(
        F.struct(spaced.alias("x"), aligned(spaced).alias("y")),
        lambda z: let(merged(F.flatten(F.array(*[offsets(z["y"], term_pattern(t)) for t in terms]))), lambda s: F.trim(spliced(z["x"], s, before, after))),
    )
    return F.when((text == "") | text.isNull(), text).otherwise(marked)


def criterion_terms(criterion: str, synonyms: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Terms to mark for a criterion: words and, for those without wildcards or quotes, their synonyms;
    quoted words that follow one another are one phrase; negated terms are marked too."""
    out: list[str] = []
    phrase: list[str] = []
    node = parse(criterion)
    for term in words_of(node) if node is not None else []:
        if term.quoted:
            phrase.append(term.word)
            continue
        if phrase:
            out.append(" ".join(phrase))
            phrase = []
        out += [term.word, *((synonyms or {}).get(term.word, ()) if not term.wild else ())]
    if phrase:
        out.append(" ".join(phrase))
    return list(dict.fromkeys(x for t in out for x in ([t, "§"] if t == "paragrafo" else [t])))


def highlight(docs: DataFrame, criterion: str, document: str = "text", name: str = "highlighted", synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``docs`` with the terms of a criterion marked, in the shape of the document."""
    terms = criterion_terms(criterion, synonyms)
    kind, column = docs.schema[document].dataType, F.col(document)
    if isinstance(kind, T.ArrayType):
        return docs.withColumn(name, F.transform(column, lambda x: highlight_terms(x, terms)))
    if isinstance(kind, T.MapType):
        return docs.withColumn(name, F.transform_values(column, lambda _, x: highlight_terms(x, terms)))
    return docs.withColumn(name, highlight_terms(column, terms))
