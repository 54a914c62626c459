"""One criterion on many documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.normalize import is_blank, light
from crivo.functions.patterns import compiled, regex_error, route
from crivo.functions.tokens import let, token_array, where_once
from crivo.operators.rewrite import Directives, rewritten, split_directives
from crivo.operators.spans import SPAN, extract, highlight
from crivo.plans.arrays import matches, positions, prefilter
from crivo.plans.parser import parse
from crivo.plans.syntax import Blank, CriterionError, Node, and_or_not, canonical


@dataclass(frozen=True)
class Criterion:
    """A compiled criterion: compile once, use on any number of documents."""

    kind: str
    body: str
    directives: Directives
    node: Node | None = None
    error: str | None = None
    synonyms: Mapping[str, Sequence[str]] | None = None
    macros: Mapping[str, str] | None = None

    @property
    def canonical(self) -> str:
        return canonical(self.node) if self.node is not None else self.body

    @property
    def and_or_not(self) -> str:
        return and_or_not(self.node) if self.node is not None else ""

    def on(self, document: Column, kind: T.DataType) -> Column:
        """Whether a document matches: null where the criterion has an error, false where it is empty."""
        if self.error:
            return F.lit(None).cast("boolean")
        text = rewritten(document, kind, self.directives)
        if self.kind != "dsl":
            return self.on_light(lightened(text, kind), kind)
        if isinstance(self.node, Blank):
            return every_part(text, kind, is_blank)
        return self.on_tokens(token_array(text, kind))

    @property
    def pattern(self) -> str:
        """The Java pattern of a regex or LIKE criterion."""
        return compiled(f"{'l' if self.kind == 'like' else 'r'}:{self.body}", dict(self.macros or {}))

    def on_light(self, text: Column, kind: T.DataType) -> Column:
        """A regex or LIKE criterion on a document that is lightly normalised already."""
        return any_part(text, kind, lambda x: x.rlike(self.pattern))

    def on_tokens(self, tok: Column) -> Column:
        return F.lit(False) if self.node is None else let(tok, lambda x: matches(self.node, x, self.synonyms))

    def maybe_on_tokens(self, tok: Column) -> Column:
        """A cheaper condition that holds wherever the criterion matches."""
        found = prefilter(self.node, tok, self.synonyms)
        return F.lit(True) if found is None else found


def lightened(document: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(document, light)
    if isinstance(kind, T.MapType):
        return F.transform_values(document, lambda _, x: light(x))
    return light(document)


def any_part(document: Column, kind: T.DataType, test) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(document, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(document), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    return F.coalesce(test(document), F.lit(False))


def every_part(document: Column, kind: T.DataType, test) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(document, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(document), lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True))
    return F.coalesce(test(document), F.lit(True))


def compile_criterion(text: str, synonyms: Mapping[str, Sequence[str]] | None = None, equivalents: Mapping[str, Sequence[str]] | None = None, macros: Mapping[str, str] | None = None, spark=None, try_pattern: bool = True) -> Criterion:
    """Compile; what is wrong with the text goes into ``error``.

    Patterns are tried on ``spark``, by default the active session; without any, or where the caller tries
    them itself, they are taken as they are.
    """
    spark = spark or SparkSession.getActiveSession()
    try:
        directives = split_directives(text)
    except CriterionError as error:
        return Criterion("dsl", text, Directives(text), error=str(error))
    kind, body = route(directives.criterion)
    if kind != "dsl":
        made = Criterion(kind, body, directives, macros=macros)
        return replace(made, error=regex_error(spark, made.pattern)) if spark is not None and try_pattern else made
    try:
        return Criterion(kind, body, directives, parse(body, equivalents), synonyms=synonyms)
    except CriterionError as error:
        return Criterion(kind, body, directives, error=str(error))


def evaluate(docs: DataFrame, criterion: Criterion | str, document: str = "text", detail: bool = False, with_spans: bool = False, mark: bool = False, name: str = "matched") -> DataFrame:
    """``docs`` with the criterion's result, and on demand details, spans and marked text."""
    c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
    kind = docs.schema[document].dataType
    out = docs.withColumn(name, c.on(F.col(document), kind))
    if with_spans:
        spans = extract(rewritten(F.col(document), kind, c.directives), kind, f"{'l' if c.kind == 'like' else 'r'}:{c.body}", dict(c.macros or {})) if c.kind != "dsl" and not c.error else F.array().cast(SPAN)
        out = out.withColumn("spans", spans)
    if detail:
        out = out.withColumns({"error": F.lit(c.error).cast("string"), "canonical": F.lit(c.canonical), "and_or_not": F.lit(c.and_or_not), "directives": F.lit(c.directives.shown), "processed": rewritten(F.col(document), kind, c.directives)})
    if mark:
        if c.kind == "dsl" and c.node is not None:
            out = highlight(out, c.body, document, synonyms=c.synonyms)
        else:
            out = out.withColumn("highlighted", F.col(document))
    return out


def matching(docs: DataFrame, criterion: Criterion | str, document: str = "text") -> DataFrame:
    """The documents that match, with the cheap condition on words tried first."""
    c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
    kind = docs.schema[document].dataType
    if c.kind != "dsl" or c.node is None or isinstance(c.node, Blank) or c.error:
        return docs.where(c.on(F.col(document), kind))
    tok = token_array(rewritten(F.col(document), kind, c.directives), kind)
    return where_once(docs, let(tok, lambda x: F.when(c.maybe_on_tokens(x), matches(c.node, x, c.synonyms)).otherwise(F.lit(False))))


def parts_of(node: Node) -> list[Node]:
    """The sub-expressions of a tree, operands before what joins them, itself last."""
    below = [getattr(node, name) for name in ("left", "right", "of") if hasattr(node, name)]
    return [*(x for n in below for x in parts_of(n)), node]


def trace(docs: DataFrame, criterion: Criterion | str, document: str = "text", name: str = "trace") -> DataFrame:
    """``docs`` with each sub-expression of the criterion and the number of positions that it has."""
    c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
    kind = docs.schema[document].dataType
    parts = parts_of(c.node) if c.node is not None and not c.error else []
    if not parts:
        return docs.withColumn(name, F.array().cast("array<struct<part:string,n_positions:int>>"))
    tok = token_array(rewritten(F.col(document), kind, c.directives), kind)
    return docs.withColumn(name, let(tok, lambda x: F.array(*[F.struct(F.lit(canonical(n)).alias("part"), F.size(positions(n, x, c.synonyms)).alias("n_positions")) for n in parts])))
