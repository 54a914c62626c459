"""A criterion as a Column over the token array of a document: many criteria, one pass over the documents.

Every sub-expression is an array of positions; a document matches if the last one isn't empty.  Operands
are bound once (``let``) before a lambda uses them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from crivo.functions.scan import running_max
from crivo.functions.tokens import TOKEN, let, unique_words
from crivo.plans.syntax import Absent, Binary, Blank, Compare, Node, Scope, Term, weaker


def nothing() -> Column:
    return F.array().cast(TOKEN)


def truth() -> Column:
    return F.array(F.struct(F.lit("").alias("w"), F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit("").alias("c"))).cast(TOKEN)


def spellings(term: Term, synonyms: Mapping[str, Sequence[str]]) -> list[str]:
    return [term.word] if term.quoted else [term.word, *synonyms.get(term.word, ())]


def wild_pattern(word: str) -> str:
    """Wildcards as a regular expression, searched anywhere in a word."""
    return word.replace("$", ".*").replace("?", ".?")


def word_matches(w: Column, term: Term, synonyms: Mapping[str, Sequence[str]]) -> Column:
    if term.wild:
        return w.rlike(wild_pattern(term.word)) if term.word.strip("$?") else F.lit(False)
    return w.isin(*spellings(term, synonyms))


def reach(name: str, number: int) -> tuple[bool, str | None, int, bool]:
    """What two positions must share and how far apart they may be: (paragraph too, what is counted, how many, either way)."""
    both = name.startswith("PROX")
    if name == "COM":
        return False, "p", max(number - 1, 0), both
    paragraph = name in ("ADJC", "PROXC")
    return (paragraph, None, 0, both) if name == "MESMO" or number == 0 else (paragraph, "t", number, both)


def near(paragraph: bool, counted: str | None, most: int | Column, both: bool, a: Column, b: Column) -> Column:
    """The positions of ``b`` that stand at most so far behind one of ``a``; with ``both`` of either, on either side.

    Both are sorted into one array, where the nearest of the other operand is the last one before or the
    next one after; a running maximum of places finds it.
    """

    def placed(x: Column, side: int) -> Column:
        group = x["p"] if paragraph else F.lit(0)
        order = x[counted] if counted else F.lit(0)
        return F.struct(x["c"].alias("c"), group.alias("g"), order.alias("o"), F.lit(side).alias("side"), x["t"].alias("t"), x["p"].alias("p"), x["w"].alias("w"))

    def latest(z: Column, side: int) -> Column:
        return running_max(F.transform(z, lambda x, i: F.when(x["side"] == side, i)))

    def fits(z: Column, x: Column, at: Column) -> Column:
        other = F.get(z, at)
        return F.coalesce((other["c"] == x["c"]) & (other["g"] == x["g"]) & (F.abs(other["o"] - x["o"]) <= most), F.lit(False))

    def found(z: Column) -> Column:
        ways = [z["up"], z["down"]] if both else [z["up"]]
        last = {k: F.struct(*[latest(way, side).alias(f"s{side}") for side in ((0, 1) if both else (0,))]).alias(f"w{k}") for k, way in enumerate(ways)}

        def kept(y: Column) -> Column:
            def test(x: Column, i: Column) -> Column:
                places = (i, F.size(ways[0]) - 1 - i)
                behind = lambda side: F.greatest(*[fits(way, x, F.get(y[f"w{k}"][f"s{side}"], places[k])) for k, way in enumerate(ways)], F.lit(False))
                return F.when(x["side"] == 1, behind(0)).otherwise(behind(1) if both else F.lit(False))

            return F.filter(ways[0], test)

        return let(F.struct(*last.values()), kept)

    up = F.sort_array(F.concat(F.transform(a, lambda x: placed(x, 0)), F.transform(b, lambda x: placed(x, 1))))
    ways = let(up, lambda z: F.struct(z.alias("up"), *([F.reverse(z).alias("down")] if both else [])))
    rows = F.transform(let(ways, found), lambda x: F.struct(x["w"].alias("w"), x["t"].alias("t"), x["p"].alias("p"), x["c"].alias("c")))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), rows).otherwise(nothing())


def compares(w: Column, sign: str, value: str) -> Column:
    if sign == "=":
        return w == value
    if value.isdigit():
        left, right = F.when(w.rlike("^[0-9]{1,38}$"), w.cast("decimal(38,0)")), F.lit(value).cast("decimal(38,0)")
    else:
        left, right = F.when(~w.rlike("^[0-9]+$"), w), F.lit(value)
    return F.coalesce({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "<>": left != right}[sign], F.lit(False))


def positions(node: Node | None, tok: Column, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    synonyms = synonyms or {}

    def of(n: Node) -> Column:
        match n:
            case Term():
                return F.filter(tok, lambda x: word_matches(x["w"], n, synonyms))
            case Scope():
                return F.filter(of(n.of), lambda x: x["c"] == n.field)
            case Compare():
                return F.when(F.exists(tok, lambda x: (x["c"] == n.field) & compares(x["w"], n.sign, n.value)), truth()).otherwise(nothing())
            case Absent():
                return F.when(F.size(of(n.of)) == 0, truth()).otherwise(nothing())
            case Blank():
                return F.when(F.size(tok) == 0, truth()).otherwise(nothing())
            case Binary():
                pair = F.struct(of(n.left).alias("a"), of(n.right).alias("b"))
                return let(pair, lambda z: combine(n, z["a"], z["b"]))
        raise TypeError(n)

    return nothing() if node is None else of(node)


def combine(n: Binary, a: Column, b: Column) -> Column:
    if n.name == "E":
        return F.when(F.size(a) > 0, b).otherwise(nothing())
    if n.name == "OU":
        return F.concat(a, b)
    if n.name == "NAO":
        return F.when((F.size(a) > 0) & (F.size(b) == 0), truth()).otherwise(nothing())
    return near(*reach(n.name, n.number), a, b)


def matches(node: Node | None, tok: Column, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    return F.size(positions(node, tok, synonyms)) > 0


def prefilter(node: Node | None, tok: Column, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column | None:
    """A cheap necessary condition on the distinct words; None if there is none."""
    synonyms = synonyms or {}
    weak = weaker(node) if node is not None else None

    def build(n: Node, names: Column) -> Column:
        if isinstance(n, Term):
            if n.wild:
                longest = max(re.split(r"[$?]", n.word), key=len)
                return F.exists(names, lambda w: w.contains(longest))
            return F.arrays_overlap(names, F.array(*[F.lit(w) for w in spellings(n, synonyms)]))
        left, right = build(n.left, names), build(n.right, names)
        return left | right if n.name == "OU" else left & right

    return None if weak is None else let(unique_words(tok), lambda names: build(weak, names))
