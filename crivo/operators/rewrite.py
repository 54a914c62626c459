"""Directives that change a text before it is matched: remover(...), remover(aspas), recortar(start;end).

Patterns are found on lightly normalised text and cut out of the original at the same offsets, so both
stay in step.  Order: quotes, then all crops (each on the same text, results joined by line feeds), then
the removals one after another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions.normalize import in_step, light, light_text, remove_quoted, unify_quotes
from crivo.functions.patterns import FLAGS
from crivo.functions.scan import blocks, piece
from crivo.functions.tokens import let
from crivo.operators.spans import between, offsets
from crivo.plans.syntax import CriterionError

# --- fixed values: the directives and what the signs in their bodies stand for -----------------------
DIRECTIVE = re.compile(r"\b(remover|recortar)\(([^)]*)\)", re.IGNORECASE)
BRACKETS = r'["\[\]\(\){}\|]'
LETTER, OTHER = "[a-z0-9]", "[^a-z0-9]{1,10}"
#: What each wildcard of a removal stands for; runs of asterisks reach a hundred characters each.
WILDCARDS = {"*%": '[^"]{1,100}' + BRACKETS, "*##": r"..{0,100}[^\r\n]", "*#": f"{LETTER}.{{0,100}}{OTHER}", "*": ".{0,100}", "%": BRACKETS, "?": f"{LETTER}?", "&": LETTER, "#": OTHER}


@dataclass(frozen=True)
class Directives:
    """What a criterion asks to be done to texts, and the criterion without that."""

    criterion: str
    quotes: bool = False
    removals: tuple[str, ...] = ()
    crops: tuple[tuple[str, str], ...] = ()
    shown: str = field(default="", compare=False)

    @property
    def any(self) -> bool:
        return bool(self.quotes or self.removals or self.crops)


def split_directives(criterion: str) -> Directives:
    quotes, removals, crops, shown = False, [], [], []
    for m in DIRECTIVE.finditer(criterion):
        shown.append(m.group())
        body = light_text(m[2])
        if m[1].lower() == "remover":
            if body.strip() == "aspas":
                quotes = True
            elif body.strip():
                removals.append(removal_pattern(body))
        else:
            start, _, end = body.partition(";")
            crops.append((start.strip(" "), end.strip(" ")))
    rest = re.sub(r"\s+", " ", DIRECTIVE.sub(" ", criterion)).strip() if shown else criterion
    return Directives(rest, quotes, tuple(removals), tuple(crops), " ".join(shown))


def removal_pattern(body: str) -> str:
    """The Java pattern of a removal."""
    body = re.sub(r"[\\|]", " ", body).replace("$", "*")

    def one(m: re.Match) -> str:
        piece = m.group()
        if piece in WILDCARDS:
            return WILDCARDS[piece]
        if piece[0] == "*":
            return f'[^"]{{1,{min(len(piece), 10)}00}}'
        return "\\" + piece

    pattern = re.sub(r"\*{2,}|\*%|\*##|\*#|[*%?&#]|[\[\].\-^(]", one, body)
    try:
        re.compile(pattern)
    except re.error as error:
        raise CriterionError(f"remover({body}): {error}") from None
    return pattern


def removed(text: Column, pattern: str) -> Column:
    """``text`` with every match of the pattern (found on the folded text) turned into a space."""
    bound = lambda x: F.struct(offsets(light(x), FLAGS + pattern).alias("at"), blocks(x).alias("parts"), F.length(x).alias("size"))
    return let(in_step(text), lambda x: let(bound(x), lambda z: F.trim(between(z["parts"], z["at"], z["size"], lambda _: F.lit(" ")))))


def delimiter(raw: str) -> tuple[str, bool]:
    """(pattern, whether the delimiter is optional)."""
    optional = raw.endswith("?")
    clean = re.sub(r"[^a-z0-9._\-#$ ]", "", raw[:-1] if optional else raw)
    return "".join({"#": r"(?:^|$|\n|\r)", "$": r"(?:\b|$|^)"}.get(c, c) for c in clean), optional


def cropped(text: Column, start: str, end: str) -> Column:
    """The stretches from ``start`` to ``end``, both included, joined by line feeds."""
    if not start and not end:
        return text
    text = in_step(text)
    first, start_optional = delimiter(start)
    last, end_optional = delimiter(end)
    at = lambda x, p: F.regexp_instr(light(x), F.lit(FLAGS + p))
    upto = lambda x: F.length(F.regexp_extract(light(x), f"(?s){FLAGS}^.*?(?:{last})", 0))
    has = lambda x, p: light(x).rlike(FLAGS + p)
    nothing = F.lit("")
    if not end:
        return let(text, lambda x: F.when(has(x, first), F.substring(x, at(x, first), F.length(x))).otherwise(x if start_optional else nothing))
    if not start:
        return let(text, lambda x: F.when(has(x, last), F.substring(x, F.lit(1), upto(x))).otherwise(x if end_optional else nothing))

    if not start_optional and not end_optional:
        # Looking ahead for the start lets the end be searched from the start's first character on.
        stretch = f"(?s)(?=(?:{first})).*?(?:{last})"
        found = lambda x: F.struct(offsets(light(x), FLAGS + stretch).alias("at"), blocks(x).alias("parts"))
        return let(text, lambda x: let(found(x), lambda z: F.array_join(F.transform(z["at"], lambda s: piece(z["parts"], s["start"], s["end"])), "\n")))

    def step(acc: Column, k: Column) -> Column:
        rest = acc["rest"]
        from_start = has(rest, first)
        head = F.when(from_start, F.substring(rest, at(rest, first), F.length(rest))).otherwise(rest if start_optional else nothing)

        def ended(z: Column) -> Column:
            found = has(z, last)
            piece = F.when(found, F.substring(z, F.lit(1), upto(z))).otherwise(z if end_optional else nothing)
            none = (k > 1) & ~from_start & ~found | (rest == "")
            after = F.when(found, F.substring(z, upto(z) + 1, F.length(z))).otherwise(nothing)
            return F.struct(F.when(none, nothing).otherwise(after).alias("rest"), F.when(none | (piece == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

        return let(head, ended)

    def run(x: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.size(F.regexp_extract_all(light(x), F.lit(FLAGS + last), 0)) + 1)
        return F.aggregate(rounds, F.struct(x.alias("rest"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], "\n"))

    return let(text, run)


def rewritten_text(text: Column, directives: Directives) -> Column:
    if directives.quotes:
        text = remove_quoted(unify_quotes(text))
    if directives.crops:
        base = text
        text = let(base, lambda x: F.array_join(F.filter(F.array(*[cropped(x, a, b) for a, b in directives.crops]), lambda p: p != ""), "\n"))
    for pattern in directives.removals:
        text = removed(text, pattern)
    return text


def rewritten(document: Column, kind: T.DataType, directives: Directives) -> Column:
    """A document of any shape, rewritten."""
    if not directives.any:
        return document
    if isinstance(kind, T.ArrayType):
        return F.transform(document, lambda x: rewritten_text(x, directives))
    if isinstance(kind, T.MapType):
        return F.transform_values(document, lambda _, x: rewritten_text(x, directives))
    return rewritten_text(document, directives)
