"""Text normalisation as Column expressions, with plain-string twins for criteria on the driver."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------
SECTION_WORD = " paragrafo "
QUOTES = "'\"´`“”"
BREAK = r"<\s*/?\s*[bB][rR]\s*/?\s*>"
COMBINING = "[̀-ͯ]"
#: Words that keep their final s.
PLURAL_EXCEPTIONS = tuple(
    "apos atlas atraves bs campones corpus cs depois dois ds fs gas gs hs ingles lapis manganes mes ms ns oculos onibus "
    "pancreas pires portugues rs sapiens sars seis simples ss tenis tes tres ts virus vs ws aspas".split()
)
#: Endings of plurals and what they become; the first that fits is used.
PLURAL_ENDINGS = (("(oes|aes)$", "ao"), ("ais$", "al"), ("eis$", "el"), ("ois$", "ol"), ("les$", "l"), ("res$", "r"), ("zes$", "z"), ("is$", "il"), ("ns$", "m"), ("([aeiou])s$", r"\1"))
PLURAL_KEPT_VOWEL = "^(lei|pai)s$"
#: A doubled character other than s and r, or a y or w, marks an acronym or a foreign word.
NOT_PLURAL = r"([^sr])\1|[yw]"
BLANK = " \n\t\r.,;:/?-_=+`´~^\"!@#$%¨&*\\<>()[]{}|'"


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks, and that character."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        character = chr(code)
        base = re.sub(COMBINING, "", unicodedata.normalize("NFD", character))
        if len(base) == 1 and base != character:
            source.append(character)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents; every precomposed letter stays one character."""
    source, target = fold_table()
    return F.lower(F.regexp_replace(F.translate(text, source, target), COMBINING, ""))


def fold_text(text: str) -> str:
    return re.sub(COMBINING, "", unicodedata.normalize("NFD", text)).lower()


def symbols(text: Column) -> Column:
    """Folded text with ``<br>`` as a line feed and the section sign as a word."""
    return F.replace(F.replace(fold(text), F.lit("<br>"), F.lit("\n")), F.lit("§"), F.lit(SECTION_WORD))


def full(text: Column) -> Column:
    """The form that criteria and token positions are based on."""
    x = F.translate(symbols(text), "{[}]", "(())")
    x = F.translate(x, QUOTES, '"' * len(QUOTES))
    x = F.regexp_replace(x, r"([0-9])[.,]+([0-9])", "$1$2")
    x = F.regexp_replace(x, r"([0-9])[.,]+ ", "$1 ")
    return F.regexp_replace(x, BREAK, "\n")


def full_text(text: str) -> str:
    x = fold_text(text).replace("<br>", "\n").replace("§", SECTION_WORD)
    x = x.translate(str.maketrans("{[}]", "(())")).translate(str.maketrans(QUOTES, '"' * len(QUOTES)))
    x = re.sub(r"([0-9])[.,]+([0-9])", r"\1\2", x)
    x = re.sub(r"([0-9])[.,]+ ", r"\1 ", x)
    return re.sub(BREAK, "\n", x)


def light(text: Column) -> Column:
    """The form that regular expressions run on: folded, every line end a line feed."""
    return F.translate(F.replace(fold(text), F.lit("<br>"), F.lit("\n")), "\r", "\n")


def in_step(text: Column) -> Column:
    """The original text, each character where its ``light`` form has it: line breaks are one character."""
    return F.translate(F.regexp_replace(text, "(?i)<br>", "\n"), "\r", "\n")


def light_text(text: str) -> str:
    return fold_text(text).replace("<br>", "\n").replace("\r", "\n")


def singular(word: Column) -> Column:
    """Pseudo-singular of a normalised word."""
    out = F.when(~word.endswith("s") | word.isin(*PLURAL_EXCEPTIONS) | word.rlike(NOT_PLURAL) | ~word.rlike("[aeiou]"), word)
    out = out.when(word.rlike(PLURAL_KEPT_VOWEL), F.regexp_replace(word, "s$", ""))
    for ending, instead in PLURAL_ENDINGS:
        out = out.when(word.rlike(ending), F.regexp_replace(word, ending, instead.replace("\\", "$")))
    return out.otherwise(word)


def singular_text(word: str) -> str:
    if not word.endswith("s") or word in PLURAL_EXCEPTIONS or re.search(NOT_PLURAL, word) or not re.search("[aeiou]", word):
        return word
    if re.search(PLURAL_KEPT_VOWEL, word):
        return word[:-1]
    for ending, instead in PLURAL_ENDINGS:
        if re.search(ending, word):
            return re.sub(ending, instead, word)
    return word


def aligned(text: Column) -> Column:
    """Normalised text whose characters stand where the original's stand: shortened words are padded with ~."""
    x = F.translate(F.regexp_replace(fold(text), BREAK, "\n"), "\r", "\n")
    for _ in range(2):
        x = F.regexp_replace(x, r"([0-9])[.,]([0-9])", "$1_$2")
    x = F.translate(x, "-", " ")
    padded = F.transform(F.split(x, " ", -1), lambda w: F.regexp_replace(F.rpad(singular(F.replace(w, F.lit("~"), F.lit(""))), F.length(w), "~"), r"[^a-z0-9\-~_\n§]", " "))
    return F.array_join(padded, " ")


def is_blank(text: Column) -> Column:
    """Nothing but white space and punctuation."""
    return F.length(F.translate(text, BLANK, "")) == 0


def unify_quotes(text: Column) -> Column:
    """Curly quotes, and apostrophes that don't stand between word characters, become plain quotes."""
    return F.regexp_replace(text, r"(?U)[“”]|'(?=\W)|(?<=\W)'|'$|^'", '"')


def remove_quoted(text: Column) -> Column:
    """Every quoted stretch becomes a space, if the quotes pair up."""
    n = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when((n > 0) & (n % 2 == 0), F.regexp_replace(F.trim(text), '"[^"]*"', " ")).otherwise(text)


def head_tail(text: Column, head: int | None, tail: int | None) -> Column:
    """The first ``head`` and last ``tail`` characters; the whole text if they cover it."""
    head, tail = max(0, head or 0), max(0, tail or 0)
    if not head and not tail:
        return text
    first, last = F.substring(text, 1, head), F.right(text, F.lit(tail))
    cut = F.concat(first, F.lit(" "), last) if head and tail else first if head else last
    return F.when(F.length(text) <= head + tail, text).otherwise(cut)


def breaks_to_html(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def breaks_from_html(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, BREAK, "\n"), "\r", "\n")


def literal_breaks(text: Column) -> Column:
    """A backslash and an n, written out in a text, become a line feed."""
    return F.regexp_replace(text, r"(?<=[^\\])\\n", "\n")
