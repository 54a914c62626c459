"""A criterion over stored postings (id, w, t, p, c): few criteria, a large corpus.

Only the postings that the criterion's words ask for are read, once for all of them.  They are gathered by
document, which moves one row a document where a document's postings lie together, and each document's
positions are tested as in array mode.  Nothing is compared across documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.plans.arrays import compares, matches, word_matches
from crivo.plans.syntax import Absent, Binary, Blank, Compare, Node, Scope, words_of


def comparisons(node: Node) -> list[Compare]:
    match node:
        case Compare():
            return [node]
        case Scope() | Absent():
            return comparisons(node.of)
        case Binary():
            return comparisons(node.left) + comparisons(node.right)
    return []


def needed(node: Node, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Whether a posting can matter to a criterion."""
    tests = [word_matches(F.col("w"), t, synonyms) for t in words_of(node)]
    tests += [(F.col("c") == n.field) & compares(F.col("w"), n.sign, n.value) for n in comparisons(node)]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def fits_nothing(node: Node) -> bool:
    """Whether a document without any of the needed postings matches."""
    match node:
        case Scope():
            return fits_nothing(node.of)
        case Absent():
            return not fits_nothing(node.of)
        case Binary(name="E"):
            return fits_nothing(node.left) and fits_nothing(node.right)
        case Binary(name="OU"):
            return fits_nothing(node.left) or fits_nothing(node.right)
        case Binary(name="NAO"):
            return fits_nothing(node.left) and not fits_nothing(node.right)
        case Binary():
            # Operands that hold without a position of their own stand at the same place.
            return fits_nothing(node.left) and fits_nothing(node.right)
    return False


def gathered(node: Node, postings: DataFrame, id_col: str = "doc_id", synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id, tok): the positions that a criterion needs, one row a document that has any."""
    return postings.where(needed(node, synonyms or {})).groupBy(id_col).agg(F.collect_list(F.struct("w", "t", "p", "c")).alias("tok"))


def search(node: Node | None, postings: DataFrame, ids: DataFrame, id_col: str = "doc_id", synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The ids of the matching documents; ``ids`` holds all documents of the corpus."""
    everything = ids.select(id_col).distinct()
    if node is None:
        return everything.limit(0)
    if isinstance(node, Blank):
        return everything.join(postings.select(id_col).distinct(), id_col, "left_anti")
    held = gathered(node, postings, id_col, synonyms)
    passes = matches(node, F.col("tok"), synonyms)
    if not fits_nothing(node):
        return held.where(passes).select(id_col)
    return everything.join(held.where(~passes).select(id_col), id_col, "left_anti")
