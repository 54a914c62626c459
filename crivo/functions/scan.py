"""Running sums and maxima of an array, and a text cut at many places, in time that grows with their length.

``aggregate`` can only gather what it has seen by copying it at every step.  A scan here adds to every
element what stands 1, 2, ... 7 places before it, then 8, 16, ... 56 places, and so on: a round for every
factor of eight in the array's size, each one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crivo.functions.tokens import let

RADIX = 8
#: Arrays of up to 8^9 elements, 134 million.
ROUNDS = 9
BLOCK = 1024


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    def spread(a: Column, step: Column) -> Column:
        def add(x: Column, i: Column) -> Column:
            for j in range(1, RADIX):
                x = join(x, F.get(a, i - j * step))
            return x

        return F.when(F.size(a) > step, F.transform(a, add)).otherwise(a)

    return F.aggregate(F.array(*[F.lit(RADIX**k) for k in range(ROUNDS)]), values, spread)


def running_sums(values: Column) -> Column:
    """The sum of the elements up to each one, itself included; elements aren't null."""
    return _scan(values, lambda x, y: x + F.coalesce(y, F.lit(0)))


def running_max(values: Column) -> Column:
    """The largest of the elements up to each one; null before the first that isn't."""
    return _scan(values, lambda x, y: F.greatest(x, y))


def blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` characters, to reach any place of it without walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text in blocks."""

    def cut(z: Column) -> Column:
        first, last = z["a"].cast("int"), z["b"].cast("int")
        block = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        head = F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK))
        tail = F.substring(block(last), F.lit(1), (end - 1) % BLOCK + 1)
        inner = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        one = F.substring(block(first), start % BLOCK + 1, end - start)
        return F.when(first == last, one).otherwise(F.concat(head, inner, tail))

    places = F.struct(F.floor(start / BLOCK).alias("a"), F.floor((end - 1) / BLOCK).alias("b"))
    return F.when(end <= start, F.lit("")).otherwise(let(places, cut))
