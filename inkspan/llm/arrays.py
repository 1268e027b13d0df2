"""Array expressions shared by the operators that stay inside DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda, other expressions are computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, first: Column, op) -> Column:
    """For each element ``op`` folded over the elements before it; in blocks, so that long arrays cost little more than their length."""
    fold = lambda a: F.aggregate(a, first, op)

    def in_blocks(a):
        n = F.size(a)
        blocks = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        wholes = F.transform(blocks, lambda b: fold(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = let(wholes, lambda t: F.transform(t, lambda _, b: fold(F.slice(t, F.lit(1), b))))

        def at(folded):
            def one(_, i):
                b = (i / _BLOCK).cast("int")
                return op(F.get(folded, b), fold(F.slice(a, b * _BLOCK + 1, i % _BLOCK)))

            return F.transform(a, one)

        return let(before, at)

    return let(values, in_blocks)


def sums_before(lengths: Column) -> Column:
    return _before(lengths, F.lit(0), lambda s, x: s + x)


def most_before(values: Column) -> Column:
    """For each element the greatest of the elements before it, 0 at least."""
    return _before(values, F.lit(0), lambda s, x: F.greatest(s, x))


def letters(text: Column) -> Column:
    """The code points of a text as an array of strings."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
