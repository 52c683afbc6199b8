"""Array expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: runs of letters and digits in lower case; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def grams(h: Column, k: int) -> Column:
    """Hashes of k in a row of an array of hashes (bound by let); none if there are fewer."""
    return F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))),
    )
