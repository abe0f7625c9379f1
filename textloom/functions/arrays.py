"""Row-local frequency work on arrays: sorting a text's own words takes the place of a grouped shuffle.

A text is one row, and nothing is learned across texts; so frequencies, ranks and distances between occurrences come
from a sort inside the row, and plans built on these have no exchange at all, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lambda = Callable[[Column], Column]


def let(value: Column, f: Lambda) -> Column:
    """f of a value that is worked out once: an expression named inside a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, worked out where they stand: others the optimizer moves up to where they are used, but not
    past a generator, here of one row. Spark keeps rows that wait for Python with all their columns, so that calls have
    to stay below the making of wide ones."""
    return df.select("*", F.inline(F.array(F.struct(*(x.alias(c) for c, x in columns.items()))))) if columns else df


def total(array: Column, f: Lambda = lambda x: x) -> Column:
    """Sum of f over an array, in array order; 0.0 for an empty one."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def mean(array: Column, f: Lambda = lambda x: x) -> Column:
    """Mean of f over an array; null for an empty one."""
    return F.when(F.size(array) > 0, total(array, f) / F.size(array))


def count(array: Column, test: Lambda) -> Column:
    return F.size(F.filter(array, test))


def equal(array: Column, value) -> Column:
    """How many elements equal a value. (A lambda's second parameter would be taken for the element's index.)"""
    return count(array, lambda x: x == value)


def span(n: Column) -> Column:
    """[1, ..., n], empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def with_occurrences(df: DataFrame, words: str, to: str) -> DataFrame:
    """Add `to`: array<struct<w, p>>, the words with their places from 1, sorted by word, then place."""
    return df.withColumn(to, F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))))


def with_frequencies(df: DataFrame, words: str, to: str) -> DataFrame:
    """Add `to`: array<int>, the frequency of each distinct word, falling."""
    s, e = f"{to}_sorted", f"{to}_ends"
    df = df.withColumn(s, F.sort_array(words))
    df = df.withColumn(e, F.filter(span(F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1))))
    f = F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0)))
    return df.withColumn(to, F.sort_array(f, asc=False)).drop(s, e)


def gaps(occurrences: str) -> Column:
    """array<struct<p, prev>>: of each place, the place before it with the same word, or null."""

    def one(x: Column, i: Column) -> Column:
        before = F.get(occurrences, i - 1)
        return F.struct(x["p"].alias("p"), F.when(before["w"] == x["w"], before["p"]).alias("prev"))

    return F.transform(occurrences, one)


def entropy(counts: Column, n: Column) -> Column:
    """-sum(c/n ln c/n) of an array of counts with the sum n."""
    return F.lit(0.0) - total(counts, lambda c: (c / n) * F.ln(c / n))


def distinct_counts(array: Column) -> Column:
    """Counts of the distinct values of a short array (tags, lengths)."""
    return F.transform(F.array_distinct(array), lambda v: count(array, lambda x: x == v))
