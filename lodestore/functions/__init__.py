"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products of two vectors of one length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays zero. The length is bound once, not taken anew for each element."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, clamped to [-1, 1]; 0 if either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), lengths))))


def normalized(text: Column | str) -> Column:
    """Lower case, outer white space off, inner runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens_of(n: Column) -> Column:
    """Estimated tokens of n characters."""
    return F.floor(n / 4).cast("long")


def cut(text: Column, most: int) -> Column:
    """text, or its beginning with `...`, so that it has at most `most` characters."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def first_of(*cases: tuple[Column, str], default: Column | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(None).cast("string") if default is None else default
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def words(text: Column | str) -> Column:
    """Distinct words of a text for set F1: punctuation as space, lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9 ]", " ")), " ")), "")


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two word sets; 0 if either is empty. What they share is bound once."""
    shared = F.array(F.size(F.array_intersect(a, b)).cast("double"))
    return F.get(F.transform(shared, lambda n: F.when(n == 0, 0.0).otherwise(2 * n / (F.size(a) + F.size(b)))), F.lit(0))


def newest(df, key: str, *order: Column):  # noqa: ANN001, ANN201
    """One row for each key: the first in order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
