"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def truncate_normalise(a: Column, width: int) -> Column:
    """The first `width` places at unit length; a zero vector stays."""
    head = F.slice(a, 1, width)
    size = norm(head)
    return F.when(size > 0, F.transform(head, lambda x: x.cast("double") / size)).otherwise(F.transform(head, lambda x: x.cast("double")))


def hashed_place(term: Column, width: int = 64) -> tuple[Column, Column]:
    """A term's place and sign in a hashed bag, from its MD5 (the same in every engine)."""
    digest = F.md5(term.cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(width)), F.when(F.substring(digest, 5, 1) < "8", 1.0).otherwise(-1.0)
