"""Small building blocks shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use inside a higher-order lambda, where Spark would re-evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def present(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def non_empty(collection: Column) -> Column:
    """The array or map itself, or null when it is null or empty (for coalesce chains)."""
    return F.when(F.size(collection) > 0, collection)


def finite(value: Column) -> Column:
    """The double itself, or null when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def unit_hash(*parts: Column, seed: int | str = 0) -> Column:
    """A hex digest that orders rows at random but the same way in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_fraction(digest: Column) -> Column:
    """Position of a hex digest in [0, 1), monotone in the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
