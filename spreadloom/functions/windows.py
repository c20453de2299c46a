"""Window specifications over a panel (key, date_id). All frames of a key share one partitioning, hence one exchange."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str = "target") -> WindowSpec:
    return Window.partitionBy(key).orderBy("date_id")


def last_rows(n: int, key: str = "target") -> WindowSpec:
    """The row and the n - 1 before it."""
    return ordered(key).rowsBetween(1 - n, 0)


def up_to_now(key: str = "target") -> WindowSpec:
    return ordered(key).rowsBetween(Window.unboundedPreceding, 0)


def whole(key: str = "target") -> WindowSpec:
    """All rows of the key, in order; one value for the key, so it costs a row once."""
    return ordered(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def full(n: int, x: Column, value: Column, key: str = "target") -> Column:
    """value where the last n rows all have x, else NULL."""
    return F.when(F.count(x).over(last_rows(n, key)) == n, value)


def filled(x: Column, key: str = "target") -> Column:
    """Forward fill, then backward fill of what leads, which is the first value there is."""
    return F.coalesce(F.last(x, True).over(up_to_now(key)), F.first(x, True).over(whole(key)))
