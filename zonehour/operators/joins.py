"""Joins in which a NULL key meets a NULL key, as it does in a grouping, and joins that split hot keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Keys of more than one row in so many are known by broadcast: there are fewer of them than this.
HOT_SHARE = 1000


def with_known(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each ``key``, where ``facts`` has the key.

    ``count`` is a column of ``facts``: how many of the ``total`` rows have the key. Keys of more than a thousandth
    of all rows are looked up by broadcast where the rows are, so no task gets a hot key; the others are
    shuffled. ``count`` isn't returned.
    """
    least = total // HOT_SHARE
    hot, other = facts.where(F.col(count) > least), facts.where(F.col(count) <= least)
    here = rows.join(F.broadcast(hot), key, "left")
    rest = here.where(F.col(count).isNull()).select(*rows.columns).join(other, key, "left")
    return here.where(F.col(count).isNotNull()).unionByName(rest).drop(count)


def null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` for inner and left joins, with NULL equal to NULL."""
    keys = list(keys)
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(named, on, how).drop(*[f"_on_{k}" for k in keys])
