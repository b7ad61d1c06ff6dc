"""Long and wide forms of the density surfaces."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, array_col: str, index: str, value: str, base: int = 1) -> DataFrame:
    """Array column to rows (index counted from ``base``); nest calls for more axes."""
    rest = [c for c in df.columns if c != array_col]
    return df.select(*rest, F.posexplode(array_col).alias("_pos", value)).select(
        *rest, (F.col("_pos") + base).alias(index), value
    )


def to_longer(df: DataFrame, keys, columns, name: str = "name", value: str = "value") -> DataFrame:
    """Columns to (name, value) rows."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, value)


def to_arrays(df: DataFrame, keys, index: str, value: str, out: str) -> DataFrame:
    """Rows to one array per key.

    Keys hold as many rows as there are evaluation points, a tree parameter.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col(index), F.col(value))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias(out))


def slice_sites(df: DataFrame, sites: DataFrame, on="zone") -> DataFrame:
    """Rows of the chosen sites only."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(sites.select(*on), on, "left_semi")


def grid_to_index(i, j, rows):
    """Column-major linear index of cell (i, j), all 1-based."""
    return (j - 1) * rows + i


def index_to_grid(index, rows):
    """(i, j) of a column-major linear index, all 1-based."""
    return F.pmod(index - 1, F.lit(rows)) + 1, F.floor((index - 1) / F.lit(rows)) + 1


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def natural_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on every shared column, NULL matching NULL."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables share no column; a natural join would pair all rows")
    left, right = a.alias("l"), b.alias("r")
    on = F.lit(True)
    for c in shared:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    keys = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in shared]
    rest_a = [F.col(f"l.{c}") for c in a.columns if c not in shared]
    rest_b = [F.col(f"r.{c}") for c in b.columns if c not in shared]
    return left.join(right, on, "full").select(*keys, *rest_a, *rest_b)
