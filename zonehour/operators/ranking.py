"""Row numbers, ranks and group-wise scaling without a single-task sort of facts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe
from .quantiles import exact_quantiles, magnitude_bin


def number_rows(df: DataFrame, order: str, out: str, block: int = 65536, base: int = 0) -> DataFrame:
    """Dense numbering by a unique, non-negative integer column, in parallel.

    A NULL value, of which there may be one, comes first. A counted table of at most ``block`` rows is numbered by one window. Beyond,
    rows are numbered inside blocks of ``block`` consecutive order values; the
    rows before each block come from a running sum over block counts, a table
    ``block`` times smaller. That table is itself folded once more, so the one
    unpartitioned window sees count/block**2 rows.
    """
    facts = df.agg(F.count("*").alias("n"), F.coalesce(F.max(order), F.lit(0)).cast("decimal(38,0)").alias("top")).first()
    if facts["n"] <= block:
        number = F.row_number().over(Window.orderBy(order)) - 1 + base
        return df.withColumn(out, number.cast("bigint"))
    # Sparse values get wider blocks, so that there are about as many blocks as full ones would be.
    width = max(block, (int(facts["top"]) + 1) * block // facts["n"])
    blocked = df.withColumn("_b", F.coalesce(F.expr(f"{order} div {width}L"), F.lit(-1))).withColumn(
        "_bb", F.floor(F.col("_b") / block))
    counts = blocked.groupBy("_bb", "_b").agg(F.count("*").alias("_n"))
    outer = counts.groupBy("_bb").agg(F.sum("_n").alias("_n"))
    outer = outer.select("_bb", (F.sum("_n").over(Window.orderBy("_bb")) - F.col("_n")).alias("_o2"))
    inner = Window.partitionBy("_bb").orderBy("_b")
    offsets = (
        counts.withColumn("_o1", F.sum("_n").over(inner) - F.col("_n"))
        .join(outer, "_bb").select("_b", (F.col("_o1") + F.col("_o2")).alias("_off"))
    )
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return (
        blocked.withColumn("_r", within).join(offsets, "_b")
        .withColumn(out, (F.col("_off") + F.col("_r") - 1 + base).cast("bigint"))
        .drop("_b", "_bb", "_r", "_off")
    )


def average_ranks(df: DataFrame, groups, metrics) -> DataFrame:
    """Rank of each metric within its group, ties sharing their mean rank.

    Equal values are counted first, so a hot tie costs one row. Ranks then come
    from the counts of lower magnitude bins plus a window inside one bin, so a
    large group is spread over its bins. A NULL metric has no rank and counts for
    none; a NULL group is a group.
    """
    groups = list(groups)
    out = df
    before = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for m in metrics:
        counts = df.where(F.col(m).isNotNull()).groupBy(*groups, m).agg(F.count("*").alias("_n")).withColumn(
            "_bin", magnitude_bin(F.col(m).cast("double")))
        bins = counts.groupBy(*groups, "_bin").agg(F.sum("_n").alias("_m"))
        by_bin = before.partitionBy(*groups).orderBy("_bin")
        bins = bins.select(*groups, "_bin", (F.sum("_m").over(by_bin) - F.col("_m")).alias("_low"))
        inside = before.partitionBy(*groups, "_bin").orderBy(m)
        upto = F.col("_low") + F.sum("_n").over(inside)
        ranks = null_safe(counts, bins, [*groups, "_bin"]).select(
            *groups, m, (upto - (F.col("_n") - 1) / 2).cast("double").alias(f"rank_{m}"))
        out = null_safe(out, ranks, [*groups, m], "left")
    return out


def rank_summary(ranked: DataFrame, by, metrics) -> DataFrame:
    return ranked.groupBy(*by).agg(
        *[F.avg(f"rank_{m}").alias(f"rank_{m}_mean") for m in metrics])


def scale_by_group_max(df: DataFrame, groups, column: str, out: str) -> DataFrame:
    """column / max(column) of its group; the maximum is pre-aggregated, then joined."""
    top = df.groupBy(*groups).agg(F.max(column).alias("_max"))
    return null_safe(df, top, groups).withColumn(out, F.col(column) / F.col("_max")).drop("_max")


def clip_at_quantile(df: DataFrame, column: str, out: str, prob: float = 0.05, keys=()) -> DataFrame:
    """Values below their ``prob`` quantile are raised to it."""
    q = exact_quantiles(df, column, [prob], keys=keys).drop("prob").withColumnRenamed(
        "quantile", "_q")
    if keys:
        joined = null_safe(df, q, keys)
        bound = F.col("_q")
    else:
        joined, bound = df, q.scalar()
    return joined.withColumn(out, F.greatest(F.col(column) - bound, F.lit(0.0)) + bound).drop("_q")


def ordinal(column, levels):
    """Position of a label in a fixed order, 1-based; NULL when it is not listed."""
    expr = F.lit(None).cast("int")
    for i, level in reversed(list(enumerate(levels, start=1))):
        expr = F.when(column == level, F.lit(i)).otherwise(expr)
    return expr


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows by ``order``: per-task top-n, merged."""
    return df.orderBy(*order).limit(n)
