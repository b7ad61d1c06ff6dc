"""Exact linear-interpolated quantiles that never gather a large group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. It
is used where a count of the largest group shows that this is safe. Otherwise a
rank is located by counting:

1. count rows per logarithmic magnitude bin (partial aggregation, no sort);
2. inside the bins that hold a wanted rank, count rows per equal-width sub-bin;
3. inside those sub-bins, count rows per distinct value and pick the ranks.

Every step combines map-side; counts do not depend on order, so repeated or
recomputed tasks agree. Without keys the wanted bins are a handful of rows and
are broadcast. With keys, equal values are merged before anything is joined, so
neither a hot key (spread over its bins) nor a hot value (one row) fills a task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe

_SUB_BINS = 65536
# Largest group ``percentile`` may hold: many keyed groups share a task, one unkeyed group does not.
GATHER_ONE = 100_000
GATHER_KEYED = 20_000


def magnitude_bin(v, per_octave: int = 64):
    """Monotone integer bin of a double: sign * (floor(per_octave*log2|v|) + shift).

    Infinities have the outermost bins, and NaN one above all others, where Spark sorts it.
    """
    shift = 1100 * per_octave
    outer = 3 * shift
    finite = F.when(F.abs(v) < float("inf"), F.abs(v))
    size = (F.floor(F.log2(finite) * per_octave) + shift).cast("int")
    return (
        F.when(F.isnan(v), F.lit(outer + 1)).when(v == float("inf"), F.lit(outer))
        .when(v == float("-inf"), F.lit(-outer)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size))


def _sub(v, lo, hi):
    width = F.when(hi > lo, hi - lo)
    cell = F.floor((v - lo) / F.when(width < float("inf"), width) * _SUB_BINS)
    return F.coalesce(F.least(cell, F.lit(_SUB_BINS - 1)), F.lit(0)).cast("int")


def _cumulate(df, groups, order):
    """Add ``before``: rows of the group in earlier bins."""
    w = (Window.partitionBy(*groups).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("before", F.sum("n").over(w) - F.col("n"))


def _largest_group(df: DataFrame, keys) -> int:
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _gathered(df: DataFrame, value: str, probs, keys) -> DataFrame:
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs]))
    pairs = F.array(*[
        F.struct(F.lit(p).alias("prob"), F.col("_q")[i].alias("quantile"))
        for i, p in enumerate(probs)])
    packed = df.groupBy(*keys).agg(q.alias("_q")).where(F.col("_q").isNotNull())
    return packed.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def exact_quantiles(df: DataFrame, value: str, probs, keys=(),
                    gather_limit: int | None = None) -> DataFrame:
    """Rows (keys..., prob, quantile), type-7 interpolation, NULL values ignored.

    A NULL key is a group; NaN sorts above infinity. Both ways agree on all of these.

    One count of the largest group decides between the two ways.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    if gather_limit is None:
        gather_limit = GATHER_KEYED if keys else GATHER_ONE
    if gather_limit and _largest_group(df, keys) <= gather_limit:
        return _gathered(df, value, probs, keys)
    v = F.col("_v")
    facts = df.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull())
    if keys:
        facts = facts.groupBy(*keys, "_v").agg(F.count("*").alias("n"))
    else:
        facts = facts.withColumn("n", F.lit(1).cast("bigint"))
    facts = facts.withColumn("_bin", magnitude_bin(v))
    hist = _cumulate(
        facts.groupBy(*keys, "_bin").agg(
            F.sum("n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")),
        keys, "_bin")
    if keys:
        total = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
        hist = null_safe(hist, total, keys)
    else:
        hist = hist.withColumn("total", F.sum("n").over(Window.partitionBy()))
    # Both neighbours of every fractional rank (0-based).
    spot = F.col("prob") * (F.col("total") - 1)
    wanted = (
        hist.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("rank", F.when(F.col("side") == 0, F.floor(spot)).otherwise(F.ceil(spot)))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        .withColumn("weight", spot - F.floor(spot))
        .select(*keys, "prob", "side", "weight", "_bin", "lo", "hi",
                (F.col("rank") - F.col("before")).alias("rank"))
    )

    def small(t):
        # Without keys there are at most 2*len(probs) rows: safe to broadcast.
        return t if keys else F.broadcast(t)

    bins = wanted.select(*keys, "_bin", "lo", "hi").distinct()
    fine = null_safe(facts, small(bins), [*keys, "_bin"]).select(
        *keys, "_bin", "_v", "n", _sub(v, F.col("lo"), F.col("hi")).alias("_sub"))
    sub_hist = _cumulate(
        fine.groupBy(*keys, "_bin", "_sub").agg(F.sum("n").alias("n")), [*keys, "_bin"], "_sub")
    located = (
        null_safe(wanted, sub_hist, [*keys, "_bin"])
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        .select(*keys, "prob", "side", "weight", "_bin", "_sub",
                (F.col("rank") - F.col("before")).alias("rank"))
    )
    cells = located.select(*keys, "_bin", "_sub").distinct()
    values = _cumulate(
        null_safe(fine, small(cells), [*keys, "_bin", "_sub"])
        .groupBy(*keys, "_bin", "_sub", "_v").agg(F.sum("n").alias("n")),
        [*keys, "_bin", "_sub"], "_v")
    hit = null_safe(located, values, [*keys, "_bin", "_sub"]).where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    both = hit.groupBy(*keys, "prob").agg(
        F.max(F.when(F.col("side") == 0, v)).alias("a"),
        F.max(F.when(F.col("side") == 1, v)).alias("b"),
        F.max("weight").alias("w"))
    # Equal neighbours are taken as they are: infinities have no difference.
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    ends = F.abs(F.col("a")) + F.abs(F.col("b")) == float("inf")
    mixed = F.when(ends, (1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b")).otherwise(between)
    return both.select(
        *keys, "prob",
        F.when((F.col("w") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(mixed).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, names: dict[str, float], keys,
                     gather_limit: int | None = None) -> DataFrame:
    """One row per key with one column per quantile."""
    probs = sorted(set(names.values()))
    long = exact_quantiles(df, value, probs, keys=keys, gather_limit=gather_limit)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
        for n, p in names.items()])


def group_quantiles(df: DataFrame, value: str, names: dict[str, float], keys, bounded: bool):
    """Quantiles per key; ``bounded`` says that a key holds at most a fixed number of rows
    (bootstrap samples, folds), so that no count is needed before ``percentile``."""
    if not bounded:
        return quantile_columns(df, value, names, keys)
    arr = F.percentile(value, F.array(*[F.lit(float(p)) for p in names.values()]))
    packed = df.groupBy(*keys).agg(arr.alias("_q"))
    return packed.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def value_range(df: DataFrame, value: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(value).alias("min_val"), F.max(value).alias("max_val"),
        (F.max(value) - F.min(value)).alias("range_val"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the extremes, the top one closed."""
    lo = df.agg(F.min(value)).scalar()
    width = df.agg((F.max(value) - F.min(value)) / bins).scalar()
    cell = F.floor((F.col(value) - lo) / F.nullif(width, F.lit(0.0)))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.coalesce(F.least(cell, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def surface_limits(df: DataFrame, value: str, digits: int, pad: float) -> DataFrame:
    """Rounded extremes with a margin, for a shared colour scale."""
    return df.agg(
        (F.round(F.min(value), digits) - pad).alias("min_val"),
        (F.round(F.max(value), digits) + pad).alias("max_val"))


def share_where(df: DataFrame, predicate, out: str = "share") -> DataFrame:
    return df.agg(F.avg(predicate.cast("double")).alias(out))
