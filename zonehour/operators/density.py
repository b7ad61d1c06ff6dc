"""Log-odds at the splits to densities, tail probabilities and quantiles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import log_logistic
from .joins import null_safe
from .splits import WIDE_SPLITS, cut_points, leaf_of, split_paths


def leaf_probabilities(betas: DataFrame, splits: DataFrame, keys=("vertex",),
                       renormalize: bool = False) -> DataFrame:
    """(keys, leaf, leaf_lo, leaf_up, log_prob, prob).

    ``betas`` holds every split of every key; samples have the sample number
    among the keys. A leaf below a split without log-odds has NULL mass; of repeated
    log-odds the greatest counts. One shuffle brings the log-odds of a key together; there the
    splits become columns and every leaf is a sum over its ancestors, written out
    from the tree. Trees too large for that many columns join their path table.
    """
    keys = list(keys)
    together = betas.repartition(*keys)
    rows = split_paths(splits)
    # The tree is a parameter of some dozens of rows.
    paths = rows.limit(WIDE_SPLITS * WIDE_SPLITS).collect()
    if len({p["split_id"] for p in paths}) > WIDE_SPLITS or len(paths) == WIDE_SPLITS ** 2:
        path = F.struct("leaf", "leaf_lo", "leaf_up", "split_id", "side")
        tree = rows.agg(F.collect_list(path)).scalar()
        one = together.groupBy(*keys, "split_id").agg(F.max("beta").alias("beta"))
        steps = together.select(*keys).distinct().select(*keys, F.inline(tree))
        term = log_logistic(F.col("beta") * F.col("side"))
        out = (
            null_safe(steps, one, [*keys, "split_id"], "left").groupBy(*keys, "leaf", "leaf_lo", "leaf_up")
            .agg(F.when(F.count("beta") == F.count("*"), F.sum(term)).alias("log_prob"))
        )
    else:
        out = _wide_leaves(together, paths, keys)
    out = out.withColumn("prob", F.exp("log_prob"))
    return normalize_mass(out, keys) if renormalize else out


def _wide_leaves(betas: DataFrame, paths, keys) -> DataFrame:
    ids = sorted({p["split_id"] for p in paths})
    logs = betas.select(
        *keys, "split_id", log_logistic(F.col("beta")).alias("_left"),
        log_logistic(-F.col("beta")).alias("_right"))
    # The greatest log-odds has the greatest left and the least right logarithm.
    wide = logs.groupBy(*keys).agg(*[
        F.expr(f"{most}({side}) FILTER (WHERE split_id = {i}) AS {side}{i}")
        for i in ids for side, most in (("_left", "max"), ("_right", "min"))])
    leaves = {}
    for p in paths:
        term = f"{'_left' if p['side'] > 0 else '_right'}{p['split_id']}"
        leaves.setdefault((p["leaf"], p["leaf_lo"], p["leaf_up"]), []).append(term)
    cells = ", ".join(f"{leaf}, {lo!r}D, {up!r}D, {' + '.join(terms)}"
                      for (leaf, lo, up), terms in sorted(leaves.items()))
    return wide.selectExpr(
        *keys, f"stack({len(leaves)}, {cells}) AS (leaf, leaf_lo, leaf_up, log_prob)")


def normalize_mass(df: DataFrame, keys, prob: str = "prob") -> DataFrame:
    """Divide by the sum over the evaluation points of each key."""
    total = F.sum(prob).over(Window.partitionBy(*keys))
    return df.withColumn(prob, F.col(prob) / total)


def point_probabilities(leaves: DataFrame, keys=("vertex",), compat: bool = False) -> DataFrame:
    """Mass of the bin that ends at each evaluation point, x_num from 2.

    ``compat`` also emits the first point with the first bin's mass and
    renormalises, as the published surfaces do.
    """
    keys = list(keys)
    points = leaves.select(*keys, (F.col("leaf") + 2).alias("x_num"),
                           F.col("leaf_up").alias("x"), "prob")
    if not compat:
        return points
    first = leaves.where(F.col("leaf") == 0).select(
        *keys, F.lit(1).alias("x_num"), F.col("leaf_lo").alias("x"), "prob")
    return normalize_mass(points.unionByName(first), keys)


def support_mask(df: DataFrame, x: str, lo, up, prob: str = "prob") -> DataFrame:
    """Probability zero outside the support of the root."""
    return df.withColumn(prob, F.when(F.col(x).between(lo, up), F.col(prob)).otherwise(0.0))


def bin_widths(points: DataFrame, order: str = "x_num", x: str = "x", keys=()) -> DataFrame:
    """Width of the bin ending at each point (first one repeated) and bin middles.

    ``points`` is the table of evaluation points, one row per tree cut.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return points.withColumns({
        "width": F.coalesce(F.col(x) - before, after - F.col(x)),
        "midpoint": F.coalesce((F.col(x) + before) / 2, F.col(x))})


def density(leaves: DataFrame) -> DataFrame:
    """Mass divided by bin width."""
    return leaves.withColumn("density", F.col("prob") / (F.col("leaf_up") - F.col("leaf_lo")))


def _log_density(leaves: DataFrame):
    """ln(mass / width) from the log mass where there is one: no mass gives minus infinity, not NULL."""
    log_mass = F.when(F.col("prob") == 0, float("-inf")).otherwise(F.ln("prob"))
    if "log_prob" in leaves.columns:
        log_mass = F.coalesce("log_prob", log_mass)
    return log_mass - F.ln(F.col("leaf_up") - F.col("leaf_lo"))


def log_density_at(values: DataFrame, leaves: DataFrame, splits: DataFrame, value: str,
                   keys=("vertex",)) -> DataFrame:
    """log density of each value under its key's distribution; NULL outside the tree.

    A busy key may own a large share of the values: values are grouped per
    (key, leaf, value) neither sorted nor gathered, only joined on (key, leaf).
    """
    cuts = cut_points(splits)
    dens = leaves.select(*keys, "leaf", _log_density(leaves).alias("log_density"))
    return values.withColumn("leaf", leaf_of(value, cuts)).join(
        dens, [*keys, "leaf"], "left")


def heldout_nll(values: DataFrame, leaves: DataFrame, splits: DataFrame, value: str,
                keys=("vertex",), by=()) -> DataFrame:
    """Mean negative log density over the values, per group in ``by``.

    Values are first counted per (key, leaf), so the join sees cells, not rows. With the fold among
    ``keys`` and ``by``, ``leaves`` are those fitted without that fold; a value in a leaf without mass
    costs infinity.
    """
    cuts = cut_points(splits)
    cells = (
        values.select(*dict.fromkeys([*keys, *by]), leaf_of(value, cuts).alias("leaf"))
        .where(F.col("leaf").isNotNull()).groupBy(*dict.fromkeys([*keys, *by]), "leaf").agg(F.count("*").alias("n"))
    )
    dens = leaves.select(*keys, "leaf", _log_density(leaves).alias("log_density"))
    return cells.join(dens, [*keys, "leaf"]).groupBy(*by).agg(
        (-F.sum(F.col("log_density") * F.col("n")) / F.sum("n")).alias("nll"),
        F.sum("n").cast("bigint").alias("n"))


def validation_nll(log_densities: DataFrame, keys=("vertex",)) -> DataFrame:
    """Mean negative log density over the draws of each key, then over keys."""
    per_key = log_densities.groupBy(*keys).agg((-F.avg("log_density")).alias("nll"))
    return per_key.agg(F.avg("nll").alias("validation_nll"))


def running_cdf(points: DataFrame, keys, order: str = "x_num") -> DataFrame:
    """Cumulative probability over the evaluation points of each key."""
    w = (Window.partitionBy(*keys).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return points.withColumn("cdf", F.sum("prob").over(w))


def _level_name(prefix, level):
    return f"{prefix}_{format(level, 'g').replace('.', '_')}"


def tail_columns(points: DataFrame, levels, keys, x: str = "x", prefix: str = "tp"):
    """Probability of reaching each level, all levels in one aggregation."""
    return points.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(x) >= t, F.col("prob")).otherwise(0.0)).alias(_level_name(prefix, t))
        for t in levels])


def tail_probability(points: DataFrame, levels=(18.56, 21.64, 32.73, 34.74), keys=("vertex",),
                     x: str = "x") -> DataFrame:
    """(keys, level, tail_prob): probability mass at points >= level."""
    wide = tail_columns(points, levels, keys, x)
    pairs = F.array(*[
        F.struct(F.lit(float(t)).alias("level"), F.col(_level_name("tp", t)).alias("tail_prob"))
        for t in levels])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def density_quantile(leaves: DataFrame, levels=(0.1, 0.25, 0.5, 0.75), keys=("vertex",)):
    """(keys, level, value): where the distribution function crosses each level.

    Linear inside the crossing bin. All levels come from one window and one
    aggregation, both over the bins of a key. A level met up to 1e-12 counts as
    reached, so that rounding in the running sum cannot pick the next bin.
    """
    keys = list(keys)
    cdf = running_cdf(leaves, keys, "leaf").withColumn("_before", F.col("cdf") - F.col("prob"))

    def crossing(level):
        reached = level - 1e-12
        hit = (F.col("_before") < reached) & (F.col("cdf") >= reached)
        share = (F.lit(level) - F.col("_before")) / F.nullif(F.col("prob"), F.lit(0.0))
        at = F.col("leaf_lo") + share * (F.col("leaf_up") - F.col("leaf_lo"))
        return F.min(F.when(hit, at))

    wide = cdf.groupBy(*keys).agg(
        *[crossing(q).alias(_level_name("q", q)) for q in levels],
        F.min("leaf_lo").alias("_first"))
    pairs = F.array(*[
        F.struct(F.lit(float(q)).alias("level"),
                 F.coalesce(_level_name("q", q), "_first").alias("value"))
        for q in levels])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def expected_value(points: DataFrame, keys, at: str = "midpoint", out: str = "mean") -> DataFrame:
    return points.groupBy(*keys).agg(F.sum(F.col("prob") * F.col(at)).alias(out))


def geometric_mean_density(df: DataFrame, value: str = "prob", point: str = "x_num") -> DataFrame:
    """exp(mean(log p)) per point over all zones and hours, normalised over points.

    One zero makes a point's mean zero; NULLs don't count.
    """
    log = F.when(F.col(value) == 0, float("-inf")).otherwise(F.ln(value))
    per_point = df.groupBy(point).agg(F.exp(F.avg(log)).alias("prob"))
    # One row per evaluation point remains.
    total = F.sum("prob").over(Window.partitionBy())
    return per_point.withColumn("prob", F.when(total > 0, F.col("prob") / total).otherwise(F.col("prob")))


def trapezoid_weights(grid: DataFrame, order: str = "x_num", x: str = "x") -> DataFrame:
    """Integration weight of every point of a grid table (half steps at both ends)."""
    w = Window.orderBy(order)
    before = F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    after = F.coalesce(F.lead(x).over(w) - F.col(x), F.lit(0.0))
    return grid.withColumn("weight", (before + after) / 2)


def integrated_errors(df: DataFrame, p: str, q: str, by, key: str, weight: str = "weight"):
    """Integrated squared and absolute error per curve; RMISE and MIAE over curves."""
    gap = F.col(p) - F.col(q)
    per_curve = df.groupBy(*by, key).agg(
        F.sum(F.col(weight) * gap * gap).alias("ise"),
        F.sum(F.col(weight) * F.abs(gap)).alias("iae"))
    return per_curve.groupBy(*by).agg(
        F.sqrt(F.avg("ise")).alias("rmise"), F.avg("iae").alias("miae"))


def density_mean(df: DataFrame, keys, f: str = "density", x: str = "x", weight: str = "weight"):
    """Integral of x times the density."""
    return df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(x) * F.col(f)).alias("mean"))
