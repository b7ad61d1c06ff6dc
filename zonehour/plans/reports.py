"""Maps and site reports: the data behind the figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weektime import bin_label, day_index, hour_index
from ..operators import density as D
from ..operators import posterior as P

MAP_HOURS = (1, 37)


def hours_of_interest(df: DataFrame, hours, column: str = "hour") -> DataFrame:
    return df.where(F.col(column).isin(*hours))


def every_kth(df: DataFrame, column: str, k: int, keep_first: bool = False) -> DataFrame:
    """Rows whose index is a multiple of ``k`` (and, if asked, index 1)."""
    hit = F.col(column) % k == 0
    return df.where(hit | (F.col(column) == 1) if keep_first else hit)


def attach_to_zones(zones: DataFrame, surface: DataFrame, hours=MAP_HOURS, value: str = "value"):
    """Every zone at every mapped hour; zones without a value keep NULL."""
    layer = zones.select("zone").withColumn(
        "hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    return layer.join(surface.select("zone", "hour", value), ["zone", "hour"], "left")


def _limited(surface: DataFrame, zones: DataFrame, hours, digits, pad) -> DataFrame:
    """Map rows with the colour limits shared by the mapped hours."""
    part = hours_of_interest(surface, hours)
    lo = part.agg(F.round(F.min("value"), digits) - pad).scalar()
    hi = part.agg(F.round(F.max("value"), digits) + pad).scalar()
    return attach_to_zones(zones, part, hours).withColumns({
        "timelabel": bin_label(F.col("hour"), "12h"), "min_val": lo, "max_val": hi})


def exceedance_map(points: DataFrame, zones: DataFrame, level: float, hours=MAP_HOURS):
    """Probability of reaching ``level``, per zone at the mapped hours.

    ``points``: zone, hour, x, prob. The hours are selected before aggregation.
    """
    wanted = hours_of_interest(points, hours)
    tails = D.tail_probability(wanted, (level,), ("zone", "hour"))
    surface = tails.select("zone", "hour", F.round("tail_prob", 2).alias("value"))
    return _limited(surface, zones, hours, 3, 0.001)


def quantile_map(leaves: DataFrame, zones: DataFrame, level: float, hours=MAP_HOURS):
    """Density quantile per zone. ``leaves``: zone, hour, leaf, leaf_lo, leaf_up, prob."""
    q = D.density_quantile(hours_of_interest(leaves, hours), (level,), ("zone", "hour"))
    return _limited(q.select("zone", "hour", "value"), zones, hours, 2, 0.01)


def iqr_map(leaves: DataFrame, zones: DataFrame, hours=MAP_HOURS):
    """Interquartile range of the density per zone."""
    q = D.density_quantile(hours_of_interest(leaves, hours), (0.25, 0.75), ("zone", "hour"))
    iqr = P.quantile_range(q, ("zone", "hour")).withColumnRenamed("iqr", "value")
    return _limited(iqr, zones, hours, 2, 0.01)


def uncertainty_map(samples: DataFrame, zones: DataFrame, level: float | None = None,
                    quantile: float | None = None, hours=MAP_HOURS, bounded: bool = True):
    """Width of the 5-95% interval over samples, of a tail probability or a quantile.

    ``samples``: zone, hour, sim, leaf, leaf_lo, leaf_up, prob.
    """
    part = hours_of_interest(samples, hours)
    keys = ("zone", "hour", "sim")
    if level is not None:
        each = D.tail_probability(part, (level,), keys, x="leaf_up").withColumnRenamed(
            "tail_prob", "v")
    else:
        each = D.density_quantile(part, (quantile,), keys).withColumnRenamed("value", "v")
    width = P.credible_width(each, ("zone", "hour"), "v", bounded=bounded)
    surface = width.withColumnRenamed("width", "value")
    digits, pad = (4, 0.0001) if level is not None else (2, 0.1)
    return _limited(surface, zones, hours, digits, pad)


def count_labels(vertices: DataFrame) -> DataFrame:
    """Labels and sort keys of the ride count of every vertex."""
    return vertices.withColumns({
        "iszero": F.col("node_counts") == 0,
        "lab": F.concat(F.lit("n="), F.col("node_counts").cast("string")),
        "wday": day_index(F.col("hour")), "hour_of_day": hour_index(F.col("hour"))})


def site_extract(points: DataFrame, sites: DataFrame, ranks: DataFrame) -> DataFrame:
    """Density rows of named zones, with each zone's row number in the zone order."""
    named = sites.join(ranks.select("zone", (F.col("zone_rank") + 1).alias("row")), "zone")
    return points.join(named, "zone")


def density_bands(samples: DataFrame, widths: DataFrame, keys=("zone", "hour")) -> DataFrame:
    """(keys, x_num, q05, q50, q95): bands of the density over samples.

    ``samples``: keys, sim, leaf, prob, a fixed number of samples a key; ``widths``: x_num, width.
    """
    steps = F.broadcast(widths.select("x_num", "width"))  # one row per evaluation point: a tree parameter
    dens = samples.withColumn("x_num", F.col("leaf") + 2).join(steps, "x_num").withColumn(
        "density", F.col("prob") / F.col("width"))
    return P.posterior_bands(dens, keys, prob="density", bounded=True)


def site_report(points: DataFrame, vertices: DataFrame, sites: DataFrame, widths: DataFrame,
                bands: DataFrame | None = None, hours=MAP_HOURS) -> DataFrame:
    """Density of named zones at chosen hours beside band, mean, counts and global curve.

    ``points``: zone, hour, x_num, x, prob over all zones (the global curve uses
    them all); ``widths``: x_num, width, midpoint; ``bands``: zone, hour, x_num,
    q05, q95 of the density.
    """
    # One row per evaluation point: a tree parameter.
    steps = F.broadcast(widths.select("x_num", "width", "midpoint"))
    dens = points.join(steps, "x_num").withColumn("density", F.col("prob") / F.col("width"))
    overall = D.geometric_mean_density(dens, "density").withColumnRenamed("prob", "global_density")
    chosen = hours_of_interest(dens.join(sites, "zone"), hours)
    means = D.expected_value(chosen, ("zone", "hour"), "midpoint", "mean")
    labels = count_labels(vertices).select("zone", "hour", "lab", "iszero", "wday", "hour_of_day")
    out = (
        chosen.join(means, ["zone", "hour"]).join(labels, ["zone", "hour"], "left")
        .join(F.broadcast(overall), "x_num", "left")
        .withColumn("timelabel", bin_label(F.col("hour"), "12h"))
    )
    if bands is not None:
        out = out.join(bands.select("zone", "hour", "x_num", "q05", "q95"),
                       ["zone", "hour", "x_num"], "left")
    return out.drop("width", "midpoint", "prob")


def outlier_suffix(df: DataFrame, columns=("task_space", "task_time"), flag: str = "outliers"):
    """Task names marked when outliers were injected."""
    tail = F.when(F.col(flag), "+outliers").otherwise("")
    return df.withColumns({c: F.concat(F.col(c), tail) for c in columns})


def enrich(df: DataFrame, *dimensions) -> DataFrame:
    """Left joins with (table, key columns) pairs, one after the other."""
    for table, on in dimensions:
        df = df.join(table, list(on), "left")
    return df
