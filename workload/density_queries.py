"""Log-odds to densities, tail probabilities, quantiles; summaries over samples."""

from pyspark.sql import functions as F

from zonehour.functions import likelihood as L
from zonehour.operators import counts as C
from zonehour.operators import density as D
from zonehour.operators import posterior as P
from zonehour.operators import quantiles as Q
from zonehour.operators import reshape as H
from zonehour.operators import splits as T

from . import standins as X
from .registry import query, r, rounded, rs
from .tree_queries import tree

BY_ZONE_COUNTS = f"""{X.TREE}, {X.counts_sql('cells', 'zone')},
 zs AS (SELECT cast(s_suppkey AS integer) AS zone FROM supplier), {X.dense_sql('zs', 'zone')}"""
BY_ZONE = f"""{BY_ZONE_COUNTS},
 {X.betas_sql('dense')}, {X.leaves_sql('betas', 'zone')}"""
BY_PLACE = f"""{X.TREE}, {X.counts_sql('cells', 'zone, hour')}, {X.PLACES}, {X.dense_sql('places', 'zone, hour')},
 {X.betas_sql('dense')}, {X.leaves_sql('betas', 'zone, hour')}"""


def raw_betas(counts):
    s, n = L.pseudo_counts(F.col("successes"), F.col("attempts"))
    return counts.withColumn("beta", L.logit(s, n)).drop("successes", "attempts")


def betas(spark, sf, keys, cells, splits):
    """Unsmoothed log-odds of every key at every split."""
    return raw_betas(C.split_counts(X.cells(spark, sf), splits, keys=keys, vertices=cells))


def zone_leaves(spark, sf):
    splits = tree(spark, sf)
    b = betas(spark, sf, ("zone",), X.zone_grid(spark, sf), splits)
    return D.leaf_probabilities(b, splits, ("zone",)), splits


def place_leaves(spark, sf):
    splits = tree(spark, sf)
    b = betas(spark, sf, ("zone", "hour"), X.places(spark, sf), splits)
    return D.leaf_probabilities(b, splits, ("zone", "hour")), splits


@query("leaf_probabilities", f"WITH {BY_ZONE} SELECT zone, leaf, {rs('leaf_lo', 'leaf_up', 'prob')} FROM leaves")
def leaf_probabilities(spark, sf):
    return rounded(zone_leaves(spark, sf)[0].drop("log_prob"))


@query("leaf_probabilities_samples", f"""WITH {X.TREE}, {X.counts_sql('cells', 'zone, sim')},
  zs AS (SELECT DISTINCT zone, sim FROM cells), {X.dense_sql('zs', 'zone, sim')}, {X.betas_sql('dense')},
  {X.leaves_sql('betas', 'zone, sim')} SELECT zone, sim, leaf, {rs('prob')} FROM leaves""")
def leaf_probabilities_samples(spark, sf):
    splits = tree(spark, sf)
    pairs = X.cells(spark, sf).select("zone", "sim").distinct()
    b = betas(spark, sf, ("zone", "sim"), pairs, splits)
    return rounded(D.leaf_probabilities(b, splits, ("zone", "sim")).select(
        "zone", "sim", "leaf", "prob"))


@query("normalize_mass", f"""WITH {BY_ZONE} SELECT zone, leaf, {r('prob / sum(prob) OVER (PARTITION BY zone)', 'prob')} FROM leaves""")
def normalize_mass(spark, sf):
    return rounded(D.normalize_mass(zone_leaves(spark, sf)[0], ["zone"]).select("zone", "leaf", "prob"))


@query("point_probabilities", f"""WITH {BY_ZONE}, p AS (SELECT zone, leaf + 2 AS x_num, leaf_up AS x, prob FROM leaves
   UNION ALL SELECT zone, 1, leaf_lo, prob FROM leaves WHERE leaf = 0)
   SELECT zone, cast(x_num AS integer) AS x_num, {rs('x')}, {r('prob / sum(prob) OVER (PARTITION BY zone)', 'prob')} FROM p""")
def point_probabilities(spark, sf):
    return rounded(D.point_probabilities(zone_leaves(spark, sf)[0], ("zone",), compat=True))


@query("support_mask", f"""WITH {BY_ZONE} SELECT zone, leaf, CASE WHEN leaf_up BETWEEN 20 AND 100 THEN
   {r('prob', 'x')[:-5]} ELSE 0.0::double END AS prob FROM leaves""")
def support_mask(spark, sf):
    leaves = zone_leaves(spark, sf)[0]
    return rounded(D.support_mask(leaves, "leaf_up", F.lit(20.0), F.lit(100.0)).select(
        "zone", "leaf", "prob"))


@query("running_cdf", f"WITH {BY_ZONE} SELECT zone, leaf, {r('sum(prob) OVER (PARTITION BY zone ORDER BY leaf)', 'cdf')} FROM leaves")
def running_cdf(spark, sf):
    return rounded(D.running_cdf(zone_leaves(spark, sf)[0], ["zone"], "leaf").select(
        "zone", "leaf", "cdf"))


@query("density", f"WITH {BY_ZONE} SELECT zone, leaf, {r('prob / (leaf_up - leaf_lo)', 'density')} FROM leaves")
def density(spark, sf):
    return rounded(D.density(zone_leaves(spark, sf)[0]).select("zone", "leaf", "density"))


_AT = f"""{BY_ZONE}, cutl AS (SELECT list(x ORDER BY x_num) AS cuts FROM pts),
  placed AS (SELECT ride_id, zone, hour, least(len(list_filter(cuts, lambda c: c <= productivity)), len(cuts) - 1) - 1 AS leaf FROM cells, cutl),
  dens AS (SELECT ride_id, zone, hour, ln(prob / (leaf_up - leaf_lo)) AS log_density FROM placed JOIN leaves USING (zone, leaf))"""


@query("log_density_at", f"WITH {_AT} SELECT ride_id, zone, {rs('log_density')} FROM dens")
def log_density_at(spark, sf):
    leaves, splits = zone_leaves(spark, sf)
    return rounded(D.log_density_at(
        X.cells(spark, sf), leaves, splits, "productivity", ("zone",)).select(
        "ride_id", "zone", "log_density"))


_LEVELS = "18.56, 21.64, 32.73, 34.74"


@query("tail_probability", f"""WITH {BY_PLACE} SELECT zone, hour, level, {r('sum(CASE WHEN leaf_up >= level THEN prob ELSE 0 END)', 'tail_prob')}
   FROM leaves, (SELECT unnest([{_LEVELS}])::double AS level) GROUP BY zone, hour, level""")
def tail_probability(spark, sf):
    leaves, _ = place_leaves(spark, sf)
    points = D.point_probabilities(leaves, ("zone", "hour"))
    return rounded(D.tail_probability(points, keys=("zone", "hour")))


_CDF = """cdf AS (SELECT *, sum(prob) OVER (PARTITION BY zone, hour ORDER BY leaf) AS cum FROM leaves),
  quant AS (SELECT zone, hour, level, arg_min(leaf_lo + (level - (cum - prob)) / prob * (leaf_up - leaf_lo), leaf) AS value
    FROM cdf, (SELECT unnest([0.1, 0.25, 0.5, 0.75])::double AS level) WHERE cum >= level - 1e-12 GROUP BY ALL)"""


@query("density_quantile", f"WITH {BY_PLACE}, {_CDF} SELECT zone, hour, level, {rs('value')} FROM quant")
def density_quantile(spark, sf):
    return rounded(D.density_quantile(place_leaves(spark, sf)[0], keys=("zone", "hour")))


@query("quantile_range", f"""WITH {BY_PLACE}, {_CDF} SELECT zone, hour, {r('max(value) FILTER (level = 0.75) - max(value) FILTER (level = 0.25)', 'iqr')}
   FROM quant GROUP BY zone, hour""")
def quantile_range(spark, sf):
    q = D.density_quantile(place_leaves(spark, sf)[0], (0.25, 0.75), ("zone", "hour"))
    return rounded(P.quantile_range(q, ("zone", "hour")))


@query("share_where", f"""WITH {BY_PLACE}, {_CDF} SELECT {r('avg(CASE WHEN value < 10 THEN 1.0::double ELSE 0 END)', 'share')} FROM quant WHERE level = 0.1""")
def share_where(spark, sf):
    q = D.density_quantile(place_leaves(spark, sf)[0], (0.1,), ("zone", "hour"))
    return rounded(Q.share_where(q, F.col("value") < 10))


@query("surface_limits", f"""WITH {BY_PLACE}, t AS (SELECT zone, hour, sum(CASE WHEN leaf_up >= 21.64 THEN prob ELSE 0 END) AS v FROM leaves GROUP BY ALL)
   SELECT {r('round(min(v), 3) - 0.001', 'min_val')}, {r('round(max(v), 3) + 0.001', 'max_val')} FROM t""")
def surface_limits(spark, sf):
    points = D.point_probabilities(place_leaves(spark, sf)[0], ("zone", "hour"))
    tails = D.tail_probability(points, (21.64,), ("zone", "hour"))
    return rounded(Q.surface_limits(tails, "tail_prob", 3, 0.001))


@query("expected_value", f"""WITH {BY_ZONE} SELECT zone, {r('sum(prob * (leaf_lo + leaf_up) / 2)', 'mean')} FROM leaves GROUP BY zone""")
def expected_value(spark, sf):
    leaves, splits = zone_leaves(spark, sf)
    mids = D.bin_widths(T.evaluation_points(splits)).select("x_num", "midpoint")
    points = D.point_probabilities(leaves, ("zone",)).join(mids, "x_num")
    return rounded(D.expected_value(points, ("zone",)))


@query("geometric_mean_density", f"""WITH {BY_ZONE}, g AS (SELECT leaf + 2 AS x_num, exp(avg(ln(prob))) AS p FROM leaves GROUP BY leaf)
   SELECT cast(x_num AS integer) AS x_num, {r('p / sum(p) OVER ()', 'prob')} FROM g""")
def geometric_mean_density(spark, sf):
    points = D.point_probabilities(zone_leaves(spark, sf)[0], ("zone",))
    return rounded(D.geometric_mean_density(points))


@query("binomial_columns", f"""WITH {X.TREE}, {X.counts_sql('cells', 'zone')},
  b AS (SELECT zone, split_id, successes::double AS s, attempts::double AS n,
        ln((successes + 1e-3) / (attempts + 2e-3 - successes - 1e-3)) AS beta FROM counts)
  SELECT zone, split_id, {r('s + 1e-5', 'pseudo_s')}, {r('n + 2e-5', 'pseudo_n')}, {rs('beta')},
   {r('1 / (1 + exp(-beta))', 'p')}, {r('1 - s / (n + 1e-6)', 'raw')},
   {r('CASE WHEN beta >= 0 THEN -n * ln(1 + exp(-beta)) - (n - s) * beta ELSE s * beta - n * ln(1 + exp(beta)) END', 'loglik', 4)}
  FROM b""")
def binomial_columns(spark, sf):
    counts = C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone",))
    s, n = F.col("successes").cast("double"), F.col("attempts").cast("double")
    ps, pn = L.pseudo_counts(s, n, 1e-5)
    s3, n3 = L.pseudo_counts(s, n)
    out = counts.withColumn("beta", L.logit(s3, n3))
    out = out.select(
        "zone", "split_id", ps.alias("pseudo_s"), pn.alias("pseudo_n"), "beta",
        L.logistic(F.col("beta")).alias("p"), L.raw_rate(s, n).alias("raw"),
        F.round(L.binomial_loglik(s, n, F.col("beta")), 4).alias("loglik"))
    return rounded(out)


@query("penalty_columns", f"""WITH {X.SEARCH} SELECT runid, {r('3.0::double * (CASE WHEN gen % 2 = 1 THEN lam_t1 ELSE lam_s1 END)', 'l1')},
  {r('log10(lam_s2)', 'log_s2')}, {r('lam_s1 * pow(2.0::double, 0.25 * floor(log2(split_id + 1)))', 'by_power')},
  {r('lam_s1 * (1 + floor(log2(split_id + 1)) * sqrt(2.0::double))', 'by_level')} FROM runs""")
def penalty_columns(spark, sf):
    runs, c = X.search_runs(spark, sf), F.col
    return rounded(runs.select(
        "runid", L.penalty_weight(F.lit(3.0), c("gen") % 2 == 1, c("lam_s1"), c("lam_t1")).alias("l1"),
        F.log10("lam_s2").alias("log_s2"),
        L.level_scaled_penalty(c("lam_s1"), c("split_id") + 1, "power").alias("by_power"),
        L.level_scaled_penalty(c("lam_s1"), c("split_id") + 1, "linear").alias("by_level")))


_ERR = X.CHAIN + """,
  m AS (SELECT site, x_num, avg(prob) AS q FROM chain GROUP BY ALL),
  w AS (SELECT *, (CASE WHEN x_num IN (1, 64) THEN 0.5 ELSE 1 END)::double / 64 AS weight, x_num / 64 AS x FROM chain JOIN m USING (site, x_num))
"""


def _curves(spark, sf):
    ch = X.chain(spark, sf)
    grid = ch.select("x_num").distinct().withColumn("x", F.col("x_num") / 64)
    mean = ch.groupBy("site", "x_num").agg(F.avg("prob").alias("q"))
    return ch.join(mean, ["site", "x_num"]).join(D.trapezoid_weights(grid), "x_num")


@query("integrated_errors", f"""WITH {_ERR} SELECT site, {r('sqrt(avg(ise))', 'rmise', 8)}, {r('avg(iae)', 'miae', 8)} FROM
   (SELECT site, sim, sum(weight * pow(prob - q, 2)) AS ise, sum(weight * abs(prob - q)) AS iae FROM w GROUP BY ALL) GROUP BY site""")
def integrated_errors(spark, sf):
    return rounded(D.integrated_errors(_curves(spark, sf), "prob", "q", ("site",), "sim"), 8)


@query("density_mean", f"WITH {_ERR} SELECT site, sim, {r('sum(weight * x * prob * 64)', 'mean')} FROM w GROUP BY ALL")
def density_mean(spark, sf):
    curves = _curves(spark, sf).withColumn("density", F.col("prob") * 64)
    return rounded(D.density_mean(curves, ("site", "sim")))


# --- summaries over samples --------------------------------------------------------

_BANDS = ", ".join(f"quantile_cont(prob, {q}) AS q{n}" for n, q in (
    ("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95)))


@query("melt", f"WITH {X.CHAIN} SELECT sim, x_num, {r('e', 'value')} FROM (SELECT sim, cast(x_num AS integer) AS x_num, e FROM ch0)")
def melt(spark, sf):
    e = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sim"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(H.melt(e, "v", "x_num", "value"))


@query("to_arrays", f"WITH {X.CHAIN} SELECT site, sim, list(round(prob, 6) ORDER BY x_num) AS probs FROM chain GROUP BY site, sim")
def to_arrays(spark, sf):
    ch = X.chain(spark, sf).withColumn("prob", F.round("prob", 6))
    return H.to_arrays(ch, ["site", "sim"], "x_num", "prob", "probs")


@query("slice_sites", f"WITH {X.CHAIN} SELECT site, sim, x_num, {rs('prob')} FROM chain WHERE site IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def slice_sites(spark, sf):
    some = X.table(spark, sf, "nation").where("n_regionkey = 1").select(
        F.col("n_nationkey").alias("site"))
    return rounded(H.slice_sites(X.chain(spark, sf), some, "site"))


@query("posterior_bands", f"WITH {X.CHAIN}, b AS (SELECT site, x_num, {_BANDS} FROM chain GROUP BY ALL) SELECT site, x_num, {rs('q05', 'q50', 'q95')} FROM b")
def posterior_bands(spark, sf):
    return rounded(P.posterior_bands(X.chain(spark, sf), ("site",)))


_SCALED = ", ".join(f"{c} / sum({c}) OVER (PARTITION BY site) AS {c}" for c in
                    ("q05", "q25", "q50", "q75", "q95", "mean"))


@query("posterior_bands_scaled", f"""WITH {X.CHAIN}, b AS (SELECT site, x_num, {_BANDS}, avg(prob) AS mean FROM chain GROUP BY ALL),
   s AS (SELECT site, x_num, {_SCALED} FROM b)
   SELECT site, x_num, {rs('q05', 'q25', 'q50', 'q75', 'q95', 'mean')}, {r('q75 - q25', 'iqr')} FROM s""")
def posterior_bands_scaled(spark, sf):
    return rounded(P.posterior_bands(X.chain(spark, sf), ("site",), renormalize=True))


@query("tail_mass_bands", f"""WITH {X.CHAIN}, t AS (SELECT site, sim, sum(prob) AS prob FROM chain WHERE x_num < 20 GROUP BY ALL)
   SELECT site, {r('quantile_cont(prob, 0.05)', 'q05')}, {r('quantile_cont(prob, 0.5)', 'q50')}, {r('quantile_cont(prob, 0.95)', 'q95')} FROM t GROUP BY site""")
def tail_mass_bands(spark, sf):
    return rounded(P.tail_mass_bands(X.chain(spark, sf), ("site",), 20, x="x_num"))


@query("extreme_over_samples", f"""WITH {X.CHAIN}, e AS (SELECT sim, max(prob) AS a, min(prob) AS b FROM chain GROUP BY sim)
   SELECT {r('avg(a)', 'max')}, {r('quantile_cont(a, 0.95)', 'maxq95')}, {r('quantile_cont(a, 0.05)', 'maxq05')},
   {r('avg(b)', 'min')}, {r('quantile_cont(b, 0.95)', 'minq95')}, {r('quantile_cont(b, 0.05)', 'minq05')} FROM e""")
def extreme_over_samples(spark, sf):
    return rounded(P.extreme_over_samples(X.chain(spark, sf), "prob"))


@query("posterior_iqr", f"""WITH {X.CHAIN}, b AS (SELECT site, x_num, {_BANDS} FROM chain GROUP BY ALL),
   i AS (SELECT *, q75 - q25 AS iqr FROM b)
   SELECT site, x_num, {rs('q25', 'q50', 'q75', 'iqr')}, {r('(iqr - min(iqr) OVER ()) / (max(iqr) OVER () - min(iqr) OVER ())', 'iqr_scaled')} FROM i""")
def posterior_iqr(spark, sf):
    return rounded(P.posterior_iqr(X.chain(spark, sf), ("site", "x_num"), "prob"))


@query("credible_width", f"""WITH {X.CHAIN}, t AS (SELECT site, sim, sum(prob) AS prob FROM chain WHERE x_num >= 40 GROUP BY ALL)
   SELECT site, {r('quantile_cont(prob, 0.95) - quantile_cont(prob, 0.05)', 'width')} FROM t GROUP BY site""")
def credible_width(spark, sf):
    tails = X.chain(spark, sf).where(F.col("x_num") >= 40).groupBy("site", "sim").agg(
        F.sum("prob").alias("prob"))
    return rounded(P.credible_width(tails, ("site",), "prob"))
