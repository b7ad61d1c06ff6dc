"""Quantiles, histograms, split trees and split counts."""

from pyspark.sql import functions as F

from zonehour.operators import counts as C
from zonehour.operators import quantiles as Q
from zonehour.operators import splits as T
from zonehour.operators.density import bin_widths
from zonehour.operators.reshape import union_tables
from zonehour.sources.shared import save_round

from . import standins as X
from .registry import query, r, rounded, rs

_TREE_COLS = f"split_id, lvl, {rs('lo', 'mid', 'up')}"


def tree(spark, sf):
    """Quantile tree of the observations, stored so that its cuts are computed once."""
    return save_round(T.quantile_splits(X.cells(spark, sf), "productivity", top=None), "tree")


_PROBS = sorted(set(T.dyadic_probs(5, 6) + T.dyadic_probs(5)))


@query("global_quantiles", f"""WITH {X.CELLS} SELECT {r('unnest(' + repr(_PROBS) + ')', 'prob')},
  {r('unnest(quantile_cont(productivity, ' + repr(_PROBS) + '))', 'quantile')} FROM cells""")
def global_quantiles(spark, sf):
    """Both probability families, located by counting even though the data would fit a task."""
    return rounded(Q.exact_quantiles(X.cells(spark, sf), "productivity", _PROBS, gather_limit=0))


@query("keyed_quantiles", f"""WITH {X.CELLS} SELECT zone, {r('quantile_cont(productivity, 0.05)', 'q05')},
  {r('quantile_cont(productivity, 0.5)', 'q50')}, {r('quantile_cont(productivity, 0.95)', 'q95')}
  FROM cells GROUP BY zone""")
def keyed_quantiles(spark, sf):
    return rounded(Q.quantile_columns(
        X.cells(spark, sf), "productivity", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, ["zone"],
        gather_limit=0))


@query("level_cuts", f"""WITH {X.CELLS}, l AS (SELECT list_concat([0.0], list_concat(
   quantile_cont(productivity, {T.dyadic_probs(5, 6)!r}), [125.0])) AS t FROM cells)
  SELECT cast(generate_subscripts(t, 1) AS integer) AS k, {r('unnest(t)', 'cut')} FROM l""")
def level_cuts(spark, sf):
    cuts = T.level_cuts(X.cells(spark, sf), "productivity", T.dyadic_probs(5, 6), 0, 125)
    return rounded(cuts.select(F.posexplode("cuts").alias("k", "cut")).withColumn(
        "k", F.col("k") + 1))


@query("trail_levels", f"""WITH {X.CELLS}, l AS (SELECT list_concat([0.0], list_concat(
   quantile_cont(productivity, {T.dyadic_probs(5, 6)!r}), [125.0])) AS t FROM cells),
  d AS (SELECT t, l AS lvl, cast(pow(2, 4 - l) AS bigint) AS d,
     unnest(generate_series(0, cast(pow(2, l) AS bigint) - 1)) AS j
     FROM (SELECT t, unnest(generate_series(0, 4)) AS l FROM l)),
  s AS (SELECT cast(lvl AS integer) AS lvl, t[2*j*d+1] AS lo, t[2*j*d+d+1] AS mid, t[2*j*d+2*d+1] AS up FROM d)
  SELECT cast(row_number() OVER (ORDER BY lvl, lo) - 1 AS integer) AS split_id, lvl, {rs('lo', 'mid', 'up')} FROM s""")
def trail_levels(spark, sf):
    cuts = T.level_cuts(X.cells(spark, sf), "productivity", T.dyadic_probs(5, 6), 0, 125)
    return rounded(T.trail_levels(cuts, 5))


@query("value_range", f"""WITH {X.CELLS} SELECT {r('min(productivity)', 'min_val')},
  {r('max(productivity)', 'max_val')}, {r('max(productivity) - min(productivity)', 'range_val')} FROM cells""")
def value_range(spark, sf):
    return rounded(Q.value_range(X.cells(spark, sf), "productivity"))


def _hist(bins):
    return f"""SELECT cast(least(floor((productivity - lo) / ((hi - lo) / {bins})), {bins - 1}) AS integer) AS bin,
      count(*)::bigint AS n FROM cells, (SELECT min(productivity) AS lo, max(productivity) AS hi FROM cells)
      GROUP BY 1"""


@query("histogram_45", f"WITH {X.CELLS} {_hist(45)}")
def histogram_45(spark, sf):
    return Q.histogram(X.cells(spark, sf), "productivity", 45)


@query("histogram_30", f"WITH {X.CELLS} {_hist(30)}")
def histogram_30(spark, sf):
    return Q.histogram(X.cells(spark, sf), "productivity", 30)


@query("quantile_split_tree", f"WITH {X.TREE} SELECT {_TREE_COLS} FROM tree")
def quantile_split_tree(spark, sf):
    return rounded(T.quantile_splits(X.cells(spark, sf), "productivity", top=None))


@query("uniform_split_tree", f"""WITH {X.CELLS}, b AS (SELECT max(productivity) AS hi FROM cells),
  n AS (SELECT hi, l, unnest(generate_series(0, cast(pow(2, l) AS bigint) - 1)) AS j,
        cast(pow(2, 5 - l) AS bigint) AS d FROM (SELECT hi, unnest(generate_series(0, 4)) AS l FROM b)),
  s AS (SELECT cast(l AS integer) AS lvl, hi * (j * d / 32) AS lo, hi * ((j * d + d / 2) / 32) AS mid,
        hi * ((j + 1) * d / 32) AS up FROM n)
  SELECT cast(row_number() OVER (ORDER BY lvl, lo) - 1 AS integer) AS split_id, lvl, {rs('lo', 'mid', 'up')} FROM s""")
def uniform_split_tree(spark, sf):
    bounds = X.cells(spark, sf).agg(F.lit(0.0).alias("lo"), F.max("productivity").alias("hi"))
    return rounded(T.uniform_splits(bounds, 5))


@query("dyadic_histogram_tree", f"""WITH {X.CELLS},
  b AS (SELECT min(productivity) AS lo, max(productivity) AS hi FROM cells),
  f AS (SELECT lo, hi, cast(least(floor((productivity - lo) / (hi - lo) * 64), 63) AS bigint) AS leaf FROM cells, b),
  n AS (SELECT lo, hi, lvl, leaf // cast(pow(2, 6 - lvl) AS bigint) AS node, count(*)::bigint AS n
        FROM (SELECT lo, hi, leaf, unnest(generate_series(0, 5)) AS lvl FROM f)
        GROUP BY ALL HAVING count(*) >= 200),
  s AS (SELECT cast(lvl AS integer) AS lvl, lo + (hi - lo) / pow(2, lvl) * node AS lo,
        lo + (hi - lo) / pow(2, lvl) * (node + 0.5) AS mid, lo + (hi - lo) / pow(2, lvl) * (node + 1) AS up, n FROM n)
  SELECT cast(row_number() OVER (ORDER BY lvl, lo) - 1 AS integer) AS split_id, lvl, {rs('lo', 'mid', 'up', digits=5)}, n FROM s""")
def dyadic_histogram_tree(spark, sf):
    return rounded(T.dyadic_histogram_tree(X.cells(spark, sf), "productivity", 6, 200), 5)


@query("union_split_families", f"""WITH {X.TREE}
  SELECT {r('unnest(quantile_cont(productivity, ' + repr(T.dyadic_probs(5)) + '))', 'val')}, '(B) Quantiles' AS type FROM cells
  UNION ALL SELECT {r('mid', 'val')}, '(C) Extended quantiles' FROM tree
  UNION ALL SELECT {r('max_p * k / 32', 'val')}, '(A) Uniform' FROM
    (SELECT max(productivity) AS max_p FROM cells), generate_series(1, 31) g(k)""")
def union_split_families(spark, sf):
    cells = X.cells(spark, sf)
    plain = Q.exact_quantiles(cells, "productivity", T.dyadic_probs(5)).select(
        F.col("quantile").alias("val"), F.lit("(B) Quantiles").alias("type"))
    extended = T.quantile_splits(cells, "productivity", top=None).select(
        F.col("mid").alias("val"), F.lit("(C) Extended quantiles").alias("type"))
    bounds = cells.agg(F.lit(0.0).alias("lo"), F.max("productivity").alias("hi"))
    even = T.uniform_splits(bounds, 5).select(
        F.col("mid").alias("val"), F.lit("(A) Uniform").alias("type"))
    return rounded(union_tables(plain, extended, even))


@query("evaluation_points", f"WITH {X.TREE} SELECT x_num, {rs('x')} FROM pts")
def evaluation_points(spark, sf):
    return rounded(T.evaluation_points(tree(spark, sf)))


@query("bin_widths", f"""WITH {X.TREE} SELECT x_num, {rs('x')},
   {r('coalesce(x - lag(x) OVER w, lead(x) OVER w - x)', 'width')},
   {r('coalesce((x + lag(x) OVER w) / 2, x)', 'midpoint')} FROM pts WINDOW w AS (ORDER BY x_num)""")
def widths(spark, sf):
    return rounded(bin_widths(T.evaluation_points(tree(spark, sf))))


@query("split_paths", f"WITH {X.TREE} SELECT leaf, {rs('leaf_lo', 'leaf_up')}, split_id, side FROM paths")
def split_paths(spark, sf):
    return rounded(T.split_paths(tree(spark, sf)))


@query("split_counts", f"WITH {X.TREE}, {X.counts_sql('cells', 'zone, hour')} SELECT * FROM counts")
def split_counts(spark, sf):
    return C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone", "hour"))


def _closed(low, high):
    return f"""SELECT zone, split_id,
      sum(CASE WHEN productivity {high} mid THEN 1 ELSE 0 END)::bigint AS successes, count(*)::bigint AS attempts
      FROM cells JOIN tree ON productivity {low} lo AND productivity {high} up"""


@query("split_counts_right", f"""WITH {X.TREE} {_closed('>', '<=')}
    OR (productivity = lo AND lo = (SELECT min(lo) FROM tree)) GROUP BY ALL""")
def split_counts_right(spark, sf):
    return C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone",), closed="right")


@query("split_counts_open", f"WITH {X.TREE} {_closed('>', '<')} GROUP BY ALL")
def split_counts_open(spark, sf):
    return C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone",), closed="neither")


@query("split_counts_dense", f"""WITH {X.TREE}, {X.counts_sql('cells', 'zone')}
  SELECT s_suppkey::integer AS zone, split_id, coalesce(successes, 0)::bigint AS successes,
   coalesce(attempts, 0)::bigint AS attempts
  FROM (supplier CROSS JOIN tree) d LEFT JOIN counts ON counts.zone = d.s_suppkey AND counts.split_id = d.split_id
  """.replace("split_id, coalesce", "d.split_id, coalesce", 1))
def split_counts_dense(spark, sf):
    return C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone",),
                          vertices=X.zone_grid(spark, sf))


@query("split_totals", f"""WITH {X.TREE}, {X.counts_sql('cells', 'zone')}
  SELECT tree.split_id, lvl, {rs('lo', 'mid', 'up')}, coalesce(sum(successes), 0)::bigint AS successes,
   coalesce(sum(attempts), 0)::bigint AS attempts FROM tree LEFT JOIN counts USING (split_id) GROUP BY ALL
  """.replace("tree.split_id", "split_id"))
def split_totals(spark, sf):
    splits = tree(spark, sf)
    return rounded(C.split_totals(C.split_counts(X.cells(spark, sf), splits, keys=("zone",)), splits))


@query("missing_mask", f"""WITH {X.TREE}, {X.counts_sql('cells', 'zone')}
  SELECT zone, split_id, CASE WHEN s_acctbal < 1000 THEN 0 ELSE successes END::bigint AS successes,
    CASE WHEN s_acctbal < 1000 THEN 0 ELSE attempts END::bigint AS attempts, s_acctbal < 1000 AS missing
  FROM counts JOIN supplier ON zone = s_suppkey""")
def missing_mask(spark, sf):
    counts = C.split_counts(X.cells(spark, sf), tree(spark, sf), keys=("zone",))
    balance = X.zone_grid(spark, sf).select("zone", "s_acctbal")
    masked = C.missing_mask(counts.join(balance, "zone"), F.col("s_acctbal") < 1000)
    return masked.drop("s_acctbal")
