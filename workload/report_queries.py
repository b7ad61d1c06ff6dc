"""Maps, site reports, search report, benchmark tables."""

from pyspark.sql import functions as F

from zonehour.operators import density as D
from zonehour.operators import graph as G
from zonehour.operators import ranking as K
from zonehour.operators import reshape as H
from zonehour.operators import splits as T
from zonehour.operators import validation as V
from zonehour.plans import reports as M
from zonehour.plans.densities import bootstrap_leaves, with_place
from zonehour.plans.search import search_report

from . import standins as X
from .density_queries import _CDF, BY_PLACE, place_leaves
from .graph_queries import RANKS, VERTEX_TABLE, grid_cells, ranks, vertices, _CELLGRID
from .registry import query, r, rounded, rs
from .tree_queries import tree

RICH = 9000  # zones with a larger account balance are the named sites


def sites(spark, sf):
    s = X.table(spark, sf, "supplier").where(F.col("s_acctbal") > RICH)
    return s.select(F.col("s_suppkey").cast("int").alias("zone"), F.col("s_name").alias("site_name"))


_SITES = f"sites AS (SELECT cast(s_suppkey AS integer) AS zone, s_name AS site_name FROM supplier WHERE s_acctbal > {RICH})"
_WIDE = """(CASE WHEN (hour - 1) % 24 % 12 = 0 THEN 12 ELSE (hour - 1) % 24 % 12 END) ||
   (CASE WHEN (hour - 1) % 24 < 12 THEN 'AM' ELSE 'PM' END)"""
_LABEL12 = f"['Sun','Mon','Tu','Wed','Th','Fr','Sat'][(hour - 1) // 24 + 1] || ' ' || {_WIDE}"


def _map_sql(surface: str, digits: int, pad: float, with_: str) -> str:
    return f"""WITH {with_}, surface AS ({surface}),
      lim AS (SELECT round(min(value), {digits}) - {pad} AS lo, round(max(value), {digits}) + {pad} AS hi FROM surface),
      layer AS (SELECT cast(s_suppkey AS integer) AS zone, cast(h AS integer) AS hour FROM supplier, (SELECT unnest([1, 37]) AS h))
      SELECT zone, hour, {rs('value')}, {_LABEL12} AS timelabel, {r('lo', 'min_val')}, {r('hi', 'max_val')}
      FROM layer LEFT JOIN surface USING (zone, hour), lim"""


@query("exceedance_map", _map_sql("""SELECT zone, hour, round(sum(CASE WHEN leaf_up >= 32.73 THEN prob ELSE 0 END), 2) AS value
   FROM leaves WHERE hour IN (1, 37) GROUP BY ALL""", 3, 0.001, BY_PLACE))
def exceedance_map(spark, sf):
    points = D.point_probabilities(place_leaves(spark, sf)[0], ("zone", "hour"))
    return rounded(M.exceedance_map(points, X.zone_grid(spark, sf), 32.73))


@query("quantile_map", _map_sql("SELECT zone, hour, value FROM quant WHERE level = 0.25 AND hour IN (1, 37)",
                                2, 0.01, f"{BY_PLACE}, {_CDF}"))
def quantile_map(spark, sf):
    return rounded(M.quantile_map(place_leaves(spark, sf)[0], X.zone_grid(spark, sf), 0.25))


@query("iqr_map", _map_sql("""SELECT zone, hour, max(value) FILTER (level = 0.75) - max(value) FILTER (level = 0.25) AS value
   FROM quant WHERE hour IN (1, 37) GROUP BY zone, hour""", 2, 0.01, f"{BY_PLACE}, {_CDF}"))
def iqr_map(spark, sf):
    return rounded(M.iqr_map(place_leaves(spark, sf)[0], X.zone_grid(spark, sf)))


# Bands and uncertainty come from bootstrap samples of the rides, at the mapped hours.
SAMPLES = 20
_BOOTSTRAP = f"""sims AS (SELECT unnest(generate_series(0, {SAMPLES - 1})) AS sim),
  bw AS (SELECT zone, hour, productivity, sims.sim AS sim, {X.poisson_sql('ride_id', '(sims.sim + 1)')} AS n
    FROM (SELECT ride_id, zone, hour, productivity FROM cells WHERE hour IN (1, 37)) c, sims),
  bcounts AS MATERIALIZED (SELECT zone, hour, sim, split_id, sum(CASE WHEN productivity < mid THEN n ELSE 0 END)::bigint AS successes,
    sum(n)::bigint AS attempts FROM bw JOIN tree ON productivity >= lo
      AND (productivity < up OR (productivity = up AND up = (SELECT max(up) FROM tree))) GROUP BY ALL),
  sp AS (SELECT zone, hour, sim FROM places, sims WHERE hour IN (1, 37)),
  {X.dense_sql('sp', 'zone, hour, sim', 'bcounts', 'bdense')}, {X.betas_sql('bdense', 'bbetas')},
  {X.leaves_sql('bbetas', 'zone, hour, sim', 'sleaves')}"""
_SAMPLED = f"{X.TREE}, {X.PLACES}, {_BOOTSTRAP}"


def sample_leaves(spark, sf, splits):
    """Leaf masses per zone, mapped hour and bootstrap sample."""
    mapped = lambda df: M.hours_of_interest(df, M.MAP_HOURS)
    return bootstrap_leaves(mapped(X.cells(spark, sf)), splits, mapped(X.places(spark, sf)), SAMPLES)


@query("uncertainty_map_tail", _map_sql("""SELECT zone, hour, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS value FROM
   (SELECT zone, hour, sim, sum(CASE WHEN leaf_up >= 21.64 THEN prob ELSE 0 END) AS v FROM sleaves GROUP BY ALL) GROUP BY ALL""",
                                        4, 0.0001, _SAMPLED))
def uncertainty_map_tail(spark, sf):
    samples = sample_leaves(spark, sf, tree(spark, sf))
    return rounded(M.uncertainty_map(samples, X.zone_grid(spark, sf), level=21.64))


@query("uncertainty_map_quantile", _map_sql("""SELECT zone, hour, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS value FROM
   (SELECT zone, hour, sim, arg_min(leaf_lo + (0.1 - (cum - prob)) / prob * (leaf_up - leaf_lo), leaf) AS v FROM
     (SELECT *, sum(prob) OVER (PARTITION BY zone, hour, sim ORDER BY leaf) AS cum FROM sleaves) WHERE cum >= 0.1 - 1e-12 GROUP BY ALL)
   GROUP BY ALL""", 2, 0.1, _SAMPLED))
def uncertainty_map_quantile(spark, sf):
    samples = sample_leaves(spark, sf, tree(spark, sf))
    return rounded(M.uncertainty_map(samples, X.zone_grid(spark, sf), quantile=0.1))


@query("attach_to_zones", f"""WITH {X.CELLS}, s AS (SELECT zone, hour, count(*)::bigint AS value FROM cells WHERE hour IN (1, 37) GROUP BY ALL)
   SELECT cast(s_suppkey AS integer) AS zone, cast(h AS integer) AS hour, value FROM (supplier CROSS JOIN (SELECT unnest([1, 37]) AS h)) l
   LEFT JOIN s ON zone = s_suppkey AND hour = h""")
def attach_to_zones(spark, sf):
    counts = G.node_counts(X.cells(spark, sf)).withColumnRenamed("node_counts", "value")
    return M.attach_to_zones(X.zone_grid(spark, sf), counts)


@query("surface_with_vertex", f"""WITH {BY_PLACE}, {RANKS}, {VERTEX_TABLE},
   t AS (SELECT zone, hour, sum(CASE WHEN leaf_up >= 21.64 THEN prob ELSE 0 END) AS tail_prob FROM leaves GROUP BY ALL)
   SELECT zone, hour, vertex, timelabel, node_counts, {rs('tail_prob')} FROM t JOIN vt USING (zone, hour)""")
def surface_with_vertex(spark, sf):
    points = D.point_probabilities(place_leaves(spark, sf)[0], ("zone", "hour"))
    tails = D.tail_probability(points, (21.64,), ("zone", "hour"))
    return rounded(with_place(tails, vertices(spark, sf), ("zone", "hour")).select(
        "zone", "hour", "vertex", "timelabel", "node_counts", "tail_prob"))


_SITE_SQL = f"""WITH {BY_PLACE}, {_SITES}, {RANKS}, {VERTEX_TABLE},
  wd AS (SELECT x_num, coalesce(x - lag(x) OVER w, lead(x) OVER w - x) AS width, coalesce((x + lag(x) OVER w) / 2, x) AS midpoint
         FROM pts WINDOW w AS (ORDER BY x_num)),
  dn AS (SELECT zone, hour, cast(leaf + 2 AS integer) AS x_num, leaf_up AS x, prob, prob / width AS density, midpoint FROM leaves JOIN wd ON wd.x_num = leaf + 2),
  gl0 AS (SELECT x_num, exp(avg(ln(density))) AS g FROM dn GROUP BY x_num),
  gl AS (SELECT x_num, g / sum(g) OVER () AS global_density FROM gl0),
  ch AS (SELECT * FROM dn JOIN sites USING (zone) WHERE hour IN (1, 37)),
  mn AS (SELECT zone, hour, sum(prob * midpoint) AS mean FROM ch GROUP BY ALL),
  {_BOOTSTRAP},
  b AS (SELECT zone, hour, x_num, quantile_cont(d, 0.05) AS q05, quantile_cont(d, 0.95) AS q95
        FROM (SELECT zone, hour, sim, x_num, prob / width AS d FROM sleaves JOIN wd ON wd.x_num = leaf + 2) GROUP BY ALL)
  SELECT zone, hour, x_num, {rs('x', 'density', 'mean', 'global_density', 'q05', 'q95')}, site_name,
    'n=' || node_counts AS lab, node_counts = 0 AS iszero, cast((hour - 1) // 24 AS integer) AS wday,
    cast((hour - 1) % 24 AS integer) AS hour_of_day, {_LABEL12} AS timelabel
  FROM ch JOIN mn USING (zone, hour) JOIN gl USING (x_num) LEFT JOIN b USING (zone, hour, x_num)
  JOIN (SELECT zone, hour, node_counts FROM vt) v USING (zone, hour)"""


@query("site_report", _SITE_SQL)
def site_report(spark, sf):
    leaves, splits = place_leaves(spark, sf)
    points = D.point_probabilities(leaves, ("zone", "hour"))
    widths = D.bin_widths(T.evaluation_points(splits))
    named = sites(spark, sf)
    samples = sample_leaves(spark, sf, splits).join(named.select("zone"), "zone", "left_semi")
    return rounded(M.site_report(points, vertices(spark, sf), named, widths, M.density_bands(samples, widths)))


@query("count_labels", f"""WITH {RANKS}, {X.CELLS}, {VERTEX_TABLE} SELECT vertex, node_counts = 0 AS iszero, 'n=' || node_counts AS lab,
   cast((hour - 1) // 24 AS integer) AS wday, cast((hour - 1) % 24 AS integer) AS hour_of_day FROM vt""")
def count_labels(spark, sf):
    return M.count_labels(vertices(spark, sf)).select(
        "vertex", "iszero", "lab", "wday", "hour_of_day")


@query("site_extract", f"""WITH {BY_PLACE}, {_SITES}, {RANKS} SELECT zone, hour, cast(leaf + 2 AS integer) AS x_num,
   {rs('prob')}, site_name, zone_rank + 1 AS row FROM leaves JOIN sites USING (zone) JOIN ranks USING (zone)""")
def site_extract(spark, sf):
    points = D.point_probabilities(place_leaves(spark, sf)[0], ("zone", "hour"))
    return rounded(M.site_extract(points, sites(spark, sf), ranks(spark, sf)).select(
        "zone", "hour", "x_num", "prob", "site_name", "row"))


@query("in_list", f"WITH {X.CELLS} SELECT ride_id, hour, {rs('productivity')} FROM cells WHERE hour IN (1, 37)")
def in_list(spark, sf):
    return rounded(M.hours_of_interest(X.cells(spark, sf), M.MAP_HOURS).select(
        "ride_id", "hour", "productivity"))


@query("subsample_mod", f"WITH {_CELLGRID} SELECT i, j, {rs('signal')} FROM g WHERE (i % 3 = 0 OR i = 1) AND (j % 3 = 0 OR j = 1)")
def subsample_mod(spark, sf):
    """The every-third-cell display filter."""
    return rounded(M.every_kth(M.every_kth(grid_cells(spark, sf), "i", 3, True), "j", 3, True))


@query("enrich", f"""WITH {X.CHAIN}, m AS (SELECT site, x_num, avg(prob) AS centre FROM chain GROUP BY ALL)
   SELECT site, sim, x_num, {rs('prob', 'centre')}, n_name AS site_name FROM chain LEFT JOIN nation ON n_nationkey = site
   LEFT JOIN m USING (site, x_num)""")
def enrich(spark, sf):
    ch = X.chain(spark, sf)
    names = X.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("site"), F.col("n_name").alias("site_name"))
    centre = ch.groupBy("site", "x_num").agg(F.avg("prob").alias("centre"))
    return rounded(M.enrich(ch, (names, ["site"]), (centre, ["site", "x_num"])))


_NORM = """CASE WHEN name IN ('gen', 'cv_logll') THEN (value - lo) / nullif(hi - lo, 0)
   WHEN name IN ('lam_s1', 'lam_t1') THEN (value + 2.03) / 2.78 ELSE (value + 4.03) / 4.78 END"""


@query("search_report", f"""WITH {X.SEARCH}, e AS (SELECT * REPLACE (gen::double AS gen, log10(lam_s1) AS lam_s1, log10(lam_s2) AS lam_s2,
     log10(lam_t1) AS lam_t1, log10(lam_t2) AS lam_t2) FROM runs WHERE gen % 2 = 0),
  f AS (SELECT split_id, quantile_cont(cv_logll, 0.05) AS q, max(cv_logll) AS top FROM e GROUP BY split_id),
  s AS (SELECT split_id, runid, cv_logll / top AS cv_scaled, greatest(cv_logll - q, 0) + q AS cv_logll_norm FROM e JOIN f USING (split_id)),
  l AS (UNPIVOT e ON gen, lam_s1, lam_s2, lam_t1, lam_t2, cv_logll INTO NAME name VALUE value),
  sp AS (SELECT split_id, name, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL)
  SELECT split_id, runid, name, cast(list_position(['gen','lam_s1','lam_s2','lam_t1','lam_t2','cv_logll'], name) AS integer) AS axis,
   {r('value', 'value')}, {r(_NORM, 'value_norm')}, {rs('cv_scaled', 'cv_logll_norm')}
  FROM l JOIN s USING (split_id, runid) JOIN sp USING (split_id, name)""")
def report_of_search(spark, sf):
    return rounded(search_report(X.search_runs(spark, sf)))


@query("to_longer", f"""WITH {X.SEARCH} SELECT runid, name, {r('value', 'value')} FROM
   (UNPIVOT (SELECT runid, gen::double AS gen, lam_s1, cv_logll FROM runs) ON gen, lam_s1, cv_logll INTO NAME name VALUE value)""")
def to_longer(spark, sf):
    return rounded(H.to_longer(X.search_runs(spark, sf), ["runid"], ["gen", "lam_s1", "cv_logll"]))


@query("best_candidate", f"""WITH {X.SEARCH} SELECT split_id, runid, gen, {rs('lam_s1', 'cv_logll')} FROM
   (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY cv_logll DESC, runid) AS rn FROM runs) WHERE rn = 1""")
def best_candidate(spark, sf):
    best = V.best_candidate(X.search_runs(spark, sf), "cv_logll", tie="runid")
    return rounded(best.select("split_id", "runid", "gen", "lam_s1", "cv_logll"))


@query("benchmark_summary", f"WITH {X.SCORES} SELECT task, outliers, method, {r('avg(score)', 'val_ll', 3)} FROM scores GROUP BY ALL")
def benchmark_summary(spark, sf):
    return V.benchmark_summary(X.scores(spark, sf), ["task", "outliers", "method"], {"val_ll": "score"})


@query("average_ranks", f"""WITH {X.SCORES} SELECT runid, task, experiment, method,
   rank() OVER (PARTITION BY task, experiment ORDER BY score)
   + (count(*) OVER (PARTITION BY task, experiment, score) - 1) / 2.0::double AS rank_score FROM scores""")
def average_ranks(spark, sf):
    return K.average_ranks(X.scores(spark, sf), ["task", "experiment"], ["score"]).select(
        "runid", "task", "experiment", "method", "rank_score")


@query("rank_summary", f"""WITH {X.SCORES}, k AS (SELECT task, method, rank() OVER (PARTITION BY task, experiment ORDER BY score)
   + (count(*) OVER (PARTITION BY task, experiment, score) - 1) / 2.0::double AS rk FROM scores)
   SELECT task, method, {r('avg(rk)', 'rank_score_mean')} FROM k GROUP BY ALL""")
def rank_summary(spark, sf):
    ranked = K.average_ranks(X.scores(spark, sf), ["task", "experiment"], ["score"])
    return rounded(K.rank_summary(ranked, ["task", "method"], ["score"]))


@query("scale_by_group_max", f"WITH {X.SCORES} SELECT runid, {r('score / max(score) OVER (PARTITION BY task)', 'scaled')} FROM scores")
def scale_by_group_max(spark, sf):
    return rounded(K.scale_by_group_max(X.scores(spark, sf), ["task"], "score", "scaled").select(
        "runid", "scaled"))


@query("clip_at_quantile", f"""WITH {X.SCORES}, q AS (SELECT quantile_cont(score, 0.05) AS q FROM scores),
   t AS (SELECT task, quantile_cont(score, 0.05) AS tq FROM scores GROUP BY task)
   SELECT runid, {r('greatest(score - q, 0) + q', 'clipped')}, {r('greatest(score - tq, 0) + tq', 'clipped_task')} FROM scores JOIN t USING (task), q""")
def clip_at_quantile(spark, sf):
    once = K.clip_at_quantile(X.scores(spark, sf), "score", "clipped")
    return rounded(K.clip_at_quantile(once, "score", "clipped_task", keys=("task",)).select(
        "runid", "clipped", "clipped_task"))


@query("case_when", f"""WITH {X.SCORES} SELECT runid, task || (CASE WHEN outliers THEN '+outliers' ELSE '' END) AS task FROM scores""")
def case_when(spark, sf):
    return M.outlier_suffix(X.scores(spark, sf), ("task",)).select("runid", "task")


@query("ordered_labels", """SELECT o_orderkey, cast(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END AS integer) AS ord FROM orders""")
def ordered_labels(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.select("o_orderkey", K.ordinal(F.col("o_orderstatus"), ["O", "F", "P"]).alias("ord"))


@query("rename_cols", "SELECT o_orderkey AS runid, o_custkey AS experiment, o_orderpriority AS task FROM orders")
def rename_cols(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumnsRenamed(
        {"o_orderkey": "runid", "o_custkey": "experiment", "o_orderpriority": "task"})


@query("head", f"WITH {X.SCORES} SELECT runid, {rs('score')} FROM scores ORDER BY scores.score, scores.runid LIMIT 10")
def head(spark, sf):
    return rounded(K.head(X.scores(spark, sf).select("runid", "score"), 10, "score", "runid"))
