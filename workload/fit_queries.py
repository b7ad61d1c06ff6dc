"""Folds, candidates, smoothing, cross-validation and bootstrap.

All registered fits are whole: every model is fitted until it settles. Their SQL writes
out as many rounds as the slowest model needs.
"""

from pyspark.sql import functions as F

from zonehour.operators import counts as C
from zonehour.operators import density as D
from zonehour.operators import graph as G
from zonehour.operators import posterior as P
from zonehour.operators import quadratic as Q
from zonehour.operators import smoothing as S
from zonehour.operators import splits as T
from zonehour.operators import validation as V
from zonehour.plans import search as E
from zonehour.plans import reports as M
from zonehour.plans.densities import surfaces
from zonehour.plans.spacetime import SpaceTime, stored_betas
from zonehour.sources.shared import save_round

from . import standins as X
from .density_queries import BY_ZONE_COUNTS
from .graph_queries import RANKS, ranks
from .registry import query, r, rounded, rs
from .tree_queries import tree

# Fixed penalties of the registered fits: within-hour and across-hour, L1 and L2.
PEN = {"l1_space": 0.3, "l2_space": 0.2, "l1_time": 0.1, "l2_time": 0.4}
# Every model is fitted until its residuals are below tol; more rounds than these are an error.
CV = {"rounds": 150, "tol": 1e-2, "check_every": 5}

_SMALL_TREE = """
tree AS MATERIALIZED (SELECT 0 AS split_id, 0 AS lvl, t[1] AS lo, t[3] AS mid, t[5] AS up FROM qq
   UNION ALL SELECT 1, 1, t[1], t[2], t[3] FROM qq UNION ALL SELECT 2, 1, t[3], t[4], t[5] FROM qq)
"""
_TREE3 = X.CELLS + """,
qq AS (SELECT list_concat([min(productivity)], list_concat(quantile_cont(productivity, [0.25, 0.5, 0.75]),
       [max(productivity)])) AS t FROM cells),""" + _SMALL_TREE
_TREE1 = X.CELLS + """,
tree AS MATERIALIZED (SELECT 0 AS split_id, min(productivity) AS lo, quantile_cont(productivity, 0.5) AS mid,
   max(productivity) AS up FROM cells)"""


def _placed(tree_sql: str) -> str:
    return f"""{tree_sql}, {RANKS}, placed AS MATERIALIZED (SELECT cells.*, vertex FROM cells JOIN verts USING (zone, hour)),
      {X.counts_sql('placed', 'vertex')}, {X.dense_sql('verts', 'vertex')}"""


def _edges_sql(models: str) -> str:
    """Edges of every model of ``models`` (model_id, s1, s2, t1, t2)."""
    return f"""ed AS MATERIALIZED (SELECT model_id, src, dst, CASE WHEN temporal THEN t1 ELSE s1 END AS l1,
      CASE WHEN temporal THEN t2 ELSE s2 END AS l2 FROM st, {models})"""


_PENSQL = "0.3::double AS s1, 0.2::double AS s2, 0.1::double AS t1, 0.4::double AS t2"


def graph(spark, sf):
    rk = ranks(spark, sf)
    edges = save_round(G.spacetime_edges(X.adjacency(spark, sf), rk), "edges")
    verts = save_round(G.expand_hours(rk).select("zone", "hour", "vertex"), "vertices")
    return verts, edges


def placed(spark, sf, verts):
    return G.map_node_to_vertex(X.cells(spark, sf), verts)


def vertex_counts(spark, sf, verts, depth):
    """Split counts of every vertex over a quantile tree of ``depth`` levels."""
    cuts = T.level_cuts(X.cells(spark, sf), "productivity",
                        T.dyadic_probs(depth) if depth > 1 else [0.5])
    splits = save_round(T.trail_levels(cuts, depth), "tree")
    counts = C.split_counts(placed(spark, sf, verts), splits, vertices=verts)
    return splits, save_round(counts, "counts")


def constant_models(splits):
    return splits.select(F.col("split_id").cast("bigint").alias("model_id"),
                         *[F.lit(v).alias(k) for k, v in PEN.items()])


@query("assign_folds", f"""WITH {_placed(X.TREE)} SELECT vertex, split_id,
   CASE WHEN attempts >= 1 THEN {X.fold_sql('vertex', 5, 7)} END AS fold FROM dense""")
def assign_folds(spark, sf):
    verts, _ = graph(spark, sf)
    dense = C.split_counts(placed(spark, sf, verts), tree(spark, sf), vertices=verts)
    return V.assign_folds(dense, 5, 7).select("vertex", "split_id", "fold")


_FOLDED = f"""{_placed(_TREE1)}, folded AS (SELECT *, CASE WHEN attempts >= 1 THEN {X.fold_sql('vertex', 4)} END AS fold FROM dense)"""


def _folded(spark, sf):
    verts, _ = graph(spark, sf)
    return V.assign_folds(vertex_counts(spark, sf, verts, 1)[1], 4)


@query("mask_fold", f"""WITH {_FOLDED} SELECT vertex, held_fold, CASE WHEN fold = held_fold THEN 0 ELSE successes END::bigint AS successes,
   CASE WHEN fold = held_fold THEN 0 ELSE attempts END::bigint AS attempts
   FROM folded, (SELECT cast(unnest([0, 1, 2, 3]) AS integer) AS held_fold)""")
def mask_fold(spark, sf):
    return V.mask_fold(_folded(spark, sf), 4).select("vertex", "held_fold", "successes", "attempts")


@query("heldout", f"""WITH {_FOLDED} SELECT vertex, attempts, 'test' AS part FROM folded WHERE fold = 2
   UNION ALL SELECT vertex, attempts, 'train' FROM folded WHERE fold IS DISTINCT FROM 2""")
def heldout(spark, sf):
    train, test = V.heldout(_folded(spark, sf), 2)
    tag = lambda df, t: df.select("vertex", "attempts", F.lit(t).alias("part"))
    return tag(test, "test").unionByName(tag(train, "train"))


@query("observed_minus_heldout", f"WITH {_FOLDED} SELECT vertex FROM folded WHERE attempts >= 1 AND fold <> 1")
def observed_minus_heldout(spark, sf):
    folded = _folded(spark, sf)
    return V.observed_minus_heldout(folded.where("attempts >= 1"), folded.where("fold = 1"))


@query("shuffle_vertices", f"WITH {RANKS} SELECT vertex, {r(X.hash_sql('vertex', 11), 'shuffle_key')} FROM verts")
def shuffle_vertices(spark, sf):
    verts, _ = graph(spark, sf)
    return rounded(verts.select(
        "vertex", V.shuffle_order(F.col("vertex"), 11).alias("shuffle_key"))).orderBy("shuffle_key")


_BOX = {"l1_space": (-2, 3), "l2_space": (-3, 5), "l1_time": (-2, 3), "l2_time": (-3, 5)}


@query("candidate_penalties", f"""WITH z AS (SELECT cast(s_suppkey AS integer) AS split_id FROM supplier),
  c AS (SELECT cast(((a * 2 + b) * 2 + c) * 2 + d AS integer) AS candidate, pow(10, -2 + 3 * a) AS l1_space, pow(10, -3 + 5 * b) AS l2_space,
     pow(10, -2 + 3 * c) AS l1_time, pow(10, -3 + 5 * d) AS l2_time FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b),
     (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1]) AS d)
   UNION ALL SELECT cast(16 + id AS integer), {', '.join(f"pow(10, {lo} + ({X.hash_sql(f'id * 4 + {k}', 5)}) * {w})" for k, (lo, w) in enumerate(_BOX.values()))}
     FROM (SELECT unnest(generate_series(0, 31)) AS id))
  SELECT split_id, candidate, {rs(*_BOX)}, (split_id::bigint * 48 + candidate)::bigint AS model_id FROM z, c""")
def candidate_penalties(spark, sf):
    """Every zone's model with every candidate."""
    zones = X.zone_grid(spark, sf).select(F.col("zone").alias("split_id"))
    models = V.cross_models(zones, V.candidate_penalties(spark, 32, 5))
    return rounded(models)


_AXIS = "pow(10, -2 + (log10(5.0::double) + 2) * {k} / {n})"


@query("method_grid", f"""WITH f AS (SELECT {_AXIS.format(k='a', n=19)} AS l1_space, 1e-12::double AS l2_space, {_AXIS.format(k='b', n=19)} AS l1_time, 1e-12::double AS l2_time, 'fl' AS method
     FROM (SELECT unnest(generate_series(0, 19)) AS a), (SELECT unnest(generate_series(0, 19)) AS b)),
   e AS (SELECT {_AXIS.format(k='a', n=3)} AS l1_space, {_AXIS.format(k='b', n=3)} AS l2_space, {_AXIS.format(k='c', n=3)} AS l1_time, {_AXIS.format(k='d', n=3)} AS l2_time, 'enet' AS method
     FROM (SELECT unnest(generate_series(0, 3)) AS a), (SELECT unnest(generate_series(0, 3)) AS b), (SELECT unnest(generate_series(0, 3)) AS c), (SELECT unnest(generate_series(0, 3)) AS d))
   SELECT cast(s_suppkey AS integer) AS zone, method, {rs(*PEN)} FROM (SELECT * FROM f UNION ALL SELECT * FROM e), supplier""")
def method_grid(spark, sf):
    """Penalty grids of two methods for the model of every zone."""
    grid = V.method_grid(spark, "fl").unionByName(V.method_grid(spark, "enet", 4))
    listed = grid.agg(F.collect_list(F.struct("method", *PEN))).scalar()
    zones = X.zone_grid(spark, sf).select("zone", F.explode(listed).alias("g"))
    return rounded(zones.select("zone", "g.*"))


@query("cv_loglik", f"""WITH {_FOLDED}, p AS (SELECT fold, sum(successes) AS s, sum(attempts) AS n FROM folded WHERE fold IS NOT NULL GROUP BY fold),
  b AS (SELECT a.fold AS model_id, ln((sum(p.s) + 1e-3) / (sum(p.n) - sum(p.s) + 1e-3)) AS beta FROM p a JOIN p ON a.fold <> p.fold GROUP BY a.fold)
  SELECT fold, {r('sum(successes * -ln(1 + exp(-beta)) + (attempts - successes) * -ln(1 + exp(beta))) / sum(attempts)', 'cv_loglik')},
   sum(attempts)::bigint AS heldout_attempts FROM folded JOIN b ON model_id = fold GROUP BY fold""")
def cv_loglik(spark, sf):
    """Held-out score of the pooled model of the other folds."""
    folded = _folded(spark, sf)
    masked = V.mask_fold(folded, 4).groupBy("held_fold").agg(
        F.sum("successes").alias("s"), F.sum("attempts").alias("n"))
    beta = masked.select(F.col("held_fold").alias("model_id"), F.ln(
        (F.col("s") + 1e-3) / (F.col("n") - F.col("s") + 1e-3)).alias("beta"))
    test = folded.where("fold IS NOT NULL").withColumn("model_id", F.col("fold"))
    betas = test.select("model_id", "vertex").join(beta, "model_id")
    return rounded(V.cv_loglik(test, betas, ("fold",)))


_VALUES = f"""{X.CELLS}, {RANKS}, vals AS MATERIALIZED (SELECT verts.vertex, avg(productivity) / 10 AS value FROM verts LEFT JOIN cells USING (zone, hour) GROUP BY ALL)"""


def vertex_means(spark, sf, verts):
    means = placed(spark, sf, verts).groupBy("vertex").agg(
        (F.avg("productivity") / 10).alias("value"))
    return verts.select("vertex").join(means, "vertex", "left")


@query("cv_errors", f"""WITH {_VALUES}, f AS (SELECT vertex, value, {X.fold_sql('vertex', 4)} AS fold FROM vals WHERE value IS NOT NULL),
  c AS (SELECT *, CASE candidate WHEN 0 THEN value - 6 ELSE value - vertex % 12 END AS gap FROM f, (SELECT cast(unnest([0, 1]) AS integer) AS candidate)),
  k AS (SELECT candidate, fold, avg(gap * gap) AS mse, avg(abs(gap)) AS mae FROM c GROUP BY ALL)
  SELECT candidate, {r('avg(mse)', 'mse')}, {r('avg(mae)', 'mae')}, {r('sqrt(avg(mse))', 'rmse')} FROM k GROUP BY candidate""")
def cv_errors(spark, sf):
    verts, _ = graph(spark, sf)
    v = vertex_means(spark, sf, verts).where("value IS NOT NULL").withColumn(
        "fold", V.fold_of(F.col("vertex"), 4))
    test = v.withColumn("candidate", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "beta", F.when(F.col("candidate") == 0, F.lit(6.0)).otherwise(
            (F.col("vertex") % 12).cast("double")))
    return rounded(V.cv_errors(test))


@query("smooth_binomial", f"""WITH {_placed(_TREE3)}, mod AS (SELECT split_id::bigint AS model_id, {_PENSQL} FROM tree), {_edges_sql('mod')},
  mc AS (SELECT split_id::bigint AS model_id, vertex, successes, attempts FROM dense), {X.settled_fit_sql('mc', 'ed', **CV)}
  SELECT model_id, vertex, {rs('beta')} FROM ffit""")
def smooth_binomial(spark, sf):
    """Three splits smoothed together over the whole space-time graph."""
    verts, edges = graph(spark, sf)
    splits, counts = vertex_counts(spark, sf, verts, 2)
    rows = counts.select(F.col("split_id").cast("bigint").alias("model_id"), "vertex",
                         "successes", "attempts")
    return rounded(S.smooth_binomial(rows, edges, constant_models(splits), **CV).result())


@query("smooth_gaussian", f"""WITH {_VALUES}, mod AS (SELECT 0::bigint AS model_id, {_PENSQL}), {_edges_sql('mod')},
  gv AS (SELECT 0::bigint AS model_id, vertex, value FROM vals), {X.settled_fit_sql('gv', 'ed', squared=True, **CV)}
  SELECT vertex, {rs('beta')} FROM ffit""")
def smooth_gaussian(spark, sf):
    verts, edges = graph(spark, sf)
    values = vertex_means(spark, sf, verts).withColumn("model_id", F.lit(0).cast("bigint"))
    one = spark.range(1).select(F.col("id").alias("model_id"),
                                *[F.lit(v).alias(k) for k, v in PEN.items()])
    return rounded(S.smooth_gaussian(values, edges, one, **CV).result().select("vertex", "beta"))


# Whole cross-validation: three splits, the 16 corners of the search box and 5 folds are 240 models over the graph of
# zones and parts of the week (weekdays and weekends), each fitted until it settles.
FOLDS = 5


def week_parts(spark, sf):
    """(cells, vertices, edges) of the graph: vertex 2 * zone, and one more at weekends."""
    weekend = F.when(F.col("hour").between(25, 144), 0).otherwise(1)
    cells = X.cells(spark, sf).select("ride_id", "productivity", (F.col("zone") * 2 + weekend).alias("vertex"))
    zones, adjacent = X.zone_grid(spark, sf), X.adjacency(spark, sf)
    part = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    within = adjacent.select("zone1", "zone2", part).selectExpr("zone1 * 2 + part AS src", "zone2 * 2 + part AS dst", "false AS temporal")
    across = zones.selectExpr("zone * 2 AS src", "zone * 2 + 1 AS dst", "true AS temporal")
    verts = zones.select("zone", part).selectExpr("zone * 2 + part AS vertex")
    return cells, save_round(verts, "vertices"), save_round(within.unionByName(across), "edges")


def _week(tree_sql: str) -> str:
    return f"""{X.ADJ}, {tree_sql}, wv AS (SELECT zone * 2 + part AS vertex FROM zg, (SELECT unnest([0, 1]) AS part)),
  wc AS (SELECT ride_id, productivity, zone * 2 + CASE WHEN hour BETWEEN 25 AND 144 THEN 0 ELSE 1 END AS vertex FROM cells),
  {X.counts_sql('wc', 'vertex')}, {X.dense_sql('wv', 'vertex')},
  we AS (SELECT zone1 * 2 + part AS src, zone2 * 2 + part AS dst, false AS temporal FROM adj, (SELECT unnest([0, 1]) AS part)
     UNION ALL SELECT zone * 2, zone * 2 + 1, true FROM zg)"""


_CV = f"""{_week(_TREE3)}, folded AS MATERIALIZED (SELECT *, CASE WHEN attempts >= 1 THEN {X.fold_sql('vertex', FOLDS)} END AS fold FROM dense),
  cand AS (SELECT ((a * 2 + b) * 2 + c) * 2 + d AS candidate, pow(10, -2 + 3 * a) AS s1, pow(10, -3 + 5 * b) AS s2, pow(10, -2 + 3 * c) AS t1,
     pow(10, -3 + 5 * d) AS t2 FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1]) AS d)),
  mod AS MATERIALIZED (SELECT cand.*, split_id, hf, ((split_id * 16 + candidate) * {FOLDS} + hf)::bigint AS model_id
     FROM cand, tree, (SELECT cast(unnest(generate_series(0, {FOLDS - 1})) AS integer) AS hf)), {_edges_sql('mod').replace('FROM st,', 'FROM we,')},
  mc AS (SELECT model_id, vertex, CASE WHEN fold = hf THEN 0 ELSE successes END AS successes, CASE WHEN fold = hf THEN 0 ELSE attempts END AS attempts
     FROM folded JOIN mod USING (split_id)),
  {X.settled_fit_sql('mc', 'ed', **CV)},
  sc AS MATERIALIZED (SELECT split_id, candidate, s1, s2, t1, t2, sum(successes * -ln(1 + exp(-beta)) + (attempts - successes) * -ln(1 + exp(beta))) / sum(attempts) AS cv_loglik,
     sum(attempts)::bigint AS heldout_attempts FROM folded JOIN mod USING (split_id) JOIN ffit USING (model_id, vertex) WHERE fold = hf GROUP BY ALL)"""


def _cv(spark, sf):
    cells, verts, edges = week_parts(spark, sf)
    splits = save_round(T.trail_levels(T.level_cuts(cells, "productivity", T.dyadic_probs(2)), 2), "tree")
    counts = save_round(C.split_counts(cells, splits, vertices=verts), "counts")
    return counts, edges, E.cross_validate(counts, edges, V.corner_penalties(spark), folds=FOLDS, **CV)


@query("cross_validate", f"""WITH {_CV} SELECT split_id, candidate::integer AS candidate, {r('s1', 'l1_space')}, {r('s2', 'l2_space')}, {r('t1', 'l1_time')},
   {r('t2', 'l2_time')}, {rs('cv_loglik')}, heldout_attempts FROM sc""")
def cross_validate(spark, sf):
    """Held-out score of every corner at every split, from fits that have settled."""
    return rounded(_cv(spark, sf)[2])


# Squared penalties within a part of the week and across parts, of three models.
SQUARED = ((0, 0.2, 0.4), (1, 1.0, 1.0), (2, 5.0, 0.5))


def _conjugate_sql(rounds: int = 40) -> str:
    """CTE text of conjugate gradients for ``qv`` (model_id, vertex, value) and ``qe`` (model_id, vertex, other, c)."""
    out = ["""x0 AS MATERIALIZED (SELECT model_id, vertex, diag, 0.0::double AS x, b AS r, b / diag AS p FROM (
      SELECT model_id, vertex, (value IS NOT NULL)::integer + 1e-3::double + coalesce(deg, 0) AS diag, coalesce(value, 0) AS b FROM qv
      LEFT JOIN (SELECT model_id, vertex, sum(c) AS deg FROM qe GROUP BY ALL) USING (model_id, vertex)))"""]
    for k in range(1, rounds + 1):
        out.append(f"""q{k} AS MATERIALIZED (SELECT v.*, diag * p - coalesce(s, 0) AS q FROM x{k - 1} v LEFT JOIN (
          SELECT e.model_id, e.vertex, sum(c * p) AS s FROM qe e JOIN x{k - 1} o ON o.model_id = e.model_id AND o.vertex = e.other
          GROUP BY ALL) USING (model_id, vertex)),
        y{k} AS MATERIALIZED (SELECT model_id, vertex, diag, p, x + alpha * p AS x, r - alpha * q AS r, rz FROM q{k} JOIN (SELECT model_id,
          sum(r * r / diag) AS rz, coalesce(sum(r * r / diag) / nullif(sum(p * q), 0), 0) AS alpha FROM q{k} GROUP BY model_id) USING (model_id)),
        x{k} AS MATERIALIZED (SELECT model_id, vertex, diag, x, r, r / diag + turn * p AS p FROM y{k} JOIN (SELECT model_id,
          coalesce(sum(r * r / diag) / nullif(max(rz), 0), 0) AS turn FROM y{k} GROUP BY model_id) USING (model_id))""")
    return ", ".join(out)


@query("smooth_quadratic", f"""WITH {_week(_TREE3)}, qm AS (SELECT * FROM (VALUES {', '.join(f'({m}::bigint, {a}::double, {b}::double)' for m, a, b in SQUARED)}) AS listed(m, s, t)),
  qv AS MATERIALIZED (SELECT m AS model_id, vertex, value FROM qm, (SELECT wv.vertex, avg(productivity) / 10 AS value FROM wv LEFT JOIN wc USING (vertex) GROUP BY ALL)),
  qh AS (SELECT m AS model_id, src, dst, 2 * CASE WHEN temporal THEN t ELSE s END AS c FROM we, qm),
  qe AS MATERIALIZED (SELECT model_id, src AS vertex, dst AS other, c FROM qh UNION ALL SELECT model_id, dst, src, c FROM qh), {_conjugate_sql()}
  SELECT model_id, vertex, {r('x', 'beta')} FROM x40""")
def smooth_quadratic(spark, sf):
    """Means of zones and parts of the week under squared penalties, solved to a residual of 1e-10."""
    cells, verts, edges = week_parts(spark, sf)
    means = cells.groupBy("vertex").agg((F.avg("productivity") / 10).alias("value"))
    models = spark.createDataFrame([(m, s, t) for m, s, t in SQUARED], "model_id bigint, l2_space double, l2_time double")
    values = verts.join(means, "vertex", "left").withColumn("model_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m, _, _ in SQUARED])))
    return rounded(Q.smooth_quadratic(values, edges, models).result())


@query("fit_best", f"""WITH {_CV}, bm AS (SELECT split_id::bigint AS model_id, s1, s2, t1, t2 FROM sc
     QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY cv_loglik DESC, candidate) = 1),
   {_edges_sql('bm').replace('ed AS', 'bed AS').replace('FROM st,', 'FROM we,')}, bc AS (SELECT split_id::bigint AS model_id, vertex, successes, attempts FROM dense),
   {X.settled_fit_sql('bc', 'bed', p='h', **CV)} SELECT model_id::integer AS split_id, vertex, {rs('beta')} FROM hfit""")
def fit_best(spark, sf):
    """Every split refitted on all counts at its best corner, until it settles."""
    counts, edges, scores = _cv(spark, sf)
    return rounded(E.fit_best(counts, edges, scores, **CV))


_HELD = f"""{_week(X.TREE)}, folded AS MATERIALIZED (SELECT *, {X.fold_sql('vertex', FOLDS)} AS fold FROM dense),
  mod AS MATERIALIZED (SELECT split_id, hf, (split_id * {FOLDS} + hf)::bigint AS model_id, {_PENSQL}
     FROM tree, (SELECT cast(unnest(generate_series(0, {FOLDS - 1})) AS integer) AS hf)), {_edges_sql('mod').replace('FROM st,', 'FROM we,')},
  mc AS (SELECT model_id, vertex, CASE WHEN fold = hf THEN 0 ELSE successes END AS successes, CASE WHEN fold = hf THEN 0 ELSE attempts END AS attempts
     FROM folded JOIN mod USING (split_id)),
  {X.settled_fit_sql('mc', 'ed', **CV)},
  hb AS (SELECT split_id, vertex, beta FROM ffit JOIN mod USING (model_id) WHERE hf = {X.fold_sql('vertex', FOLDS)}),
  {X.leaves_sql('hb', 'vertex')},
  cutl AS (SELECT list(x ORDER BY x_num) AS cuts FROM pts),
  scored AS (SELECT vertex, {X.fold_sql('vertex', FOLDS)} AS fold, ln(prob / (leaf_up - leaf_lo)) AS logd FROM (
     SELECT vertex, least(len(list_filter(cuts, lambda c: c <= productivity)), len(cuts) - 1) - 1 AS leaf FROM wc, cutl)
     JOIN leaves USING (vertex, leaf))"""


def _held_leaves(spark, sf):
    """(rides, leaves, splits): the leaves of each vertex come from the fit that didn't see its rides."""
    cells, verts, edges = week_parts(spark, sf)
    splits = save_round(tree(spark, sf), "tree")
    counts = save_round(C.split_counts(cells, splits, vertices=verts), "counts")
    penalties = splits.select("split_id", *[F.lit(v).alias(k) for k, v in PEN.items()])
    betas = E.heldout_betas(counts, edges, penalties, FOLDS, **CV)
    return cells, D.leaf_probabilities(betas, splits, ("vertex",)), splits


@query("heldout_nll", f"WITH {_HELD} SELECT fold, {r('-avg(logd)', 'nll')}, count(*)::bigint AS n FROM scored GROUP BY fold")
def heldout_nll(spark, sf):
    """Score of each fold's rides under the surface that was fitted without them."""
    cells, leaves, splits = _held_leaves(spark, sf)
    values = cells.withColumn("fold", V.fold_of(F.col("vertex"), FOLDS))
    return rounded(D.heldout_nll(values, leaves, splits, "productivity", ("vertex",), ("fold",)))


@query("validation_nll", f"""WITH {_HELD} SELECT {r('avg(nll)', 'validation_nll')} FROM
   (SELECT vertex, -avg(logd) AS nll FROM scored GROUP BY vertex)""")
def validation_nll(spark, sf):
    """The same per vertex, then over vertices."""
    cells, leaves, splits = _held_leaves(spark, sf)
    return rounded(D.validation_nll(D.log_density_at(cells, leaves, splits, "productivity", ("vertex",)), ("vertex",)))


@query("bootstrap_counts", f"""WITH {X.TREE}, w AS (SELECT zone, productivity, sim, n FROM (
     SELECT zone, productivity, 0 AS sim, {X.poisson_sql('ride_id', 1)} AS n FROM cells
     UNION ALL SELECT zone, productivity, 1, {X.poisson_sql('ride_id', 2)} FROM cells
     UNION ALL SELECT zone, productivity, 2, {X.poisson_sql('ride_id', 3)} FROM cells) WHERE n > 0)
   SELECT zone, sim, split_id, sum(CASE WHEN productivity < mid THEN n ELSE 0 END)::bigint AS successes, sum(n)::bigint AS attempts
   FROM w JOIN tree ON productivity >= lo AND (productivity < up OR (productivity = up AND up = (SELECT max(up) FROM tree))) GROUP BY ALL""")
def bootstrap_counts(spark, sf):
    splits = tree(spark, sf)
    slots = P.bootstrap_slot_counts(X.cells(spark, sf), splits, "productivity", ["zone"], 3)
    return C.roll_up(slots, splits, ["zone", "sim"])


SAMPLES = 20


@query("bootstrap_samples", f"""WITH {_week(X.TREE)},
   sims AS (SELECT unnest(generate_series(0, {SAMPLES - 1})) AS sim),
   w AS (SELECT vertex, productivity, sims.sim AS sim, {X.poisson_sql('ride_id', '(sims.sim + 1)')} AS n FROM wc, sims),
   k AS (SELECT vertex, sim, split_id, sum(CASE WHEN productivity < mid THEN n ELSE 0 END) AS successes, sum(n) AS attempts
      FROM w JOIN tree ON productivity >= lo AND (productivity < up OR (productivity = up AND up = (SELECT max(up) FROM tree))) GROUP BY ALL),
   mc AS (SELECT (split_id * {SAMPLES} + sim)::bigint AS model_id, vertex, coalesce(successes, 0)::bigint AS successes, coalesce(attempts, 0)::bigint AS attempts
      FROM (SELECT vertex, sim, split_id FROM wv, sims, tree) LEFT JOIN k USING (vertex, sim, split_id)),
   mod AS (SELECT (split_id * {SAMPLES} + sim)::bigint AS model_id, {_PENSQL} FROM tree, sims), {_edges_sql('mod').replace('FROM st,', 'FROM we,')},
   {X.settled_fit_sql('mc', 'ed', **CV)}
   SELECT (model_id // {SAMPLES})::integer AS split_id, (model_id % {SAMPLES})::integer AS sim, vertex, {rs('beta')} FROM ffit""")
def bootstrap_samples(spark, sf):
    """Twenty smoothed samples of all splits, over the graph of zones and parts of the week."""
    cells, verts, edges = week_parts(spark, sf)
    splits = save_round(tree(spark, sf), "tree")
    pen = splits.select("split_id", *[F.lit(v).alias(k) for k, v in PEN.items()])
    return rounded(E.bootstrap_samples(cells, verts, edges, splits, pen, SAMPLES, **CV))


# Whole fits: all 36 splits smoothed over the zones' own graph until they settle, and the surfaces from them.
ZONE_ROUNDS = 100
_ZONE_FIT = f"""{BY_ZONE_COUNTS}, wide AS (SELECT cast(ceil(sqrt(count(*))) AS integer) AS w FROM supplier),
  zed AS MATERIALIZED (SELECT split_id::bigint AS model_id, a.zone AS src, b.zone AS dst, 0.3::double AS l1, 0.2::double AS l2
    FROM zs a, zs b, wide, tree WHERE (b.zone = a.zone + w) OR (b.zone = a.zone + 1 AND b.zone % w <> 0)),
  zcounts AS (SELECT split_id::bigint AS model_id, zone AS vertex, successes, attempts FROM dense), {X.fit_sql('zcounts', 'zed', ZONE_ROUNDS, 'z')},
  smoothed AS (SELECT vertex AS zone, model_id AS split_id, beta FROM zv{ZONE_ROUNDS}), {X.leaves_sql('smoothed', 'zone')}"""


def zone_surfaces(spark, sf):
    """Rides of every zone to smoothed log-odds, and from these to all surfaces."""
    return surfaces(*_zone_fit(spark, sf), ("zone",))


def _zone_fit(spark, sf):
    splits = save_round(tree(spark, sf), "tree")
    places = X.zone_grid(spark, sf).select(F.col("zone").alias("vertex"))
    cells = X.cells(spark, sf).withColumnRenamed("zone", "vertex")
    counts = C.split_counts(cells, splits, vertices=places).withColumn("model_id", F.col("split_id").cast("bigint"))
    edges = X.adjacency(spark, sf).select(
        F.col("zone1").alias("src"), F.col("zone2").alias("dst"), F.lit(False).alias("temporal"))
    fit = S.smooth_binomial(counts, edges, constant_models(splits), rounds=ZONE_ROUNDS, tol=1e-3,
                            check_every=ZONE_ROUNDS, relax=1.0).result()
    return fit.select(F.col("vertex").alias("zone"), F.col("model_id").cast("int").alias("split_id"), "beta"), splits


@query("smoothed_tail_probability", f"""WITH {_ZONE_FIT} SELECT zone, level, {r('sum(CASE WHEN leaf_up >= level THEN prob ELSE 0 END)', 'tail_prob')}
   FROM leaves, (SELECT unnest([18.56, 21.64, 32.73, 34.74])::double AS level) GROUP BY zone, level""")
def smoothed_tail_probability(spark, sf):
    return rounded(zone_surfaces(spark, sf).tails)


@query("smoothed_density_quantile", f"""WITH {_ZONE_FIT}, zcdf AS (SELECT *, sum(prob) OVER (PARTITION BY zone ORDER BY leaf) AS cum FROM leaves)
   SELECT zone, level, {r('arg_min(leaf_lo + (level - (cum - prob)) / prob * (leaf_up - leaf_lo), leaf)', 'value', 4)}
   FROM zcdf, (SELECT unnest([0.1, 0.25, 0.5, 0.75])::double AS level) WHERE cum >= level - 1e-12 GROUP BY ALL""")
def smoothed_density_quantile(spark, sf):
    return rounded(zone_surfaces(spark, sf).quantiles, 4)


# The surface over zone and hour: all 36 splits smoothed over the whole space-time graph. The fit is stored, and the maps
# read it. Written out in SQL it would take an estimated 20 GB at sf0.01, so there is none; tests/test_coarse_and_stored.py has a plain solver.
SURFACE_FIT = {**CV, "coarsest": 4000}


def spacetime_leaves(spark, sf):
    """(leaves, splits) of the stored space-time fit, by zone and hour."""
    splits = save_round(tree(spark, sf), "tree")

    def make():
        verts, edges = graph(spark, sf)
        return SpaceTime(verts, edges, C.split_counts(placed(spark, sf, verts), splits, vertices=verts))

    penalties = splits.select("split_id", *[F.lit(v).alias(k) for k, v in PEN.items()])
    inputs = [X.table(spark, sf, t) for t in ("lineitem", "supplier")]
    betas = stored_betas(make, inputs, splits, penalties, **SURFACE_FIT).drop("vertex")
    return D.leaf_probabilities(betas, splits, ("zone", "hour")), splits


@query("smoothed_exceedance_map")
def smoothed_exceedance_map(spark, sf):
    """Probability of reaching a level, per zone at the mapped hours, from the smoothed surface."""
    points = D.point_probabilities(spacetime_leaves(spark, sf)[0], ("zone", "hour"))
    return rounded(M.exceedance_map(points, X.zone_grid(spark, sf), 32.73))


@query("smoothed_quantile_map")
def smoothed_quantile_map(spark, sf):
    return rounded(M.quantile_map(spacetime_leaves(spark, sf)[0], X.zone_grid(spark, sf), 0.25))


@query("smoothed_iqr_map")
def smoothed_iqr_map(spark, sf):
    return rounded(M.iqr_map(spacetime_leaves(spark, sf)[0], X.zone_grid(spark, sf)))


@query("smoothed_surface")
def smoothed_surface(spark, sf):
    """Probability of reaching each income level, at every zone and hour of the week, from the smoothed surface."""
    points = D.point_probabilities(spacetime_leaves(spark, sf)[0], ("zone", "hour"))
    return rounded(D.tail_probability(points, (18.56, 21.64, 32.73, 34.74), ("zone", "hour")))
