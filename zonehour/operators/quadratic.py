"""Means smoothed with squared penalties only: one linear system a model, solved by conjugate gradients on tables.

The minimiser of

    sum of seen * (y - b)**2 / 2 + prior_weight * (b - prior_mean)**2 / 2 + sum over edges of weight * l2 * (b_i - b_j)**2

satisfies (seen + prior_weight) * b_i + sum of 2 * weight * l2 * (b_i - b_j) = y_i + prior_weight * prior_mean. Directions
are scaled by the diagonal. A round is one join of edges with vertices, summed map-side at each vertex, one written
table, and two sums a model, which are all that the driver sees. Models are rows, and each ends at its own round.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import penalty_weight
from ..sources.shared import drop_round, save_round
from .smoothing import Fit


def _links(edges: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, vertex, other, c): both directions of every edge with twice its squared penalty."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    # The model list is a parameter table.
    table = models.agg(F.collect_list(F.struct("model_id", "l2_space", "l2_time"))).scalar()
    rows = edges.where("src <> dst").withColumn("m", F.explode(table))
    pull = 2 * penalty_weight(F.col("weight"), F.col("temporal"), F.col("m.l2_space"), F.col("m.l2_time"))
    return rows.select(F.col("m.model_id").alias("model_id"), "src", "dst", pull.alias("c")).selectExpr(
        "model_id", "stack(2, src, dst, dst, src) AS (vertex, other)", "c")


def smooth_quadratic(values: DataFrame, edges: DataFrame, models: DataFrame, *, rounds: int = 1000, tol: float = 1e-10,
                     prior_mean: float = 0.0, prior_weight: float = 1e-3) -> Fit:
    """The exact case of ``smooth_gaussian`` without absolute penalties; a NULL value is unobserved.

    ``values``: model_id, vertex, value, every vertex present. ``edges``: src, dst, temporal [, weight]; ``models``:
    model_id, l2_space, l2_time [, l1_space, l1_time, which must be 0]. A model has settled when its residual is
    ``tol`` times its right side's length. A positive ``prior_weight`` keeps the system solvable.
    """
    if prior_weight <= 0:
        raise ValueError("prior_weight must be positive")
    absolute = [F.col(c) > 0 for c in ("l1_space", "l1_time") if c in models.columns]
    if absolute and models.where(reduce(lambda x, y: x | y, absolute)).limit(1).count():
        raise ValueError("absolute penalties have no linear system; use smooth_gaussian")
    spark = values.sparkSession
    links = save_round(_links(edges, models), "links")
    pulls = links.groupBy("model_id", "vertex").agg(F.sum("c").alias("deg"))
    y = F.col("value").cast("double")
    right = F.coalesce(y, F.lit(0.0)) + prior_weight * prior_mean
    state = save_round(values.join(pulls, ["model_id", "vertex"], "left").select(
        "model_id", "vertex", (y.isNotNull().cast("double") + prior_weight + F.coalesce("deg", F.lit(0.0))).alias("diag"),
        F.lit(0.0).alias("x"), right.alias("r")).withColumn("p", F.col("r") / F.col("diag")), "quadratic")
    saved, parts, report = state, [], []
    sums = [F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")]
    first = {row.model_id: (row.rz, row.rr) for row in state.groupBy("model_id").agg(*sums).collect()}
    ready = [m for m, (_, rr) in first.items() if rr == 0]
    if ready:
        report += [(m, 0, True) for m in ready]
        parts.append(state.where(F.col("model_id").isin(ready)).select("model_id", "vertex", F.lit(0.0).alias("beta")))
        state = state.where(~F.col("model_id").isin(ready))
    length = {m: rz for m, (rz, _) in first.items() if m not in ready}
    done = 0
    while length and done < rounds:
        done += 1
        heads = state.select("model_id", F.col("vertex").alias("other"), F.col("p").alias("_p"))
        carried = links.join(heads, ["model_id", "other"]).groupBy("model_id", "vertex").agg(
            F.sum(F.col("c") * F.col("_p")).alias("_pulled"))
        walked = save_round(state.join(carried, ["model_id", "vertex"], "left").select(
            "model_id", "vertex", "diag", "x", "r", "p",
            (F.col("diag") * F.col("p") - F.coalesce("_pulled", F.lit(0.0))).alias("q")), "quadratic")
        if not any(saved is part for part in parts) and not (done == 1 and ready):
            drop_round(saved)
        saved = walked
        bend = {row.model_id: row.pq for row in walked.groupBy("model_id").agg(
            F.sum(F.col("p") * F.col("q")).alias("pq")).collect()}
        steps = spark.createDataFrame([(m, length[m] / bend[m]) for m in length], "model_id bigint, alpha double")
        moved = walked.join(F.broadcast(steps), "model_id").withColumns({
            "x": F.expr("x + alpha * p"), "r": F.expr("r - alpha * q")}).drop("alpha", "q")
        after = {row.model_id: (row.rz, row.rr) for row in moved.groupBy("model_id").agg(*sums).collect()}
        settled = [m for m, (_, rr) in after.items() if rr <= tol * tol * first[m][1]]
        if settled:
            report += [(m, done, True) for m in settled]
            ended = F.broadcast(spark.createDataFrame([(m,) for m in settled], "model_id bigint"))
            parts.append(save_round(moved.join(ended, "model_id", "left_semi").select(
                "model_id", "vertex", F.col("x").alias("beta")), "settled"))
        turns = [(m, after[m][0] / length[m]) for m in length if m not in settled]
        length = {m: after[m][0] for m, _ in turns}
        turned = F.broadcast(spark.createDataFrame(turns, "model_id bigint, turn double"))
        state = moved.join(turned, "model_id").withColumn("p", F.expr("r / diag + turn * p")).drop("turn")
    if length:
        parts.append(state.select("model_id", "vertex", F.col("x").alias("beta")))
        report += [(m, done, False) for m in length]
    listed = spark.createDataFrame(report, "model_id bigint, rounds int, settled boolean")
    if not parts:
        parts.append(state.select("model_id", "vertex", F.col("x").alias("beta")))
    return Fit(reduce(DataFrame.unionByName, parts), done, not length, listed)
