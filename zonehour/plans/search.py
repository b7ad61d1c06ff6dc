"""Cross-validated penalties, the final fit, bootstrap samples, and the search report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import posterior as P
from ..operators import validation as V
from ..operators.counts import roll_up
from ..operators.joins import null_safe
from ..operators.quantiles import exact_quantiles
from ..operators.smoothing import PENALTIES, smooth_binomial
from ..sources.shared import save_round


def cross_validate(counts: DataFrame, edges: DataFrame, candidates: DataFrame, folds: int = 5,
                   seed: int = 0, unfinished: str = "error", **fit) -> DataFrame:
    """(split_id, candidate, penalties, cv_loglik, heldout_attempts).

    All splits, candidates and folds are fitted in one job; a fit that hasn't converged is an error
    unless ``unfinished`` is "keep".
    """
    models = save_round(
        V.cross_models(counts.select("split_id").distinct(), candidates, folds), "models")
    folded = V.assign_folds(counts, folds, seed)
    training = V.mask_fold(folded, folds).join(
        models.select("split_id", "held_fold", "model_id"), ["split_id", "held_fold"]
    ).select("model_id", "vertex", "successes", "attempts")
    betas = smooth_binomial(training, edges, models, **fit).result(unfinished)
    test = folded.where(F.col("fold").isNotNull()).join(
        models.select("split_id", F.col("held_fold").alias("fold"), "candidate", "model_id"),
        ["split_id", "fold"])
    scores = V.cv_loglik(test, betas)
    return scores.join(candidates.select("candidate", *PENALTIES), "candidate")


def heldout_betas(counts: DataFrame, edges: DataFrame, penalties: DataFrame, folds: int = 5, seed: int = 0,
                  unfinished: str = "error", **fit) -> DataFrame:
    """(split_id, fold, vertex, beta): log-odds of every vertex from the fit in which its own fold has no counts.

    The vertex keeps its place in the graph and gets its rate from its neighbours alone. ``penalties``:
    split_id and the four penalties. All folds and splits are one job; a vertex is held out at every split by
    the same fold.
    """
    listed = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    models = save_round(penalties.select("split_id", *PENALTIES).withColumn("held_fold", listed).withColumn(
        "model_id", F.col("split_id").cast("bigint") * folds + F.col("held_fold")), "models")
    folded = counts.withColumn("fold", V.fold_of(F.col("vertex"), folds, seed))
    training = V.mask_fold(folded, folds).join(models.select("split_id", "held_fold", "model_id"), ["split_id", "held_fold"])
    betas = smooth_binomial(training.select("model_id", "vertex", "successes", "attempts"), edges, models, **fit).result(unfinished)
    own = F.pmod(F.col("model_id"), F.lit(folds)).cast("int")
    return betas.where(own == V.fold_of(F.col("vertex"), folds, seed)).select(
        F.floor(F.col("model_id") / folds).cast("int").alias("split_id"), own.alias("fold"), "vertex", "beta")


def fit_best(counts: DataFrame, edges: DataFrame, scores: DataFrame, unfinished: str = "error",
             **fit) -> DataFrame:
    """(split_id, vertex, beta): each split refitted on all counts at its best penalties, to convergence."""
    best = save_round(V.best_candidate(scores, "cv_loglik").select(
        "split_id", F.col("split_id").cast("bigint").alias("model_id"), *PENALTIES), "best")
    rows = counts.select(F.col("split_id").cast("bigint").alias("model_id"), "vertex",
                         "successes", "attempts")
    done = smooth_binomial(rows, edges, best, **fit).result(unfinished)
    return done.select(F.col("model_id").cast("int").alias("split_id"), "vertex", "beta")


def bootstrap_samples(values: DataFrame, vertices: DataFrame, edges: DataFrame, splits: DataFrame,
                      penalties: DataFrame, samples: int, value: str = "productivity",
                      ident: str = "ride_id", seed: int = 0, init: DataFrame | None = None,
                      unfinished: str = "error", **fit):
    """(split_id, sim, vertex, beta): smoothed log-odds of Poisson-reweighted data.

    A bootstrap, not a posterior chain. ``penalties``: split_id and the four
    penalties; ``init`` (split_id, vertex, beta), e.g. the fit on all counts,
    starts every sample.
    """
    slots = P.bootstrap_slot_counts(values, splits, value, ["vertex"], samples, ident, seed)
    cells = vertices.select("vertex").withColumn(
        "sim", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    dense = roll_up(slots, splits, ["vertex", "sim"], vertices=cells)
    number = F.col("split_id").cast("bigint") * samples + F.col("sim")
    counts = dense.withColumn("model_id", number)
    models = penalties.withColumn(
        "sim", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("model_id", number)
    if init is not None:
        init = init.withColumn(
            "sim", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn(
            "model_id", number).select("model_id", "vertex", "beta")
    betas = smooth_binomial(counts, edges, models, init=init, **fit).result(unfinished)
    return betas.select(
        F.floor(F.col("model_id") / samples).cast("int").alias("split_id"),
        (F.col("model_id") % samples).cast("int").alias("sim"), "vertex", "beta")


#: Columns of a search run that the report shows, in display order.
SEARCH_AXES = ("gen", "lam_s1", "lam_s2", "lam_t1", "lam_t2", "cv_logll")
# Lower end and length of the display range of log10 penalties.
LINEAR_RANGE, SQUARED_RANGE = (-2.03, 2.78), (-4.03, 4.78)
DISPLAY = {"lam_s1": LINEAR_RANGE, "lam_t1": LINEAR_RANGE, "lam_s2": SQUARED_RANGE, "lam_t2": SQUARED_RANGE}


def search_report(runs: DataFrame) -> DataFrame:
    """One row per run of an even generation and axis: value, place in the axis' range, and the run's score.

    ``runs``: split_id, runid, gen, lam_s1, lam_s2, lam_t1, lam_t2, cv_logll. What a split's runs share (ends of
    the open axes, the score's 5% point) is computed once per split, joined to the runs, and only then are the
    axes unpivoted.
    """
    shown = runs.where("gen % 2 = 0").select(
        "split_id", "runid", F.col("gen").cast("double").alias("gen"), "cv_logll",
        *[F.log10(axis).alias(axis) for axis in DISPLAY])
    ends = shown.groupBy("split_id").agg(
        F.min("gen").alias("gen_from"), F.max("gen").alias("gen_to"),
        F.min("cv_logll").alias("score_from"), F.max("cv_logll").alias("score_to"))
    low = exact_quantiles(shown, "cv_logll", [0.05], keys=["split_id"]).select(
        "split_id", F.col("quantile").alias("score_low"))
    wide = null_safe(shown, null_safe(ends, low, ["split_id"]), ["split_id"])
    places = {
        "gen": "(gen - gen_from) / nullif(gen_to - gen_from, 0D)",
        "cv_logll": "(cv_logll - score_from) / nullif(score_to - score_from, 0D)",
        **{axis: f"({axis} - ({start}D)) / {length}D" for axis, (start, length) in DISPLAY.items()}}
    cells = ", ".join(f"'{axis}', {i}, {axis}, {places[axis]}" for i, axis in enumerate(SEARCH_AXES, 1))
    return wide.selectExpr(
        "split_id", "runid", f"stack({len(SEARCH_AXES)}, {cells}) AS (name, axis, value, value_norm)",
        "cv_logll / score_to AS cv_scaled", "greatest(cv_logll - score_low, 0D) + score_low AS cv_logll_norm")
