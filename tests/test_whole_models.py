"""Models fitted in their own tasks against the same models fitted on tables."""

import random

import pytest
from pyspark.sql import functions as F

from zonehour.operators import coarsening as Z
from zonehour.operators import smoothing as S
from zonehour.operators import whole_models as W
from zonehour.plans import search as E

MODEL = "model_id bigint, l1_space double, l2_space double, l1_time double, l2_time double"
EDGE = "src int, dst int, temporal boolean, weight double"
COUNT = "model_id bigint, vertex int, successes bigint, attempts bigint"
KW = {"rounds": 150, "tol": 1e-2, "check_every": 5}


def grid(n=5):
    edges = [(i * n + j, i * n + n + j, False, 1.0) for i in range(n - 1) for j in range(n)]
    return edges + [(i * n + j, i * n + j + 1, True, 1.0) for i in range(n) for j in range(n - 1)]


def frames(spark, edges, models=3, size=25, void=True):
    rnd = random.Random(5)
    rows = [(m, v, rnd.randrange(0, 6), rnd.randrange(6, 20)) for m in range(models) for v in range(size)]
    if void:
        rows += [(m, None, 1, 4) for m in range(models)]
    pens = [(m, 0.3 / (m + 1), 0.2 * m, 0.1 * (m + 1), 0.4 / (m + 1)) for m in range(models)]
    return spark.createDataFrame(rows, COUNT), spark.createDataFrame(edges, EDGE), spark.createDataFrame(pens, MODEL)


def found(betas):
    return {(r.model_id, r.vertex): r.beta for r in betas.collect()}


def both(monkeypatch, fit):
    """What ``fit`` gives in tasks, and on tables."""
    first = fit()
    with monkeypatch.context() as m:
        m.setattr(W, "MOST_EDGES", -1)
        return first, fit()


def jobs(spark, work):
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        done = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return done, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def same(a, b):
    assert set(a) == set(b) and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_same_betas_and_rounds_as_on_tables(spark, monkeypatch):
    """Parallel edges, loops, weights, unknown and NULL ends, and a vertex of NULL."""
    edges = grid() + [(0, 1, True, 2.5), (0, 1, True, 2.5), (7, 7, False, 1.0), (3, 99, False, 1.0), (None, 3, False, 1.0), (2, 8, None, 0.5)]
    counts, links, models = frames(spark, edges)
    task, table = both(monkeypatch, lambda: S.smooth_binomial(counts, links, models, **KW))
    same(found(task.result()), found(table.result()))
    assert task.betas.dtypes == table.betas.dtypes and len(found(task.betas)) == 78
    report = lambda fit: sorted(tuple(r) for r in fit.models.collect())
    assert report(task) == report(table) and task.rounds == table.rounds and task.converged


def test_starts_and_unfinished_fits_as_on_tables(spark, monkeypatch):
    counts, links, models = frames(spark, grid(), void=False)
    start = counts.select("model_id", "vertex", (F.col("vertex") / 25.0).alias("beta"))
    for kw in ({"rounds": 7, "tol": 0.0}, {"rounds": 12, "tol": 1e-9, "check_every": 5}):
        task, table = both(monkeypatch, lambda: S.smooth_binomial(counts, links, models, init=start, **kw))
        same(found(task.betas), found(table.betas))
        assert not task.converged and task.rounds == table.rounds
        with pytest.raises(RuntimeError):
            task.result()


def test_gaussian_as_on_tables(spark, monkeypatch):
    counts, links, models = frames(spark, grid())
    values = counts.select("model_id", "vertex", F.when(F.col("attempts") % 3 > 0, F.col("successes") * 1.5).alias("value"))
    task, table = both(monkeypatch, lambda: S.smooth_gaussian(values, links, models, prior_mean=2.0, **KW))
    same(found(task.result()), found(table.result()))


def test_coarse_levels_as_on_tables(spark, monkeypatch):
    """The levels of each model are summed, started and handed down in its task."""
    edges = [*grid(12), (3, 4, True, 1.0), (3, 4, True, 1.0)]
    counts, links, models = frames(spark, edges, size=144, void=False)
    task, table = both(monkeypatch, lambda: Z.smooth_from_coarse(counts, links, models, coarsest=20, rounds=10, tol=1e-9, check_every=5))
    assert len(task[1]) > 2 and task[1] == table[1]
    same(found(task[0].betas), found(table[0].betas))


def test_a_coarse_start_adds_no_job_a_round(spark):
    """Levels are fitted one after the other inside each model's task."""
    counts, links, models = frames(spark, grid(8), size=64, void=False)
    (fit, report), few = jobs(spark, lambda: Z.smooth_from_coarse(counts, links, models, coarsest=30, **KW))
    assert fit.converged and len(report) == 2 and few <= 80
    _, again = jobs(spark, lambda: Z.smooth_from_coarse(counts, links, models, coarsest=30, rounds=90, tol=0.0))
    assert again <= few + 5


def test_a_fit_is_a_few_jobs_whatever_its_rounds(spark):
    counts, links, models = frames(spark, grid(), models=12, void=False)
    fit, few = jobs(spark, lambda: S.smooth_binomial(counts, links, models, **KW))
    assert fit.converged and fit.rounds >= 10 and few <= 15


def test_held_out_fits_are_a_few_jobs(spark):
    """All folds and splits of the held-out scores end in their own tasks."""
    counts, links, models = frames(spark, grid(), models=4, void=False)
    renamed = lambda df: df.withColumn("split_id", F.col("model_id").cast("int")).drop("model_id")
    betas, few = jobs(spark, lambda: E.heldout_betas(renamed(counts), links, renamed(models), 5, **KW).collect())
    assert len(betas) == 100 and few <= 30


def test_a_vertex_given_twice_is_refused(spark):
    counts, links, models = frames(spark, grid(), models=1)
    with pytest.raises(Exception, match="has a vertex twice"):
        S.smooth_binomial(counts.union(counts), links, models, **KW)


def test_cross_validation_and_the_best_fit_are_a_few_jobs(spark):
    """Candidates, folds and splits end in their own tasks, whatever rounds the slowest needs."""
    counts, links, models = frames(spark, grid(), models=2, void=False)
    table = counts.withColumn("split_id", F.col("model_id").cast("int")).drop("model_id")
    pens = models.withColumn("candidate", F.col("model_id").cast("int")).drop("model_id")

    def search():
        scores = E.cross_validate(table, links, pens, 3, **KW)
        return E.fit_best(table, links, scores, **KW).collect()

    betas, few = jobs(spark, search)
    assert len(betas) == 50 and few <= 60
