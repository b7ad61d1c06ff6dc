"""Smoothing, cross-validation and bootstrap run to convergence on small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonehour.operators import density as D
from zonehour.operators import graph as G
from zonehour.operators import smoothing as S
from zonehour.operators import splits as T
from zonehour.operators import validation as V
from zonehour.plans import search as E
from zonehour.plans.spacetime import spacetime
from zonehour.sources import shared

MODEL = "model_id bigint, l1_space double, l2_space double, l1_time double, l2_time double"
EDGE = "src bigint, dst bigint, temporal boolean"
COUNT = "model_id bigint, vertex bigint, successes bigint, attempts bigint"


def _grid(n=4):
    at = lambda i, j: i * n + j
    edges = [(at(i, j), at(i + 1, j), False) for i in range(n - 1) for j in range(n)]
    return edges + [(at(i, j), at(i, j + 1), True) for i in range(n) for j in range(n - 1)]


def _counts(n=16, seed=0, models=(0,)):
    rnd = random.Random(seed)
    base = [(v, rnd.randrange(1, 9), rnd.randrange(10, 30)) for v in range(n)]
    return [(m, v, s, a) for m in models for v, s, a in base]


def _fit(spark, counts, edges, models, **kw):
    return S.smooth_binomial(spark.createDataFrame(counts, COUNT), spark.createDataFrame(edges, EDGE),
                             spark.createDataFrame(models, MODEL), **kw)


def test_no_penalty_and_huge_penalty(spark):
    counts = _counts(models=(0, 1, 2))
    fit = _fit(spark, counts, _grid(), [(0, 0.0, 0.0, 0.0, 0.0), (1, 500.0, 0.0, 500.0, 0.0),
                                        (2, 0.0, 500.0, 0.0, 500.0)], rounds=80, tol=1e-4)
    got = {(r.model_id, r.vertex): r.beta for r in fit.betas.collect()}
    s, n = sum(c[2] for c in counts if c[0] == 0), sum(c[3] for c in counts if c[0] == 0)
    for m, v, si, ni in counts:
        if m == 0:
            assert got[m, v] == pytest.approx(np.log(si / (ni - si)), abs=2e-3)
        else:
            assert got[m, v] == pytest.approx(np.log(s / (n - s)), abs=0.05)


def _reference_solution(counts, edges, pen, rounds=4000):
    """The same problem by proximal steps on the whole dense system."""
    s = np.array([c[2] for c in counts]) + 1e-3
    n = np.array([c[3] for c in counts]) + 2e-3
    a = np.zeros((len(edges), len(counts)))
    for k, (i, j, _) in enumerate(edges):
        a[k, i], a[k, j] = 1, -1
    l1 = np.array([pen[2] if t else pen[0] for *_, t in edges])
    l2 = np.array([pen[3] if t else pen[1] for *_, t in edges])
    b, z, u = np.zeros(len(counts)), np.zeros(len(edges)), np.zeros(len(edges))
    for _ in range(rounds):
        for _ in range(3):
            p = 1 / (1 + np.exp(-b))
            g = n * p - s + a.T @ (a @ b - z + u)
            b = b - np.linalg.solve(np.diag(n * p * (1 - p)) + a.T @ a + 1e-9 * np.eye(len(b)), g)
        v = a @ b + u
        z = np.sign(v) * np.maximum(np.abs(v) - l1, 0) / (1 + 2 * l2)
        u = u + a @ b - z
    d = a @ b
    value = np.sum(n * np.logaddexp(0, b) - s * b) + np.sum(l1 * np.abs(d) + l2 * d * d)
    return b, value


def test_minimiser_and_objective(spark):
    counts, edges, pen = _counts(seed=4), _grid(), (0.6, 0.2, 0.3, 0.8)
    fit = _fit(spark, counts, edges, [(0, *pen)], rounds=100, tol=1e-4)
    want, value = _reference_solution(counts, edges, pen)
    got = {r.vertex: r.beta for r in fit.betas.collect()}
    assert max(abs(got[v] - want[v]) for v in got) < 5e-3
    obj = S.objective(spark.createDataFrame(counts, COUNT), spark.createDataFrame(edges, EDGE),
                      spark.createDataFrame([(0, *pen)], MODEL), fit.betas).first().objective
    assert obj == pytest.approx(value, abs=1e-3)


def test_models_settle_at_their_own_round(spark):
    """Weak, medium and strong penalties together: each model ends by itself, at its own minimiser."""
    pens = {3: (0.01, 0.001, 0.01, 0.001), 5: (0.6, 0.2, 0.3, 0.8), 8: (0.1, 30.0, 0.1, 30.0)}
    counts, edges = _counts(seed=4, models=tuple(pens)), _grid()
    fit = _fit(spark, counts, edges, [(m, *pen) for m, pen in pens.items()], rounds=150, tol=1e-3, check_every=5)
    report = {r.model_id: r for r in fit.models.collect()}
    assert fit.converged and set(report) == set(pens) and all(r.settled for r in report.values())
    assert len({r.rounds for r in report.values()}) > 1 and max(r.rounds for r in report.values()) == fit.rounds
    got = {(r.model_id, r.vertex): r.beta for r in fit.result().collect()}
    assert len(got) == len(counts) == fit.betas.count()
    for m, pen in pens.items():
        want, _ = _reference_solution([c for c in counts if c[0] == m], edges, pen)
        assert max(abs(got[m, v] - want[v]) for v in range(16)) < 2e-2


def test_unsettled_models_are_reported_and_refused(spark):
    fit = _fit(spark, _counts(seed=4, models=(0, 1)), _grid(), [(0, 0.01, 0.001, 0.01, 0.001), (1, 10.0, 100.0, 10.0, 100.0)],
               rounds=20, tol=1e-3, check_every=5)
    report = {r.model_id: r.settled for r in fit.models.collect()}
    assert report == {0: True, 1: False} and not fit.converged
    with pytest.raises(RuntimeError):
        fit.result()
    assert fit.result("keep").count() == 32


def test_heldout_betas_come_from_the_fit_without_their_fold(spark):
    counts, edges, pen = _counts(seed=6), _grid(), (0.05, 0.8, 0.05, 0.8)
    table = spark.createDataFrame([(7, v, s, n) for _, v, s, n in counts], "split_id int, vertex bigint, successes bigint, attempts bigint")
    penalties = spark.createDataFrame([(7, *pen)], MODEL.replace("model_id bigint", "split_id int"))
    got = {r.vertex: r for r in E.heldout_betas(table, spark.createDataFrame(edges, EDGE), penalties, folds=2, rounds=150,
                                                tol=1e-3, check_every=5).collect()}
    folds = {r.vertex: r.fold for r in table.select("vertex", V.fold_of(F.col("vertex"), 2).alias("fold")).collect()}
    assert set(got) == set(range(16)) and {r.split_id for r in got.values()} == {7}
    for fold in (0, 1):
        masked = [(m, v, 0, 0) if folds[v] == fold else (m, v, s, n) for m, v, s, n in counts]
        want, _ = _reference_solution(masked, edges, pen)
        for v in range(16):
            if folds[v] == fold:
                assert got[v].fold == fold and abs(got[v].beta - want[v]) < 2e-2


def test_start_from_an_earlier_fit_and_stop(spark):
    counts, edges, pen = _counts(seed=4), _grid(), (0.6, 0.2, 0.3, 0.8)
    first = _fit(spark, counts, edges, [(0, *pen)], rounds=40, tol=1e-4)
    again = _fit(spark, counts, edges, [(0, *pen)], rounds=40, tol=1e-2, init=first.betas)
    assert again.converged and again.rounds < 40


def test_vertex_without_edges_or_data(spark):
    fit = _fit(spark, [(0, 0, 3, 10), (0, 1, 0, 0)], [], [(0, 1.0, 1.0, 1.0, 1.0)], rounds=15)
    got = {r.vertex: r.beta for r in fit.betas.collect()}
    assert got[0] == pytest.approx(np.log(0.3 / 0.7), abs=1e-3) and got[1] == pytest.approx(0, abs=1e-6)


def test_gaussian_ridge_equals_linear_solution(spark):
    edges, rnd = _grid(), random.Random(2)
    y = [None if rnd.random() < 0.3 else rnd.gauss(0, 1) for _ in range(16)]
    values = spark.createDataFrame([(0, v, x) for v, x in enumerate(y)],
                                   "model_id bigint, vertex bigint, value double")
    fit = S.smooth_gaussian(values, spark.createDataFrame(edges, EDGE),
                            spark.createDataFrame([(0, 0.0, 0.7, 0.0, 0.7)], MODEL), rounds=100, tol=1e-4)
    a = np.diag([1e-3 + (x is not None) for x in y])
    for i, j, _ in edges:
        a[i, i] += 1.4
        a[j, j] += 1.4
        a[i, j] -= 1.4
        a[j, i] -= 1.4
    want = np.linalg.solve(a, [x or 0.0 for x in y])
    got = {r.vertex: r.beta for r in fit.betas.collect()}
    assert max(abs(got[v] - want[v]) for v in got) < 5e-3


def test_folds_cover_every_observed_vertex_evenly(spark):
    df = spark.range(20000).selectExpr("id AS vertex", "cast(id % 3 AS bigint) AS attempts")
    sizes = V.assign_folds(df, 4, seed=9).groupBy("fold").count().collect()
    by = {r.fold: r["count"] for r in sizes}
    assert by.pop(None) == 6667 and len(by) == 4
    assert max(by.values()) < 1.1 * min(by.values())


def test_smoothing_beats_raw_frequencies_on_held_out_data(spark):
    """Known smooth surface, few observations: cross-validation must prefer smoothing."""
    rnd = random.Random(12)
    rows = []
    for v in range(64):
        i, j = divmod(v, 8)
        p = 1 / (1 + np.exp(-(np.sin(i / 2) + np.cos(j / 2))))
        n = rnd.randrange(0, 5)
        rows.append((0, v, int(sum(rnd.random() < p for _ in range(n))), n))
    counts = spark.createDataFrame(rows, "split_id int, vertex bigint, successes bigint, attempts bigint")
    edges = spark.createDataFrame(_grid(8), EDGE)
    cand = spark.createDataFrame(
        [(0, 1e-12, 1e-12, 1e-12, 1e-12), (1, 0.05, 1.0, 0.05, 1.0)],
        "candidate int, l1_space double, l2_space double, l1_time double, l2_time double")
    scores = E.cross_validate(counts, edges, cand, folds=4, rounds=150, tol=1e-2, check_every=5)
    best = V.best_candidate(scores, "cv_loglik").first()
    assert best.candidate == 1
    assert scores.agg(F.max("heldout_attempts")).first()[0] == sum(r[3] for r in rows)
    betas = E.fit_best(counts, edges, scores, rounds=150, tol=1e-2, check_every=5)
    assert betas.count() == 64


def test_events_to_densities_end_to_end(spark):
    rnd = random.Random(7)
    values = spark.createDataFrame(
        [(k, rnd.choice([1, 2, 3, 4, 9]), rnd.randrange(1, 169), rnd.gammavariate(4, 6)) for k in range(4000)],
        "ride_id bigint, zone int, hour int, productivity double")
    adj = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 10)], "zone1 int, zone2 int")
    splits = shared.save_round(T.trail_levels(
        T.level_cuts(values, "productivity", T.dyadic_probs(2)), 2), "tree")
    st = spacetime(adj, values, splits)
    assert st.vertices.count() == 4 * 168          # zone 9 is cut off
    assert st.edges.count() == 168 * (3 + 4)
    assert st.counts.count() == 4 * 168 * 3
    pen = splits.selectExpr("split_id", "0.05D AS l1_space", "0.5D AS l2_space", "0.05D AS l1_time",
                            "0.5D AS l2_time")
    placed = G.map_node_to_vertex(values, st.vertices)
    samples = E.bootstrap_samples(placed, st.vertices, st.edges, splits, pen, samples=3, rounds=100, tol=5e-2, check_every=5)
    assert samples.count() == 4 * 168 * 3 * 3
    leaves = D.leaf_probabilities(samples, splits, ("vertex", "sim"))
    off = leaves.groupBy("vertex", "sim").agg(F.sum("prob").alias("p")).where(F.abs(F.col("p") - 1) > 1e-9)
    assert off.count() == 0


def test_rounds_go_to_the_named_folder(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = shared.shared_dir(spark)
    kept = shared.save_round(spark.range(5), "probe")
    assert kept._zonehour_path.startswith(path) and kept.count() == 5
    shared.drop_round(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._zonehour_path).count()


def test_zone_surfaces_are_fitted_in_each_query(spark, monkeypatch):
    from workload import fit_queries

    fits = []
    monkeypatch.setattr(fit_queries, "_zone_fit", lambda spark, sf: (len(fits), fits.append(sf)))
    monkeypatch.setattr(fit_queries, "surfaces", lambda fit, splits, keys: fit)
    assert [fit_queries.zone_surfaces(spark, "some/path") for _ in range(2)] == [0, 1]
