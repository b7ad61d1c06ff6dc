"""Quantiles, split trees, counts and densities: known values and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonehour.functions.likelihood import hash_uniform, log_logistic, logistic, poisson_one
from zonehour.operators import counts as C
from zonehour.operators import density as D
from zonehour.operators import splits as T
from zonehour.operators.quantiles import exact_quantiles, histogram


def _numbers(spark, rows, cols="x double"):
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("limit", [0, None])
def test_exact_quantiles_equal_linear_interpolation(spark, limit):
    rnd = random.Random(8)
    xs = ([rnd.gauss(0, 1) for _ in range(800)] + [0.0] * 300 + [5.25] * 500
          + [rnd.uniform(1e6, 1e9) for _ in range(40)] + [-1e-300, 1e-300, -7e12])
    probs = [0, 0.001, 0.05, 0.25, 0.5, 0.51, 0.75, 0.97, 1]
    df = _numbers(spark, [(x,) for x in xs] + [(None,)])
    got = {r.prob: r.quantile for r in exact_quantiles(df, "x", probs, gather_limit=limit).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-300)


def test_exact_quantiles_by_key_with_one_hot_key(spark):
    rnd = random.Random(9)
    groups = {"hot": [rnd.expovariate(1) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0],
              "flat": [3.0] * 50}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    df = _numbers(spark, rows, "k string, x double")
    got = exact_quantiles(df, "x", [0.1, 0.5, 0.95], keys=["k"], gather_limit=0).collect()
    assert len(got) == 12
    for r in got:
        assert r.quantile == pytest.approx(np.quantile(groups[r.k], r.prob), rel=1e-12)


def test_histogram_closes_the_top_bin(spark):
    df = _numbers(spark, [(float(x),) for x in range(11)])
    assert {r.bin: r.n for r in histogram(df, "x", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert histogram(_numbers(spark, [(2.0,), (2.0,)]), "x", 5).collect()[0].n == 2


# Ends and outer quantiles of the published tree, and the tail cuts they must give.
LOW, Q1, Q31, HIGH = 1.2841484605899862, 5.92094747498866, 41.01080253239303, 124.19509625687544
LEFT_CUT = 3.6025479677893233
RIGHT_CUTS = [52.80864202591442, 64.60648151943582, 76.40432101295721, 88.2021605064786]


@pytest.fixture(scope="module")
def tree(spark):
    inner = np.linspace(Q1, Q31, 31)
    df = _numbers(spark, [(float(x),) for x in [LOW, *inner, HIGH]])
    return T.quantile_splits(df, "x")


def test_quantile_tree_has_the_published_shape(tree):
    rows = tree.orderBy("split_id").collect()
    assert [sum(r.lvl == k for r in rows) for k in range(9)] == [1, 2, 4, 8, 16, 2, 1, 1, 1]
    assert rows[0].lo == LOW and rows[0].up == HIGH
    assert any(abs(r.mid - LEFT_CUT) < 1e-9 and r.lo == LOW for r in rows)
    mids = [r.mid for r in rows]
    for cut in RIGHT_CUTS:
        assert min(abs(m - cut) for m in mids) < 1e-9
    for r in rows[1:]:
        parents = [p for p in rows if (p.lo, p.mid) == (r.lo, r.up) or (p.mid, p.up) == (r.lo, r.up)]
        assert len(parents) == 1


def test_evaluation_points_are_ends_and_midpoints(tree):
    points = [r.x for r in T.evaluation_points(tree).orderBy("x_num").collect()]
    mids = sorted(r.mid for r in tree.collect())
    assert points == [LOW, *mids, HIGH] and len(points) == 38


def _values(spark, tree, n=3000):
    rnd = random.Random(1)
    cuts = T.cut_points(tree)
    xs = [rnd.uniform(0, 130) for _ in range(n)] + cuts * 3
    rows = [(0 if rnd.random() < 0.35 else rnd.randrange(12), x) for x in xs]
    return rows, spark.createDataFrame(rows, "vertex int, productivity double")


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("closed", ["left", "right", "neither"])
def test_split_counts_equal_brute_force(spark, tree, closed, wide, monkeypatch):
    if not wide:
        monkeypatch.setattr(C, "WIDE_SPLITS", 5)
    rows, df = _values(spark, tree)
    splits = tree.collect()
    top, low = max(s.up for s in splits), min(s.lo for s in splits)

    def held(x, lo, up):
        if closed == "left":
            return lo <= x < up or x == up == top
        if closed == "right":
            return lo < x <= up or x == lo == low
        return lo < x < up

    def left(x, s):
        return x <= s.mid if closed == "right" else x < s.mid

    want = {}
    for v, x in rows:
        for s in splits:
            if held(x, s.lo, s.up):
                a = want.setdefault((v, s.split_id), [0, 0])
                a[0] += left(x, s)
                a[1] += 1
    got = C.split_counts(df, tree, closed=closed).collect()
    assert {(r.vertex, r.split_id): [r.successes, r.attempts] for r in got} == want
    verts = spark.range(20).selectExpr("cast(id AS int) AS vertex")
    dense = C.split_counts(df, tree, closed=closed, vertices=verts)
    assert dense.count() == 20 * 36
    assert dense.agg(F.sum("attempts")).first()[0] == sum(a[1] for a in want.values())


def test_children_share_out_their_parent(spark, tree):
    _, df = _values(spark, tree)
    n = {r.split_id: r for r in C.split_totals(C.split_counts(df, tree), tree).collect()}
    for c in n.values():
        for p in n.values():
            if (p.lo, p.mid) == (c.lo, c.up):
                assert c.attempts == p.successes
            if (p.mid, p.up) == (c.lo, c.up):
                assert c.attempts == p.attempts - p.successes


@pytest.fixture(scope="module")
def betas(spark, tree):
    rnd = random.Random(6)
    rows = [(v, s, rnd.gauss(0, 2)) for v in range(5) for s in range(36)]
    return spark.createDataFrame(rows, "vertex int, split_id int, beta double")


def test_leaf_masses_sum_to_one_and_do_not_depend_on_the_path(tree, betas, monkeypatch):
    wide = {(r.vertex, r.leaf): r.prob for r in D.leaf_probabilities(betas, tree).collect()}
    assert len(wide) == 5 * 37
    for v in range(5):
        assert sum(p for (w, _), p in wide.items() if w == v) == pytest.approx(1)
    monkeypatch.setattr(D, "WIDE_SPLITS", 5)
    joined = {(r.vertex, r.leaf): r.prob for r in D.leaf_probabilities(betas, tree).collect()}
    assert joined == pytest.approx(wide, rel=1e-12)


def test_quantiles_invert_the_distribution_function(tree, betas):
    leaves = D.leaf_probabilities(betas, tree)
    table = {}
    for r in leaves.orderBy("vertex", "leaf").collect():
        table.setdefault(r.vertex, []).append((r.leaf_lo, r.leaf_up, r.prob))
    for r in D.density_quantile(leaves, (0.0001, 0.1, 0.5, 0.9, 0.9999)).collect():
        cdf = sum(p * min(max((r.value - lo) / (up - lo), 0), 1) for lo, up, p in table[r.vertex])
        assert cdf == pytest.approx(r.level, abs=1e-9)


def test_tails_fall_with_the_level(tree, betas):
    points = D.point_probabilities(D.leaf_probabilities(betas, tree))
    tails = D.tail_probability(points, (0.0, 18.56, 21.64, 32.73, 200.0)).collect()
    for v in range(5):
        row = [r.tail_prob for r in sorted(tails, key=lambda r: r.level) if r.vertex == v]
        assert row[0] == pytest.approx(1) and row[-1] == 0
        assert all(a >= b for a, b in zip(row, row[1:]))


def test_heldout_nll_matches_row_by_row(spark, tree, betas):
    leaves = D.leaf_probabilities(betas, tree)
    rnd = random.Random(3)
    values = spark.createDataFrame(
        [(rnd.randrange(5), rnd.uniform(2, 120)) for _ in range(500)], "vertex int, x double")
    rows = D.log_density_at(values, leaves, tree, "x")
    assert rows.where("log_density IS NULL").count() == 0
    one = D.heldout_nll(values, leaves, tree, "x").first()
    assert one.n == 500
    assert one.nll == pytest.approx(-rows.agg(F.avg("log_density")).first()[0])


def test_trapezoid_uses_both_ends(spark):
    grid = spark.createDataFrame([(i, i / 10) for i in range(11)], "x_num int, x double")
    total = D.trapezoid_weights(grid).agg(F.sum(F.col("weight") * F.col("x") * F.col("x"))).first()[0]
    assert total == pytest.approx(np.trapezoid([(i / 10) ** 2 for i in range(11)], dx=0.1))


def test_logistic_is_stable(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "b double").select(
        logistic(F.col("b")).alias("p"), log_logistic(F.col("b")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [(0.0, -800.0), (0.5, pytest.approx(-np.log(2))), (1.0, 0.0)]


def test_hashed_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(40000).select(poisson_one(hash_uniform(F.col("id"), 3)).alias("w"))
    mean, var = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=0.02) and var == pytest.approx(1, abs=0.04)
