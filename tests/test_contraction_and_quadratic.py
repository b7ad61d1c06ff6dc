"""Components by contraction, and squared penalties against plain solvers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonehour.operators import graph as G
from zonehour.operators import joins as J
from zonehour.operators import quadratic as Q
from zonehour.operators import smoothing as S

EDGE = "src bigint, dst bigint, temporal boolean"


def _grid(n):
    at = lambda i, j: i * n + j
    edges = [(at(i, j), at(i + 1, j), False) for i in range(n - 1) for j in range(n)]
    return edges + [(at(i, j), at(i, j + 1), True) for i in range(n) for j in range(n - 1)]


def _find(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


@pytest.mark.parametrize("share", [1000, 3])
def test_contraction_equals_union_find(spark, monkeypatch, share):
    """Random parts, a star of a third of all edges around its greatest or least node, a shuffled path, loops and NULLs."""
    monkeypatch.setattr(J, "HOT_SHARE", share)
    rnd = random.Random(share)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    edges += [(1000, 1000 + k) for k in range(1, 150)] + [(9000, 8000 + k) for k in range(150)]
    path = list(range(2000, 2400))
    rnd.shuffle(path)
    edges += list(zip(path, path[1:])) + [(7777, 7777)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None), edges[0]], "zone1 int, zone2 int")
    assert {r.node: r.component for r in G.contracted_components(df).collect()} == _find(edges)
    assert G.contracted_components(df.where("false")).count() == 0


def test_contraction_of_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    mark = G._mark
    monkeypatch.setattr(G, "_mark", lambda e: rounds.append(mark(e)) or rounds[-1])
    n = 100_000
    path = spark.range(n - 1).selectExpr("id AS zone1", "id + 1 AS zone2")
    labels = G.contracted_components(path)
    assert labels.count() == n and labels.where("component <> 0").count() == 0
    assert len(rounds) <= 25 and all(a[0] >= b[0] for a, b in zip(rounds, rounds[1:]))


def test_quadratic_equals_a_dense_solve(spark):
    rnd = np.random.default_rng(3)
    n, edges = 49, _grid(7)
    y = [None if rnd.random() < 0.3 else float(rnd.normal(5, 2)) for _ in range(n)]
    models = [(0, 0.2, 0.4), (1, 3.0, 0.0), (2, 100.0, 50.0), (3, 0.0, 0.0)]
    rows = [(m, v, y[v]) for m, *_ in models for v in range(n)] + [(4, v, None) for v in range(n)]
    values = spark.createDataFrame(rows, "model_id bigint, vertex bigint, value double")
    table = spark.createDataFrame([*models, (4, 1.0, 1.0)], "model_id bigint, l2_space double, l2_time double")
    weighted = [(a, b, t, 1.0 + (a + b) % 3) for a, b, t in edges]
    fit = Q.smooth_quadratic(values, spark.createDataFrame(weighted, EDGE + ", weight double"), table)
    got = {(r.model_id, r.vertex): r.beta for r in fit.result().collect()}
    assert len(got) == 5 * n and {r.model_id for r in fit.models.where("settled").collect()} == set(range(5))
    for m, space, time in models:
        a = np.diag([(v is not None) + 1e-3 for v in y]).astype(float)
        for i, j, t, w in weighted:
            c = 2 * w * (time if t else space)
            a[i, i] += c
            a[j, j] += c
            a[i, j] -= c
            a[j, i] -= c
        right = np.array([v or 0.0 for v in y])
        mine = np.array([got[m, v] for v in range(n)])
        assert np.abs(mine - np.linalg.solve(a, right)).max() < 1e-6
        assert np.linalg.norm(a @ mine - right) < 1e-8 * max(1, np.linalg.norm(right))
    assert all(got[4, v] == 0 for v in range(n))


def test_quadratic_agrees_with_the_general_fit(spark):
    rnd = random.Random(4)
    values = spark.createDataFrame([(0, v, rnd.gauss(3, 1)) for v in range(25)], "model_id bigint, vertex bigint, value double")
    edges = spark.createDataFrame(_grid(5), EDGE)
    pen = spark.createDataFrame([(0, 0.0, 0.7, 0.0, 0.2)], "model_id bigint, l1_space double, l2_space double, l1_time double, l2_time double")
    exact = {r.vertex: r.beta for r in Q.smooth_quadratic(values, edges, pen).result().collect()}
    steps = S.smooth_gaussian(values, edges, pen, rounds=200, tol=1e-5).result().collect()
    assert max(abs(exact[r.vertex] - r.beta) for r in steps) < 1e-3
    with pytest.raises(ValueError):
        Q.smooth_quadratic(values, edges, pen.withColumn("l1_time", F.lit(0.1)))
