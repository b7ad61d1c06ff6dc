"""Sequences, zones and graphs against brute force on small fixtures."""

import random
from datetime import datetime, timedelta
from fractions import Fraction as Q

import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonehour.functions.planar import segments_intersect
from zonehour.operators import graph as G
from zonehour.operators import rides as R
from zonehour.operators import spatial as S
from zonehour.operators.ranking import average_ranks, number_rows
from zonehour.operators.reshape import natural_full_join


def _rides(n=400, drivers=6, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        driver = 0 if rnd.random() < 0.4 else rnd.randrange(drivers)
        created = datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        start = created + timedelta(minutes=rnd.randrange(0, 9))
        end = start + timedelta(minutes=rnd.randrange(1, 40))
        rows.append((i, driver, start, created, end, 4.0 + i % 7, 5.0 + i % 5))
    return rows


RIDE_SCHEMA = ("ride_id bigint, driver_id bigint, started_on timestamp_ntz, created_date timestamp_ntz, "
               "completed_on timestamp_ntz, fare_estimate double, fare_estimate_with_surge double")


@pytest.mark.parametrize("hot_rows", [10 ** 9, 0, 50])
def test_driver_sequence_follows_each_driver(spark, hot_rows):
    rows = _rides()
    df = spark.createDataFrame(rows, RIDE_SCHEMA)
    got = {r.ride_id: r for r in R.driver_sequence(df, hot_rows=hot_rows).collect()}
    assert len(got) == len(rows)
    by_driver = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_driver.setdefault(r[1], []).append(r)
    for rides in by_driver.values():
        for a, b in zip(rides, rides[1:] + [None]):
            g = got[a[0]]
            if b is None:
                assert g.unproductive_after is None and g.productivity is None
                continue
            gap = (b[2] - a[4]).total_seconds() / 60
            span = gap + (b[4] - b[2]).total_seconds() / 60
            assert g.unproductive_after == pytest.approx(gap)
            assert g.idle_after == pytest.approx((b[3] - a[4]).total_seconds() / 60)
            assert g.fare_next == b[5]
            if span:
                assert g.productivity == pytest.approx(b[5] / span * 60)


def test_negative_gaps_go_and_missing_gaps_stay(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, None)], "id int, unproductive_after double")
    assert sorted(r.id for r in R.drop_negative_gap(df).collect()) == [2, 3]


def test_full_join_matches_nulls(spark):
    a = spark.createDataFrame([(1, None, 10), (2, 5, 20)], "k int, s int, a int")
    b = spark.createDataFrame([(1, None, 7), (3, 1, 8)], "k int, s int, b int")
    got = sorted(map(tuple, natural_full_join(a, b).collect()))
    assert got == [(1, None, 10, 7), (2, 5, 20, None), (3, 1, None, 8)]


# --- zones -----------------------------------------------------------------------

# Concave, slanted and axis-parallel rings; zone 4 has two rings.
RINGS = [
    (1, 0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]),
    (2, 0, [(4.0, 0.0), (7.3, 0.4), (6.1, 5.2), (4.0, 4.0)]),
    (3, 0, [(0.0, 4.0), (2.0, 1.0), (4.0, 4.0), (2.0, 6.7)]),
    (4, 0, [(8.0, 8.0), (9.0, 8.0), (9.0, 9.0), (8.0, 9.0)]),
    (4, 1, [(0.3, 8.1), (1.9, 8.3), (1.1, 9.7)]),
    (5, 0, [(8.5, 8.5), (9.5, 8.5), (9.5, 9.5), (8.5, 9.5)]),
]


def _zones(spark):
    rows = [(z, k, [{"x": x, "y": y} for x, y in ring + ring[:1]]) for z, k, ring in RINGS]
    return spark.createDataFrame(rows, "zone_id int, ring_id int, ring array<struct<x:double,y:double>>")


def _inside(x, y, ring):
    """Even-odd test in exact arithmetic."""
    x, y, ring = Q(x), Q(y), [(Q(a), Q(b)) for a, b in ring]
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


@pytest.mark.parametrize("limit", [10 ** 6, 0])
@pytest.mark.parametrize("cell", [4.0, 1.0, 0.3])
def test_tag_zone_equals_brute_force(spark, cell, limit):
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-1, 10), rnd.uniform(-1, 10)) for i in range(1500)]
    points += [(2000 + i, float(x), float(y)) for i, (x, y) in enumerate(
        (x, y) for x in range(10) for y in range(10))]
    points += [(3000 + i, *p) for i, p in enumerate(p for _, _, ring in RINGS for p in ring)]
    df = spark.createDataFrame(points, "ride_id bigint, x double, y double")
    got = {r.ride_id: r.zone for r in S.tag_zone(
        df, _zones(spark), {"zone": ("x", "y")}, cell=cell, broadcast_segments=limit).collect()}
    for i, x, y in points:
        zones = [z for z, _, ring in RINGS if _inside(x, y, ring)]
        assert got[i] == (min(zones) if zones else None), (i, x, y)


def test_crowded_cells_are_salted_without_loss(spark, monkeypatch):
    pts = spark.range(5000).selectExpr("id AS ride_id", "0.5D AS x", "0.5D + id % 3 AS y")
    cells = S.zone_cells(S.ring_table(_zones(spark)), 1.0)
    out = S._tag_by_shuffle(pts, cells, "zone", "x", "y", "ride_id", 1.0, rows_per_salt=100)
    assert {r.zone for r in out.collect()} == {1} and out.count() == 5000


@pytest.mark.parametrize("p,q,eps,meets", [
    (((0, 0), (0, 2)), ((0, 1), (0, 3)), 0, True),     # both vertical, overlapping
    (((0, 0), (0, 1)), ((0, 2), (0, 3)), 0, False),    # both vertical, apart
    (((0, 0), (0, 1)), ((1, 0), (1, 1)), 0, False),    # both vertical, parallel lines
    (((0, 0), (2, 0)), ((1, -1), (1, 1)), 0, True),    # horizontal first segment
    (((0, 0), (2, 2)), ((1, 1), (3, 3)), 0, True),     # collinear
    (((0, 0), (1, 1)), ((2, 2), (3, 3)), 0, False),
    (((0, 0), (1, 0)), ((1.05, -1), (1.05, 1)), 0, False),
    (((0, 0), (1, 0)), ((1.05, -1), (1.05, 1)), 0.1, True),   # stretched
    (((0, 0), (4, 0)), ((1, 0), (2, 0)), 0, True),     # contained
    (((0, 0), (1, 0)), ((1, 0), (1, 5)), 0, True),     # shared corner
])
def test_segments_intersect(spark, p, q, eps, meets):
    f = lambda pt: tuple(F.lit(float(v)) for v in pt)
    both = spark.range(1).select(
        segments_intersect(f(p[0]), f(p[1]), f(q[0]), f(q[1]), eps).alias("a"),
        segments_intersect(f(q[0]), f(q[1]), f(p[0]), f(p[1]), eps).alias("b")).first()
    assert both.a == both.b == meets


@pytest.mark.parametrize("crowd", [1000, 3])
def test_adjacent_zones(spark, crowd):
    pairs = S.zone_adjacency(_zones(spark), max_dist=20.0, eps=0.0, cell=2.0, crowd=crowd).collect()
    assert sorted(map(tuple, pairs)) == [(1, 2), (1, 3), (2, 3), (4, 5)]
    near = S.zone_adjacency(_zones(spark), max_dist=3.5, eps=0.0, cell=2.0).collect()
    assert (1, 2) not in set(map(tuple, near))


# --- graphs ----------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rnd = random.Random(11)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    edges += [(1000, 1000 + k) for k in range(1, 200)]            # a hub
    edges += [(2000 + k, 2001 + k) for k in range(60)]            # a long chain
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "zone1 int, zone2 int")
    labels = G.connected_components(df)
    assert {r.node: r.component for r in labels.collect()} == {v: find(v) for v in parent}
    assert G.largest_component(labels).count() == 200


def test_number_rows_in_blocks(spark):
    keys = sorted(random.Random(2).sample(range(100000), 3000))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for block in (10, 7000):
        got = {r.k: r.n for r in number_rows(df, "k", "n", block=block, base=1).collect()}
        assert got == {k: i for i, k in enumerate(keys, start=1)}


def test_spacetime_graph_size_and_connection(spark):
    adj = spark.createDataFrame([(5, 9), (5, 7), (7, 9), (9, 12)], "zone1 int, zone2 int")
    ranks = G.number_zones(adj.withColumn("pos", F.col("zone1") * 100 + F.col("zone2")))
    # list order: (5,7) (5,9) (7,9) (9,12)
    assert {r.zone: r.zone_rank for r in ranks.collect()} == {5: 0, 7: 1, 9: 2, 12: 3}
    edges = G.spacetime_edges(adj, ranks)
    assert edges.count() == 168 * (4 + 4)
    parts = G.connected_components(edges, "src", "dst")
    assert parts.select("component").distinct().count() == 1
    assert parts.count() == 4 * 168
    assert G.spacetime_edges(adj, ranks, hours=3, periodic=False).count() == 3 * 4 + 2 * 4


def test_average_ranks_share_ties(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), float(rnd.choice([-3, -1.5, 0, 0.2, 1, 7, 7.1, 900]))) for _ in range(300)]
    pdf = pd.DataFrame(rows, columns=["g", "m"])
    pdf["want"] = pdf.groupby("g").m.rank()
    got = average_ranks(spark.createDataFrame(pdf), ["g"], ["m"]).toPandas()
    assert len(got) == 300 and (got.want - got.rank_m).abs().max() == 0
