"""Both sides of every switch on size give the same rows: NULL keys, NaN, infinities, repeated ids, missing splits."""

import math

import pytest
from pyspark.sql import functions as F

from zonehour.functions.planar import segments_intersect
from zonehour.operators import counts as C
from zonehour.operators import density as D
from zonehour.operators import ranking as R
from zonehour.operators import rides as I
from zonehour.operators import spatial as S
from zonehour.operators.quantiles import exact_quantiles
from zonehour.operators.reshape import natural_full_join
from zonehour.operators.splits import uniform_splits
from zonehour.sources.readers import read_trails

NAN, INF = math.nan, math.inf


def rows(df, *columns):
    def plain_value(v):
        return v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 9) + 0.0

    plain = [tuple(map(plain_value, r)) for r in df.select(*columns or "*").collect()]
    return sorted(plain, key=str)


@pytest.fixture(scope="module")
def odd(spark):
    values = [("a", 1.0), ("a", 2.0), ("a", None), ("a", 7.5), (None, 3.0), (None, -4.0), (None, -INF), ("b", NAN),
              ("b", 1.0), ("b", 10.0), ("c", INF), ("c", 2.0), ("c", 2.0), ("d", None), ("e", 0.0), ("e", -0.0)]
    return spark.createDataFrame(values, "k string, v double")


@pytest.mark.parametrize("probs", [[0.0], [0.25, 0.5], [0.1, 1.0]])
def test_quantiles(odd, probs):
    for keys in (["k"], []):
        df = odd if keys else odd.where("k in ('a', 'c', 'e') or v < 5")
        gathered = exact_quantiles(df, "v", probs, keys=keys, gather_limit=10**6)
        counted = exact_quantiles(df, "v", probs, keys=keys, gather_limit=0)
        assert rows(gathered) == rows(counted)
    assert rows(exact_quantiles(odd, "v", probs, keys=[], gather_limit=10**6)) == rows(
        exact_quantiles(odd, "v", probs, keys=[], gather_limit=0))


@pytest.mark.parametrize("ids", [[0, 1, 2, None], [5, 9, 2**40, 2**62, 7, None], [1]])
def test_row_numbers(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "i bigint")
    want = {i: n for n, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i))}
    for block in (100, 2):
        assert {r.i: r.n for r in R.number_rows(df, "i", "n", block=block).collect()} == want


def test_ranks_and_scaling_keep_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 2.0), (None, 4.0), (None, 4.0)], "g string, m double")
    assert rows(R.average_ranks(df, ["g"], ["m"]), "g", "m", "rank_m") == sorted(
        [("a", 1.0, 1.0), ("a", None, None), ("a", 3.0, 2.0), (None, 2.0, 1.0), (None, 4.0, 2.5), (None, 4.0, 2.5)], key=str)
    assert R.scale_by_group_max(df, ["g"], "m", "s").where("g is null and s = 1").count() == 2
    assert R.clip_at_quantile(df, "m", "c", 0.5, keys=["g"]).where("g is null").count() == 3


def zones_of(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    return spark.createDataFrame([(i, ring(float(i))) for i in range(3)], "zone_id int, ring array<struct<x: double, y: double>>")


@pytest.mark.parametrize("unit", [1.0, 1 / 64])
def test_zone_tags(spark, unit):
    points = [(7, .5, .5), (7, 2.5, .5), (None, 1.5, .5), (8, 9.0, 9.0), (8, None, .5), (7, .5, .5)]
    scaled = [(i, x and x * unit, y * unit, "cx") for i, x, y in points]
    df = spark.createDataFrame(scaled, "ride_id int, x double, y double, cx string")
    zones = zones_of(spark).withColumn("ring", F.transform("ring", lambda p: F.struct(
        (p["x"] * unit).alias("x"), (p["y"] * unit).alias("y"))))
    tagged = [rows(S.tag_zone(df, zones, {"z": ("x", "y")}, broadcast_segments=n)) for n in (10**6, 0)]
    assert tagged[0] == tagged[1] and [r[-1] for r in tagged[0]].count(None) == 2
    assert S.ring_size(S.ring_table(zones)) == unit


def test_split_counts(spark, monkeypatch):
    splits = uniform_splits(spark.createDataFrame([(0.0, 8.0)], "lo double, hi double"), 2)
    values = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 3.0), (9, 3.0), (None, 7.0)], "vertex int, productivity double")
    vertices = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "vertex int")
    wide = [rows(C.split_counts(values, splits, vertices=v), "vertex", "split_id", "successes", "attempts") for v in (vertices, None)]
    monkeypatch.setattr(C, "WIDE_SPLITS", 1)
    joined = [rows(C.split_counts(values, splits, vertices=v), "vertex", "split_id", "successes", "attempts") for v in (vertices, None)]
    assert wide == joined and {r[0] for r in wide[0]} == {1, 2, 3, None}


def test_leaves_of_incomplete_trees(spark, monkeypatch):
    splits = uniform_splits(spark.createDataFrame([(0.0, 8.0)], "lo double, hi double"), 2)
    ids = [r.split_id for r in splits.orderBy("split_id").collect()]
    betas = [(1, i, 0.5) for i in ids] + [(2, i, 0.1) for i in ids[:2]] + [(None, ids[0], 0.3), (1, ids[0], 0.2)]
    df = spark.createDataFrame(betas, "vertex int, split_id int, beta double")
    shown = lambda: [(v, leaf, p if p is None else round(p, 9)) for v, leaf, p in rows(
        D.leaf_probabilities(df, splits), "vertex", "leaf", "prob")]
    wide = shown()
    monkeypatch.setattr(D, "WIDE_SPLITS", 1)
    assert wide == shown()
    assert abs(sum(p for v, _, p in wide if v == 1) - 1) < 1e-6 and any(p is None for v, _, p in wide if v == 2)


def test_busy_drivers_and_rides_without_start(spark):
    day = lambda d, h: f"2020-01-0{d} 0{h}:00:00"
    data = [(1, "x", None), (2, "x", day(1, 1)), (3, "x", day(1, 5)), (4, "x", day(3, 2)), (5, "y", day(1, 1)), (6, None, day(1, 1)),
            (7, None, day(1, 2)), (8, "y", None)]
    df = spark.createDataFrame(data, "ride_id int, driver_id string, s string").select(
        "ride_id", "driver_id", F.col("s").cast("timestamp_ntz").alias("started_on"),
        F.col("s").cast("timestamp_ntz").alias("created_date"),
        (F.col("s").cast("timestamp_ntz") + F.expr("interval 10 minutes")).alias("completed_on"),
        F.col("ride_id").cast("double").alias("fare_estimate"), F.lit(1.0).alias("fare_estimate_with_surge"))
    got = [rows(I.driver_sequence(df, hot_rows=n), "ride_id", "fare_next") for n in (10**6, 1)]
    assert got[0] == got[1] == sorted([(1, 2.0), (2, 3.0), (3, 4.0), (4, None), (5, None), (8, 5.0)], key=str)


def test_zero_mass_is_an_infinite_loss(spark):
    splits = uniform_splits(spark.createDataFrame([(0.0, 8.0)], "lo double, hi double"), 2)
    leaves = spark.createDataFrame([(1, i, 2.0 * i, 2.0 * i + 2, p) for i, p in enumerate((0.0, 0.5, 0.5, 0.0))],
                                   "vertex int, leaf int, leaf_lo double, leaf_up double, prob double")
    values = spark.createDataFrame([(1, 1.0), (1, 3.0)], "vertex int, v double")
    assert D.heldout_nll(values, leaves, splits, "v").first()["nll"] == INF
    logs = D.log_density_at(values, leaves, splits, "v")
    assert sorted(r.log_density for r in logs.collect()) == [-INF, pytest.approx(math.log(0.25))]
    assert D.validation_nll(logs).first()[0] == INF
    means = spark.createDataFrame([(1, 0.0), (1, 0.5), (2, 0.5), (2, 0.5)], "x_num int, prob double")
    assert rows(D.geometric_mean_density(means)) == [(1, 0.0), (2, 1.0)]


@pytest.mark.parametrize("unit", [1e-7, 1.0, 1e6])
def test_segments_meet_in_any_unit(spark, unit):
    def meet(*c):
        p = [F.lit(float(v) * unit) for v in c]
        return segments_intersect((p[0], p[1]), (p[2], p[3]), (p[4], p[5]), (p[6], p[7]))

    got = spark.range(1).select(meet(0, 0, 2, 2, 0, 2, 2, 0), meet(0, 0, 1, 0, 0, 1, 1, 1), meet(0, 0, 2, 0, 1, 0, 3, 0),
                                meet(0, 0, 1, 0, 2, 0, 3, 0), meet(0, 0, 1, 1, 1, 1, 2, 0)).first()
    assert list(got) == [True, False, True, False, True]


def test_natural_join_needs_a_shared_column(spark):
    with pytest.raises(ValueError):
        natural_full_join(spark.range(1).toDF("a"), spark.range(2).toDF("b"))


def test_trail_documents_of_many_lines(spark, tmp_path):
    text = '{\n "ptr": [5, 6, 7],\n "brks": [1, 3, 4],\n "wts": [1, 1, 0.5],\n "istemp": [0, 1, 0], "num_nodes": 9}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(text)
    got = read_trails(spark, str(tmp_path))
    assert rows(got, "trail_no", "pos", "vertex") == sorted([(1, 0, 5), (1, 1, 6), (2, 2, 7)] * 2, key=str)
    assert got.select("doc").distinct().count() == 2
    (tmp_path / "c.json").write_text('{"ptr": [1, 2')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_trails(spark, str(tmp_path)).collect()
