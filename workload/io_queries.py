"""Sources and sinks: each query writes data derived from the tables and reads it back."""

from pyspark.sql import functions as F

from zonehour.functions.weektime import minutes_between, week_hour
from zonehour.operators import graph as G
from zonehour.operators import reshape as H
from zonehour.sources import readers as I
from zonehour.sources import writers as W
from zonehour.sources.shared import fresh_path

from . import standins as X
from .graph_queries import RANKS, ranks
from .registry import query, r, rounded, rs


@query("read_rides", f"""WITH {X.RIDES} SELECT ride_id, driver_id, requested_car_category, {rs('surge_factor', 'start_x', 'end_y', 'distance_meters')},
   {r("date_diff('microsecond', created_date, completed_on) / 6e7", 'total_minutes')} FROM rides""")
def read_rides(spark, sf):
    path = fresh_path(spark, "rides")
    W.write_table(in_schema_order(X.rides(spark, sf)), path)
    back = I.read_rides(spark, path)
    return rounded(back.select(
        "ride_id", "driver_id", "requested_car_category", "surge_factor", "start_x", "end_y",
        "distance_meters", minutes_between("created_date", "completed_on").alias("total_minutes")))


def in_schema_order(df):
    """Columns in the order of the ride schema."""
    return df.select(
        "ride_id", "driver_id", "started_on", "created_date", "completed_on",
        "requested_car_category", "surge_factor", "start_x", "start_y", "end_x", "end_y",
        "base_fare", "distance_meters")


@query("read_zones", f"""WITH {X.GRID} SELECT zone AS zone_id, 0 AS ring_id, {r('x', 'x')}, {r('y', 'y')} FROM
   (SELECT zone, unnest([c, c + 1, c + 1, c, c])::double AS x, unnest([r, r, r + 1, r + 1, r])::double AS y FROM zg)""")
def read_zones(spark, sf):
    path = fresh_path(spark, "zones")
    X.zones(spark, sf).write.json(path)
    back = I.read_zones(spark, path)
    return rounded(back.select("zone_id", "ring_id", F.explode("ring").alias("p")).select(
        "zone_id", "ring_id", "p.x", "p.y"))


@query("read_productivity", """SELECT event_id AS ride_id, user_id AS driver_id, cast(event_id % 97 AS integer) AS end_zone,
   cast(24 * dayofweek(ts) + hour(ts) + 1 AS integer) AS timebin, round(value / 7, 6) AS productivity FROM events""")
def read_productivity(spark, sf):
    path = fresh_path(spark, "productivity")
    e = X.table(spark, sf, "events").select(
        F.col("event_id").alias("ride_id"), F.col("user_id").alias("driver_id"),
        F.col("ts").alias("completed_on"), (F.col("event_id") % 97).cast("int").alias("end_zone"),
        week_hour("ts").cast("int").alias("timebin"), (F.col("value") / 7).alias("productivity"))
    W.write_table(e, path, fmt="parquet")
    return rounded(I.read_productivity(spark, path).drop("completed_on"))


@query("read_headerless", f"WITH {X.ADJ} SELECT zone1, zone2 FROM adj")
def read_headerless(spark, sf):
    path = fresh_path(spark, "adjacency")
    W.write_table(X.adjacency(spark, sf), path, header=False)
    return I.read_headerless(spark, path, "zone1 int, zone2 int")


@query("read_skip_header", f"WITH {RANKS} SELECT src AS vertex1, dst AS vertex2, temporal::integer AS temporal FROM st")
def read_skip_header(spark, sf):
    path = fresh_path(spark, "edges")
    edges = G.spacetime_edges(X.adjacency(spark, sf), ranks(spark, sf)).select(
        F.col("src").alias("vertex1"), F.col("dst").alias("vertex2"),
        F.col("temporal").cast("int").alias("temporal"))
    W.write_table(edges, path)
    return I.read_headerless(spark, path, "vertex1 bigint, vertex2 bigint, temporal int", True)


@query("read_tagged", f"""WITH {X.SCORES} SELECT experiment, task, method, {r('score', 'score')}, NULL::bigint AS runid, '80%' AS prob FROM scores WHERE outliers
   UNION ALL SELECT experiment, task, method, {r('score', 'score')}, runid, '10%' FROM scores WHERE NOT outliers""")
def read_tagged(spark, sf):
    """Two CSV families, one without the run id column."""
    sc = X.scores(spark, sf)
    a, b = fresh_path(spark, "p80"), fresh_path(spark, "p10")
    W.write_table(sc.where("outliers").select("experiment", "task", "method", "score"), a)
    W.write_table(sc.where("NOT outliers").select("experiment", "task", "method", "score", "runid"), b)
    df = I.read_tagged(spark, {"80%": a, "10%": b})
    return rounded(df.select(
        F.col("experiment").cast("bigint").alias("experiment"), "task",
        F.col("method").cast("int").alias("method"), "score",
        F.col("runid").cast("bigint").alias("runid"), "prob"))


@query("load_samples", f"WITH {X.CHAIN} SELECT site AS split_id, sim * 64 + x_num AS vertex, {r('ln(prob)', 'beta')} FROM chain WHERE site IN (3, 4)")
def load_samples(spark, sf):
    """Log-odds written one folder per split; only the wanted folders are read."""
    path = fresh_path(spark, "samples")
    ch = X.chain(spark, sf).select(
        F.col("site").alias("split_id"), (F.col("sim") * 64 + F.col("x_num")).alias("vertex"),
        F.ln("prob").alias("beta"))
    W.write_partitioned(ch, path)
    back = I.read_samples(spark, path, with_sims=False).where(F.col("split_id").isin(3, 4))
    return rounded(back.select("split_id", "vertex", "beta"))


@query("write_table", f"WITH {X.CELLS} SELECT zone, hour, count(*)::bigint AS n, {r('sum(productivity)', 'total', 3)} FROM cells GROUP BY ALL")
def write_table(spark, sf):
    path = fresh_path(spark, "cells")
    W.write_table(X.cells(spark, sf), path)
    back = spark.read.schema("ride_id bigint, zone int, sim int, hour int, productivity double").csv(
        path, header=True)
    return rounded(back.groupBy("zone", "hour").agg(
        F.count("*").alias("n"), F.sum("productivity").alias("total")), 3)


@query("write_partitioned", f"WITH {X.CELLS} SELECT cast(hour AS integer) AS split_id, count(*)::bigint AS n, 1::bigint AS folders FROM cells GROUP BY hour")
def write_partitioned(spark, sf):
    """Exactly one folder per split, written by several tasks each."""
    path = fresh_path(spark, "by-split")
    cells = X.cells(spark, sf).select(F.col("hour").alias("split_id"), F.col("zone").alias("vertex"))
    W.write_partitioned(cells, path, pieces=4)
    back = spark.read.parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"split_id=(\d+)", 1)
    return back.withColumn("_f", folder).groupBy(F.col("split_id").cast("int").alias("split_id")).agg(
        F.count("*").alias("n"), F.countDistinct("_f").alias("folders"))


@query("write_chunks", f"WITH {RANKS} SELECT count(*)::bigint AS n, min(vertex) AS lo, max(vertex) AS hi, true AS ordered FROM verts")
def write_chunks(spark, sf):
    """Twenty files that hold consecutive vertex ranges: none overlaps the next."""
    path = fresh_path(spark, "chunks")
    verts = G.expand_hours(ranks(spark, sf)).select("vertex", "zone", "hour")
    W.write_chunks(verts, path)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(
        F.count("*").alias("n"), F.min("vertex").alias("lo"), F.max("vertex").alias("hi"))
    # One row per file.
    spans = files.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "n"))).alias("s"))
    gaps = F.transform(F.arrays_zip(
        F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s")).alias("b")),
        lambda p: p["a"]["hi"] < p["b"]["lo"])
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return spans.select(
        total.alias("n"), F.element_at("s", 1)["lo"].alias("lo"),
        F.element_at("s", -1)["hi"].alias("hi"),
        F.forall(gaps, lambda g: g).alias("ordered"))


@query("write_arrays", f"WITH {X.CHAIN} SELECT site, sim, x_num, {rs('prob')} FROM chain")
def write_arrays(spark, sf):
    path = fresh_path(spark, "arrays")
    W.write_arrays(X.chain(spark, sf), path, ["site", "sim"], "x_num", "prob", "probs")
    return rounded(H.melt(spark.read.parquet(path), "probs", "x_num", "prob"))


@query("split_from_filename", """SELECT o_orderkey, cast(o_orderkey % 32 AS integer) AS first_bin, cast(o_orderkey % 32 + 1 AS integer) AS last_bin,
   'betas_' || lpad(cast(o_orderkey % 36 AS varchar), 2, '0') || '.csv' AS file_name FROM orders""")
def split_from_filename(spark, sf):
    k = F.col("o_orderkey")
    o = X.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("best_betas/betas_x_"), (k % 32).cast("string"), F.lit("-"),
                               (k % 32 + 1).cast("string"), F.lit(".csv")).alias("path"))
    first, last = I.split_from_path(F.col("path"))
    return o.select("o_orderkey", first.alias("first_bin"), last.alias("last_bin"),
                    I.split_file_name((k % 36).cast("int")).alias("file_name"))
