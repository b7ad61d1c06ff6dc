"""Inputs of the operators, derived from the given tables.

Each stand-in exists twice: as a DataFrame and as text of SQL common table
expressions for the oracle. All of them grow with the tables they read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.functions.likelihood import poisson_steps

HOURS = 168


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid_width(supplier: DataFrame):
    return supplier.agg(F.ceil(F.sqrt(F.count("*").cast("double"))).cast("bigint")).scalar()


def zone_grid(spark, sf_dir) -> DataFrame:
    """One unit square per supplier, laid out in rows of a near-square grid."""
    s = table(spark, sf_dir, "supplier")
    w = _grid_width(s)
    return s.select(
        F.col("s_suppkey").cast("int").alias("zone"), "s_acctbal",
        (F.col("s_suppkey") % w).alias("c"), F.floor(F.col("s_suppkey") / w).alias("r"))


def zones(spark, sf_dir) -> DataFrame:
    """Zone polygons: zone_id, ring_id, ring."""
    c, r = F.col("c").cast("double"), F.col("r").cast("double")
    corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    ring = F.array(*[F.struct((c + i).alias("x"), (r + j).alias("y")) for i, j in corners])
    return zone_grid(spark, sf_dir).select(
        F.col("zone").alias("zone_id"), F.lit(0).alias("ring_id"), ring.alias("ring"))


def adjacency(spark, sf_dir) -> DataFrame:
    """Zones that share a side."""
    g = zone_grid(spark, sf_dir).select("zone", "c", "r")
    moves = F.array(F.struct(F.lit(1).alias("dc"), F.lit(0).alias("dr")),
                    F.struct(F.lit(0).alias("dc"), F.lit(1).alias("dr")))
    a = g.select(F.col("zone").alias("zone1"), "c", "r", F.explode(moves).alias("m")).select(
        "zone1", (F.col("c") + F.col("m.dc")).alias("c"), (F.col("r") + F.col("m.dr")).alias("r"))
    return a.join(g.withColumnRenamed("zone", "zone2"), ["c", "r"]).select("zone1", "zone2")


def rides(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = _grid_width(table(spark, sf_dir, "supplier"))
    ident = F.col("event_id")
    minutes = lambda k: F.make_dt_interval(mins=k)

    def spot(factor):
        return (((ident * factor) % 1040) * w) / F.lit(1000.0)

    surge = (
        F.when(ident % 7 == 0, F.lit(None).cast("double")).when(ident % 7 == 1, 0.0)
        .when(ident % 7 == 2, 1.0).otherwise(1 + (ident % 5) * 0.25)
    )
    e = e.withColumn("started_on", F.col("ts") + minutes((1 + ident % 9).cast("int")))
    e = e.withColumn("completed_on", F.col("started_on") + minutes((2 + ident % 40).cast("int")))
    return e.select(
        ident.alias("ride_id"), F.col("user_id").alias("driver_id"), "started_on",
        F.col("ts").alias("created_date"), "completed_on",
        F.col("event_type").alias("requested_car_category"), surge.alias("surge_factor"),
        spot(7919).alias("start_x"), spot(104729).alias("start_y"),
        spot(611953).alias("end_x"), spot(15485863).alias("end_y"),
        F.lit(1.5).alias("base_fare"), (F.col("value") * 100).alias("distance_meters"))


def cells(spark, sf_dir) -> DataFrame:
    """Many (zone, hour, productivity) observations."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ride_id"),
        F.col("l_suppkey").cast("int").alias("zone"), F.col("l_linenumber").alias("sim"),
        ((F.dayofweek("l_shipdate") - 1) * 24 + (F.col("l_orderkey") % 24) + 1).cast("int")
        .alias("hour"),
        (F.col("l_extendedprice") / 850).alias("productivity"))


def places(spark, sf_dir) -> DataFrame:
    """Every zone at every hour of the week."""
    return zone_grid(spark, sf_dir).select(
        "zone", F.explode(F.sequence(F.lit(1), F.lit(HOURS))).alias("hour"))


def chain(spark, sf_dir) -> DataFrame:
    """(site, sim, x_num, prob): one distribution over 64 points per embedding."""
    e = table(spark, sf_dir, "embeddings")
    ex = F.transform("embedding", lambda v: F.exp(v.cast("double")))
    e = e.select(F.col("label").alias("site"), F.col("vec_id").alias("sim"), ex.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    e = e.select("site", "sim", F.transform("p", lambda x: x / total).alias("p"))
    return e.select("site", "sim", F.posexplode("p").alias("_p", "prob")).select(
        "site", "sim", (F.col("_p") + 1).alias("x_num"), "prob")


def scores(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("runid"), F.col("o_custkey").alias("experiment"),
        F.col("o_orderpriority").alias("task"), (F.col("o_orderkey") % 3).cast("int").alias("method"),
        (F.col("o_orderstatus") == "F").alias("outliers"),
        (F.col("o_totalprice") / 77777).alias("score"))


def search_runs(spark, sf_dir) -> DataFrame:
    """Search log: one run per order, 36 splits."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def lam(factor, lo, width):
        return F.pow(F.lit(10.0), lo + ((k * factor) % 1000) * (width / 1000))

    return o.select(
        (F.col("o_custkey") % 36).cast("int").alias("split_id"), k.alias("runid"),
        (1 + F.floor(k / 36) % 48).cast("int").alias("gen"),
        lam(7919, -2.0, 3.0).alias("lam_s1"), lam(104729, -3.0, 5.0).alias("lam_s2"),
        lam(611953, -2.0, 3.0).alias("lam_t1"), lam(15485863, -3.0, 5.0).alias("lam_t2"),
        (-F.col("o_totalprice") / 777777).alias("cv_logll"))


# --- the same as SQL -------------------------------------------------------------

GRID = """
zg AS (SELECT cast(s_suppkey AS integer) AS zone, s_acctbal, s_suppkey % w AS c,
              s_suppkey // w AS r, w, k
       FROM supplier, (SELECT cast(ceil(sqrt(count(*))) AS bigint) AS w, count(*) AS k FROM supplier) z)
"""
ADJ = GRID + """,
adj AS (SELECT a.zone AS zone1, b.zone AS zone2 FROM zg a JOIN zg b
        ON (b.c = a.c + 1 AND b.r = a.r) OR (b.c = a.c AND b.r = a.r + 1))
"""
RIDES = """
gw AS (SELECT cast(ceil(sqrt(count(*))) AS bigint) AS w, count(*) AS k FROM supplier),
rides AS (
  SELECT *, started_on + to_minutes(cast(2 + ride_id % 40 AS integer)) AS completed_on
  FROM (SELECT event_id AS ride_id, user_id AS driver_id, ts AS created_date,
    ts + to_minutes(cast(1 + event_id % 9 AS integer)) AS started_on,
    event_type AS requested_car_category,
    CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 1.0
         ELSE 1 + (event_id % 5) * 0.25 END::double AS surge_factor,
    (((event_id * 7919) % 1040) * w) / 1000.0::double AS start_x,
    (((event_id * 104729) % 1040) * w) / 1000.0::double AS start_y,
    (((event_id * 611953) % 1040) * w) / 1000.0::double AS end_x,
    (((event_id * 15485863) % 1040) * w) / 1000.0::double AS end_y,
    1.5::double AS base_fare, value * 100 AS distance_meters
  FROM events, gw))
"""
TAGGED = RIDES + """,
zoned AS (SELECT rides.*,
    CASE WHEN floor(start_x) < w AND floor(start_y) * w + floor(start_x) < k
         THEN cast(floor(start_y) * w + floor(start_x) AS integer) END AS start_zone,
    CASE WHEN floor(end_x) < w AND floor(end_y) * w + floor(end_x) < k
         THEN cast(floor(end_y) * w + floor(end_x) AS integer) END AS end_zone
  FROM rides, gw),
tagged AS (SELECT * FROM zoned WHERE start_zone IS NOT NULL AND end_zone IS NOT NULL)
"""
PRICED = TAGGED + """,
trips AS (SELECT * FROM (SELECT *, date_diff('microsecond', started_on, completed_on) / 6e7 AS duration
                         FROM tagged)
          WHERE distance_meters BETWEEN 10 AND 100000 AND duration BETWEEN 1 AND 120),
surged AS (SELECT * REPLACE (CASE WHEN surge_factor IS NULL OR surge_factor IN (0, 1) THEN 1.0
                             ELSE surge_factor END::double AS surge_factor) FROM trips),
fares0 AS (SELECT *, distance_meters / 1000 AS distance_km,
    distance_meters / 1000 * 0.62137119::double AS distance_miles,
    distance_meters / 1000 * 0.62137119::double * 0.99::double AS mile_fare_estim,
    duration * 0.25::double AS time_fare_estim FROM surged),
fares1 AS (SELECT *, base_fare + time_fare_estim + mile_fare_estim AS fare_pre_estimate FROM fares0),
priced AS (SELECT *, greatest(fare_pre_estimate, 4.0::double) AS fare_estimate,
    fare_pre_estimate * surge_factor AS fare_pre_estimate_with_surge,
    greatest(fare_pre_estimate * surge_factor, 4.0::double) AS fare_estimate_with_surge FROM fares1)
"""
SEQUENCED = PRICED + """,
led AS (SELECT *, lead(created_date) OVER w AS n_created, lead(started_on) OVER w AS n_started,
    lead(completed_on) OVER w AS n_completed, lead(fare_estimate) OVER w AS fare_next,
    lead(fare_estimate_with_surge) OVER w AS fare_next_with_surge
  FROM priced WINDOW w AS (PARTITION BY driver_id ORDER BY started_on, ride_id)),
gaps AS (SELECT *, date_diff('microsecond', completed_on, n_created) / 6e7 AS idle_after,
    date_diff('microsecond', completed_on, n_started) / 6e7 AS unproductive_after,
    date_diff('microsecond', n_created, n_started) / 6e7 AS reach_after,
    date_diff('microsecond', n_started, n_completed) / 6e7 AS duration_next FROM led),
seq AS (SELECT *, fare_next / nullif(unproductive_after + duration_next, 0) * 60 AS productivity,
    fare_next_with_surge / nullif(unproductive_after + duration_next, 0) * 60
      AS productivity_with_surge FROM gaps)
"""
PRODUCTIVE = SEQUENCED + """,
prod AS (SELECT *, cast(24 * dayofweek(completed_on) + hour(completed_on) + 1 AS integer) AS timebin
  FROM seq WHERE (unproductive_after IS NULL OR unproductive_after >= 0)
    AND idle_after > 0.1 AND idle_after < 60 AND duration_next > 1 AND duration_next < 120
    AND fare_next < 200 AND productivity < 125)
"""
CELLS = """
cells AS (SELECT l_orderkey * 8 + l_linenumber AS ride_id, cast(l_suppkey AS integer) AS zone,
    l_linenumber AS sim, cast(24 * dayofweek(l_shipdate) + l_orderkey % 24 + 1 AS integer) AS hour,
    l_extendedprice / 850 AS productivity FROM lineitem)
"""
CHAIN = """
ch0 AS (SELECT label AS site, vec_id AS sim, unnest(embedding)::double AS e,
               generate_subscripts(embedding, 1) AS x_num FROM embeddings),
chain AS (SELECT site, sim, cast(x_num AS integer) AS x_num,
                 exp(e) / sum(exp(e)) OVER (PARTITION BY site, sim) AS prob FROM ch0)
"""
SCORES = """
scores AS (SELECT o_orderkey AS runid, o_custkey AS experiment, o_orderpriority AS task,
    cast(o_orderkey % 3 AS integer) AS method, o_orderstatus = 'F' AS outliers,
    o_totalprice / 77777 AS score FROM orders)
"""
SEARCH = """
runs AS (SELECT cast(o_custkey % 36 AS integer) AS split_id, o_orderkey AS runid,
    cast(1 + (o_orderkey // 36) % 48 AS integer) AS gen,
    pow(10.0::double, -2.0 + ((o_orderkey * 7919) % 1000) * (3.0::double / 1000)) AS lam_s1,
    pow(10.0::double, -3.0 + ((o_orderkey * 104729) % 1000) * (5.0::double / 1000)) AS lam_s2,
    pow(10.0::double, -2.0 + ((o_orderkey * 611953) % 1000) * (3.0::double / 1000)) AS lam_t1,
    pow(10.0::double, -3.0 + ((o_orderkey * 15485863) % 1000) * (5.0::double / 1000)) AS lam_t2,
    -o_totalprice / 777777 AS cv_logll FROM orders)
"""

# Quantile tree of depth 5 with one split on the left tail and four on the right.
TREE = CELLS + f""",
q AS (SELECT list_concat([min(productivity)], list_concat(
        quantile_cont(productivity, [{', '.join(repr(k / 32) for k in range(1, 32))}]),
        [max(productivity)])) AS t FROM cells),
dy AS (SELECT l AS lvl, t[2 * j * d + 1] AS lo, t[2 * j * d + d + 1] AS mid, t[2 * j * d + 2 * d + 1] AS up
       FROM (SELECT t, l, cast(pow(2, 4 - l) AS bigint) AS d,
                    unnest(generate_series(0, cast(pow(2, l) AS bigint) - 1)) AS j
             FROM (SELECT t, unnest(generate_series(0, 4)) AS l FROM q))),
lt AS (SELECT 5 AS lvl, t[1] AS lo, t[1] + (t[2] - t[1]) * 0.5 AS mid, t[2] AS up FROM q),
rt AS (SELECT 4 + k AS lvl,
         CASE WHEN k = 1 THEN t[32] ELSE t[32] + (t[32] + (t[33] - t[32]) * 0.75 - t[32]) * ((k - 1) / 5.0::double) END AS lo,
         t[32] + (t[32] + (t[33] - t[32]) * 0.75 - t[32]) * (k / 5.0::double) AS mid, t[33] AS up
       FROM (SELECT t, unnest(generate_series(1, 4)) AS k FROM q)),
tree AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY lvl, lo) - 1 AS integer) AS split_id, cast(lvl AS integer) AS lvl,
         lo, mid, up
         FROM (SELECT * FROM dy UNION ALL SELECT * FROM lt UNION ALL SELECT * FROM rt)),
pts AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY x) AS integer) AS x_num, x FROM (
         SELECT min(lo) AS x FROM tree UNION ALL SELECT mid FROM tree UNION ALL SELECT max(up) FROM tree)),
leafs AS MATERIALIZED (SELECT x_num - 1 AS leaf, x AS leaf_lo, lead(x) OVER (ORDER BY x_num) AS leaf_up FROM pts),
lv AS MATERIALIZED (SELECT * FROM leafs WHERE leaf_up IS NOT NULL),
paths AS MATERIALIZED (SELECT leaf, leaf_lo, leaf_up, split_id, CASE WHEN leaf_up <= mid + 1e-9 THEN 1 ELSE -1 END AS side
          FROM lv JOIN tree ON lo <= leaf_lo + 1e-9 AND leaf_up <= up + 1e-9)
"""


def counts_sql(source: str, keys: str, out: str = "counts") -> str:
    """CTE text: left-closed split counts of ``source`` by ``keys`` over ``tree``."""
    return f"""
{out} AS MATERIALIZED (SELECT {keys}, split_id, sum(CASE WHEN productivity < mid THEN 1 ELSE 0 END)::bigint AS successes,
            count(*)::bigint AS attempts
     FROM {source} JOIN tree ON productivity >= lo
      AND (productivity < up OR (productivity = up AND up = (SELECT max(up) FROM tree)))
     GROUP BY {keys}, split_id)
"""


def betas_sql(counts: str, out: str = "betas", eps: str = "1e-3") -> str:
    return f"""
{out} AS (SELECT * EXCLUDE (successes, attempts),
     ln((successes + {eps}::double) / (attempts + 2 * {eps}::double - successes - {eps}::double)) AS beta FROM {counts})
"""


def leaves_sql(betas: str, keys: str, out: str = "leaves") -> str:
    return f"""
{out} AS MATERIALIZED (SELECT {keys}, leaf, leaf_lo, leaf_up, exp(sum(
        least(beta * side, 0.0) - ln(1 + exp(-abs(beta * side))))) AS prob
     FROM {betas} JOIN paths USING (split_id) GROUP BY {keys}, leaf, leaf_lo, leaf_up)
"""


PLACES = """
places AS (SELECT cast(s_suppkey AS integer) AS zone, cast(unnest(generate_series(1, 168)) AS integer) AS hour FROM supplier)
"""


def dense_sql(places: str, keys: str, counts: str = "counts", out: str = "dense") -> str:
    """CTE text: counts at every key of ``places`` and every split, zeros included."""
    return f"""
{out} AS MATERIALIZED (SELECT {keys}, split_id, coalesce(successes, 0)::bigint AS successes,
      coalesce(attempts, 0)::bigint AS attempts
  FROM (SELECT {keys}, split_id FROM {places} CROSS JOIN tree) LEFT JOIN {counts} USING ({keys}, split_id))
"""


def hash_sql(ident: str, salt: int) -> str:
    h = (f"((({ident}) % 2147483648) * 2654435761 + ((({ident}) // 2147483648) % 1048576) * 40503 "
         f"+ {salt} * 1013904223::bigint) % 4294967296")
    h = f"(({h}) // 65536 * 69069 + ({h}) % 65536 * 1234567)"
    return f"((({h}) * 1664525 + 1013904223) % 4294967296) / 4294967296.0::double"


def poisson_sql(ident: str, salt) -> str:
    """Weight of a ride in the bootstrap sample with this salt (a number, or SQL text)."""
    u = hash_sql(ident, salt)
    return " + ".join(f"CASE WHEN {u} >= {c!r}::double THEN 1 ELSE 0 END" for c in poisson_steps())


def fold_sql(vertex: str, folds: int, seed: int = 0) -> str:
    return f"cast((((({vertex}) % 2147483648) * 2654435761 + {seed}) % 4294967296) // 65536 % {folds} AS integer)"


def fit_sql(counts: str, edges: str, rounds: int, p: str = "f", eps: str = "1e-3",
            newton: int = 3, reach: float = 4.0) -> str:
    """CTE text of ``rounds`` alternating steps; the betas end up in ``{p}v{rounds}``.

    ``counts``: model_id, vertex, successes, attempts; ``edges``: model_id, src, dst, l1, l2.
    """
    out = [f"""{p}c AS MATERIALIZED (SELECT model_id, vertex, successes + {eps}::double AS s,
       attempts + 2 * {eps}::double AS n FROM {counts})""",
           f"{p}p AS (SELECT model_id, ln(sum(s) / (sum(n) - sum(s))) AS beta FROM {p}c GROUP BY model_id)",
           f"{p}v0 AS MATERIALIZED (SELECT model_id, vertex, s, n, beta FROM {p}c JOIN {p}p USING (model_id))",
           f"""{p}e0 AS MATERIALIZED (SELECT model_id, src, dst, l1, l2, beta AS zs, beta AS zd, 0.0::double AS us,
       0.0::double AS ud FROM {edges} JOIN {p}p USING (model_id))"""]
    for k in range(1, rounds + 1):
        e, v = f"{p}e{k - 1}", f"{p}v{k - 1}"
        out.append(f"""{p}m{k} AS MATERIALIZED (SELECT model_id, vertex, sum(pull) AS pull, count(*)::double AS deg
          FROM (SELECT model_id, src AS vertex, zs - us AS pull FROM {e} UNION ALL SELECT model_id, dst, zd - ud FROM {e})
          GROUP BY ALL)""")
        body = f"""(SELECT model_id, vertex, s, n, beta, coalesce(pull, 0) AS pull, coalesce(deg, 0) AS deg
          FROM {v} LEFT JOIN {p}m{k} USING (model_id, vertex))"""
        for _ in range(newton):
            body = f"""(SELECT model_id, vertex, s, n, pull, deg, beta - greatest(least(
              CASE WHEN n * q * (1 - q) + deg > 0 THEN (n * q - s + (deg * beta - pull)) / greatest(n * q * (1 - q) + deg, 1e-12)
              ELSE 0.0 END, {reach}), -{reach}) AS beta
              FROM (SELECT *, 1 / (1 + exp(-beta)) AS q FROM {body}))"""
        out.append(f"{p}v{k} AS MATERIALIZED (SELECT model_id, vertex, s, n, beta FROM {body})")
        if k < rounds:
            out.append(edge_step_sql(p, k))
    return ",\n".join(out)


def edge_step_sql(p: str, k: int) -> str:
    return f"""{p}a{k} AS MATERIALIZED (SELECT e.*, i.beta + us AS a FROM {p}e{k - 1} e
      JOIN {p}v{k} i ON i.model_id = e.model_id AND i.vertex = src),
    {p}e{k} AS MATERIALIZED (SELECT model_id, src, dst, l1, l2, m + h AS zs, m - h AS zd, a - (m + h) AS us, c - (m - h) AS ud
      FROM (SELECT *, (a + c) / 2 AS m, sign(a - c) * greatest(abs(a - c) - 2 * l1, 0) / (1 + 4 * l2) / 2 AS h
        FROM (SELECT e.*, j.beta + ud AS c FROM {p}a{k} e
          JOIN {p}v{k} j ON j.model_id = e.model_id AND j.vertex = dst)))"""


def settled_fit_sql(counts: str, edges: str, rounds: int, tol: float, check_every: int, p: str = "f", eps: str = "1e-3",
                    newton: int = 3, reach: float = 4.0, relax: float = 1.7, change: int = 3, written: int = 60,
                    squared: bool = False) -> str:
    """CTE text of alternating steps in which every model ends at its own round: ``{p}fit`` has model_id, vertex,
    beta, rounds. Of at most ``rounds`` rounds the first ``written`` are written out: models that need more are missing.
    ``squared``: ``counts`` has model_id, vertex, value, and the loss is squared.
    """
    data, start = f"successes + {eps}::double AS s, attempts + 2 * {eps}::double AS n", "ln(sum(s) / (sum(n) - sum(s)))"
    if squared:
        data, start = "coalesce(value, 0) AS s, (value IS NOT NULL)::integer::double AS n", "0.0::double"
    out = [f"{p}c AS MATERIALIZED (SELECT model_id, vertex, {data} FROM {counts})",
           f"{p}p AS (SELECT model_id, {start} AS beta FROM {p}c GROUP BY model_id)",
           f"{p}v0 AS MATERIALIZED (SELECT model_id, vertex, s, n, beta, 1.0::double AS rho FROM {p}c JOIN {p}p USING (model_id))",
           f"""{p}e0 AS MATERIALIZED (SELECT model_id, src, dst, l1, l2, beta AS zs, beta AS zd, 0.0::double AS us,
       0.0::double AS ud, 1.0::double AS rho FROM {edges} JOIN {p}p USING (model_id))"""]
    v, e, ended = f"{p}v0", f"{p}e0", []
    ahead = f"{relax!r}::double * {{b}} + {1 - relax!r}::double * {{z}} + {{u}}"
    for k in range(1, written + 1):
        out.append(f"""{p}m{k} AS MATERIALIZED (SELECT model_id, vertex, sum(pull) AS pull, count(*)::double AS deg
          FROM (SELECT model_id, src AS vertex, zs - us AS pull FROM {e} UNION ALL SELECT model_id, dst, zd - ud FROM {e})
          GROUP BY ALL)""")
        body = f"""(SELECT model_id, vertex, s, n, rho, beta, coalesce(pull, 0) AS pull, coalesce(deg, 0) AS deg
          FROM {v} LEFT JOIN {p}m{k} USING (model_id, vertex))"""
        if squared:
            body = f"(SELECT model_id, vertex, s, n, rho, (s + rho * pull) / (n + {eps}::double + rho * deg) AS beta FROM {body})"
        for _ in range(0 if squared else newton):
            body = f"""(SELECT model_id, vertex, s, n, rho, pull, deg, beta - greatest(least(
              (n * q - s + rho * (deg * beta - pull)) / greatest(n * q * (1 - q) + rho * deg, 1e-12), {reach}), -{reach}) AS beta
              FROM (SELECT *, 1 / (1 + exp(-beta)) AS q FROM {body}))"""
        v = f"{p}v{k}"
        out.append(f"{v} AS MATERIALIZED (SELECT model_id, vertex, s, n, rho, beta FROM {body})")
        out.append(f"""{p}a{k} AS MATERIALIZED (SELECT e.*, i.beta AS bs FROM {e} e JOIN {v} i ON i.model_id = e.model_id AND i.vertex = src)""")
        e = f"{p}e{k}"
        out.append(f"""{e} AS MATERIALIZED (SELECT model_id, src, dst, l1, l2, m + h AS zs, m - h AS zd, a - (m + h) AS us, c - (m - h) AS ud, rho,
            pow(bs - (m + h), 2) + pow(bd - (m - h), 2) AS primal, pow((m + h) - zs, 2) + pow((m - h) - zd, 2) AS dual
          FROM (SELECT *, (a + c) / 2 AS m, sign(a - c) * greatest(abs(a - c) - l1 * (2 / rho), 0) / (1 + l2 * (4 / rho)) / 2 AS h
            FROM (SELECT *, {ahead.format(b='bs', z='zs', u='us')} AS a, {ahead.format(b='bd', z='zd', u='ud')} AS c
              FROM (SELECT e.*, j.beta AS bd FROM {p}a{k} e JOIN {v} j ON j.model_id = e.model_id AND j.vertex = dst))))""")
        if k % check_every == 0:
            factor = (f"pow(2, greatest(-{change}, least({change}, floor(log2(pr / du) / 4 + 0.5))))" if 4 * k <= 3 * rounds else "1.0")
            out.append(f"""{p}r{k} AS MATERIALIZED (SELECT model_id, sqrt(greatest(pr, du) / 2) < {tol!r}::double AS settled,
                CASE WHEN pr > 0 AND du > 0 THEN {factor} ELSE 1.0 END::double AS factor
              FROM (SELECT model_id, avg(primal) AS pr, avg(dual * rho * rho) AS du FROM {e} GROUP BY model_id))""")
            ended.append(f"SELECT model_id, vertex, beta, {k} AS rounds FROM {v} JOIN {p}r{k} USING (model_id) WHERE settled")
            out.append(f"{v}r AS MATERIALIZED (SELECT model_id, vertex, s, n, beta, rho * factor AS rho FROM {v} JOIN {p}r{k} USING (model_id) WHERE NOT settled)")
            out.append(f"""{e}r AS MATERIALIZED (SELECT model_id, src, dst, l1, l2, zs, zd, us / factor AS us, ud / factor AS ud, rho * factor AS rho
              FROM {e} JOIN {p}r{k} USING (model_id) WHERE NOT settled)""")
            v, e = f"{v}r", f"{e}r"
    out.append(f"{p}fit AS MATERIALIZED ({' UNION ALL '.join(ended)})")
    return ",\n".join(out)
