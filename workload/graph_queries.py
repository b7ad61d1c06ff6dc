"""Zone graph, space-time graph, numbering, trails and grids."""

from pyspark.sql import functions as F

from zonehour.operators import graph as G
from zonehour.operators import ranking as K
from zonehour.operators import reshape as H
from zonehour.operators import spatial as S
from zonehour.plans import productivity as P
from zonehour.plans.spacetime import rank_zones
from zonehour.sources import readers as I
from zonehour.sources.shared import fresh_path, save_round

from . import standins as X
from .registry import query, r, rounded, rs


def present(spark, sf):
    """Zones in which a ride is."""
    return X.cells(spark, sf).select("zone").distinct()


def kept_edges(spark, sf):
    return G.keep_edges_within(X.adjacency(spark, sf), present(spark, sf), "zone")


_KEPT = f"""{X.ADJ}, {X.CELLS},
kept AS (SELECT zone1, zone2 FROM adj WHERE zone1 IN (SELECT zone FROM cells) AND zone2 IN (SELECT zone FROM cells)),
und AS (SELECT zone1 AS a, zone2 AS b FROM kept UNION SELECT zone2, zone1 FROM kept),
reach(node, other) AS (SELECT a, a FROM und UNION SELECT reach.node, und.b FROM reach JOIN und ON reach.other = und.a),
cc AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
big AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
"""
RANKS = X.ADJ + """,
seen AS (SELECT zone, min(p) AS p FROM (
   SELECT zone1 AS zone, (zone1 * k + zone2) * 2 AS p FROM adj, (SELECT count(*) AS k FROM supplier)
   UNION ALL SELECT zone2, (zone1 * k + zone2) * 2 + 1 FROM adj, (SELECT count(*) AS k FROM supplier)) GROUP BY zone),
ranks AS (SELECT zone, row_number() OVER (ORDER BY p) - 1 AS zone_rank FROM seen),
hours AS (SELECT cast(unnest(generate_series(1, 168)) AS integer) AS hour),
verts AS (SELECT zone, hour, (hour - 1) * (SELECT count(*) FROM ranks) + zone_rank AS vertex FROM ranks, hours),
st AS (SELECT a.vertex AS src, b.vertex AS dst, false AS temporal FROM adj JOIN verts a ON a.zone = zone1
        JOIN verts b ON b.zone = zone2 AND b.hour = a.hour
       UNION ALL SELECT a.vertex, b.vertex, true FROM verts a JOIN verts b ON a.zone = b.zone AND b.hour = a.hour % 168 + 1)
"""


@query("zone_adjacency", f"""WITH {X.ADJ.replace('(b.c = a.c + 1 AND b.r = a.r) OR (b.c = a.c AND b.r = a.r + 1)',
   'a.zone < b.zone AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1')} SELECT zone1, zone2 FROM adj""")
def zone_adjacency(spark, sf):
    """Unit squares that share a side or a corner."""
    return S.zone_adjacency(X.zones(spark, sf), max_dist=1.5, eps=0.0, cell=1.0)


@query("zone_adjacency_stretched", f"""WITH {X.GRID},
  seg AS (SELECT zone, c + .5 AS lx, r + .5 AS ly, unnest([c, c + 1, c + 1, c])::double AS x1, unnest([r, r, r + 1, r + 1])::double AS y1,
     unnest([c + 1, c + 1, c, c])::double AS x2, unnest([r, r + 1, r + 1, r])::double AS y2 FROM zg),
  st AS (SELECT zone, lx, ly, least(x1, x2) - 0.1 * abs(x2 - x1) AS xa, greatest(x1, x2) + 0.1 * abs(x2 - x1) AS xb,
     least(y1, y2) - 0.1 * abs(y2 - y1) AS ya, greatest(y1, y2) + 0.1 * abs(y2 - y1) AS yb FROM seg)
  SELECT DISTINCT a.zone AS zone1, b.zone AS zone2 FROM st a JOIN st b ON a.zone < b.zone
    AND a.xa <= b.xb AND b.xa <= a.xb AND a.ya <= b.yb AND b.ya <= a.yb
    AND sqrt(pow(a.lx - b.lx, 2) + pow(a.ly - b.ly, 2)) < 2.5""")
def zone_adjacency_stretched(spark, sf):
    return S.zone_adjacency(X.zones(spark, sf), max_dist=2.5, eps=0.1, cell=1.0)


@query("label_distance", f"""WITH {X.GRID} SELECT a.zone AS zone1, b.zone AS zone2,
   {r('sqrt(pow(a.c - b.c, 2) + pow(a.r - b.r, 2))', 'label_dist')} FROM zg a JOIN zg b ON a.zone < b.zone
   WHERE sqrt(pow(a.c - b.c, 2) + pow(a.r - b.r, 2)) < 2.5""")
def label_distance(spark, sf):
    return rounded(S.label_distance(S.ring_table(X.zones(spark, sf)), 2.5))


@query("order_pairs", f"WITH {X.ADJ} SELECT zone1, zone2 FROM adj ORDER BY zone1, zone2")
def order_pairs(spark, sf):
    return S.order_pairs(X.adjacency(spark, sf))


@query("dedupe_edges", f"""WITH {X.TAGGED} SELECT DISTINCT least(start_zone, end_zone) AS src,
   greatest(start_zone, end_zone) AS dst FROM tagged WHERE start_zone <> end_zone""")
def dedupe_edges(spark, sf):
    rides = P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf))
    return G.dedupe_edges(rides.select(F.col("start_zone").alias("src"), F.col("end_zone").alias("dst")))


@query("semi_filter", f"WITH RECURSIVE {_KEPT} SELECT zone1, zone2 FROM kept")
def semi_filter(spark, sf):
    return kept_edges(spark, sf)


@query("connected_components", f"WITH RECURSIVE {_KEPT} SELECT node, component FROM cc")
def connected_components(spark, sf):
    return G.connected_components(kept_edges(spark, sf))


@query("components_by_contraction", f"WITH RECURSIVE {_KEPT} SELECT node, component FROM cc")
def components_by_contraction(spark, sf):
    return G.contracted_components(kept_edges(spark, sf))


@query("largest_component", f"WITH RECURSIVE {_KEPT} SELECT node, component FROM cc WHERE component IN (SELECT component FROM big)")
def largest_component(spark, sf):
    return G.largest_component(G.connected_components(kept_edges(spark, sf)))


@query("present_in_component", f"""WITH RECURSIVE {_KEPT}
  SELECT DISTINCT zone FROM cells WHERE zone IN (SELECT node FROM cc WHERE component IN (SELECT component FROM big))""")
def present_in_component(spark, sf):
    part = G.largest_component(G.connected_components(kept_edges(spark, sf)))
    return G.present_in_component(X.cells(spark, sf), part, "zone")


def ranks(spark, sf):
    return save_round(rank_zones(X.adjacency(spark, sf)), "ranks")


@query("number_vertices", f"WITH {RANKS} SELECT zone, zone_rank FROM ranks")
def number_vertices(spark, sf):
    return rank_zones(X.adjacency(spark, sf)).select("zone", "zone_rank")


@query("enumerate_rows", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders""")
def enumerate_rows(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey")
    return K.number_rows(o, "o_orderkey", "rn", block=1024, base=1)


@query("zone_hours", f"WITH {RANKS} SELECT zone, hour, vertex FROM verts")
def zone_hours(spark, sf):
    """Cross product of zones and hours, with vertex ids."""
    return G.expand_hours(ranks(spark, sf)).select("zone", "hour", "vertex")


@query("spacetime_edges", f"WITH {RANKS} SELECT src, dst, temporal FROM st")
def spacetime_edges(spark, sf):
    return G.spacetime_edges(X.adjacency(spark, sf), ranks(spark, sf))


@query("node_counts", f"WITH {X.CELLS} SELECT zone, hour, count(*)::bigint AS node_counts FROM cells GROUP BY ALL")
def node_counts(spark, sf):
    return G.node_counts(X.cells(spark, sf))


_LABEL = """['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][(hour - 1) // 24 + 1] || ' ' ||
   lpad(cast((hour - 1) % 24 AS varchar), 2, '0') || ':00'"""
VERTEX_TABLE = f"""vt AS (SELECT v.zone || '-' || v.hour AS node, vertex, v.zone, v.hour, {_LABEL.replace('hour', 'v.hour')} AS timelabel,
   coalesce(n, 0)::bigint AS node_counts FROM verts v LEFT JOIN
   (SELECT zone, hour, count(*) AS n FROM cells GROUP BY ALL) c ON c.zone = v.zone AND c.hour = v.hour)"""


def vertices(spark, sf):
    return save_round(
        G.vertex_table(ranks(spark, sf), G.node_counts(X.cells(spark, sf))), "vertices")


@query("vertex_table", f"WITH {RANKS}, {X.CELLS}, {VERTEX_TABLE} SELECT * FROM vt")
def vertex_table(spark, sf):
    return G.vertex_table(ranks(spark, sf), G.node_counts(X.cells(spark, sf)))


@query("map_node_to_vertex", f"""WITH {RANKS}, {X.CELLS}
   SELECT vertex, count(*)::bigint AS n, {r('sum(productivity)', 'total', 4)}
   FROM cells JOIN verts USING (zone, hour) GROUP BY vertex""")
def map_node_to_vertex(spark, sf):
    placed = G.map_node_to_vertex(X.cells(spark, sf), vertices(spark, sf))
    return rounded(placed.groupBy("vertex").agg(
        F.count("*").alias("n"), F.sum("productivity").alias("total")), 4)


def trail_path(spark, sf):
    """Trail documents: one per zone, its observed hours in two trails (before and after noon)."""
    steps = X.cells(spark, sf).select("zone", "hour").distinct().withColumn(
        "half", (((F.col("hour") - 1) % 24) >= 12).cast("int"))
    # At most 168 positions per zone.
    seq = F.sort_array(F.collect_list(F.struct("half", "hour")))
    docs = steps.groupBy("zone").agg(
        seq.alias("s"), F.sum(1 - F.col("half")).cast("bigint").alias("n0"))
    n = F.size("s")
    first = F.array(F.lit(1).cast("bigint"))
    brks = F.when((F.col("n0") > 0) & (F.col("n0") < n), F.concat(
        first, F.array(F.col("n0") + 1), F.array((n + 1).cast("bigint")))).otherwise(
        F.concat(first, F.array((n + 1).cast("bigint"))))
    docs = docs.select(
        F.transform("s", lambda x: F.col("zone") * 168 + x["hour"] - 1).cast("array<bigint>").alias("ptr"),
        brks.alias("brks"), F.transform("s", lambda x: 1 / (1 + x["hour"] % 2)).alias("wts"),
        F.transform("s", lambda x: F.lit(0)).alias("istemp"),
        n.cast("bigint").alias("num_nodes"))
    path = fresh_path(spark, "trails")
    docs.write.json(path)
    return path


_TRAILS = X.CELLS + """,
tp AS (SELECT DISTINCT zone, hour, cast((hour - 1) % 24 >= 12 AS integer) AS half FROM cells),
tr AS (SELECT zone, hour, half, zone * 168 + hour - 1 AS vertex, 1 / (1 + hour % 2) AS weight,
   lead(zone * 168 + hour - 1) OVER (PARTITION BY zone, half ORDER BY hour) AS next_vertex FROM tp),
te AS (SELECT *, CASE WHEN next_vertex = vertex + 1 OR (vertex % 168 = 167 AND next_vertex = vertex - 167)
                      THEN true ELSE false END AS temporal FROM tr WHERE next_vertex IS NOT NULL)
"""


def _time_chain(spark, sf):
    """Temporal edges of a graph numbered zone by zone."""
    z = X.zone_grid(spark, sf).select("zone", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("h"))
    return z.select((F.col("zone") * 168 + F.col("h")).cast("bigint").alias("src"),
                    (F.col("zone") * 168 + (F.col("h") + 1) % 168).cast("bigint").alias("dst"),
                    F.lit(True).alias("temporal"))


@query("read_trails", f"""WITH {_TRAILS} SELECT vertex::bigint AS vertex, {rs('weight')}, count(*) OVER (PARTITION BY zone)::bigint AS num_nodes FROM tr""")
def read_trails(spark, sf):
    return rounded(I.read_trails(spark, trail_path(spark, sf), lines=True).select("vertex", "weight", "num_nodes"))


@query("trail_steps", f"WITH {_TRAILS} SELECT vertex::bigint AS vertex, next_vertex::bigint AS next_vertex FROM tr WHERE next_vertex IS NOT NULL")
def trail_steps(spark, sf):
    return G.trail_steps(I.read_trails(spark, trail_path(spark, sf), lines=True)).select("vertex", "next_vertex")


@query("expand_trails", f"WITH {_TRAILS} SELECT vertex::bigint AS vertex, next_vertex::bigint AS next_vertex, {rs('weight')}, temporal FROM te")
def expand_trails(spark, sf):
    trails = I.read_trails(spark, trail_path(spark, sf), lines=True)
    return rounded(G.expand_trails(trails, _time_chain(spark, sf)).select(
        "vertex", "next_vertex", "weight", "temporal"))


@query("tag_edges", f"""WITH {RANKS}, {X.CELLS},
  moves AS (SELECT l_orderkey AS k, a.vertex AS vertex, b.vertex AS next_vertex
    FROM (SELECT l_orderkey, min(cast(l_suppkey AS integer)) AS z1, max(cast(l_suppkey AS integer)) AS z2,
       cast(l_orderkey % 168 + 1 AS integer) AS h FROM lineitem GROUP BY l_orderkey) o
    JOIN verts a ON a.zone = z1 AND a.hour = h JOIN verts b ON b.zone = z2 AND b.hour = (CASE WHEN z1 = z2 THEN h % 168 + 1 ELSE h END)),
  t AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, bool_or(temporal) AS f FROM st GROUP BY ALL)
  SELECT k, vertex, next_vertex, coalesce(f, false) AS temporal FROM moves
  LEFT JOIN t ON a = least(vertex, next_vertex) AND b = greatest(vertex, next_vertex)""")
def tag_edges(spark, sf):
    rk = ranks(spark, sf)
    v = save_round(G.expand_hours(rk).select("zone", "hour", "vertex"), "places")
    o = X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.col("l_suppkey").cast("int")).alias("z1"), F.max(F.col("l_suppkey").cast("int")).alias("z2"))
    h = (F.col("l_orderkey") % 168 + 1).cast("int")
    o = o.select(F.col("l_orderkey").alias("k"), "z1", "z2", h.alias("h1"),
                 F.when(F.col("z1") == F.col("z2"), (h % 168 + 1).cast("int")).otherwise(h).alias("h2"))
    a = G.map_node_to_vertex(o, v, "z1", "h1")
    nxt = v.select(F.col("zone").alias("z2"), F.col("hour").alias("h2"),
                   F.col("vertex").alias("next_vertex"))
    steps = a.join(nxt, ["z2", "h2"]).select("k", "vertex", "next_vertex")
    return G.tag_edges(steps, G.spacetime_edges(X.adjacency(spark, sf), rk)).select(
        "k", "vertex", "next_vertex", "temporal")


def grid_cells(spark, sf):
    """Grid of orders, 100 rows high: row from the key, column (time) from its block."""
    o = X.table(spark, sf, "orders")
    return o.groupBy(
        (F.col("o_orderkey") % 100 + 1).cast("int").alias("i"),
        (F.floor(F.col("o_orderkey") / 100) + 1).cast("int").alias("j"),
    ).agg((F.sum("o_totalprice") / 77777).alias("signal"))


_CELLGRID = """
g AS (SELECT cast(o_orderkey % 100 + 1 AS integer) AS i, cast(o_orderkey // 100 + 1 AS integer) AS j,
      sum(o_totalprice) / 77777 AS signal FROM orders GROUP BY ALL)
"""
_NEAR = _CELLGRID + """,
n AS (SELECT g.i, g.j, g.signal, t.signal AS prev_time, s.signal AS prev_space, d.signal AS prev_diagonal
  FROM g JOIN g t ON t.i = g.i AND t.j = g.j - 1 JOIN g s ON s.i = g.i - 1 AND s.j = g.j
  JOIN g d ON d.i = g.i - 1 AND d.j = g.j - 1)
"""


@query("grid_edges", f"""WITH {_CELLGRID} SELECT ((a.j - 1) * 100 + a.i)::bigint AS src, ((b.j - 1) * 100 + b.i)::bigint AS dst,
   b.j = a.j + 1 AS temporal FROM g a JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)""")
def grid_edges(spark, sf):
    return G.grid_edges(grid_cells(spark, sf), 100)


@query("grid_neighbors", f"WITH {_NEAR} SELECT i, j, {rs('signal', 'prev_time', 'prev_space', 'prev_diagonal')} FROM n")
def grid_neighbors(spark, sf):
    return rounded(G.grid_neighbors(grid_cells(spark, sf), "signal"))


_CORR = ("signal", "prev_time", "prev_space", "prev_diagonal")


@query("neighbor_correlation", f"WITH {_NEAR} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM n" for a in _CORR for b in _CORR))
def neighbor_correlation(spark, sf):
    return rounded(G.neighbor_correlation(G.grid_neighbors(grid_cells(spark, sf), "signal"), "signal"))


@query("grid_index", """SELECT o_orderkey, (o_orderkey // 100 * 100 + o_orderkey % 100 + 1)::bigint AS idx,
   (o_orderkey % 100 + 1)::bigint AS i, (o_orderkey // 100 + 1)::bigint AS j FROM orders""")
def grid_index(spark, sf):
    k = F.col("o_orderkey")
    o = X.table(spark, sf, "orders").select(
        "o_orderkey", H.grid_to_index(k % 100 + 1, F.floor(k / 100) + 1, 100).alias("idx"))
    i, j = H.index_to_grid(F.col("idx"), 100)
    return o.withColumns({"i": i, "j": j})
