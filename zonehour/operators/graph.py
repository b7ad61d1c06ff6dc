"""Zone graph, space-time graph, its vertex numbering, trails and grids."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weektime import HOURS_PER_WEEK, bin_label, node_key
from ..sources.shared import drop_round, save_round
from .joins import with_known
from .ranking import number_rows


def dedupe_edges(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Undirected simple graph: ordered ends, no loops, each edge once."""
    return (
        edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
        .where(F.col(a) != F.col(b)).distinct()
    )


def keep_edges_within(edges: DataFrame, nodes: DataFrame, node: str, a="zone1", b="zone2"):
    """Edges with both ends in ``nodes``."""
    return (
        edges.join(nodes.select(F.col(node).alias(a)), a, "left_semi")
        .join(nodes.select(F.col(node).alias(b)), b, "left_semi")
        .select(*edges.columns)
    )


def connected_components(edges: DataFrame, a: str = "zone1", b: str = "zone2") -> DataFrame:
    """(node, component): the least node id reachable from each node.

    Every round takes the least label among the neighbours (pre-aggregated per
    task, so hubs are cheap) and then follows that label's own label, which
    roughly doubles the reach. Rounds are written tables; it stops when no label
    has moved.
    """
    both = (
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(edges.select(F.col(b), F.col(a))).distinct()
    )
    both = save_round(both, "cc-edges")
    labels = save_round(
        both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("component")),
        "cc-labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("_near"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("_near").alias("_near"))
        low = labels.join(near, "node").select(
            "node", "component", F.least("component", "_near").alias("_low"))
        # Few distinct labels remain after some rounds: look each one up once.
        jump = low.select("_low").distinct().join(
            labels.select(F.col("node").alias("_low"), F.col("component").alias("_jump")), "_low")
        moved = low.join(jump, "_low").select(
            "node", F.least("_low", "_jump").alias("new"), "component")
        step = save_round(
            moved.select("node", F.col("new").alias("component"),
                         (F.col("new") != F.col("component")).alias("changed")), "cc-labels")
        drop_round(labels)
        labels = step
        if labels.where("changed").limit(1).count() == 0:
            break
    drop_round(both)
    return labels.select("node", "component")


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge table, and its number of edges."""
    h = F.xxhash64("hi", "lo")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return tuple(row)


def contracted_components(edges: DataFrame, a: str = "zone1", b: str = "zone2") -> DataFrame:
    """(node, component), as ``connected_components`` gives, by contraction of the edge table.

    Edges are kept from the greater end ``hi`` to the lesser one ``lo``. In turn, every node passes its greater
    neighbours to the least node it knows, and then its lesser neighbours and itself. Neither adds edges, and the
    number of rounds grows with the logarithm of the longest path, until each component is a star around its least
    node. Nodes with a large part of all edges are looked up by broadcast, so a hub is never one task. Edges
    with a NULL end are no edges; a loop makes its node one of its own. Both steps of a round are written tables.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes = ends.select(F.col("x").alias("node")).union(ends.select("y")).distinct()
    star = save_round(ends.where("x <> y").select(
        F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "star")
    mark = _mark(star)
    while mark[0]:
        least = star.groupBy("hi").agg(F.min("lo").alias("least"))
        known = star.groupBy("lo").agg(F.count("*").alias("_n")).join(
            least.withColumnRenamed("hi", "lo"), "lo", "left")
        large = save_round(with_known(star, known, "lo", "_n", mark[0]).select(
            "hi", F.coalesce("least", "lo").alias("lo")).distinct(), "star")
        drop_round(star)
        least = large.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("_n"))
        passed = with_known(large, least, "hi", "_n", mark[0]).where("lo <> least").select(
            F.col("lo").alias("hi"), F.col("least").alias("lo"))
        star = save_round(passed.union(least.select("hi", "least")).distinct(), "star")
        drop_round(large)
        before, mark = mark, _mark(star)
        if mark == before:
            break
    return nodes.join(star.withColumnRenamed("hi", "node"), "node", "left").select(
        "node", F.coalesce("lo", "node").alias("component"))


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties go to the smaller component id."""
    top = (
        components.groupBy("component").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "component").limit(1)
    )
    return components.join(F.broadcast(top.select("component")), "component", "left_semi").select(
        "node", "component")


def present_in_component(zones: DataFrame, component: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Zones that occur in the data and belong to the component."""
    return zones.select(zone).intersect(component.select(F.col("node").alias(zone)))


def number_zones(adjacency: DataFrame, position: str = "pos") -> DataFrame:
    """Zone ranks by first appearance in the adjacency list, 0-based.

    An edge at list position p shows its ends at places 2p and 2p+1.
    """
    first = (
        adjacency.select(F.col("zone1").alias("zone"), (F.col(position) * 2).alias("first_pos"))
        .union(adjacency.select("zone2", F.col(position) * 2 + 1))
        .groupBy("zone").agg(F.min("first_pos").alias("first_pos"))
    )
    return number_rows(save_round(first, "first-seen"), "first_pos", "zone_rank")


def vertex_id(hour, rank, zones):
    """Vertices are listed hour by hour, zones in rank order: 0-based id."""
    return ((hour - 1) * zones + rank).cast("bigint")


def expand_hours(ranks: DataFrame, hours: int = HOURS_PER_WEEK) -> DataFrame:
    """One row per zone and hour, with its vertex id."""
    total = ranks.agg(F.count("*")).scalar()
    return ranks.withColumn("hour", F.explode(F.sequence(F.lit(1), F.lit(hours)))).withColumn(
        "vertex", vertex_id(F.col("hour"), F.col("zone_rank"), total))


def spacetime_edges(adjacency: DataFrame, ranks: DataFrame, hours: int = HOURS_PER_WEEK,
                    periodic: bool = True) -> DataFrame:
    """Zone pairs repeated every hour, and every zone linked to its next hour."""
    total = ranks.agg(F.count("*")).scalar()
    slots = F.explode(F.sequence(F.lit(1), F.lit(hours)))
    one = ranks.select(F.col("zone").alias("zone1"), F.col("zone_rank").alias("r1"))
    two = ranks.select(F.col("zone").alias("zone2"), F.col("zone_rank").alias("r2"))
    pairs = adjacency.select("zone1", "zone2").join(one, "zone1").join(two, "zone2")
    space = pairs.select("r1", "r2", slots.alias("hour")).select(
        vertex_id(F.col("hour"), F.col("r1"), total).alias("src"),
        vertex_id(F.col("hour"), F.col("r2"), total).alias("dst"),
        F.lit(False).alias("temporal"))
    steps = hours if periodic else hours - 1
    time = (
        ranks.select("zone_rank", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("hour"))
        .select(vertex_id(F.col("hour"), F.col("zone_rank"), total).alias("src"),
                vertex_id(F.pmod(F.col("hour"), F.lit(hours)) + 1, F.col("zone_rank"), total)
                .alias("dst"),
                F.lit(True).alias("temporal"))
    )
    return space.unionByName(time)


def node_counts(rides: DataFrame, zone: str = "zone", hour: str = "hour") -> DataFrame:
    return rides.groupBy(F.col(zone).alias("zone"), F.col(hour).alias("hour")).agg(
        F.count("*").alias("node_counts"))


def vertex_table(ranks: DataFrame, counts: DataFrame, hours: int = HOURS_PER_WEEK) -> DataFrame:
    """Id, zone, hour, label and ride count of every vertex, empty ones included."""
    return (
        expand_hours(ranks, hours).join(counts, ["zone", "hour"], "left")
        .select(node_key(F.col("zone"), F.col("hour")).alias("node"), "vertex", "zone", "hour",
                bin_label(F.col("hour")).alias("timelabel"),
                F.coalesce("node_counts", F.lit(0)).cast("bigint").alias("node_counts"))
    )


def map_node_to_vertex(df: DataFrame, vertices: DataFrame, zone="zone", hour="hour") -> DataFrame:
    """Vertex id of each row's zone and hour; rows off the graph are dropped."""
    ids = vertices.select(F.col("zone").alias(zone), F.col("hour").alias(hour), "vertex")
    return df.join(ids, [zone, hour])


def trail_steps(trails: DataFrame) -> DataFrame:
    """Consecutive vertices of each trail; a step never crosses into the next trail."""
    w = Window.partitionBy("doc", "trail_no").orderBy("pos")
    return (
        trails.withColumn("next_vertex", F.lead("vertex").over(w))
        .where(F.col("next_vertex").isNotNull())
    )


def tag_edges(steps: DataFrame, edges: DataFrame, a: str = "vertex", b: str = "next_vertex",
              src: str = "src", dst: str = "dst") -> DataFrame:
    """Temporal flag of each unordered pair; pairs that are no edge count as spatial.

    Edges are merged, never broadcast: hours unrolled from a small zone table make Spark believe they are as small.
    """
    flags = (
        edges.select(F.least(src, dst).alias("_a"), F.greatest(src, dst).alias("_b"),
                     F.col("temporal").alias("_flag"))
        .groupBy("_a", "_b").agg(F.max("_flag").alias("_flag"))
    )
    plain = steps.drop("temporal").withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)})
    return (
        plain.join(flags.hint("merge"), ["_a", "_b"], "left")
        .withColumn("temporal", F.coalesce("_flag", F.lit(False))).drop("_a", "_b", "_flag")
    )


def expand_trails(trails: DataFrame, edges: DataFrame) -> DataFrame:
    """Trail positions as tagged, weighted steps."""
    return tag_edges(trail_steps(trails), edges).select(
        "doc", "trail_no", "pos", "vertex", "next_vertex", "weight", "temporal")


def grid_edges(cells: DataFrame, rows, i: str = "i", j: str = "j") -> DataFrame:
    """Each 4-neighbour edge of the grid cells once; steps along j are temporal.

    Cells absent from the table have no edges. Ids are column-major, 1-based.
    """
    have = cells.select(F.col(i).alias("_i"), F.col(j).alias("_j"))
    moves = F.array(F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")),
                    F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")))
    ends = cells.select(i, j, F.explode(moves).alias("m")).select(
        i, j, (F.col(i) + F.col("m.di")).alias("_i"), (F.col(j) + F.col("m.dj")).alias("_j"),
        (F.col("m.dj") == 1).alias("temporal"))
    number = lambda r, c: ((c - 1) * rows + r).cast("bigint")
    return ends.join(have, ["_i", "_j"], "left_semi").select(
        number(F.col(i), F.col(j)).alias("src"), number(F.col("_i"), F.col("_j")).alias("dst"),
        "temporal")


def grid_neighbors(cells: DataFrame, value: str, i: str = "i", j: str = "j") -> DataFrame:
    """Value of each cell with its previous-time, previous-space and diagonal cell.

    One equi-join on shifted positions, three candidates per cell.
    """
    shifts = F.array(*[
        F.struct(F.lit(n).alias("kind"), F.lit(di).alias("di"), F.lit(dj).alias("dj"))
        for n, di, dj in (("time", 0, 1), ("space", 1, 0), ("diagonal", 1, 1))])
    sent = cells.select(i, j, value, F.explode(shifts).alias("s")).select(
        (F.col(i) + F.col("s.di")).alias(i), (F.col(j) + F.col("s.dj")).alias(j),
        F.col("s.kind").alias("kind"), F.col(value).alias("_v"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("_v")))
    near = sent.groupBy(i, j).agg(
        pick("time").alias("prev_time"), pick("space").alias("prev_space"),
        pick("diagonal").alias("prev_diagonal"))
    return cells.join(near, [i, j]).dropna(subset=["prev_time", "prev_space", "prev_diagonal"])


def neighbor_correlation(neighbors: DataFrame, value: str) -> DataFrame:
    """Pearson matrix of a cell and its three neighbours, as (a, b, r) rows."""
    cols = [value, "prev_time", "prev_space", "prev_diagonal"]
    pairs = [(a, b) for a in cols for b in cols]
    wide = neighbors.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
        for a, b in pairs])
    return wide.select(F.explode(rows).alias("x")).select("x.*")
