"""Zone adjacency and rides to vertices, edges and split counts."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import graph as G
from ..operators.coarsening import smooth_from_coarse
from ..operators.smoothing import PENALTIES
from ..sources.shared import save_round
from ..sources.stored import stored


@dataclass
class SpaceTime:
    vertices: DataFrame
    edges: DataFrame
    counts: DataFrame


def zone_graph(adjacency: DataFrame, present: DataFrame, zone: str = "zone"):
    """(adjacency, ranks) of the largest connected set of zones found in the data."""
    kept = G.keep_edges_within(adjacency, present, zone)
    component = G.largest_component(G.connected_components(kept))
    kept = G.keep_edges_within(kept, component, "node")
    return kept, rank_zones(kept)


def rank_zones(adjacency: DataFrame) -> DataFrame:
    """Zone ranks by first appearance in the (zone1, zone2)-ordered adjacency list."""
    span = adjacency.agg(F.max(F.greatest("zone1", "zone2")).cast("bigint") + 1).scalar()
    placed = adjacency.select(
        F.col("zone1"), F.col("zone2"), (F.col("zone1") * span + F.col("zone2")).alias("pos"))
    return G.number_zones(placed)


def spacetime(adjacency: DataFrame, values: DataFrame, splits: DataFrame,
              value: str = "productivity") -> SpaceTime:
    """Everything the smoother needs from (zone, hour, value) rows."""
    adjacency, ranks = zone_graph(adjacency, values.select("zone").distinct())
    ranks = save_round(ranks, "ranks")
    edges = G.spacetime_edges(adjacency, ranks)
    vertices = save_round(G.vertex_table(ranks, G.node_counts(values)), "vertices")
    placed = G.map_node_to_vertex(values.select("zone", "hour", value), vertices)
    return SpaceTime(vertices, edges, C.split_counts(placed, splits, value, vertices=vertices))


def stored_betas(make, inputs, splits: DataFrame, penalties: DataFrame, name: str = "spacetime", **fit) -> DataFrame:
    """(split_id, zone, hour, vertex, beta): the whole space-time fit, made once for the same inputs and parameters.

    ``make()`` gives the ``SpaceTime`` and is called only if no such fit is stored; ``inputs`` are the tables that it
    reads, straight from their files. ``splits`` and ``penalties`` (split_id and the four penalties) are parameter
    tables of a row a split, part of the digest like ``fit``, the parameters of ``smooth_from_coarse``. A split
    without penalties isn't fitted.
    """
    listed = lambda df: sorted(repr(tuple(row)) for row in df.distinct().collect())
    parameters = {"splits": listed(splits), "penalties": listed(penalties.select("split_id", *PENALTIES)), "fit": fit}

    def fitted():
        graph = make()
        models = penalties.select(F.col("split_id").cast("bigint").alias("model_id"), *PENALTIES)
        counts = graph.counts.join(F.broadcast(penalties.select("split_id")), "split_id", "left_semi").select(
            F.col("split_id").cast("bigint").alias("model_id"), "vertex", "successes", "attempts")
        betas = smooth_from_coarse(save_round(counts, "counts"), save_round(graph.edges, "edges"), models, **fit)[0].result()
        return betas.join(graph.vertices.select("vertex", "zone", "hour"), "vertex").select(
            F.col("model_id").cast("int").alias("split_id"), "zone", "hour", "vertex", "beta")

    return stored(penalties.sparkSession, name, inputs, parameters, fitted)
