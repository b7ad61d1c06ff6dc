"""Points in zones, and zones next to each other, through grid-cell equi-joins."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planar import distance, inside, segments_intersect, segments_of

BROADCAST_SEGMENTS = 500_000


def ring_table(zones: DataFrame) -> DataFrame:
    """Zone rings with boundary segments and bounding box."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return zones.withColumns({
        "segments": segments_of(F.col("ring")),
        "xmin": F.array_min(xs), "xmax": F.array_max(xs),
        "ymin": F.array_min(ys), "ymax": F.array_max(ys),
    })


def ring_size(rings: DataFrame) -> float:
    """The median over the layer's rings of the longer side of their bounding boxes; 1 for an empty layer."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return rings.agg(F.percentile_approx(side, 0.5)).first()[0] or 1.0


def label_points(rings: DataFrame) -> DataFrame:
    """One label point per zone: the middle of its bounding box over all rings."""
    return rings.groupBy("zone_id").agg(
        ((F.min("xmin") + F.max("xmax")) / 2).alias("lx"),
        ((F.min("ymin") + F.max("ymax")) / 2).alias("ly"))


def _cells(lo, hi, size):
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def _cell_id(x, size):
    return F.floor(x / size).cast("bigint")


def binary_size(size: float) -> float:
    """The nearest power of two: cell numbers and cell corners are then exact."""
    return 2.0 ** round(math.log2(size))


def zone_cells(rings: DataFrame, cell: float) -> DataFrame:
    """Grid cells of every ring, ``cell`` a power of two.

    A cell no boundary passes is either ``full`` (inside the ring) or dropped;
    other cells keep the boundary segments that a ray from inside the cell to the
    right can meet. Testing open cells matches the half-open point test, in which
    left and lower borders belong to a zone and right and upper ones do not.
    """
    x0, y0 = F.col("cx") * cell, F.col("cy") * cell
    x1, y1 = x0 + cell, y0 + cell
    listed = (
        rings.withColumn("cx", F.explode(_cells(F.col("xmin"), F.col("xmax"), cell)))
        .withColumn("cy", F.explode(_cells(F.col("ymin"), F.col("ymax"), cell)))
    )

    def passes(s):
        return ((F.least(s["x1"], s["x2"]) < x1) & (F.greatest(s["x1"], s["x2"]) > x0)
                & (F.least(s["y1"], s["y2"]) < y1) & (F.greatest(s["y1"], s["y2"]) > y0))

    def ahead(s):
        return ((F.greatest(s["x1"], s["x2"]) >= x0) & (F.least(s["y1"], s["y2"]) < y1)
                & (F.greatest(s["y1"], s["y2"]) >= y0))

    centre = inside(x0 + cell / 2, y0 + cell / 2, F.col("segments"))
    return (
        listed.withColumn("crossed", F.exists("segments", passes))
        .withColumn("full", ~F.col("crossed") & centre)
        .where(F.col("crossed") | F.col("full"))
        .select("cx", "cy", "zone_id", "full",
                F.when(F.col("crossed"), F.filter("segments", ahead)).alias("segments"))
    )


def tag_zone(points: DataFrame, zones: DataFrame, ends: dict[str, tuple[str, str]],
             key: str = "ride_id", cell: float | None = None,
             broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """Add one zone column per entry of ``ends`` ({out: (x, y)}), NULL outside all zones.

    Points in cells that lie wholly inside a zone are looked up, others are
    tested against the boundary segments of their cell; ties go to the smaller
    zone id. The zone layer is measured first. Up to ``broadcast_segments`` listed
    segments it is broadcast by cell and the points are not shuffled at all, both
    ends of a trip being tagged in one pass. A larger layer is joined by shuffle,
    with points of crowded cells spread over salts: each place is tagged once, and
    its zone goes to all points there, whatever their ``key``. Cells are as wide as
    the layer's median ring unless ``cell`` is given.
    """
    rings = ring_table(zones)
    cell = binary_size(cell or ring_size(rings))
    cells = zone_cells(rings, cell)
    size = F.coalesce(F.size("segments"), F.lit(0)) + 1
    listed = cells.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if listed > broadcast_segments:
        for out, (x, y) in ends.items():
            points = _tag_by_shuffle(points, cells, out, x, y, key, cell)
        return points
    border = F.when(~F.col("full"), F.struct("zone_id", "segments"))
    lookup = F.broadcast(cells.groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(
        F.min(F.when(F.col("full"), F.col("zone_id"))).alias("_full"),
        F.collect_list(border).alias("_border")))
    for out, (x, y) in ends.items():
        px, py = F.col(x), F.col(y)
        points = points.withColumns({"_cx": _cell_id(px, cell), "_cy": _cell_id(py, cell)})
        hits = F.filter("_border", lambda z: inside(px, py, z["segments"]))
        near = F.array_min(F.transform(hits, lambda z: z["zone_id"]))
        points = (
            points.join(lookup, ["_cx", "_cy"], "left")
            .withColumn(out, F.least(
                F.col("_full"), F.when(F.size("_border") > 0, near)))
            .drop("_cx", "_cy", "_full", "_border")
        )
    return points


def _tag_by_shuffle(points, cells, out, x, y, key, cell, rows_per_salt=2_000_000):
    px, py = F.col(x), F.col(y)
    narrow = points.select(px.alias("_x"), py.alias("_y")).distinct().select(
        "_x", "_y", _cell_id(F.col("_x"), cell).alias("cx"), _cell_id(F.col("_y"), cell).alias("cy"))
    load = narrow.groupBy("cx", "cy").agg(F.count("*").alias("_n"))
    salts = load.select("cx", "cy", F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_k"))
    # Crowded cells are at most rows/rows_per_salt many; anything else has one salt.
    hot = salts.where("_k > 1")
    few = hot.limit(100_001).count() <= 100_000
    narrow = narrow.join(F.broadcast(hot) if few else hot, ["cx", "cy"], "left")
    narrow = narrow.withColumn(
        "_salt", F.pmod(F.xxhash64("_x", "_y"), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    spread = cells.join(salts, ["cx", "cy"]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    hit = F.col("full") | inside(F.col("_x"), F.col("_y"), F.col("segments"))
    tags = (
        narrow.join(spread, ["cx", "cy", "_salt"]).where(hit)
        .groupBy("_x", "_y").agg(F.min("zone_id").alias(out))
    )
    return points.join(tags, (px == F.col("_x")) & (py == F.col("_y")), "left").drop("_x", "_y")


def label_distance(rings: DataFrame, max_dist: float) -> DataFrame:
    """Pairs of zones whose label points lie closer than ``max_dist``.

    Labels are bucketed in cells as wide as the distance, so candidates come
    from the same or an adjoining cell, never from all pairs.
    """
    labels = label_points(rings).withColumns({
        "cx": _cell_id(F.col("lx"), max_dist), "cy": _cell_id(F.col("ly"), max_dist)})
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    near = (
        labels.select(F.col("zone_id").alias("zone2"), F.col("lx").alias("x2"),
                      F.col("ly").alias("y2"), F.col("cx"), F.col("cy"))
        .withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        .withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
    )
    gap = distance(F.col("lx"), F.col("ly"), F.col("x2"), F.col("y2"))
    return (
        labels.join(near, ["cx", "cy"]).where(F.col("zone_id") < F.col("zone2"))
        .withColumn("label_dist", gap).where(F.col("label_dist") < max_dist)
        .select(F.col("zone_id").alias("zone1"), "zone2", "label_dist")
    )


def _boundary_cells(rings: DataFrame, cell: float, eps: float) -> DataFrame:
    """Boundary segments under every cell touched by their stretched bounding box."""
    seg = rings.select("zone_id", F.explode("segments").alias("s")).select("zone_id", "s.*")
    dx, dy = F.abs(F.col("x2") - F.col("x1")) * eps, F.abs(F.col("y2") - F.col("y1")) * eps
    seg = seg.withColumns({
        "_x0": F.least("x1", "x2") - dx, "_x1": F.greatest("x1", "x2") + dx,
        "_y0": F.least("y1", "y2") - dy, "_y1": F.greatest("y1", "y2") + dy})
    return (
        seg.withColumn("cx", F.explode(_cells(F.col("_x0"), F.col("_x1"), cell)))
        .withColumn("cy", F.explode(_cells(F.col("_y0"), F.col("_y1"), cell)))
        .select("cx", "cy", "zone_id", "x1", "y1", "x2", "y2")
    )


def _calm_cell(rings: DataFrame, cell: float, eps: float, limit: int) -> float:
    """Halve the cell until no cell lists more than ``limit`` segments.

    Stops when the listing has grown eightfold: then the segments really cross
    one place and smaller cells would not part them.
    """
    first = None
    while True:
        load = _boundary_cells(rings, cell, eps).groupBy("cx", "cy").count().agg(
            F.max("count").alias("top"), F.sum("count").alias("total")).first()
        first = first or load["total"] or 1
        if (load["top"] or 0) <= limit or load["total"] > 8 * first:
            return cell
        cell /= 2


def zone_adjacency(zones: DataFrame, max_dist: float = 0.25, eps: float = 0.1,
                   cell: float | None = None, crowd: int = 1000) -> DataFrame:
    """(zone1 < zone2) pairs with close label points and touching boundaries.

    Segments meet through grid cells, starting about as wide as a segment and
    halved while a cell is crowded, so a cell holds the few boundaries that pass
    it. The label distance is then tested on touching pairs only.
    """
    rings = ring_table(zones)
    cell = _calm_cell(rings, cell or max_dist / 2, eps, crowd)
    seg = _boundary_cells(rings, cell, eps).dropDuplicates()
    left = seg.select("cx", "cy", F.col("zone_id").alias("zone1"),
                      *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    right = seg.select("cx", "cy", F.col("zone_id").alias("zone2"),
                       *[F.col(c).alias(f"q_{c}") for c in ("x1", "y1", "x2", "y2")])
    c = F.col
    meet = segments_intersect(
        (c("p_x1"), c("p_y1")), (c("p_x2"), c("p_y2")),
        (c("q_x1"), c("q_y1")), (c("q_x2"), c("q_y2")), eps)
    touching = (
        left.join(right, ["cx", "cy"]).where((c("zone1") < c("zone2")) & meet)
        .select("zone1", "zone2").distinct()
    )
    labels = label_points(rings)
    one = labels.select(c("zone_id").alias("zone1"), c("lx").alias("x1"), c("ly").alias("y1"))
    two = labels.select(c("zone_id").alias("zone2"), c("lx").alias("x2"), c("ly").alias("y2"))
    return (
        touching.join(one, "zone1").join(two, "zone2")
        .where(distance(c("x1"), c("y1"), c("x2"), c("y2")) < max_dist)
        .select("zone1", "zone2")
    )


def order_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("zone1", "zone2")
