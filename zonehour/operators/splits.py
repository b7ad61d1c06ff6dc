"""Binary split trees over the measured value.

A tree is a table (split_id, lvl, lo, mid, up), split ids in breadth-first
order. It has tens of rows, a model parameter: arrays and unpartitioned windows
over it do not grow with the data.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

MAX_SPLITS = 4096
WIDE_SPLITS = 128  # up to here the splits of a key may become columns
TOLERANCE = 1e-9


def bfs_order(splits: DataFrame) -> DataFrame:
    """Number splits by (level, low end)."""
    w = Window.orderBy("lvl", "lo")
    return splits.withColumn("split_id", (F.row_number().over(w) - 1).cast("int")).select(
        "split_id", "lvl", "lo", "mid", "up")


def _dyadic_rows(cuts, depth: int):
    """Splits of 2**depth cells given by cut point expressions, as (lvl, lo, mid, up)."""
    out = []
    for lvl in range(depth):
        half = 2 ** (depth - lvl - 1)
        for node in range(2 ** lvl):
            first = node * 2 * half
            out.append((lvl, cuts[first], cuts[first + half], cuts[first + 2 * half]))
    return out


def _explode_rows(df: DataFrame, rows) -> DataFrame:
    """A tree from SQL expressions over a one-row table."""
    cells = ", ".join(f"{lvl}, {lo}, {mid}, {up}" for lvl, lo, mid, up in rows)
    return bfs_order(df.selectExpr(f"stack({len(rows)}, {cells}) AS (lvl, lo, mid, up)"))


def uniform_splits(bounds: DataFrame, depth: int) -> DataFrame:
    """Even dyadic tree between the columns ``lo`` and ``hi`` of a one-row table."""
    n = 2 ** depth
    cuts = [f"lo + (hi - lo) * {k / n!r}D" for k in range(n + 1)]
    return _explode_rows(bounds, _dyadic_rows(cuts, depth))


def level_cuts(df: DataFrame, value: str, probs, lo=None, hi=None) -> DataFrame:
    """One row with the array of cut points: quantiles between two outer ends.

    The ends are the extremes unless given.
    """
    q = exact_quantiles(df, value, [0.0, *probs, 1.0])
    packed = q.agg(F.transform(F.sort_array(F.collect_list(F.struct("prob", "quantile"))),
                               lambda s: s["quantile"]).alias("cuts"))
    inner = F.slice("cuts", 2, len(probs))
    ends = [F.element_at("cuts", 1) if lo is None else F.lit(float(lo)),
            F.element_at("cuts", -1) if hi is None else F.lit(float(hi))]
    return packed.select(F.concat(F.array(ends[0]), inner, F.array(ends[1])).alias("cuts"))


def dyadic_probs(depth: int, margin: int | None = None):
    """2**depth - 1 even probabilities from 2**-margin to 1 - 2**-margin."""
    n = 2 ** depth - 1
    first = 2.0 ** -(margin or depth)
    return [first + (1 - 2 * first) * k / (n - 1) for k in range(n)]


def trail_levels(cuts: DataFrame, depth: int) -> DataFrame:
    """Dyadic splits at index offsets of a cut array."""
    return _explode_rows(cuts, _dyadic_rows([f"cuts[{k}]" for k in range(2 ** depth + 1)], depth))


def quantile_splits(df: DataFrame, value: str, depth: int = 5, tails=(1, 4),
                    top: float | None = 100.0, top_share: float = 0.75) -> DataFrame:
    """Dyadic splits over even quantiles, then extra splits cutting off the tails.

    The right tail is cut at even points between the last quantile and ``top``;
    with ``top=None`` it ends ``top_share`` of the way to the maximum.
    """
    n = 2 ** depth
    cuts = level_cuts(df, value, dyadic_probs(depth))
    c = [f"cuts[{k}]" for k in range(n + 1)]
    low, first, last, high = c[0], c[1], c[n - 1], c[n]
    end = f"({last} + ({high} - {last}) * {top_share!r}D)" if top is None else f"{float(top)!r}D"
    rows = _dyadic_rows(c, depth)

    def between(a, b, parts):
        """The ends and ``parts`` - 1 even points between two expressions."""
        inner = [f"{a} + ({b} - {a}) * {k / parts!r}D" for k in range(1, parts)]
        return [a, *inner, b]

    lefts, rights = tails
    edge = between(low, first, lefts + 1)
    for k in range(1, lefts + 1):
        rows.append((depth - 1 + k, low, edge[-1 - k], edge[-k]))
    edge = between(last, end, rights + 1)
    for k in range(1, rights + 1):
        rows.append((depth - 1 + k, edge[k - 1], edge[k], high))
    return _explode_rows(cuts, rows)


def dyadic_histogram_tree(df: DataFrame, value: str, depth: int = 6, min_count: int = 1):
    """Even dyadic nodes that hold at least ``min_count`` values, with their counts.

    Values are counted once at the finest level; ancestors are sums of those counts.
    """
    n = 2 ** depth
    lo = df.agg(F.min(value).cast("double")).scalar()
    hi = df.agg(F.max(value).cast("double")).scalar()
    cell = F.floor((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * n)
    leaves = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.coalesce(F.least(cell, F.lit(n - 1)), F.lit(0)).cast("int").alias("leaf"))
        .agg(F.count("*").alias("n"))
    )
    nodes = (
        leaves.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        .withColumn("node", F.expr(f"shiftright(leaf, {depth} - lvl)"))
        .groupBy("lvl", "node").agg(F.sum("n").cast("bigint").alias("n"))
        .where(F.col("n") >= min_count)
    )
    width = (hi - lo) / F.pow(F.lit(2.0), F.col("lvl"))
    rows = nodes.select(
        "lvl", (lo + width * F.col("node")).alias("lo"),
        (lo + width * (F.col("node") + 0.5)).alias("mid"),
        (lo + width * (F.col("node") + 1)).alias("up"), "n")
    w = Window.orderBy("lvl", "lo")
    return rows.withColumn("split_id", (F.row_number().over(w) - 1).cast("int")).select(
        "split_id", "lvl", "lo", "mid", "up", "n")


def _points(splits: DataFrame) -> DataFrame:
    """One row: all cut points in order, and the splits as an array."""
    return splits.agg(
        F.concat(F.array(F.min("lo")), F.sort_array(F.collect_set("mid")),
                 F.array(F.max("up"))).alias("points"),
        F.collect_list(F.struct("split_id", "lo", "mid", "up")).alias("splits"))


def evaluation_points(splits: DataFrame, duplicate_first: bool = False) -> DataFrame:
    """(x_num, x): lowest end, sorted midpoints, highest end; x_num from 1."""
    return _points(splits).select(F.posexplode("points").alias("_p", "x")).select(
        (F.col("_p") + 1).alias("x_num"), "x")


def cut_points(splits: DataFrame) -> list[float]:
    """The tree's cut points as driver-side constants (a few dozen numbers)."""
    points = _points(splits).first()["points"]
    if len(points) > MAX_SPLITS:
        raise ValueError(f"a tree of {len(points)} cut points is not a small parameter")
    return points


def split_paths(splits: DataFrame) -> DataFrame:
    """(leaf, leaf_lo, leaf_up, split_id, side): the ancestors of every leaf.

    A split is an ancestor of a leaf that lies inside it; side is +1 when the
    leaf lies in its left half. Leaves are found by interval containment, so the
    tree need not be balanced.
    """
    leaves = _points(splits).select(
        "splits", F.posexplode(F.arrays_zip(
            F.slice("points", 1, F.size("points") - 1).alias("a"),
            F.slice("points", 2, F.size("points")).alias("b"))).alias("leaf", "ab"),
    ).select("leaf", F.col("ab.a").alias("leaf_lo"), F.col("ab.b").alias("leaf_up"),
             F.explode("splits").alias("s"))
    inside = (F.col("s.lo") <= F.col("leaf_lo") + TOLERANCE) & (
        F.col("leaf_up") <= F.col("s.up") + TOLERANCE)
    left = F.col("leaf_up") <= F.col("s.mid") + TOLERANCE
    return leaves.where(inside).select(
        "leaf", "leaf_lo", "leaf_up", F.col("s.split_id").alias("split_id"),
        F.when(left, 1).otherwise(-1).alias("side"))


def slot_of(x: str, cuts):
    """Which cut point or gap between cut points holds the column ``x``.

    Slot 2i is the open gap below cut i, slot 2i+1 is cut i itself. Written as
    a balanced comparison tree: log2(cuts) comparisons per row, all in generated
    code. NULL and NaN have no slot.
    """

    def search(a, b):
        if a == b:
            return str(2 * a)
        m = (a + b) // 2
        cut = f"{float(cuts[m])!r}D"
        return (f"CASE WHEN {x} < {cut} THEN {search(a, m)} WHEN {x} > {cut} "
                f"THEN {search(m + 1, b)} ELSE {2 * m + 1} END")

    return F.expr(f"CASE WHEN {x} IS NULL OR isnan({x}) THEN CAST(NULL AS INT) "
                  f"ELSE {search(0, len(cuts))} END")


def leaf_of(x: str, cuts, closed: str = "left"):
    """Leaf index of a value; NULL outside the tree; both outer ends belong to it."""
    slot = slot_of(x, cuts)
    at_cut = (slot % 2) == 1
    cut, top = F.floor(slot / 2), len(cuts) - 1
    on_cut = (F.least(cut, F.lit(top - 1)) if closed == "left"
              else F.greatest(cut - 1, F.lit(0)))
    leaf = F.when(at_cut, on_cut).otherwise(cut - 1)
    return F.when((slot >= 1) & (slot <= 2 * top + 1), leaf).cast("int")


def slot_paths(splits: DataFrame, closed: str = "left") -> DataFrame:
    """(slot, split_id, is_left) for every slot a split covers.

    ``closed``: ``left`` counts [lo, up) with the outermost upper end included,
    ``right`` counts (lo, up] with the outermost lower end included, ``neither``
    counts (lo, up).
    """
    base = _points(splits).select(
        "splits", "points", F.posexplode("points").alias("i", "c"))
    base = base.withColumn("n", F.size("points")).withColumn(
        "below", F.when(F.col("i") > 0, F.element_at("points", F.greatest("i", F.lit(1)))))
    root_lo, root_up = F.element_at("points", 1), F.element_at("points", -1)
    s_lo, s_mid, s_up = F.col("s.lo"), F.col("s.mid"), F.col("s.up")
    c, below = F.col("c"), F.col("below")
    rows = base.select("i", "c", "below", root_lo.alias("root_lo"), root_up.alias("root_up"),
                       F.explode("splits").alias("s"))
    gaps = rows.where(
        below.isNotNull() & (s_lo <= below + TOLERANCE) & (c <= s_up + TOLERANCE)
    ).select((F.col("i") * 2).alias("slot"), F.col("s.split_id").alias("split_id"),
             (c <= s_mid + TOLERANCE).alias("is_left"))
    if closed == "left":
        held = (s_lo <= c + TOLERANCE) & (
            (c < s_up - TOLERANCE) | ((c >= F.col("root_up")) & (s_up >= F.col("root_up"))))
        left = c < s_mid - TOLERANCE
    elif closed == "right":
        held = (c <= s_up + TOLERANCE) & (
            (c > s_lo + TOLERANCE) | ((c <= F.col("root_lo")) & (s_lo <= F.col("root_lo"))))
        left = c <= s_mid + TOLERANCE
    elif closed == "neither":
        held = (c > s_lo + TOLERANCE) & (c < s_up - TOLERANCE)
        left = c < s_mid - TOLERANCE
    else:
        raise ValueError(f"closed must be left, right or neither, not {closed!r}")
    cuts = rows.where(held).select(
        (F.col("i") * 2 + 1).alias("slot"), F.col("s.split_id").alias("split_id"),
        left.alias("is_left"))
    return gaps.unionByName(cuts)
