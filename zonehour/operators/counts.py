"""Successes and attempts of every vertex at every split."""

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import null_safe
from .splits import WIDE_SPLITS, cut_points, slot_of, slot_paths


def slot_counts(values: DataFrame, splits: DataFrame, value: str, keys, weight: str | None = None):
    """Rows per (keys, slot): the only pass over the raw values, combined map-side."""
    cuts = cut_points(splits)
    n = F.count("*") if weight is None else F.sum(weight)
    return (
        values.select(*keys, slot_of(value, cuts).alias("slot"),
                      *([weight] if weight else []))
        .where(F.col("slot").isNotNull()).groupBy(*keys, "slot").agg(n.alias("n"))
    )


def _slot_filter(slots) -> str:
    slots = sorted(slots)
    if not slots:
        return "false"
    if slots[-1] - slots[0] == len(slots) - 1:
        return f"slot BETWEEN {slots[0]} AND {slots[-1]}"
    return f"slot IN ({', '.join(map(str, slots))})"


def roll_up(slots: DataFrame, splits: DataFrame, keys, closed: str = "left",
            vertices: DataFrame | None = None) -> DataFrame:
    """Slot counts to (keys, split_id, successes, attempts).

    One shuffle brings the few slots of a key together; there every split is a
    pair of filtered sums over its slot range. With ``vertices`` every one of
    their rows gets every split, zeros included; without, only splits that were
    tried appear. Trees too large for that many columns join their slot table.
    """
    keys = list(keys)
    table = slot_paths(splits, closed)
    paths = table.limit(WIDE_SPLITS * WIDE_SPLITS).collect()  # a tree parameter
    left, right = defaultdict(list), defaultdict(list)
    for p in paths:
        (left if p["is_left"] else right)[p["split_id"]].append(p["slot"])
    ids = sorted({*left, *right})
    if len(ids) > WIDE_SPLITS or len(paths) == WIDE_SPLITS ** 2:
        sparse = slots.join(F.broadcast(table), "slot").groupBy(*keys, "split_id").agg(
            F.sum(F.when(F.col("is_left"), F.col("n")).otherwise(0)).alias("successes"),
            F.sum("n").alias("attempts"))
        return sparse if vertices is None else densify(sparse, vertices, splits, keys)
    rows = slots.select(*keys, "slot", F.col("n").cast("bigint").alias("n"))
    if vertices is not None:
        rows = rows.withColumn("_listed", F.lit(False)).unionByName(vertices.select(
            *keys, F.lit(None).cast("int").alias("slot"), F.lit(0).cast("bigint").alias("n"),
            F.lit(True).alias("_listed")))
        sums_of = [F.max("_listed").alias("_listed")]
    else:
        sums_of = []
    sums = [
        F.expr(f"coalesce(sum(n) FILTER (WHERE {_slot_filter(s)}), 0) AS {name}{i}")
        for i in ids for name, s in (("_s", left[i]), ("_a", left[i] + right[i]))]
    wide = rows.repartition(*keys).groupBy(*keys).agg(*sums, *sums_of)
    if vertices is not None:
        wide = wide.where("_listed")
    cells = ", ".join(f"{i}, _s{i}, _a{i}" for i in ids)
    long = wide.selectExpr(
        *keys, f"stack({len(ids)}, {cells}) AS (split_id, successes, attempts)")
    return long.where(F.col("attempts") > 0) if vertices is None else long


def split_counts(values: DataFrame, splits: DataFrame, value: str = "productivity",
                 keys=("vertex",), closed: str = "left", weight: str | None = None,
                 vertices: DataFrame | None = None) -> DataFrame:
    """(keys, split_id, successes, attempts); dense over ``vertices`` when they are given.

    Of the values only those with a key in ``vertices`` count; repeated vertices are one, NULL is a key.
    """
    slots = slot_counts(values, splits, value, list(keys), weight)
    return roll_up(slots, splits, keys, closed, vertices)


def densify(counts: DataFrame, vertices: DataFrame, splits: DataFrame, keys=("vertex",)):
    """Add the zero rows to sparse counts: every vertex at every split."""
    ids = splits.agg(F.sort_array(F.collect_set("split_id"))).scalar()
    full = vertices.select(*keys).distinct().withColumn("split_id", F.explode(ids))
    return null_safe(full, counts, [*keys, "split_id"], "left").select(
        *keys, "split_id",
        F.coalesce("successes", F.lit(0)).cast("bigint").alias("successes"),
        F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"))


def split_totals(counts: DataFrame, splits: DataFrame) -> DataFrame:
    """The tree with its total successes and attempts."""
    total = counts.groupBy("split_id").agg(
        F.sum("successes").cast("bigint").alias("successes"),
        F.sum("attempts").cast("bigint").alias("attempts"))
    return splits.join(total, "split_id", "left").select(
        "split_id", "lvl", "lo", "mid", "up",
        F.coalesce("successes", F.lit(0)).alias("successes"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"))


def missing_mask(counts: DataFrame, mask) -> DataFrame:
    """Zero the counts where ``mask`` holds and flag those rows."""
    hidden = F.coalesce(mask, F.lit(False))
    return counts.withColumns({
        "missing": hidden,
        "successes": F.when(hidden, 0).otherwise(F.col("successes")),
        "attempts": F.when(hidden, 0).otherwise(F.col("attempts"))})
