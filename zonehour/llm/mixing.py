"""Mixing sources to target weights by Pfair scheduling.

Block i of a source with weight w (a part of 1) may not come before slot floor(i/w) and must have come by
slot ceil((i+1)/w). Going slot by slot to the released block with the earliest deadline keeps each source
less than one block from its target at every slot. Weights are exact fractions, of any number of sources.

The schedule has one entry a block. It is made on the driver, so its length is bounded: blocks hold as
many rows as it takes for a mixture to have about ``SLOTS`` of them, and 16 at least.
"""

import heapq
import math
from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, rank_within, seeded

#: Blocks that a mixture is cut into, about, when it has many rows. The schedule takes 4 bytes for each.
SLOTS = 1 << 20
#: Rows of a block, at least.
BLOCK_ROWS = 16
#: Weights of sources when none are given: their rows to this power.
EVENNESS = 0.7
#: Entries of the schedule that one row of its table holds.
CHUNK = 512


def default_weights(counts: dict) -> dict:
    """Rows to the power ``EVENNESS``, in millionths; a source with rows has a millionth at least."""
    return {s: Fraction(max(1, round(n ** EVENNESS * 1e6)), 10**6) for s, n in counts.items()}


def rows_of_block(counts: dict, weights: dict, least: int = BLOCK_ROWS, slots: int = SLOTS) -> int:
    """Rows of a block that give a mixture of about ``slots`` blocks, ``least`` at least."""
    if any(weights[s] <= 0 for s in counts):
        raise ValueError("weights must be positive")
    total = sum(Fraction(weights[s]) for s in counts)
    rows = max((n * total / Fraction(weights[s]) for s, n in counts.items()), default=0)
    return max(least, math.ceil(rows / slots))


def schedule(weights: dict, needed: dict) -> dict:
    """The slot of each block, a list for each source, up to the slot in which the last source has given its ``needed`` blocks.

    Earliest deadline first, then by name.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    if not exact or min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items()}
    total, missing = sum(parts.values()), sum(n > 0 for n in needed.values())
    placed: dict = {s: [] for s in parts}
    waiting = [(0, str(s), i, s) for i, s in enumerate(parts)]
    heapq.heapify(waiting)
    queue: list = []
    slot = 0
    while missing:
        while waiting and waiting[0][0] <= slot:
            _, name, i, s = heapq.heappop(waiting)
            heapq.heappush(queue, (-(-(len(placed[s]) + 1) * total // parts[s]), name, i, s))
        deadline, name, i, s = heapq.heappop(queue)
        assert slot < deadline
        placed[s].append(slot)
        missing -= len(placed[s]) == needed.get(s, 0)
        heapq.heappush(waiting, (len(placed[s]) * total // parts[s], name, i, s))
        slot += 1
    return placed


def source_counts(docs: DataFrame) -> dict:
    """Rows by source: one count for each source reaches the driver."""
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}


def mix(docs: DataFrame, weights: dict | None = None, seed: int = 0, keys: Iterable[str] = ("doc_id",),
        block_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mixture needs them, with the columns ``mix_block``, ``mix_slot``,
    ``mix_place`` and ``mix_epoch``.

    Each source is a ring of its rows in seeded order, cut into blocks of ``block_rows`` (default: of
    ``rows_of_block``). The mixture ends with the slot in which the last source has given all its rows: every
    row comes at least once (epoch 0), and sources that are small for their weight begin again (epoch 1,
    ...). ``mix_slot`` is the block's place in the mixture, ``mix_place`` the row's place in its block. In
    every prefix of blocks each source is less than one block from its exact share. ``weights`` by source
    default to rows ** ``EVENNESS``; sources that have no rows are left out, and sources without a weight
    are an error. A NULL source is a source of its own. Equal rows are separate rows whose order among
    themselves is open; NULL or equal ``keys`` are told apart by the text. An empty table gives no rows.
    Columns of ``docs`` named ``mix_...`` are replaced.

    A third of all rows in one source is no hot spot: ranks come from cells of a source. Memory is that of
    one cell. The driver gets one count for each source, however many there are, and makes the schedule,
    which is broadcast: 4 bytes a slot, some 4 MB by default whatever the input.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_place", "mix_epoch")
    counts = source_counts(docs)
    if weights is None:
        weights = default_weights(counts)
    elif missing := set(counts) - set(weights):
        raise ValueError(f"no weight for the sources {sorted(map(str, missing))[:5]}")
    spark, keys = docs.sparkSession, list(keys)
    block_rows = rows_of_block(counts, weights) if block_rows is None else block_rows
    slots = schedule({s: weights[s] for s in counts}, {s: -(-n // block_rows) for s, n in counts.items()}) if counts else {}
    table = F.broadcast(spark.createDataFrame(
        [(s, counts[s], len(slots[s]) * block_rows) for s in counts], "_s string, _rows bigint, _wanted bigint"))
    parts = F.broadcast(spark.createDataFrame(
        [(s, at // CHUNK, taken[at:at + CHUNK]) for s, taken in slots.items() for at in range(0, len(taken), CHUNK)],
        "_s string, _chunk bigint, _slots array<int>"))
    drawn = packed(docs, "source", seeded(seed, *keys, "text").alias("_mix"), F.xxhash64(*keys, "text").alias("_tie"))
    ranked = rank_within(drawn, ["source"], "_mix", ["_tie"], "_rank", rows=sum(counts.values()))
    place = ranked.join(table, F.col("source").cast("string").eqNullSafe(F.col("_s"))).drop("_s")
    copies = place.withColumn("mix_epoch", F.explode(F.expr(
        "sequence(0L, (_wanted - 1 - _rank) div _rows)")))
    at = copies.withColumn("_at", F.col("mix_epoch") * F.col("_rows") + F.col("_rank"))
    blocks = at.withColumn("mix_block", F.expr(f"_at div {block_rows}"))
    placed = blocks.join(parts, F.col("source").cast("string").eqNullSafe(F.col("_s"))
                         & (F.expr(f"mix_block div {CHUNK}") == F.col("_chunk")))
    return placed.select(
        "row.*", "mix_epoch", "mix_block", F.expr(f"_at % {block_rows}").alias("mix_place"),
        F.expr(f"CAST(_slots[int(mix_block % {CHUNK})] AS BIGINT)").alias("mix_slot"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture as documents: the columns of ``docs``, a row as often as it is drawn, laid out in its order."""
    mixed = mix(docs, **parameters)
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(
        *docs.columns)
