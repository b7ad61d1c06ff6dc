"""Shards that all match the mixture: proportional stratified interleaving.

Rows are shuffled by a seed within their source. The row with rank r of n has the fractional rank
(2r + 1) / 2n; sorting all rows by it spreads each source evenly, and cutting the order into equal
parts gives every shard each source's share. Ranks that agree to 60 binary places go by source.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, rank_within, seeded


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, stratum: str = "source") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Counts of shards differ by one at most. NULL sources are a source; NULL or equal doc_ids are told
    apart by their text, and equal rows may trade places; an empty table gives no rows;
    columns of ``docs`` with the two names are replaced. Both rankings run over cells of the
    order, so neither one source nor the global order meets in one task.
    """
    docs = docs.drop("shard", "slot")
    total = docs.count()
    sizes = docs.groupBy(F.col(stratum).alias("_of_stratum")).agg(F.count("*").alias("_of"))
    drawn = packed(docs, F.col(stratum).alias("_stratum"), seeded(seed, "doc_id", "text").alias("_draw"),
                   F.xxhash64("doc_id", "text").alias("_tie"))
    ranked = rank_within(drawn, ["_stratum"], "_draw", ["_tie"], "_rank", rows=total)
    # (2r + 1) / 2n to 60 binary places, 20 at a time: no step leaves 64 bits.
    even = ranked.join(sizes, F.col("_stratum").eqNullSafe(F.col("_of_stratum"))).withColumn("_even", F.lit(0)).withColumn(
        "_left", F.expr("2 * _rank + 1"))
    for _ in range(3):
        even = even.withColumn("_step", F.expr("_left * 1048576L div (2 * _of)")).withColumn(
            "_left", F.expr("_left * 1048576L % (2 * _of)")).withColumn("_even", F.expr("_even * 1048576L + _step"))
    even = even.withColumn("_even", F.expr("_even * 8"))
    placed = rank_within(even, [], "_even", ["_stratum", "_rank"], "_place", rows=total)
    shard = F.expr(f"_place * {shards} div {max(total, 1)}")
    first = F.expr(f"(_place * {shards} div {max(total, 1)} * {total} + {shards} - 1) div {shards}")
    return placed.select("row.*", shard.cast("int").alias("shard"), (F.col("_place") - first).alias("slot"))


def shard_digests(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; only sizes and hashes are shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(thin, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the rows to ``path`` as folders ``shard=N``, each in slot order."""
    placed = shard_rows(docs, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(
        path)
