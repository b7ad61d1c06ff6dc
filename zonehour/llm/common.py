"""Helpers that several operators share: inputs, Arrow rows, shipped code, and ranks without a single hot task."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shipped import ship

#: Fixed value: the white space that separates words, 0x20 and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Rows, which may carry whole texts, that one ordering cell of ``rank_within`` holds at most on average.
CELL_ROWS = 8_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that extra columns can't clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, next to copies of the named ones: then nothing clashes."""
    return docs.select(F.struct("*").alias("row"), *names)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package's code at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def text_rows(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]],
              limit: int = 16 << 20) -> DataFrame:
    """One output row for every input row: ``work`` gets columns of about ``limit`` bytes as lists and returns columns."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                yield pa.RecordBatch.from_pydict(work(part.to_pydict()), schema=arrow)
                pa.default_memory_pool().release_unused()

    return arrow_map(df, run, schema)


def slices(batch: pa.RecordBatch, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about ``limit`` bytes: long texts don't add up to a batch that memory can't hold."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def seeded(seed: int, *cols) -> Column:
    """A uniform number from 0 to 2^63 - 1 that depends on the seed and the columns only."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))


def rank_within(df: DataFrame, groups: list[str], order: str, ties: list[str], rank: str,
                rows: int | None = None) -> DataFrame:
    """Add ``rank``: 0-based place of each row in its group by ``order`` (from ``seeded``), then ``ties``.

    A group is cut into cells by the leading bits of ``order``: each cell is ranked alone and starts
    after the counted rows of the cells before it, so a group that holds a third of all rows is still
    spread over many tasks. The cut doesn't change the ranks. NULL group values are a group.
    """
    total = df.count() if rows is None else rows
    bits = max(0, min(30, (total // CELL_ROWS).bit_length()))
    clear = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(groups)]
    void = [F.col(g).isNull().alias(f"_v{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))] + [f"_v{i}" for i in range(len(groups))]
    cells = df.select("*", *clear, *void, F.expr(f"shiftright({order}, {63 - bits})").alias("_cell"))
    sizes = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(order, *ties)
    return (
        cells.join(starts, [*keys, "_cell"])
        .select(*df.columns, (F.col("_start") + F.row_number().over(inside) - 1).alias(rank))
    )
