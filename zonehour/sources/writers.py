"""Writers. All of them leave ordering and sizing to partitions, never to one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, header: bool = True, fmt: str = "csv",
                mode: str = "errorifexists") -> None:
    """CSV with or without column names, or parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=header)
    else:
        writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, split: str = "split_id",
                      pieces: int | None = None, by: str = "vertex",
                      mode: str = "errorifexists") -> None:
    """One folder per split.

    ``pieces`` spreads each split over that many tasks by a hash of ``by``; left
    out, rows stay where they are, and no split is pulled through one task.
    """
    if pieces:
        df = df.repartition(F.col(split), F.pmod(F.xxhash64(by), F.lit(pieces)))
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_chunks(df: DataFrame, path: str, chunks: int = 20, by: str = "vertex",
                 mode: str = "errorifexists") -> None:
    """``chunks`` files holding consecutive, sorted ranges of ``by``."""
    (df.repartitionByRange(chunks, by).sortWithinPartitions(by)
     .write.mode(mode).parquet(path))


def write_arrays(df: DataFrame, path: str, keys, index: str, value: str, out: str,
                 mode: str = "errorifexists") -> None:
    """Surfaces as one array per key, in ``index`` order."""
    from ..operators.reshape import to_arrays

    to_arrays(df, keys, index, value, out).write.mode(mode).parquet(path)
