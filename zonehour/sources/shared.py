"""Written tables that cut lineage and survive the loss of executors.

Iterative operators write each round to the cluster's shared checkpoint folder
and read it back. Compared with keeping a growing plan this also gives the next
round true file sizes, so Spark only broadcasts what is known to be small.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="zonehour-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/zonehour-{name}-{uuid.uuid4().hex}"


def save_round(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder and return the table read back from it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._zonehour_path = path
    return saved


def drop_round(saved: DataFrame | None) -> None:
    """Remove a round that a later, completely written round has replaced."""
    path = getattr(saved, "_zonehour_path", None)
    if path is None:
        return
    spark = saved.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
