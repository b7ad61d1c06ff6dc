"""Readers with explicit schemas, so no pass over the data infers types."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RIDES_SCHEMA = (
    "ride_id bigint, driver_id bigint, started_on timestamp_ntz, created_date timestamp_ntz, "
    "completed_on timestamp_ntz, requested_car_category string, surge_factor double, "
    "start_x double, start_y double, end_x double, end_y double, "
    "base_fare double, distance_meters double"
)
ZONES_SCHEMA = "zone_id int, ring_id int, ring array<struct<x:double,y:double>>"
PRODUCTIVITY_SCHEMA = (
    "ride_id bigint, driver_id bigint, completed_on timestamp_ntz, end_zone int, "
    "timebin int, productivity double"
)
TRAILS_SCHEMA = (
    "ptr array<bigint>, brks array<bigint>, wts array<double>, istemp array<int>, num_nodes bigint"
)


def read_rides(spark: SparkSession, paths, schema: str = RIDES_SCHEMA) -> DataFrame:
    """CSV ride events; timestamps stay wall-clock time of the service area."""
    return spark.read.schema(schema).csv(paths, header=True)


def read_zones(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Zone layer, one row per outer ring, with an integer zone id."""
    return (
        spark.read.schema(ZONES_SCHEMA).format(fmt).load(path)
        .withColumn("zone_id", F.col("zone_id").cast("int"))
    )


def read_productivity(spark: SparkSession, path: str) -> DataFrame:
    """Typed re-read of the productivity table; only these columns are scanned."""
    return spark.read.schema(PRODUCTIVITY_SCHEMA).parquet(path)


def read_headerless(spark: SparkSession, path: str, schema: str, skip_header: bool = False):
    """Integer pairs, vectors or count matrices stored without column names."""
    return spark.read.schema(schema).csv(path, header=skip_header)


def read_trails(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Struct-of-arrays trail documents as one row per visited position.

    Breaks hold the 1-based first position of every trail, closed by the end. A file
    holds one document, however it is broken into lines, or with ``lines`` one
    document a line. Input that isn't such a document is an error.
    """
    docs = (
        spark.read.schema(TRAILS_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
        .withColumn("doc", F.xxhash64(F.col("_metadata.file_path"), F.col("ptr"), F.col("brks")))
        .withColumn("_steps", F.arrays_zip("ptr", "wts", "istemp"))
    )
    trails = docs.select("doc", "brks", "num_nodes", "_steps", F.posexplode("brks").alias("_i", "_from"))
    upto = F.coalesce(F.get("brks", F.col("_i") + 1), F.size("_steps") + 1)
    own = F.slice("_steps", F.col("_from").cast("int"), F.greatest(upto - F.col("_from"), F.lit(0)).cast("int"))
    steps = trails.select("doc", "num_nodes", "_i", "_from", F.posexplode(own).alias("_at", "step"))
    return steps.select(
        "doc",
        (F.col("_i") + 1).alias("trail_no"),
        (F.col("_from") - 1 + F.col("_at")).cast("int").alias("pos"),
        F.col("step.ptr").alias("vertex"),
        F.col("step.wts").alias("weight"),
        (F.col("step.istemp") == 1).alias("temporal"),
        "num_nodes",
    )


def read_tagged(spark: SparkSession, tagged: dict[str, str], schema: str | None = None,
                tag: str = "prob") -> DataFrame:
    """Union of CSV families: every file below each path, tagged, missing columns NULL."""
    parts = []
    for value, path in tagged.items():
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.csv(path, header=True, enforceSchema=False) if schema else reader.csv(
            path, header=True, inferSchema=True)
        parts.append(
            df.withColumn(tag, F.lit(value)).withColumn("file_name", F.col("_metadata.file_name"))
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_samples(spark: SparkSession, path: str, with_sims: bool = True) -> DataFrame:
    """Log-odds stored one folder per split; filters on split_id prune folders."""
    fields = [T.StructField("vertex", T.LongType())]
    if with_sims:
        fields.append(T.StructField("sim", T.IntegerType()))
    fields += [T.StructField("beta", T.DoubleType()), T.StructField("split_id", T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def split_from_path(path):
    """First and last bin of a split from a name such as ``betas_x_0-32.csv``."""
    pattern = r"_(\d+)-(\d+)\.csv$"
    return (
        F.regexp_extract(path, pattern, 1).cast("int"),
        F.regexp_extract(path, pattern, 2).cast("int"),
    )


def split_file_name(split_id, prefix: str = "betas_"):
    """Two-digit file name of a split."""
    return F.concat(F.lit(prefix), F.lpad(split_id.cast("string"), 2, "0"), F.lit(".csv"))
