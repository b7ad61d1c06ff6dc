"""From raw events to the productivity table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fares import fare_columns, normal_surge
from ..functions.weektime import minutes_between, node_key, week_hour, week_label, weekday_name

RIDE_COLUMNS = (
    "ride_id", "driver_id", "started_on", "created_date", "completed_on",
    "requested_car_category", "surge_factor", "start_x", "start_y", "end_x", "end_y",
    "base_fare", "distance_meters",
)


def project_rides(df: DataFrame, columns=RIDE_COLUMNS) -> DataFrame:
    return df.select(*columns)


def drop_outside(df: DataFrame) -> DataFrame:
    """Rides that start or end outside every zone are dropped."""
    return df.dropna(subset=["start_zone", "end_zone"])


def clean_trips(df: DataFrame, meters=(10, 100000), minutes=(1, 120)) -> DataFrame:
    """Add the duration and keep plausible trips, bounds included."""
    return (
        df.withColumn("duration", minutes_between("started_on", "completed_on"))
        .where(F.col("distance_meters").between(*meters) & F.col("duration").between(*minutes))
    )


def normalize_surge(df: DataFrame) -> DataFrame:
    return df.withColumn("surge_factor", normal_surge(F.col("surge_factor")))


def estimate_fare(df: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("base_fare", "distance_meters", "duration", "surge_factor")]
    return df.withColumns(fare_columns(*cols))


def add_clock(df: DataFrame) -> DataFrame:
    """Weekday names and hours of both ends of the trip."""
    return df.withColumns({
        "weekday_started": weekday_name("started_on"),
        "weekday_completed": weekday_name("completed_on"),
        "hour_started": F.hour("started_on"),
        "hour_completed": F.hour("completed_on"),
    })


HOT_DRIVER_ROWS = 2_000_000


def _bucketed(df: DataFrame, driver: str, bucket: str, load: DataFrame, hot_rows: int):
    """Add ``_bucket``: the calendar bucket for busy drivers, one constant for the others.

    Returns the table and whether any driver is busy. At most rows/hot_rows
    drivers can be, and that number is counted before they are broadcast.
    """
    hot = load.where(F.col(driver).isNotNull()).groupBy(driver).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(driver, F.lit(True).alias("_hot"))
    busy = hot.limit(100_001).count()
    if busy == 0:
        return df.withColumn("_bucket", F.lit(None).cast("timestamp_ntz")), False
    flagged = df.join(F.broadcast(hot) if busy <= 100_000 else hot, driver, "left")
    # Rides without a start come first, as in the other drivers' windows.
    start = F.coalesce(F.date_trunc(bucket, F.col("started_on")).cast("timestamp_ntz"),
                       F.lit("0001-01-01").cast("timestamp_ntz"))
    return flagged.withColumn("_bucket", F.when(F.col("_hot"), start)).drop("_hot"), True


def driver_sequence(df: DataFrame, driver: str = "driver_id", bucket: str = "day",
                    load: DataFrame | None = None, hot_rows: int = HOT_DRIVER_ROWS) -> DataFrame:
    """Gaps to, and earnings of, each driver's next ride.

    Drivers with more than ``hot_rows`` rows in ``load`` (default ``df``; pass the
    raw table to spare a second evaluation) are not one window group. Their rides
    are ordered within (driver, calendar bucket), and the last ride of a bucket
    takes its successor from the first ride of the driver's next bucket; those
    first rides form a table with one row per busy driver and bucket. Everyone
    else takes one shuffle and one window. Ties in the start time are ordered by
    ride id. Rides without a driver are dropped; rides without a start come first.
    """
    ahead = F.struct("started_on", "created_date", "completed_on", "fare_estimate",
                     "fare_estimate_with_surge")
    inside = Window.partitionBy(driver, "_bucket").orderBy("started_on", "ride_id")
    df = df.where(F.col(driver).isNotNull())
    rides, any_hot = _bucketed(df, driver, bucket, df if load is None else load, hot_rows)
    flagged = rides
    rides = rides.withColumn("_next", F.lead(ahead).over(inside))
    if any_hot:
        heads = flagged.where(F.col("_bucket").isNotNull()).withColumn(
            "_rn", F.row_number().over(inside)).where(F.col("_rn") == 1)
        heads = heads.select(driver, "_bucket", ahead.alias("_head")).withColumn(
            "_carry", F.lead("_head").over(Window.partitionBy(driver).orderBy("_bucket")))
        rides = rides.join(heads.drop("_head"), [driver, "_bucket"], "left")
    else:
        rides = rides.withColumn("_carry", F.lit(None).cast(rides.schema["_next"].dataType))
    nxt = F.coalesce(F.col("_next"), F.col("_carry"))
    rides = rides.withColumn("_next", nxt).drop("_carry", "_bucket")
    busy = F.col("unproductive_after") + F.col("duration_next")
    hours = F.when(busy != 0, busy)
    return (
        rides.withColumns({
            "idle_after": minutes_between("completed_on", F.col("_next.created_date")),
            "unproductive_after": minutes_between("completed_on", F.col("_next.started_on")),
            "reach_after": minutes_between(F.col("_next.created_date"), F.col("_next.started_on")),
            "duration_next": minutes_between(F.col("_next.started_on"), F.col("_next.completed_on")),
            "fare_next": F.col("_next.fare_estimate"),
            "fare_next_with_surge": F.col("_next.fare_estimate_with_surge"),
        })
        .withColumns({
            "productivity": F.col("fare_next") / hours * 60,
            "productivity_with_surge": F.col("fare_next_with_surge") / hours * 60,
        })
        .drop("_next")
    )


def drop_negative_gap(df: DataFrame) -> DataFrame:
    """Overlapping rides are dropped; the last ride of a driver (no gap) stays."""
    gap = F.col("unproductive_after")
    return df.where(gap.isNull() | (gap >= 0))


def clean_gaps(df: DataFrame, idle=(0.1, 60), minutes=(1, 120), fare=200, productivity=125):
    """Keep rides with a plausible successor, bounds excluded, NULL dropped."""
    idle_after, duration = F.col("idle_after"), F.col("duration_next")
    return df.where(
        (idle_after > idle[0]) & (idle_after < idle[1])
        & (duration > minutes[0]) & (duration < minutes[1])
        & (F.col("fare_next") < fare) & (F.col("productivity") < productivity))


def add_node(df: DataFrame) -> DataFrame:
    """Hour of the week at completion, its label and the zone-hour key."""
    return (
        df.withColumn("timebin", week_hour("completed_on"))
        .withColumn("timelabel", week_label("completed_on"))
        .withColumn("node", node_key(F.col("end_zone"), F.col("timebin")))
    )


def distinct_ids(df: DataFrame, *columns) -> DataFrame:
    """How many different drivers, zones, hours ... there are."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])
