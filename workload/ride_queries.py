"""Rides: projection, zone tagging, cleaning, fares, driver sequences, time bins."""

from pyspark.sql import functions as F

from zonehour.functions.weektime import (
    bin_label, day_index, hour_index, hour_text, node_key, parse_node)
from zonehour.operators import rides as R
from zonehour.operators import spatial as S
from zonehour.operators.reshape import natural_full_join
from zonehour.plans import productivity as P

from . import standins as X
from .registry import query, r, rounded, rs

_RIDE_NUMBERS = rs("start_x", "start_y", "end_x", "end_y", "base_fare", "distance_meters")


@query("project_rides", f"""WITH {X.RIDES} SELECT ride_id, driver_id, requested_car_category,
    {rs('surge_factor')}, {_RIDE_NUMBERS}, started_on, created_date, completed_on FROM rides""")
def project_rides(spark, sf):
    return rounded(R.project_rides(X.rides(spark, sf)))


@query("natural_full_join", f"""WITH {X.RIDES},
  a AS (SELECT ride_id, driver_id, surge_factor, base_fare FROM rides WHERE distance_meters < 4000),
  b AS (SELECT ride_id, driver_id, surge_factor, distance_meters FROM rides WHERE distance_meters > 1000)
  SELECT coalesce(a.ride_id, b.ride_id) AS ride_id, coalesce(a.driver_id, b.driver_id) AS driver_id,
    coalesce(a.surge_factor, b.surge_factor) AS surge_factor, base_fare, {rs('distance_meters')}
  FROM a FULL JOIN b ON a.ride_id IS NOT DISTINCT FROM b.ride_id
   AND a.driver_id IS NOT DISTINCT FROM b.driver_id
   AND a.surge_factor IS NOT DISTINCT FROM b.surge_factor""")
def full_join(spark, sf):
    rides = X.rides(spark, sf)
    a = rides.where("distance_meters < 4000").select(
        "ride_id", "driver_id", "surge_factor", "base_fare")
    b = rides.where("distance_meters > 1000").select(
        "ride_id", "driver_id", "surge_factor", "distance_meters")
    return rounded(natural_full_join(a, b))


@query("tag_zone", f"WITH {X.TAGGED} SELECT ride_id, start_zone, end_zone FROM zoned")
def tag_zone(spark, sf):
    return S.tag_zone(X.rides(spark, sf), X.zones(spark, sf), P.ENDS).select(
        "ride_id", "start_zone", "end_zone")


@query("tag_zone_large_layer", f"WITH {X.TAGGED} SELECT ride_id, start_zone, end_zone FROM zoned")
def tag_zone_large(spark, sf):
    """The path for zone layers that are too large to broadcast."""
    return S.tag_zone(X.rides(spark, sf), X.zones(spark, sf), P.ENDS,
                      cell=4.0, broadcast_segments=0).select("ride_id", "start_zone", "end_zone")


@query("drop_outside", f"WITH {X.TAGGED} SELECT ride_id, start_zone, end_zone FROM tagged")
def drop_outside(spark, sf):
    return P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf)).select(
        "ride_id", "start_zone", "end_zone")


@query("clean_trips", f"WITH {X.PRICED} SELECT ride_id, {rs('distance_meters', 'duration')} FROM trips")
def clean_trips(spark, sf):
    return rounded(R.clean_trips(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf))).select(
        "ride_id", "distance_meters", "duration"))


@query("normalize_surge", f"""WITH {X.RIDES} SELECT ride_id,
    CASE WHEN surge_factor IS NULL OR surge_factor IN (0, 1) THEN 1.0 ELSE surge_factor END::double
    AS surge_factor FROM rides""")
def normalize_surge(spark, sf):
    return R.normalize_surge(X.rides(spark, sf)).select("ride_id", "surge_factor")


_FARES = ("distance_km", "distance_miles", "mile_fare_estim", "time_fare_estim",
          "fare_pre_estimate", "fare_estimate", "fare_pre_estimate_with_surge",
          "fare_estimate_with_surge")


@query("estimate_fare", f"WITH {X.PRICED} SELECT ride_id, {rs(*_FARES, digits=4)} FROM priced")
def estimate_fare(spark, sf):
    return rounded(P.priced_rides(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf))).select(
        "ride_id", *_FARES), 4)


@query("clock_columns", f"""WITH {X.RIDES} SELECT ride_id, dayname(started_on) AS weekday_started,
    dayname(completed_on) AS weekday_completed, cast(hour(started_on) AS integer) AS hour_started,
    cast(hour(completed_on) AS integer) AS hour_completed FROM rides""")
def clock_columns(spark, sf):
    return R.add_clock(X.rides(spark, sf)).select(
        "ride_id", "weekday_started", "weekday_completed", "hour_started", "hour_completed")


_SEQ = ("idle_after", "unproductive_after", "reach_after", "duration_next", "fare_next",
        "fare_next_with_surge", "productivity", "productivity_with_surge")


@query("driver_sequence", f"WITH {X.SEQUENCED} SELECT ride_id, driver_id, {rs(*_SEQ, digits=4)} FROM seq")
def driver_sequence(spark, sf):
    rides = P.priced_rides(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf)))
    return rounded(R.driver_sequence(rides, load=X.rides(spark, sf)).select(
        "ride_id", "driver_id", *_SEQ), 4)


@query("driver_sequence_busy", f"WITH {X.SEQUENCED} SELECT ride_id, driver_id, {rs(*_SEQ, digits=4)} FROM seq")
def driver_sequence_busy(spark, sf):
    """The path for drivers with very many rides, here from 20 rides on."""
    rides = P.priced_rides(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf)))
    return rounded(R.driver_sequence(rides, load=X.rides(spark, sf), hot_rows=20).select(
        "ride_id", "driver_id", *_SEQ), 4)


@query("drop_negative_gap", f"""WITH {X.SEQUENCED} SELECT ride_id, {rs('unproductive_after', digits=4)}
    FROM seq WHERE unproductive_after IS NULL OR unproductive_after >= 0""")
def drop_negative_gap(spark, sf):
    rides = P.priced_rides(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf)))
    return rounded(R.drop_negative_gap(R.driver_sequence(rides, load=X.rides(spark, sf))).select(
        "ride_id", "unproductive_after"), 4)


@query("clean_gaps", f"""WITH {X.SEQUENCED} SELECT ride_id, {rs('idle_after', 'productivity', digits=4)}
    FROM seq WHERE idle_after > 0.1 AND idle_after < 600 AND duration_next > 1
     AND duration_next < 120 AND fare_next < 200 AND productivity < 125""")
def clean_gaps(spark, sf):
    rides = P.priced_rides(P.tagged_rides(X.rides(spark, sf), X.zones(spark, sf)))
    return rounded(R.clean_gaps(R.driver_sequence(rides, load=X.rides(spark, sf)), idle=(0.1, 600)).select(
        "ride_id", "idle_after", "productivity"), 4)


@query("productivity_table", f"""WITH {X.PRODUCTIVE} SELECT ride_id, driver_id, start_zone, end_zone,
    {rs('duration', *_SEQ, digits=4)}, timebin, left(dayname(completed_on), 3) || ' ' ||
    lpad(cast(hour(completed_on) AS varchar), 2, '0') || ':00' AS timelabel,
    end_zone || '-' || timebin AS node FROM prod""")
def productivity_table(spark, sf):
    return rounded(P.productivity_table(X.rides(spark, sf), X.zones(spark, sf)).select(
        "ride_id", "driver_id", "start_zone", "end_zone", "duration", *_SEQ, "timebin",
        "timelabel", "node"), 4)


@query("week_bins", """SELECT event_id, cast(24 * dayofweek(ts) + hour(ts) + 1 AS integer) AS timebin,
    left(dayname(ts), 3) || ' ' || lpad(cast(hour(ts) AS varchar), 2, '0') || ':00' AS timelabel,
    (event_id % 25) || '-' || cast(24 * dayofweek(ts) + hour(ts) + 1 AS integer) AS node
    FROM events""")
def week_bins(spark, sf):
    e = X.table(spark, sf, "events").withColumns(
        {"completed_on": F.col("ts"), "end_zone": F.col("event_id") % 25})
    return R.add_node(e).select("event_id", "timebin", "timelabel", "node")


@query("bin_labels", f"""WITH {X.CELLS}, b AS (SELECT DISTINCT zone, hour,
      cast((hour - 1) // 24 AS integer) AS d, cast((hour - 1) % 24 AS integer) AS h FROM cells)
    SELECT zone || '-' || hour AS node, zone, hour, d AS wday, h AS hour_of_day,
      ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][d + 1] || ' ' || lpad(cast(h AS varchar), 2, '0') || ':00' AS label24,
      ['Sun','Mon','Tu','Wed','Th','Fr','Sat'][d + 1] || ' ' || (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END)
        || (CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END) AS label12,
      (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || (CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END) AS hour_text
    FROM b""")
def bin_labels(spark, sf):
    nodes = X.cells(spark, sf).select(node_key(F.col("zone"), F.col("hour")).alias("node")).distinct()
    zone, hour = parse_node(F.col("node"))
    h = F.col("hour")
    return nodes.withColumns({"zone": zone, "hour": hour}).select(
        "node", "zone", "hour", day_index(h).alias("wday"), hour_index(h).alias("hour_of_day"),
        bin_label(h).alias("label24"), bin_label(h, "12h").alias("label12"),
        hour_text(h).alias("hour_text"))


@query("distinct_ids", f"""WITH {X.CELLS}, {X.RIDES} SELECT count(DISTINCT driver_id)::bigint AS n_driver_id,
    (SELECT count(DISTINCT zone) FROM cells)::bigint AS n_zone,
    (SELECT count(DISTINCT hour) FROM cells)::bigint AS n_hour FROM rides""")
def distinct_ids(spark, sf):
    n = R.distinct_ids(X.cells(spark, sf), "zone", "hour")
    drivers = R.distinct_ids(X.rides(spark, sf), "driver_id")
    return drivers.withColumns({
        "n_zone": n.select("n_zone").scalar(), "n_hour": n.select("n_hour").scalar()})


@query("minutes_between", f"""WITH {X.RIDES} SELECT ride_id,
    {r("date_diff('microsecond', created_date, started_on) / 6e7", 'wait')},
    {r("date_diff('microsecond', started_on, completed_on) / 6e7", 'ride')} FROM rides""")
def minutes_between_ends(spark, sf):
    from zonehour.functions.weektime import minutes_between
    return rounded(X.rides(spark, sf).select(
        "ride_id", minutes_between("created_date", "started_on").alias("wait"),
        minutes_between("started_on", "completed_on").alias("ride")))
