"""Minutes, hours of the week and their labels.

Timestamps are read as wall-clock time (TIMESTAMP_NTZ, or TIMESTAMP under a
fixed session time zone), because the local hour drives the weekly bin.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts used by the published tables.
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
WEEKDAYS_SHORT = ("Sun", "Mon", "Tu", "Wed", "Th", "Fr", "Sat")
HOURS_PER_WEEK = 168


def minutes_between(start, end) -> Column:
    """Fractional minutes from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def weekday_name(ts) -> Column:
    return F.date_format(ts, "EEEE")


def week_hour(ts) -> Column:
    """Hour of the week, 1..168, counted from Sunday midnight."""
    return (F.dayofweek(ts) - 1) * 24 + F.hour(ts) + 1


def _pick(labels, index0) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index0 + 1).cast("int"))


def week_label(ts) -> Column:
    """``Sun 00:00`` from a timestamp."""
    return F.format_string("%s %02d:00", _pick(WEEKDAYS, F.dayofweek(ts) - 1), F.hour(ts))


def day_index(hour_of_week) -> Column:
    """0 for Sunday .. 6 for Saturday; also the sort key of weekday labels."""
    return F.floor((hour_of_week - 1) / 24).cast("int")


def hour_index(hour_of_week) -> Column:
    """0..23; also the sort key of hour labels."""
    return F.pmod(hour_of_week - 1, F.lit(24)).cast("int")


def hour_text(hour_of_week) -> Column:
    """``12AM`` .. ``11PM``."""
    h = hour_index(hour_of_week)
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, "AM").otherwise("PM"))


def bin_label(hour_of_week, style: str = "24h") -> Column:
    """Label of an hour of the week: ``Sun 00:00`` or, with ``12h``, ``Sun 12AM``."""
    if style == "24h":
        return F.format_string(
            "%s %02d:00", _pick(WEEKDAYS, day_index(hour_of_week)), hour_index(hour_of_week)
        )
    return F.concat_ws(
        " ", _pick(WEEKDAYS_SHORT, day_index(hour_of_week)), hour_text(hour_of_week)
    )


def node_key(zone, hour_of_week) -> Column:
    return F.concat_ws("-", zone.cast("string"), hour_of_week.cast("string"))


def parse_node(node):
    """(zone, hour) columns of a ``zone-hour`` key."""
    parts = F.split(node, "-")
    return parts.getItem(0).cast("int"), parts.getItem(1).cast("int")
