"""Raw rides to the productivity table."""

from pyspark.sql import DataFrame

from ..operators import rides as R
from ..operators.spatial import tag_zone

ENDS = {"start_zone": ("start_x", "start_y"), "end_zone": ("end_x", "end_y")}


def tagged_rides(rides: DataFrame, zones: DataFrame, cell: float | None = None) -> DataFrame:
    """Zones of both trip ends; rides outside the zones are dropped."""
    return R.drop_outside(tag_zone(rides, zones, ENDS, cell=cell))


def priced_rides(tagged: DataFrame) -> DataFrame:
    """Plausible trips with their standardised fare."""
    return R.estimate_fare(R.normalize_surge(R.add_clock(R.clean_trips(tagged))))


def productivity_table(rides: DataFrame, zones: DataFrame, cell: float = 1.0,
                       idle=(0.1, 60)) -> DataFrame:
    """Every ride whose successor allows a productivity, with its zone-hour node.

    The zones are broadcast when small, so rides are shuffled once, by driver.
    """
    seq = R.driver_sequence(priced_rides(tagged_rides(rides, zones, cell)), load=rides)
    return R.add_node(R.clean_gaps(R.drop_negative_gap(seq), idle=idle))
