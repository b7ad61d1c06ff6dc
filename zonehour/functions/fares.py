"""Standardised fare of a trip."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the fare table.
MILES_PER_KM = 0.62137119
PER_MILE = 0.99
PER_MINUTE = 0.25
MINIMUM_FARE = 4.0


def normal_surge(surge) -> Column:
    """A missing, zero or unit factor all mean: no surge."""
    return F.when(surge.isNull() | surge.isin(0, 1), F.lit(1.0)).otherwise(surge)


def fare_columns(base, meters, minutes, surge) -> dict[str, Column]:
    km = meters / 1000
    miles = km * MILES_PER_KM
    mile_part = miles * PER_MILE
    time_part = minutes * PER_MINUTE
    before_floor = base + time_part + mile_part
    with_surge = before_floor * surge
    return {
        "distance_km": km,
        "distance_miles": miles,
        "mile_fare_estim": mile_part,
        "time_fare_estim": time_part,
        "fare_pre_estimate": before_floor,
        "fare_estimate": F.greatest(before_floor, F.lit(MINIMUM_FARE)),
        "fare_pre_estimate_with_surge": with_surge,
        "fare_estimate_with_surge": F.greatest(with_surge, F.lit(MINIMUM_FARE)),
    }
