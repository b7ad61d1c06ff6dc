"""Planar predicates as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sine of the angle below which two directions count as parallel, whatever the unit of length.
_FLAT = 1e-12


def segments_of(ring) -> Column:
    """Boundary segments of a ring given as array<struct<x,y>>; closes open rings."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.arrays_zip(ring.alias("p"), shifted.alias("q"))
    segs = F.transform(
        pairs,
        lambda s: F.struct(
            s["p"]["x"].alias("x1"), s["p"]["y"].alias("y1"),
            s["q"]["x"].alias("x2"), s["q"]["y"].alias("y2"),
        ),
    )
    return F.filter(segs, lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))


def inside(x, y, segments) -> Column:
    """Even-odd test: how often does a ray to the right cross the boundary?

    Written without division, so horizontal sides need no special case.
    """

    def crossed(s):
        lhs = (x - s["x1"]) * (s["y2"] - s["y1"])
        rhs = (s["x2"] - s["x1"]) * (y - s["y1"])
        return ((s["y1"] > y) != (s["y2"] > y)) & F.when(
            s["y2"] > s["y1"], lhs < rhs
        ).otherwise(lhs > rhs)

    return F.size(F.filter(segments, crossed)) % 2 == 1


def segments_intersect(p1, p2, q1, q2, eps: float = 0.0) -> Column:
    """Do segments p1-p2 and q1-q2 meet? Each point is an (x, y) pair of columns.

    ``eps`` stretches both segments by that share of their length at each end,
    so neighbouring boundaries that leave a small gap still count as touching.
    """
    rx, ry = p2[0] - p1[0], p2[1] - p1[1]
    sx, sy = q2[0] - q1[0], q2[1] - q1[1]
    wx, wy = q1[0] - p1[0], q1[1] - p1[1]
    cross = rx * sy - ry * sx
    lo, hi = F.lit(-eps), F.lit(1.0 + eps)
    long_r, long_s = F.sqrt(rx * rx + ry * ry), F.sqrt(sx * sx + sy * sy)
    crossing = F.abs(cross) > _FLAT * long_r * long_s
    safe = F.when(crossing, cross)
    t, u = (wx * sy - wy * sx) / safe, (wx * ry - wy * rx) / safe
    proper = t.between(lo, hi) & u.between(lo, hi)
    # Parallel: both ends of q projected on p, when q lies on p's line.
    length2 = F.when(rx * rx + ry * ry > 0, rx * rx + ry * ry)
    a = (wx * rx + wy * ry) / length2
    b = ((q2[0] - p1[0]) * rx + (q2[1] - p1[1]) * ry) / length2
    stretch = F.abs(b - a) * eps
    on_line = F.abs(wx * ry - wy * rx) <= _FLAT * long_r * F.sqrt(wx * wx + wy * wy)
    overlap = (F.greatest(a, b) + stretch >= lo) & (F.least(a, b) - stretch <= hi)
    return F.coalesce(
        F.when(crossing, proper).otherwise(on_line & overlap), F.lit(False)
    )


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))
