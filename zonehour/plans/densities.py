"""Log-odds to the surfaces that are stored and mapped."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import logit, pseudo_counts
from ..operators import density as D
from ..operators import posterior as P
from ..operators.counts import roll_up


@dataclass
class Surfaces:
    leaves: DataFrame
    points: DataFrame
    tails: DataFrame
    quantiles: DataFrame


def surfaces(betas: DataFrame, splits: DataFrame, keys=("vertex",),
             tails=(18.56, 21.64, 32.73, 34.74), levels=(0.1, 0.25, 0.5, 0.75)) -> Surfaces:
    """Leaf masses, point masses, tail probabilities and quantiles per key."""
    leaves = D.leaf_probabilities(betas, splits, keys)
    points = D.point_probabilities(leaves, keys)
    return Surfaces(leaves, points, D.tail_probability(points, tails, keys),
                    D.density_quantile(leaves, levels, keys))


def bootstrap_leaves(values: DataFrame, splits: DataFrame, places: DataFrame, samples: int, keys=("zone", "hour"),
                     value: str = "productivity", ident: str = "ride_id", seed: int = 0) -> DataFrame:
    """(keys, sim, leaf, leaf_lo, leaf_up, log_prob, prob): leaf masses of ``samples`` Poisson-reweighted copies of the data.

    Every key of ``places`` has every sample; the log-odds are those of the counts, not smoothed. The sample
    number is a key from the counts on, so all samples and splits are one job: values are scanned once, and
    one shuffle each brings the counts and the log-odds of a key and sample together. For smoothed samples
    pass the log-odds of ``search.bootstrap_samples`` to ``leaf_probabilities`` with the key ``sim``.
    """
    keys = list(keys)
    slots = P.bootstrap_slot_counts(values, splits, value, keys, samples, ident, seed)
    cells = places.select(*keys).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    counts = roll_up(slots, splits, [*keys, "sim"], vertices=cells)
    s, n = pseudo_counts(F.col("successes"), F.col("attempts"))
    betas = counts.withColumn("beta", logit(s, n)).drop("successes", "attempts")
    return D.leaf_probabilities(betas, splits, (*keys, "sim"))


def with_place(surface: DataFrame, vertices: DataFrame, on=("vertex",)) -> DataFrame:
    """A surface beside the id, place, label and count of its vertices."""
    return surface.join(
        vertices.select("vertex", "zone", "hour", "timelabel", "node_counts"), list(on))
