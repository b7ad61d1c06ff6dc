"""Folds, penalty candidates, held-out scores and the choice of the best candidate."""

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.likelihood import binomial_loglik, hash_uniform

# Search box of log10 penalties (within time, across time alike).
L1_BOX = (-2.0, 1.0)
L2_BOX = (-3.0, 2.0)
OFF = 1e-12


def fold_of(vertex, folds: int, seed: int = 0):
    """Near-even fold of a vertex from the high bits of a multiplicative hash."""
    low = F.pmod(vertex.cast("bigint"), F.lit(2147483648))
    h = (low * 2654435761 + seed) % 4294967296
    return (F.floor(h / 65536) % folds).cast("int")


def shuffle_order(vertex, seed: int = 0):
    """Sort key of a repeatable random order."""
    return hash_uniform(vertex, seed)


def assign_folds(counts: DataFrame, folds: int, seed: int = 0, attempts: str = "attempts"):
    """Fold of every observed vertex (at least one attempt); NULL for the others."""
    return counts.withColumn(
        "fold", F.when(F.col(attempts) >= 1, fold_of(F.col("vertex"), folds, seed)))


def mask_fold(counts: DataFrame, folds: int) -> DataFrame:
    """Training counts of all folds at once: held-out vertices are zeroed, not removed."""
    out = counts.withColumn("held_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    held = F.coalesce(F.col("fold") == F.col("held_fold"), F.lit(False))
    return out.withColumns({
        "successes": F.when(held, 0).otherwise(F.col("successes")),
        "attempts": F.when(held, 0).otherwise(F.col("attempts"))})


def heldout(df: DataFrame, fold: int):
    """(training, test) rows of one fold; unobserved vertices count as training."""
    return df.where(~F.col("fold").eqNullSafe(F.lit(fold))), df.where(F.col("fold") == fold)


def observed_minus_heldout(observed: DataFrame, held: DataFrame, key: str = "vertex") -> DataFrame:
    return observed.select(key).join(held.select(key), key, "left_anti")


def corner_penalties(spark: SparkSession) -> DataFrame:
    """The 16 corners of the search box."""
    rows = [(i, *[float(10.0 ** e) for e in c])
            for i, c in enumerate(product(L1_BOX, L2_BOX, L1_BOX, L2_BOX))]
    return spark.createDataFrame(
        rows, "candidate int, l1_space double, l2_space double, l1_time double, l2_time double")


def candidate_penalties(spark: SparkSession, sampled: int, seed: int = 0,
                        corners: bool = True) -> DataFrame:
    """Corners first, then ``sampled`` points drawn evenly in the log box."""
    base = 16 if corners else 0
    draw = spark.range(sampled).select(F.col("id"))

    def axis(k, box):
        u = hash_uniform(F.col("id") * 4 + k, seed)
        return F.pow(F.lit(10.0), F.lit(box[0]) + u * (box[1] - box[0]))

    points = draw.select(
        (F.col("id") + base).cast("int").alias("candidate"),
        axis(0, L1_BOX).alias("l1_space"), axis(1, L2_BOX).alias("l2_space"),
        axis(2, L1_BOX).alias("l1_time"), axis(3, L2_BOX).alias("l2_time"))
    return corner_penalties(spark).unionByName(points) if corners else points


def method_grid(spark: SparkSession, method: str, n: int | None = None, top: float = 5.0):
    """Penalty pairs of a method in space times the same pairs in time.

    ``fl`` uses the absolute penalty only, ``kal`` the squared one only, ``enet`` both.
    """
    n = n or (10 if method == "enet" else 20)
    axis = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(
        F.lit(10.0), F.lit(-2.0) + (F.log10(F.lit(top)) + 2.0) * k / (n - 1)))
    none = F.array(F.lit(OFF))
    l1, l2 = {"fl": (axis, none), "kal": (none, axis), "enet": (axis, axis)}[method]
    one = spark.range(1)
    for name, values in zip(("l1_space", "l2_space", "l1_time", "l2_time"), (l1, l2, l1, l2)):
        one = one.withColumn(name, F.explode(values))
    return one.drop("id").withColumn("method", F.lit(method))


def cross_models(splits: DataFrame, candidates: DataFrame, folds: int | None = None) -> DataFrame:
    """Model table: every split with every candidate (and fold), numbered by arithmetic.

    All three lists are parameters; they are multiplied by exploding arrays.
    """
    cols = [c for c in candidates.columns if c != "candidate"]
    listed = candidates.agg(F.collect_list(F.struct("candidate", *cols))).scalar()
    total = candidates.agg(F.max("candidate") + 1).scalar()
    out = splits.select("split_id").withColumn("c", F.explode(listed)).select("split_id", "c.*")
    number = F.col("split_id").cast("bigint") * total + F.col("candidate")
    if folds is None:
        return out.withColumn("model_id", number)
    out = out.withColumn("held_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return out.withColumn("model_id", number * folds + F.col("held_fold"))


def cv_loglik(test: DataFrame, betas: DataFrame, by=("split_id", "candidate")) -> DataFrame:
    """Held-out log-likelihood per candidate, divided by its held-out attempts.

    ``test``: by..., model_id, vertex, successes, attempts of held-out vertices.
    """
    ll = binomial_loglik(F.col("successes").cast("double"), F.col("attempts").cast("double"),
                         F.col("beta"))
    return test.join(betas, ["model_id", "vertex"]).groupBy(*by).agg(
        (F.sum(ll) / F.sum("attempts")).alias("cv_loglik"),
        F.sum("attempts").cast("bigint").alias("heldout_attempts"))


def cv_errors(test: DataFrame, by=("candidate",), fold: str = "fold", y: str = "value",
              yhat: str = "beta") -> DataFrame:
    """MSE and MAE per fold, averaged over folds; RMSE from the averaged MSE."""
    gap = F.col(y) - F.col(yhat)
    per_fold = test.groupBy(*by, fold).agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))
    return per_fold.groupBy(*by).agg(
        F.avg("mse").alias("mse"), F.avg("mae").alias("mae"),
        F.sqrt(F.avg("mse")).alias("rmse"))


def best_candidate(scores: DataFrame, score: str, by=("split_id",), largest: bool = True,
                   tie: str = "candidate") -> DataFrame:
    """The winning row of each group; the smaller ``tie`` wins among equals."""
    rest = [c for c in scores.columns if c not in by]
    order = F.struct(F.col(score) if largest else -F.col(score), -F.col(tie))
    best = scores.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*by, "best.*")


def benchmark_summary(results: DataFrame, by, scores: dict[str, str], digits: int = 3):
    """Rounded mean scores by task, method and tag."""
    return results.groupBy(*by).agg(
        *[F.round(F.avg(c), digits).alias(out) for out, c in scores.items()])
