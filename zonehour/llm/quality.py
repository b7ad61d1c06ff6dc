"""Quality rules: a decision list learned from labelled statistics, emitted as one Spark expression.

Statistics of every text, candidate thresholds, the counts that rules are grown and pruned on, and the
verdict are all DataFrame expressions; the driver sees sums by (statistic, threshold) only.

Sequential covering: a rule grows by the threshold condition of the largest information gain until it
covers no good text, is pruned from its end on rows that it wasn't grown on, and is kept if enough of what
it covers there is bad. What it covers is set aside before the next rule grows.
"""

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.sources.shared import save_round

#: Statistics that conditions can be put on.
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "word_length", "n_words")
#: Thresholds for each statistic: this many quantiles of the bad rows and of the good ones.
THRESHOLDS = 24
#: Rules in a list, conditions in a rule, and the share of bad rows that a rule must have among what it
#: covers of the rows kept for pruning.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION = 8, 4, 0.95
#: A rule must cover so many bad rows when it is grown.
MIN_COVER = 5

SPACE = r"[ \t\n\x0B\f\r]"


@dataclass(frozen=True)
class Condition:
    """``feature`` above the threshold, or not above it."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects the text."""

    rules: list[list[Condition]] = field(default_factory=list)

    def accepts(self) -> Column:
        """True unless a rule rejects: CASE WHEN rule THEN false ... ELSE true."""
        verdict = None
        for rule in self.rules:
            fires = reduce(and_, [c.column() for c in rule])
            verdict = F.when(fires, False) if verdict is None else verdict.when(fires, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["accept"])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the text's statistics.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, and FEATURES. NULL and empty texts
    have no words and zeros everywhere. A word is a run of characters outside 0x20 and 0x09 to 0x0D.
    Three-word windows are compared by 64-bit hash within one text; each step is a column of its own that
    the next uses more than once, so no step is computed again inside another's lambda.
    """
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    words = base.select(
        *keep, F.array_remove(F.split("_text", SPACE + "+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        F.length(F.regexp_replace("_text", SPACE + "+", "")).alias("word_chars"))
    windows = words.withColumn("n_words", F.size("_words")).withColumn("_windows", F.expr(
        "if(size(_words) > 2, transform(sequence(0, size(_words) - 3),"
        " i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))), array())"))
    # Only texts in which a window repeats are sorted.
    ordered = windows.withColumn("_sorted", F.expr(
        "if(size(array_distinct(_windows)) < size(_windows),"
        " sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))), null)"))
    repeats = ordered.withColumn("_again", F.expr(
        "transform(filter(_sorted, (x, k) -> x.h <=> get(_sorted, k - 1).h or x.h <=> get(_sorted, k + 1).h), x -> x.i)"))
    counted = repeats.select(
        *keep, F.col("n_words").cast("bigint").alias("n_words"), F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"), F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("bigint(if(_again is null, 0, size(array_distinct(concat(_again, transform(_again, i -> i + 1),"
               " transform(_again, i -> i + 2))))))").alias("n_repeat_words"))
    some = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*", (F.col("n_symbols") / some).alias("symbol_share"), (F.col("n_repeat_words") / some).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("word_chars") / some).alias("word_length"))


def base_failed() -> Column:
    """Too few words, or more than half of them in windows that repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Ascending candidate thresholds by feature, from quantiles of either class."""
    points = [i / (THRESHOLDS - 1) for i in range(THRESHOLDS)]
    rows = labelled.groupBy("bad").agg(*[F.percentile_approx(f, points, 1000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(x) for r in rows for x in r[f] or []}) for f in FEATURES}


def _cells(labelled: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Labelled rows counted by fold and by how many thresholds lie below each statistic."""
    level = [reduce(lambda a, b: a + b, [(F.col(f) > t).cast("int") for t in thresholds[f]]).alias(f) for f in FEATURES]
    return labelled.select("grow", "bad", *level).groupBy("grow", *FEATURES).agg(
        F.sum(F.col("bad").cast("int")).alias("bad"), F.sum((~F.col("bad")).cast("int")).alias("good"))


def learn(labelled: DataFrame, min_precision: float = MIN_PRECISION) -> DecisionList:
    """A decision list from rows with FEATURES, ``bad`` (boolean) and ``grow`` (boolean: grow or prune on it).

    Rows without a label (NULL ``bad``) are left out; without bad rows, or without good ones, there is no
    rule. Counts cover all labelled rows; the driver reads one row for each (statistic, threshold).
    """
    labelled = labelled.where("bad is not null")
    thresholds = _thresholds(labelled)
    if not thresholds["n_words"]:
        return DecisionList()
    cells = save_round(_cells(labelled, thresholds), "rule-cells")
    levels = F.expr("stack({}, {}) as (feature, level)".format(
        len(FEATURES), ", ".join(f"'{f}', {f}" for f in FEATURES)))

    def fires(rule: list[tuple[str, bool, int]]) -> Column:
        return reduce(and_, [F.col(f) > k if above else F.col(f) <= k for f, above, k in rule], F.lit(True))

    found: list[list[tuple[str, bool, int]]] = []
    for _ in range(MAX_RULES):
        left = reduce(and_, [~fires(r) for r in found], F.lit(True))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            counts = cells.where(F.col("grow") & left & fires(rule)).select("bad", "good", levels).groupBy(
                "feature", "level").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
            best = _best_condition({f: [(r.level, r.bad, r.good) for r in counts if r.feature == f] for f in FEATURES})
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
        held = cells.where(~F.col("grow") & left).agg(*[
            F.coalesce(F.sum(F.when(fires(p), F.col(c))), F.lit(0)).alias(f"{c}{i}")
            for i, p in enumerate(prefixes) for c in ("bad", "good")]).first()
        worth = [((held[f"bad{i}"] - held[f"good{i}"]) / max(1, held[f"bad{i}"] + held[f"good{i}"]), -i)
                 for i in range(len(prefixes))]
        at = -max(worth)[1]
        if held[f"bad{at}"] < min_precision * (held[f"bad{at}"] + held[f"good{at}"]) or not held[f"bad{at}"]:
            break
        found.append(prefixes[at])
    # Level k is reached above thresholds 0 to k - 1: more than k is above threshold k.
    return DecisionList([[Condition(f, above, thresholds[f][k]) for f, above, k in r] for r in found])


def _best_condition(counts: dict[str, list[tuple[int, int, int]]]) -> tuple[tuple[str, bool, int], int] | None:
    """The condition of the largest information gain, and the good rows that it still covers."""
    bad = sum(b for _, b, _ in next(iter(counts.values())))
    good = sum(g for _, _, g in next(iter(counts.values())))
    if bad < MIN_COVER or not good:
        return None
    before, best = math.log2(bad / (bad + good)), None
    for feature, rows in counts.items():
        under_bad = under_good = 0
        for level, b, g in sorted(rows)[:-1]:
            under_bad, under_good = under_bad + b, under_good + g
            for above, p, n in ((False, under_bad, under_good), (True, bad - under_bad, good - under_good)):
                if p >= MIN_COVER and n < good:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, (feature, above, level), n)
    return best and best[1:]


def with_labels(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``stats`` of labelled documents, with ``bad`` and ``grow``; a document with both labels is bad."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(
        F.col("doc_id").cast("bigint").alias("_labelled")).agg((F.min("quality") == 0).alias("bad"))
    return stats.join(marks, F.col(doc_id) == F.col("_labelled")).withColumn(
        "grow", F.pmod(F.xxhash64("_labelled"), F.lit(3)) > 0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics, base_failed, kept) of every row; the list is learned from the labelled rows.

    Statistics are computed once and written without the texts. Rows that fail the base rules aren't kept
    and teach nothing; NULL and empty texts fail. Equal rows get equal verdicts; an empty table
    gives none, and without labels only the base rules decide. Extra columns are ignored.
    """
    stats = save_round(statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"]),
                       "text-statistics")
    rules = learn(with_labels(stats.where(~base_failed()), labels))
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & rules.accepts()).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, with the columns of ``docs``.

    Rows are written once with their statistics; the verdict then is a filter on that table.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_id"), "text")
    stats = save_round(statistics(packed, ["row", "_id"]), "judged-texts")
    rules = learn(with_labels(stats.drop("row").where(~base_failed()), labels, "_id"))
    return stats.where(~base_failed() & rules.accepts()).select("row.*")
