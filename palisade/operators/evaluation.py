"""Evaluation: threshold sweeps, operating points and what alerts cost.

A sweep reads the scored queries once: scores are counted between neighbouring thresholds, and running sums from the top
give each threshold's alerts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLDS = tuple(round(0.02 * k, 2) for k in range(51))



def _ratios(counts: DataFrame) -> DataFrame:
    """precision is 1 without alerts; the other ratios are 0 where their divisor is."""
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), "recall": div(tp, tp + fn), "fpr": div(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", div(2 * p * r, p + r))


def sweep_counts(scored: DataFrame, thresholds=THRESHOLDS, by: tuple[str, ...] = ()) -> DataFrame:
    """scored: score, positive (bool), correct (bool) and the columns `by`. tp, fp, fn, tn of each threshold and group.

    A positive counts as found when its score reaches the threshold and its match is correct; a negative that reaches it
    is a false positive.
    """
    grid = sorted({float(t) for t in thresholds})
    step = F.array(*[F.lit(t) for t in grid])
    level = F.size(F.filter(step, lambda t: t <= F.col("score")))  # how many thresholds the score reaches
    binned = (scored.withColumn("level", level).groupBy(*by, "level")
              .agg(F.count_if(F.col("positive") & F.col("correct")).alias("tp"), F.count_if(~F.col("positive")).alias("fp"),
                   F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg")))
    levels = scored.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "at int, threshold double")
    whole = binned.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spread = whole.crossJoin(F.broadcast(levels))  # groups x thresholds
    own = binned.select(*by, F.col("level").alias("at"), "tp", "fp").filter("at > 0")
    running = W.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    return (spread.join(own, [*by, "at"], "left").fillna(0, ["tp", "fp"])
            .withColumns({"tp": F.sum("tp").over(running), "fp": F.sum("fp").over(running)})
            .withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")}).select(*by, "threshold", "tp", "fp", "fn", "tn"))


def sweep_thresholds(scored: DataFrame, thresholds=THRESHOLDS, by: tuple[str, ...] = ()) -> DataFrame:
    return _ratios(sweep_counts(scored, thresholds, by)).select(*by, "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")


def sweep_results(pos: DataFrame, neg: DataFrame, scorer: str = "ens", thresholds=THRESHOLDS) -> DataFrame:
    """The curve of one scorer over results of score_all_queries; negatives are judged by their own score."""
    score, match = F.col(f"{scorer}_score"), F.col(f"{scorer}_match_id")
    rows = pos.select(score.alias("score"), F.lit(True).alias("positive"), F.coalesce(match == F.col("true_entity_id"), F.lit(False)).alias("correct"))
    rows = rows.unionByName(neg.select(score.alias("score"), F.lit(False).alias("positive"), F.lit(False).alias("correct")))
    return sweep_thresholds(rows, thresholds).withColumn("scorer", F.lit(scorer))


def find_operating_point(curve: DataFrame, target_recall: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """The row of the highest threshold that reaches the recall, else that of the lowest threshold; achievable tells which."""
    row = F.struct("threshold", *[c for c in curve.columns if c not in (*by, "threshold")])
    reached = F.max(F.when(F.col("recall") >= target_recall, row))
    return (curve.groupBy(*by).agg(reached.alias("hit"), F.min(row).alias("low"))
            .select(*by, F.coalesce("hit", "low").alias("point"), F.col("hit").isNotNull().alias("achievable"))
            .select(*by, "point.*", "achievable"))


def best_f1(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The row with the highest f1 (of the lowest threshold among equals), and the highest recall."""
    row = F.struct("f1", (-F.col("threshold")).alias("_t"), *[c for c in curve.columns if c not in (*by, "f1")])
    return curve.groupBy(*by).agg(F.max(row).alias("row"), F.max("recall").alias("max_recall")).select(*by, "row.*", "max_recall").drop("_t")


def residual_failures(pos: DataFrame, threshold: float, scorer: str = "ens") -> DataFrame:
    """Positives (results of score_all_queries) that a scorer still misses at the threshold: reason is below_threshold, or
    wrong_match where the best match is another entity."""
    score, match = F.col(f"{scorer}_score"), F.col(f"{scorer}_match_id")
    reason = F.when(F.coalesce(score, F.lit(0.0)) < threshold, "below_threshold").when(~match.eqNullSafe(F.col("true_entity_id")), "wrong_match")
    return pos.withColumn("reason", reason).filter("reason is not null")


def cost_at_operating_point(point: DataFrame, monthly_volume: float = 1_000_000, cost_per_alert: float = 35.0) -> DataFrame:
    """False alerts a month and a year, and what they cost, from the false positive rate."""
    monthly = F.col("fpr") * float(monthly_volume)
    return point.withColumns({"monthly_false_positives": monthly, "annual_false_positives": monthly * 12, "annual_cost": monthly * 12 * float(cost_per_alert)})


def operating_grid(curves: DataFrame, targets=(0.7, 0.8, 0.9), by: tuple[str, ...] = ("scorer",)) -> DataFrame:
    out = None
    for t in targets:
        part = find_operating_point(curves, t, by).withColumn("target_recall", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out


def sweep_by_group(scored: DataFrame, group: str, least: int = 10, thresholds=THRESHOLDS) -> DataFrame:
    """The best row of each group's curve: its own positives (at least `least`) against all negatives."""
    positives = scored.filter("positive")
    often = positives.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(group)
    own = sweep_counts(positives.join(often, group, "left_semi"), thresholds, (group,)).select(group, "threshold", "tp", "fn")
    shared = sweep_counts(scored.filter("not positive"), thresholds).select("threshold", "fp", "tn")
    curves = _ratios(own.join(F.broadcast(shared), "threshold", "left").fillna(0, ["fp", "tn"]))  # one row a threshold
    return best_f1(curves.select(group, "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"), (group,))
