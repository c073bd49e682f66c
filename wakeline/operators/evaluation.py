"""Evaluation of detections: confusion, derived scores, sweeps, rank metrics, tallies.

Each metric is one aggregation pass; grids of thresholds are a small constant side
joined to rows already reduced to score counts, so a sweep never multiplies the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """tp, fp, fn, tn at a threshold (score >= threshold is positive), per key; invalid counts the rows without score or label."""
    known = F.col("score").isNotNull() & F.col("y").isNotNull()
    hit, pos = known & (F.col("score") >= threshold), known & (F.col("y") == 1)
    return rows.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & known & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(known & ~hit & ~pos).alias("tn"), F.count_if(~known).alias("invalid"))


def derived(counts: DataFrame, empty=None) -> DataFrame:
    """precision, recall, f1 and iou; a zero denominator gives ``empty`` (null, or the value another report uses)."""
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp, tp + fp + fn).alias("iou"))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts and derived scores at each threshold.

    A row falls into the interval between two thresholds; the rows are summed by
    interval once, and running sums over the few intervals give every threshold.
    """
    spark, cuts = rows.sparkSession, sorted(set(map(float, thresholds)))
    grid = spark.createDataFrame([(i + 1, t) for i, t in enumerate(cuts)], "k int, threshold double")
    # the number of thresholds that the score reaches
    k = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in cuts), F.lit(0)).alias("k")
    by = rows.filter("score is not null and y is not null").groupBy(k).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    by = grid.join(by, "k", "full").select("k", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "n")])
    w = Window.orderBy("k")
    above, below = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    out = by.select("threshold", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.coalesce(F.sum("p").over(below), F.lit(0)).alias("fn"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("tn"))
    return derived(out.filter("threshold is not null"))


def best_threshold(swept: DataFrame, key: str = "iou") -> DataFrame:
    """The threshold of the greatest key; ties go to the lower threshold; null keys are skipped."""
    s = swept.filter(F.col(key).isNotNull())
    return s.agg(F.max_by("threshold", F.struct(F.col(key), -F.col("threshold"))).alias("threshold"), F.max(key).alias(key))


def per_group_iou(rows: DataFrame, threshold: float) -> DataFrame:
    """Distribution of IoU over groups: mean, median, p10, p90, worst, and the pooled value beside it."""
    groups = derived(confusion(rows, threshold, "grp"))
    p = F.percentile("iou", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    one = groups.agg(F.count(F.lit(1)).alias("groups"), F.avg("iou").alias("mean_iou"), p.alias("p"), F.min("iou").alias("worst"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return one.select("groups", "mean_iou", F.col("p")[0].alias("p10"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p90"), "worst", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("pooled"))


def auc(rows: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve by average ranks, per key; null where one class is missing.

    Rows are first reduced to counts by score; ranks are running sums over those.
    """
    c = rows.filter("score is not null and y is not null").groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("rank_sum", F.col("p") * (before + (F.col("n") + 1) / 2))
    out = c.groupBy(*keys).agg(F.sum("rank_sum").alias("r"), F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))
    return out.select(*keys, "pos", "neg", F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"))


def feature_auc(rows: DataFrame, features: list[str]) -> DataFrame:
    """Oriented AUC (at least one half) of each feature alone."""
    stacked = rows.unpivot("y", features, "feature", "score")
    return auc(stacked, "feature").select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"), (F.col("auc") >= 0.5).alias("rising"))


def outcomes(rows: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """accepted / uncertain / rejected by class, the share of positives kept and of negatives rejected."""
    v = F.when(F.col("score") >= high, "accepted").when(F.col("score") <= low, "rejected").otherwise("uncertain")
    t = rows.withColumn("v", v)
    pos = F.col("y") == 1
    return t.agg(
        *[F.count_if((F.col("v") == x) & (pos if y else ~pos)).alias(f"{x}_{y}") for x in ("accepted", "uncertain", "rejected") for y in (1, 0)],
        F.try_divide(F.count_if((F.col("v") != "rejected") & pos), F.count_if(pos)).alias("kept_sensitivity"), F.try_divide(F.count_if((F.col("v") == "rejected") & ~pos), F.count_if(~pos)).alias("rejection_specificity"),
    )


def tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and positive counts over all rows, by each key alone, in one pass of grouping sets."""
    sets = [()] + [(k,) for k in keys]
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positives"), F.count_distinct("doc_id").alias("documents"))
    return out


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n: how often each value of each column occurs, in one pass."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("d")).select("d.*")
    return stacked.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin, n over half-open bins between edges (bin 0 lies below the first)."""
    b = sum((F.when(F.col(column) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return rows.filter(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def likelihood(rows: DataFrame, model: DataFrame, features: list[str], intercept: float) -> DataFrame:
    """Logistic score of standardised features; ``model``: feature, weight, mean, std (a few rows, broadcast)."""
    stacked = rows.unpivot("vec_id", features, "feature", "x")
    z = F.sum(F.col("weight") * (F.coalesce("x", "mean") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-9)))
    s = stacked.join(F.broadcast(model), "feature").groupBy("vec_id").agg((z + intercept).alias("z"))
    return s.select("vec_id", (1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("z")))))).alias("likelihood"))


def feature_moments(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.unpivot("vec_id", features, "feature", "x").groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def thresholds(spark: SparkSession, step: int = 20) -> list[float]:
    return [i / step for i in range(1, step)]


def scene_threshold(rows: DataFrame, thresholds: list[float], group: str, split: str) -> DataFrame:
    """One row: the threshold of the greatest mean IoU of the groups of ``val`` (of equals the lowest), and what it gives on ``test``.

    threshold, val_iou, test_groups, test_iou (mean of the groups), test_pooled.  A group
    without anything to find or found has no IoU and is left out of means.  Each group is
    counted once for all thresholds.
    """
    cuts = sorted(set(map(float, thresholds)))
    hit = lambda t: F.col("score") >= t
    oil = F.col("y") == 1
    counts = rows.filter(f"score is not null and y is not null and {split} in ('val', 'test')").groupBy(split, group).agg(*[F.struct(F.lit(t).alias("threshold"), F.count_if(hit(t) & oil).alias("tp"), F.count_if(hit(t) | oil).alias("either")).alias(f"c{i}") for i, t in enumerate(cuts)])
    each = counts.select(split, F.explode(F.array(*[f"c{i}" for i in range(len(cuts))])).alias("c")).select(split, "c.*").withColumn("iou", F.try_divide("tp", "either"))
    by = each.groupBy(split, "threshold").agg(F.avg("iou").alias("mean"), F.count(F.lit(1)).alias("groups"), F.try_divide(F.sum("tp"), F.sum("either")).alias("pooled"))
    best = by.filter(f"{split} = 'val' and mean is not null").agg(F.max_by(F.struct("threshold", "mean"), F.struct("mean", -F.col("threshold"))).alias("b")).select("b.threshold", F.col("b.mean").alias("val_iou"))
    return best.join(by.filter(f"{split} = 'test'").select("threshold", F.col("groups").alias("test_groups"), F.col("mean").alias("test_iou"), F.col("pooled").alias("test_pooled")), "threshold", "left")
