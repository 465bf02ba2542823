"""Classification and calibration metrics of grouped predictions.

Every rate is a function of four counts, so one aggregation with partial sums serves all of them;
calibration and AUROC first aggregate by bin or by distinct score, so what is windowed afterwards is
as small as the number of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleforge.operators.tables import join_null_safe
from titleforge.session import cut_lineage

Policy = Literal["fixed", "observed"]
#: The edges of ten equal bins as floating-point steps give them; 0.3, 0.6 and 0.7 lie below their edges.
EDGES = tuple([k * 0.1 for k in range(10)] + [1.0])
RATES = ("accuracy", "balanced_accuracy", "precision_yes", "recall_yes", "f1_yes", "macro_f1", "specificity", "mcc")


def indicator(label: Column) -> Column:
    return (F.coalesce(label, F.lit("")) == "Yes").cast("int")


def probability_yes(label: Column, confidence: Column) -> Column:
    """The probability of Yes that a confidence in the given label stands for; 0.5 without a label."""
    return F.when(label == "Yes", confidence).when(label == "No", F.lit(1.0) - confidence).otherwise(0.5)


def confusion(predictions: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """n, tp, fp, tn, fn per group, with `extra` aggregates."""
    y, p = indicator(F.col("gold_label")), indicator(F.col("pred_label"))
    counts = [F.count_if((y == a) & (p == b)).alias(name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), *counts, *extra)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(policy: Policy = "fixed", prefix: str = "") -> dict[str, Column]:
    """The metrics over columns tp, fp, tn, fn. With `observed`, classes that do not occur are left
    out of the averages; with `fixed` they count as 0. Empty denominators give 0."""
    tp, fp, tn, fn = (F.col(prefix + c) for c in ("tp", "fp", "tn", "fn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1_yes, f1_no = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    balanced, macro = (recall + specificity) / 2, (f1_yes + f1_no) / 2
    if policy == "observed":
        balanced = F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise(balanced)
        macro = F.when(tp + fn + fp == 0, f1_no).when(tn + fp + fn == 0, f1_yes).otherwise(macro)
    d = [c.cast("double") for c in (tp + fp, tp + fn, tn + fp, tn + fn)]
    below = F.sqrt(d[0]) * F.sqrt(d[1]) * F.sqrt(d[2]) * F.sqrt(d[3])
    above = tp.cast("double") * tn.cast("double") - fp.cast("double") * fn.cast("double")
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": balanced,
        "precision_yes": _ratio(tp, tp + fp),
        "recall_yes": recall,
        "f1_yes": f1_yes,
        "macro_f1": macro,
        "specificity": specificity,
        "mcc": F.coalesce(F.try_divide(above, below), F.lit(0.0)),
    }


def point_metrics(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), policy: Policy = "fixed") -> DataFrame:
    """Counts, rates and means per group, from one shuffle of partial sums.

    Groups of no rows do not occur; an empty table gives none. Null labels count as not Yes."""
    means = [F.avg(F.col(c).cast("double")).alias(name) for c, name in MEANS if c in predictions.columns]
    return confusion(predictions, by, means).withColumns(rates(policy))


def bin_of(p: Column, edges: Sequence[float] = EDGES) -> Column:
    """The half-open bin of a probability, the last one closed; null outside the edges."""
    out = F.when((p >= edges[-2]) & (p <= edges[-1]), len(edges) - 2)
    for k in range(len(edges) - 3, -1, -1):
        out = out.when((p >= edges[k]) & (p < edges[k + 1]), k)
    return out


MEANS = (("format_valid", "format_valid_rate"), ("thinking_observed", "thinking_observed_rate"), ("latency_ms", "mean_latency_ms"), ("reasoning_tokens", "mean_reasoning_tokens"))


def score_cells(predictions: DataFrame, by: Sequence[str], score: Column | None = None, *, whole: bool = False) -> DataFrame:
    """(by, s, y, n): rows by group, score and gold label; with `whole` also by prediction, and with the
    sums and counts of the columns that are averaged. Whatever is computed from scores starts from these
    few rows: one shuffle of partial counts."""
    s = probability_yes(F.col("pred_label"), F.col("confidence")) if score is None else score
    there = [c for c, _ in MEANS if whole and c in predictions.columns]
    keys = [*by, s.alias("s"), indicator(F.col("gold_label")).alias("y"), *([indicator(F.col("pred_label")).alias("hat")] if whole else [])]
    rows = predictions.select(*keys, *(F.col(c).cast("double").alias(f"_{c}") for c in there))
    sums = [f(F.col(f"_{c}")).alias(f"{name}_{c}") for c in there for name, f in (("sum", F.sum), ("num", F.count))]
    return rows.groupBy(*by, "s", "y", *(["hat"] if whole else [])).agg(F.count("*").alias("n"), *sums)


def _bins(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    placed = cells.withColumn("bin", bin_of(F.col("s")))
    n = F.sum("n")
    return placed.groupBy(*by, "bin").agg(n.alias("n"), (F.sum(F.col("s") * F.col("n")) / n).alias("mean_p"), (F.sum(F.col("y") * F.col("n")) / n).alias("mean_y"))


def _error(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y")))
    return _bins(cells, by).groupBy(*by).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def _area(cells: DataFrame, by: Sequence[str], *, ranges: bool = False) -> DataFrame:
    """Area under the curve from counts per score. With `ranges`, for scores that are nearly all distinct,
    the scores of all groups are sorted in ranges and the ranges' sums carried on, so that no task sees a whole group."""
    per = cells.groupBy(*by, "s").agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum((1 - F.col("y")) * F.col("n")).alias("neg"))
    inside = list(by)
    if ranges:
        per = cut_lineage(per.repartitionByRange(*by, "s").withColumn("_part", F.spark_partition_id()))
        inside = [*by, "_part"]
    w = Window.partitionBy(*inside).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    if ranges:  # one row per range and group that share rows
        sums = per.groupBy(*inside).agg(F.sum("neg").alias("_sum"))
        before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranked = join_null_safe(ranked, before.drop("_sum"), inside).withColumn("below", F.col("below") + F.col("_before"))
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2.0))
    return ranked.groupBy(*by).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def calibration_bins(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset")) -> DataFrame:
    """Per group and bin: rows, mean probability of Yes, share of Yes."""
    return _bins(score_cells(predictions, by), by).where("bin is not null")


def calibration_error(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset")) -> DataFrame:
    """Expected calibration error per group: the bins' gaps, weighted by their share of all rows.

    Rows without a probability, or with one outside 0 and 1, are in no bin but among all rows."""
    return _error(score_cells(predictions, by), by)


def auroc(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), score: Column | None = None) -> DataFrame:
    """Area under the ROC curve per group, ties shared; null where gold has one class.

    With a `score` column of its own, scores may all be distinct: they are ranked range by range."""
    return _area(score_cells(predictions, by, score), by, ranges=score is not None)


def evaluation(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), policy: Policy = "fixed") -> DataFrame:
    """The full metric table: point metrics, calibration error and AUROC, from one pass over the rows."""
    cells = score_cells(predictions, by, whole=True)
    counts = [F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("hat") == b), F.col("n"))), F.lit(0)).alias(name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]
    means = [F.try_divide(F.sum(f"sum_{c}"), F.sum(f"num_{c}")).alias(name) for c, name in MEANS if f"sum_{c}" in cells.columns]
    points = cells.groupBy(*by).agg(F.sum("n").alias("n"), *counts, *means).withColumns(rates(policy))
    return points.join(_error(cells, by), list(by), "left").join(_area(cells, by), list(by), "left")
