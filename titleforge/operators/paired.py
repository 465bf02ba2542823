"""Paired comparison of models on the titles both completed: exact McNemar test, Holm step-down."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(100_000)
def _p_value(k: int, n: int) -> float:
    """min(1, 2 P(X <= k)) of a binomial X of n fair draws, as the incomplete beta function at one half
    by its continued fraction: no memory, and steps that grow with the root of n."""
    if not n or 2 * k >= n:
        return 1.0
    a, b = float(n - k), k + 1.0  # P(X <= k) = I(1/2; a, b); a > b, where the fraction converges fast
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2.0)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) / (a + 1) / 2
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000_000):
        for part in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) / 2, -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) / 2):
            d = 1.0 + part * d
            c = 1.0 + part / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return min(1.0, 2.0 * front * value)


@F.pandas_udf(T.DoubleType())  # type: ignore[call-overload]
def exact_binomial(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided p at one half of k successes of n, k the smaller side; 1 for n = 0."""
    return pd.Series([_p_value(int(a), int(b)) for a, b in zip(k, n)])


def exact_binomial_sql(k: Column, n: Column) -> Column:
    """The same by built-in functions, for n up to about 1,000 (0.5^n must not vanish)."""
    start = F.struct(F.pow(F.lit(0.5), n).alias("pmf"), F.pow(F.lit(0.5), n).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        pmf = acc["pmf"] * (n - i + 1) / i
        return F.struct(pmf.alias("pmf"), (acc["cdf"] + pmf).alias("cdf"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(2.0) * F.aggregate(steps, start, step, lambda acc: acc["cdf"])))


def pair_counts(predictions: DataFrame) -> DataFrame:
    """(subset, model_a, model_b, shared_n, model_a_only_correct, model_b_only_correct), a before b.

    Instead of joining the predictions with themselves, the results of one title are gathered (as
    many as there are models) and paired there; only pair sums are shuffled again."""
    right = (F.col("pred_label") == F.col("gold_label")).cast("int")
    titles = predictions.groupBy("subset", "id").agg(F.array_sort(F.collect_list(F.struct("model_name", F.coalesce(right, F.lit(0)).alias("ok")))).alias("of"))
    paired = titles.select("subset", F.explode(F.flatten(F.transform("of", lambda a, i: F.transform(F.expr("of"), lambda b, j: F.struct(a["model_name"].alias("a"), b["model_name"].alias("b"), a["ok"].alias("x"), b["ok"].alias("y")))))).alias("p"))
    return (
        paired.where("p.a < p.b")
        .groupBy("subset", F.col("p.a").alias("model_a"), F.col("p.b").alias("model_b"))
        .agg(F.count("*").alias("shared_n"), F.count_if(F.expr("p.x > p.y")).alias("model_a_only_correct"), F.count_if(F.expr("p.x < p.y")).alias("model_b_only_correct"))
    )


def holm(tests: DataFrame, p: str, by: str, out: str = "holm_adjusted_p") -> DataFrame:
    """Holm's step-down per group: the running maximum of (m - rank) p, at most 1. Ties get one value."""
    ordered = Window.partitionBy(by).orderBy(p)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(by)) - F.row_number().over(ordered) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn(out, F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def pairwise_mcnemar(predictions: DataFrame) -> DataFrame:
    """All pairs of models per subset, with exact and Holm-adjusted p. Fewer than two models give no rows."""
    c = pair_counts(predictions)
    a, b = F.col("model_a_only_correct"), F.col("model_b_only_correct")
    return holm(c.withColumn("exact_mcnemar_p", exact_binomial(F.least(a, b), a + b)), "exact_mcnemar_p", "subset")
