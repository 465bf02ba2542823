"""The two whole pipelines: tables from a prediction log, and classical models on a labelled file."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.functions.text import KeywordRule
from titleforge.operators import estimators, metrics, paired, resample, state
from titleforge.operators.tables import positional_split
from titleforge.session import cut_lineage

KEY = state.KEY


def log_tables(log: DataFrame, titles: DataFrame, signatures: DataFrame, *, rounds: int = 1_000, seed: int = 42, rng: str = "multinomial") -> dict[str, DataFrame]:
    """llm_predictions, llm_metrics and pairwise_mcnemar of an append-only log, for the lines of the current signatures.

    rng `numpy` draws the bootstrap from numpy's index stream, for small logs only."""
    success = cut_lineage(state.latest_success(log, signatures, titles))
    draw = resample.bootstrap_numpy if rng == "numpy" else resample.bootstrap
    table = metrics.evaluation(success).join(draw(success, rounds=rounds, seed=seed), ["model_name", "subset"], "left")
    return {"llm_predictions": success.orderBy(*KEY), "llm_metrics": table.orderBy("model_name", "subset"), "pairwise_mcnemar": paired.pairwise_mcnemar(success).orderBy("subset", "model_a", "model_b")}


def preview(log: DataFrame, titles: DataFrame, models: DataFrame, signatures: DataFrame) -> DataFrame:
    """(titles, expected, completed, remaining) in one row: what a run would do, without doing it."""
    expected = state.expected_keys(titles, models)
    row = state.progress(expected, state.latest_success(log, signatures, titles)).agg(F.sum("expected").alias("expected"), F.sum("completed").alias("completed"))
    whole = row.select(F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("completed", F.lit(0)).alias("completed"))
    return whole.select(F.lit(titles.count()).cast("long").alias("titles"), "expected", "completed", (F.col("expected") - F.col("completed")).alias("remaining"))


def classify(rows: DataFrame, dev: int, test: int, *, rounds: int = 1_000, seed: int = 42, rng: str = "multinomial", rule: KeywordRule = KeywordRule(), families: Sequence[str] = tuple(estimators.FAMILIES)) -> dict[str, Any]:
    """ml_dev_selection, ml_predictions, ml_metrics and ml_top_features of (ordinal, id, title, gold_label),
    and the fitted models under `models`: the last rows are for the test, those before for development."""
    parts = cut_lineage(positional_split(rows, dev, test).select("ordinal", "id", "title", "gold_label", "split"))
    return classify_splits(*(parts.where(F.col("split") == s) for s in ("train", "dev", "test")), rounds=rounds, seed=seed, rng=rng, rule=rule, families=families)


def classify_splits(train: DataFrame, held: DataFrame, last: DataFrame, *, rounds: int = 1_000, seed: int = 42, rng: str = "multinomial", rule: KeywordRule = KeywordRule(), families: Sequence[str] = tuple(estimators.FAMILIES)) -> dict[str, Any]:
    """The same of three parts with ordinal, id, title, gold_label.

    Hyperparameters are chosen on the development part; models are fitted anew on training and
    development part and tested on the last. The keyword rule needs no fit."""
    grid = {n: estimators.FAMILIES[n] for n in families}
    chosen = cut_lineage(estimators.selection(train, held, families=grid))
    data = estimators.prepare(train.unionByName(held))
    ruled = last.withColumn("r", rule.predict(F.col("title"))).select(F.lit("keyword_rule").alias("model_name"), "id", "ordinal", "title", "gold_label", F.col("r.label").alias("pred_label"), F.col("r.score").cast("double").alias("score_yes"))
    best = chosen.where("selected").orderBy("model_name").collect()  # one row per family
    models = dict(zip([row.model_name for row in best], estimators.fits(data, [(estimators.make_estimator(row.model_name), row.value) for row in best])))
    tops, every = [estimators.top_features(model, name) for name, model in models.items()], ruled
    if models:
        names = F.array(*(F.lit(n) for n in models))
        each = estimators.margins(list(models.values()), last).select(F.inline(F.arrays_zip(names.alias("model_name"), F.col("f"))), "id", "ordinal", "title", "gold_label")
        every = ruled.unionByName(each.withColumn("pred_label", estimators.predicted(F.col("f"))).withColumn("score_yes", estimators.score(F.col("f"))).drop("f"))
    every = cut_lineage(every)
    by, names = ["model_name"], ("accuracy", "macro_f1")
    if rng == "numpy":
        intervals = resample.bootstrap_numpy(every, by, order="ordinal", rounds=rounds, seed=seed, metrics=names, policy="observed")
    else:
        intervals = resample.bootstrap(every, by, rounds=rounds, seed=seed, metrics=names, policy="observed")
    setting = chosen.where("selected").select("model_name", F.to_json(F.create_map("parameter", F.col("value"))).alias("selected_parameters"))
    table = metrics.point_metrics(every, by, "observed").join(metrics.auroc(every, by, F.col("score_yes")), by, "left").join(intervals, by, "left").join(setting, by, "left")
    ranked = tops[0] if tops else every.sparkSession.createDataFrame([], "model_name string, direction string, rank int, feature string, weight double")
    for t in tops[1:]:
        ranked = ranked.unionByName(t)
    return {"ml_dev_selection": chosen, "ml_predictions": every.drop("ordinal"), "ml_metrics": table.orderBy(F.col("macro_f1").desc(), "model_name"), "ml_top_features": ranked, "models": models}
