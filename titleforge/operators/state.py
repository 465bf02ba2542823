"""State of an evaluation, rebuilt from its append-only log: latest results, stage outcomes, what is open.

A log record belongs to the state if its signature is the model's current one and its title is the
benchmark's. Lines count in file order, not by their time stamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleforge.functions.control import stage_budget, stage_cycle
from titleforge.operators.tables import group_ordinal, join_null_safe

KEY = ("model_name", "subset", "id")
MOST_MODELS = 10_000


def expected_keys(titles: DataFrame, models: DataFrame) -> DataFrame:
    """One row per title and model, with the title's current text and label; models is a short list."""
    names = sorted(r.model_name for r in models.select("model_name").where("model_name is not null").distinct().limit(MOST_MODELS + 1).collect())
    if len(names) > MOST_MODELS:
        raise ValueError("more models than one title can be matched with at once")
    t = titles.select("subset", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("gold_label", F.lit("")).alias("gold_label"))
    return t.select(F.explode(F.lit(names).cast("array<string>")).alias("model_name"), "subset", "id", "title", "gold_label")


def current_signatures(log: DataFrame) -> DataFrame:
    """(model_name, condition_signature): the signature most lines of a model have; ties go to the least.

    A stand-in for logs whose configuration is not at hand, as test inputs: after a change of the prompt
    the old lines win until they are fewer. Where there is a configuration, take `configured_signatures`."""
    counts = log.groupBy("model_name", "condition_signature").agg(F.count("*").alias("n"))
    best = F.min_by("condition_signature", F.struct(-F.col("n"), F.col("condition_signature")))
    return counts.where("condition_signature is not null").groupBy("model_name").agg(best.alias("condition_signature"))


def configured_signatures(spark: SparkSession, signatures: Mapping[str, str]) -> DataFrame:
    """(model_name, condition_signature) of the configured models."""
    if len(signatures) > MOST_MODELS:
        raise ValueError("more models than a log can be matched with at once")
    return spark.createDataFrame(sorted(signatures.items()), "model_name string, condition_signature string")


def _signed(log: DataFrame, signatures: DataFrame) -> DataFrame:
    return log.join(signatures.select("model_name", "condition_signature"), ["model_name", "condition_signature"], "left_semi").withColumn("title", F.coalesce("title", F.lit("")))


def _known(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows whose title is the benchmark's; `_gold` is its label."""
    known = titles.select("subset", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("gold_label", F.lit("")).alias("_gold"))
    return rows.join(known, ["subset", "id", "title"])


SUCCESS = ("title", "gold_label", "pred_label", "confidence", "format_valid", "thinking_observed", "latency_ms", "reasoning_tokens")


def success_lines(log: DataFrame, signatures: DataFrame, columns: Sequence[str] = SUCCESS) -> DataFrame:
    """(key, title, line_no, r): the last successful line with a legal label per key and wording, by partial maxima."""
    rows = _signed(log.where("status = 'success' and pred_label in ('Yes', 'No')"), signatures)
    return rows.groupBy(*KEY, "title").agg(F.max("line_no").alias("line_no"), F.max_by(F.struct(*(c for c in columns if c != "title")), "line_no").alias("r"))


def settled(lines: DataFrame, titles: DataFrame | None, columns: Sequence[str] = SUCCESS) -> DataFrame:
    """The lines of `success_lines` whose wording is the benchmark's, with its label; without one the last of each key."""
    if titles is None:
        last = lines.groupBy(*KEY).agg(F.max("line_no").alias("line_no"), F.max_by("title", "line_no").alias("title"), F.max_by("r", "line_no").alias("r"))
        label = F.col("r.gold_label") if "gold_label" in columns else F.lit(None)
    else:
        last, label = _known(lines, titles), F.col("_gold")
    return last.select(*KEY, "line_no", *(F.col("title") if c == "title" else label.alias(c) if c == "gold_label" else F.col(f"r.{c}").alias(c) for c in columns))


def latest_success(log: DataFrame, signatures: DataFrame, titles: DataFrame | None = None, *, columns: Sequence[str] = SUCCESS) -> DataFrame:
    """(model_name, subset, id, line_no, columns): the last successful line with a legal label per key.

    A later failure never undoes a success. Lines are first brought to one per key and title, and only
    these are joined with the titles (one row per subset and id): a title asked over and over shrinks
    before any row moves."""
    return settled(success_lines(log, signatures, columns), titles, columns)


def stage_outcomes(log: DataFrame, signatures: DataFrame, plan_signature: Column | str, titles: DataFrame | None = None, *, stages: Sequence[int] | None = None, geometric: bool = False, most: int = 262_144) -> DataFrame:
    """(model_name, subset, id, stage, status): the last status per key and stage of the current plan.

    A null stage counts as stage 0; negative stages, and in geometric mode lines whose budget is not
    the stage's, do not count. Lines are brought to one per key, stage and title before the titles are joined."""
    stage = F.coalesce(F.col("token_stage_index").cast("long"), F.lit(0).cast("long"))
    rows = _signed(log.where(F.col("token_plan_signature") == plan_signature).withColumn("stage", stage).where("stage >= 0"), signatures)
    if geometric:
        if not stages:
            raise ValueError("geometric mode needs the stages")
        rows = rows.where(F.col("token_budget") == stage_budget(F.col("stage"), stages, geometric=True, most=most))
    last = rows.groupBy(*KEY, "stage", "title").agg(F.max("line_no").alias("line_no"), F.max_by("status", "line_no").alias("status"))
    last = _known(last, titles) if titles is not None else last.groupBy(*KEY, "stage").agg(F.max_by("status", "line_no").alias("status"))
    return last.select(*KEY, "stage", F.coalesce("status", F.lit("")).alias("status"))


def item_stage(outcomes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, stage): how many stages from 0 on ended at the token limit without a gap."""
    w = Window.partitionBy(*KEY).orderBy("stage")
    run = outcomes.where("status = 'token_limit'").withColumn("rn", F.row_number().over(w)).where("stage = rn - 1")
    reached = run.groupBy(*KEY).agg(F.count("*").alias("stage"))
    return keys.select(*KEY).join(reached, list(KEY), "left").select(*KEY, F.coalesce("stage", F.lit(0).cast("long")).alias("stage"))


def incomplete_keys(expected: DataFrame, success: DataFrame) -> DataFrame:
    return expected.select(*KEY).join(success.select(*KEY), list(KEY), "left_anti")


def completed_keys(expected: DataFrame, success: DataFrame) -> DataFrame:
    return expected.select(*KEY).join(success.select(*KEY), list(KEY), "left_semi")


def stage_candidates(incomplete: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(key, stage): stage 0 of every incomplete key, and each stage behind one that ended at the limit."""
    ended = outcomes.where("status = 'token_limit'").select(*KEY, (F.col("stage") + 1).alias("stage"))
    later = ended.join(incomplete, list(KEY), "left_semi")
    return incomplete.select(*KEY, F.lit(0).cast("long").alias("stage")).unionByName(later).distinct()


def stage_pending(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Candidates that have not ended at the limit in this very stage."""
    return candidates.join(outcomes.where("status = 'token_limit'").select(*KEY, "stage"), [*KEY, "stage"], "left_anti")


def ready_stage(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stage, pending, fresh) of the stage to work at next: first escalations never tried, then any
    never tried, then any; the most work first, then the earliest stage. No row if nothing is pending."""
    tried = outcomes.select(*KEY, "stage", F.lit(1).alias("t"))
    work = pending.join(tried, [*KEY, "stage"], "left").groupBy("stage").agg(F.count("*").alias("pending"), F.count_if(F.col("t").isNull()).alias("fresh"))
    rank = F.when((F.col("fresh") > 0) & (F.col("stage") > 0), 0).when(F.col("fresh") > 0, 1).otherwise(2)
    size = F.when(rank < 2, F.col("fresh")).otherwise(F.col("pending"))
    return work.orderBy(rank, size.desc(), "stage").limit(1)


def progress(expected: DataFrame, success: DataFrame) -> DataFrame:
    """(model_name, expected, completed, remaining) per model."""
    done = success.select(*KEY, F.lit(1).alias("done"))
    return (
        expected.select(*KEY).join(done, list(KEY), "left").groupBy("model_name")
        .agg(F.count("*").alias("expected"), F.count("done").alias("completed")).withColumn("remaining", F.col("expected") - F.col("completed"))
    )


def token_limit_rollup(outcomes: DataFrame, expected: DataFrame, stages: Sequence[int], *, geometric: bool = False, most: int = 262_144) -> DataFrame:
    """(level, cycle, stage, budget, token_limits): truncations by budget, by cycle and budget, and by stage.

    Planned budgets that none reached are there with 0."""
    spark = outcomes.sparkSession
    rows = outcomes.where("status = 'token_limit'").join(expected.select(*KEY), list(KEY), "left_semi")
    rows = rows.select("stage", stage_cycle(F.col("stage"), len(stages), geometric=geometric)[0].alias("cycle"), stage_budget(F.col("stage"), stages, geometric=geometric, most=most).alias("budget"))
    # one row per stage leaves the data; the levels are built from these
    by_stage = rows.groupBy("stage", "cycle", "budget").agg(F.count("*").alias("n"))
    planned = spark.range(1).select(F.explode(F.array(*(F.lit(int(b)).cast("long") for b in sorted(set(stages))))).alias("budget"))
    nothing = F.lit(None).cast("long")
    budget = planned.unionByName(by_stage.select("budget")).distinct().join(by_stage.groupBy("budget").agg(F.sum("n").alias("n")), "budget", "left")
    cycles = by_stage.select("cycle").distinct().withColumn("budget", F.explode(F.array(*(F.lit(int(b)).cast("long") for b in sorted(set(stages))))))
    cycle = cycles.unionByName(by_stage.select("cycle", "budget")).distinct().join(by_stage.groupBy("cycle", "budget").agg(F.sum("n").alias("n")), ["cycle", "budget"], "left")
    shape = lambda df, level, c, s: df.select(F.lit(level).alias("level"), c.alias("cycle"), s.alias("stage"), "budget", F.coalesce("n", F.lit(0).cast("long")).alias("token_limits"))
    return shape(budget, "budget", nothing, nothing).unionByName(shape(cycle, "cycle", F.col("cycle"), nothing)).unionByName(shape(by_stage, "stage", F.col("cycle"), F.col("stage")))


def sharded(jobs: DataFrame, workers: int, *, by: str = "model_name", order: Sequence[str] = ("subset", "id")) -> DataFrame:
    """`jobs` with job_index from 0 per group, shard_index (round robin) and shard_count, at most `workers`.

    Jobs are numbered over range partitions, so that no task holds all jobs of a model."""
    numbered, sizes = group_ordinal(jobs, [by], order, "job_index")
    count = F.least(F.lit(workers).cast("long"), F.col("n"))
    return join_null_safe(numbered, sizes, [by]).withColumn("shard_count", count).withColumn("shard_index", F.pmod("job_index", "shard_count")).drop("n")


def interleaved(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(place, model_name, shard_index, jobs): the shards of all models in turn, in the models' order of `positions`."""
    per = shards.groupBy("model_name", "shard_index").agg(F.count("*").alias("jobs")).join(F.broadcast(positions.select("model_name", "position")), "model_name")
    return per.withColumn("place", (F.row_number().over(Window.orderBy("shard_index", "position")) - 1).cast("long")).select("place", "model_name", "shard_index", "jobs")


def worker_counters(lines: DataFrame) -> DataFrame:
    """(model_name, successes, token_limits, transient_failures, permanent_failures, failed) of lines of a log; a model with any failure has failed."""
    counts = {"successes": "success", "token_limits": "token_limit", "transient_failures": "transient_failure", "permanent_failures": "permanent_failure"}
    per = lines.groupBy("model_name").agg(*(F.count_if(F.coalesce(F.col("status") == v, F.lit(False))).alias(k) for k, v in counts.items()))
    return per.withColumn("failed", F.col("transient_failures") + F.col("permanent_failures") > 0)
