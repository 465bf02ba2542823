"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleforge.functions import control, text
from titleforge.operators import estimators, features, metrics, paired, resample, state, tables
from titleforge.plans import inputs, pipelines
from titleforge.plans.inputs import STAGES, sql
from titleforge.session import cut_lineage, shared_folder, table
from titleforge.sources import readers, recovering_csv, sinks
from titleforge.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles at six places, as sums in another order differ behind them."""
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double" and (not names or c in names)})


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_LINES = rf"""
WITH heads AS (
    SELECT file_id, list_transform(string_split(ltrim(min(header), chr(65279)), ','), lambda x: trim(x)) AS names FROM csv_files GROUP BY file_id
),
split AS (
    SELECT row_id, names, regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') AS quoted,
        list_transform(regexp_extract_all(raw || ',', '{_FIELD},', 1), lambda f: regexp_replace(
            CASE WHEN f LIKE '"%' THEN replace(substring(f, 2, length(f) - 2), '""', '"') ELSE f END, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS fields
    FROM csv_lines LEFT JOIN heads USING (file_id)
),
named AS (
    SELECT row_id, quoted, len(fields) AS n, len(names) AS m,
        fields[list_position(names, 'title')] AS title, fields[list_position(names, 'label')] AS label, fields[list_position(names, 'account')] AS account
    FROM split
),
judged AS (
    SELECT row_id, title, label, account, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> m THEN 'columns'
        WHEN title IN ('', 'NA', 'null', 'nan') OR label NOT IN ('Yes', 'No') THEN 'value' END AS reason
    FROM named
)
"""


@query(_LINES + "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return recovering_csv.failed_lines(table(spark, sf, "csv_lines"), table(spark, sf, "csv_files"))


@query(_LINES + "SELECT row_id, title, label, account FROM judged WHERE reason IS NULL")
def p7_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return recovering_csv.loaded_lines(table(spark, sf, "csv_lines"), table(spark, sf, "csv_files"))


@query(SQL["p7_loaded"])
def p7_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """The valid rows once more, now from whole files: the lines put together, read in ranges and resumed behind each fault."""
    rows = recovering_csv.recovered_rows(table(spark, sf, "csv_lines"), table(spark, sf, "csv_files"))
    return rows.where("reason is null").select("row_id", "title", "label", "account")



# Metrics

_RATES = """
    coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, (r + s) / 2 AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_yes, r AS recall_yes,
    f1y AS f1_yes, (f1y + f1n) / 2 AS macro_f1, s AS specificity,
    coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
"""
_COUNTS = """
counts AS (
    SELECT model_name, subset, CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE gold_label = 'Yes' AND pred_label = 'Yes') AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE gold_label = 'No' AND pred_label = 'Yes') AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE gold_label = 'No' AND pred_label = 'No') AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE gold_label = 'Yes' AND pred_label = 'No') AS DOUBLE) AS fn,
        avg(CAST(format_valid AS INTEGER)) AS fv, avg(CAST(thinking_observed AS INTEGER)) AS th, avg(latency_ms) AS lat, avg(reasoning_tokens) AS rea
    FROM pred GROUP BY 1, 2
),
parts AS (
    SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1y, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1n FROM counts
),
rates AS (SELECT *, """ + _RATES + " FROM parts)"
_INT = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n", "tp", "fp", "tn", "fn"))


@query(sql("pred", "SELECT model_name, subset, " + _INT + " FROM counts", _COUNTS.split("parts AS")[0].rstrip().rstrip(",")))
def confusion_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(inputs.predictions(spark, sf), ["model_name", "subset"])


@query(
    sql(
        "pred",
        "SELECT model_name, subset, " + _INT + ", round(fv, 6) AS format_valid_rate, round(th, 6) AS thinking_observed_rate, round(lat, 6) AS mean_latency_ms, round(rea, 6) AS mean_reasoning_tokens, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in metrics.RATES) + " FROM rates",
        _COUNTS,
    )
)
def point_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.point_metrics(inputs.predictions(spark, sf)))


@query(
    sql(
        "pred",
        "SELECT model_name, subset, round(CASE WHEN tp + fn = 0 THEN s WHEN tn + fp = 0 THEN r ELSE (r + s) / 2 END, 6) AS balanced_accuracy, "
        "round(CASE WHEN tp + fn + fp = 0 THEN f1n WHEN tn + fp + fn = 0 THEN f1y ELSE (f1y + f1n) / 2 END, 6) AS macro_f1 FROM parts",
        _COUNTS,
    )
)
def metrics_observed_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.point_metrics(inputs.predictions(spark, sf), policy="observed")
    return rounded(df.select("model_name", "subset", "balanced_accuracy", "macro_f1"))


_PROB = "CASE pred_label WHEN 'Yes' THEN confidence WHEN 'No' THEN CAST(1 AS DOUBLE) - confidence ELSE 0.5 END"
_EDGES = ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in metrics.EDGES)
_BINS = f"""
scored AS (SELECT model_name, subset, {_PROB} AS p, CAST(gold_label = 'Yes' AS INTEGER) AS y FROM pred),
binned AS (SELECT *, least(len(list_filter([{_EDGES}], lambda e: e <= p)) - 1, 9) AS bin FROM scored WHERE p BETWEEN 0 AND 1),
bins AS (SELECT model_name, subset, CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM binned GROUP BY 1, 2, 3)
"""


@query(sql("pred", "SELECT model_name, subset, bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins", _BINS))
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration_bins(inputs.predictions(spark, sf)))


@query(
    sql(
        "pred",
        "SELECT model_name, subset, round(sum(n * abs(mean_p - mean_y)) / any_value(total), 6) AS ece FROM bins JOIN (SELECT model_name, subset, count(*) AS total FROM pred GROUP BY 1, 2) USING (model_name, subset) GROUP BY 1, 2",
        _BINS,
    )
)
def calibration_ece(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration_error(inputs.predictions(spark, sf)))


_RANKS = f"""
ranked AS (
    SELECT model_name, subset, y, rank() OVER (PARTITION BY model_name, subset ORDER BY p) + (count(*) OVER (PARTITION BY model_name, subset, p) - 1) / 2.0 AS r
    FROM (SELECT model_name, subset, {_PROB} AS p, CAST(gold_label = 'Yes' AS INTEGER) AS y FROM pred)
),
sums AS (SELECT model_name, subset, CAST(sum(r) FILTER (WHERE y = 1) AS DOUBLE) AS r, CAST(sum(y) AS DOUBLE) AS a, CAST(count(*) - sum(y) AS DOUBLE) AS b FROM ranked GROUP BY 1, 2)
"""


@query(sql("pred", "SELECT model_name, subset, round(CASE WHEN a * b > 0 THEN (r - a * (a + 1) / 2) / (a * b) END, 6) AS auroc FROM sums", _RANKS))
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.auroc(inputs.predictions(spark, sf)))


_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in metrics.RATES)


@query(
    sql(
        "pred",
        "SELECT model_name, subset, " + _INT.replace("CAST(", "CAST(rates.") + ", round(fv, 6) AS format_valid_rate, round(th, 6) AS thinking_observed_rate, round(lat, 6) AS mean_latency_ms, round(rea, 6) AS mean_reasoning_tokens, " + _ROUND + ", "
        "round(ece, 6) AS ece, round(CASE WHEN a * b > 0 THEN (sums.r - a * (a + 1) / 2) / (a * b) END, 6) AS auroc FROM rates JOIN sums USING (model_name, subset) "
        "JOIN (SELECT model_name, subset, sum(bins.n * abs(mean_p - mean_y)) / any_value(counts.n) AS ece FROM bins JOIN counts USING (model_name, subset) GROUP BY 1, 2) USING (model_name, subset)",
        ",".join((_COUNTS, _BINS.strip().replace("scored AS", "binnable AS").replace("FROM scored", "FROM binnable"), _RANKS)),
    )
)
def evaluation_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.evaluation(inputs.predictions(spark, sf)))


@query()
def llm_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The whole result table of the log: all metrics with their bootstrap intervals."""
    kept = cut_lineage(inputs.predictions(spark, sf))
    return rounded(metrics.evaluation(kept).join(resample.bootstrap(kept), ["model_name", "subset"], "left"))


@query(
    sql(
        "pred",
        """SELECT subset, model_a, model_b, shared_n, model_a_only_correct, model_b_only_correct, round(p, 6) AS exact_mcnemar_p,
            round(max(least(1, (m - rn + 1) * p)) OVER (PARTITION BY subset ORDER BY p, rn ROWS UNBOUNDED PRECEDING), 6) AS holm_adjusted_p
        FROM (SELECT *, count(*) OVER (PARTITION BY subset) AS m, row_number() OVER (PARTITION BY subset ORDER BY p) AS rn FROM tested)""",
        """pairs AS (
    SELECT a.subset, a.model_name AS model_a, b.model_name AS model_b, count(*) AS shared_n,
        count(*) FILTER (WHERE a.pred_label = a.gold_label AND b.pred_label <> b.gold_label) AS model_a_only_correct,
        count(*) FILTER (WHERE a.pred_label <> a.gold_label AND b.pred_label = b.gold_label) AS model_b_only_correct
    FROM pred a JOIN pred b ON a.subset = b.subset AND a.id = b.id AND a.model_name < b.model_name GROUP BY 1, 2, 3
),
tested AS (
    SELECT *, CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END AS p
    FROM (SELECT *, model_a_only_correct + model_b_only_correct AS n, least(model_a_only_correct, model_b_only_correct) AS k FROM pairs)
)""",
    )
)
def pairwise_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paired.pairwise_mcnemar(inputs.predictions(spark, sf)))


_GATHER = """
numbered AS (SELECT model_name, subset, gold_label, pred_label, row_number() OVER (PARTITION BY model_name, subset ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY model_name, subset) AS size FROM pred),
drawn AS (
    SELECT model_name, subset, round, (((round + 1) * 7919 + pos * (round * 2 + 104729) + ((pos * pos) % 1009) * 31) % size) AS pos
    FROM numbered, (SELECT unnest(range(0, 1000)) AS round) WHERE size > 1
),
cells AS (
    SELECT model_name, subset, round, CAST(count(*) FILTER (WHERE gold_label = 'Yes' AND pred_label = 'Yes') AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE gold_label = 'No' AND pred_label = 'Yes') AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE gold_label = 'No' AND pred_label = 'No') AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE gold_label = 'Yes' AND pred_label = 'No') AS DOUBLE) AS fn
    FROM drawn JOIN numbered USING (model_name, subset, pos) GROUP BY 1, 2, 3
),
values_ AS (
    SELECT model_name, subset, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_yes,
        (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1 FROM cells
)
"""


@query(
    sql(
        "pred",
        "SELECT model_name, subset, " + ", ".join(f"round(quantile_cont({m}, CAST({q} AS DOUBLE)), 6) AS {m}_ci_{e}" for m in resample.METRICS for e, q in (("low", 0.025), ("high", 0.975))) + " FROM values_ GROUP BY 1, 2",
        _GATHER,
    )
)
def bootstrap_gather(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.bootstrap_gather(cut_lineage(inputs.predictions(spark, sf))))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.bootstrap(inputs.predictions(spark, sf)))


@query()
def bootstrap_ci_numpy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resample.bootstrap_numpy(inputs.predictions(spark, sf)))


# State of the log


@query(sql("expected", "SELECT * FROM expected"))
def expected_keys(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.expected(spark, sf)


@query(sql("pred", "SELECT model_name, subset, id, line_no, title, gold_label, pred_label, confidence, format_valid, thinking_observed, latency_ms, reasoning_tokens FROM pred"))
def latest_success(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.predictions(spark, sf)


@query(
    sql(
        "pred",
        "SELECT line_no, model_name, l.id, s.condition_signature IS NOT NULL AS signed, b.title IS NOT NULL AS current_title, l.status = 'success' AND l.pred_label IN ('Yes', 'No') AS succeeded "
        "FROM prediction_log l LEFT JOIN sig s USING (model_name, condition_signature) LEFT JOIN bench b ON l.subset = b.subset AND l.id = b.id AND l.title = b.title",
    )
)
def success_checkpoint_filter(spark: SparkSession, sf: str) -> DataFrame:
    logged = inputs.log(spark, sf)
    signed = state.current_signatures(logged).withColumn("signed", F.lit(True))
    known = inputs.benchmark(spark, sf).select("subset", "id", "title", F.lit(True).alias("current_title"))
    rows = logged.select("line_no", "model_name", "subset", "id", "title", "condition_signature", ((F.col("status") == "success") & F.col("pred_label").isin("Yes", "No")).alias("succeeded"))
    rows = rows.join(signed, ["model_name", "condition_signature"], "left").join(known, ["subset", "id", "title"], "left")
    return rows.select("line_no", "model_name", "id", F.coalesce("signed", F.lit(False)).alias("signed"), F.coalesce("current_title", F.lit(False)).alias("current_title"), "succeeded")


@query(sql("outcome", "SELECT model_name, subset, id, stage, status FROM outcome"))
def stage_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.outcomes(spark, sf)


@query(sql("open", "SELECT * FROM open"))
def open_keys(spark: SparkSession, sf: str) -> DataFrame:
    return state.incomplete_keys(inputs.expected(spark, sf), inputs.predictions(spark, sf))


@query(sql("expected", "SELECT model_name, subset, id FROM expected JOIN pred USING (model_name, subset, id)"))
def completed_keys(spark: SparkSession, sf: str) -> DataFrame:
    return state.completed_keys(inputs.expected(spark, sf), inputs.predictions(spark, sf))


@query(
    sql(
        "expected",
        "SELECT e.model_name, count(*) AS expected, count(p.id) AS completed, count(*) - count(p.id) AS remaining FROM expected e LEFT JOIN pred p ON e.model_name = p.model_name AND e.subset = p.subset AND e.id = p.id GROUP BY 1",
    )
)
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.progress(inputs.expected(spark, sf), inputs.predictions(spark, sf))


@query(
    sql(
        "open",
        """SELECT model_name, subset, id, coalesce(n, 0) AS stage FROM open LEFT JOIN (
            SELECT model_name, subset, id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model_name, subset, id ORDER BY stage) - 1 AS pos FROM limited) WHERE stage = pos GROUP BY 1, 2, 3
        ) USING (model_name, subset, id)""",
    )
)
def item_stage_pointer(spark: SparkSession, sf: str) -> DataFrame:
    return state.item_stage(inputs.outcomes(spark, sf), state.incomplete_keys(inputs.expected(spark, sf), inputs.predictions(spark, sf)))


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    done = cut_lineage(inputs.outcomes(spark, sf))
    return state.stage_candidates(cut_lineage(open_keys(spark, sf)), done), done


@query(sql("candidate", "SELECT model_name, subset, id, CAST(stage AS BIGINT) AS stage FROM candidate"))
def stage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)[0]


@query(sql("pending", "SELECT model_name, subset, id, CAST(stage AS BIGINT) AS stage FROM pending"))
def stage_pending(spark: SparkSession, sf: str) -> DataFrame:
    return state.stage_pending(*_candidates(spark, sf))


@query(
    sql(
        "pending",
        """SELECT CAST(stage AS BIGINT) AS stage, pending, fresh FROM (
            SELECT p.stage, count(*) AS pending, count(*) FILTER (WHERE o.id IS NULL) AS fresh
            FROM pending p LEFT JOIN outcome o ON p.model_name = o.model_name AND p.subset = o.subset AND p.id = o.id AND p.stage = o.stage GROUP BY 1
        ) ORDER BY CASE WHEN fresh > 0 AND stage > 0 THEN 0 WHEN fresh > 0 THEN 1 ELSE 2 END, CASE WHEN fresh > 0 THEN fresh ELSE pending END DESC, stage LIMIT 1""",
    )
)
def ready_stage_pick(spark: SparkSession, sf: str) -> DataFrame:
    candidates, done = _candidates(spark, sf)
    return state.ready_stage(state.stage_pending(candidates, done), done)


_BUDGET = "(CASE stage % 3 WHEN 0 THEN 4096 WHEN 1 THEN 8192 ELSE 16384 END)"


@query(
    sql(
        "limited",
        """SELECT 'budget' AS level, CAST(NULL AS BIGINT) AS cycle, CAST(NULL AS BIGINT) AS stage, CAST(b AS BIGINT) AS budget, count(budget) AS token_limits FROM planned LEFT JOIN hit ON b = budget GROUP BY b
        UNION ALL SELECT 'cycle', c, NULL, CAST(b AS BIGINT), count(budget) FROM (SELECT DISTINCT cycle AS c FROM hit), planned LEFT JOIN hit ON b = budget AND c = cycle GROUP BY b, c
        UNION ALL SELECT 'stage', cycle, stage, CAST(budget AS BIGINT), count(*) FROM hit GROUP BY cycle, stage, budget""",
        f"hit AS (SELECT CAST(stage AS BIGINT) AS stage, CAST(stage // 3 AS BIGINT) AS cycle, {_BUDGET} AS budget FROM limited JOIN expected USING (model_name, subset, id)), planned AS (SELECT unnest([4096, 8192, 16384]) AS b)",
    )
)
def token_limit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return state.token_limit_rollup(cut_lineage(inputs.outcomes(spark, sf)), inputs.expected(spark, sf), STAGES)


@query(
    "WITH s AS (SELECT line_no, CAST(coalesce(token_stage_index, 0) AS BIGINT) AS stage FROM prediction_log) SELECT line_no, CAST(" + _BUDGET + " AS BIGINT) AS cyclic, "
    "CASE WHEN stage < 3 THEN CAST(" + _BUDGET + " AS BIGINT) ELSE CAST(least(262144, 16384 * pow(2, stage - 2)) AS BIGINT) END AS geometric, CAST(stage // 3 AS BIGINT) AS cycle, CAST(stage % 3 AS BIGINT) AS place FROM s"
)
def stage_budget(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.coalesce(F.col("token_stage_index").cast("long"), F.lit(0).cast("long"))
    rows = inputs.log(spark, sf).select("line_no", stage.alias("stage"))
    cycle, place = control.stage_cycle(F.col("stage"), len(STAGES))
    return rows.select("line_no", control.stage_budget(F.col("stage"), STAGES).alias("cyclic"), control.stage_budget(F.col("stage"), STAGES, geometric=True).alias("geometric"), cycle.alias("cycle"), place.alias("place"))


_SHARDS = "shard AS (SELECT model_name, subset, id, row_number() OVER (PARTITION BY model_name ORDER BY subset, id) - 1 AS job_index, least(8, count(*) OVER (PARTITION BY model_name)) AS shard_count FROM open)"


@query(sql("open", "SELECT model_name, subset, id, job_index, shard_count, job_index % shard_count AS shard_index FROM shard", _SHARDS))
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return state.sharded(open_keys(spark, sf), 8)


@query(
    sql(
        "open",
        """SELECT row_number() OVER (ORDER BY s, position) - 1 AS place, model_name, s AS shard_index, jobs
        FROM (SELECT model_name, job_index % shard_count AS s, count(*) AS jobs FROM shard GROUP BY 1, 2) JOIN (SELECT model_name, row_number() OVER (ORDER BY model_name) AS position FROM model) USING (model_name)""",
        _SHARDS,
    )
)
def shard_interleave(spark: SparkSession, sf: str) -> DataFrame:
    positions = inputs.models(spark, sf).select("model_name", F.row_number().over(Window.orderBy("model_name")).alias("position"))
    return state.interleaved(state.sharded(open_keys(spark, sf), 8), positions)


# Relational operators over the benchmark


@query(sql("bench", "SELECT subset, id, title FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY id) AS rn FROM bench) WHERE rn <= 25"))
def head_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return tables.head_per_group(inputs.benchmark(spark, sf), 25, by="subset", order="id").select("subset", "id", "title")


_ORDINAL = "ordered AS (SELECT row_number() OVER (ORDER BY subset, id) AS ordinal, subset, title, count(*) OVER () AS n FROM bench)"


@query(sql("bench", "SELECT ordinal, format('row-{:04d}', ordinal) AS row_id, title FROM ordered", _ORDINAL))
def ordinal_ids(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.ordered_ordinal(inputs.benchmark(spark, sf).select("subset", "id", "title"), ["subset", "id"])
    return df.select("ordinal", tables.ordinal_id(F.lit("row"), F.col("ordinal")).alias("row_id"), "title")


@query(sql("bench", "SELECT ordinal, title, CASE WHEN ordinal <= n - n * 15 // 100 - n * 16 // 100 THEN 'train' WHEN ordinal <= n - n * 16 // 100 THEN 'dev' ELSE 'test' END AS split FROM ordered", _ORDINAL))
def positional_split(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.ordered_ordinal(inputs.benchmark(spark, sf).select("subset", "id", "title"), ["subset", "id"])
    n = df.count()
    return tables.positional_split(df, n * 15 // 100, n * 16 // 100).select("ordinal", "title", "split")


@query(sql("bench", "SELECT subset, count(*) AS n, count(DISTINCT title) AS titles FROM bench GROUP BY 1"))
def subset_union(spark: SparkSession, sf: str) -> DataFrame:
    first, second = inputs.sources(spark, sf)
    return first.unionByName(second).groupBy("subset").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))


@query(sql("bench", "SELECT DISTINCT subset, id FROM bench EXCEPT SELECT subset, id FROM prediction_log"))
def key_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.benchmark(spark, sf).select("subset", "id").distinct().join(inputs.log(spark, sf).select("subset", "id"), ["subset", "id"], "left_anti")


@query(sql("bench", "SELECT subset, id FROM bench INTERSECT SELECT subset, id FROM prediction_log"))
def key_set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.benchmark(spark, sf).select("subset", "id").distinct().join(inputs.log(spark, sf).select("subset", "id"), ["subset", "id"], "left_semi")


@query("SELECT gold_label AS label, count(*) AS n FROM titles WHERE gold_label IS NULL OR gold_label NOT IN ('Yes', 'No') GROUP BY 1")
def label_domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    return tables.label_violations(table(spark, sf, "titles"))


_STRIP = f"regexp_replace(title, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(f"SELECT title_id, title IS NULL AS missing, coalesce({_STRIP} = '', FALSE) AS blank FROM titles WHERE title IS NULL OR {_STRIP} = ''")
def empty_title_check(spark: SparkSession, sf: str) -> DataFrame:
    t = text.strip(F.col("title"))
    return table(spark, sf, "titles").where(t.isNull() | (t == "")).select("title_id", F.col("title").isNull().alias("missing"), F.coalesce(t == "", F.lit(False)).alias("blank"))


@query(f"SELECT title_id, {_STRIP} AS title, length(title) AS before, length({_STRIP}) AS after FROM titles WHERE title IS NOT NULL")
def unicode_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = text.strip(F.col("title"))
    return table(spark, sf, "titles").where("title is not null").select("title_id", t.alias("title"), F.length("title").cast("long").alias("before"), F.length(t).cast("long").alias("after"))


@query("SELECT title_id AS name, count(*) AS n FROM titles GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return tables.duplicate_names(table(spark, sf, "titles").withColumnRenamed("title_id", "name"), "name")


@query(
    "SELECT m.name AS model_name, m.full_name AS model_id, provider, base_url, coalesce(token_parameter, 'max_tokens') AS token_parameter, coalesce(supports_temperature, TRUE) AS supports_temperature, len(m.thinking_profiles) AS profiles "
    "FROM (SELECT *, unnest(model) AS m FROM model_config)"
)
def config_explode(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.models(spark, sf).select("model_name", "model_id", "provider", "base_url", "token_parameter", "supports_temperature", F.size("thinking_profiles").cast("long").alias("profiles"))


@query(sql("bench", "SELECT subset, id, sha256(CAST(json_object('gold_label', gold_label, 'id', id, 'subset', subset, 'title', title) AS VARCHAR)) AS signature FROM bench"))
def sha256_signature(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.benchmark(spark, sf).select("subset", "id", control.row_hash("subset", "id", "title", "gold_label").alias("signature"))


_POLICY = control.request_policy(stages=STAGES)
_POLICY_TEXT = json.dumps(_POLICY, sort_keys=True, separators=(",", ":"))
_PROFILES = (
    "CASE WHEN len(m.thinking_profiles) > 0 THEN m.thinking_profiles WHEN lower(provider) = 'deepseek' OR contains(lower(base_url), 'api.deepseek.com') THEN ['deepseek_thinking'] "
    "WHEN (lower(provider) = 'siliconflow' OR contains(lower(base_url), 'siliconflow')) AND contains(lower(m.full_name), 'glm-5.2') THEN ['thinking_object', 'siliconflow_enable'] "
    "WHEN (lower(provider) = 'siliconflow' OR contains(lower(base_url), 'siliconflow')) AND contains(lower(m.full_name), 'kimi-k2.6') THEN ['siliconflow_enable', 'thinking_object'] "
    "WHEN lower(provider) = 'siliconflow' OR contains(lower(base_url), 'siliconflow') THEN ['siliconflow_enable'] ELSE ['thinking_object'] END"
)


@query(
    "SELECT m.name AS model_name, sha256('{\"experiment\":\"e\",\"model\":' || to_json(m.full_name) || ',\"prompt\":\"Judge the title.\",\"provider\":' || to_json(provider) || "
    f"',\"shared_request_policy\":{_POLICY_TEXT},\"thinking_profiles\":' || to_json({_PROFILES}) || '}}') AS condition_signature FROM (SELECT *, unnest(model) AS m FROM model_config)"
)
def model_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """The signature of each configured model: what binds results to prompt, model and settings."""
    rows = inputs.models(spark, sf).collect()  # the configuration, one row per model
    configs = [{"name": r.model_name, "model": r.model_id, "provider": r.provider, "thinking_profiles": r.thinking_profiles} for r in rows]
    return state.configured_signatures(spark, control.condition_signatures(configs, "Judge the title.", _POLICY, "e"))


@query("SELECT model_name, " + ", ".join(f"count(*) FILTER (WHERE status = '{v}') AS {k}" for k, v in (("successes", "success"), ("token_limits", "token_limit"), ("transient_failures", "transient_failure"), ("permanent_failures", "permanent_failure"))) + ", count(*) FILTER (WHERE status IN ('transient_failure', 'permanent_failure')) > 0 AS failed FROM prediction_log GROUP BY 1")
def worker_counters(spark: SparkSession, sf: str) -> DataFrame:
    return state.worker_counters(inputs.log(spark, sf))


@query(
    sql(
        "expected",
        "SELECT (SELECT count(*) FROM bench) AS titles, count(*) AS expected, count(p.id) AS completed, count(*) - count(p.id) AS remaining FROM expected e LEFT JOIN pred p ON e.model_name = p.model_name AND e.subset = p.subset AND e.id = p.id",
    )
)
def run_preview(spark: SparkSession, sf: str) -> DataFrame:
    logged = inputs.log(spark, sf)
    return pipelines.preview(logged, inputs.benchmark(spark, sf), inputs.models(spark, sf), state.current_signatures(logged))


@query(sql("bench", "SELECT row_number() OVER (ORDER BY subset, id) AS ordinal, format('read-{:04d}', row_number() OVER (ORDER BY subset, id)) AS id, 'read' AS subset, title, gold_label FROM bench WHERE " + f"regexp_replace(title, '^{_SPACE}+|{_SPACE}+$', '', 'g') = title"))
def labelled_file(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark written as a labelled CSV file and read back, with its ordinals and ids."""
    rows = inputs.benchmark(spark, sf).where(text.strip(F.col("title")) == F.col("title"))
    path = f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}.csv"
    rows.repartitionByRange(1, "subset", "id").sortWithinPartitions("subset", "id").select("title", F.col("gold_label").alias("label"), "split").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.labelled_csv(spark, path, "read")


@query("SELECT model_name, subset, id, title, status, pred_label, raw_response, confidence, format_valid, token_stage_index, total_tokens, http_status FROM prediction_log")
def log_file(spark: SparkSession, sf: str) -> DataFrame:
    """The prediction log appended to a JSONL log and read back, with the schema of a log."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    sinks.append_jsonl(inputs.log(spark, sf).drop("line_no"), path)
    names = ("model_name", "subset", "id", "title", "status", "pred_label", "raw_response", "confidence", "format_valid", "token_stage_index", "total_tokens", "http_status")
    return readers.jsonl(spark, path)[0].select(*names)


@query("SELECT line_no, coalesce(latency_ms / 1000 >= 60, FALSE) AS timed_out FROM prediction_log")
def wall_clock(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).select("line_no", F.coalesce(control.timed_out(F.col("latency_ms") / 1000, 60.0), F.lit(False)).alias("timed_out"))


# Text and responses

_RULE = text.KeywordRule()
_SCORE = (
    f"CASE WHEN regexp_matches(title, '{_RULE.negative}') THEN 0.1 WHEN regexp_matches(title, '{_RULE.question}') AND NOT regexp_matches(title, '{_RULE.question_override}') THEN 0.25 "
    f"WHEN regexp_matches(title, '{_RULE.high_risk}') THEN 0.9 WHEN regexp_matches(title, '{_RULE.remedy}') AND regexp_matches(title, '{_RULE.claim}') THEN 0.75 ELSE 0.3 END"
)


@query(sql("bench", f"SELECT subset, id, CASE WHEN s >= 0.5 THEN 'Yes' ELSE 'No' END AS label, CAST(s AS DOUBLE) AS score FROM (SELECT subset, id, {_SCORE} AS s FROM bench)"))
def keyword_rule(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.benchmark(spark, sf).select("subset", "id", _RULE.predict(F.col("title")).alias("r"))
    return df.select("subset", "id", "r.label", F.col("r.score").cast("double").alias("score"))


@query(
    sql(
        "bench",
        "SELECT subset, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE gold_label = '{g}' AND label = '{p}') AS {c}" for c, g, p in (("tp", "Yes", "Yes"), ("fp", "No", "Yes"), ("tn", "No", "No"), ("fn", "Yes", "No"))) + " FROM ruled GROUP BY 1",
        f"ruled AS (SELECT subset, gold_label, CASE WHEN {_SCORE} >= 0.5 THEN 'Yes' ELSE 'No' END AS label FROM bench)",
    )
)
def keyword_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.benchmark(spark, sf).withColumn("pred_label", _RULE.predict(F.col("title"))["label"])
    return metrics.confusion(df, ["subset"])


_FENCE = f"regexp_replace(regexp_replace(regexp_replace(coalesce(raw_response, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^```(?:json)?{_SPACE}*', '', 'i'), '{_SPACE}*```$', '')"
_WORD = r"lower(regexp_extract(t, '(?i)(^|[^\p{L}\p{N}_])(yes|no)($|[^\p{L}\p{N}_])', 2))"
_RESCUE = f"CASE {_WORD} WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE '' END"
_READ = f"""
WITH cleaned AS (SELECT line_no, {_FENCE} AS t FROM prediction_log),
located AS (SELECT *, regexp_extract(t, '(?s)\\{{.*\\}}', 0) AS body FROM cleaned),
checked AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN CAST(body AS JSON) END AS j FROM located),
fields AS (
    SELECT *, CASE lower(trim(json_extract_string(j, '$.label'))) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END AS l, json_type(j, '$.confidence') AS kind, json_extract_string(j, '$.confidence') AS c FROM checked
),
read AS (
    SELECT *, CASE WHEN kind IS NULL THEN 0.5 WHEN kind = 'NULL' THEN NULL WHEN c = 'true' THEN 1 WHEN c = 'false' THEN 0 WHEN TRY_CAST(trim(c) AS DOUBLE) IS NOT NULL THEN least(1, greatest(0, TRY_CAST(trim(c) AS DOUBLE))) END AS conf FROM fields
)
"""


@query(
    _READ + f"""SELECT line_no, CASE WHEN ok THEN l ELSE {_RESCUE} END AS label, CASE WHEN ok THEN trim(coalesce(json_extract_string(j, '$.explanation'), '')) ELSE substring(t, 1, 200) END AS explanation,
    CAST(CASE WHEN ok THEN conf ELSE 0.5 END AS DOUBLE) AS confidence, ok AS format_valid FROM (SELECT *, j IS NOT NULL AND l IS NOT NULL AND conf IS NOT NULL AS ok FROM read)"""
)
def parse_response(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).select("line_no", text.parse_response(F.col("raw_response")).alias("r")).select("line_no", "r.*")


@query()
def parse_response_exact(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).select("line_no", text.parse_response_exact("raw_response").alias("r")).select("line_no", "r.*")


@query(_READ.split("checked AS")[0].rstrip().rstrip(",") + " SELECT line_no, t AS bare, body FROM located")
def strip_fence(spark: SparkSession, sf: str) -> DataFrame:
    bare = text.strip_fence(F.coalesce("raw_response", F.lit("")))
    return inputs.log(spark, sf).select("line_no", bare.alias("bare"), text.outer_object(bare).alias("body"))


@query(f"WITH c AS (SELECT line_no, {_FENCE} AS t FROM prediction_log) SELECT line_no, {_RESCUE} AS label FROM c")
def label_rescue(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).select("line_no", text.rescue_label(text.strip_fence(F.coalesce("raw_response", F.lit("")))).alias("label"))


@query("SELECT line_no, CASE WHEN confidence IS NULL THEN NULL WHEN isnan(confidence) THEN 0 ELSE least(1, greatest(0, confidence)) END AS confidence, CAST(round(" + _PROB + ", 6) AS DOUBLE) AS probability_yes FROM prediction_log")
def clamp_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.probability_yes(F.col("pred_label"), F.col("confidence"))
    return inputs.log(spark, sf).select("line_no", text.clamp_confidence(F.col("confidence").cast("string")).alias("confidence"), F.round(p, 6).alias("probability_yes"))


@query(sql("bench", "SELECT subset, id, 'Article title: ' || title || chr(10) || 'Judge the title now and return JSON only.' AS prompt, 2 AS messages FROM bench"))
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    prompt = text.user_prompt(F.col("title"))
    return inputs.benchmark(spark, sf).select("subset", "id", prompt.alias("prompt"), F.size(text.messages(F.lit("Judge the title."), prompt)).alias("messages"))


_BODY = (
    "'{\"model\":' || to_json(full_name) || ',\"messages\":[{\"role\":\"system\",\"content\":\"Judge the title.\"},{\"role\":\"user\",\"content\":' || to_json('Article title: ' || title || chr(10) || 'Judge the title now and return JSON only.') || "
    "'}],\"stream\":true,\"stream_options\":{\"include_usage\":true},\"temperature\":0.6,\"top_p\":0.95,\"frequency_penalty\":0.5,\"reasoning_effort\":\"high\",\"response_format\":{\"type\":\"json_object\"},\"' || parameter || '\":4096,\"extra_body\":' || "
    "CASE profile WHEN 'siliconflow_enable' THEN '{\"enable_thinking\":true,\"thinking_budget\":1024}' ELSE '{\"thinking\":{\"type\":\"enabled\"}}' END || '}'"
)


@query(
    sql(
        "expected",
        f"SELECT model_name, subset, id, {_BODY} AS body FROM expected JOIN requested USING (model_name)",
        f"requested AS (SELECT m.name AS model_name, m.full_name, coalesce(token_parameter, 'max_tokens') AS parameter, coalesce(list_filter(m.thinking_profiles, lambda x: x IN {tuple(control.SYNTAX)})[1], ({_PROFILES.replace("len(m.thinking_profiles) > 0", "FALSE")})[1]) AS profile FROM (SELECT *, unnest(model) AS m FROM model_config))",
    )
)
def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies of all questions, with the first profile of the configuration that has a known syntax, else the one inferred."""
    named = F.get(F.filter("thinking_profiles", lambda x: x.isin(*control.SYNTAX)), F.lit(0))
    profile = F.coalesce(named, control.thinking_profiles(F.col("provider"), F.col("model_id"), F.col("base_url"))[0])
    keys = inputs.expected(spark, sf).join(inputs.models(spark, sf), "model_name")
    prompts = text.messages(F.lit("Judge the title."), text.user_prompt(F.col("title")))
    body = control.request_body(F.col("model_id"), prompts, F.col("token_parameter"), F.lit(STAGES[0]), profile)
    return keys.select("model_name", "subset", "id", body.alias("body"))


# Requests

_LIMIT = "(lower(trim(coalesce(finish_reason, ''))) IN ('length', 'max_tokens', 'max_output_tokens', 'token_limit') OR (trim(coalesce(finish_reason, '')) = '' AND coalesce(completion_tokens, 0) >= token_budget))"


@query(f"SELECT line_no, {_LIMIT} AS token_limit FROM prediction_log")
def token_limit_detect(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).select("line_no", control.hit_token_limit(F.col("finish_reason"), F.col("completion_tokens"), F.col("token_budget")).alias("token_limit"))


@query(f"SELECT line_no, CASE WHEN {_LIMIT} THEN 'token_limit' WHEN pred_label IN ('Yes', 'No') THEN 'valid_response' ELSE 'invalid_response' END AS attempt_status FROM prediction_log")
def attempt_status(spark: SparkSession, sf: str) -> DataFrame:
    limit = control.hit_token_limit(F.col("finish_reason"), F.col("completion_tokens"), F.col("token_budget"))
    return inputs.log(spark, sf).select("line_no", control.attempt_status(limit, F.col("pred_label")).alias("attempt_status"))


def _terms(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(m, '{n}')" for n in names) + ")"


@query(
    f"""SELECT line_no, CASE WHEN coalesce(http_status = 402, FALSE) OR {_terms(control.BALANCE_TERMS)} THEN 'balance_exhausted' WHEN http_status IN {control.RETRYABLE} THEN 'transient'
    WHEN http_status IS NULL AND {_terms(control.NETWORK_TERMS)} THEN 'transient' WHEN http_status IN (400, 422) THEN 'invalid_parameters' ELSE 'permanent' END AS error_class
    FROM (SELECT line_no, http_status, lower(coalesce(error, '')) AS m FROM prediction_log WHERE error_kind IS NOT NULL)"""
)
def error_class(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).where("error_kind is not null").select("line_no", control.error_class(F.col("http_status"), F.col("error")).alias("error_class"))


@query("SELECT line_no, least(60, 2 * pow(2, api_attempts - 1)) AS delay FROM prediction_log WHERE api_attempts IS NOT NULL")
def retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.log(spark, sf).where("api_attempts is not null").select("line_no", control.retry_delay(F.col("api_attempts") - 1, F.lit(None).cast("string")).alias("delay"))


@query(
    "SELECT model_name, array_to_string(CASE WHEN lower(provider) = 'deepseek' OR contains(lower(base_url), 'api.deepseek.com') THEN ['deepseek_thinking'] "
    "WHEN lower(provider) = 'siliconflow' OR contains(lower(base_url), 'siliconflow') THEN ['siliconflow_enable'] ELSE ['thinking_object'] END, ',') AS profiles "
    "FROM (SELECT provider, base_url, unnest(model).name AS model_name FROM model_config)"
)
def thinking_profile(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.models(spark, sf).select("model_name", F.array_join(control.thinking_profiles(F.col("provider"), F.col("model_id"), F.col("base_url")), ",").alias("profiles"))


@query(
    "SELECT line_no, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, CAST(coalesce(reasoning_tokens, 0) AS BIGINT) AS reasoning_tokens, "
    "coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS total_tokens, round(latency_ms, 2) AS latency_ms FROM prediction_log"
)
def usage_normalised(spark: SparkSession, sf: str) -> DataFrame:
    u = control.usage(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("reasoning_tokens"), F.col("total_tokens"))
    return inputs.log(spark, sf).select("line_no", u.alias("u"), control.elapsed_ms(F.col("latency_ms") / 1000).alias("latency_ms")).select("line_no", "u.*", "latency_ms")


# Features and models

_LOW = f"lower(regexp_replace(title, '{_SPACE}{_SPACE}+', ' ', 'g'))"
_GRAMS = f"""
train AS (SELECT id, {_LOW} AS t, gold_label FROM bench WHERE split = 'train'),
size AS (SELECT count(*) AS n FROM train),
places AS (SELECT id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM train, (VALUES (2), (3), (4), (5)) AS sizes(k)),
tf AS (SELECT id, substring(t, CAST(i AS INTEGER), k) AS gram, count(*) AS tf FROM places GROUP BY 1, 2),
df AS (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY 1),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY tf DESC, gram) - 1 AS INTEGER) AS index, * FROM (SELECT * FROM df WHERE df <= 0.98 * (SELECT n FROM size) ORDER BY tf DESC, gram LIMIT 80000)),
raw AS (SELECT id, index, gram, (1 + ln(tf.tf)) * (ln((1.0 + (SELECT n FROM size)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (gram)),
weights AS (SELECT id, index, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw),
sums AS (
    SELECT index, gram, sum(CASE WHEN gold_label = 'No' THEN weight ELSE 0 END) + 0.5 AS no, sum(CASE WHEN gold_label = 'Yes' THEN weight ELSE 0 END) + 0.5 AS yes
    FROM weights JOIN train USING (id) GROUP BY 1, 2
),
contrast AS (SELECT index, gram, (ln(no) - ln(sum(no) OVER ())) AS a, (ln(yes) - ln(sum(yes) OVER ())) AS b FROM sums)
"""


def _part(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return inputs.benchmark(spark, sf).where(F.col("split") == split).select("id", "title", "gold_label")


@query(sql("bench", "SELECT id, gram, tf FROM tf", _GRAMS))
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return features.term_frequencies(_part(spark, sf, "train"))


@query(sql("bench", "SELECT gram, df, tf FROM df", _GRAMS))
def df_tf(spark: SparkSession, sf: str) -> DataFrame:
    return features.document_frequencies(char_ngrams(spark, sf))


def _vocabulary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    tf, n = cut_lineage(char_ngrams(spark, sf)), _part(spark, sf, "train").count()
    return tf, features.vocabulary(features.document_frequencies(tf), n), n


@query(sql("bench", "SELECT index, gram, df, tf FROM vocab", _GRAMS))
def vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf)[1]


@query(sql("bench", "SELECT id, index, gram, round(weight, 6) AS weight FROM weights", _GRAMS))
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    tf, vocab, n = _vocabulary(spark, sf)
    return rounded(features.tfidf(tf, cut_lineage(vocab), n))


@query(sql("bench", "SELECT gold_label, count(*) AS n, round((SELECT count(*) FROM train) / (2.0 * count(*)), 6) AS weight FROM train GROUP BY 1", _GRAMS))
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.class_weights(_part(spark, sf, "train")))


def _nb_contrast(spark: SparkSession, sf: str, alpha: float = 0.5) -> tuple[DataFrame, estimators.Features]:
    """(index, feature, weight) of complement naive Bayes, all in tables."""
    data = estimators.prepare(_part(spark, sf, "train"))
    sums = estimators.complement_sums(data.rows).select("index", (F.col("no") + alpha).alias("no"), (F.col("yes") + alpha).alias("yes"))
    total = sums.agg(F.sum("no").alias("a"), F.sum("yes").alias("b")).first()
    weight = (F.log("yes") - F.log(F.lit(total.b))) - (F.log("no") - F.log(F.lit(total.a)))
    table_ = sums.select("index", weight.alias("weight"))
    return table_.join(data.vocab.select("index", F.col("gram").alias("feature")), "index"), data


@query(
    sql(
        "bench",
        "SELECT * FROM (SELECT 'char_tfidf_complement_nb' AS model_name, 'Yes' AS direction, CAST(row_number() OVER (ORDER BY w DESC, gram) AS INTEGER) AS rank, gram AS feature, w AS weight FROM (SELECT gram, round(b - a, 6) AS w FROM contrast)) WHERE rank <= 30 "
        "UNION ALL SELECT * FROM (SELECT 'char_tfidf_complement_nb', 'No', CAST(row_number() OVER (ORDER BY w, gram) AS INTEGER) AS rank, gram, w FROM (SELECT gram, round(b - a, 6) AS w FROM contrast)) WHERE rank <= 30",
        _GRAMS,
    )
)
def top_features_nb(spark: SparkSession, sf: str) -> DataFrame:
    weights, _ = _nb_contrast(spark, sf)
    return estimators.ranked_features(cut_lineage(weights.select("feature", F.round("weight", 6).alias("weight"))), "char_tfidf_complement_nb")


@query(
    sql(
        "bench",
        "SELECT id, round(sum(weight * (b - a)), 6) AS margin FROM weights JOIN contrast USING (index) GROUP BY 1",
        _GRAMS,
    )
)
def nb_scores(spark: SparkSession, sf: str) -> DataFrame:
    weights, data = _nb_contrast(spark, sf)
    scored = data.rows.select("id", "index", F.col("weight").alias("x")).join(F.broadcast(weights.select("index", "weight")), "index")
    return rounded(scored.groupBy("id").agg(F.sum(F.col("x") * F.col("weight")).alias("margin")))


def _fitted(spark: SparkSession, sf: str, name: str, value: float) -> tuple[estimators.Linear, DataFrame]:
    known = _part(spark, sf, "train").unionByName(_part(spark, sf, "dev"))
    model = estimators.make_estimator(name)(estimators.prepare(known), value)
    return model, model.predict(_part(spark, sf, "test"))


@query()
def lr_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fitted(spark, sf, "char_tfidf_logistic", 1.0)[1].select("id", "gold_label", "pred_label", "score_yes"))


@query()
def svm_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fitted(spark, sf, "char_tfidf_linear_svm", 0.25)[1].select("id", "gold_label", "pred_label", "score_yes"))


_KNOWN = _GRAMS.replace("split = 'train'", "split IN ('train', 'dev')")
_NB = _KNOWN.rstrip() + f""",
asked AS (SELECT id, gold_label, {_LOW} AS t FROM bench WHERE split = 'test'),
asked_places AS (SELECT id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM asked, (VALUES (2), (3), (4), (5)) AS sizes(k)),
asked_tf AS (SELECT id, substring(t, CAST(i AS INTEGER), k) AS gram, count(*) AS tf FROM asked_places GROUP BY 1, 2),
asked_raw AS (SELECT id, index, (1 + ln(asked_tf.tf)) * (ln((1.0 + (SELECT n FROM size)) / (1 + df)) + 1) AS w FROM asked_tf JOIN vocab USING (gram)),
asked_weights AS (SELECT id, index, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM asked_raw),
margins AS (SELECT id, sum(weight * (b - a)) AS f FROM asked_weights JOIN contrast USING (index) GROUP BY 1)
"""


@query(sql("bench", "SELECT id, gold_label, CASE WHEN coalesce(f, 0) > 0 THEN 'Yes' ELSE 'No' END AS pred_label, round(1 / (1 + exp(-coalesce(f, 0))), 6) AS score_yes FROM asked LEFT JOIN margins USING (id)", _NB))
def nb_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fitted(spark, sf, "char_tfidf_complement_nb", 0.5)[1].select("id", "gold_label", "pred_label", "score_yes"))


@query()
def model_selection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(estimators.selection(_part(spark, sf, "train"), _part(spark, sf, "dev")))


@query()
def ml_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword rule and all three families at their selected values on the test split: metrics with observed labels, AUROC and intervals."""
    parts = (_part(spark, sf, s).withColumn("ordinal", F.col("id")) for s in ("train", "dev", "test"))
    return rounded(pipelines.classify_splits(*parts)["ml_metrics"])


# Streaming


@query(SQL["latest_success"])
def stream_latest_success(spark: SparkSession, sf: str) -> DataFrame:
    logged = inputs.log(spark, sf)
    stream = replay.stream_table(spark, f"{sf}/prediction_log.parquet")
    return replay.latest_success(stream, cut_lineage(state.current_signatures(logged)), cut_lineage(inputs.benchmark(spark, sf)))


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Responses cut into deltas of seven characters, as a stream of chunks would bring them."""
    n = F.length("raw_response")
    rows = inputs.log(spark, sf).where(n > 0).select("line_no", "raw_response", "finish_reason", n.alias("n"))
    parts = rows.withColumn("seq", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 7).cast("int")))).withColumn("seq", F.col("seq").cast("long"))
    piece = F.substring(F.col("raw_response"), ((F.col("seq") - 1) * 7 + 1).cast("int"), F.lit(7))
    last = F.when(F.col("seq") * 7 >= F.col("n"), F.coalesce("finish_reason", F.lit(""))).otherwise("")
    return parts.select(F.col("line_no").alias("request"), "seq", piece.alias("content_delta"), F.lit("").alias("reasoning_delta"), last.alias("finish_reason"))


@query("SELECT line_no AS request, raw_response AS content, '' AS reasoning, coalesce(finish_reason, '') AS finish_reason, CAST(ceil(length(raw_response) / 7) AS BIGINT) AS chunks FROM prediction_log WHERE length(raw_response) > 0")
def stream_fold_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return replay.fold_deltas(_deltas(spark, sf))


@query(
    "SELECT line_no AS request, CAST(s AS BIGINT) AS seq, CAST(least(s * 7, length(raw_response)) AS INTEGER) AS length FROM (SELECT line_no, raw_response, unnest(range(10, CAST(ceil(length(raw_response) / 7) AS BIGINT) + 1, 10)) AS s FROM prediction_log WHERE length(raw_response) > 0) "
    "WHERE least(s * 7, length(raw_response)) >= s * 7 - 70 + 64"
)
def content_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return replay.content_checkpoints(_deltas(spark, sf))
