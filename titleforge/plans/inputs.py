"""What the registered queries read: the benchmark, the models, the log's current state; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.operators import state
from titleforge.operators.tables import latest_row
from titleforge.session import table
from titleforge.sources.readers import expand_config

STAGES = (4096, 8192, 16384)


def sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark's two sources with equal columns: the titles, latest delivery, and the anchors, valid rows only."""
    titles = latest_row(table(spark, sf, "titles").select("title_id", "loaded_at", "subset", "id", "title", "gold_label", "split"), ["title_id"], "loaded_at")
    anchors = table(spark, sf, "anchor_titles").select("subset", "id", "title", "gold_label", F.lit("anchor").alias("split"))
    valid = F.col("title").isNotNull() & F.col("gold_label").isin("Yes", "No")
    return titles.select("subset", "id", "title", "gold_label", "split").where(valid), anchors.where(valid)


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """(subset, id, title, gold_label, split) of every valid title, latest delivery, and of the anchors."""
    titles, anchors = sources(spark, sf)
    return titles.unionByName(anchors)


def models(spark: SparkSession, sf: str) -> DataFrame:
    return expand_config(table(spark, sf, "model_config"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "prediction_log")


def plan_signature(logged: DataFrame) -> Column:
    """The signature of the plan most lines have: one value, read by a small aggregation."""
    row = logged.groupBy("token_plan_signature").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token_plan_signature").first()
    return F.lit(row.token_plan_signature if row else None)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The latest success of every key of the benchmark."""
    logged = log(spark, sf)
    return state.latest_success(logged, state.current_signatures(logged), benchmark(spark, sf))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The last status of every key and stage of the current plan."""
    logged = log(spark, sf)
    return state.stage_outcomes(logged, state.current_signatures(logged), plan_signature(logged), benchmark(spark, sf))


def expected(spark: SparkSession, sf: str) -> DataFrame:
    return state.expected_keys(benchmark(spark, sf), models(spark, sf))


# The same in SQL: common table expressions, each query takes those up to the last it needs.
CTE = {
    "bench": """bench AS (
    SELECT subset, id, title, gold_label, split FROM (
        SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY loaded_at DESC) AS rn FROM titles
    ) WHERE rn = 1 AND title IS NOT NULL AND gold_label IN ('Yes', 'No')
    UNION ALL SELECT subset, id, title, gold_label, 'anchor' FROM anchor_titles
)""",
    "sig": """sig AS (
    SELECT model_name, condition_signature FROM (
        SELECT model_name, condition_signature, row_number() OVER (PARTITION BY model_name ORDER BY count(*) DESC, condition_signature) AS rn
        FROM prediction_log GROUP BY 1, 2
    ) WHERE rn = 1
)""",
    "pred": """pred AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT l.model_name, l.subset, l.id, l.line_no, b.title, b.gold_label, l.pred_label, l.confidence, l.format_valid, l.thinking_observed, l.latency_ms, l.reasoning_tokens,
            row_number() OVER (PARTITION BY l.model_name, l.subset, l.id ORDER BY l.line_no DESC) AS rn
        FROM prediction_log l JOIN sig USING (model_name, condition_signature) JOIN bench b ON l.subset = b.subset AND l.id = b.id AND l.title = b.title
        WHERE l.status = 'success' AND l.pred_label IN ('Yes', 'No')
    ) WHERE rn = 1
)""",
    "model": """model AS (SELECT m.name AS model_name FROM (SELECT unnest(model) AS m FROM model_config))""",
    "expected": """expected AS (SELECT DISTINCT model_name, subset, id, title, gold_label FROM model, bench)""",
    "outcome": """outcome AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT l.model_name, l.subset, l.id, coalesce(l.token_stage_index, 0) AS stage, l.status,
            row_number() OVER (PARTITION BY l.model_name, l.subset, l.id, coalesce(l.token_stage_index, 0) ORDER BY l.line_no DESC) AS rn
        FROM prediction_log l JOIN sig USING (model_name, condition_signature) JOIN bench b ON l.subset = b.subset AND l.id = b.id AND l.title = b.title
        WHERE l.token_plan_signature = (SELECT token_plan_signature FROM prediction_log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND coalesce(l.token_stage_index, 0) >= 0
    ) WHERE rn = 1
)""",
    "limited": "limited AS (SELECT model_name, subset, id, stage FROM outcome WHERE status = 'token_limit')",
    "open": "open AS (SELECT model_name, subset, id FROM expected e WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.model_name = e.model_name AND p.subset = e.subset AND p.id = e.id))",
    "candidate": """candidate AS (
    SELECT model_name, subset, id, 0 AS stage FROM open
    UNION SELECT l.model_name, l.subset, l.id, l.stage + 1 FROM limited l JOIN open USING (model_name, subset, id)
)""",
    "pending": "pending AS (SELECT * FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM limited l WHERE l.model_name = c.model_name AND l.subset = c.subset AND l.id = c.id AND l.stage = c.stage))",
}


def sql(upto: str, body: str, more: str = "") -> str:
    """`body` behind all common table expressions up to `upto`, and more."""
    names = list(CTE)
    parts = [CTE[n] for n in names[: names.index(upto) + 1]] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + body
