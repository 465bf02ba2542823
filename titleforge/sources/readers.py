"""Sources: labelled CSV files, JSONL logs with a torn tail, model configurations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.functions.control import profiles_of, thinking_profiles
from titleforge.functions.text import LABELS, strip
from titleforge.operators.tables import head_per_group, require_columns, with_ordinal

LOG_SCHEMA = (
    "timestamp string, experiment string, condition_signature string, token_plan_signature string, provider string, model_name string, model_id string, subset string, id string, title string, gold_label string, "
    "token_budget long, token_stage_index long, status string, pred_label string, explanation string, raw_response string, finish_reason string, thinking_profile string, error_kind string, error string, "
    "confidence double, latency_ms double, format_valid boolean, thinking_requested boolean, thinking_observed boolean, reasoning_chars long, prompt_tokens long, completion_tokens long, reasoning_tokens long, "
    "total_tokens long, api_attempts long, http_status int"
)


def labelled_csv(spark: SparkSession, path: str, subset: str, *, id_prefix: str | None = None, pandas_compat: bool = False) -> DataFrame:
    """A CSV file with title and label as (ordinal, id, subset, title, gold_label), ids in file order.

    Title and label are stripped of Unicode white space; a missing column, an empty title or another
    label than Yes and No raise. Other columns are not read. With pandas_compat a missing cell is the
    text `nan`, as in data frames cast to text."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    require_columns(raw, ("title", "label"), path)
    void = F.lit("nan") if pandas_compat else F.lit("")
    rows = with_ordinal(raw.select(*(F.coalesce(strip(F.col(c)), void).alias(c) for c in ("title", "label"))), "ordinal")
    bad = rows.where((F.col("title") == "") | ~F.col("label").isin(*LABELS)).select("title", "label").limit(10).collect()
    if any(r.title == "" for r in bad):
        raise ValueError(f"{path} contains an empty title")
    if bad:
        raise ValueError(f"{path} contains invalid labels: {sorted({r.label for r in bad})}")
    return rows.select("ordinal", F.format_string(f"{id_prefix or subset}-%04d", "ordinal").alias("id"), F.lit(subset).alias("subset"), "title", F.col("label").alias("gold_label"))


def evaluation_data(spark: SparkSession, core: str, other: str | None = None, *, most_per_subset: int = 0) -> DataFrame:
    """The core file as `core_all` and the other as `out_of_domain`, cut to their first rows if asked."""
    df = labelled_csv(spark, core, "core_all")
    if other:
        df = df.unionByName(labelled_csv(spark, other, "out_of_domain"))
    return head_per_group(df, most_per_subset, by="subset", order="ordinal") if most_per_subset > 0 else df


def jsonl(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(records with line_no, torn tail) of an append-only log.

    Blank lines are skipped. A line that does not parse is allowed only at the very end, where an
    interrupted writer may leave it; elsewhere it raises. The source is never rewritten."""
    lines = with_ordinal(spark.read.option("lineSep", "\n").text(path), "line_no").where(F.trim("value") != "")
    fields = T._parse_datatype_string(schema)
    parsed = lines.withColumn("r", F.from_json("value", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    broken = parsed.where("r._bad is not null").select("line_no", "value")
    last = lines.agg(F.max("line_no")).first()[0]
    if inside := broken.where(F.col("line_no") != last).select("line_no").limit(1).collect():
        raise ValueError(f"line {inside[0].line_no} of {path} does not parse")
    return parsed.where("r._bad is null").select("line_no", *(F.col(f"r.{f.name}").alias(f.name) for f in fields.fields)), broken


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files. Files of more than 2 GB: `local_digest`."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def local_digest(path: str | Path, block: int = 1 << 20) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() if not block else _blocks(f, block)


def _blocks(f: Any, block: int) -> str:
    h = hashlib.sha256()
    while part := f.read(block):
        h.update(part)
    return h.hexdigest()


def _flat(entry: Mapping[str, Any], shared: Mapping[str, Any]) -> dict[str, Any]:
    """One model of a configuration: own values before the provider's, then the defaults."""
    model = str(entry.get("full_name") or entry.get("model") or entry["name"])
    provider, url = str(shared.get("provider", "openai_compatible")), str(shared.get("base_url", "https://api.openai.com/v1"))
    return {
        "provider": provider,
        "protocol": str(shared.get("protocol", "openai")),
        "base_url": url,
        "api_key_env": str(shared.get("api_key_env") or ""),
        "name": str(entry.get("name", model)),
        "model": model,
        "token_parameter": str(shared.get("token_parameter", "max_tokens")),
        "supports_temperature": bool(shared.get("supports_temperature", True)),
        "extra_body": dict(entry.get("extra_body") or shared.get("extra_body") or {}),
        "thinking_profiles": list(entry.get("thinking_profiles") or profiles_of(provider, model, url)),
    }


def model_configs(source: str | Path | Sequence[Mapping[str, Any]] | Mapping[str, Any], names: str = "") -> list[dict[str, Any]]:
    """The models of a configuration file or value, nested by provider or flat, filtered by a comma
    list of display names. Duplicate names, and a filter that leaves none, raise."""
    data: Any = json.loads(Path(source).read_text(encoding="utf-8-sig")) if isinstance(source, (str, Path)) else source
    blocks = data.get("models", [data]) if isinstance(data, Mapping) else data
    out = [_flat(entry, block) for block in blocks for entry in (block["model"] if isinstance(block["model"], list) else [block])]
    wanted = {n.strip() for n in names.split(",") if n.strip()}
    out = [c for c in out if not wanted or c["name"] in wanted]
    if not out:
        raise ValueError("no model was selected")
    seen = [c["name"] for c in out]
    if twice := sorted({n for n in seen if seen.count(n) > 1}):
        raise ValueError(f"duplicate model names: {twice}")
    return out


def expand_config(config: DataFrame) -> DataFrame:
    """A provider table with nested models, one row per model: model_name, model_id, provider, base_url,
    token_parameter, supports_temperature, thinking_profiles."""
    each = config.select("*", F.explode("model").alias("m"))
    model_id = F.coalesce("m.full_name", "m.name")
    provider, url = F.coalesce("provider", F.lit("openai_compatible")), F.coalesce("base_url", F.lit("https://api.openai.com/v1"))
    return each.select(
        F.coalesce("m.name", model_id).alias("model_name"),
        model_id.alias("model_id"),
        provider.alias("provider"),
        url.alias("base_url"),
        F.coalesce("token_parameter", F.lit("max_tokens")).alias("token_parameter"),
        F.coalesce("supports_temperature", F.lit(True)).alias("supports_temperature"),
        F.coalesce("m.thinking_profiles", thinking_profiles(provider, model_id, url)).alias("thinking_profiles"),
    )


def environment_configs(environ: Mapping[str, str], *, dry_run: bool = False) -> list[dict[str, Any]]:
    """Models named by the environment: LLM_MODELS_JSON (a list), or LLM_MODEL_NAME with LLM_BASE_URL and
    LLM_API_KEY_ENV; a dry run without either gets one example."""
    if listed := environ.get("LLM_MODELS_JSON"):
        return model_configs(json.loads(listed))
    if name := environ.get("LLM_MODEL_NAME") or (dry_run and "example-model"):
        default = "https://api.example.com/v1" if dry_run else "https://api.openai.com/v1"
        return model_configs([{"model": name, "base_url": environ.get("LLM_BASE_URL", default), "api_key_env": environ.get("LLM_API_KEY_ENV", "OPENAI_API_KEY")}])
    raise ValueError("the environment names no model")


def api_key(config: Mapping[str, Any], environ: Mapping[str, str]) -> str:
    """The key of a configuration: its own, else that of the variable it names."""
    if key := str(config.get("api_key") or "").strip():
        return key
    if not (variable := str(config.get("api_key_env") or "").strip()):
        raise ValueError(f"{config.get('name')} has no key and names no variable for one")
    return environ[variable]
