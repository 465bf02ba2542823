"""Expressions over request records: truncation, error classes, budgets, usage, signatures."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finish reasons of a truncated response, and terms of error messages.
TRUNCATED = ("length", "max_tokens", "max_output_tokens", "token_limit")
BALANCE_TERMS = ("insufficient balance", "insufficient funds", "balance not enough", "insufficient quota", "quota is not enough", "account balance", "recharge required", "余额不足", "账户余额", "额度不足", "请充值", "欠费")
NETWORK_TERMS = ("timeout", "timed out", "connection", "network", "temporarily unavailable", "remote protocol", "server disconnected")
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)


def _any_term(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def hit_token_limit(finish_reason: Column, completion_tokens: Column, budget: Column) -> Column:
    """Truncated by its finish reason, or without one but with the whole budget used."""
    reason = F.lower(F.trim(F.coalesce(finish_reason, F.lit(""))))
    return reason.isin(*TRUNCATED) | ((reason == "") & (F.coalesce(completion_tokens, F.lit(0)) >= budget))


def attempt_status(truncated: Column, label: Column) -> Column:
    return F.when(truncated, "token_limit").when(label.isin("Yes", "No"), "valid_response").otherwise("invalid_response")


def error_class(status: Column, message: Column) -> Column:
    """balance_exhausted, transient, invalid_parameters or permanent, in this order."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(F.coalesce(status == 402, F.lit(False)) | _any_term(text, BALANCE_TERMS), "balance_exhausted")
        .when(status.isin(*RETRYABLE), "transient")
        .when(status.isNull() & _any_term(text, NETWORK_TERMS), "transient")
        .when(status.isin(400, 422), "invalid_parameters")
        .otherwise("permanent")
    )


def truncated(finish_reason: str, completion_tokens: int, budget: int) -> bool:
    """`hit_token_limit` of one response."""
    reason = finish_reason.strip().lower()
    return reason in TRUNCATED or (not reason and completion_tokens >= budget)


def error_kind(status: int | None, message: str) -> str:
    """`error_class` of one error."""
    low = message.lower()
    if status == 402 or any(t in low for t in BALANCE_TERMS):
        return "balance_exhausted"
    if status in RETRYABLE or (status is None and any(t in low for t in NETWORK_TERMS)):
        return "transient"
    return "invalid_parameters" if status in (400, 422) else "permanent"


def delay(attempt: int, retry_after: object = None, *, base: float = 2.0, most: float = 60.0) -> float:
    """`retry_delay` of one attempt."""
    try:
        wish = float(str(retry_after))
    except ValueError:
        wish = math.nan
    return min(most, base * 2.0**attempt if math.isnan(wish) else max(0.0, wish))


def now() -> str:
    """`utc_now` outside of Spark."""
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def retry_delay(attempt: Column, retry_after: Column, *, base: float = 2.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait: the server's wish, if it is a number, else a doubling delay; both at most `most`."""
    number = retry_after.try_cast("double")
    wish = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), number))
    grown = F.lit(base) * F.pow(F.lit(2.0), attempt) + (F.lit(0.0) if jitter is None else jitter * base)
    return F.least(F.lit(most), F.coalesce(wish, grown))


# Whose requests these are, by provider name and address, the part of the model's name that
# decides, and the syntaxes to try in order. The first row that fits holds.
PROFILES = (
    ("deepseek", "api.deepseek.com", "", ("deepseek_thinking",)),
    ("siliconflow", "siliconflow", "glm-5.2", ("thinking_object", "siliconflow_enable")),
    ("siliconflow", "siliconflow", "kimi-k2.6", ("siliconflow_enable", "thinking_object")),
    ("siliconflow", "siliconflow", "", ("siliconflow_enable",)),
)
USUAL = ("thinking_object",)
# What each syntax adds to a request, the budget left to be filled in.
SYNTAX = {"deepseek_thinking": {"thinking": {"type": "enabled"}}, "siliconflow_enable": {"enable_thinking": True, "thinking_budget": None}, "thinking_object": {"thinking": {"type": "enabled"}}}


def thinking_profiles(provider: Column, model_id: Column, base_url: Column) -> Column:
    """The request syntaxes to try, in order, inferred from a provider's name, model and address."""
    p, m, u = (F.lower(F.coalesce(c, F.lit(""))) for c in (provider, model_id, base_url))
    out = F.array(*map(F.lit, USUAL))
    for name, address, part, profiles in reversed(PROFILES):
        out = F.when(((p == name) | u.contains(address)) & m.contains(part), F.array(*map(F.lit, profiles))).otherwise(out)
    return out


def profiles_of(provider: str, model: str, url: str) -> list[str]:
    """The same for one configuration."""
    p, m, u = provider.lower(), model.lower(), url.lower()
    return list(next((x for name, address, part, x in PROFILES if (p == name or address in u) and part in m), USUAL))


def request_body(
    model: Column, prompts: Column, token_parameter: Column, max_tokens: Column, profile: Column, *, extra: Column | None = None,
    temperature: float = 0.6, top_p: float = 0.95, frequency_penalty: float = 0.5, reasoning_effort: str = "high", thinking_budget: int = 1_024,
) -> Column:
    """The body of a chat request as JSON text: the token limit under the provider's own name for it, and
    in extra_body the object `extra` of the configuration (JSON text) with the profile's syntax for
    thinking, which goes before it. An unknown profile is an error."""
    head = F.to_json(F.struct(model.alias("model"), prompts.alias("messages")))
    shared = json.dumps({"stream": True, "stream_options": {"include_usage": True}, "temperature": temperature, "top_p": top_p, "frequency_penalty": frequency_penalty, "reasoning_effort": reasoning_effort, "response_format": {"type": "json_object"}}, separators=(",", ":"))
    unknown = F.raise_error(F.concat(F.lit("unknown thinking profile: "), F.coalesce(profile, F.lit("null")))).cast("string")
    own = unknown
    for name, fields in SYNTAX.items():
        text = json.dumps({k: thinking_budget if v is None else v for k, v in fields.items()}, separators=(",", ":"))
        own = F.when(profile == name, F.lit(text)).otherwise(own)
    if extra is not None:
        given = F.from_json(extra, "map<string, variant>")
        both = F.map_concat(F.map_filter(given, lambda k, _: ~F.array_contains(F.json_object_keys(own), k)), F.from_json(own, "map<string, variant>"))
        own = F.when(given.isNull(), own).otherwise(F.to_json(both))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)  # noqa: E731  without the braces
    limit = F.concat(F.lit('"'), token_parameter, F.lit('":'), max_tokens.cast("string"))
    return F.concat(F.lit("{"), inner(head), F.lit(","), inner(F.lit(shared)), F.lit(","), limit, F.lit(',"extra_body":'), own, F.lit("}"))


def stage_budget(stage: Column, stages: Sequence[int], *, geometric: bool = False, most: int = 262_144) -> Column:
    """The token budget of a stage: the list over and over, or doubling beyond its end up to `most`."""
    plan = F.array(*(F.lit(int(s)).cast("long") for s in stages))
    n = len(stages)
    if not geometric:
        return F.element_at(plan, (F.pmod(stage, F.lit(n)) + 1).cast("int"))
    over = F.least(F.lit(int(most)).cast("double"), F.lit(float(stages[-1])) * F.pow(F.lit(2.0), F.least(stage - n + 1, F.lit(62)))).cast("long")
    return F.when(stage < n, F.element_at(plan, (F.least(stage, F.lit(n - 1)) + 1).cast("int"))).otherwise(over)


def stage_cycle(stage: Column, n: int, *, geometric: bool = False) -> tuple[Column, Column]:
    """(cycle, place in the cycle) of a stage."""
    if geometric:
        return F.lit(0).cast("long"), stage.cast("long")
    return F.floor(stage / F.lit(n)).cast("long"), F.pmod(stage, F.lit(n)).cast("long")


def parse_stages(text: str, initial: int, *, strict: bool = False) -> list[int]:
    """A comma list of token budgets, checked: positive, starting with `initial`, and nondecreasing.

    strict adds `initial` where it is missing and forbids repetition."""
    stages = [int(x) for x in text.split(",") if x.strip()]
    if strict and stages and initial not in stages:
        stages.insert(0, initial)
    if not stages or stages[0] != initial:
        raise ValueError(f"the stages must begin with {initial}")
    if min(stages) <= 0 or stages != (sorted(set(stages)) if strict else sorted(stages)):
        raise ValueError("the stages must be positive and must not fall" + " or repeat" * strict)
    return stages


def usage(prompt: Column, completion: Column, reasoning: Column, total: Column) -> Column:
    """struct of token counts, null as 0; the total defaults to prompt and completion."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.struct(
        zero(prompt).alias("prompt_tokens"), zero(completion).alias("completion_tokens"), zero(reasoning).alias("reasoning_tokens"), F.coalesce(total.cast("long"), zero(prompt) + zero(completion)).alias("total_tokens")
    )


def progress_record(status: Column, profile: Column, attempt: Column, content: Column, reasoning_chars: Column, elapsed: Column) -> Column:
    """The compact record of a running response: its text so far, no hidden reasoning, no usage yet."""
    none = F.lit(0).cast("long")
    return F.struct(
        utc_now().alias("timestamp"), status.alias("attempt_status"), profile.alias("thinking_profile"), attempt.alias("api_attempt"), F.lit("").alias("finish_reason"), content.alias("raw_response"),
        F.lit("").alias("reasoning_content"), (reasoning_chars > 0).alias("thinking_observed"), reasoning_chars.alias("reasoning_chars"), none.alias("prompt_tokens"), none.alias("completion_tokens"),
        none.alias("reasoning_tokens"), none.alias("total_tokens"), elapsed_ms(elapsed).alias("latency_ms"), F.lit(None).cast("int").alias("http_status"), F.lit("").alias("error_kind"), F.lit("").alias("error"),
    )


def request_policy(*, stages: Sequence[int], temperature: float = 0.6, top_p: float = 0.95, frequency_penalty: float = 0.5, thinking_budget: int = 1_024, reasoning_effort: str = "high", timeout: float = 300.0, retries: int = 3, **more: Any) -> dict[str, Any]:
    """The settings all requests share, as one value to sign."""
    own = dict(temperature=temperature, top_p=top_p, frequency_penalty=frequency_penalty, thinking_budget=thinking_budget, reasoning_effort=reasoning_effort, timeout=timeout, retries=retries)
    return {**own, "max_tokens": stages[0], "token_stages": list(stages), "response_format": "json_object", "stream": True, **more}


def timed_out(elapsed_seconds: Column, limit: float = 300.0) -> Column:
    """Whether a streamed response ran longer than its wall-clock limit."""
    return elapsed_seconds >= limit


def elapsed_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000, 2)


def utc_now() -> Column:
    """Now as ISO text in UTC (the session's zone must be UTC)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def row_hash(*names: str) -> Column:
    """SHA-256 of columns as canonical JSON: keys in order, no blanks, text as it is, null for null. The same
    as `stable_hash` of the row's columns as a dictionary."""
    return F.sha2(F.to_json(F.struct(*(F.col(n) for n in sorted(names))), {"ignoreNullFields": "false"}), 256)


def stable_hash(value: Any) -> str:
    """SHA-256 of a driver-side value as canonical JSON: sorted keys, no blanks, text as it is."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def plan_signature(stages: Sequence[int], policy: str = "repeat_until_success") -> str:
    return stable_hash({"token_stage_plan": list(stages), "token_stage_policy": policy})


def condition_signature(*, experiment: str, prompt: str, model: str, provider: str, thinking_profiles: Sequence[str], shared_request_policy: dict[str, Any]) -> str:
    """Binds results to the exact prompt, model and request settings."""
    return stable_hash(dict(experiment=experiment, prompt=prompt, model=model, provider=provider, thinking_profiles=list(thinking_profiles), shared_request_policy=shared_request_policy))


def condition_signatures(configs: Sequence[Mapping[str, Any]], prompt: str, policy: dict[str, Any], experiment: str = "llm_title_detection") -> dict[str, str]:
    """The current signature of every configured model, by its display name."""
    return {c["name"]: condition_signature(experiment=experiment, prompt=prompt, model=c["model"], provider=c["provider"], thinking_profiles=c["thinking_profiles"], shared_request_policy=policy) for c in configs}


def policy_signature(signatures: Mapping[str, str], stages: Sequence[int], *, policy: str = "repeat_until_success", geometric: bool = False, most: int = 262_144) -> str:
    """Binds a run to its models' signatures and its plan of stages."""
    return stable_hash({"condition_signatures": dict(signatures), "token_stages": list(stages), "token_stage_policy": policy, "token_plan_signature": plan_signature(stages, policy), "escalate_after_max": geometric, "max_escalation_tokens": most})


def evaluation_signature(titles: DataFrame) -> str:
    """One hash of all (subset, id, title, gold_label) in their order, whatever the number of rows.

    Rows are sorted in ranges and hashed where they are; the hashes, one per row of 64 signs, are folded
    range by range, and one hash per range is folded on the driver. Not equal to a hash of the whole
    list as one text, which would need all rows in one place; equal for equal tables however they lie."""
    from titleforge.operators.tables import ordered_ordinal

    names = ("subset", "id", "title", "gold_label")
    rows = ordered_ordinal(titles.select(*names).select(*names, row_hash(*names).alias("_hash")), ["subset", "id", "title", "gold_label"], "_n")
    block = F.floor((F.col("_n") - 1) / 10_000)
    folded = rows.groupBy(block.alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_hash"))), lambda x: x["_hash"]), ""), 256).alias("h"))
    folded = folded.groupBy(F.floor(F.col("b") / 10_000).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return stable_hash([r.h for r in folded.orderBy("b").collect()])  # one row per hundred million titles
