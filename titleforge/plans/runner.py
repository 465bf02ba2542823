"""Scoring what is still open with a pluggable scorer, stage by stage.

A scorer is a function from a data frame of requests (model_name, subset, id, title, prompt,
token_budget, thinking_profile) to one of responses, row by row: raw_response, finish_reason, error,
http_status and, as far as it knows them, token counts, latency_ms, reasoning_chars and retry_after.
It runs inside the executors; the engine retries, parses, classifies and appends."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.functions import control, text
from titleforge.operators import state
from titleforge.session import cut_lineage
from titleforge.sources import sinks

KEY = state.KEY
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
COUNTS = ("reasoning_chars", "prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")
# what a request ends with, as the log has it
RESULT = (
    "status string, pred_label string, explanation string, raw_response string, finish_reason string, thinking_profile string, error_kind string, error string, confidence double, latency_ms double, "
    "format_valid boolean, thinking_requested boolean, thinking_observed boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", api_attempts long, http_status int"
)
ATTEMPT = "timestamp string, attempt_status string, thinking_profile string, api_attempt long, finish_reason string, pred_label string, raw_response string, latency_ms double, http_status int, error_kind string, error string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
LOGGED = ["timestamp", "condition_signature", "token_plan_signature", *KEY, "title", "gold_label", "token_budget", "token_stage_index"]


def _one(value: Any, otherwise: Any) -> Any:
    return otherwise if value is None or value != value else value


def ask(requests: pd.DataFrame, scorer: Scorer, profiles: Sequence[Sequence[str]], *, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> list[dict[str, Any]]:
    """The result of each request, with its attempts under `attempts`.

    A request is tried up to `retries` times with each of its model's thinking profiles. Errors that may
    pass, and responses without a legal label, are tried again; a rejected profile gives way to the
    next; an empty account, a truncated response and other errors end it. Requests are sent together,
    those that go on again together, after the longest wait any of them asks for."""
    n = len(requests)
    profile_at, tries, total = [0] * n, [0] * n, [0] * n
    attempts: list[list[dict[str, Any]]] = [[] for _ in range(n)]
    done: list[dict[str, Any] | None] = [None] * n
    requests = requests.reset_index(drop=True)
    while open_ := [k for k in range(n) if done[k] is None]:
        batch = requests.iloc[open_].reset_index(drop=True).assign(thinking_profile=[profiles[k][profile_at[k]] for k in open_])
        began = time.perf_counter()
        answers = scorer(batch).reset_index(drop=True).astype(object).to_dict("records")
        took, pause = (time.perf_counter() - began) * 1_000, 0.0
        for k, answer in zip(open_, answers):
            total[k] += 1
            tries[k] += 1
            profile, budget = profiles[k][profile_at[k]], int(requests["token_budget"].iloc[k])
            code = _one(answer.get("http_status"), None)
            message, raw, reason = (str(_one(answer.get(c), "")) for c in ("error", "raw_response", "finish_reason"))
            latency = round(float(_one(answer.get("latency_ms"), took)), 2)
            counts = {c: int(_one(answer.get(c), 0)) for c in COUNTS}
            counts["total_tokens"] = counts["total_tokens"] or counts["prompt_tokens"] + counts["completion_tokens"]
            label, explanation, confidence, valid = text.read_response(raw)
            if message:
                kind, seen = control.error_kind(code, message), "request_error"
            elif control.truncated(reason, counts["completion_tokens"], budget):
                kind = seen = "token_limit"
            elif label in text.LABELS:
                kind, seen = "", "valid_response"
            else:
                kind = seen = "invalid_response"
            attempts[k].append(
                {"timestamp": control.now(), "attempt_status": seen, "thinking_profile": profile, "api_attempt": total[k], "finish_reason": reason, "pred_label": label, "raw_response": raw, "latency_ms": latency, "http_status": code, "error_kind": kind if message else "", "error": message}
            )
            observed = bool(counts["reasoning_chars"] or counts["reasoning_tokens"])
            whole = {"raw_response": raw, "finish_reason": reason, "thinking_observed": observed, "latency_ms": latency, **counts}
            again = kind in ("transient", "invalid_response") and tries[k] < retries
            if seen == "valid_response":
                done[k] = _result("success", profile, total[k], label=label, explanation=explanation, confidence=confidence, valid=valid, **whole)
            elif seen == "token_limit":
                done[k] = _result("token_limit", profile, total[k], kind=kind, error="The response reached the token limit of its stage.", **whole)
            elif again:
                pause = max(pause, control.delay(tries[k] - 1, _one(answer.get("retry_after"), None)))
            elif kind in ("invalid_parameters", "invalid_response") and profile_at[k] + 1 < len(profiles[k]):
                profile_at[k], tries[k] = profile_at[k] + 1, 0
            else:
                status = {"balance_exhausted": "balance_exhausted", "transient": "transient_failure", "invalid_response": "transient_failure"}.get(kind, "permanent_failure")
                done[k] = _result(status, profile, total[k], kind=kind, code=code, error=message or "The response held no legal label.")
        if pause:
            wait(pause)
    return [{**d, "attempts": a} for d, a in zip(done, attempts) if d is not None]


def _result(status: str, profile: str, attempts: int, *, label: str = "", explanation: str = "", confidence: float = 0.0, valid: bool = False, kind: str = "", code: int | None = None, error: str = "", **whole: Any) -> dict[str, Any]:
    """One shape for every end of a request; what failed has no response."""
    nothing = {"raw_response": "", "finish_reason": "", "thinking_observed": False, "latency_ms": 0.0, **dict.fromkeys(COUNTS, 0)}
    return {
        "status": status, "pred_label": label, "explanation": explanation, "confidence": confidence, "format_valid": valid, "thinking_profile": profile, "thinking_requested": True,
        "error_kind": kind, "http_status": code, "error": error, "api_attempts": attempts, **nothing, **whole,
    }


def score(requests: DataFrame, scorer: Scorer, *, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """`requests` (with token_budget, and thinking_profiles if the models have any) with the result of
    each and the array `attempts`. Responses are read by the strict parser, whatever their depth."""
    kept = requests.drop("thinking_profiles")
    columns = kept.columns
    attempt = T.ArrayType(T._parse_datatype_string(ATTEMPT))
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(RESULT).fields, T.StructField("attempts", attempt)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            profiles = [list(p) if p is not None and len(p) else list(control.USUAL) for p in pdf["thinking_profiles"]] if "thinking_profiles" in pdf else [list(control.USUAL)] * len(pdf)
            own = pdf[columns].reset_index(drop=True)
            got = pd.DataFrame(ask(own, scorer, profiles, retries=retries, wait=wait), columns=[*NAMES, "attempts"])
            got["http_status"] = got["http_status"].astype("Int32")
            yield pd.concat([own, got], axis=1)

    return requests.mapInPandas(run, schema)


def run_stages(
    titles: DataFrame, models: DataFrame, log: DataFrame, scorer: Scorer, *, signatures: DataFrame, plan: str, stages: Sequence[int], most_stages: int = 12, item_local: bool = False, geometric: bool = False,
    workers: int = 8, retries: int = 3, seconds: float = 0.0, attempts_path: str | None = None, wait: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, str]:
    """(the log with new lines, outcome). Stage s + 1 begins when every candidate of stage s succeeded or
    was cut off; with item_local each item goes on by itself, from the stage it has reached. Outcome:
    complete, balance (the account is empty), time (`seconds` are over; checked between stages),
    transient, permanent (failures of this kind), incomplete (stages are left).

    Successes are never asked again. New lines hold the whole result of a request; columns that `log`
    lacks are null in its old lines. Jobs are dealt to `workers` shards per model. Each stage is one
    job; the log grows by a written table per stage, and every attempt is appended to `attempts_path`."""
    began = time.monotonic()
    expected = cut_lineage(state.expected_keys(titles, models))
    known = models.select("model_name", *(c for c in ("thinking_profiles", "provider", "model_id") if c in models.columns))
    success = lambda: state.latest_success(log, signatures, titles, columns=("title", "gold_label", "pred_label"))
    for stage in range(most_stages):
        open_ = cut_lineage(state.incomplete_keys(expected, success()))
        if open_.isEmpty():
            return log, "complete"
        if seconds and time.monotonic() - began >= seconds:
            return log, "time"
        outcomes = state.stage_outcomes(log, signatures, plan, titles)
        if item_local:
            due = state.item_stage(outcomes, open_)
        else:
            due = state.stage_pending(state.stage_candidates(open_, outcomes), outcomes).where(F.col("stage") == stage)
        dealt = state.sharded(due, workers)
        # one model's shards go to different tasks
        requests = dealt.join(expected, list(KEY)).join(known, "model_name").repartition("model_name", "shard_index").select(
            *KEY, "title", "gold_label", text.user_prompt(F.col("title")).alias("prompt"), "stage", control.stage_budget(F.col("stage"), stages, geometric=geometric).alias("token_budget"), *(c for c in known.columns if c != "model_name")
        )
        got = cut_lineage(score(requests, scorer, retries=retries, wait=wait))
        if attempts_path:
            sinks.append_jsonl(got.select(*KEY, "title", "gold_label", "token_budget", F.col("stage").alias("token_stage_index"), F.inline("attempts")), attempts_path)
        top = log.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
        own = [c for c in got.columns if c not in ("prompt", "stage", "attempts", "thinking_profiles")]
        # line numbers need only rise: any order among the lines of one stage will do
        lines = got.join(signatures.select("model_name", "condition_signature"), "model_name").select(
            (F.monotonically_increasing_id() + top + 1).alias("line_no"), control.utc_now().alias("timestamp"), "condition_signature", F.lit(plan).alias("token_plan_signature"), F.col("stage").alias("token_stage_index"), *own
        )
        log = cut_lineage(log.unionByName(lines, allowMissingColumns=True))
        kinds = {r.status for r in got.select("status").distinct().collect()}
        if "balance_exhausted" in kinds:
            return log, "balance"
        failed = kinds & {"transient_failure", "permanent_failure"}
        if failed and not (item_local and kinds - failed):
            return log, "permanent" if "permanent_failure" in failed else "transient"
    return log, "complete" if state.incomplete_keys(expected, success()).isEmpty() else "incomplete"
