"""python -m titleforge run|metrics|classify: answers of a scorer, and result tables, from files."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.functions import control
from titleforge.operators import estimators, state
from titleforge.plans import pipelines, runner
from titleforge.session import build_session
from titleforge.sources import readers, sinks

# How a run ends, for what starts it.
EXITS = {"complete": 0, "permanent": 2, "incomplete": 3, "time": 3, "balance": 42, "transient": 75}
CLASSIFIED = ("ml_dev_selection", "ml_predictions", "ml_metrics", "ml_top_features")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="titleforge")
    what = top.add_subparsers(dest="what", required=True)
    for name in ("run", "metrics", "classify"):
        p = what.add_parser(name)
        p.add_argument("--core", required=True, help="labelled CSV file")
        p.add_argument("--output", required=True, help="folder of the result tables")
        p.add_argument("--rounds", type=int, default=1_000)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--rng", choices=("multinomial", "numpy"), default="multinomial")
        if name == "classify":
            p.add_argument("--dev", type=int, default=69)
            p.add_argument("--test", type=int, default=72)
            p.add_argument("--families", default=",".join(estimators.FAMILIES))
            p.add_argument("--save-models", action="store_true", help="write each fitted model as a table")
            p.add_argument("--force", action="store_true")
            continue
        p.add_argument("--other", help="labelled CSV file of the second subset")
        p.add_argument("--log", required=True, help="prediction log, JSONL (for run a folder of such files)")
        p.add_argument("--most-per-subset", type=int, default=0)
        p.add_argument("--models", default="", help="model configuration, JSON; else the environment names the models")
        p.add_argument("--model-names", default="", help="comma list of display names")
        p.add_argument("--prompt", required=True, help="file of the system prompt, which the signatures bind")
        p.add_argument("--stages", default="4096,8192,16384", help="comma list of token budgets")
        p.add_argument("--temperature", type=float, default=0.6)
        p.add_argument("--top-p", type=float, default=0.95)
        p.add_argument("--frequency-penalty", type=float, default=0.5)
        p.add_argument("--thinking-budget", type=int, default=1_024)
        p.add_argument("--reasoning-effort", choices=("high", "max"), default="high")
        p.add_argument("--timeout", type=float, default=300.0)
        p.add_argument("--retries", type=int, default=3)
        if name == "run":
            p.add_argument("--scorer", default="", help="module:function that answers requests")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--item-local", action="store_true")
            p.add_argument("--geometric", action="store_true", help="double the last budget instead of starting over")
            p.add_argument("--most-stages", type=int, default=12)
            p.add_argument("--workers", type=int, default=8, help="shards per model")
            p.add_argument("--minutes", type=float, default=0.0, help="time budget; 0 for none")
            p.add_argument("--resume-after-balance", action="store_true")
    return top


def classify(args: argparse.Namespace) -> int:
    spark, mark = build_session(), f"{args.output}/complete.json"
    signature = control.stable_hash({**{k: v for k, v in vars(args).items() if k not in ("force", "output")}, "file": readers.local_digest(args.core)})
    outputs = [Path(args.output) / f"{name}.csv" for name in CLASSIFIED]
    outputs += [Path(args.output) / "models" / name for name in args.families.split(",")] if args.save_models else []
    if not args.force and sinks.is_current(mark, signature, tuple(outputs)):
        return 0
    rows = readers.labelled_csv(spark, args.core, "core", id_prefix="core")
    tables = pipelines.classify(rows, args.dev, args.test, rounds=args.rounds, seed=args.seed, rng=args.rng, families=args.families.split(","))
    sinks.write_tables({name: tables[name] for name in CLASSIFIED}, args.output)
    if args.save_models:
        for name, model in tables["models"].items():
            estimators.save(model, str(Path(args.output).resolve() / "models" / name))
    sinks.mark_complete(mark, signature)
    show(tables["ml_dev_selection"])
    show(tables["ml_metrics"])
    return 0


def show(table: DataFrame) -> None:
    """A small table on the console."""
    print(table.limit(1_000).toPandas().to_string(index=False))


def log_command(args: argparse.Namespace) -> int:
    spark, out = build_session(), Path(args.output)
    balance = out / "balance_stop.json"
    if args.what == "run" and sinks.stopped_for_balance(balance, resume=args.resume_after_balance):
        print(balance.read_text(encoding="utf-8"))
        return EXITS["balance"]
    titles = readers.evaluation_data(spark, args.core, args.other, most_per_subset=args.most_per_subset)
    dry = args.what == "run" and args.dry_run
    configs = readers.model_configs(args.models, args.model_names) if args.models else readers.environment_configs(os.environ, dry_run=dry)
    stages = control.parse_stages(args.stages, int(args.stages.split(",")[0]))
    policy = control.request_policy(
        stages=stages, temperature=args.temperature, top_p=args.top_p, frequency_penalty=args.frequency_penalty, thinking_budget=args.thinking_budget, reasoning_effort=args.reasoning_effort, timeout=args.timeout, retries=args.retries
    )
    signed = control.condition_signatures(configs, Path(args.prompt).read_text(encoding="utf-8"), policy)
    signatures, plan = state.configured_signatures(spark, signed), control.plan_signature(stages)
    models = spark.createDataFrame([(c["name"], c["provider"], c["model"], c["thinking_profiles"]) for c in configs], "model_name string, provider string, model_id string, thinking_profiles array<string>")
    if not Path(args.log).exists() and args.what == "run":
        log = spark.createDataFrame([], "line_no long, " + readers.LOG_SCHEMA)
    else:
        log, tail = readers.jsonl(spark, args.log)
        sinks.quarantine(tail, args.log)
    if args.what == "metrics":
        return finish(args, log, titles, signatures, {"status": "metrics"})
    run = {
        "policy_signature": control.policy_signature(signed, stages, geometric=args.geometric), "evaluation_signature": control.evaluation_signature(titles), "token_plan_signature": plan, "token_stages": stages,
        "models": [{k: c[k] for k in ("name", "model", "provider", "thinking_profiles")} for c in configs], "shared_request": policy,
    }
    if args.dry_run:
        print(json.dumps({**pipelines.preview(log, titles, models, signatures).first().asDict(), **run}, ensure_ascii=False, indent=2))
        return 0
    module, _, name = args.scorer.partition(":")
    sys.path.insert(0, os.getcwd())
    scorer = getattr(importlib.import_module(module), name)
    before = log.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
    log, outcome = runner.run_stages(
        titles, models, log, scorer, signatures=signatures, plan=plan, stages=stages, most_stages=args.most_stages, item_local=args.item_local, geometric=args.geometric,
        workers=args.workers, retries=args.retries, seconds=60 * args.minutes, attempts_path=str((out / "request_attempts").resolve()),
    )
    new = log.where(F.col("line_no") > before)
    if not new.isEmpty():
        sinks.append_jsonl(new.drop("line_no"), args.log)
    counters = {r.model_name: r.asDict() for r in state.worker_counters(new).collect()}  # one row per model
    expected = state.expected_keys(titles, models)
    success = state.latest_success(log, signatures, titles, columns=("title", "gold_label", "pred_label"))
    rollup = state.token_limit_rollup(state.stage_outcomes(log, signatures, plan, titles), expected, stages, geometric=args.geometric)
    failed = sorted(k for k, v in counters.items() if v["failed"])
    sinks.write_progress(out / "progress.json", state.progress(expected, success), rollup, status=outcome, updated_at=control.now(), counters=counters, failed_models=failed)
    if outcome == "balance":
        empty = new.where("status = 'balance_exhausted'").select("model_name", "error", "http_status").first()
        sinks.mark_balance(balance, empty.asDict())
    return finish(args, log, titles, signatures, {**run, "status": outcome}, EXITS[outcome])


def finish(args: argparse.Namespace, log: DataFrame, titles: DataFrame, signatures: DataFrame, marks: dict[str, Any], code: int = 0) -> int:
    """Writes and shows the result tables; the mark of completion only for a run that is complete."""
    tables = pipelines.log_tables(log, titles, signatures, rounds=args.rounds, seed=args.seed, rng=args.rng)
    sinks.write_tables(tables, args.output)
    if code == 0:
        sinks.mark_complete(f"{args.output}/complete.json", marks.get("policy_signature", ""), **{k: v for k, v in marks.items() if k != "status"})
    show(tables["llm_metrics"])
    return code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return classify(args) if args.what == "classify" else log_command(args)


if __name__ == "__main__":
    raise SystemExit(main())
