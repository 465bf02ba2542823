"""Sinks: append-only logs, small atomic files, result tables, progress and completion marks."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends under the commit protocol: a reader sees a whole job's rows or none."""
    df.write.mode("append").json(path)


def write_text(path: str | Path, text: str, encoding: str = "utf-8") -> None:
    """A small driver-side file, replaced at once: readers never see a part of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(path.name + ".tmp")
    draft.write_text(text, encoding=encoding, newline="")
    os.replace(draft, path)


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2))


def write_csv(df: DataFrame, path: str | Path, most_rows: int = 200_000) -> None:
    """A table as one CSV file with a byte-order mark, for spreadsheets. A table of more than `most_rows`
    rows is written by the executors instead, as a folder of CSV files of that name."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(str(path))
    else:
        write_text(path, rows.to_csv(index=False, lineterminator="\n"), "utf-8-sig")


def write_tables(tables: Mapping[str, DataFrame], folder: str | Path, most_rows: int = 200_000) -> None:
    """Result tables as <name>.csv; tables without rows are not written."""
    for name, df in tables.items():
        if not df.isEmpty():
            write_csv(df, Path(folder) / f"{name}.csv", most_rows)


def quarantine(tail: DataFrame, path: str) -> int:
    """Torn lines appended to <path>.corrupt_tail; the log itself is left alone. Returns their number."""
    n = tail.count()
    if n:
        tail.select("value").coalesce(1).write.mode("append").text(f"{path}.corrupt_tail")
    return n


def write_progress(path: str | Path, progress: DataFrame, rollup: DataFrame | None = None, **more: Any) -> None:
    """Completed and expected requests per model, and truncations, as one JSON file."""
    rows = {r.model_name: {"completed": r.completed, "expected": r.expected} for r in progress.collect()}  # one row per model
    limits = [r.asDict() for r in rollup.collect()] if rollup is not None else []  # one row per stage and level
    write_json(path, {**more, "models": rows, "completed": sum(r["completed"] for r in rows.values()), "expected": sum(r["expected"] for r in rows.values()), "token_limits": limits})


def mark_complete(path: str | Path, signature: str, **more: Any) -> None:
    write_json(path, {"status": "complete", "signature": signature, **more})


def mark_balance(path: str | Path, record: Mapping[str, Any]) -> None:
    """The mark of a run that stopped because an account is empty."""
    write_json(path, {"status": "balance_exhausted", **record})


def stopped_for_balance(path: str | Path, *, resume: bool = False) -> bool:
    """Whether an earlier run left such a mark; with `resume` it is taken away."""
    path = Path(path)
    if path.exists() and resume:
        path.unlink()
    return path.exists()


def is_current(path: str | Path, signature: str, outputs: tuple[str | Path, ...] = ()) -> bool:
    """Whether a completed run with this signature left all its outputs."""
    try:
        mark = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    return mark.get("status") == "complete" and mark.get("signature") == signature and all(Path(p).exists() for p in outputs)
