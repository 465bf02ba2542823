"""Streaming replay of append-only logs, and the fold of streamed responses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from titleforge.functions.control import usage
from titleforge.operators import state
from titleforge.session import shared_folder


def stream_table(spark: SparkSession, path: str, *, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet table (a folder, or a single file) as a stream of its files."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    if [f.rstrip("/").rsplit("/", 1)[-1] for f in table.inputFiles()] == [path.rstrip("/").rsplit("/", 1)[-1]]:
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stream_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder that gets JSONL files, as a stream; torn lines have `_bad` set and are left out."""
    fields = StructType.fromDDL(schema)
    return spark.readStream.schema(fields.add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").option("lineSep", "\n").json(folder).where("_bad is null").drop("_bad")


def run_available(stream: DataFrame, *, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Everything available goes through the stream; all rows it gave, in `update` mode each change of a key.

    State lives in a checkpoint in the shared folder: a run that is stopped goes on from there. A batch
    writes only what it changed, to a folder of its own that a repeated batch replaces."""
    spark = stream.sparkSession
    own = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = out or f"{own}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_number={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{own}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).schema(StructType([*stream.schema.fields]).add("_number", "long")).parquet(out)
    return rows.drop("_number")


def latest_success(log: DataFrame, signatures: DataFrame, titles: DataFrame, columns: Sequence[str] = state.SUCCESS, **options: Any) -> DataFrame:
    """The latest success per key over a stream: the batch operator's aggregation keeps a maximum per key
    and wording as state; the changes it wrote, the last of each counting, are joined with the titles."""
    changes = run_available(state.success_lines(log, signatures, columns), mode="update", **options)
    lines = changes.groupBy(*state.KEY, "title").agg(F.max("line_no").alias("line_no"), F.max_by("r", "line_no").alias("r"))
    return state.settled(lines, titles, columns)


def replay(log: DataFrame, refresh: Callable[[DataFrame, int], None], *, checkpoint: str) -> None:
    """Feeds a log stream to `refresh` batch by batch with exactly-once bookkeeping; ends when nothing is left."""
    log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(refresh).start().awaitTermination()


USAGE = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")


def fold_deltas(deltas: DataFrame, request: str = "request") -> DataFrame:
    """(request, content, reasoning, finish_reason, chunks) of rows (request, seq, content_delta,
    reasoning_delta, finish_reason): texts joined in order, the last finish reason that is not empty.
    If the rows have a struct `usage`, the last that is not null gives the token counts as well.

    A request's deltas meet in one row: they are one response of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content_delta", F.lit("")).alias("c"), F.coalesce("reasoning_delta", F.lit("")).alias("r"))))
    reason = F.max_by("finish_reason", F.when(F.coalesce("finish_reason", F.lit("")) != "", F.col("seq")))
    used = [F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("u")] if "usage" in deltas.columns else []
    folded = deltas.groupBy(request).agg(parts.alias("p"), F.coalesce(reason, F.lit("")).alias("finish_reason"), F.count("*").alias("chunks"), *used)
    counts = [usage(*(F.col(f"u.{c}") for c in USAGE))[c].alias(c) for c in USAGE] if used else []
    return folded.select(request, F.array_join(F.col("p.c"), "").alias("content"), F.array_join(F.col("p.r"), "").alias("reasoning"), "finish_reason", "chunks", *counts)


def content_checkpoints(deltas: DataFrame, request: str = "request", step: int = 64) -> DataFrame:
    """(request, seq, length): the deltas at which at least `step` characters came since the last such point."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.length(F.coalesce("content_delta", F.lit(""))).alias("n"))))
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("last"), F.array().cast("array<struct<seq:bigint,length:int>>").alias("points"))

    def add(acc: Any, part: Any) -> Any:
        length = acc["length"] + part["n"]
        due = length - acc["last"] >= step
        point = F.array(F.struct(part["seq"].cast("long").alias("seq"), length.alias("length")))
        return F.struct(length.alias("length"), F.when(due, length).otherwise(acc["last"]).alias("last"), F.when(due, F.concat(acc["points"], point)).otherwise(acc["points"]).alias("points"))

    folded = deltas.groupBy(request).agg(F.aggregate(parts, start, add, lambda acc: acc["points"]).alias("points"))
    return folded.select(request, F.inline("points"))


class ResponseFold(StatefulProcessor):
    """One response per request: content so far, a content checkpoint each `step` characters, and a sign
    of life when a request was silent for `alive_ms` of processing time."""

    def __init__(self, step: int = 64, alive_ms: int = 30_000) -> None:
        self.step, self.alive_ms = step, alive_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("response", "content string, last long, chunks long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        content, last, chunks = self.state.get() if self.state.exists() else ("", 0, 0)
        out, finished = [], False
        for row in pd.concat(rows).sort_values("seq").itertuples():
            content, chunks = content + (row.content_delta or ""), chunks + 1
            if row.finish_reason:
                out.append((key[0], "finished", content, chunks))
                finished = True
            elif len(content) - last >= self.step:
                last = len(content)
                out.append((key[0], "content_checkpoint", content, chunks))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if finished:  # nothing is kept of a response that has ended
            self.state.clear()
        else:
            self.state.update((content, last, chunks))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.alive_ms)
        yield pd.DataFrame(out, columns=["request", "status", "content", "chunks"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        content, _, chunks = self.state.get() if self.state.exists() else ("", 0, 0)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.alive_ms)
        yield pd.DataFrame([(key[0], "stream_checkpoint", content, chunks)], columns=["request", "status", "content", "chunks"])

    def close(self) -> None:
        pass


def watch_responses(deltas: DataFrame, step: int = 64, alive_ms: int = 30_000) -> DataFrame:
    """The checkpoints of running requests as a stream.

    Needs the RocksDB state store, and a processing-time trigger: with timers an availableNow run never ends."""
    return deltas.groupBy("request").transformWithStateInPandas(
        statefulProcessor=ResponseFold(step, alive_ms), outputStructType="request string, status string, content string, chunks long", outputMode="Append", timeMode="ProcessingTime"
    )
