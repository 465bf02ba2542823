"""Bootstrap intervals of metrics that are functions of the confusion counts.

Drawing n rows with replacement and counting them is drawing the four counts from a multinomial
distribution, so the usual engine draws counts: rounds per group, whatever n. Two further streams
gather rows by index: numpy's generator for equal results with a given seed on small groups, and an
arithmetic one that any SQL engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleforge.operators.metrics import Policy, confusion, indicator, rates

METRICS = ("accuracy", "macro_f1", "f1_yes")


def _percentiles(rounds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    ends = [F.percentile(m, F.lit(q)).alias(f"{m}_ci_{end}") for m in metrics for end, q in (("low", 0.025), ("high", 0.975))]
    return rounds.groupBy(*by).agg(*ends)


def bootstrap(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), *, rounds: int = 1_000, seed: int = 42, metrics: Sequence[str] = METRICS, policy: Policy = "fixed") -> DataFrame:
    """Percentile intervals (2.5, 97.5) per group; groups of fewer than two rows have none."""
    counts = confusion(predictions, by).where("n > 1")
    keys = list(by)

    def draw(batches):
        for pdf in batches:
            parts = []
            for row in pdf.to_dict("records"):
                cells = np.array([row[c] for c in ("tp", "fp", "tn", "fn")])
                own = np.random.default_rng([seed, *b"\0".join(str(row[k]).encode() for k in keys)])
                got = own.multinomial(cells.sum(), cells / cells.sum(), rounds)
                parts.append(pd.DataFrame({**{k: row[k] for k in keys}, "round": np.arange(rounds), **{c: got[:, i] for i, c in enumerate(("tp", "fp", "tn", "fn"))}}))
            if parts:
                yield pd.concat(parts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in keys) + ", round long, tp long, fp long, tn long, fn long"
    drawn = counts.mapInPandas(draw, schema).withColumns({m: c for m, c in rates(policy).items() if m in metrics})
    return _percentiles(drawn, by, metrics)


def bootstrap_numpy(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), *, order: str = "id", rounds: int = 1_000, seed: int = 42, metrics: Sequence[str] = METRICS, policy: Policy = "fixed", most_rows: int = 1_000_000) -> DataFrame:
    """As `bootstrap`, with the index stream of numpy's default generator, seeded anew per group.

    A group is drawn in one task, so groups of more than `most_rows` rows are an error: use `bootstrap`."""
    keys = list(by)
    rows = predictions.select(*keys, F.col(order).alias("_order"), indicator(F.col("gold_label")).alias("y"), indicator(F.col("pred_label")).alias("p"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n > most_rows:
            raise ValueError(f"a group of {n} rows is too large for this stream")
        if n < 2:
            return pd.DataFrame(columns=[*keys, "round", "tp", "fp", "tn", "fn"])
        cell = (pdf.sort_values("_order")["y"] * 2 + pdf.sort_values("_order")["p"]).to_numpy()
        rng = np.random.default_rng(seed)
        got = np.stack([np.bincount(cell[rng.integers(0, n, n)], minlength=4) for _ in range(rounds)])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "round": np.arange(rounds), "tp": got[:, 3], "fp": got[:, 1], "tn": got[:, 0], "fn": got[:, 2]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys) + ", round long, tp long, fp long, tn long, fn long"
    drawn = rows.groupBy(*keys).applyInPandas(draw, schema).withColumns({m: c for m, c in rates(policy).items() if m in metrics})
    return _percentiles(drawn, by, metrics)


def arithmetic_index(round_: Column, position: Column, n: Column) -> Column:
    """A fixed index below n for a round and a position."""
    return F.pmod((round_ + 1) * 7_919 + position * (round_ * 2 + 104_729) + F.pmod(position * position, F.lit(1_009)) * 31, n)


PIECE, DRAWS = 32_000_000, 10_000_000  # most rows of a group that a task holds (a byte each), and draws it makes at least


def bootstrap_gather(predictions: DataFrame, by: Sequence[str] = ("model_name", "subset"), *, order: str = "id", rounds: int = 1_000, metrics: Sequence[str] = METRICS, piece: int = PIECE, draws: int = DRAWS) -> DataFrame:
    """Rows drawn by gathering rows by index, with the arithmetic stream.

    Rows are sorted in range partitions and leave them as runs of one byte each, the cell of the row.
    A task has one piece of a group's bytes (all of them, up to `piece` rows) and some of the rounds,
    and counts what the indices of all positions find in it. Work is rows times rounds, but nothing is
    written per draw: `bootstrap` has the same distribution at a cost that does not depend on the rows."""
    keys = list(by)
    rows = predictions.select(*keys, order, (indicator(F.col("gold_label")) * 2 + indicator(F.col("pred_label"))).cast("int").alias("_cell")).dropna(subset=keys)
    placed = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).select(*keys, "_cell", F.spark_partition_id().alias("_part"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def pack(batches):
        at = 0
        for pdf in batches:
            for key, run in pdf.groupby(keys, sort=False, dropna=False):
                at += 1
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "_part": [run["_part"].iloc[0]], "_at": [at], "_n": [len(run)], "_cells": [run["_cell"].to_numpy(np.uint8).tobytes()]})

    w = Window.partitionBy(*keys)
    runs = placed.mapInPandas(pack, f"{named}, _part int, _at long, _n long, _cells binary")
    runs = runs.withColumn("_first", F.coalesce(F.sum("_n").over(w.orderBy("_part", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_n").over(w)).where("_size > 1")
    tasks = 4 * predictions.sparkSession.sparkContext.defaultParallelism
    slices = F.least(F.lit(tasks), F.lit(rounds), F.ceil(F.col("_size") * rounds / draws)).cast("int")
    parts = runs.withColumn("_slices", slices).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).withColumn("_piece", F.floor(F.col("_first") / piece))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_first")
        n, lo, at, slices = (int(pdf[c].iloc[0]) for c in ("_size", "_first", "_slice", "_slices"))
        chosen = range(rounds * at // slices, rounds * (at + 1) // slices)
        got = _gathered(np.frombuffer(b"".join(pdf["_cells"]), np.uint8), n, lo, chosen)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "round": np.arange(chosen.start, chosen.stop), "tp": got[:, 3], "fp": got[:, 1], "tn": got[:, 0], "fn": got[:, 2]})

    spread = parts.repartition(tasks, *keys, "_slice", "_piece").groupBy(*keys, "_slice", "_piece")
    found = spread.applyInPandas(draw, f"{named}, round long, tp long, fp long, tn long, fn long")
    counts = found.groupBy(*keys, "round").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
    return _percentiles(counts.withColumns({m: c for m, c in rates().items() if m in metrics}), keys, metrics)


def _gathered(cells: np.ndarray, n: int, lo: int, rounds: range, block: int = 16_384) -> np.ndarray:
    """(rounds, 4): how often each round's indices, of all positions of a group of n rows, find each of the
    values 0 to 3 in `cells`, which are the group's rows from `lo` on. From one round to the next an index
    grows by 7919 + 2 * position, so it is carried on without a division."""
    out, whole = np.zeros((len(rounds), 4), np.int64), len(cells) == n
    cells, r, size = np.append(cells, np.uint8(4)), rounds.start, np.uint64(n)
    for start in range(0, n, block):
        pos = np.arange(start, min(n, start + block), dtype=np.int64)
        index = (((r + 1) * 7_919 + pos * (r * 2 + 104_729) + (pos % 1_009) ** 2 % 1_009 * 31) % n).view(np.uint64)
        step = ((7_919 + 2 * pos) % n).view(np.uint64)
        less, inside, found = np.empty_like(index), np.empty_like(index), np.empty(len(pos), np.uint8)
        for k in range(len(rounds)):
            at = index
            if not whole:  # what lies before wraps around, and is as far off as what lies behind
                at = np.minimum(np.subtract(index, np.uint64(lo), out=inside), np.uint64(len(cells) - 1), out=inside)
            np.take(cells, at.view(np.int64), out=found, mode="clip")
            out[k] += [np.count_nonzero(found == v) for v in range(4)]
            np.add(index, step, out=index)
            np.minimum(index, np.subtract(index, size, out=less), out=index)  # below n the difference wraps around
    return out
