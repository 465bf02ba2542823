"""Problem 4: records that are the same but for formatting are collapsed.

Records are brought to a canonical key, range-partitioned by (key, record) and externally sorted;
a scan of adjacent rows compares full keys. A key that a third of all rows share spans several
partitions: the scan also gives each partition's first and last run, two rows each, and the runs cut
by a partition's edge are joined by these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleforge.session import cut_lineage

FIELDS = ("title", "label", "account", "source")
SCANNED = "record_id long, kept long, copies long, part int, head boolean, edge string"


def canonical(text: Column) -> Column:
    """Letters and digits only, in lower case; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical_key(payload: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The canonical key of a JSON object; of anything else its own letters and digits."""
    parsed = F.from_json(payload, ", ".join(f"`{f}` string" for f in fields), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    whole = F.concat_ws("\x1f", *(canonical(parsed[f]) for f in fields))
    some = F.coalesce(*(parsed[f] for f in fields))
    return F.when(some.isNotNull(), F.concat(F.lit("{"), whole)).otherwise(F.concat(F.lit("~"), canonical(payload)))


def _scan(each_copy: bool):
    """Rows of a partition sorted by (key, record): per copy, or per run, its run's first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()  # type: ignore[union-attr]
        key, first, copies, head = None, 0, 0, True
        opening: tuple[str, int] | None = None

        def out(records: np.ndarray | None, kept: np.ndarray, counts: np.ndarray, heads: np.ndarray, edge: str | None = None) -> pa.RecordBatch:
            n = len(kept)
            return pa.RecordBatch.from_arrays(
                [pa.array(records) if records is not None else pa.nulls(n, pa.int64()), pa.array(kept), pa.array(counts), pa.array(np.full(n, part, np.int32)), pa.array(heads), pa.array([edge] * n, pa.string())],
                names=["record_id", "kept", "copies", "part", "head", "edge"],
            )

        def one(value: int, count: int, is_head: bool, edge: str | None = None) -> pa.RecordBatch:
            return out(None, np.array([value]), np.array([count]), np.array([is_head]), edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0), np.asarray(batch.column(1))
            change = np.ones(len(ids), bool)
            change[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
            change[0] = key is None or keys[0].as_py() != key
            at = np.flatnonzero(change)
            runs = np.cumsum(change)  # 0: the run that is open from the batch before
            firsts = np.concatenate([[first], ids[at]])
            if opening is None:
                opening = (keys[0].as_py(), int(ids[0]))
                heads = np.arange(len(firsts)) <= 1
            else:
                heads = np.concatenate([[head], np.zeros(len(at), bool)])
            if each_copy:
                yield out(ids, firsts[runs], np.ones(len(ids), np.int64), heads[runs])
            else:
                counts = np.bincount(runs, minlength=len(firsts))
                counts[0] += copies
                done = slice(0 if key is not None else 1, len(firsts) - 1)
                if len(firsts[done]):
                    yield out(None, firsts[done], counts[done], heads[done])
                copies = int(counts[-1])
            key, first, head = keys[-1].as_py(), int(firsts[-1]), bool(heads[-1])
        if opening is not None:
            if not each_copy:
                yield one(first, copies, head)
            yield one(opening[1], 0, True, opening[0])
            yield one(first, 0, head, key)

    return run


def _scanned(records: DataFrame, id_col: str, payload: str, each_copy: bool) -> DataFrame:
    """(record_id, kept, copies) with the runs across partition edges joined."""
    keyed = records.where(F.col(payload).isNotNull() & F.col(id_col).isNotNull()).select(canonical_key(F.col(payload)).alias("key"), F.col(id_col).cast("long").alias("id"))
    ordered = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    rows = cut_lineage(ordered.mapInArrow(_scan(each_copy), SCANNED))
    edges = rows.where("edge is not null")
    # at most two rows per partition, whatever the data
    least = edges.groupBy("edge").agg(F.min("kept").alias("whole"), F.collect_set(F.when(F.col("head"), F.col("part"))).alias("parts"))
    fixed = least.select(F.explode("parts").alias("part"), "whole")
    return rows.where("edge is null").join(F.broadcast(fixed), "part", "left").select("record_id", F.when(F.col("head"), F.col("whole")).otherwise(F.col("kept")).alias("kept_id"), "copies")


def copy_pairs(records: DataFrame, *, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """p4_found: (kept_id, copy_id) of every record but the first of its set of same records.

    Two records are the same if all fields agree by name when only letters and digits count, without
    case; a missing or null field is as an empty one. A payload that is no object is compared whole.
    Null payloads and null ids are left out; repeated ids count once; an empty table gives no rows."""
    return _scanned(records, id_col, payload, True).where("record_id <> kept_id").select("kept_id", F.col("record_id").alias("copy_id")).distinct()


def collapsed(records: DataFrame, *, id_col: str = "record_id", payload: str = "payload") -> DataFrame:
    """(kept_id, copies): one representative, the smallest id, per set of same records, and its exact number of rows."""
    return _scanned(records, id_col, payload, False).groupBy("kept_id").agg(F.sum("copies").alias("copies"))
