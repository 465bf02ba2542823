"""Problem 3: how often every term occurs, and in how many records.

Range-partitioned external sort of (term, record) pairs and a run-length scan. A term is a substring of
given sizes, a word (a run of letters and digits), or the whole value. Substrings of up to three code
points are packed into one long, so sorting compares numbers; other terms are sorted as strings.
Before the shuffle each task merges the pairs of one term it holds at the time into one entry (least
record, occurrences, records), so a term that most records hold moves a few entries per task; the
range is cut by term and record, so such a term may span several partitions, whose partial runs are
summed at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.arrow import over_batches
from titleforge.llm.codepoints import from_codepoints, letters_and_digits, row_of, to_codepoints
from titleforge.session import cut_lineage, tasks_for

FLUSH = 2_000_000  # pairs a task holds before it writes entries
PART = (1 << 21) - 1


def packed_terms(points: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of every substring of the given sizes, at most 3 code points; order as of the texts."""
    row = row_of(offsets)
    terms, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sizes:
        if len(points) < size:
            continue
        end = len(points) - size + 1
        value = np.zeros(end, np.int64)
        for k in range(3):
            value = value << 21 | (points[k : k + end] + 1 if k < size else 0)
        whole = row[:end] == row[size - 1 :]
        terms.append(value[whole])
        rows.append(row[:end][whole])
    return np.concatenate(terms), np.concatenate(rows)


def unpacked(terms: np.ndarray) -> pa.Array:
    """The strings of packed terms."""
    parts = np.stack([terms >> 42 & PART, terms >> 21 & PART, terms & PART], axis=1)
    there = parts > 0
    return from_codepoints((parts - 1)[there], np.concatenate([[0], np.cumsum(there.sum(1))]))


def cut_terms(points: np.ndarray, offsets: np.ndarray, unit: str, sizes: tuple[int, ...]) -> tuple[pa.Array, np.ndarray]:
    """(term, row) of every substring of the given sizes, every word, or every whole value, as strings."""
    row = row_of(offsets)
    if unit == "values":
        starts, lengths, rows = offsets[:-1], np.diff(offsets), np.arange(len(offsets) - 1)
    elif unit == "words":
        inside = letters_and_digits()[points]
        edge = np.ones(len(points), bool)
        edge[1:] = row[1:] != row[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        last[:-1] &= ~inside[1:] | edge[1:]
        starts = np.flatnonzero(first)
        lengths, rows = np.flatnonzero(last) + 1 - starts, row[starts]
    else:
        parts = [np.flatnonzero(row[: len(points) - k + 1] == row[k - 1 :]) for k in sizes]
        starts, lengths = np.concatenate([np.zeros(0, np.int64), *parts]), np.repeat(np.array(sizes, np.int64), [len(x) for x in parts])
        rows = row[starts]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
    return from_codepoints(points[at], np.concatenate([[0], ends])), rows


def _merged(terms: np.ndarray | pa.Array, records: np.ndarray) -> pa.RecordBatch:
    """One entry per term of the pairs: its least record, occurrences and records."""
    names = None
    if not isinstance(terms, np.ndarray):
        coded = terms.dictionary_encode()
        names, terms = coded.dictionary, coded.indices.to_numpy()
    order = np.lexsort((records, terms))
    terms, records = terms[order], records[order]
    first = np.concatenate([[True], terms[1:] != terms[:-1]])
    fresh = first | np.concatenate([[True], records[1:] != records[:-1]])
    at = np.flatnonzero(first)
    term = pa.array(terms[at]) if names is None else names.take(pa.array(terms[at]))
    return pa.RecordBatch.from_pydict({"term": term, "record": records[at], "occurrences": np.diff(np.append(at, len(terms))), "records": np.add.reduceat(fresh.astype(np.int64), at)})


def _entries(unit: str, sizes: tuple[int, ...], packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray | pa.Array, np.ndarray]] = []
        count = 0

        def entries() -> pa.RecordBatch:
            terms, records = zip(*held)
            return _merged(np.concatenate(terms) if packed else pa.concat_arrays(terms), np.concatenate(records))

        for batch in batches:
            points, offsets, _ = to_codepoints(batch.column(1))
            terms, rows = packed_terms(points, offsets, sizes) if packed else cut_terms(points, offsets, unit, sizes)
            if len(rows):
                held.append((terms, np.asarray(batch.column(0))[rows]))
                count += len(rows)
            if count >= FLUSH:
                yield entries()
                held, count = [], 0
        if count:
            yield entries()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over runs of equal terms of a sorted partition; the open run is carried from batch to batch."""
    names = ["term", "occurrences", "records"]
    open_run: tuple[pa.Array, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        term, occ, rec = batch.column(0), np.asarray(batch.column(2)), np.asarray(batch.column(3))
        change = np.ones(len(term), bool)
        change[1:] = np.asarray(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))
        at = np.flatnonzero(change)
        term, occ, rec = term.take(pa.array(at)), np.add.reduceat(occ, at), np.add.reduceat(rec, at)
        if open_run and open_run[0][0] == term[0]:
            occ[0] += open_run[1]
            rec[0] += open_run[2]
        elif open_run:
            yield pa.RecordBatch.from_arrays([open_run[0], pa.array([open_run[1]]), pa.array([open_run[2]])], names=names)
        open_run = term.slice(len(term) - 1), int(occ[-1]), int(rec[-1])
        if len(term) > 1:
            yield pa.RecordBatch.from_arrays([term.slice(0, len(term) - 1), pa.array(occ[:-1]), pa.array(rec[:-1])], names=names)
    if open_run:
        yield pa.RecordBatch.from_arrays([open_run[0], pa.array([open_run[1]]), pa.array([open_run[2]])], names=names)


def term_counts(
    titles: DataFrame, *, id_col: str = "title_id", text: str = "title", unit: str = "characters", sizes: tuple[int, ...] = (2, 3), rare_below: int = 3, common_above: float = 0.05, only_marked: bool = False
) -> DataFrame:
    """(term, occurrences, records, mark) of every term: with unit `characters` every substring of the given
    sizes in code points (any sizes from 1 on), with `words` every run of letters and digits, with
    `values` every whole text.

    A record is a distinct id (null is none) with a text that is not null; of an id that came again with other texts
    the least text counts. mark is `rare` below `rare_below` records, `common` above the share
    `common_above` of the records, else null. Texts are taken as stored. Empty texts count as records
    without substrings and words; an empty table gives no rows."""
    if unit not in ("characters", "words", "values") or min(sizes) < 1:
        raise ValueError("terms are characters of positive sizes, words or values")
    packed = unit == "characters" and max(sizes) <= 3
    kind = "long" if packed else "string"
    rows = titles.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    once = cut_lineage(rows.repartition(tasks_for(rows), "id").groupBy("id").agg(F.min("text").alias("text")))
    total = once.count()
    entries = cut_lineage(once.mapInArrow(_entries(unit, sizes, packed), f"term {kind}, record long, occurrences long, records long"))
    ordered = entries.repartitionByRange("term", "record").sortWithinPartitions("term", "record")
    runs = ordered.mapInArrow(_runs, f"term {kind}, occurrences long, records long")
    sums = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
    marked = sums.withColumn("mark", mark)
    if only_marked:
        marked = marked.where("mark is not null")
    if not packed:
        return marked.select("term", "occurrences", "records", "mark")
    return over_batches(
        marked, lambda b: {"term": unpacked(np.asarray(b.column(0))), "occurrences": b.column(1), "records": b.column(2), "mark": b.column(3)}, "term string, occurrences long, records long, mark string"
    )


def marked_terms(titles: DataFrame) -> DataFrame:
    """p3_found: (term, mark) of the terms of two or three code points that are too rare or too common."""
    return term_counts(titles, only_marked=True).select("term", "mark")
