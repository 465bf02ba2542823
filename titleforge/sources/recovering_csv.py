"""Problem 7: separated values that do not all parse.

A recursive-descent grammar (file: record*, record: field (',' field)*, field: quoted | bare) reads
records with the place of every syntax error. Rows cut record by record are read each for itself.

Whole files are read in ranges of lines. After a broken quote reading resumes at the next validated
record start: a line from which a record of the header's width and with valid values parses. A task
cannot know whether its range begins at a record, inside one, or behind a fault, so it reads it for
all three; the three readings soon meet, and what they share is parsed once. When the ranges are
stitched, one row per range tells which reading holds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.session import cut_lineage

# Texts that stand for a missing value, and the labels.
NO_VALUE = ("", "NA", "null", "nan")
LABELS = ("Yes", "No")


@dataclass(frozen=True)
class Fault:
    """A record that does not load: why, and where in the text."""

    reason: str
    at: int


class BrokenQuote(Exception):
    def __init__(self, at: int) -> None:
        super().__init__(f"broken quote at {at}")
        self.at = at


class Grammar:
    """Reads records; `ends_at_line` says whether a line break outside quotes ends a record."""

    def __init__(self, *, delimiter: str = ",", quote: str = '"', ends_at_line: bool) -> None:
        d, q = re.escape(delimiter), re.escape(quote)
        self.delimiter, self.quote, self.ends_at_line = delimiter, quote, ends_at_line
        self._quoted = re.compile(f"{q}([^{q}]*(?:{q}{q}[^{q}]*)*+){q}")
        self._bare = re.compile(f"[^{d}\r\n]*" if ends_at_line else f"[^{d}]*")
        self._line_end = re.compile("\r\n|\n|\r")
        self._rest = re.compile(f"[^{q}]*(?:{q}{q}[^{q}]*)*+{q}")

    def field(self, text: str, at: int) -> tuple[str, int]:
        """The field that begins at `at` and where it ends."""
        if text.startswith(self.quote, at):
            m = self._quoted.match(text, at)
            if m is None or not self._stops(text, m.end()):
                raise BrokenQuote(at if m is None else m.end())
            return m[1].replace(self.quote * 2, self.quote), m.end()
        m = self._bare.match(text, at)
        if (inner := m[0].find(self.quote)) >= 0:
            raise BrokenQuote(at + inner)
        return m[0], m.end()

    def _stops(self, text: str, at: int) -> bool:
        return at == len(text) or text.startswith(self.delimiter, at) or (self.ends_at_line and text[at] in "\r\n")

    def record(self, text: str, at: int = 0) -> tuple[list[str], int]:
        """The fields of the record that begins at `at`, and where the text goes on behind it."""
        values = []
        while True:
            value, at = self.field(text, at)
            values.append(value)
            if not text.startswith(self.delimiter, at):
                break
            at += len(self.delimiter)
        if self.ends_at_line and (m := self._line_end.match(text, at)):
            at = m.end()
        return values, at

    def walk(self, line: str, inside: bool = False) -> tuple[str, int, int]:
        """What a line makes of a record that begins with it or, with `inside`, is in a quoted field before it:
        (`end`, fields closed, length), (`open`, fields closed, place of the open quote) or (`broken`, 0, place)."""
        fields = at = 0
        if inside:
            m = self._rest.match(line)
            if m is None:
                return "open", 0, 0
            fields, at = 1, m.end()
            if not self._stops(line, at):
                return "broken", 0, at
            if not line.startswith(self.delimiter, at):
                return "end", fields, at
            at += len(self.delimiter)
        while True:
            if line.startswith(self.quote, at) and self._quoted.match(line, at) is None:
                return "open", fields, at
            try:
                at = self.field(line, at)[1]
            except BrokenQuote as broken:
                return "broken", 0, broken.at
            fields += 1
            if not line.startswith(self.delimiter, at):
                return "end", fields, at
            at += len(self.delimiter)


class Run:
    """The lines of one file that a range holds, and those behind it that its last record may need.

    `beyond` says how a record ends that is open behind the last line known: None where the file ends."""

    def __init__(self, lines: list[str], ahead: list[str], names: Sequence[str], beyond: tuple[int, int] | None = None) -> None:
        self.lines, self.own, self.names, self.beyond = lines + ahead, len(lines), names, beyond
        self.grammar = Grammar(ends_at_line=True)
        quote = self.grammar.quote
        # the lines at which an open field may close; others only prolong it
        self.after = [0] * (len(self.lines) + 1)
        self.after[-1] = len(self.lines)
        for i in range(len(self.lines) - 1, -1, -1):
            self.after[i] = i if quote in self.lines[i] else self.after[i + 1]
        self.known: dict[int, tuple[str, int, int, int]] = {}

    def closes(self, i: int) -> tuple[str, int, int, int]:
        """How a field that is open before line i ends: (state, fields, last line, place)."""
        fields = 0
        while (i := self.after[i]) < len(self.lines):
            state, more, at = self.grammar.walk(self.lines[i], True)
            fields += more
            if state != "open":
                return state, fields, i, at
            i += 1
        return "open", fields, len(self.lines), 0

    def record(self, i: int) -> tuple[str, int, int, int]:
        """The record that begins with line i: (`end` or `broken`, fields, last line, place of the fault).

        A line at which an earlier record stays open has an even number of quotes, so no record that
        begins with it is open behind it: no line is walked again and again."""
        if i not in self.known:
            state, fields, at = self.grammar.walk(self.lines[i])
            last = i
            if state == "open":
                state, more, last, place = self.closes(i + 1)
                fields += more
                if state == "open":
                    state, last, place = "broken", *((i, at) if self.beyond is None else (last + self.beyond[0] - 1, self.beyond[1]))
                at = place
            self.known[i] = state, fields, last, at
        return self.known[i]

    def values(self, i: int) -> list[str]:
        return self.grammar.record("".join(self.lines[i : self.record(i)[2] + 1]))[0]

    def is_start(self, i: int) -> bool:
        """Whether line i is a validated record start."""
        state, fields, _, _ = self.record(i)
        return state == "end" and fields == len(self.names) and value_fault(self.names, self.values(i)) is None

    def read(self, at: int, lost: bool) -> Iterator[tuple[int, bool, tuple[int, list[str] | None, str | None, int, int] | None]]:
        """From line `at` on, for each step: (line, whether behind a fault, what comes out), and last where
        the reading leaves the range. Out come (line, values, reason, lines to the fault, place)."""
        while at < self.own:
            if lost:
                if self.is_start(at):
                    lost = False
                else:
                    yield at, True, None
                    at += 1
                continue
            state, fields, last, place = self.record(at)
            if state == "broken":
                yield at, False, (at, None, "quoting", last - at, place)
                at, lost = at + 1, True
                continue
            if fields != len(self.names):
                out = (at, None, "columns", 0, 0)
            else:
                values = self.values(at)
                fault = value_fault(self.names, values)
                out = (at, None, fault, 0, 0) if fault else (at, values, None, 0, 0)
            yield at, False, out
            at = last + 1
        yield at, lost, None


def header_fields(header: str | None) -> list[str]:
    """Column names of a header line; a byte-order mark is no part of a name."""
    if header is None:
        return []
    try:
        return [x.strip() for x in Grammar(ends_at_line=False).record(header.lstrip("﻿"))[0]]
    except BrokenQuote:
        return []


def value_fault(names: Sequence[str], values: Sequence[str]) -> str | None:
    """`value` if the title is missing or the label is not exactly one of the labels."""
    named = dict(zip(reversed(names), reversed(values)))
    return None if named.get("title", "").strip() not in NO_VALUE and named.get("label", "").strip() in LABELS else "value"


OUT = T.StructType([T.StructField(n, k) for n, k in (("title", T.StringType()), ("label", T.StringType()), ("account", T.StringType()), ("reason", T.StringType()), ("error_at", T.IntegerType()))])


def parse_lines(lines: DataFrame, files: DataFrame, *, raw: str = "raw", file_id: str = "file_id", header: str = "header", keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Every row of `lines` read under its file's header: the kept columns, title, label, account,
    reason and error_at.

    reason is null for a valid row, else the first that holds of `quoting`, `columns`, `value`;
    error_at is the offset of the fault in the row (0 for columns and value). Faulty rows have no
    values. Values are stripped of Unicode white space. A null row, and a row of a file without a
    header, has the wrong columns; the columns of `lines` and `files` never clash, as only the named
    ones are used. Row order is not kept; an empty table gives no rows."""
    grammar = Grammar(ends_at_line=False)
    names: dict[str | None, list[str]] = {}
    heads = files.groupBy(F.col(file_id).alias("_file")).agg(F.min(header).alias("_header"))
    joined = lines.select(F.col(raw).cast("string").alias("_raw"), F.col(file_id).alias("_file"), *keep).join(heads, "_file", "left").select("_raw", "_header", *keep)

    def one(text: str | None, head: str | None) -> tuple[str | None, str | None, str | None, str | None, int | None]:
        if head not in names:
            names[head] = header_fields(head)
        columns = names[head]
        if text is None:
            return None, None, None, "columns", 0
        try:
            values, _ = grammar.record(text)
        except BrokenQuote as broken:
            return None, None, None, "quoting", broken.at
        if len(values) != len(columns):
            return None, None, None, "columns", 0
        if fault := value_fault(columns, values):
            return None, None, None, fault, 0
        named = dict(zip(reversed(columns), reversed(values)))
        return named["title"].strip(), named["label"].strip(), named["account"].strip() if "account" in named else None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [one(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*read)) if read else [[]] * len(OUT)
            kinds = [pa.string()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([*(batch.column(2 + k) for k in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, *OUT.names])

    return joined.mapInArrow(run, T.StructType([*lines.select(*keep).schema.fields, *OUT.fields]))


START, INSIDE, LOST = 0, 1, 2  # how a range may begin: at a record, in one from before, behind a fault
READ = "_part int, _mask int, _line long, error_line long, exits array<int>"


def recover(lines: DataFrame, *, file: str, order: Sequence[str], text: str = "text", header: str = "header", keep: Sequence[str] = (), ranges: int | None = None, most_ahead: int = 32 << 20) -> DataFrame:
    """Files given as lines (with their line ends) to records and located faults: the columns `keep` of a
    record's first line, title, label, account, reason, error_line, error_at.

    A record may span any number of lines; `order` sorts the lines of a file. reason is null for a
    valid record, else `quoting`, `columns` or `value`; a broken quote is located by error_line, the lines
    from the record's first to the fault, and error_at, the offset in it (0 for the other faults). From a
    broken quote to the next validated record start everything is one fault. Lines are sorted once into
    ranges, `ranges` of them if given, whatever their files; a file of a third of all rows is read by
    many tasks. Null lines count as empty ones; lines without a header have wrong columns; an empty
    table gives no rows. Lines behind a range that its last record needs are sent to its task if they
    are at most `most_ahead` bytes in all; else the lines are shuffled once more."""
    spark = lines.sparkSession
    chosen = lines.select(F.col(file).cast("string").alias("_file"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.col(header).cast("string").alias("_header"), *order, *(c for c in keep if c not in order))
    by = ["_file", *order]
    placed = chosen.repartitionByRange(ranges, *by) if ranges else chosen.repartitionByRange(*by)
    placed = cut_lineage(placed.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))  # written, so that ranges stay
    grammar = Grammar(ends_at_line=True)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per range: its first and last file, how a field open before it ends, and whether one may be open behind it."""
        first = last = None
        state, fields, at, count, spill, one = "open", 0, 0, 0, False, True
        for batch in batches:
            for part, name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if count == 0:
                    first, number = name, part
                elif name != last:
                    spill = False
                    if one and state == "open":
                        state = "ended"
                    one = False
                last = name
                if one and state == "open":
                    state, more, at = grammar.walk(line, True)
                    fields, ends = fields + more, count
                if grammar.quote in line:
                    spill = grammar.walk(line)[0] == "open" or (spill and grammar.walk(line, True)[0] == "open")
                count += 1
        if count:
            yield pa.RecordBatch.from_pydict({"part": [number], "first": pa.array([first], pa.string()), "last": pa.array([last], pa.string()), "one": [one], "state": [state], "ends": [ends if state in ("end", "broken") else count], "at": [at], "count": [count], "spill": [spill]})

    rows = sorted(placed.select("_part", "_file", "_text").mapInArrow(heads, "part long, first string, last string, one boolean, state string, ends long, at long, count long, spill boolean").collect())  # one per range
    wanted: list[tuple[int, int, int]] = []  # (range that asks, range that gives, its first lines)
    beyond: dict[int, tuple[int, int]] = {}
    for k, row in enumerate(rows):
        passed, gives = 0, []
        for then in rows[k + 1 :] if row.spill else ():
            if then.first != row.last or then.state == "ended":
                break
            if then.state == "end":
                wanted += [*gives, (row.part, then.part, then.ends + 1)]
                break
            if then.state == "broken":
                beyond[row.part] = passed + then.ends + 1, then.at
                break
            passed += then.count
            gives.append((row.part, then.part, then.count))
            if not then.one:
                break
    give: dict[int, list[tuple[int, int]]] = {}
    for ask, giver, n in wanted:
        give.setdefault(giver, []).append((ask, n))

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else None
            for ask, n in give.get(part, ()):
                if count < n:
                    some = batch.slice(0, n - count)
                    yield pa.RecordBatch.from_pydict({"_part": pa.array([ask] * some.num_rows, pa.int32()), "_from": some.column(0), "_at": pa.array(range(count, count + some.num_rows), pa.int64()), "_text": some.column(1)})
            count += batch.num_rows

    ahead: dict[int, list[str]] = {}
    source, names = placed.withColumn("_from", F.lit(None).cast("int")).withColumn("_at", F.lit(None).cast("long")), list(dict.fromkeys([*order, *keep]))
    if wanted:
        lent = cut_lineage(placed.select("_part", "_text").mapInArrow(lend, "_part int, _from int, _at long, _text string"))
        if lent.agg(F.sum(F.octet_length("_text"))).first()[0] <= most_ahead:
            for r in sorted(lent.collect()):
                ahead.setdefault(r["_part"], []).append(r["_text"])
        else:
            source = source.unionByName(lent, allowMissingColumns=True).repartitionById(rows[-1].part + 1, "_part").sortWithinPartitions("_part", F.col("_from").asc_nulls_first(), "_at", *by)
    own = {r.part: r for r in rows}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), _arrow(columns))
        if not held.num_rows:
            return
        part = held.column("_part")[0].as_py()
        mine = held.column("_from").is_null() if held.column("_from").null_count < held.num_rows else None
        later = [] if mine is None else held.filter(pa.compute.invert(mine)).column("_text").to_pylist()
        held = held if mine is None else held.filter(mine)
        files, texts, headers = (held.column(c).to_pylist() for c in ("_file", "_text", "_header"))
        starts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        out: list[tuple[int, int, list[str], tuple[int, list[str] | None, str | None, int, int]]] = []
        exits = [START, INSIDE, LOST]
        for k, (low, high) in enumerate(zip(starts, starts[1:])):
            final = high == len(files)
            run = Run(texts[low:high], ahead.get(part, later) if final else [], header_fields(headers[low]), beyond.get(part) if final else None)
            base = run.read(0, False)
            steps = list(base)
            index = {(at, lost): n for n, (at, lost, _) in enumerate(steps)}
            leaves = [exit_of(run, steps[-1])] * 3
            masks = [7 if k else 1 << START] * len(steps)
            if not k:
                head = own[part]
                first = {LOST: (0, True)} | ({INSIDE: (head.ends + 1, False)} if head.state == "end" else {})
                for mode, entry in first.items():
                    for step in run.read(*entry):
                        if (n := index.get(step[:2])) is not None:
                            for m in range(n, len(steps)):
                                masks[m] |= 1 << mode
                            leaves[mode] = leaves[START]
                            break
                        if step[2]:
                            out.append((low, 1 << mode, run.names, step[2]))
                        leaves[mode] = exit_of(run, step)
                if head.state != "end":
                    leaves[INSIDE] = INSIDE if final else START
            exits = leaves if final else exits
            out += [(low, m, run.names, step[2]) for m, step in zip(masks, steps) if step[2]]
        first_lines = pa.array([low + o[0] for low, _, _, o in out], pa.int64())
        named = [dict(zip(reversed(n), reversed(o[1]))) if o[1] else {} for _, _, n, o in out]
        yield from pa.Table.from_arrays(
            [
                pa.array([part] * len(out), pa.int32()), pa.array([m for _, m, _, _ in out], pa.int32()), first_lines, pa.array([o[3] if o[2] else None for *_, o in out], pa.int64()), pa.nulls(len(out), pa.list_(pa.int32())),
                *(held.column(c).take(first_lines) for c in names), *(pa.array([n[c].strip() if c in n else None for n in named], pa.string()) for c in ("title", "label", "account")),
                pa.array([o[2] for *_, o in out], pa.string()), pa.array([o[4] if o[2] else None for *_, o in out], pa.int32()),
            ],
            schema=_arrow(schema),
        ).to_batches()
        yield from pa.Table.from_pylist([{"_part": part, "exits": exits}], schema=_arrow(schema)).to_batches()

    columns = source.schema
    kept_columns = [T.StructField(f"_k{k}", f.dataType) for k, f in enumerate(lines.select(*names).schema.fields)]
    schema = T.StructType([*T._parse_datatype_string(READ).fields, *kept_columns, *OUT.fields])
    read = cut_lineage(source.mapInArrow(parse, schema))
    left = {r["_part"]: r.exits for r in read.where("exits is not null").select("_part", "exits").collect()}  # one per range
    entry, bits, before = START, [], None
    for row in rows:
        entry = entry if before == row.first else START
        bits.append((row.part, 1 << entry))
        entry, before = left[row.part][entry], row.last
    holds = spark.createDataFrame(bits, "_part int, _bit int")
    kept = read.where("exits is null").join(F.broadcast(holds), "_part").where(F.col("_mask").bitwiseAND(F.col("_bit")) != 0)
    return kept.select(*(F.col(f"_k{names.index(c)}").alias(c) for c in keep), *(c for c in OUT.names if c != "error_at"), "error_line", "error_at")


def exit_of(run: Run, step: tuple[int, bool, object]) -> int:
    """How the range behind begins, after the last step of a reading."""
    at, lost, _ = step
    return LOST if lost else INSIDE if at > run.own else START


def with_lines(df: DataFrame, text: str) -> DataFrame:
    """Each row as its lines, with their ends: `_line` from 0 and `_text`."""
    return df.select("*", F.posexplode(F.split(text, r"(?<=\n)|(?<=\r)(?!\n)")).alias("_line", "_text"))


def parse_files(files: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("file_name",), ranges: int | None = None) -> DataFrame:
    """Whole files (first line: header) to records and located faults: the kept columns, line_no,
    title, label, account, reason, error_line, error_at. Null and empty files give none; files with
    the same kept columns stay apart."""
    named = files.where(F.length(text) > 0).select(F.struct(*keep).alias("_keep"), F.ltrim(F.col(text), F.lit("\ufeff")).alias("_body")).withColumn("_name", F.monotonically_increasing_id())
    lines = with_lines(cut_lineage(named).select("_name", "_keep", "_body"), "_body")
    header = F.regexp_replace(F.regexp_extract("_body", r"^[^\r\n]*", 0), r"[\r\n]", "")
    body = lines.select("_name", "_keep", (F.col("_line") + 1).cast("long").alias("line_no"), "_text", header.alias("_head")).where("line_no > 1 and _text <> ''")
    got = recover(body, file="_name", order=["line_no"], text="_text", header="_head", keep=["_keep", "line_no"], ranges=ranges)
    return got.select("_keep.*", *(c for c in got.columns if c != "_keep"))


def recovered_rows(lines: DataFrame, files: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """`lines` (row_id, file_id, line_no, raw) put together to their files and read as such: row_id of a
    record's first line, title, label, account, reason, error_line, error_at."""
    heads = files.groupBy("file_id").agg(F.min("header").alias("_header"))
    each = lines.select("row_id", "file_id", "line_no", F.concat(F.coalesce("raw", F.lit("")), F.lit("\n")).alias("_raw")).join(heads, "file_id", "left")
    parts = with_lines(each, "_raw").where("_text <> ''").select("row_id", "file_id", "line_no", "_line", "_text", "_header")
    return recover(parts, file="file_id", order=["line_no", "row_id", "_line"], text="_text", header="_header", keep=["row_id"], ranges=ranges)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def failed_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """p7_found: (row_id, reason) of each row that does not load."""
    return parse_lines(lines, files).where("reason is not null").select("row_id", "reason")


def loaded_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The valid rows as columns: row_id, title, label, account."""
    return parse_lines(lines, files).where("reason is null").select("row_id", "title", "label", "account")
