"""Problem 1: text that was decoded with the wrong character encoding.

A hidden Markov model with one clean state and one state per encoding pair labels the characters of
each title; each labelled span gets its state's inverse transform. The clean state's emissions are
the character counts of the whole benchmark; a pair's are learned from a bounded sample of benchmark
titles put through the pair. Viterbi runs over padded code-point blocks; rows whose characters cannot
pay for leaving the clean state, by an upper bound, are settled without it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.arrow import bounded_sample, bucket_counts
from titleforge.llm.codepoints import SIZE, to_codepoints

TOP = 0x10000  # planes above the first share one emission
LOSS = "�"
CELLS = 1 << 18  # characters of a block, padding included


@dataclass(frozen=True)
class Pair:
    """Text written in `true` and read as `wrong`, `times` times over."""

    true: str
    wrong: str
    times: int = 1

    def garble(self, text: str) -> list[str]:
        """What the pair makes of a text, under each way a decoder treats bytes it doesn't know."""
        out = []
        for errors in ("keep", "replace", "ignore"):
            now = text
            for _ in range(self.times):
                now = _read(now.encode(self.true, "replace"), self.wrong, errors)
            out.append(now)
        return list(dict.fromkeys(out))

    def restore(self, text: str) -> str:
        """The inverse; what can't be had back becomes U+FFFD."""
        for _ in range(self.times):
            text = _bytes(text, self.wrong).decode(self.true, "replace")
        return text


def _read(raw: bytes, encoding: str, errors: str) -> str:
    if errors != "keep":
        return raw.decode(encoding, errors)
    out, at = [], 0
    while at < len(raw):  # bytes without a meaning stand as control characters
        try:
            out.append(raw[at:].decode(encoding))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode(encoding))
            out.append(raw[at + e.start : at + e.start + 1].decode("latin-1") if encoding.startswith("cp12") else LOSS)
            at += e.start + 1
    return "".join(out)


def _bytes(text: str, encoding: str) -> bytes:
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            out += bytes([ord(ch)]) if ord(ch) < 0x100 else b"\xff"
    return bytes(out)


# The encoding pairs, one state each.
PAIRS = (
    Pair("utf-8", "latin-1"),
    Pair("utf-8", "cp1252"),
    Pair("utf-8", "cp1252", 2),
    Pair("utf-8", "latin-1", 2),
    Pair("utf-8", "cp1251"),
    Pair("utf-8", "gb18030"),
    Pair("utf-8", "big5"),
    Pair("utf-8", "cp932"),
    Pair("utf-8", "cp949"),
    Pair("gb18030", "cp1252"),
    Pair("gb18030", "utf-8"),
    Pair("gb18030", "cp949"),
)


class Model:
    """Log emissions of the clean state (0) and the pairs' states (1..), and the transition costs."""

    def __init__(self, clean_counts: np.ndarray, sample: list[str], pairs: tuple[Pair, ...] = PAIRS, *, leave: float = 1e-3, back: float = 0.02, swap: float = 1e-6) -> None:
        self.pairs = pairs
        known = np.minimum(np.arange(SIZE), TOP)
        clean = np.bincount(known, weights=clean_counts, minlength=TOP + 1)
        self.new = clean == 0
        table = [self._emissions(clean)]
        for pair in pairs:
            text = "".join(x for s in sample for x in pair.garble(s))
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            table.append(self._emissions(np.bincount(np.minimum(points, TOP), minlength=TOP + 1).astype(float)))
        self.emit = np.stack(table).astype(np.float32)
        n = len(pairs)
        step = np.full((n + 1, n + 1), np.log(swap))
        step[0, 1:], step[1:, 0] = np.log(leave / n), np.log(back)
        np.fill_diagonal(step, np.log(1 - back - swap * n))
        step[0, 0] = np.log(1 - leave)
        self.step = step.astype(np.float32)
        self.gain = np.maximum(self.emit[1:].max(axis=0) - self.emit[0], 0)
        self.price = -float(step[0, 1])

    @staticmethod
    def _emissions(counts: np.ndarray, share: float = 0.98) -> np.ndarray:
        """Counts, backed off to blocks of 128 points and to all points."""
        total = max(counts.sum(), 1.0)
        blocks = np.add.reduceat(counts, np.arange(0, len(counts), 128))
        near = np.repeat(blocks, 128)[: len(counts)] / total / 128
        return np.log(share * counts / total + (1 - share) * (0.9 * near + 0.1 / len(counts)))

    def label(self, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(row, states of its characters) of the rows that hold a span of another state."""
        points = np.minimum(points, TOP)
        sizes = np.diff(offsets)
        rows = np.flatnonzero(sizes)
        if not len(rows):
            return []
        bound = np.zeros(len(sizes))
        bound[rows] = np.add.reduceat(self.gain[points], offsets[:-1][rows])
        rows = np.flatnonzero(bound > self.price)
        out = []
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        at = 0
        while at < len(rows):
            # a block is padded to its longest row, so its cells are bounded, and not only its rows
            padded = sizes[rows[at : at + 512]] * np.arange(1, len(rows[at : at + 512]) + 1)
            some = rows[at : at + max(1, int(np.searchsorted(padded, CELLS, "right")))]
            at += len(some)
            states = self._viterbi(points, offsets[some], sizes[some])
            out += [(int(r), states[k, : sizes[r]]) for k, r in enumerate(some) if states[k, : sizes[r]].any()]
        return out

    def _viterbi(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        longest, count, states = int(sizes.max()), len(sizes), len(self.step)
        start = np.full(states, self.step[0, 1], np.float32)
        start[0] = self.step[0, 0]
        best = start + self.emit[:, points[starts]].T
        came = np.zeros((longest, count, states), np.int8)
        for t in range(1, longest):
            on = sizes > t
            here = points[np.where(on, starts + t, starts)]
            through = best[:, :, None] + self.step
            came[t] = through.argmax(axis=1)
            best = np.where(on[:, None], through.max(axis=1) + self.emit[:, here].T, best)
        path = np.zeros((count, longest), np.int8)
        state = best.argmax(axis=1)
        every = np.arange(count)
        for t in range(longest - 1, -1, -1):
            on = sizes > t
            path[:, t] = np.where(on, state, 0)
            state = np.where(on, came[t][every, state], state)
        return path

    def clean(self, text: str) -> float:
        """Mean log emission of a text under the clean state."""
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), TOP)
        return float(self.emit[0][points].mean()) if len(points) else 0.0

    def _sure(self, span: str, state: int, least_signs: int = 4, least_odds: float = 15.0) -> bool:
        """Whether a span whose bytes were partly dropped can't be clean: several signs that the benchmark never has, far likelier under the pair."""
        points = np.minimum(np.frombuffer(span.encode("utf-32-le", "replace"), np.uint32), TOP)
        points = points[(points > 0x7F) & self.new[points]]
        return len(points) >= least_signs and float((self.emit[state] - self.emit[0])[points].sum()) >= least_odds

    def spans(self, states: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, state) of the runs of states other than clean."""
        at = np.flatnonzero(np.diff(states.astype(np.int16), prepend=-1, append=-1))
        return [(int(a), int(b), int(states[a])) for a, b in zip(at[:-1], at[1:]) if states[a]]

    def repair(self, text: str, states: np.ndarray) -> tuple[str, list[str], bool]:
        """(text with the inverse of each span, the pairs met, whether all came back whole).

        A span counts only if its inverse reads better than the span itself, if it holds the signs of
        a loss that the clean text cannot have, or if it is surely not clean."""
        out, met, whole, at = [], [], True, 0
        spans = self.spans(states)
        main = int(np.bincount(states).argsort()[-1]) or int(np.bincount(states[states > 0]).argmax())
        for begin, end, state in spans:
            pair, span = self.pairs[state - 1], text[begin:end]
            back = pair.restore(span)
            if state != main and LOSS not in (other := self.pairs[main - 1].restore(span)) and other != span:
                pair, back = self.pairs[main - 1], other  # a short span rather has the pair of the rest
            better = self.clean(back.replace(LOSS, "")) - self.clean(span.replace(LOSS, ""))
            real = sum(c != LOSS and ord(c) > 0x7F for c in back)
            lost = back.count(LOSS)
            if not ((real > lost and better > 1.0) or LOSS in span or self._sure(span, state)):
                continue
            out += [text[at:begin], back]
            at = end
            met.append(f"{pair.true}>{pair.wrong}" + f"*{pair.times}" * (pair.times > 1))
            whole &= not lost and LOSS not in span
        return "".join([*out, text[at:]]), met, whole


def fit(benchmark: DataFrame, *, id_col: str = "title_id", text: str = "title", sample: int = 3000, pairs: tuple[Pair, ...] = PAIRS) -> Model:
    """The model of a benchmark table. Character counts cover all of it; the pairs' emissions are
    learned from at most `sample` titles, those of least id hash. Text of encodings that are not among
    `pairs` is found only as far as it looks like one that is."""
    texts = benchmark.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    counts = bucket_counts(texts.select("text"), lambda b: to_codepoints(b.column(0))[0], SIZE)
    picked = [r.text for r in bounded_sample(texts, "id", sample).collect()]
    return Model(counts.astype(float), picked, pairs)


def restored(log: DataFrame, model: Model, *, text: str = "title", keep: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """The rows of `log` with a wrongly decoded span: the kept columns, title, restored, pairs, whole.

    restored has the inverse of every span; what is lost stands as U+FFFD and whole is then false.
    Null and empty titles are never found; no row is moved, so nothing is shuffled; repeated rows
    come out as often as they go in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            points, offsets, _ = to_codepoints(column)
            found = []
            for row, states in model.label(points, offsets):
                title = column[row].as_py()
                back, met, whole = model.repair(title, states)
                if met:
                    found.append((row, title, back, ",".join(dict.fromkeys(met)), whole))
            if found:
                found.sort()
                take = pa.array([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(1 + k).take(take) for k in range(len(keep))), *(pa.array([f[k] for f in found]) for k in range(1, 5))], names=[*keep, "title", "restored", "pairs", "whole"]
                )

    from pyspark.sql import types as T

    chosen = log.select(F.col(text).cast("string").alias("_title"), *keep)
    kept = log.select(*keep).schema.fields
    schema = T.StructType([*kept, T.StructField("title", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("pairs", T.StringType()), T.StructField("whole", T.BooleanType())])
    return chosen.where("_title is not null").mapInArrow(run, schema)


def garbled_lines(log: DataFrame, benchmark: DataFrame) -> DataFrame:
    """p1_found: line_no of every line whose title was decoded wrongly, as a whole or in part."""
    return restored(log, fit(benchmark)).select("line_no")


def originals(log: DataFrame, benchmark: DataFrame, anchors: DataFrame) -> DataFrame:
    """(line_no, id, title, pairs, original, source): the found lines with their title as it was.

    source is `inverse` where the inverse transform gives it whole, else `benchmark` where the id has
    a title, else `partial`: the inverse with its losses."""
    found = restored(log, fit(benchmark), keep=("line_no", "id"))
    known = benchmark.where("title is not null").select("id", F.col("title").alias("known")).unionByName(anchors.select("id", F.col("title").alias("known"))).groupBy("id").agg(F.min("known").alias("known"))
    source = F.when(F.col("whole"), "inverse").when(F.col("known").isNotNull(), "benchmark").otherwise("partial")
    return found.join(known, "id", "left").select("line_no", "id", "title", "pairs", F.when(F.col("whole"), F.col("restored")).otherwise(F.coalesce("known", "restored")).alias("original"), source.alias("source"))
