"""Problem 10: the programming or markup language of every document and segment.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then temperature calibration. It is fitted
on a bounded sample per language of documents whose extension agrees with their label: chunks
from all over their texts. Scoring adds up the weights of the n-grams of each small unit (a line, or a statement of a very long line); a
Viterbi pass with a price for changing the language joins units to segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ORDERS = (2, 3, 4)
BITS = 16
CHUNK = 300  # bytes a training example has, and the length at which evidence is as calibrated
SCALE = 10.0
BLOCK = 1 << 14  # bytes scored at once: their weights stay in the processor's cache


def _alphabet() -> np.ndarray:
    """Bytes to signs: digits alike, other white space as blank, all letters beyond ASCII alike."""
    table = np.arange(256, dtype=np.uint32)
    table[0x30:0x3A] = 0x30
    table[[9, 11, 12, 13]] = 32
    table[0x80:] = 0x80
    return table


SIGNS = _alphabet()


def gram_hashes(signs: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the `order` signs from each place on; the last places wrap into zeros."""
    x = signs.copy()
    for k in range(1, order):
        x[: len(x) - k] |= signs[k:] << np.uint32(8 * k)
    with np.errstate(over="ignore"):
        x = (x ^ np.uint32(order * 0x1F123BB5)) * np.uint32(2654435761)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
    return x >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class LangModel:
    """Weight per n-gram bucket and language (idf and scale included), and the temperature."""

    names: tuple[str, ...]
    weights: np.ndarray
    temperature: float

    def evidence(self, raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed weights, n-grams) of the units that begin at `starts`; `ends` holds the end of each text of `raw`."""
        out = np.zeros((len(starts), len(self.names)), np.float32)
        nothing = len(self.weights)  # the row of n-grams that run over the end of a text
        table = np.concatenate([self.weights, np.zeros((1, len(self.names)), np.float32)])
        reach = max(ORDERS)
        for a in range(0, len(raw), BLOCK):
            b = min(len(raw), a + BLOCK)
            signs = SIGNS[raw[a : min(len(raw), b + reach)]]
            edges = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b + reach, "right")] - a
            total = None
            for order in ORDERS:
                h = gram_hashes(signs, order)[: b - a].astype(np.int64)
                for back in range(1, order):
                    cross = edges - back
                    h[cross[(cross >= 0) & (cross < b - a)]] = nothing
                got = np.take(table, h, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b))
            # sums along rows are several times faster than sums of rows
            out[first:last] += np.add.reduceat(np.ascontiguousarray(total.T), np.maximum(starts[first:last], a) - a, axis=1).T
        sizes = np.diff(np.append(starts, len(raw)))
        return out, sizes * len(ORDERS)

    def confidence(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for summed weights over so many n-grams."""
        logits = sums / np.maximum(grams, 1)[:, None] / self.temperature
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)


def units(raw: np.ndarray, ends: np.ndarray, long_line: int = 200) -> np.ndarray:
    """Where the units begin: after each line break, at each text, and in lines of more than `long_line` bytes after > ; { }."""
    n = len(raw)
    breaks = raw == 10
    begins = np.zeros(n + 1, bool)
    begins[1:] = breaks
    begins[ends[ends < n]] = True
    begins[0] = True
    lines = np.flatnonzero(begins[:n])
    lengths = np.diff(np.append(lines, n))
    if (lengths > long_line).any():
        in_long = np.repeat(lengths > long_line, lengths)
        stop = np.isin(raw, np.frombuffer(b">;{}", np.uint8))
        stop[:-1] &= raw[1:] != 10
        begins[1:] |= stop & in_long
    return np.flatnonzero(begins[:n])


def segment(sums: np.ndarray, docs: np.ndarray, price: float) -> np.ndarray:
    """The language of each unit: the best path through its document, with a price per change."""
    count, states = sums.shape
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if count else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, count))
    path = np.zeros(count, np.int16)
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        longest = int(sizes[some].max())
        live = np.searchsorted(sizes[some], np.arange(longest), "right")  # documents before it have ended
        best = np.zeros((len(some), states), np.float32)
        came: list[np.ndarray] = []
        for t in range(longest):
            on = slice(int(live[t]), None)
            now = best[on]
            top = now.argmax(axis=1)
            peak = now[np.arange(len(top)), top][:, None] - price
            change = now < peak
            came.append(np.where(change, top[:, None], np.arange(states)[None]).astype(np.int16))
            best[on] = np.where(change, peak, now) + sums[first[some[on]] + t]
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            on = slice(int(live[t]), None)
            path[first[some[on]] + t] = state[on]
            state[on] = came[t][np.arange(len(state[on])), state[on]]
    return path


def chunks_of(text: bytes, most: int | None = None) -> list[bytes]:
    """The text in chunks; if there are more than `most`, as many spread evenly over the whole of it."""
    starts = np.arange(0, max(len(text) - CHUNK // 3, 1), CHUNK)
    if most is not None and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).round().astype(np.int64)]
    return [text[a : a + CHUNK] for a in starts.tolist()]


def train(chunks: list[bytes], labels: np.ndarray, docs: np.ndarray, names: tuple[str, ...], *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, rounds: int = 2, batch: int = 16, held_out: int = 8, seed: int = 7) -> LangModel:
    """Fits on chunks of texts (labels and docs: the label and the text of each); every `held_out`-th text only
    serves the temperature. Steps are taken for small batches, of the features that occur in them.

    After the first round, chunks that the model surely gives to another language (embedded code,
    wrong labels) are left out."""
    size, k = 1 << BITS, len(names)
    features: list[np.ndarray] = []
    shares: list[np.ndarray] = []
    for chunk in chunks:
        signs = SIGNS[np.frombuffer(chunk, np.uint8)]
        h = np.concatenate([gram_hashes(signs, o)[: max(len(signs) - o + 1, 0)] for o in ORDERS])
        f, c = np.unique(h, return_counts=True)
        features.append(f.astype(np.int64))
        shares.append((c / max(len(h), 1)).astype(np.float32))
    full = np.array([len(f) > 0 for f in features], bool)
    df = np.bincount(np.concatenate([*features, np.zeros(0, np.int64)]), minlength=size)
    idf = (np.log((1 + len(chunks)) / (1 + df)) + 1).astype(np.float32)
    z, n = np.zeros((size, k), np.float32), np.zeros((size, k), np.float32)
    keep = full.copy()
    rng = np.random.default_rng(seed)

    def weights(rows: np.ndarray | slice) -> np.ndarray:
        zz = z[rows]
        return np.where(np.abs(zz) > l1, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[rows])) / alpha + l2), 0.0).astype(np.float32)

    def matrix(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of these chunks, a row of their values per chunk)."""
        all_ = np.concatenate([features[i] for i in some.tolist()])
        there = np.zeros(size, bool)
        there[all_] = True
        rows = np.flatnonzero(there)
        place = np.zeros(size, np.int64)
        place[rows] = np.arange(len(rows))
        x = np.zeros((len(some), len(rows)), np.float32)
        x[np.repeat(np.arange(len(some)), [len(features[i]) for i in some.tolist()]), place[all_]] = np.concatenate([shares[i] for i in some.tolist()])
        return rows, x * (idf[rows] * np.float32(SCALE))

    def logits(some: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, k), np.float32)]
        for at in range(0, len(some), 64):
            rows, x = matrix(some[at : at + 64])
            parts.append(x @ weights(rows))
        return np.concatenate(parts)

    fitted = np.flatnonzero(full & (docs % held_out > 0))
    for turn in range(rounds):
        order = rng.permutation(fitted)
        order = order[keep[order]]
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            rows, x = matrix(some)
            w = weights(rows)
            p = x @ w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            g = x.T @ p
            now = n[rows]
            more = now + (x * x).T @ (p * p)  # the squares of each chunk's own step
            z[rows] += g - (np.sqrt(more) - np.sqrt(now)) / alpha * w
            n[rows] = more
        if turn + 1 < rounds:
            s = logits(fitted)
            keep[fitted] = s.max(axis=1, initial=-np.inf) - s[np.arange(len(fitted)), labels[fitted]] < 2.0
    # temperature: least log loss on the held-out chunks, by golden section on its logarithm
    rest = np.flatnonzero(full & (docs % held_out == 0))
    temperature = 1.0
    if len(rest):
        s, y = logits(rest).astype(float), labels[rest]

        def loss(t: float) -> float:
            v = s / np.exp(t)
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

        a, b, g = -3.0, 3.0, (np.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        temperature = float(np.exp((a + b) / 2))
    return LangModel(names, weights(slice(None)) * (idf * np.float32(SCALE))[:, None], temperature)


def fit(documents: DataFrame, languages: DataFrame, *, sample: int = 4_000, per_document: int = 20) -> LangModel:
    """The model of labelled documents (of no languages: one that finds nothing). It is fitted on about
    `sample` documents, the same number for each language if there are as many, whose usual
    extension agrees with the label: those of least id hash. Of each at most `per_document` chunks are
    used, spread over its whole text. What is gathered is bounded by these two numbers.

    Documents are counted by language first, from two short columns; their texts are read once."""
    known = sorted((r.lang, r.usual_ext) for r in languages.select("lang", "usual_ext").limit(1_000).collect())
    names = tuple(k for k, _ in known)
    if not names:
        return LangModel((), np.zeros((1 << BITS, 0), np.float32), 1.0)
    usual = F.create_map(*(F.lit(x) for pair in known for x in pair))
    ext = F.regexp_extract(F.lower("file_path"), r"\.(\w+)$", 1)
    agreed = documents.where(F.col("lang").isin(*names) & (usual[F.col("lang")] == ext))
    counts = {r.lang: r["n"] for r in agreed.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    each = max(8, sample // len(names))
    share = {x: min(1.0, (1.5 * each + 20) / max(n, 1)) for x, n in counts.items()}
    top = {x: int(-(2**63) + s * 2**64) if s < 1 else 2**63 - 1 for x, s in share.items()}
    if not top:
        return LangModel(names, np.zeros((1 << BITS, len(names)), np.float32), 1.0)
    limit = F.create_map(*(F.lit(v) for pair in top.items() for v in pair))[F.col("lang")]
    h = F.xxhash64("doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunks_of(x.encode(), per_document) if x and len(x) > 20 else [] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["h", "lang", "chunks"])

    picked = agreed.where(h <= limit).select(h.alias("h"), "lang", F.col("text").cast("string").alias("text")).mapInArrow(cut, "h long, lang string, chunks array<binary>")
    taken: dict[str, int] = {}
    chunks, labels, docs = [], [], []
    for number, row in enumerate(sorted(picked.where(F.size("chunks") > 0).collect())):
        taken[row.lang] = taken.get(row.lang, 0) + 1
        if taken[row.lang] <= each:
            chunks += row.chunks
            labels += [names.index(row.lang)] * len(row.chunks)
            docs += [number] * len(row.chunks)
    return train([bytes(c) for c in chunks], np.array(labels, np.int64), np.array(docs, np.int64), names)


@dataclass(frozen=True)
class Rules:
    """How units become segments and documents."""

    price: float = 3.0  # of changing the language, in log odds
    evidence: float = 4.0  # times which units weigh against the price; their own odds, spread over a text, are too even
    label_weight: float = 2.0  # log odds for the language the file came with
    least_size: int = 40
    large_size: int = 200  # non-blank characters below which prose is a comment or a string of the code around it, and a doubtful segment joins it
    least_sure: float = 0.7
    prose: tuple[str, ...] = ("text", "markdown")
    least_language: float = 0.13  # share of a document below which a language is taken for noise


def _analyse(model: LangModel, rules: Rules, column: pa.Array, labels: list[str | None], *, every: bool = False) -> tuple[np.ndarray, ...]:
    """Per segment: (document, begin byte, end byte, language, confidence, non-blank bytes).

    With `every`, floors are absolute: whatever its share of the document, a segment stays that has
    `least_size` non-blank characters, or `large_size` if it is prose or of less confidence than `least_sure`."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts = units(raw, offsets)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, grams = model.evidence(raw, offsets, starts)
    docs = np.searchsorted(offsets, starts, "right") - 1
    solid = np.add.reduceat(((raw > 32) & ((raw & 0xC0) != 0x80)).astype(np.int64), starts)
    typical = CHUNK * len(ORDERS) * model.temperature / rules.evidence
    names = {n: k for k, n in enumerate(model.names)}
    odds = sums / typical
    # the label's weight is spread over the document's units
    lab = np.array([names.get(x, -1) for x in labels])[docs]
    size = np.bincount(docs, weights=solid, minlength=len(labels))
    has = np.flatnonzero((lab >= 0) & (size[docs] > 0))
    odds[has, lab[has]] += (rules.label_weight * solid[has] / size[docs[has]]).astype(np.float32)
    lang = segment(odds, docs, rules.price)

    def runs() -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (docs[1:] != docs[:-1])]))

    def absorb(small: np.ndarray, lang: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Small segments take the language that most of their document is in."""
        table = np.zeros((len(labels), len(model.names)))
        np.add.at(table, (docs[at], lang[at]), part)
        lengths = np.diff(np.append(at, len(lang)))
        return np.where(np.repeat(small, lengths), table.argmax(axis=1)[docs], lang)

    at = runs()
    part = np.add.reduceat(solid, at)
    small = np.zeros(len(at), bool)  # of a whole document only the sum of each language counts, below
    if every:
        doubtful = model.confidence(np.add.reduceat(sums, at, axis=0), np.add.reduceat(grams, at))[np.arange(len(at)), lang[at]] < rules.least_sure
        small = part < np.where(doubtful | np.isin(np.array(model.names)[lang[at]], rules.prose), rules.large_size, rules.least_size)
    if small.any():
        lang = absorb(small, lang, at, part)
        at = runs()
        part = np.add.reduceat(solid, at)
    table = np.zeros((len(labels), len(model.names)))
    np.add.at(table, (docs[at], lang[at]), part)
    rare = table[docs[at], lang[at]] < rules.least_language * size[docs[at]]
    if not every and rare.any():
        lang = absorb(rare, lang, at, part)
        at = runs()
    total, count = np.add.reduceat(sums, at, axis=0), np.add.reduceat(grams, at)
    sure = model.confidence(total, count)[np.arange(len(at)), lang[at]]
    begin = starts[at] - offsets[docs[at]]
    end = np.append(starts[at][1:], len(raw))
    end = np.minimum(end, offsets[docs[at] + 1]) - offsets[docs[at]]
    return docs[at], begin, end, lang[at].astype(np.int64), sure, np.add.reduceat(solid, at)


def _texts(documents: DataFrame, model: LangModel) -> DataFrame:
    """The columns that scoring reads; no rows if the model knows no language."""
    return documents.where(F.lit(bool(model.names))).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, as scoring needs several arrays of a batch's size."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def segments(documents: DataFrame, model: LangModel, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, segment, begin, end, lang, confidence, solid) of every segment of one language, however long its document.

    begin and end are byte offsets of the UTF-8 text, solid the number of non-blank characters.
    Null, empty and blank texts have no segment. The label a file came with (lang) weighs a little;
    null and unknown labels weigh nothing. No shuffle; repeated rows give repeated segments."""
    names = np.array(model.names, object)
    schema = "doc_id long, segment int, begin long, end long, lang string, confidence double, solid long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            doc, begin, end, lang, sure, solid = _analyse(model, rules, batch.column(1), batch.column(2).to_pylist(), every=True)
            full = solid > 0
            doc, begin, end, lang, sure, solid = (x[full] for x in (doc, begin, end, lang, sure, solid))
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(doc)), "segment": pa.array(number, pa.int32()), "begin": begin, "end": end, "lang": pa.array(names[lang] if len(lang) else [], pa.string()), "confidence": pa.array(sure, pa.float64()), "solid": solid})

    return _texts(documents, model).mapInArrow(run, schema)


def document_languages(documents: DataFrame, model: LangModel, rules: Rules = Rules(), *, only_found: bool = False) -> DataFrame:
    """(doc_id, lang, share, confidence, several, label_ok) per document and language of at least
    `rules.least_language` of its non-blank characters; all in one pass, without a shuffle. That is a little
    under the 15 percent that count, as the measured share of an embedded part falls short by about a
    hundredth; a document has several languages if it has several rows.

    label_ok says whether the label it came with is the largest language. With only_found, documents
    of one language with the right label are left out."""
    names = np.array(model.names, object)
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("lang", T.StringType()), ("share", T.DoubleType()), ("confidence", T.DoubleType()), ("several", T.BooleanType()), ("label_ok", T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            labels = batch.column(2).to_pylist()
            doc, _, _, lang, sure, solid = _analyse(model, rules, batch.column(1), labels)
            if not len(doc):
                continue
            table = np.zeros((len(labels), len(names)))
            np.add.at(table, (doc, lang), solid)
            trust = np.zeros_like(table)
            np.add.at(trust, (doc, lang), sure * solid)
            total = table.sum(axis=1)
            main = table.argmax(axis=1)
            ok = np.array([x == names[m] for x, m in zip(labels, main)])
            show = (table >= rules.least_language * total[:, None]) & (table > 0)
            several = show.sum(axis=1) > 1
            if only_found:
                show &= (several | ~ok)[:, None]
            d, k = np.nonzero(show)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d)), pa.array(names[k] if len(k) else [], pa.string()), pa.array(table[d, k] / total[d]), pa.array(trust[d, k] / table[d, k]), pa.array(several[d]), pa.array(ok[d])],
                names=schema.names,
            )

    return _texts(documents, model).mapInArrow(run, schema)


def found(documents: DataFrame, languages: DataFrame) -> DataFrame:
    """p10_found: (doc_id, lang) of documents of several languages and of those without a right label."""
    return document_languages(documents, fit(documents, languages), only_found=True).select("doc_id", "lang")
