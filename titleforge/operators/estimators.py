"""Linear text classifiers over TF-IDF tables, their selection on a fixed split, and their top features."""

from __future__ import annotations

import hmac
import secrets
import socket
import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.operators import features
from titleforge.operators.metrics import confusion, rates
from titleforge.session import cut_lineage


Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # of y and f: the losses, their slopes and curvatures


@dataclass
class Linear:
    """f(x) = w x + b; Yes above 0, ties are No. `link` says how f becomes a score."""

    vocab: DataFrame
    weights: np.ndarray
    intercept: float
    texts: int
    link: str = "sigmoid"

    def table(self) -> DataFrame:
        """(index, weight) as a table."""
        spark = self.vocab.sparkSession
        return spark.createDataFrame(pd.DataFrame({"index": np.arange(len(self.weights), dtype=np.int32), "w": self.weights.astype(float)}))

    def predict(self, titles: DataFrame) -> DataFrame:
        """`titles` with pred_label and score_yes; texts without known grams get the intercept alone."""
        f = F.col("f")[0]
        return margins([self], titles).withColumn("pred_label", predicted(f)).withColumn("score_yes", score(f)).drop("f")


def predicted(f: Column) -> Column:
    return F.when(f > 0, "Yes").otherwise("No")


def score(f: Column) -> Column:
    return 1 / (1 + F.exp(-f))


def margins(models: Sequence[Linear], titles: DataFrame) -> DataFrame:
    """`titles` with f, the values of models over one vocabulary, text by text over Arrow batches: no entry is moved."""
    vocab, sc = models[0].vocab, models[0].vocab.sparkSession.sparkContext
    shared = sc.broadcast((*features.lookup(vocab, models[0].texts), [(m.weights, m.intercept) for m in models]))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, weights = shared.value
        for batch in batches:
            sizes, index, weight = features.vectors(batch.column("_t").to_pylist(), known, idf)
            row = np.repeat(np.arange(len(sizes)), sizes)
            f = np.stack([np.bincount(row, weights=weight * w[index], minlength=len(sizes)) + b for w, b in weights], axis=1)
            upto = np.arange(0, f.size + 1, len(weights), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(upto, pa.array(f.ravel()))], names=[*batch.schema.names[:-1], "f"])

    spread = features.plain(titles.repartition(sc.defaultParallelism))
    return spread.mapInArrow(some, T.StructType([*titles.schema.fields, T.StructField("f", T.ArrayType(T.DoubleType()))]))


@dataclass
class Features:
    """The training table of a split: vocabulary, TF-IDF of each title (id, y, c, i, v) with label and class weight."""

    vocab: DataFrame
    titles: DataFrame
    texts: int
    size: int
    entries: int
    blocks: DataFrame | None = None
    sums: np.ndarray | None = None

    @property
    def rows(self) -> DataFrame:
        """(id, index, weight, y, c): a row for each entry."""
        return self.titles.select("id", F.inline(F.arrays_zip("i", "v")), "y", "c").select("id", F.col("i").alias("index"), F.col("v").alias("weight"), "y", "c")


def prepare(train: DataFrame, *, id_col: str = "id", max_features: int = 80_000) -> Features:
    """TF-IDF of the training titles with y (0, 1) and balanced class weight c."""
    train = train.where(F.col("gold_label").isin("Yes", "No") & F.col("title").isNotNull())
    train = cut_lineage(features.plain(train).select(F.col(id_col).alias("id"), "_t", "gold_label"))
    sc, texts = train.sparkSession.sparkContext, train.count()
    spread = train.repartition(max(sc.defaultParallelism, -(-texts // 20_000)), "id")
    vocab = cut_lineage(features.vocabulary(features.gram_counts(spread), texts, max_features=max_features))
    weights = features.class_weights(train).select("gold_label", F.col("weight").alias("c"))
    known = spread.join(F.broadcast(weights), "gold_label").select("id", (F.col("gold_label") == "Yes").cast("double").alias("y"), "c", "_t")
    shared = sc.broadcast(features.lookup(vocab, texts))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, index, weight = features.vectors(batch.column("_t").to_pylist(), *shared.value)
            upto = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(upto, pa.array(x)) for x in (index.astype(np.int32), weight))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=["id", "y", "c", "i", "v"])

    kinds = [known.schema["id"], *(T.StructField(n, t) for n, t in (("y", T.DoubleType()), ("c", T.DoubleType()), ("i", T.ArrayType(T.IntegerType())), ("v", T.ArrayType(T.DoubleType()))))]
    titles = cut_lineage(known.mapInArrow(weighed, T.StructType(kinds)))
    shared.destroy()
    entries = titles.agg(F.sum(F.size("i").cast("long")).alias("n")).first().n or 0
    return Features(vocab, titles, texts, vocab.count(), entries)


@dataclass(frozen=True)
class Problem:
    """What Newton's method is to find: least (|w|^2 + intercept_penalty * b^2) / 2 + C sum c loss."""

    loss: Loss
    c_value: float
    intercept_penalty: float
    max_iter: int
    tol: float
    link: str


def logistic_problem(c_value: float, *, max_iter: int = 1_000, tol: float = 1e-8) -> Problem:
    def loss(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = y * f
        wrong = 1 / (1 + np.exp(np.minimum(m, 700.0)))
        return np.logaddexp(0.0, -m), -y * wrong, wrong * (1 - wrong)

    return Problem(loss, c_value, 0.0, max_iter, tol, "probability")


def squared_hinge_problem(c_value: float, *, max_iter: int = 300, tol: float = 1e-6) -> Problem:
    def loss(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slack = np.maximum(0.0, 1 - y * f)
        return slack * slack, -2 * slack * y, 2.0 * (slack > 0)

    return Problem(loss, c_value, 1.0, max_iter, tol, "sigmoid")


def logistic(data: Features, c_value: float, **limits: float) -> Linear:
    """L2-regularised logistic regression with balanced weights: least |w|^2 / 2 + C sum c log(1 + exp(-y f)); the intercept is free."""
    return _fit(data, [logistic_problem(c_value, **limits)])[0]


def squared_hinge(data: Features, c_value: float, **limits: float) -> Linear:
    """Linear SVM: least |w, b|^2 / 2 + C sum c max(0, 1 - y f)^2, the intercept regularised too."""
    return _fit(data, [squared_hinge_problem(c_value, **limits)])[0]


def complement_nb(data: Features, alpha: float) -> Linear:
    """Complement naive Bayes: each class by the sums of the other; f is the difference of Yes and No."""
    with _PREPARING:
        if data.sums is None:
            data.sums = _class_sums(data)
    sums = data.sums
    logs = np.log(sums[::-1] + alpha) - np.log((sums[::-1] + alpha).sum(axis=1, keepdims=True))
    return Linear(data.vocab, logs[0] - logs[1], 0.0, data.texts, "probability")


def _class_sums(data: Features) -> np.ndarray:
    """`complement_sums` as an array (no, yes) by index, summed over Arrow batches."""
    size = data.size

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            y, i, v = batch.columns
            yes = np.repeat(y.to_numpy() == 1, i.value_lengths().to_numpy())
            index, weight = i.flatten().to_numpy(), v.flatten().to_numpy()
            sums += [np.bincount(index[yes == k], weights=weight[yes == k], minlength=size) for k in (False, True)]
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict({"index": at, "no": sums[0, at], "yes": sums[1, at]})

    parts = data.titles.select("y", "i", "v").mapInArrow(some, "index long, no double, yes double")
    table = parts.groupBy("index").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas()  # at most the vocabulary
    out = np.zeros((2, size))
    out[:, table["index"].to_numpy(np.int64)] = table[["no", "yes"]].to_numpy(float).T
    return out


def complement_sums(rows: DataFrame) -> DataFrame:
    """(index, no, yes): summed weights of the titles of each class."""
    return rows.groupBy("index").agg(F.sum(F.when(F.col("y") == 0, F.col("weight")).otherwise(0.0)).alias("no"), F.sum(F.when(F.col("y") == 1, F.col("weight")).otherwise(0.0)).alias("yes"))


def _blocks(data: Features, rows: int = 2_000) -> DataFrame:
    """The titles as blocks of arrays (y, c, sizes, index, weight), as bytes, so that a step reads few rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                y, c, i, v = batch.slice(at, rows).columns
                arrays = {"y": y.to_numpy() * 2 - 1, "c": c.to_numpy(), "sizes": i.value_lengths().to_numpy().astype(np.int64), "i": i.flatten().to_numpy(), "v": v.flatten().to_numpy()}
                yield pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in arrays.items()})

    return cut_lineage(data.titles.select("y", "c", "i", "v").mapInArrow(pack, "y binary, c binary, sizes binary, i binary, v binary"))


WHOLE = 10_000_000  # entries of the training table, of some 60 bytes each, that a task holds at most; up to so many in all, it finds the weights by itself
_PREPARING = threading.Lock()  # fits may run side by side on the same table


def _sums(of: np.ndarray, at: np.ndarray, x: np.ndarray, starts: np.ndarray, piece: int = 32_768) -> np.ndarray:
    """The sums of of[at] * x from each start to the next, none of them empty, in pieces that stay in the cache."""
    out, k = np.empty(len(starts)), 0
    while k < len(starts):
        more = max(k + 1, int(np.searchsorted(starts, starts[k] + piece)))
        a, b = starts[k], starts[more] if more < len(starts) else len(at)
        np.add.reduceat(of[at[a:b]] * x[a:b], starts[k:more] - a, out=out[k:more])
        k = more
    return out


class _Titles:
    """Some blocks as a sparse matrix; with `turned` also by columns, for many steps on the same titles."""

    def __init__(self, blocks: pd.DataFrame, size: int, loss: Loss, c_value: float, turned: bool = False) -> None:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in blocks[name])])

        self.size, self.turned = size, turned
        self.y, self.given, sizes = joined("y", float), joined("c", float), joined("sizes", np.int64)
        self.i, self.v = joined("i", np.int32).astype(np.intp), joined("v", float)
        self.filled = np.flatnonzero(sizes)  # a title without known grams has the intercept alone
        self.starts, self.row = (np.cumsum(sizes) - sizes)[self.filled], np.repeat(np.arange(len(sizes)), sizes)
        self.ask(loss, c_value)
        if turned:
            order, counts = np.argsort(self.i, kind="stable"), np.bincount(self.i, minlength=size)
            self.row, self.x = self.row[order], self.v[order]
            self.columns = np.flatnonzero(counts)
            self.tops = (np.cumsum(counts) - counts)[self.columns]

    def ask(self, loss: Loss, c_value: float) -> None:
        self.loss, self.c, self.by, self.f, self.bent = loss, self.given * c_value, None, np.zeros(0), None

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.y), w[-1])
        out[self.filled] += _sums(w, self.i, self.v, self.starts)
        return out

    def at(self, w: np.ndarray) -> np.ndarray:
        """The margins at w, computed once for the same w."""
        if self.by is not w:
            self.by, self.f, self.bent = w, self.margins(w), None
        return self.f

    def curvature(self, w: np.ndarray) -> np.ndarray:
        """The weighed second derivatives of the losses at w, computed once for the same w."""
        f = self.at(w)
        if self.bent is None:
            self.bent = self.c * self.loss(self.y, f)[2]
        return self.bent

    def summed(self, g: np.ndarray, power: int = 1) -> np.ndarray:
        """The sums of g times the entries, or their squares, per feature; the intercept last."""
        out = np.zeros(self.size + 1)
        if self.turned:
            out[self.columns] = _sums(g, self.row, self.x if power == 1 else self.x**power, self.tops)
        else:
            out[:-1] = np.bincount(self.i, weights=g[self.row] * self.v**power, minlength=self.size)
        out[-1] = g.sum()
        return out


def _marks(parts: Sequence[pd.DataFrame], size: int, seed: int = 0) -> np.ndarray:
    """Two random sums of each feature's entries, equal for features of equal entries in all titles."""
    out, rng = np.zeros((2, size)), np.random.default_rng(seed)
    for sizes, i, v in (x for part in parts for x in zip(part["sizes"], part["i"], part["v"])):
        sizes, i, v = np.frombuffer(sizes, np.int64), np.frombuffer(i, np.int32), np.frombuffer(v, float)
        for k in range(2):
            out[k] += np.bincount(i, weights=v * np.repeat(rng.random(len(sizes)), sizes), minlength=size)
    return out


def _equal(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that stand for equal ones, the number of the one for each feature, and how many it stands for.

    Equal features have equal weights at the optimum, so m of them are one with entries sqrt(m) times as
    large, of the same loss and norm. Grams of one phrase are mostly such."""
    _, first, same, times = np.unique(marks.T, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, same.ravel(), times


def _reduced(parts: Sequence[pd.DataFrame], size: int, first: np.ndarray, same: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """The blocks with equal features as one."""
    stands, number, factor, rows = np.isin(np.arange(size), first), same.astype(np.int32), np.sqrt(times), []
    for y, c, sizes, i, v in (x for part in parts for x in zip(*(part[k] for k in ("y", "c", "sizes", "i", "v")))):
        sizes, i, v = np.frombuffer(sizes, np.int64), np.frombuffer(i, np.int32), np.frombuffer(v, float)
        kept = stands[i]
        sizes, i = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes)), number[i[kept]]
        rows.append((y, c, sizes.tobytes(), i.tobytes(), (v[kept] * factor[i]).tobytes()))
    return pd.DataFrame(rows, columns=["y", "c", "sizes", "i", "v"])


def _merged(parts: Sequence[pd.DataFrame], size: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The blocks with features of equal entries as one, the number of the one for each feature, and how many it stands for."""
    first, same, times = _equal(_marks(parts, size))
    return _reduced(parts, size, first, same, times), same, times


def _state(t: _Titles, w: np.ndarray) -> np.ndarray:
    """Loss, gradient, and the diagonal of the second derivatives, one behind the other."""
    each, slope, curve = t.loss(t.y, t.at(w))
    return np.concatenate(([t.c @ each], t.summed(t.c * slope), t.summed(t.c * curve, 2)))


def _curved(t: _Titles, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The second derivatives at w times d."""
    return t.summed(t.curvature(w) * t.margins(d))


def _along(t: _Titles, w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The losses at w + step * d."""
    f, more = t.at(w), t.margins(d)
    return np.array([t.c @ t.loss(t.y, f + step * more)[0] for step in steps])


_PARTS = (_state, _curved, _along)
_WAIT = 900  # seconds without a word from another task after which a task gives up


def _received(link: socket.socket, count: int, kind: type = float) -> np.ndarray:
    out = np.empty(count, kind)
    left = memoryview(out).cast("B")
    while len(left):
        got = link.recv_into(left)
        if not got:
            raise ConnectionError("another task of the fit has ended")
        left = left[got:]
    return out


def _links(context: BarrierTaskContext) -> list[socket.socket]:
    """Connections of task 0 to all others, in their order, and of each other task to task 0. Only who has the word
    that Spark carried is let in, and nothing but numbers is read."""
    rank, tasks = context.partitionId(), context.getTaskInfos()
    host = tasks[0].address.rpartition(":")[0]
    if rank:
        port, word = context.allGather("")[0].split()
        link = socket.create_connection((host, int(port)), timeout=_WAIT)
        link.sendall(bytes.fromhex(word) + np.int64(rank).tobytes())
        links = {0: link}
    else:
        word, links = secrets.token_bytes(32), {}
        with socket.create_server((host, 0), backlog=len(tasks)) as server:
            server.settimeout(_WAIT)
            context.allGather(f"{server.getsockname()[1]} {word.hex()}")
            while len(links) < len(tasks) - 1:
                link, _ = server.accept()
                link.settimeout(_WAIT)
                try:
                    known = hmac.compare_digest(_received(link, 32, np.uint8).tobytes(), word)
                    links[int(_received(link, 1, np.int64)[0]) if known else -1] = link
                except OSError:
                    link.close()
                links.pop(-1, link)  # who had another word is dropped
    for link in links.values():
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return [links[k] for k in sorted(links)]


def _lead(links: Sequence[socket.socket], parts: list[pd.DataFrame], size: int, problems: Sequence[Problem]) -> Iterator[np.ndarray]:
    """The weights of one problem after another, found by task 0: it takes the steps, and the others give sums over the titles they hold."""

    def say(*arrays: np.ndarray) -> None:
        message = b"".join(a.tobytes() for a in arrays)
        for link in links:
            link.sendall(message)

    marks = _marks(parts, size)
    for link in links:
        marks += _received(link, 2 * size).reshape(2, size)
    first, same, times = _equal(marks)
    say(np.array([len(times)]), first, same, times)
    held = _take(parts, size, first, same, times, problems[0])
    for k, problem in enumerate(problems):
        held.ask(problem.loss, problem.c_value)
        last: list[Any] = [None]  # the w that the others have

        def run(part: Callable[..., np.ndarray], length: int, w: np.ndarray, *more: np.ndarray) -> np.ndarray:
            given = [*([] if w is last[0] else [w]), *more]
            say(np.array([k, _PARTS.index(part), len(given) > len(more), len(w), *(len(x) for x in more), *[0] * (2 - len(more))]), *given)
            last[0], total = w, part(held, w, *more)
            for link in links:
                total += _received(link, length)
            return total

        u = _newton(run, np.append(np.ones(len(times)), problem.intercept_penalty), problem.max_iter, problem.tol)
        yield np.append((u[:-1] / np.sqrt(times))[same], u[-1])
    say(np.array([-1, 0, 0, 0, 0, 0]))


def _follow(link: socket.socket, rank: int, parts: list[pd.DataFrame], size: int, problems: Sequence[Problem]) -> None:
    """What the other tasks do: the sums that task 0 asks for."""
    link.sendall(_marks(parts, size, rank).tobytes())
    kinds = int(_received(link, 1, np.int64)[0])
    first, same, times = (_received(link, n, np.int64) for n in (kinds, size, kinds))
    held, at, w = _take(parts, size, first, same, times, problems[0]), 0, np.zeros(0)
    while True:
        k, part, new, length, *more = _received(link, 6, np.int64).tolist()
        if k < 0:
            return
        if k != at:
            held.ask(problems[k].loss, problems[k].c_value)
            at = k
        w = _received(link, length) if new else w
        link.sendall(_PARTS[part](held, w, *(_received(link, n) for n in more if n)).tobytes())


def _take(parts: list[pd.DataFrame], size: int, first: np.ndarray, same: np.ndarray, times: np.ndarray, problem: Problem) -> _Titles:
    """The reduced blocks, held for many steps; the list of parts is emptied."""
    merged = _reduced(parts, size, first, same, times)
    parts.clear()
    return _Titles(merged, len(times), problem.loss, problem.c_value, turned=True)


def _slots(sc: SparkContext) -> int:
    """How many tasks can run at once; 0 if that changes as it pleases the cluster."""
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    inner = sc._jsc.sc()
    return inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())


def _fit(data: Features, problems: Sequence[Problem]) -> list[Linear]:
    """Newton's method over at most max_features weights. A training table of at most WHOLE entries is given
    to one task, which needs one job. Larger ones are held by as many tasks as run at once, which find the
    weights of all problems in one job. Beyond what these can hold, the driver takes the steps, and what they
    need are sums over partitions, of which only one row per feature arrives."""
    spark, size = data.vocab.sparkSession, data.size
    with _PREPARING:
        if data.blocks is None:
            data.blocks = _blocks(data)
    blocks, tasks = data.blocks, _slots(spark.sparkContext) if data.entries > WHOLE else 1

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        context = BarrierTaskContext.get() if tasks > 1 else None
        links = _links(context) if context else []
        try:
            if context and context.partitionId():
                _follow(links[0], context.partitionId(), parts, size, problems)
            elif context or parts:
                for k, w in enumerate(_lead(links, parts, size, problems)):
                    yield pd.DataFrame({"k": k, "i": np.arange(size + 1), "g": w})
        finally:
            for link in links:
                link.close()

    def summed(problem: Problem, part: Callable[..., np.ndarray], length: int, *given: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(given)

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(length)
            for pdf in batches:
                if len(pdf):
                    total += part(_Titles(pdf, size, problem.loss, problem.c_value), *shared.value)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "g": total[at]})

        got = blocks.mapInPandas(some, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()
        shared.destroy()
        out = np.zeros(length)
        out[got["i"].to_numpy(np.int64)] = got["g"].to_numpy(float)
        return out

    found = np.zeros((len(problems), size + 1))
    if data.entries <= WHOLE * tasks:
        spread = blocks.repartition(tasks) if tasks > 1 else blocks.coalesce(1)
        got = spread.mapInPandas(held, "k long, i long, g double", barrier=tasks > 1).toPandas()
        found[got["k"].to_numpy(np.int64), got["i"].to_numpy(np.int64)] = got["g"].to_numpy(float)
    else:
        stepped = [lambda p=p: _newton(lambda *asked: summed(p, *asked), np.append(np.ones(size), p.intercept_penalty), p.max_iter, p.tol) for p in problems]
        found[:] = side_by_side(stepped)
    return [Linear(data.vocab, w[:size], float(w[size]), data.texts, p.link) for w, p in zip(found, problems)]


def _newton(run: Callable[..., np.ndarray], penalty: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Newton's method with backtracking, until the gradient is below tol times its first norm. `run(part,
    length, ...)` gives the sum of a part over all titles. The steps are solved by conjugate gradients, scaled
    by the diagonal and the more exactly the smaller the gradient: the passes over the titles are a fraction
    of those that a method without second derivatives takes."""
    w, first, n = np.zeros(len(penalty)), 0.0, len(penalty)
    for _ in range(max_iter):
        state = run(_state, 1 + 2 * n, w)
        value, g, scale = penalty @ (w * w) / 2 + state[0], penalty * w + state[1 : n + 1], np.maximum(penalty + state[n + 1 :], 1e-12)
        norm = np.linalg.norm(g)
        first = first or norm
        if norm <= tol * max(first, 1.0):
            break
        d, left = np.zeros(n), -g
        p, enough = left / scale, max(min(0.25, norm / first) * norm, tol * max(first, 1.0) / 100)
        z, rest = p, left @ p
        for _ in range(1_000):
            if np.linalg.norm(left) <= enough:
                break
            h = penalty * p + run(_curved, n, w, p)
            a = rest / (p @ h)
            d, left = d + a * p, left - a * h
            z = left / scale
            p, rest = z + (left @ z) / rest * p, left @ z
        for steps in (np.ones(1), 0.5 ** np.arange(1, 30)):
            after = run(_along, len(steps), w, d, steps) + [penalty @ ((w + t * d) ** 2) / 2 for t in steps]
            good = steps[after <= value + 1e-4 * steps * (g @ d) + 1e-13 * abs(value)]  # rounding is no rise
            if len(good):
                break
        else:
            break
        w = w + good[0] * d
    return w


FAMILIES: dict[str, tuple[str, tuple[float, ...], Callable[[Features, float], Linear]]] = {
    "char_tfidf_logistic": ("C", (0.25, 1.0, 4.0), logistic),
    "char_tfidf_linear_svm": ("C", (0.25, 1.0, 4.0), squared_hinge),
    "char_tfidf_complement_nb": ("alpha", (0.1, 0.5, 1.0), complement_nb),
}


def make_estimator(name: str) -> Callable[[Features, float], Linear]:
    if name not in FAMILIES:
        raise ValueError(f"unknown model {name}")
    return FAMILIES[name][2]


def side_by_side(calls: Sequence[Callable[[], Any]], most: int = 6) -> list[Any]:
    """The results of calls that run Spark jobs, in their order; up to `most` at a time, as a fit has one task."""
    with ThreadPoolExecutor(max(1, min(most, len(calls)))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


PROBLEMS: dict[Callable[..., Linear], Callable[[float], Problem]] = {logistic: logistic_problem, squared_hinge: squared_hinge_problem}


def fits(data: Features, wanted: Sequence[tuple[Callable[[Features, float], Linear], float]]) -> list[Linear]:
    """The models of several (fit, value) on one table, in their order: side by side, but those of a table too large for one task together in one job."""
    joint = [k for k, (fit, _) in enumerate(wanted) if fit in PROBLEMS and data.entries > WHOLE]
    alone = [k for k in range(len(wanted)) if k not in joint]
    calls: list[Callable[[], Any]] = [lambda k=k: wanted[k][0](data, wanted[k][1]) for k in alone]
    if joint:
        calls.append(lambda: _fit(data, [PROBLEMS[wanted[k][0]](wanted[k][1]) for k in joint]))
    got = side_by_side(calls)
    models = dict(zip(alone, got)) | (dict(zip(joint, got[-1])) if joint else {})
    return [models[k] for k in range(len(wanted))]


def selection(train: DataFrame, dev: DataFrame, *, families: dict[str, Any] | None = None, id_col: str = "id") -> DataFrame:
    """(model_name, position, parameter, value, dev_macro_f1, selected): every grid point's score on the
    fixed development split; the first best of a family is selected. The fits run side by side, and all
    models score a text at once."""
    data = prepare(train, id_col=id_col)
    dev = dev.where(F.col("gold_label").isin("Yes", "No") & F.col("title").isNotNull()).select("title", "gold_label")
    grid = [(fit, name, at, parameter, float(v)) for name, (parameter, values, fit) in (families or FAMILIES).items() for at, v in enumerate(values)]
    models = fits(data, [(fit, v) for fit, *_, v in grid])
    each = margins(models, dev).select("gold_label", F.posexplode("f").alias("at", "f")).withColumn("pred_label", predicted(F.col("f")))
    scores = {r["at"]: float(r.f) for r in confusion(each, ["at"]).select("at", rates("observed")["macro_f1"].alias("f")).collect()}
    rows = [(*point, scores.get(k, 0.0)) for k, (_, *point) in enumerate(grid)]
    table = train.sparkSession.createDataFrame(rows, "model_name string, position int, parameter string, value double, dev_macro_f1 double")
    w = Window.partitionBy("model_name").orderBy(F.col("dev_macro_f1").desc(), "position")
    return table.withColumn("selected", F.row_number().over(w) == 1)


def top_features(model: Linear, name: str, count: int = 30) -> DataFrame:
    """(model_name, direction, rank, feature, weight): the largest and the smallest weights, ties by feature."""
    w = model.vocab.select("index", F.col("gram").alias("feature")).join(F.broadcast(model.table()), "index").select("feature", F.col("w").alias("weight"))
    return ranked_features(w, name, count)


def ranked_features(weights: DataFrame, name: str, count: int = 30) -> DataFrame:
    """The same over a table of (feature, weight)."""
    parts = []
    for direction, order in (("Yes", F.col("weight").desc()), ("No", F.col("weight").asc())):
        top = weights.orderBy(order, "feature").limit(count)
        parts.append(top.select(F.lit(name).alias("model_name"), F.lit(direction).alias("direction"), F.row_number().over(Window.orderBy(order, "feature")).alias("rank"), "feature", "weight"))
    return parts[0].unionByName(parts[1])


def save(model: Linear, path: str) -> None:
    """The model as tables: its weights by gram, its intercept and number of training texts."""
    model.vocab.join(F.broadcast(model.table()), "index").withColumn("intercept", F.lit(model.intercept)).withColumn("texts", F.lit(model.texts)).withColumn("link", F.lit(model.link)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Linear:
    table = spark.read.parquet(path)
    rows = table.orderBy("index").toPandas()  # bounded by the vocabulary
    return Linear(table.select("index", "gram", "df", "tf"), rows["w"].to_numpy(), float(rows["intercept"].iloc[0]), int(rows["texts"].iloc[0]), str(rows["link"].iloc[0]))
