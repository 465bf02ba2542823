"""Character n-gram features: term and document frequencies, vocabulary, TF-IDF weights.

Features stay a long table (id, gram, value): no row holds a vocabulary, and every step is an
aggregation with partial sums. The vocabulary is bounded by `max_features`. Models, which need no table of
all grams of all texts, take `gram_counts` and `vectors`: the same numbers, counted over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleforge.functions.text import char_ngrams, ngram_text, replace_surrogates
from titleforge.session import cut_lineage, tasks_for

SIZES = (2, 3, 4, 5)


def term_frequencies(titles: DataFrame, *, id_col: str = "id", text: str = "title", sizes: Sequence[int] = SIZES) -> DataFrame:
    """(id, gram, tf). Null texts and texts below the smallest size have no rows.

    Texts are spread first, as a small text makes many rows; grams of a text stay where it is, so
    counting them needs no further shuffle."""
    spread = titles.select(id_col, text).repartition(tasks_for(titles, 5_000), id_col)
    return spread.select(id_col, F.explode(char_ngrams(F.col(text), sizes)).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(gram, df, tf) over all texts."""
    return tf.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(df: DataFrame, texts: int, *, max_df: float = 0.98, max_features: int = 80_000) -> DataFrame:
    """(index, gram, df, tf) of at most `max_features` grams, those of most occurrences, ties by gram."""
    if max_features > 1_000_000:
        raise ValueError("the vocabulary must stay small enough for every task")
    df = cut_lineage(df.where(F.col("df") <= max_df * texts))
    # only grams of enough occurrences are ordered: a table of few rows tells how many that takes
    size = F.floor(F.log2(F.col("tf").cast("double")) * 8)
    steps = df.groupBy(size.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect()
    seen, least = 0, None
    for step in steps:
        seen, least = seen + step.n, step.step
        if seen >= max_features:
            break
    top = df.where(size >= F.lit(least)).orderBy(F.col("tf").desc(), "gram").limit(max_features)
    return top.select((F.row_number().over(Window.orderBy(F.col("tf").desc(), "gram")) - 1).cast("int").alias("index"), "gram", "df", "tf")


def tfidf(tf: DataFrame, vocab: DataFrame, texts: int, *, id_col: str = "id") -> DataFrame:
    """(id, index, gram, weight): (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), of length 1 per text.

    The vocabulary is broadcast: its size is bounded by its own parameter."""
    raw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * (F.log(F.lit(1.0 + texts) / (F.lit(1.0) + F.col("df"))) + 1)
    rows = tf.join(F.broadcast(vocab.select("index", "gram", "df")), "gram").select(id_col, "index", "gram", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return rows.select(id_col, "index", "gram", (F.col("raw") / norm).alias("weight"))


TOGETHER = 1_000_000  # code points whose grams are counted at once


def plain(titles: DataFrame, text: str = "title") -> DataFrame:
    """`titles` with the column _t that `counted` and `vectors` read."""
    return titles.withColumn("_t", replace_surrogates(ngram_text(F.col(text))))


def counted(texts: Sequence[str], sizes: Sequence[int] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(number of the text, number of the gram, tf) as arrays, and the grams; several such for many texts.

    A gram's number is made from that of its first signs and its last sign, so it fits whatever the signs."""
    lengths, begin = np.fromiter(map(len, texts), np.int64, len(texts)), 0
    upto = np.cumsum(lengths)
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - lengths[begin] + TOGETHER, "right")))
        joined, own = "".join(texts[begin:end]), lengths[begin:end]
        text = np.repeat(np.arange(begin, end), own)
        left = np.repeat(upto[begin:end] - upto[begin] + own[0], own) - np.arange(len(text))
        signs, sign = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_inverse=True)
        number = np.zeros(len(text), np.int64)
        for size in range(1, max(sizes) + 1):
            at = np.flatnonzero(left >= size)
            some, first, gram = np.unique(number[at] * len(signs) + sign[at + size - 1], return_index=True, return_inverse=True)
            number[at] = gram
            if size in sizes and len(at):
                pair, tf = np.unique(text[at] * len(some) + gram, return_counts=True)
                yield pair // len(some), pair % len(some), tf, [joined[p : p + size] for p in at[first].tolist()]
        begin = end


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, df, tf) over all texts _t: `document_frequencies` of `term_frequencies`, without a row for each gram of each text."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, gram, tf, grams in counted(batch.column("_t").to_pylist()):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "df": np.bincount(gram), "tf": np.bincount(gram, weights=tf).astype(np.int64)})

    return texts.select("_t").mapInArrow(some, "gram string, df long, tf long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def lookup(vocab: DataFrame, texts: int) -> tuple[dict[str, int], np.ndarray]:
    """A vocabulary for `vectors`: the index of each gram, and ln((1 + n) / (1 + df)) + 1 by index; bounded as it is."""
    table = vocab.select("index", "gram", "df").toPandas()
    idf = np.zeros(len(table))
    idf[table["index"]] = np.log((1.0 + texts) / (1.0 + table["df"].to_numpy(float))) + 1
    return dict(zip(table["gram"], table["index"].tolist(), strict=True)), idf


def vectors(texts: Sequence[str], known: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of `tfidf` for some texts _t: how many each text has, and text by text their index and weight."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for text, gram, tf, grams in counted(texts):
        index = np.fromiter((known.get(g, -1) for g in grams), np.int64, len(grams))[gram]
        parts.append((text[index >= 0], index[index >= 0], tf[index >= 0]))
    text, index, tf = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    text, index, raw = text[order], index[order], ((1 + np.log(tf)) * idf[index])[order]
    norm = np.sqrt(np.bincount(text, weights=raw * raw, minlength=len(texts)))
    return np.bincount(text, minlength=len(texts)), index, raw / norm[text]


def class_weights(labels: DataFrame, label: str = "gold_label") -> DataFrame:
    """(label, n, weight): n / (classes * n of the class)."""
    per = labels.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return per.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")).cast("double"))
