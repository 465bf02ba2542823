"""Problem 8: every text as the ids of a public tokenizer.

Byte-level vocabularies use overlapping chunk encoding: long texts are cut into overlapping chunks
that tasks pre-tokenise in parallel; neighbouring chunks are stitched at a place of their overlap
where both have a pre-token boundary, and the pieces between such places are encoded by themselves.
A cut is made only behind a sign that is no white space, where pre-tokenising a piece alone gives
the same pre-tokens as pre-tokenising the whole. Chunks whose overlap holds no such place (a run
longer than it) are joined again before encoding, so the ids never depend on the chunk size."""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 32_768, 1_024  # code points
ROWS = 500


def vocabulary_folder() -> str:
    """Where the vocabulary files lie: TITLEFORGE_TOKENIZERS or the default folder."""
    return os.environ.get("TITLEFORGE_TOKENIZERS", FOLDER)


@lru_cache(4)
def _ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(Path(folder) / f"{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(8)
def encoder(name: str, folder: str) -> Callable[[str], list[int]]:
    """Text to ids, without special tokens; their strings are ordinary text."""
    if (Path(folder) / f"{name}.tiktoken").exists():
        import tiktoken

        return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(folder, name), special_tokens={}).encode_ordinary
    if (Path(folder) / f"{name}.json").exists():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(str(Path(folder) / f"{name}.json"))
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / f"{name}.model")).encode


def is_byte_level(name: str, folder: str) -> bool:
    return (Path(folder) / f"{name}.tiktoken").exists()


def boundaries(text: str) -> list[int]:
    """The pre-token boundaries of a text at which it may be cut: not at its end, not behind white space."""
    import regex

    return [m.start() for m in regex.finditer(PATTERN, text) if m.start() and not _is_space(text[m.start() - 1])]


def _is_space(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch)[0] == "Z"


def _pieces(long: DataFrame, id_col: str, chunk: int, overlap: int) -> DataFrame:
    """(id, piece, text): the texts of `long` cut at places where neighbouring chunks resynchronise."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), (F.greatest(n - overlap, F.lit(1)) - 1).cast("int"), F.lit(chunk))
    cut = long.select(id_col, "text", F.posexplode(starts).alias("k", "start"))
    # the text is cut before the shuffle that spreads the chunks
    cut = cut.select(id_col, "k", "start", F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("text"))
    # by number, as chunks are few and small beside the work on them, which a shuffle sized by bytes would give to one task
    cut = cut.repartition(max(2, long.sparkSession.sparkContext.defaultParallelism), id_col, "k")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at = np.array(boundaries(text), np.int64)
                heads.append((at[at < overlap] + start).tolist())
                tails.append((at[at >= chunk] + start).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    whole = T.ArrayType(T.LongType())
    marked = cut.mapInArrow(mark, T.StructType([*cut.schema.fields, T.StructField("head", whole), T.StructField("tail", whole)]))
    w = f"PARTITION BY {id_col} ORDER BY k"
    joined = marked.selectExpr(
        "*",
        f"array_min(array_intersect(head, lag(tail) OVER ({w}))) AS begin",
        f"array_min(array_intersect(tail, lead(head) OVER ({w}))) AS stop",
        f"lead(start) OVER ({w}) AS after",
    )
    owned = joined.selectExpr(
        id_col, "k", f"sum(CASE WHEN begin IS NULL THEN 0 ELSE 1 END) OVER ({w}) AS piece",
        "substring(text, coalesce(begin, start) - start + 1, coalesce(stop, after, start + length(text)) - coalesce(begin, start)) AS part",
    )
    return owned.groupBy(id_col, "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))


def _encoded(df: DataFrame, name: str, folder: str, count_only: bool) -> DataFrame:
    """`df` with its last column, the text, replaced by ids or their number."""
    kept = df.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        # few texts at a time: their ids as Python numbers need more room than the texts
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = [encode(x) if x else [] for x in batch.column(len(kept)).to_pylist()]
            last = pa.array([len(x) for x in ids], pa.int32()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], last], names=[*(f.name for f in kept), "n_tokens" if count_only else "ids"])

    last = T.StructField("n_tokens", T.IntegerType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, T.StructType([*kept, last]))


def _run(documents: DataFrame, id_col: str, text: str, name: str, folder: str | None, chunk: int, overlap: int, count_only: bool) -> DataFrame:
    folder = folder or vocabulary_folder()
    rows = documents.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    if not is_byte_level(name, folder):
        return _encoded(rows, name, folder, count_only)
    is_long: Column = F.length("text") > chunk + overlap
    short = _encoded(rows.where(~is_long | F.col("text").isNull()), name, folder, count_only)
    # repeated rows of one id stay apart
    long = rows.where(is_long).withColumn("_row", F.struct(id_col, F.monotonically_increasing_id().alias("at")))
    parts = _encoded(_pieces(long.select("_row", "text"), "_row", chunk, overlap), name, folder, count_only).groupBy("_row")
    if count_only:
        whole = parts.agg(F.sum("n_tokens").cast("int").alias("n_tokens"))
    else:
        whole = parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.select(F.col("_row")[id_col].alias(id_col), "n_tokens" if count_only else "ids"))


def token_ids(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    null_ids: tuple[int, ...] = (),
    empty_ids: tuple[int, ...] = (),
) -> DataFrame:
    """(id, ids) of every row: the ids of its whole text, without special tokens.

    A null text has `null_ids`, an empty one `empty_ids`; both are the empty list by default, as
    special tokens are left out. Repeated rows give repeated rows; an empty table gives none. Other
    columns of `documents` are not read. Vocabularies that are not byte-level encode texts whole."""
    source = documents
    out = _run(source, id_col, text, tokenizer, folder, chunk, overlap, False)
    if null_ids or empty_ids:
        special = source.where(F.col(text).isNull() | (F.col(text) == "")).select(
            id_col, F.when(F.col(text).isNull(), F.lit(list(null_ids)).cast("array<int>")).otherwise(F.lit(list(empty_ids)).cast("array<int>")).alias("ids")
        )
        full = _run(source.where(F.col(text) != ""), id_col, text, tokenizer, folder, chunk, overlap, False)
        return full.unionByName(special)
    return out


def token_counts(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens) of every row; 0 for null and empty texts."""
    return _run(documents, id_col, text, tokenizer, folder, chunk, overlap, True)


def decoded(encoded: DataFrame, *, id_col: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, text) of byte-level ids: their raw bytes one after another. Null ids give null; unknown ids raise."""
    folder = folder or vocabulary_folder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {v: k for k, v in _ranks(folder, tokenizer).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(raw[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    chosen = encoded.select(id_col, ids)
    return chosen.mapInArrow(run, T.StructType([chosen.schema.fields[0], T.StructField("text", T.StringType())]))
