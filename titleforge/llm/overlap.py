"""Problem 2: the same or nearly the same titles in training and evaluation splits.

Exact prefix-filter bipartite join on rare shingles. Titles are first joined into classes of equal
letters and digits. Each evaluation class is indexed by its rarest disjoint shingles (the prefix
that no set of the allowed edits can break whole); training classes probe with their shingles,
filtered by length, by position on both sides and by letter bags; what meets is verified by edit
distance. A table of hash bits of the index drops most probes before they are shuffled. Rarity comes
from a table of bounded size and only steers the choice; the probes of each shingle are counted
exactly, and shingles that very many probes share are salted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.arrow import bucket_counts, merged_array, over_batches
from titleforge.llm.codepoints import from_codepoints, to_codepoints
from titleforge.llm.edits import EditSignatures, bucket_of, letter_bags, letter_keys
from titleforge.llm.visual import unify
from titleforge.session import cut_lineage, tasks_for

ENTRY = "class_id long, h long, place int, size int, bag long"


def title_keys(titles: DataFrame, *, id_col: str = "title_id", text: str = "title", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, kept columns) per row: letters and digits of the plain form in lower case. Rows with a null text or id are left out."""
    schema = f"id long, key string{''.join(f', {c} string' for c in keep)}"

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        points, offsets, _ = to_codepoints(batch.column(1))
        points, offsets, _ = unify(points, offsets)
        return {"id": batch.column(0), "key": from_codepoints(*letter_keys(points, offsets)), **{c: batch.column(2 + k) for k, c in enumerate(keep)}}

    return over_batches(titles.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("key"), *keep), make, schema)


def table_size(entries: int, least: int = 1 << 16, most: int = 1 << 22) -> int:
    """The buckets of a table for so many entries: a power of two, at most `most` whatever the data."""
    return min(most, max(least, 1 << max(entries - 1, 1).bit_length()))


def shingle_costs(classes: DataFrame, sig: EditSignatures, rows: int) -> np.ndarray:
    """What a shingle of each bucket costs: the logarithm of the probes in it, over all of `classes` (class_id, key)."""
    size = table_size(2 * rows)

    def buckets(batch: pa.RecordBatch) -> np.ndarray:
        points, offsets, _ = to_codepoints(batch.column(1))
        return bucket_of(sig.probes(points, offsets)[2], size)

    return np.log1p(bucket_counts(classes, buckets, size)).astype(np.float32)


def entries(batch: pa.RecordBatch, sig: EditSignatures, costs: np.ndarray | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, columns) of a batch (class_id, key): its index entries if costs are given, else its probes."""
    ids = np.asarray(batch.column(0))
    points, offsets, _ = to_codepoints(batch.column(1))
    sizes, bags = np.diff(offsets), letter_bags(points, offsets)
    row, place, h = sig.probes(points, offsets) if costs is None else sig.index(points, offsets, costs)
    few, variant = sig.variants(points, offsets, sig.short + (sig.edits if costs is None else 0))
    row, place, h = np.concatenate([row, few]), np.concatenate([place, np.zeros(len(few), np.int64)]), np.concatenate([h, variant])
    return row, {"class_id": ids[row], "h": h.view(np.int64), "place": place.astype(np.int32), "size": sizes[row].astype(np.int32), "bag": bags[row]}


def crowded(entries: DataFrame, most: int, size: int = 1 << 18) -> DataFrame | None:
    """The rows of `entries` (h, ...) whose shingle may occur more than `most` times: those of full buckets
    of a table of fixed size. None if there are none, as on most data; what is left is to be counted exactly."""

    def buckets(batch: pa.RecordBatch) -> np.ndarray:
        return bucket_of(np.asarray(batch.column(0)).view(np.uint64), size)

    full = bucket_counts(entries.select("h"), buckets, size) > most
    if not full.any():
        return None
    return entries.mapInArrow(lambda batches: (b.filter(pa.array(full[buckets(b)])) for b in batches), entries.schema)


def near_classes(classes: DataFrame, edits: int = 3) -> DataFrame:
    """(train_class, eval_class): the classes within `edits` edits of each other, themselves excepted.

    `classes` has class_id, key (unique), in_train and in_eval."""
    sig = EditSignatures(edits)
    train, evaluation = (classes.where(c).select("class_id", "key") for c in ("in_train", "in_eval"))
    costs = shingle_costs(train, sig, train.count())
    index = cut_lineage(over_batches(evaluation, lambda b: entries(b, sig, costs)[1], ENTRY))
    size = 8 * table_size(2 * index.count())

    def mark(bits: np.ndarray, batch: pa.RecordBatch) -> None:
        at = bucket_of(np.asarray(batch.column(0)).view(np.uint64), size)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    there = merged_array(index.select("h"), mark, size // 8, np.bitwise_or, np.uint8)

    def asked(batch: pa.RecordBatch) -> dict[str, object]:
        out = entries(batch, sig, None)[1]
        at = bucket_of(out["h"].view(np.uint64), size)
        hit = (there[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return {k: v[hit] for k, v in out.items()}

    probe = cut_lineage(over_batches(train, asked, ENTRY))
    maybe = crowded(probe.select("h"), sig.salt_rows)
    if maybe is not None:
        hot = maybe.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > sig.salt_rows).select("h", (F.floor(F.col("n") / sig.salt_rows) + 1).cast("int").alias("parts"))
        hot, parts = cut_lineage(hot), F.coalesce("parts", F.lit(1))
        probe = probe.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("class_id"), parts).cast("int"))
        index = index.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        probe, index = probe.withColumn("salt", F.lit(0)), index.withColumn("salt", F.lit(0))
    probe, index = probe.alias("t"), index.alias("e")
    left, right = F.col("t.place") - F.col("e.place"), (F.col("t.size") - F.col("t.place")) - (F.col("e.size") - F.col("e.place"))
    met = (
        probe.join(index, (F.col("t.h") == F.col("e.h")) & (F.col("t.salt") == F.col("e.salt")) & (F.col("t.class_id") != F.col("e.class_id")))
        .where((F.abs(left) + F.abs(right) <= edits) & (F.bit_count(F.col("t.bag").bitwiseXOR(F.col("e.bag"))) <= 2 * edits))
        .select(F.col("t.class_id").alias("train_class"), F.col("e.class_id").alias("eval_class"))
        .distinct()
    )
    texts = classes.select("class_id", "key")
    return (
        met.join(texts.withColumnsRenamed({"class_id": "train_class", "key": "train_key"}), "train_class")
        .join(texts.withColumnsRenamed({"class_id": "eval_class", "key": "eval_key"}), "eval_class")
        .where(F.levenshtein("train_key", "eval_key", edits) >= 0)
        .select("train_class", "eval_class")
    )


def cross_split_overlaps(titles: DataFrame, edits: int = 3, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """(members, links) of the overlaps between split `train` and the others.

    members: id, split, source, class_id of every title that has an id and is not null (redelivered rows once).
    links: train_class, eval_class, also of a class with itself if both sides hold it. Copies are
    not expanded. Titles without letters and digits form one class. An empty table gives none;
    rows with a null split count as evaluation rows of split null."""
    rows = title_keys(titles, keep=("split", "source")).groupBy("id").agg(F.min("key").alias("key"), F.min("split").alias("split"), F.min("source").alias("source"))
    rows = cut_lineage(rows)
    is_train = F.coalesce(F.col("split") == train, F.lit(False))
    # the checkpoint keeps these partitions: cutting shingles takes longer than their bytes tell
    classes = cut_lineage(rows.repartition(tasks_for(rows), "key").groupBy("key").agg(F.min("id").alias("class_id"), F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval")))
    members = rows.join(classes.select("key", "class_id"), "key").select("id", "split", "source", "class_id", is_train.alias("is_train"))
    same = classes.where("in_train and in_eval").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"))
    return members, near_classes(classes, edits).unionByName(same)


def overlap_pairs(titles: DataFrame, edits: int = 3) -> DataFrame:
    """p2_found: every pair of a training title and one of another split within the allowed edits, a_id < b_id."""
    members, links = cross_split_overlaps(titles, edits)
    a = members.where("is_train").select(F.col("id").alias("t"), F.col("class_id").alias("train_class"))
    b = members.where("not is_train").select(F.col("id").alias("e"), F.col("class_id").alias("eval_class"))
    return links.join(a, "train_class").join(b, "eval_class").select(F.least("t", "e").alias("a_id"), F.greatest("t", "e").alias("b_id"))


def overlap_report(titles: DataFrame, edits: int = 3) -> DataFrame:
    """(split, source, titles, exact, near): evaluation titles with a partner in training, by split and source."""
    members, links = cross_split_overlaps(titles, edits)
    best = links.groupBy("eval_class").agg(F.max(F.col("train_class") == F.col("eval_class")).alias("same"))
    found = members.where("not is_train").join(best, F.col("class_id") == F.col("eval_class"), "left")
    return found.groupBy("split", "source").agg(
        F.count("*").alias("titles"), F.count_if(F.coalesce("same", F.lit(False))).alias("exact"), F.count_if(~F.coalesce("same", F.lit(True))).alias("near")
    )
