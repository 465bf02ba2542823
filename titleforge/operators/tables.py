"""Small relational operators: ordinals, splits, checks, keys as sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Row numbers from 1 in the order of the source's partitions, without moving rows: the partitions'
    sizes, one row each, give the offsets. The source, such as a file, must read the same twice."""
    numbered = df.select("*", F.monotonically_increasing_id().alias("_at"))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.withColumn("_part", part).join(F.broadcast(before), "_part").select((F.col("_before") + inside + 1).alias(name), *df.columns)


def ordered_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Row numbers from 1 in the total order of `order`, for tables of any size.

    Rows are range-partitioned and sorted; each partition numbers its rows, and the partitions'
    sizes, one row each, give the offsets. No single task sees all rows."""
    # sorted output is materialised, as both reads must see the same partitions
    from titleforge.session import cut_lineage

    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    placed = placed.withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_at", "_in", "_before")


def ordinal_id(prefix: Column, ordinal: Column) -> Column:
    """prefix-0001; wider beyond 9,999."""
    return F.format_string("%s-%04d", prefix, ordinal)


def group_ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(`df` with row numbers from 0 in each group, (by, n) with the groups' sizes), for groups of any size.

    Rows are numbered in the order of group and `order` over all partitions; a group's first number
    comes off. No task sees a whole group; nulls are a group."""
    rows = ordered_ordinal(df, [*by, *order], "_all")
    groups = rows.groupBy(*by).agg(F.min("_all").alias("_first"), F.count("*").alias("n"))
    joined = join_null_safe(rows, groups.drop("n"), by)
    return joined.select(*df.columns, (F.col("_all") - F.col("_first")).alias(name)), groups.drop("_first")


def join_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on equal columns `by`, where null equals null; `by` comes out once."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    return left.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by))).drop(*(f"_right_{c}" for c in by))


def head_per_group(df: DataFrame, n: int, *, by: str, order: str) -> DataFrame:
    """The first n rows of each group in `order`. Partial tops: a group is cut before its rows meet."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def positional_split(df: DataFrame, dev: int, test: int, *, ordinal: str = "ordinal") -> DataFrame:
    """`df` with split train, dev or test: the last `test` ordinals, the `dev` before them, the rest."""
    total = df.count()
    if dev <= 0 or test <= 0 or dev + test >= total:
        raise ValueError("development and test sizes must be positive and leave a training row")
    at = F.col(ordinal)
    return df.withColumn("split", F.when(at <= total - dev - test, "train").when(at <= total - test, "dev").otherwise("test"))


def latest_row(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of greatest `order` per key, by partial maxima; further columns break ties."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order)))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def label_violations(df: DataFrame, label: str = "gold_label") -> DataFrame:
    """(label, n): every label that is not Yes or No, null included."""
    return df.where(F.col(label).isNull() | ~F.col(label).isin("Yes", "No")).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, names: Sequence[str], what: str = "the table") -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{what} is missing columns: {missing}")
