"""Relational operators that the engine's plans are made of.  Where one key may hold much of a table, they aggregate before they shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import common_prefix_length, prefix_related
from weftline.workers import shared_folder


def with_identity(df: DataFrame, keys: list[str], *parts: Column) -> DataFrame:
    """(keys, identity): the set of the parts of each key, order and repeats aside."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*parts) if len(parts) > 1 else parts[0])).alias("identity"))


def match_counts(left: DataFrame, right: DataFrame, on: str, name: str = "matches") -> DataFrame:
    """left with the number of rows of right that are equal on a column: the arms none, one and several."""
    counts = right.groupBy(on).agg(F.count("*").alias(name))
    return left.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def first_by(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of the first row of each key, by an order of ascending columns; partial on the map side."""
    ranked = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *values)).alias("first"))
    return ranked.select(*keys, *[f"first.{v}" for v in values])


def mode_first_seen(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, value, n): each key's commonest value; among equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    return first_by(counts, keys, [-F.col("n"), F.col("seen")], [value, "n"])


def unique_winner(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """(keys, winner): the value of the first row by order, null if another row ties with it."""
    score = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    sums = df.withColumn("score", score).groupBy(*keys, "score").agg(F.count("*").alias("n"), F.max(value).alias("one"))
    best = sums.groupBy(*keys).agg(F.min(F.struct("score", "n", "one")).alias("best"))
    return best.select(*keys, F.when(F.col("best.n") == 1, F.col("best.one")).alias("winner"))


def affinity_winner(pairs: DataFrame, keys: list[str], mine: str, theirs: str, value: str) -> DataFrame:
    """(keys, winner): the value whose stem equals, or else shares the longest prefix with, one's own; null on ties or without a shared prefix."""
    shared = common_prefix_length(F.col(mine), F.col(theirs))
    scored = pairs.withColumn("shared", shared).where("shared > 0")
    return unique_winner(scored, keys, [(F.col(mine) != F.col(theirs)).cast("int"), -F.col("shared")], value)


def prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose strings are prefixes of one another, either way: an equi join on all prefixes of each."""
    longs = left.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(F.col(a), F.lit(1), i))))
    some = longs.join(right, F.col("p") == F.col(b)).drop("p")
    more = right.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(F.col(b), F.lit(1), i))))
    other = more.join(left, F.col("p") == F.col(a)).drop("p").where(F.col(a) != F.col(b))
    return some.unionByName(other.select(some.columns)).where(prefix_related(F.col(a), F.col(b)))


def lookup_or_default(left: DataFrame, right: DataFrame, ref: str, key: str, default: Column, name: str) -> DataFrame:
    """left with the key that ref names, null if it dangles, or the default where ref is null."""
    known = right.select(F.col(key).alias("known")).distinct()
    out = left.join(known, F.col(ref) == F.col("known"), "left")
    return out.withColumn(name, F.when(F.col(ref).isNotNull(), F.col("known")).otherwise(default)).drop("known")


def full_compare(left: DataFrame, right: DataFrame, key: str, value: str, only_left: str, only_right: str, differs: str, equal: str) -> DataFrame:
    """(key, status) over both tables' keys."""
    a, b = left.select(F.col(key).alias("ka"), F.col(value).alias("va")), right.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    status = F.when(F.col("ka").isNull(), only_right).when(F.col("kb").isNull(), only_left).when(F.col("va") == F.col("vb"), equal).otherwise(differs)
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), status.alias("status"))


def first_matching_step(df: DataFrame, steps: list[Column], name: str = "step") -> DataFrame:
    """Rows of the first of several conditions that any row meets, with its number."""
    number = F.coalesce(*[F.when(c, F.lit(i + 1)) for i, c in enumerate(steps)])
    rows = df.withColumn(name, number).where(F.col(name).isNotNull())
    least = rows.agg(F.min(name)).first()[0]
    return rows.where(F.col(name) == F.lit(least))


#: Rows that one range of a running sum holds, about.
ROWS_PER_RANGE = 100_000


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the sum of value over all rows before, by the columns of order, nulls first.

    Beyond one range, rows are dealt to ranges of all order columns together, as
    many as the rows need, and written with the number of their range; the sums
    of ranges come first, then the sums within each.  So no task sorts the whole
    table, and a value that many rows share spreads over several ranges by the
    columns after it.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    place = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("__v", value)
    if ranges == 1:
        before = F.sum("__v").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn(name, F.coalesce(before, F.lit(0))).drop("__v")
    path = f"{shared_folder(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(ranges, *place).withColumn("__r", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sums = rows.groupBy("__r").agg(F.sum("__v").alias("__s"))
    starts = sums.select("__r", F.coalesce(F.sum("__s").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__r").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), "__r").withColumn(name, F.col("__start") + F.coalesce(F.sum("__v").over(within), F.lit(0)))
    return out.drop("__r", "__v", "__start")


def evict_oldest(df: DataFrame, order: str, tie: str, size: str, cap: Callable[[Column], Column], protected: Column) -> DataFrame:
    """Rows to drop, oldest first, until the sizes left are at most the cap (of the total); protected rows count but stay."""
    total = df.agg(F.sum(size)).first()[0] or 0
    rows = running_sum(df.withColumn("__keep", protected), [order, tie], F.when(protected, F.lit(0)).otherwise(F.col(size)), "__before")
    return rows.where(~F.col("__keep") & (F.lit(total) - F.col("__before") > cap(F.lit(total)))).drop("__keep", "__before")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, n): rows that only one of two bags holds, counted."""
    return before.exceptAll(after).select(F.lit("removed").alias("side")).unionByName(after.exceptAll(before).select(F.lit("added").alias("side")))


def sorted_list(name: str, key: str | None = None, joiner: str = ",") -> Column:
    """Aggregate: the strings of a group in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key or name).alias("k"), F.col(name).alias("v")))), lambda x: x["v"]), joiner)
