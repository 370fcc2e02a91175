"""Grouped summaries: totals, firsts, whole-group filters, decorrelated rollups, transposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup_total(df: DataFrame, group: str, *aggregates: Column, total: str = "Total") -> DataFrame:
    """One row a group and one over all base rows; a null group stays apart from the total."""
    found = df.rollup(group).agg(F.grouping(group).alias("is_total_"), *aggregates)
    return found.withColumn(group, F.when(F.col("is_total_") == 1, total).otherwise(F.col(group))).drop("is_total_")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where both are known."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def sum_where(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def percent_where(value: Column, condition: Column) -> Column:
    """The condition's share of the group's sum, in percent."""
    return 100 * F.try_divide(F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)), F.sum(value))


def distinct_with_null(value: Column) -> Column:
    """Distinct values, null being one of them."""
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def first_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """columns of the group's first row by order, which must be total; combined before the shuffle."""
    chosen = F.min_by(F.struct(*columns), F.struct(*order)).alias("first_")
    return df.groupBy(*keys).agg(chosen).select(*keys, "first_.*")


def groups_where(df: DataFrame, keys: list[str], *, every: Column | None = None, some: list[Column] = ()) -> DataFrame:
    """Rows of the groups all of whose rows hold ``every`` and some of whose rows hold each of ``some``."""
    tests = ([F.bool_and(every)] if every is not None else []) + [F.bool_or(s) for s in some]
    found = df.groupBy(*keys).agg(*[t.alias(f"t{k}_") for k, t in enumerate(tests)])
    for k in range(len(tests)):
        found = found.where(F.col(f"t{k}_"))
    return df.join(found.select(*keys), keys, "left_semi")


def rolled_up(left: DataFrame, right: DataFrame, key: str, right_key: str, sums: dict[str, str], ids: str | None = None) -> DataFrame:
    """left with sums of right's columns (0 without rows) and its list of ids ([] without rows)."""
    aggregates = [F.sum(c).alias(name) for name, c in sums.items()] + ([F.sort_array(F.collect_set(ids)).alias("ids")] if ids else [])
    found = right.groupBy(F.col(right_key).alias("key_")).agg(*aggregates)
    joined = left.join(found, left[key] == found["key_"], "left").drop("key_")
    return joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in sums} | ({"ids": F.coalesce("ids", F.array().cast(dict(found.dtypes)["ids"]))} if ids else {}))


def top_groups(df: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    """The k groups with the greatest sum; ties by key."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def transposed(df: DataFrame, group: str, statistics: list[str], groups: list[str]) -> DataFrame:
    """A row a statistic, a column a group."""
    long = df.unpivot([group], statistics, "statistic", "value")
    return long.groupBy("statistic").pivot(group, groups).agg(F.first("value"))


def numbered(df: DataFrame, order: list[str], name: str, prefix: str = "") -> DataFrame:
    """A gapless number from 1 by order, without gathering all rows: counts by range come first.

    Rows are dealt by ranges of order, and each row's number is its rank in its range after the
    counts of the ranges before.
    """
    dealt = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    within = Window.partitionBy("part_").orderBy(*order)
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("n_"))
    # one row a range
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    placed = dealt.withColumn("rank_", F.row_number().over(within)).join(F.broadcast(before), "part_")
    number = F.col("rank_") + F.col("before_")
    return placed.withColumn(name, F.concat(F.lit(prefix), number.cast("string")) if prefix else number).drop("part_", "rank_", "before_")


def sample_by_key(df: DataFrame, key: str, n: int, prime: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """n rows that look random and are the same each time."""
    return df.orderBy((F.col(key) * prime) % modulus, key).limit(n)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """(n): how many different rows of the columns there are, nulls included."""
    return df.select(*columns).distinct().agg(F.count("*").alias("n"))


def suffix_join(left: DataFrame, right: DataFrame, name: str, suffix: str, before: str = "_", how: str = "inner") -> DataFrame:
    """left with the rows of right whose suffix, after the sign ``before``, ends left's name: an equality join.

    Every tail of the name that follows the sign is a key, so a suffix may hold the sign itself.
    """
    parts = F.split(F.col(name), before if before not in "\\^$.|?*+()[]{}" else "\\" + before)
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), before))
    keyed = left.withColumn("tail_", F.explode(F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<string>"))))
    return keyed.join(right, keyed["tail_"] == right[suffix], how).drop("tail_")
