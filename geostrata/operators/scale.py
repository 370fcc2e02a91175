"""Running sums and joins that no hot key or single window gathers on one task; checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where none is named and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="geostrata-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def heavy_join(left: DataFrame, sized: DataFrame, keys: list[str], n: str, parts: int = 1000) -> DataFrame:
    """left joined with sized (keys, n, others) on the keys, where n counts left's rows of the keys.

    Keys with more than a ``parts``-th of all rows counted are fewer than ``parts``: those rows of sized
    are broadcast, and a hot key's rows stay where they are. The rest are joined by a shuffle. left is
    read twice.
    """
    most = (sized.agg(F.sum(n)).first()[0] or 0) / parts
    marked = left.join(F.broadcast(sized.where(F.col(n) > most).withColumn("is_hot", F.lit(True))), keys, "left")
    met = [*left.columns, *[c for c in sized.columns if c not in keys]]
    rest = marked.where("is_hot IS NULL").select(left.columns).join(sized.where(F.col(n) <= most), keys)
    return marked.where("is_hot").select(met).unionByName(rest.select(met))


def cumulative(df: DataFrame, by: list[str], order: Column, sums: list[str]) -> DataFrame:
    """df with, for each column c of sums, c_before: its sum over the group's rows that come before by order, which must be total.

    Rows are dealt by ranges of by and order, so that a group may lie in many tasks; what the tasks pass
    on to each other is a row for each task and group.
    """
    dealt = checkpointed(df.repartitionByRange(*by, order).withColumn("part_", F.spark_partition_id()))
    own = dealt.groupBy(*by, "part_").agg(*[F.sum(c).alias(f"{c}_part") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(*by, "part_", *[F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums])
    within = Window.partitionBy(*by, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_run") for c in sums])
    same = F.col("r.part_") == F.col("o.part_")
    for c in by:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    met = run.alias("r").join(offsets.alias("o"), same)
    return met.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], *[(F.col(f"o.{c}_offset") + F.col(f"r.{c}_run")).alias(f"{c}_before") for c in sums])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., a column for each of shares): exact quantiles with linear interpolation, nulls left out.

    Values are counted first and ranked by ranges, so that no group's values meet in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = cumulative(counts, by, F.col("v"), ["n"])
    total = counts.groupBy(*by).agg(F.sum("n").alias("all_"))
    if by:
        same = F.lit(True)
        for c in by:
            same &= F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}"))
        known = ranked.alias("k").join(total.alias("t"), same).select("k.*", "all_")
    else:
        known = ranked.join(F.broadcast(total))  # one row
    picked = []
    for name, share in shares.items():
        at = (F.col("all_") - 1) * share
        low, high = F.floor(at), F.ceil(at)

        def holds(rank: Column) -> Column:
            return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))

        picked.append((F.max(F.when(holds(low), F.col("v"))) + (F.max(F.when(holds(high), F.col("v"))) - F.max(F.when(holds(low), F.col("v")))) * F.max(at - low)).alias(name))
    return known.groupBy(*by).agg(*picked) if by else known.agg(*picked)
