"""Final over provisional: tags, supersession, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(name: Column) -> Column:
    return F.when(F.contains(F.upper(name), F.lit("PROVISIONAL")), "provisional").otherwise("final")


def current(df: DataFrame, keys: list[str], provisional: Column, order: list[str]) -> DataFrame:
    """One row a key: a final one if there is any, the first by order. Combined before the shuffle."""
    whole = F.struct(*df.columns)
    best = df.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.min_by(whole, F.struct(provisional.cast("int").alias("p"), *order)).alias("best_"))
    return best.select("best_.*")


def superseded(df: DataFrame, keys: list[str], provisional: Column) -> DataFrame:
    """Provisional rows whose key has a final one, which a target should delete."""
    finals = df.where(~provisional).select(*keys).distinct()
    return df.where(provisional).join(finals, keys, "left_semi")


def first_names(df: DataFrame, name: str, width: int = 9) -> DataFrame:
    """(key, name): the least name of each prefix."""
    return df.groupBy(F.left(name, F.lit(width)).alias("key")).agg(F.min(name).alias("name"))


def missing(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys), keys, "left_anti")
