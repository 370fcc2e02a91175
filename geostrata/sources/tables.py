"""Reads, key guards and writes of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, line_end: str | None = None, schema: str | None = None) -> DataFrame:
    """CSV of the statistics dialect: a header, NA for null, and blanks that stay blanks in columns of text.

    Spark's reader takes NA and blanks for the same, so all columns are read as text first.
    """
    reader = spark.read.option("header", True)
    if line_end:
        reader = reader.option("lineSep", line_end)
    kinds = reader.schema(schema) if schema else reader.option("inferSchema", True).option("nullValue", "NA")
    fields = kinds.csv(path).schema.fields
    text = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "")
    text = (text.option("lineSep", line_end) if line_end else text).schema(", ".join(f"`{f.name}` string" for f in fields)).csv(path)

    def column(f: StructField) -> Column:
        own = F.col(f"`{f.name}`")
        known = F.when(F.coalesce(own, F.lit("")) != "NA", F.coalesce(own, F.lit("")))
        return (known if isinstance(f.dataType, StringType) else F.nullif(known, F.lit("")).cast(f.dataType)).alias(f.name)

    return text.select(*map(column, fields))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """The first column, as id, of CSV lists whose rows end in an empty column."""
    found = spark.read.option("header", True).csv(path)
    return found.select(F.col(f"`{found.columns[0]}`").alias("id"))


def listing(spark: SparkSession, path: str, suffix: str = "", pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files under path, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.where(F.col("path").endswith(suffix)).select("path", "length", F.col("modificationTime").alias("modified"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if found := duplicate_keys(df, keys).head(1):
        raise ValueError(f"several rows have the key {found[0].asDict()}")
    return df


def append(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append rows whose keys the target hasn't yet, one of each key, so that a repeated load changes nothing."""
    if keys:
        df = df.dropDuplicates(keys)
    if keys and _exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_missing(df: DataFrame, path: str, partition: str) -> None:
    """Write only the partitions that the target lacks."""
    if _exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(partition).distinct(), partition, "left_anti")
    df.write.partitionBy(partition).mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def reindex(df: DataFrame, columns: Iterable[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """These columns in this order; null where df lacks one, of the type that kinds names, or else string."""
    kinds = kinds or {}
    return df.select(*[(F.col(c).cast(kinds[c]) if c in kinds else F.col(c)).alias(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns])


def strict_drop(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df without the columns, all of which it must have."""
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def move_first(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[c for c in df.columns if c not in columns])


def by_prefix(df: DataFrame, path: str, prefix: str, names: dict[str, int], separator: str = "_") -> DataFrame:
    """Files whose name begins with a prefix, with fields of the rest of the name, split at a separator, by their place; null where there is none. A folder's own row is left out."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    fields = F.split(F.regexp_replace(F.substr(name, F.lit(len(prefix) + 1)), r"\.[^.]*$", ""), F.lit(f"\\Q{separator}\\E"))
    return df.where((name != "") & name.startswith(prefix)).withColumns({n: F.get(fields, F.lit(k)) for n, k in names.items()})


def read_jdbc(spark: SparkSession, url: str, table: str, split: str | None = None, parts: int = 16, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database's table or (query) alias; with an integer column to split by, its range is read in parts at once (its name goes in ANSI quotes)."""
    reader = spark.read.format("jdbc").options(url=url, fetchsize=fetch, **options)
    if split is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f'(SELECT MIN("{split}") AS low_, MAX("{split}") AS high_ FROM {table}) bounds_').load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.options(dbtable=table, partitionColumn=split, lowerBound=low, upperBound=high, numPartitions=parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, parts: int = 16, **options: str) -> None:
    """df appended to a database's table, some connections at once, each row in a batch."""
    df.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode("append").save()
