"""Vegetation recovery: index series in long form, ratios to regional baselines, recovery years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.values import recovery_metric

#: Bands of recovery, in shares of the baseline; each ends where the next begins.
BANDS = (0.70, 0.80, 0.90, 0.95, 0.99)


def long_series(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """(ids..., index, year, value) of columns named <INDEX>_<YEAR>."""
    columns = columns or [c for c in df.columns if c not in ids]
    long = df.unpivot(ids, columns, "name_", "value")
    return long.select(*ids, F.regexp_extract("name_", r"^(.*)_(\d{4})$", 1).alias("index"), F.regexp_extract("name_", r"^(.*)_(\d{4})$", 2).try_cast("int").alias("year"), "value")


def wide_series(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """A column for each of the listed names."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def metric(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric) of long series with the means of NDVI, NBR and NDMI."""
    means = df.where(F.col("index").isin("NDVI", "NBR", "NDMI")).groupBy(*by).pivot("index", ["NDVI", "NBR", "NDMI"]).agg(F.avg("value"))
    return means.select(*by, recovery_metric(F.col("NDVI"), F.col("NBR"), F.col("NDMI")).alias("metric"))


def ratios(sites: DataFrame, baselines: DataFrame, site: list[str], region: str, year: str = "year") -> DataFrame:
    """(site..., region, year, metric, baseline, ratio): sites' metric to that of their region's baselines.

    A site in several regions has a row for each; one without a baseline has a null ratio.
    """
    own = metric(sites, [*site, region, year])
    base = metric(baselines, [region, year]).withColumnRenamed("metric", "baseline")
    return own.join(base, [region, year], "left").withColumn("ratio", F.try_divide("metric", "baseline"))


def recovery_years(df: DataFrame, site: list[str], year: str, ratio: str, last: str, grace: int = 4, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(site..., ytr_70, ...): the first year later than last + grace whose ratio is in each band."""
    late = F.col(year) > F.col(last) + grace

    def first(k: int) -> Column:
        inside = F.col(ratio) >= bands[k]
        if k + 1 < len(bands):
            inside = inside & (F.col(ratio) < bands[k + 1])
        return F.min(F.when(late & inside, F.col(year))).alias(f"ytr_{round(bands[k] * 100)}")

    return df.groupBy(*site).agg(*[first(k) for k in range(len(bands))])
