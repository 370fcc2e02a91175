"""Per-pixel time series: composites, cleaning in time, zonal reduction, neighbourhoods.

A raster is a long table of cells and times; a masked cell is null or has no row. The windows of
temporal cleaning share one partitioning by pixel, so the three passes cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.scale import quantiles


def quality_mosaic(df: DataFrame, keys: list[str], quality: str, tie: list[str], bands: list[str]) -> DataFrame:
    """All bands of the row with the greatest quality of each key; null quality never wins, ties by greatest tie."""
    known = df.where(F.col(quality).isNotNull())
    best = F.max_by(F.struct(*bands), F.struct(quality, *tie)).alias("best_")
    return known.groupBy(*keys).agg(best).select(*keys, "best_.*")


def period_reducers(value: Column, percent: float = 0.15) -> dict[str, Column]:
    return {
        "least": F.min(value), "most": F.max(value), "mean": F.avg(value), "middle": F.median(value), "low": F.percentile(value, F.lit(percent)),
        "count": F.count(value), "any_nonzero": F.coalesce(F.bool_or(value != 0), F.lit(False)),
    }


def dense_series(df: DataFrame, pixel: list[str], times: DataFrame, time: str, value: str) -> DataFrame:
    """A row for each pixel and time of the short list ``times``; value null where df has none."""
    pixels = df.select(*pixel).distinct()
    return pixels.crossJoin(F.broadcast(times.select(time))).join(df.select(*pixel, time, value), [*pixel, time], "left")


def temporal_clean(df: DataFrame, pixel: list[str], time: str, raw: str) -> DataFrame:
    """df, dense, with filled (null between ones is one), despiked (a lone one is none), cleaned (a lone gap is filled).

    Beyond the ends lie zeros, but ones for the spikes, so that an end is never a spike.
    """
    w = Window.partitionBy(*pixel).orderBy(time)

    def beside(c: str, beyond: int) -> tuple[Column, Column]:
        return F.lag(c, 1, beyond).over(w), F.lead(c, 1, beyond).over(w)

    df = df.withColumn("known_", F.coalesce(raw, F.lit(0)))
    before, after = beside("known_", 0)
    df = df.withColumn("filled", F.when(F.col(raw).isNull() & (before == 1) & (after == 1), 1).otherwise(F.col("known_")))
    before, after = beside("filled", 1)
    df = df.withColumn("despiked", F.when((F.col("filled") == 1) & (before == 0) & (after == 0), 0).otherwise(F.col("filled")))
    before, after = beside("despiked", 0)
    return df.withColumn("cleaned", F.when((F.col("despiked") == 0) & (before == 1) & (after == 1), 1).otherwise(F.col("despiked"))).drop("known_")


def running_last(df: DataFrame, pixel: list[str], time: str, mask: str, name: str = "last") -> DataFrame:
    """The latest time up to and with each row at which mask was 1."""
    w = Window.partitionBy(*pixel).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(F.when(F.col(mask) == 1, F.col(time))).over(w))


def zonal(df: DataFrame, zones: DataFrame, cell: list[str], by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of the cells whose centre lies in a zone; zones maps cells to zones."""
    return df.join(zones, cell).groupBy(*by).agg(*aggregates)


def interval_mean(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """(by..., threshold): mean of the values between two percentiles of their group, both included; a group's values may lie in many tasks."""
    bounds = quantiles(df, by, value, {"low_": low, "high_": high})
    return df.join(bounds, by).where(F.col(value).between(F.col("low_"), F.col("high_"))).groupBy(*by).agg(F.avg(value).alias("threshold"))


def neighbourhood(df: DataFrame, x: str, y: str, keys: list[str], radius: int = 1, round_: bool = False) -> DataFrame:
    """Each cell of df for each cell in its kernel: (keys..., x, y, and df's other columns), x and y being the target's."""
    steps = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if not round_ or dx * dx + dy * dy <= radius * radius]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps])).alias("step_")
    others = [c for c in df.columns if c not in (x, y)]
    return df.select(*others, x, y, offsets).select(*others, (F.col(x) + F.col("step_.dx")).alias(x), (F.col(y) + F.col("step_.dy")).alias(y))


def dilate(df: DataFrame, x: str, y: str, keys: list[str], radius: int = 1) -> DataFrame:
    """Cells with a set cell in their square; df has the set cells."""
    return neighbourhood(df.select(*keys, x, y), x, y, keys, radius).distinct()


def erode(df: DataFrame, x: str, y: str, keys: list[str], radius: int = 1) -> DataFrame:
    """Cells all of whose square is set."""
    near = neighbourhood(df.select(*keys, x, y), x, y, keys, radius)
    full = near.groupBy(*keys, x, y).agg(F.count("*").alias("n_")).where(F.col("n_") == (2 * radius + 1) ** 2)
    return full.drop("n_")


def mosaic(df: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """The value on top: of the greatest priority that has one."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, priority).alias(value))


def sample_raster(points: DataFrame, raster: DataFrame, size: float, columns: int, rows: int, value: str) -> DataFrame:
    """points (x, y, ...) with the value of their cell (px, py); null beyond the raster's bounds, no point is lost."""
    at = points.withColumns({"px": F.floor(F.col("x") / size).cast("long"), "py": F.floor(F.col("y") / size).cast("long")})
    inside = F.col("px").between(0, columns - 1) & F.col("py").between(0, rows - 1)
    return at.join(raster.select("px", "py", value), ["px", "py"], "left").withColumn(value, F.when(inside, F.col(value)))


def cut_fill(pixels: DataFrame, by: list[str], before: str, after: str, cell_area: float, least: float = 20.0) -> DataFrame:
    """(by..., type, area_m2, volume_m3, elev_*): of pixels whose elevation changed by more than ``least``, by zone and sign.

    elev_post_min and so on hold the least and greatest elevations of both times and their changes.
    """
    change = F.col(after) - F.col(before)
    rows = pixels.withColumn("change_", change).where(F.abs("change_") > least).withColumn("type", F.when(F.col("change_") < 0, "cut").otherwise("fill"))
    aggregates = [(F.count("*") * cell_area).alias("area_m2"), (F.sum("change_") * cell_area).alias("volume_m3")]
    aggregates += [f(c).alias(f"elev_{name}_{kind}") for kind, f in (("min", F.min), ("max", F.max)) for name, c in (("post", after), ("pre", before))]
    found = rows.groupBy(*by, "type").agg(*aggregates)
    return found.withColumns({f"elev_change_{kind}": F.col(f"elev_post_{kind}") - F.col(f"elev_pre_{kind}") for kind in ("min", "max")})
