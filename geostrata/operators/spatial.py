"""Spatial joins by grid cells, with bounding boxes before exact tests.

Both sides' boxes are dealt to the cells they meet and joined on the cell, an equality join. A pair
that shares several cells is kept in the one that holds the lower left corner of the boxes' common
part, so no pass for duplicates follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geometry import as_text, bounds, boxes_meet, clip, intersects, polygon_cells
from geostrata.functions.overlay import MULTIPOLYGON, _members, _rows, intersection, united

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_cells(df: DataFrame, size: float, prefix: str = "") -> DataFrame:
    def span(axis: str) -> Column:
        return F.sequence(F.floor(F.col(f"{prefix}{axis}min") / size).cast("long"), F.floor(F.col(f"{prefix}{axis}max") / size).cast("long"))

    return df.withColumn("cx_", F.explode(span("x"))).withColumn("cy_", F.explode(span("y")))


def spatial_join(left: DataFrame, right: DataFrame, size: float, exact: Column | None = None) -> DataFrame:
    """Pairs whose boxes meet, and for which exact holds.

    left has its box in l_xmin, l_ymin, l_xmax, l_ymax, right in r_xmin and so on; other names must
    differ. Rows with a null in their box join nothing. size should be near the larger boxes' width.
    """
    pairs = with_cells(left, size, "l_").join(with_cells(right, size, "r_"), ["cx_", "cy_"])
    corner_x, corner_y = F.floor(F.greatest("l_xmin", "r_xmin") / size), F.floor(F.greatest("l_ymin", "r_ymin") / size)
    pairs = pairs.where((corner_x == F.col("cx_")) & (corner_y == F.col("cy_")) & boxes_meet("l_", "r_"))
    return (pairs.where(exact) if exact is not None else pairs).drop("cx_", "cy_")


def polygon_join(left: DataFrame, right: DataFrame, size: float, left_geometry: str, right_geometry: str) -> DataFrame:
    return spatial_join(left, right, size, intersects(left_geometry, right_geometry))


def spatial_semi_join(left: DataFrame, right: DataFrame, key: str, size: float, exact: Column | None = None) -> DataFrame:
    """left's rows, by their key, that meet any of right."""
    return left.join(spatial_join(left, right, size, exact).select(key).distinct(), key, "left_semi")


def overlay(left: DataFrame, right: DataFrame, size: float, left_geometry: str, right_geometry: str, name: str = "geometry") -> DataFrame:
    """Pairs of polygons with a common area, and that area as a multipolygon; pairs that only touch have none."""
    pairs = spatial_join(left, right, size).withColumn(name, intersection(F.array(left_geometry), F.array(right_geometry)))
    return pairs.where(F.size(name) > 0)


def _united(polygons: Column) -> Column:
    def run(groups: pd.Series) -> pd.Series:
        return pd.Series([_rows(united(_members(g))) for g in groups], dtype=object)

    return F.pandas_udf(run, MULTIPOLYGON)(as_text(polygons))


def dissolve(df: DataFrame, by: list[str], geometry: str, size: float) -> DataFrame:
    """(by..., tile_x, tile_y, geometry): the union of each group's polygons, cut by a grid of this size, a tile a row.

    Tiles bound what one task holds; a crowded one is united in parts first, dealt by hash, copies once. Tiles
    without area give no row, null polygons nothing. A null in by is a group of its own.
    """
    box = bounds(F.col(geometry))
    rows = df.where(F.col(geometry).isNotNull() & (F.size(geometry) > 0)).select(*by, F.col(geometry).alias("g_"), *[box[c].alias(c) for c in BOX])
    tile = F.struct((F.col("cx_") * size).alias("xmin"), (F.col("cy_") * size).alias("ymin"), ((F.col("cx_") + 1) * size).alias("xmax"), ((F.col("cy_") + 1) * size).alias("ymax"))
    cut = with_cells(rows, size).withColumn("g_", clip("g_", tile)).where(F.size("g_") > 0)
    keys = [*by, "cx_", "cy_"]
    part = cut.withColumn("salt_", F.pmod(F.xxhash64("g_"), F.lit(4096))).groupBy(*keys, "salt_").agg(F.collect_set("g_").alias("g_")).withColumn("g_", _united(F.col("g_")))
    for salts in (64, 1):
        part = part.withColumn("salt_", F.col("salt_") % salts).groupBy(*keys, "salt_").agg(F.flatten(F.collect_list("g_")).alias("g_")).withColumn("g_", _united(F.col("g_")))
    return part.where(F.size("g_") > 0).select(*by, F.col("cx_").alias("tile_x"), F.col("cy_").alias("tile_y"), F.col("g_").alias(geometry))


def label_raster(df: DataFrame, polygon: str, label: str, size: float, all_touched: bool = False) -> DataFrame:
    """(px, py, label): for each cell of a grid the least label of the polygons that hold its centre, or meet it with all_touched."""
    spark = df.sparkSession
    spark.udtf.register("polygon_cells", polygon_cells())
    rings = F.to_json(F.transform(polygon, lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    rows = df.where(F.col(polygon).isNotNull()).select(F.col(label).alias("label_"), rings.alias("rings"))
    cells = spark.sql(f"SELECT label_, px, py FROM {{rows}}, LATERAL polygon_cells(rings, {float(size)}D, {str(all_touched).lower()})", rows=rows)
    return cells.groupBy("px", "py").agg(F.min("label_").alias(label))
