"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(df: DataFrame, feature: str, properties: str) -> DataFrame:
    """Properties (named with their types), geometry (its JSON text as it stands) and geometry_type of a column of features' texts; other columns go."""
    own = df.select(F.from_json(F.get_json_object(feature, "$.properties"), f"struct<{properties}>").alias("p"), F.get_json_object(feature, "$.geometry").alias("geometry"))
    return own.select("p.*", "geometry", F.get_json_object("geometry", "$.type").alias("geometry_type"))


def _properties(raw: DataFrame) -> str:
    """The properties' names and types, as inferred from whole files or lines."""
    kind = raw.schema
    if "features" in raw.columns:
        kind = kind["features"].dataType.elementType
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind["properties"].dataType)


def read_geojson(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """Properties, geometry and geometry_type of the features of collections, one a file; properties are inferred where not given."""
    text = spark.read.text(path, wholetext=True)
    return features_of_text(text, "value", properties or _properties(spark.read.option("multiLine", True).json(path)))


def read_geojson_lines(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """The same of files with a feature a line, which are split among tasks."""
    return parsed(spark.read.text(path).where("trim(value) <> ''"), "value", properties or _properties(spark.read.json(path)))


def features_of_text(df: DataFrame, text: str, properties: str) -> DataFrame:
    """Features of collections held as text; properties names their fields and types."""
    return parsed(df.select(F.explode(F.from_json(text, "struct<features:array<string>>")["features"]).alias("f")), "f", properties)


def polygons(geometry: Column) -> Column:
    """The polygons of a Polygon's or MultiPolygon's text, without z; null for other kinds."""

    def rings(of: Column) -> Column:
        return F.transform(of, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))

    coordinates, kind = F.get_json_object(geometry, "$.coordinates"), F.get_json_object(geometry, "$.type")
    one = F.array(rings(F.from_json(coordinates, "array<array<array<double>>>")))
    many = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), rings)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def features(df: DataFrame, polygon: str) -> DataFrame:
    """(value): a feature a row, as a line of GeoJSON."""
    rings = F.transform(polygon, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    properties = F.struct(*[c for c in df.columns if c != polygon])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson_lines(df: DataFrame, polygon: str, path: str) -> None:
    features(df, polygon).write.mode("overwrite").text(path)
