"""Shapefiles: features of .shp files with the attributes of the .dbf files beside them.

A file is read whole by one task; the format bounds it at 2 GB, and files are spread over tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.overlay import _nested

# Fixed values of the format: kinds of shapes, with z and with measures.
POINTS, LINES, POLYGONS = (1, 11, 21), (3, 13, 23), (5, 15, 25)


def geometry_of(shape: bytes) -> dict | None:
    """A record's content as a GeoJSON geometry without z; null shapes give null."""
    (kind,) = struct.unpack_from("<i", shape, 0)
    if kind == 0:
        return None
    if kind in POINTS:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<2d", shape, 4))}
    if kind not in LINES + POLYGONS:
        raise ValueError(f"shapes of kind {kind} are not read")
    n_parts, n_points = struct.unpack_from("<2i", shape, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", shape, 44), n_points]
    points = np.frombuffer(shape, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    parts = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind in LINES:
        found, name = [p.tolist() for p in parts], "LineString"
    else:  # shells turn clockwise in the file
        found, name = [[r.tolist() for r in p] for p in _nested([p[::-1] for p in parts if len(p) > 3])], "Polygon"
    return {"type": name, "coordinates": found[0]} if len(found) == 1 else {"type": f"Multi{name}", "coordinates": found}


def shapes(raw: bytes) -> Iterator[dict | None]:
    at = 100
    while at + 8 <= len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        yield geometry_of(raw[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def attributes(raw: bytes) -> Iterator[dict[str, str | None] | None]:
    """Each row's values as text, blank ones null; null for a row marked as deleted."""
    rows, begin, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    for k in range(rows):
        row, found = raw[begin + k * width : begin + (k + 1) * width], {}
        at = 1
        for name, size in fields:
            found[name] = row[at : at + size].decode("utf-8", "replace").strip("\0 ") or None
            at += size
        yield None if row[:1] == b"*" else found


def read_shapefile(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Properties (named with their types; what can't be read as its type is null), geometry (GeoJSON text) and geometry_type of
    the features of a folder's or pattern's files. Deleted rows are left out; without a .dbf all properties are null.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"^(.*)\.(\w+)$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    pairs = files.where("kind IN ('shp', 'dbf')").groupBy("stem").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf")])

    def run(batches):
        for pdf in batches:
            for shp, dbf in zip(pdf.shp, pdf.dbf, strict=True):
                geometries = list(shapes(bytes(shp)))
                rows = list(attributes(bytes(dbf))) if dbf is not None else [{}] * len(geometries)
                kept = [(json.dumps(r), json.dumps(g) if g else None) for r, g in zip(rows, geometries, strict=True) if r is not None]
                for k in range(0, len(kept), 4096):
                    yield pd.DataFrame(kept[k : k + 4096], columns=["properties", "geometry"])

    found = pairs.where("shp IS NOT NULL").mapInPandas(run, "properties string, geometry string")
    kinds = spark.createDataFrame([], properties).schema
    own = [F.get_json_object("properties", f"$['{f.name}']").try_cast(f.dataType).alias(f.name) for f in kinds]
    return found.select(*own, "geometry", F.get_json_object("geometry", "$.type").alias("geometry_type"))
