"""Shapefiles, schemas and small column functions on made files and rows."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from geostrata.functions import values as X
from geostrata.sources import schemas, shapefile, tables

SHELL, HOLE, FAR = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]


def content(kind, parts):
    if kind in (0, 1):
        return struct.pack("<i", kind) + (struct.pack("<2d", *parts) if kind else b"")
    points = [p for part in parts for p in part]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def shp(records):
    return b"\0" * 100 + b"".join(struct.pack(">2i", n, len(c) // 2) + c for n, c in enumerate(records, 1))


def dbf(fields, rows):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\x0d"
    body = b"".join(mark + b"".join(v.encode().ljust(w) for v, (_, w) in zip(row, fields, strict=True)) for mark, row in rows)
    return struct.pack("<B3xIHH20x", 3, len(rows), 32 + len(head), 1 + sum(w for _, w in fields)) + head + body


def test_shapefiles_of_all_kinds(spark, tmp_path):
    records = [content(5, [SHELL, HOLE, FAR]), content(5, [FAR]), content(0, []), content(3, [[(0, 0), (1, 1)]]), content(1, (2.5, 3.0)), content(5, [FAR])]
    (tmp_path / "a.shp").write_bytes(shp(records))
    rows = [(b" ", ("one", "1")), (b" ", ("", "x")), (b" ", ("null shape", "3")), (b" ", ("line", "4.5")), (b" ", ("point", "-5")), (b"*", ("gone", "6"))]
    (tmp_path / "a.dbf").write_bytes(dbf([("name", 12), ("size", 6)], rows))
    (tmp_path / "b.SHP").write_bytes(shp([content(1, (0.0, 1.0))]))
    found = {(r.name, r["size"]): (r.geometry_type, r.geometry and json.loads(r.geometry)["coordinates"]) for r in shapefile.read_shapefile(spark, str(tmp_path), "name string, size double").where("name IS NOT NULL").collect()}
    assert set(found) == {("one", 1.0), ("null shape", 3.0), ("line", 4.5), ("point", -5.0)}
    assert found["null shape", 3.0] == (None, None) and found["line", 4.5] == ("LineString", [[0, 0], [1, 1]]) and found["point", -5.0] == ("Point", [2.5, 3])
    kind, polygons = found["one", 1.0]
    assert kind == "MultiPolygon" and sorted(map(len, polygons)) == [1, 2] and polygons[0][1] == [list(map(float, p)) for p in HOLE[::-1]]
    rest = shapefile.read_shapefile(spark, str(tmp_path), "name string, size double").where("name IS NULL").collect()
    assert sorted((r["size"], r.geometry_type) for r in rest) == [(None, "Point"), (None, "Polygon")]


def test_schemas_tables_and_views(spark):
    df = schemas.conforming(spark.createDataFrame([(1.5, "a")], "area double, id string"), "annual_mining")
    assert df.columns == ["id", "mining_year", "area", "data_status", "geom"] and tuple(df.first()) == ("a", None, 1.5, None, None)
    with pytest.raises(ValueError):
        schemas.conforming(df.withColumn("more", F.lit(1)), "annual_mining")
    for name, keys in schemas.KEYS.items():
        assert set(keys) <= set(spark.createDataFrame([], schemas.SCHEMAS[name]).columns)
    assert schemas.create_view(df, "made_view", ["id"]).columns == ["id"] and schemas.create_view(df, "made_view").count() == 1


def test_values(spark):
    assert X.parsed_codes("A, 21, 013\nB,47,001", ["name", "state", "county"], {"fips": [1, 2]}) == [{"name": "A", "state": "21", "county": "013", "fips": 21013}, {"name": "B", "state": "47", "county": "001", "fips": 47001}]
    one = spark.range(1)
    assert tuple(one.select(X.saturated(250, F.lit(10), F.lit(251)), X.saturated(250, F.lit(10), F.lit(20)), X.share_of(F.lit(1.0), F.lit(0.0)), X.both_set(F.lit(1), F.lit(None).cast("int"))).first())[2:] == (None, None)


def test_prefixes(spark):
    df = spark.createDataFrame([("gs://b/in/",), ("gs://b/in/extent_2001_v2.tif",), ("gs://b/in/extent_2002.tif",), ("gs://b/in/other_2001_v2.tif",)], "path string")
    found = tables.by_prefix(df, "path", "extent_", {"year": 0, "version": 1}).select("year", "version").collect()
    assert sorted(map(tuple, found), key=str) == [("2001", "v2"), ("2002", None)]


def test_jdbc_in_one_and_in_parts(spark):
    url = "jdbc:derby:memory:made;create=true"
    tables.write_jdbc(spark.range(100).selectExpr("CAST(id AS INT) AS id", "id * 0.5D AS v"), url, "things", driver="org.apache.derby.jdbc.EmbeddedDriver")
    one, parts = tables.read_jdbc(spark, url, "things"), tables.read_jdbc(spark, url, "things", "id", parts=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, parts.collect())) == [(k, k / 2) for k in range(100)]
    assert parts.rdd.getNumPartitions() == 4
