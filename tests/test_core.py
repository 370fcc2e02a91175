"""Reads, writes and small operators without SQL, on made files and shapes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.functions import values as X
from geostrata.operators import centerlines as L
from geostrata.operators import components as C
from geostrata.operators import pixels as P
from geostrata.operators import scale
from geostrata.operators import thresholds as T
from geostrata.sources import geojson, tables

SQUARE = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]


def feature(name, geometry):
    return {"type": "Feature", "properties": {"name": name, "year": 2000}, "geometry": geometry}


def test_geojson_of_mixed_kinds_and_round_trip(spark, tmp_path):
    both = [feature("one", {"type": "Polygon", "coordinates": SQUARE}), feature("two", {"type": "MultiPolygon", "coordinates": [SQUARE, [[[9, 9, 1], [10, 9, 1], [9, 10, 1], [9, 9, 1]]]]}), feature("none", None)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": both}, indent=1))
    (tmp_path / "lines.geojsonl").write_text("\n".join(map(json.dumps, both)) + "\n\n")
    for found in (geojson.read_geojson(spark, str(tmp_path / "a")), geojson.read_geojson_lines(spark, str(tmp_path / "lines.geojsonl"), "name string, year int")):
        rows = {r["name"]: r for r in found.withColumn("parts", geojson.polygons(F.col("geometry"))).collect()}
        assert json.loads(rows["one"].geometry) == both[0]["geometry"] and json.loads(rows["two"].geometry) == both[1]["geometry"]
        assert rows["one"].year == 2000 and rows["two"].geometry_type == "MultiPolygon" and len(rows["two"].parts) == 2 and rows["none"].parts is None
        assert [(p.x, p.y) for p in rows["two"].parts[1][0]] == [(9, 9), (10, 9), (9, 10), (9, 9)]
    made = spark.range(3).select("id", G.rectangle(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(2)).alias("p"))
    geojson.write_geojson_lines(made, "p", str(tmp_path / "out"))
    again = geojson.read_geojson_lines(spark, str(tmp_path / "out"), "id long").select("id", geojson.polygons(F.col("geometry"))[0].alias("p"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.collect()))


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,x\n1,,NA\n2,"a,b",2.5\n')
    (tmp_path / "cr.csv").write_bytes(b"id,name\r1,a\r2,b\r")
    (tmp_path / "ids.csv").write_text("id,\nx1,\nx2,\n")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, "", None), (2, "a,b", 2.5)]
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "cr.csv"), "\r").collect()] == [(1, "a"), (2, "b")]
    assert [r.id for r in tables.read_id_list(spark, str(tmp_path / "ids.csv")).collect()] == ["x1", "x2"]
    tables.write_csv(spark.createDataFrame([(1, None), (2, "b")], "id int, name string"), str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out")).collect())) == [(1, None), (2, "b")]
    assert [r.path.rsplit("/", 1)[1] for r in tables.listing(spark, str(tmp_path), "ids.csv").collect()] == ["ids.csv"]


def test_appends_are_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        tables.append(batch, path, ["id"])
    tables.append(spark.createDataFrame([(2, "x"), (3, "c")], "id int, v string"), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        tables.require_unique(batch, ["id"])
    years = str(tmp_path / "y")
    tables.write_missing(batch.withColumn("year", F.lit(1)), years, "year")
    tables.write_missing(batch.withColumn("year", F.explode(F.array(F.lit(1), F.lit(2)))), years, "year")
    assert {r.year: r["count"] for r in spark.read.parquet(years).groupBy("year").count().collect()} == {1: 3, 2: 3}


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    found = tables.reindex(df, ["z", "y", "x"], {"z": "double", "x": "long"})
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("z", "double"), ("y", "string"), ("x", "bigint")] and tuple(found.first()) == (None, "a", 1)
    assert tables.move_first(df, "y").columns == ["y", "x"] and tables.strict_drop(df, ["y"]).columns == ["x"]
    with pytest.raises(ValueError):
        tables.strict_drop(df, ["q"])


def edges(lines):
    return [(1, *map(float, a), *map(float, b), math.dist(a, b)) for a, b in lines]


def test_longest_spine_takes_the_shortest_way_round_a_cycle(spark):
    rows = edges([((0, 0), (6, 8)), ((6, 8), (12, 0)), ((0, 0), (12, 0)), ((12, 0), (15, 0))])
    found = L.longest_spine(spark.createDataFrame(rows, f"k int, {L.EDGE}"), "k").first()
    assert found.length == 15.0 and [(p.x, p.y) for p in found.line] in ([(0, 0), (12, 0), (15, 0)], [(15, 0), (12, 0), (0, 0)])


def test_outlines_with_holes_and_corners(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if not (x, y) in {(2, 2), (1, 1)}]
    inner, corner = [(2, 2)], [(10, 10), (11, 11)]
    cells = spark.createDataFrame([(*c, "a") for c in ring] + [(*c, "b") for c in inner] + [(*c, "c") for c in corner], "x long, y long, label string")
    found = {r.label: [[[(p.x, p.y) for p in q] for q in poly] for poly in r.polygons] for r in C.outlines(cells, 2.0).collect()}
    shoelace = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2
    for label, n in (("a", len(ring)), ("b", 1), ("c", 2)):
        assert sum(abs(shoelace(p[0])) - sum(abs(shoelace(h)) for h in p[1:]) for p in found[label]) == 4 * n
    assert len(found["a"]) == 1 and len(found["b"]) == 1 and len(found["c"]) == 2 and all(q[0] == q[-1] for p in found["a"] for q in p)


def test_cells_of_polygons_equal_cell_by_cell(spark):
    rng = np.random.default_rng(4)
    for _ in range(6):
        corners = rng.uniform(0, 20, (3, 2))
        ring = np.vstack([corners, corners[:1]])
        text = json.dumps([[{"x": x, "y": y} for x, y in ring.tolist()]])
        for touched in (False, True):
            got = set(G.PolygonCells().eval(text, 1.5, touched))
            expected = set()
            for px in range(-1, 15):
                for py in range(-1, 15):
                    x, y = px * 1.5, py * 1.5
                    cell = np.array([(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5), (x, y)])
                    if G.polygons_meet([ring], [cell]) if touched else G.polygon_holds([ring], x + 0.75, y + 0.75):
                        expected.add((px, py))
            assert got == expected


def test_cumulative_and_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), strict=True)] + [(None, 5), (1, None)]
    df = spark.createDataFrame(rows, "g int, v int")
    counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n")).repartition(5)
    for r in scale.cumulative(counts, ["g"], F.col("v"), ["n"]).collect():
        assert r.n_before == sum(g == r.g and v is not None and v < r.v for g, v in rows)
    for r in scale.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect():
        own = [v for g, v in rows if g == r.g and v is not None]
        assert [r.a, r.b, r.c] == pytest.approx(np.quantile(own, [0.1, 0.5, 1.0]).tolist())
    assert scale.quantiles(df, [], "v", {"m": 0.5}).first().m == np.quantile([v for _, v in rows if v is not None], 0.5)


def test_auc_interval(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 30) + 6 * p), bool(p)) for p in rng.integers(0, 2, 150)]
    found = T.auc_interval(spark.createDataFrame(rows, "s double, p boolean"), [], "s", F.col("p")).first()
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    win = np.array([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    error = 1.959963984540054 * math.sqrt(win.mean(1).var(ddof=1) / len(pos) + win.mean(0).var(ddof=1) / len(neg))
    assert (found.auc, found.low, found.high) == pytest.approx((win.mean(), win.mean() - error, win.mean() + error))


def test_remap_labels_and_cut_fill(spark):
    df = spark.range(1)
    assert df.select(X.remapped(F.lit(1), [0, 1], [100, -10]).alias("v")).first().v == -10
    assert df.select(X.labelled_blank(F.lit(" "), "none").alias("v")).first().v == "none"
    found = P.cut_fill(spark.createDataFrame([(1, 100.0, 60.0), (1, 100.0, 150.0), (1, 100.0, 110.0)], "z int, a double, b double"), ["z"], "a", "b", 4.0)
    assert {r.type: (r.area_m2, r.volume_m3, r.elev_change_min) for r in found.collect()} == {"cut": (4.0, -160.0, -40.0), "fill": (4.0, 200.0, 50.0)}


def test_reprojection_there_and_back(spark):
    square = G.rectangle(F.lit(-82.0), F.lit(37.0), F.lit(-81.5), F.lit(37.5))
    r = spark.range(1).select(square.alias("p")).select("p", G.reprojected(G.reprojected(F.col("p"), 4326, 3857), 3857, 4326).alias("q"), G.utm17(F.lit(-81.0), F.lit(0.0)).alias("o")).first()
    assert all(a.x == pytest.approx(b.x) and a.y == pytest.approx(b.y) for a, b in zip(r.p[0], r.q[0], strict=True)) and (r.o.x, r.o.y) == pytest.approx((500000, 0))


def test_simplify_and_wkb(spark):
    line = [(0, 0), (1, 0.1), (2, 0), (3, 2), (4, 0)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in line],), (None,)], f"l {G.RING}")
    assert [r.s and [(p.x, p.y) for p in r.s] for r in df.select(G.simplify(F.col("l"), 0.5).alias("s")).collect()] == [[(0, 0), (2, 0), (3, 2), (4, 0)], None]
    rings = [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]
    assert G.rings_of_wkb(G.wkb_of(rings)) == rings
