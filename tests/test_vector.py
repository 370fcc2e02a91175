"""Overlays, buffers, dissolving and thinning against point membership and plain versions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geostrata.functions import geometry as G
from geostrata.functions import overlay as O
from geostrata.operators import centerlines as L
from geostrata.operators import spatial as S
from geostrata.operators import thinning

RULES = [lambda s: s.all(1), lambda s: s.any(1), lambda s: s[:, 0] & ~s[:, 1:].any(1)]


def star(rng, n, reach, spread):
    turns, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(reach / 3, reach, n)
    ring = rng.uniform(0, spread, 2) + np.c_[far * np.cos(turns), far * np.sin(turns)]
    return np.vstack([ring, ring[:1]])


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def area(polygons):
    return sum(O.signed_area(r) for p in polygons for r in p)


@pytest.mark.parametrize("seed", range(24))
def test_combined_holds_the_points_it_should(seed):
    rng = np.random.default_rng(seed)
    if seed % 2:
        polygons = [[star(rng, rng.integers(3, 12), 3, 5)] for _ in range(rng.integers(2, 5))]
    else:  # shared edges and corners, holes
        polygons = [[box(*rng.integers(0, 8, 2), *rng.integers(3, 6, 2))] for _ in range(rng.integers(2, 5))]
        polygons = [[r, box(*(r[0] + 1), *(r[2] - r[0] - 2))] for (r,) in polygons]
    points = rng.uniform(-4, 14, (300, 2))
    inside = np.array([[G.polygon_holds(p, *q) for p in polygons] for q in points])
    for rule in RULES:
        found = O.combined(polygons, rule)
        assert [sum(G.polygon_holds(p, *q) for p in found) for q in points] == rule(inside).astype(int).tolist()
        assert all(O.signed_area(p[0]) > 0 and all(O.signed_area(h) < 0 for h in p[1:]) for p in found)


def test_union_of_many_in_rounds_and_with_itself():
    rng = np.random.default_rng(9)
    stars = [[star(rng, 8, 6, 60)] for _ in range(90)]
    found = O.united(stars)
    points = rng.uniform(0, 60, (400, 2))
    assert [sum(G.polygon_holds(p, *q) for p in found) for q in points] == [int(any(G.polygon_holds(p, *q) for p in stars)) for q in points]
    assert area(O.united(found + stars)) == pytest.approx(area(found), rel=1e-6)
    assert O.united([]) == [] and O.combined([[box(0, 0, 1, 1)], [box(1, 0, 1, 1)]], RULES[0]) == []


def test_buffers_have_their_area_and_distance():
    cap = 2 * O.QUARTER * math.sin(math.pi / 2 / O.QUARTER)
    assert area(O.buffered([box(1, 2, 3, 2)], [[box(1, 2, 3, 2)]], 0.7)) == pytest.approx(6 + 10 * 0.7 + cap * 0.49)
    assert area(O.buffered([np.array([(5.0, 5.0)])], [], 2.0)) == pytest.approx(cap * 4)
    rng = np.random.default_rng(1)
    line = np.cumsum(rng.normal(0, 1, (12, 2)), 0)
    found = O.buffered([line], [], 0.8)
    for p in rng.uniform(line.min(0) - 1, line.max(0) + 1, (300, 2)):
        a, d = line[:-1], np.diff(line, axis=0)
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        far = np.hypot(*(a + t[:, None] * d - p).T).min()
        if abs(far - 0.8) > 0.01:  # circles have sides
            assert sum(G.polygon_holds(q, *p) for q in found) == (far < 0.8)


def test_columns_with_nulls_and_empties(spark):
    square = G.rectangle(F.lit(0), F.lit(0), F.lit(4), F.lit(4))
    df = spark.range(1).select(F.array(square).alias("a"), F.array(G.rectangle(F.lit(1), F.lit(1), F.lit(2), F.lit(9))).alias("b"), F.lit(None).cast(O.MULTIPOLYGON).alias("n"), F.array().cast(O.MULTIPOLYGON).alias("e"))
    r = df.select(*[O.multi_area(f(F.col("a"), F.col("b"))) for f in (O.intersection, O.union, O.difference)], O.intersection("a", "n"), O.intersection("a", "e"), O.multi_area(O.union("a", "e")), O.buffer("n", 1.0), O.buffer("e", 1.0)).first()
    assert list(r) == [3.0, 21.0, 13.0, None, [], 16.0, None, []]


def test_dissolve_keeps_groups_tiles_and_copies(spark):
    rows = [(1, 0, 0, 5, 5), (1, 3, 3, 5, 5), (1, 3, 3, 5, 5), (None, 0, 0, 2, 2), (None, 1, 0, 2, 2), (2, 20, 20, 1, 1)]
    df = spark.createDataFrame(rows, "k int, x int, y int, w int, h int").select("k", G.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("g"))
    df = df.union(spark.range(1).select(F.lit(1), F.lit(None).cast(G.POLYGON)))
    found = S.dissolve(df, ["k"], "g", 4.0)
    assert {r.k: r.a for r in found.groupBy("k").agg(F.sum(O.multi_area("g")).alias("a")).collect()} == {1: 46.0, None: 6.0, 2: 1.0}
    assert found.count() == found.select("k", "tile_x", "tile_y").distinct().count()
    assert S.dissolve(df.limit(0), ["k"], "g", 4.0).count() == 0


def slow_thinned(cells):
    """Zhang and Suen's rule cell by cell."""
    cells = set(cells)
    while True:
        before = len(cells)
        for second in (False, True):
            gone = set()
            for x, y in cells:
                p = [(x + dx, y + dy) in cells for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                pairs = ((0, 2, 6), (0, 4, 6)) if second else ((0, 2, 4), (2, 4, 6))
                if 2 <= sum(p) <= 6 and turns == 1 and not any(all(p[k] for k in three) for three in pairs):
                    gone.add((x, y))
            cells -= gone
        if len(cells) == before:
            return cells


@pytest.mark.parametrize("tile, passes", [(256, 16), (8, 1), (8, 2)])
def test_thinning_by_tiles_equals_the_whole(spark, tile, passes):
    rng = np.random.default_rng(5)
    cells = {(int(x) + i, int(y) + j) for x, y in rng.integers(-12, 20, (14, 2)) for i in range(7) for j in range(5)}
    df = spark.createDataFrame([(k, *c) for k in (1, None) for c in cells] + [(1, None, 3)] + [(1, *next(iter(cells)))], "k int, x long, y long")
    found = thinning.thin(df, keys=["k"], tile=tile, passes=passes).collect()
    for k in (1, None):
        assert sorted((r.x, r.y) for r in found if r.k == k) == sorted(slow_thinned(cells))
    assert thinning.thin(df.limit(0), keys=["k"]).count() == 0


def test_thinned_cells_query(spark):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("year(o_orderdate) AS year", "o_orderkey * 37 % 1000 AS x", "o_custkey * 53 % 1000 AS y").collect()
    found = entry.queries()["thinned_cells"](spark, sf_dir).collect()
    for year in {r.year for r in orders}:
        cells = {(r.x + i, r.y + j) for r in orders if r.year == year for i in (-1, 0, 1) for j in (-1, 0, 1)}
        assert sorted((r.x, r.y) for r in found if r.year == year) == sorted(slow_thinned(cells))


def test_segments_of_odd_features(spark):
    schema = f"k int, lines array<{G.RING}>"
    way = [{"x": 10.0 * n, "y": 0.0} for n in range(18)]
    df = spark.createDataFrame([(1, [way]), (2, None), (3, []), (4, [way[:1]]), (5, [way[:2], way[:2]])], schema)
    found = {(r.k, r.branch, r.segment): r.segment_length for r in L.segments(df, "k", "lines").collect()}
    assert found == {(1, 0, 0): 90.0, (1, 0, 1): 80.0, (5, 0, 0): 10.0}
