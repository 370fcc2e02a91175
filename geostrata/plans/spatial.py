"""Queries of geometry, components, graphs, recovery, reconciliation and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.operators import centerlines as L
from geostrata.operators import components as C
from geostrata.operators import incremental as I
from geostrata.operators import pixels as P
from geostrata.operators import recovery as V
from geostrata.operators import spatial as S
from geostrata.operators.scale import shared_folder
from geostrata.plans.catalog import query
from geostrata.plans.pixels import COMPOSITE, _composite
from geostrata.sources.items import items
from geostrata.sources.tables import read_table as t
from geostrata.streaming import composites

#: Orders as points, nations as rectangles or triangles, suppliers as rectangles, on a square of 100.
POINTS_SQL = "points AS (SELECT o_orderkey, (o_orderkey * 37 % 1000) / 10.0::DOUBLE AS x, (o_custkey * 53 % 1000) / 10.0::DOUBLE AS y FROM orders)"
ZONES_SQL = "zones AS (SELECT n_nationkey, (n_nationkey % 5) * 20::DOUBLE AS xmin, (n_nationkey // 5) * 20::DOUBLE AS ymin FROM nation)"


def _points(spark, d):
    return t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 1000 / 10).alias("x"), (F.col("o_custkey") * 53 % 1000 / 10).alias("y"))


def _zones(spark, d):
    n = F.col("n_nationkey")
    return t(spark, d, "nation").select("n_nationkey", "n_name", (n % 5 * 20).cast("double").alias("xmin"), (F.floor(n / 5) * 20).cast("double").alias("ymin"))


@query(f"WITH {POINTS_SQL}, {ZONES_SQL} SELECT o_orderkey, n_nationkey FROM points JOIN zones ON x BETWEEN xmin AND xmin + 20 AND y BETWEEN ymin AND ymin + 20")
def point_in_zone_join(spark, d):
    points = _points(spark, d).select("o_orderkey", F.col("x").alias("l_xmin"), F.col("y").alias("l_ymin"), F.col("x").alias("l_xmax"), F.col("y").alias("l_ymax"))
    zones = _zones(spark, d).select("n_nationkey", F.col("xmin").alias("r_xmin"), F.col("ymin").alias("r_ymin"), (F.col("xmin") + 20).alias("r_xmax"), (F.col("ymin") + 20).alias("r_ymax"))
    return S.spatial_join(points, zones, 20.0).select("o_orderkey", "n_nationkey")


def _polygons(spark, d):
    x, y = F.col("xmin"), F.col("ymin")
    triangle = F.array(F.array(G.point(x, y), G.point(x + 15, y), G.point(x, y + 15), G.point(x, y)))
    zones = _zones(spark, d).select("n_nationkey", x.alias("r_xmin"), y.alias("r_ymin"), (x + 15).alias("r_xmax"), (y + 15).alias("r_ymax"), triangle.alias("triangle"))
    k = F.col("s_suppkey")
    a, b, w, h = k * 37 % 1000 / 10, k * 91 % 1000 / 10, (k % 7 + 1).cast("double"), (k % 5 + 1).cast("double")
    sites = t(spark, d, "supplier").select("s_suppkey", a.alias("l_xmin"), b.alias("l_ymin"), (a + w).alias("l_xmax"), (b + h).alias("l_ymax"), G.rectangle(a, b, a + w, b + h).alias("site"))
    return sites, zones


SITES_SQL = "sites AS (SELECT s_suppkey, (s_suppkey * 37 % 1000) / 10.0::DOUBLE AS a, (s_suppkey * 91 % 1000) / 10.0::DOUBLE AS b, (s_suppkey % 7 + 1)::DOUBLE AS w, (s_suppkey % 5 + 1)::DOUBLE AS h FROM supplier)"
MEET_SQL = "a <= xmin + 15 AND a + w >= xmin AND b <= ymin + 15 AND b + h >= ymin AND greatest(a, xmin) + greatest(b, ymin) <= xmin + ymin + 15"


@query(f"WITH {SITES_SQL}, {ZONES_SQL} SELECT s_suppkey, n_nationkey FROM sites JOIN zones ON {MEET_SQL}")
def polygon_intersects_join(spark, d):
    sites, zones = _polygons(spark, d)
    return S.polygon_join(sites, zones, 15.0, "site", "triangle").select("s_suppkey", "n_nationkey")


@query(f"WITH {SITES_SQL}, {ZONES_SQL} SELECT s_suppkey FROM sites WHERE EXISTS (SELECT 1 FROM zones WHERE {MEET_SQL})")
def spatial_semi_join(spark, d):
    sites, zones = _polygons(spark, d)
    return S.spatial_semi_join(sites, zones, "s_suppkey", 15.0, G.intersects("site", "triangle")).select("s_suppkey")


@query(f"WITH {SITES_SQL}, {ZONES_SQL} SELECT s_suppkey, n_nationkey, round((least(a + w, xmin + 20) - greatest(a, xmin)) * (least(b + h, ymin + 20) - greatest(b, ymin)), 6) AS area FROM sites JOIN zones ON a <= xmin + 20 AND a + w >= xmin AND b <= ymin + 20 AND b + h >= ymin WHERE (least(a + w, xmin + 20) - greatest(a, xmin)) * (least(b + h, ymin + 20) - greatest(b, ymin)) > 1e-9")
def overlay_intersection(spark, d):
    sites, _ = _polygons(spark, d)
    zones = _zones(spark, d).select("n_nationkey", F.col("xmin").alias("r_xmin"), F.col("ymin").alias("r_ymin"), (F.col("xmin") + 20).alias("r_xmax"), (F.col("ymin") + 20).alias("r_ymax"))
    cut = G.clip("site", F.struct(*[F.col(f"r_{c}").alias(c) for c in S.BOX]))
    pairs = S.spatial_join(sites, zones, 20.0).select("s_suppkey", "n_nationkey", cut.alias("part")).where(F.size("part") > 0)
    return pairs.select("s_suppkey", "n_nationkey", F.round(G.area(F.col("part")), 6).alias("area")).where("area > 1e-9")


@query(f"WITH {SITES_SQL} SELECT s_suppkey, round(w * h - CASE WHEN w * h / 16 >= 1 THEN w * h / 16 ELSE 0 END, 6) AS area, round(2 * (w + h), 6) AS length FROM sites")
def polygon_area_length(spark, d):
    """Sites with a hole of a sixteenth of their area, dropped where it is small."""
    sites, _ = _polygons(spark, d)
    x, y, w, h = F.col("l_xmin"), F.col("l_ymin"), F.col("l_xmax") - F.col("l_xmin"), F.col("l_ymax") - F.col("l_ymin")
    hole = G.rectangle(x + w / 4, y + h / 4, x + w / 2, y + h / 2)
    holed = sites.select("s_suppkey", G.without_small_holes(F.concat("site", hole), 1.0 - 1e-9).alias("p"))
    return holed.select("s_suppkey", F.round(G.area(F.col("p")), 6).alias("area"), F.round(G.length(F.col("p")[0]), 6).alias("length"))


@query(f"WITH {POINTS_SQL} SELECT o_orderkey, round(radians(x / 10 - 90) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(30 + y / 10) / 2)) * 6378137, 3) AS my FROM points")
def reproject_mercator(spark, d):
    at = G.mercator(F.col("x") / 10 - 90, 30 + F.col("y") / 10)
    return _points(spark, d).select("o_orderkey", F.round(at["x"], 3).alias("mx"), F.round(at["y"], 3).alias("my"))


@query(f"""WITH {POINTS_SQL}, c AS (SELECT sqrt(2 / 298.257222101::DOUBLE - power(1 / 298.257222101::DOUBLE, 2)) AS e),
k AS (SELECT e, radians(29.5::DOUBLE) AS p1, radians(45.5::DOUBLE) AS p2, radians(23::DOUBLE) AS p0 FROM c),
m AS (SELECT *, cos(p1) / sqrt(1 - power(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - power(e * sin(p2), 2)) AS m2,
 (1 - e * e) * (sin(p0) / (1 - power(e * sin(p0), 2)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0,
 (1 - e * e) * (sin(p1) / (1 - power(e * sin(p1), 2)) - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e)) AS q1,
 (1 - e * e) * (sin(p2) / (1 - power(e * sin(p2), 2)) - ln((1 - e * sin(p2)) / (1 + e * sin(p2))) / (2 * e)) AS q2 FROM k),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM m), g AS (SELECT *, m1 * m1 + n * q1 AS c FROM n),
s AS (SELECT o_orderkey, e, n, c, q0, sin(radians(30 + y / 10)) AS s, n * radians(x / 10 - 90 + 96) AS theta FROM points, g),
r AS (SELECT *, 6378137 * sqrt(c - n * (1 - e * e) * (s / (1 - power(e * s, 2)) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n AS rho, 6378137 * sqrt(c - n * q0) / n AS rho0 FROM s)
SELECT o_orderkey, round(rho * sin(theta), 3) AS ax, round(rho0 - rho * cos(theta), 3) AS ay FROM r""")
def reproject_albers(spark, d):
    at = G.albers(F.col("x") / 10 - 90, 30 + F.col("y") / 10)
    return _points(spark, d).select("o_orderkey", F.round(at["x"], 3).alias("ax"), F.round(at["y"], 3).alias("ay"))


@query(f"WITH {POINTS_SQL}, r AS (SELECT p_partkey % 40 AS px, p_partkey // 40 AS py, p_retailprice AS v FROM part) SELECT o_orderkey, v FROM points LEFT JOIN r ON px = CAST(floor(x / 2) AS BIGINT) AND py = CAST(floor(y / 2) AS BIGINT)")
def point_sample_raster(spark, d):
    k = F.col("p_partkey")
    raster = t(spark, d, "part").select((k % 40).alias("px"), F.floor(k / 40).alias("py"), F.col("p_retailprice").alias("v"))
    return P.sample_raster(_points(spark, d), raster, 2.0, 40, 50, "v").select("o_orderkey", "v")


@query(f"WITH {POINTS_SQL} SELECT o_orderkey, x, y FROM points WHERE x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 30 ORDER BY o_orderkey LIMIT 50")
def bbox_items(spark, d):
    return items(_points(spark, d), bbox=(20.0, 10.0, 40.0, 30.0), limit=50, order=["o_orderkey"], box=("x", "y", "x", "y"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice <= 100000 AND (o_orderstatus <> 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_custkey BETWEEN 100 AND 200")
def cql_items(spark, d):
    text = "o_totalprice<=100000 AND (o_orderstatus NE 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_custkey BETWEEN 100 AND 200"
    return items(t(spark, d, "orders"), filter=text, limit=None).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {SITES_SQL} SELECT s_suppkey FROM sites WHERE a <= 55 AND a + w >= 40 AND b <= 55 AND b + h >= 40 AND greatest(a, 40) + greatest(b, 40) <= 95 AND s_suppkey <> 7")
def cql_intersects(spark, d):
    sites, _ = _polygons(spark, d)
    return items(sites, filter="s_intersects(site, POLYGON ((40 40, 55 40, 40 55, 40 40))) AND s_suppkey != 7", limit=None).select("s_suppkey")


# --- components


def _labelled(spark, d):
    cells = _composite(spark, d).where("value > 60").select(F.col("user_id").alias("x"), F.col("day").cast("long").alias("y"))
    return C.components(cells, tile=16)


LABELS = COMPOSITE + """, cells AS MATERIALIZED (SELECT user_id AS x, CAST(day AS BIGINT) AS y, user_id * 1000 + day AS id FROM composite WHERE value > 60),
around AS (SELECT id, id + dx * 1000 + dy AS other FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
steps AS MATERIALIZED (SELECT a.id, a.other FROM around a JOIN cells b ON b.id = a.other),
reach AS (SELECT id, id AS root FROM cells UNION SELECT s.other, r.root FROM reach r JOIN steps s ON s.id = r.id),
labels AS (SELECT id, min(root) AS label FROM reach GROUP BY id), labelled AS (SELECT x, y, label FROM cells JOIN labels USING (id))"""


@query(f"WITH RECURSIVE {LABELS} SELECT size, count(*) AS n FROM (SELECT label, count(*) AS size FROM labelled GROUP BY label) GROUP BY size")
def component_sizes(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {LABELS} SELECT x, y, size FROM labelled JOIN (SELECT label, count(*) AS size FROM labelled GROUP BY label) USING (label) WHERE size >= 10")
def min_unit_filter(spark, d):
    return C.at_least(_labelled(spark, d), 10).select("x", "y", "size")


@query(f"WITH RECURSIVE {LABELS} SELECT count(*) AS cells, count(*) * 900::DOUBLE AS area, min(x) AS xmin, min(y) AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax FROM labelled GROUP BY label HAVING count(*) * 900 >= 1800")
def component_polygons(spark, d):
    return C.summaries(_labelled(spark, d)).where("area >= 1800").drop("label")


# --- graphs: an order's lines are a chain of nodes 24 apart, with a spur at each


def _combs(spark, d):
    """(o, ux, uy, vx, vy, w), and for lines the chains' points."""
    k, q = F.col("l_linenumber"), F.col("l_quantity") / 4
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), k.alias("k")).agg(F.max(q).alias("q"))
    ranked = lines.select("o", F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("k") * 24).cast("double").alias("ux"), F.lit(0.0).alias("uy"), (F.col("k") * 24).cast("double").alias("vx"), F.col("q").alias("vy")))).alias("e")).select("o", "e.*")
    chain = lines.alias("a").join(lines.alias("b"), (F.col("a.o") == F.col("b.o")) & (F.col("b.k") == F.col("a.k") + 1))
    chain = chain.select(F.col("a.o").alias("o"), F.lit(1).alias("kind"), (F.col("a.k") * 24).cast("double").alias("ux"), F.lit(0.0).alias("uy"), (F.col("b.k") * 24).cast("double").alias("vx"), F.lit(0.0).alias("vy"))
    both = ranked.select("o", "kind", "ux", "uy", "vx", "vy").union(chain)
    return both.select("o", "ux", "uy", "vx", "vy", F.hypot(F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")).alias("w"))


COMBS = """lines AS (SELECT l_orderkey AS o, l_linenumber AS k, max(l_quantity) / 4 AS q FROM lineitem GROUP BY 1, 2),
chain AS (SELECT a.o, a.k FROM lines a JOIN lines b ON a.o = b.o AND b.k = a.k + 1),
spurs AS (SELECT o, k, q, (EXISTS (SELECT 1 FROM chain c WHERE c.o = l.o AND c.k = l.k))::INT AS after, (EXISTS (SELECT 1 FROM chain c WHERE c.o = l.o AND c.k = l.k - 1))::INT AS before FROM lines l)"""


@query(f"WITH {COMBS}, kept AS (SELECT o, q AS w FROM spurs WHERE NOT (after + before = 2 AND q < 10) UNION ALL SELECT o, 24 FROM chain) SELECT o, count(*) AS edges, round(sum(w), 6) AS length FROM kept GROUP BY o")
def spur_prune(spark, d):
    return L.prune_spurs(_combs(spark, d), "o").groupBy("o").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("length"))


@query(f"""WITH {COMBS}, joints AS (SELECT o, k FROM spurs WHERE after + before = 2),
tips AS (SELECT s.o, s.k, s.q FROM spurs s WHERE after + before = 1),
found AS (SELECT j.o, s.q AS w FROM joints j JOIN spurs s ON s.o = j.o AND s.k = j.k UNION ALL
 SELECT a.o, 24 FROM joints a JOIN joints b ON a.o = b.o AND b.k = a.k + 1 UNION ALL
 SELECT t.o, t.q + 24 FROM tips t JOIN joints j ON j.o = t.o AND abs(j.k - t.k) = 1 UNION ALL
 SELECT a.o, a.q + 24 + b.q FROM tips a JOIN tips b ON a.o = b.o AND b.k = a.k + 1 UNION ALL
 SELECT o, q FROM spurs WHERE after + before = 0)
SELECT o, count(*) AS n, round(sum(w), 6) AS length FROM found WHERE w >= 20 OR o NOT IN (SELECT o FROM joints) GROUP BY o""")
def branch_split(spark, d):
    """Of all combs; where none has a joint, each piece is a branch, whatever its length."""
    return L.split_branches(_combs(spark, d), "o").groupBy("o").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("length"))


@query("""WITH RECURSIVE steps AS (SELECT o_custkey AS c, row_number() OVER w AS k, (o_orderkey % 50 + 1)::DOUBLE AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
totals AS (SELECT c, sum(s) AS total, max(k) AS last FROM steps GROUP BY c),
shares AS (SELECT c, total, last, total / greatest(1, ceil(total / 100) - CASE WHEN total % 100 < 50 AND ceil(total / 100) > 1 THEN 1 ELSE 0 END) AS share FROM totals WHERE total > 150),
run AS (SELECT c, 0::BIGINT AS k, 0::DOUBLE AS run, 0 AS seg, 0::DOUBLE AS s, FALSE AS cut FROM shares UNION ALL
 SELECT r.c, t.k, CASE WHEN r.cut THEN 0 ELSE r.run END + t.s, r.seg + r.cut::INT, t.s, CASE WHEN r.cut THEN 0 ELSE r.run END + t.s >= h.share FROM run r JOIN steps t ON t.c = r.c AND t.k = r.k + 1 JOIN shares h ON h.c = r.c)
SELECT c, CAST(seg AS INTEGER) AS segment, round(sum(s), 6) AS segment_length FROM run WHERE k > 0 GROUP BY c, seg UNION ALL SELECT c, 0, total FROM totals WHERE total <= 150""")
def line_segments(spark, d):
    """Lines straight along x, a step an order."""
    steps = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: (k % 50 + 1).cast("double"))
    lines = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(steps.alias("steps"))
    ends = F.aggregate("steps", F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    lines = lines.select("c", F.transform(ends, lambda x: G.point(x, F.lit(0.0))).alias("line"))
    return L.cut_lines(lines, "line").select("c", "segment", F.round("segment_length", 6).alias("segment_length"))


# --- recovery: customers are sites, suppliers baselines, nations ecoregions


def _series(spark, d, name, key, prefix):
    """Wide pseudo-indices of three years, from a table's keys and balances."""
    k, b = F.col(key), F.col(f"{prefix}_acctbal")
    columns = [(((k * (j + 3) + y * 7) % 50 + 25) / 100 + b / 1e6).alias(f"{i}_{y}") for j, i in enumerate(("NDVI", "NBR", "NDMI")) for y in (2000, 2001, 2002)]
    return V.long_series(t(spark, d, name).select(k.alias("id"), F.col(f"{prefix}_nationkey").alias("region"), *columns), ["id", "region"])


def _series_sql(name, key, prefix):
    one = [f"SELECT {key} AS id, {prefix}_nationkey AS region, {y} AS year, '{i}' AS idx, (({key} * {j + 3} + {y * 7}) % 50 + 25) / 100.0::DOUBLE + {prefix}_acctbal / 1e6::DOUBLE AS v FROM {name}" for j, i in enumerate(("NDVI", "NBR", "NDMI")) for y in (2000, 2001, 2002)]
    return " UNION ALL ".join(one)


ARM = f"""sites AS ({_series_sql("customer", "c_custkey", "c")}), bases AS ({_series_sql("supplier", "s_suppkey", "s")}),
own AS (SELECT id, region, year, ((avg(v) FILTER (idx = 'NDVI') + avg(v) FILTER (idx = 'NBR')) / 2 + avg(v) FILTER (idx = 'NDMI')) / 2 AS metric FROM sites GROUP BY ALL),
base AS (SELECT region, year, ((avg(v) FILTER (idx = 'NDVI') + avg(v) FILTER (idx = 'NBR')) / 2 + avg(v) FILTER (idx = 'NDMI')) / 2 AS baseline FROM bases GROUP BY ALL),
arm AS (SELECT id, region, year, metric, baseline, metric / baseline AS ratio FROM own LEFT JOIN base USING (region, year))"""


def _arm(spark, d):
    return V.ratios(_series(spark, d, "customer", "c_custkey", "c"), _series(spark, d, "supplier", "s_suppkey", "s"), ["id"], "region")


@query(f"WITH {ARM} SELECT id, region, CAST(year AS INTEGER) AS year, round(metric, 6) AS metric, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio FROM arm")
def arm_ratio(spark, d):
    return _arm(spark, d).select("id", "region", "year", *[F.round(c, 6).alias(c) for c in ("metric", "baseline", "ratio")])


@query(f'WITH {ARM} SELECT id, round(max(ratio) FILTER (year = 2000), 6) AS "2000", round(max(ratio) FILTER (year = 2001), 6) AS "2001", round(max(ratio) FILTER (year = 2002), 6) AS "2002" FROM arm GROUP BY id')
def arm_wide(spark, d):
    return V.wide_series(_arm(spark, d).withColumn("ratio", F.round("ratio", 6)), ["id"], "year", "ratio", [2000, 2001, 2002])


@query("""WITH series AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, max(value) / 100 AS ratio FROM events GROUP BY ALL), last AS (SELECT user_id, min(day) AS last FROM series GROUP BY 1)
SELECT user_id, min(day) FILTER (ratio >= 0.7 AND ratio < 0.8) AS ytr_70, min(day) FILTER (ratio >= 0.8 AND ratio < 0.9) AS ytr_80, min(day) FILTER (ratio >= 0.9 AND ratio < 0.95) AS ytr_90,
 min(day) FILTER (ratio >= 0.95 AND ratio < 0.99) AS ytr_95, min(day) FILTER (ratio >= 0.99) AS ytr_99 FROM (SELECT s.* FROM series s JOIN last USING (user_id) WHERE day > last + 4) GROUP BY user_id
UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, NULL FROM last WHERE user_id NOT IN (SELECT user_id FROM series JOIN last USING (user_id) WHERE day > last + 4)""")
def recovery_year(spark, d):
    series = t(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg((F.max("value") / 100).alias("ratio"))
    last = series.groupBy("user_id").agg(F.min("day").alias("last"))
    return V.recovery_years(series.join(last, "user_id"), ["user_id"], "day", "ratio", "last")


# --- reconciliation and streaming


def _files(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    name = F.concat(y.cast("string"), F.lit("_"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("_activeMining"), F.when(k % 3 == 0, "_PROVISIONAL").otherwise(""), F.lit(".geojson"))
    return t(spark, d, "orders").select(k.alias("id"), F.left(name, F.lit(7)).alias("key"), name.alias("name"))


FILES = "files AS (SELECT o_orderkey AS id, year(o_orderdate) || '_' || lpad((o_orderkey % 40)::VARCHAR, 2, '0') || '_activeMining' || CASE WHEN o_orderkey % 3 = 0 THEN '_PROVISIONAL' ELSE '' END || '.geojson' AS name FROM orders)"


@query(f"WITH {FILES} SELECT name[:7] AS key, arg_min(id, row(contains(name, 'PROVISIONAL')::INT, id)) AS id, arg_min(CASE WHEN contains(name, 'PROVISIONAL') THEN 'provisional' ELSE 'final' END, row(contains(name, 'PROVISIONAL')::INT, id)) AS data_status FROM files GROUP BY 1")
def final_over_provisional(spark, d):
    files = _files(spark, d)
    return I.current(files, ["key"], F.contains("name", F.lit("PROVISIONAL")), ["id"]).select("key", "id", I.status(F.col("name")).alias("data_status"))


@query(f"WITH {FILES} SELECT id FROM files f WHERE contains(name, 'PROVISIONAL') AND EXISTS (SELECT 1 FROM files g WHERE g.name[:7] = f.name[:7] AND NOT contains(g.name, 'PROVISIONAL'))")
def superseded_files(spark, d):
    return I.superseded(_files(spark, d), ["key"], F.contains("name", F.lit("PROVISIONAL"))).select("id")


@query(f"WITH {FILES} SELECT name[:9] AS key, min(name) AS name FROM files GROUP BY 1")
def cumulative_keep(spark, d):
    return I.first_names(_files(spark, d), "name")


@query("SELECT y AS year FROM (SELECT CAST(unnest(range(1990, 2005)) AS INTEGER) AS y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)")
def missing_years(spark, d):
    wanted = spark.range(1990, 2005).select(F.col("id").cast("int").alias("year"))
    return I.missing(wanted, t(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct(), ["year"])


@query("SELECT user_id AS pixel, CAST(ts AS DATE) AS day, max(value) AS quality, arg_max(event_id, row(value, event_id)) AS tie FROM events GROUP BY ALL")
def stream_daily_composite(spark, d):
    """A file stream run to its end; each call has its own state, in the folder that the session names."""
    schema = t(spark, d, "events").schema
    stream = composites.read_stream(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/composite_{uuid.uuid4().hex}"
    return composites.run_to_table(composites.daily_composite(stream, "ts", "user_id", "value", "event_id", "60 days"), ["pixel", "day"], folder)
