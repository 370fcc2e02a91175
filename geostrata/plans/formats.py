"""Queries of formats, the two-step request, views, remaps, outlines, cut and fill, and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.functions import values as X
from geostrata.operators import centerlines as L
from geostrata.operators import components as C
from geostrata.operators import pixels as P
from geostrata.operators import relational as R
from geostrata.operators import scale
from geostrata.operators import spatial as S
from geostrata.operators import thresholds as T
from geostrata.plans.catalog import query
from geostrata.plans.spatial import COMBS, LABELS, MEET_SQL, SITES_SQL, ZONES_SQL, _combs, _labelled, _polygons
from geostrata.sources import geojson
from geostrata.sources.items import items, items_meeting
from geostrata.sources.tables import read_table as t
from geostrata.sources.tables import reindex


@query(f"WITH {SITES_SQL} SELECT s_suppkey, 'Polygon' AS geometry_type, a AS x, b AS y, round(w * h, 6) AS area FROM sites")
def geojson_features(spark, d):
    """Sites written as features and read again."""
    sites, _ = _polygons(spark, d)
    read = geojson.parsed(geojson.features(sites.select("s_suppkey", "site"), "site"), "value", "s_suppkey bigint")
    one = geojson.polygons(F.col("geometry"))[0]
    return read.select("s_suppkey", "geometry_type", one[0][0]["x"].alias("x"), one[0][0]["y"].alias("y"), F.round(G.area(one), 6).alias("area"))


@query(f"WITH {SITES_SQL} SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry_type, unnest(range(1 + s_suppkey % 2)) AS part, round(w * h, 6) AS area FROM sites")
def geojson_mixed_parts(spark, d):
    """A collection of polygons and multipolygons as one text, read and taken apart, a part a row."""
    sites, _ = _polygons(spark, d)
    ring = F.to_json(F.transform("site", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"], F.lit(0.0)))))
    single = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))
    double = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"s_suppkey":'), F.col("s_suppkey").cast("string"), F.lit('},"geometry":'), F.when(F.col("s_suppkey") % 2 == 0, single).otherwise(double), F.lit("}"))
    text = sites.groupBy((F.col("s_suppkey") % 7).alias("file")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("text"))
    read = geojson.features_of_text(text, "text", "s_suppkey bigint")
    return read.select("s_suppkey", "geometry_type", F.posexplode(geojson.polygons(F.col("geometry"))).alias("part", "one")).select("s_suppkey", "geometry_type", F.col("part").cast("long").alias("part"), F.round(G.area(F.col("one")), 6).alias("area"))


@query(f"WITH {SITES_SQL}, {ZONES_SQL} SELECT s_suppkey FROM sites, zones WHERE n_nationkey = 12 AND {MEET_SQL} AND s_suppkey % 10 <> 3")
def two_step_items(spark, d):
    """Sites that meet the one zone that a first request names, without some."""
    sites, zones = _polygons(spark, d)
    first = items(zones, filter="n_nationkey = 12", limit=1)
    return items_meeting(first, sites.withColumn("digit", F.col("s_suppkey") % 10), "triangle", "site", "digit NE 3", None).select("s_suppkey")


@query(f"WITH {SITES_SQL}, {ZONES_SQL} SELECT s_suppkey, n_nationkey, n_name FROM (SELECT s_suppkey, a + 0.03 AS a, b + 0.03 AS b, w, h FROM sites), (SELECT * FROM zones JOIN nation USING (n_nationkey)) WHERE {MEET_SQL}")
def sites_by_zone_view(spark, d):
    """A view of sites in Mercator with the zones, in tenths of degrees, that they meet."""
    sites, zones = _polygons(spark, d)
    moved = F.transform("site", lambda ring: F.transform(ring, lambda p: G.mercator((p["x"] + 0.03) / 10, (p["y"] + 0.03) / 10)))
    names = t(spark, d, "nation").select("n_nationkey", "n_name")
    shifted = sites.select("s_suppkey", *[(F.col(f"l_{c}") + 0.03).alias(f"l_{c}") for c in S.BOX], moved.alias("site"))
    tenths = F.transform(G.reprojected(F.col("site"), 3857, 4326), lambda ring: F.transform(ring, lambda p: G.point(p["x"] * 10, p["y"] * 10)))
    degrees = shifted.withColumn("site", tenths)
    S.polygon_join(degrees, zones.join(names, "n_nationkey"), 15.0, "site", "triangle").select("s_suppkey", "n_nationkey", "n_name").createOrReplaceTempView("sites_by_zone")
    return spark.table("sites_by_zone")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN -10 ELSE 0 END AS code FROM orders")
def remap_codes(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.remapped(F.col("o_orderstatus"), ["F", "O"], [100, -10], F.lit(0)).alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < CASE year(l_shipdate) WHEN 1995 THEN 10 WHEN 1996 THEN 20 WHEN 1997 THEN 5 END")
def threshold_by_year(spark, d):
    line = t(spark, d, "lineitem")
    return line.where(F.col("l_quantity") < X.threshold_of(F.year("l_shipdate"), {1995: 10.0, 1996: 20.0, 1997: 5.0})).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1997-06-01')")
def date_range_excluded(spark, d):
    inside = F.col("o_orderdate").between(F.lit("1995-06-01").cast("timestamp_ntz"), F.lit("1997-06-01").cast("timestamp_ntz"))
    return t(spark, d, "orders").where(~inside).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' WHEN c_custkey % 3 = 1 THEN 'Unknown' ELSE c_mktsegment END AS status FROM customer")
def blank_to_label(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 1, F.lit("  ")).when(k == 2, F.col("c_mktsegment"))
    return t(spark, d, "customer").select("c_custkey", X.labelled_blank(text, "Unknown").alias("status"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)")
def distinct_row_count(spark, d):
    return R.distinct_rows(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, 'tile_' || (c_custkey // 7) || '_' || (c_custkey % 50) AS name FROM customer) JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 50)::VARCHAR ELSE (s_suppkey % 9) || '_' || (s_suppkey % 50) END AS id FROM supplier) ON ends_with(name, '_' || id)")
def suffix_match_join(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    names = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("tile_"), F.floor(c / 7).cast("string"), F.lit("_"), (c % 50).cast("string")).alias("name"))
    ids = t(spark, d, "supplier").select("s_suppkey", F.when(s % 2 == 0, (s % 50).cast("string")).otherwise(F.concat((s % 9).cast("string"), F.lit("_"), (s % 50).cast("string"))).alias("id"))
    return R.suffix_join(names, ids, "name", "id").select("c_custkey", "s_suppkey")


@query("SELECT l_returnflag, CASE WHEN l_quantity < 25 THEN 'cut' ELSE 'fill' END AS type, count(*) * 9.0::DOUBLE AS area_m2, round(sum(l_quantity * 3 - 75) * 9, 3) AS volume_m3, min(l_quantity * 3) AS elev_post_min, 75.0::DOUBLE AS elev_pre_min, max(l_quantity * 3) AS elev_post_max, 75.0::DOUBLE AS elev_pre_max, min(l_quantity * 3) - 75 AS elev_change_min, max(l_quantity * 3) - 75 AS elev_change_max FROM lineitem WHERE abs(l_quantity * 3 - 75) > 20 GROUP BY 1, 2")
def cut_fill_zones(spark, d):
    pixels = t(spark, d, "lineitem").select("l_returnflag", F.lit(75.0).alias("pre"), (F.col("l_quantity") * 3).alias("post"))
    return P.cut_fill(pixels, ["l_returnflag"], "pre", "post", 9.0).withColumn("volume_m3", F.round("volume_m3", 3))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 4) AS base_elevation, round(quantile_cont(l_extendedprice, 0.9), 4) AS top_elevation, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY 1")
def elevation_quantiles(spark, d):
    found = scale.quantiles(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"base_elevation": 0.1, "top_elevation": 0.9, "median": 0.5})
    return found.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("base_elevation", "top_elevation", "median")])


@query("SELECT o_orderkey, round(o_totalprice / 100 * 1.25, 8) AS min_cost, round(o_totalprice / 100 * 1.875, 8) AS mid_cost, round(o_totalprice / 100 * 2.5, 8) AS max_cost FROM orders")
def regrade_costs(spark, d):
    tiers = X.cost_tiers(F.col("o_totalprice") / 100)
    return t(spark, d, "orders").select("o_orderkey", *[F.round(c, 8).alias(name) for name, c in tiers.items()])


@query("""WITH s AS (SELECT l_linestatus AS g, l_quantity AS s, count(*) FILTER (l_discount > 0.05) AS p, count(*) FILTER (NOT l_discount > 0.05) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER w, 0) + n / 2 AS b, coalesce(sum(p) OVER w, 0) + p / 2 AS a FROM s WINDOW w AS (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT g, sum(p)::DOUBLE AS ps, sum(n)::DOUBLE AS ns, sum(p * b) AS w, sum(p * b * b) AS ww, sum(n * a) AS u, sum(n * a * a) AS uu FROM r GROUP BY g),
e AS (SELECT g, w / (ps * ns) AS auc, 1.959963984540054 * sqrt((ww - w * w / ps) / ((ps - 1) * ns * ns * ps) + (uu - u * u / ns) / ((ns - 1) * ps * ps * ns)) AS error FROM m)
SELECT g AS l_linestatus, round(auc, 6) AS auc, round(greatest(auc - error, 0), 6) AS low, round(least(auc + error, 1), 6) AS high FROM e""")
def roc_auc_interval(spark, d):
    found = T.auc_interval(t(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", F.col("l_discount") > 0.05)
    return found.select("l_linestatus", *[F.round(c, 6).alias(c) for c in ("auc", "low", "high")])


@query(f"""WITH RECURSIVE {LABELS}, sides AS (SELECT label, unnest([x, x + 1, x, x]) AS ax, unnest([y, y, y + 1, y]) AS ay, unnest([x + 1, x + 1, x + 1, x]) AS bx, unnest([y, y + 1, y + 1, y + 1]) AS b_y FROM labelled),
edges AS (SELECT label FROM sides GROUP BY label, ax, ay, bx, b_y HAVING count(*) = 1), outline AS (SELECT label, count(*) AS n FROM edges GROUP BY label)
SELECT cells * 900::DOUBLE AS area, n * 30::DOUBLE AS length FROM (SELECT label, count(*) AS cells FROM labelled GROUP BY label) JOIN outline USING (label)""")
def component_outlines(spark, d):
    """Each component's area and the length of its outline, holes included, from its polygons."""
    found = C.outlines(_labelled(spark, d), 30.0)
    area = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + G.area(p))
    around = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + F.aggregate(p, F.lit(0.0), lambda u, r: u + G.length(r)))
    return found.select(area.alias("area"), around.alias("length"))


@query(f"""WITH {COMBS}, runs AS (SELECT *, k - row_number() OVER (PARTITION BY o ORDER BY k) AS run FROM lines), firsts AS (SELECT r.* FROM runs r JOIN (SELECT o, min(run) AS run FROM runs GROUP BY o) USING (o, run)),
ways AS (SELECT a.o, a.k AS ka, b.k AS kb, a.q + b.q + (b.k - a.k) * 24 AS w FROM firsts a JOIN firsts b ON a.o = b.o AND a.k < b.k UNION ALL SELECT o, k, k, q FROM firsts)
SELECT o, round(max(w), 6) AS length FROM ways GROUP BY o""")
def longest_spine(spark, d):
    """Of each comb's first run of lines, the longest of its ways."""
    return L.longest_spine(_combs(spark, d), "o").select("o", F.round("length", 6).alias("length"))


@query("SELECT c_custkey AS id, NULL::VARCHAR AS note, c_acctbal AS balance, NULL::INTEGER AS year FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def reindexed_union(spark, d):
    """Tables of different columns in the order of one."""
    kinds = {"id": "bigint", "note": "string", "balance": "double", "year": "int"}
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t(spark, d, "supplier").select(F.col("s_name").alias("note"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return reindex(a, kinds, kinds).union(reindex(b, kinds, kinds))


@query("SELECT p_partkey, round(CASE WHEN p_size >= 0 AND p_retailprice >= 0 THEN (p_retailprice - p_size) / (p_retailprice + p_size) END, 9) AS nd, round(2.5 * (p_retailprice - p_size) / (p_retailprice + 6 * p_size - 7.5 + 1), 9) AS evi, round((p_retailprice - p_size) * 1.5 / (p_retailprice + p_size + 0.5), 9) AS savi, round((2 * p_retailprice + 1 - sqrt(power(2 * p_retailprice + 1, 2) - 8 * (p_retailprice - p_size))) / 2, 6) AS msavi FROM part")
def spectral_indices(spark, d):
    nir, red = F.col("p_retailprice"), F.col("p_size")
    return t(spark, d, "part").select("p_partkey", F.round(X.normalized_difference(nir, red), 9).alias("nd"), F.round(X.evi(nir, red, F.lit(1.0)), 9).alias("evi"), F.round(X.savi(nir, red), 9).alias("savi"), F.round(X.msavi(nir, red), 6).alias("msavi"))


@query(f"WITH {ZONES_SQL}, g AS (SELECT unnest(range(50)) AS px), h AS (SELECT unnest(range(50)) AS py) SELECT n_nationkey, px, py FROM zones, g, h WHERE px * 2 + 1 - xmin + py * 2 + 1 - ymin < 15 AND px * 2 + 1 > xmin AND py * 2 + 1 > ymin")
def rasterized_zones(spark, d):
    """Cells of 2 whose centre a triangle holds."""
    _, zones = _polygons(spark, d)
    spark.udtf.register("polygon_cells", G.polygon_cells())
    rings = F.to_json(F.transform("triangle", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    zones.select("n_nationkey", rings.alias("rings")).createOrReplaceTempView("zone_rings")
    return spark.sql("SELECT n_nationkey, px, py FROM zone_rings, LATERAL polygon_cells(rings, 2.0D, false)")
