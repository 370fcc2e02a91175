"""Queries of pixel time series, thresholds and validation. events are pixels: user_id by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata.functions.values import five_year_bucket as bucket
from geostrata.operators import pixels as P
from geostrata.operators import thresholds as H
from geostrata.plans.catalog import query
from geostrata.sources.tables import read_table as t

DAYS = 30
#: Pixels are dealt to this many zones.
ZONES = 25


def _pixels(spark, d):
    return t(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_id", "event_type", "value", (F.col("user_id") % ZONES).alias("zone"))


PIXELS = f"pixels AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, event_id, event_type, value, user_id % {ZONES} AS zone FROM events)"
COMPOSITE = PIXELS + ", composite AS (SELECT user_id, day, zone, arg_max(value, row(value, event_id)) AS value, arg_max(event_type, row(value, event_id)) AS event_type, arg_max(event_id, row(value, event_id)) AS event_id FROM pixels WHERE value IS NOT NULL GROUP BY ALL)"


def _composite(spark, d):
    return P.quality_mosaic(_pixels(spark, d), ["user_id", "day", "zone"], "value", ["event_id"], ["value", "event_type", "event_id"])


@query(f"WITH {COMPOSITE} SELECT * FROM composite")
def greenest_composite(spark, d):
    return _composite(spark, d)


@query(f"""WITH {PIXELS} SELECT user_id, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS middle,
 round(quantile_cont(value, 0.15), 6) AS low, count(value) AS count, bool_or(value <> 0) AS any_nonzero FROM pixels GROUP BY user_id""")
def period_reducers(spark, d):
    found = {k: F.round(c, 6) if k in ("mean", "middle", "low") else c for k, c in P.period_reducers(F.col("value")).items()}
    return _pixels(spark, d).groupBy("user_id").agg(*[c.alias(k) for k, c in found.items()])


@query(f"WITH {PIXELS} SELECT zone, day, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(*) AS n FROM pixels GROUP BY zone, day")
def zonal_mean(spark, d):
    df = _pixels(spark, d)
    zones = df.select("user_id", "zone").distinct()
    return P.zonal(df.drop("zone"), zones, ["user_id"], ["zone", "day"], F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query(f"WITH {COMPOSITE} SELECT zone, day, round(count(*) FILTER (value > 60) * 900 / 1e6::DOUBLE, 6) AS km2 FROM composite GROUP BY zone, day")
def zonal_area(spark, d):
    return _composite(spark, d).groupBy("zone", "day").agg(F.round(F.count_if(F.col("value") > 60) * 900 / 1e6, 6).alias("km2"))


THRESHOLDS = COMPOSITE + """, bounds AS (SELECT zone, day, quantile_cont(value, 0.0) AS low, quantile_cont(value, 0.5) AS high FROM composite GROUP BY zone, day),
thresholds AS (SELECT zone, day, avg(value) AS threshold FROM composite JOIN bounds USING (zone, day) WHERE value BETWEEN low AND high GROUP BY zone, day)"""


@query(f"""WITH {PIXELS}, bounds AS (SELECT zone, quantile_cont(value, 0.0) AS low, quantile_cont(value, 0.03) AS high FROM pixels GROUP BY zone)
SELECT zone, round(avg(value), 6) AS threshold FROM pixels JOIN bounds USING (zone) WHERE value BETWEEN low AND high GROUP BY zone""")
def interval_mean_threshold(spark, d):
    return P.interval_mean(_pixels(spark, d), ["zone"], "value", 0.0, 0.03).withColumn("threshold", F.round("threshold", 6))


RAW = THRESHOLDS + ", raw AS (SELECT c.user_id, c.day, c.zone, CAST(value <= threshold AS INTEGER) AS raw FROM composite c JOIN thresholds USING (zone, day))"


def _raw(spark, d):
    composite = _composite(spark, d)
    thresholds = P.interval_mean(composite, ["zone", "day"], "value", 0.0, 0.5)
    return composite.join(thresholds, ["zone", "day"]).select("user_id", "day", "zone", (F.col("value") <= F.col("threshold")).cast("int").alias("raw"))


@query(f"WITH {RAW} SELECT user_id, day, raw FROM raw")
def raw_class(spark, d):
    return _raw(spark, d).select("user_id", "day", "raw")


CLEAN = RAW + f""", dense AS (SELECT user_id, day, raw, coalesce(raw, 0) AS known FROM (SELECT DISTINCT user_id FROM raw) CROSS JOIN (SELECT CAST(unnest(range(1, {DAYS + 1})) AS INTEGER) AS day) LEFT JOIN raw USING (user_id, day)),
s1 AS (SELECT *, CASE WHEN raw IS NULL AND lag(known, 1, 0) OVER w = 1 AND lead(known, 1, 0) OVER w = 1 THEN 1 ELSE known END AS filled FROM dense WINDOW w AS (PARTITION BY user_id ORDER BY day)),
s2 AS (SELECT *, CASE WHEN filled = 1 AND lag(filled, 1, 1) OVER w = 0 AND lead(filled, 1, 1) OVER w = 0 THEN 0 ELSE filled END AS despiked FROM s1 WINDOW w AS (PARTITION BY user_id ORDER BY day)),
clean AS (SELECT *, CASE WHEN despiked = 0 AND lag(despiked, 1, 0) OVER w = 1 AND lead(despiked, 1, 0) OVER w = 1 THEN 1 ELSE despiked END AS cleaned FROM s2 WINDOW w AS (PARTITION BY user_id ORDER BY day))"""


def _clean(spark, d):
    days = spark.range(1, DAYS + 1).select(F.col("id").cast("int").alias("day"))
    return P.temporal_clean(P.dense_series(_raw(spark, d), ["user_id"], days, "day", "raw"), ["user_id"], "day", "raw")


@query(f"WITH {CLEAN} SELECT user_id, day, CAST(filled AS INTEGER) AS filled FROM clean")
def null_fill(spark, d):
    return _clean(spark, d).select("user_id", "day", "filled")


@query(f"WITH {CLEAN} SELECT user_id, day, CAST(despiked AS INTEGER) AS despiked FROM clean")
def despike(spark, d):
    return _clean(spark, d).select("user_id", "day", "despiked")


@query(f"WITH {CLEAN} SELECT user_id, day, CAST(cleaned AS INTEGER) AS cleaned FROM clean WHERE cleaned <> despiked")
def gap_fill(spark, d):
    return _clean(spark, d).where("cleaned <> despiked").select("user_id", "day", "cleaned")


@query(f"WITH {CLEAN} SELECT user_id, day, raw, CAST(cleaned AS INTEGER) AS cleaned FROM clean")
def temporal_clean(spark, d):
    return _clean(spark, d).select("user_id", "day", "raw", "cleaned")


@query(f"WITH {CLEAN} SELECT user_id, day, max(CASE WHEN cleaned = 1 THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS last_day FROM clean")
def running_last_mined(spark, d):
    return P.running_last(_clean(spark, d), ["user_id"], "day", "cleaned", "last_day").select("user_id", "day", "last_day")


@query(f"WITH {CLEAN} SELECT user_id, min(day) AS first_day, max(day) AS last_day, max(day) FILTER (day < 25) AS last_final FROM clean WHERE cleaned = 1 GROUP BY user_id")
def cumulative_extent(spark, d):
    mined = _clean(spark, d).where("cleaned = 1")
    return mined.groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max(F.when(F.col("day") < 25, F.col("day"))).alias("last_final"))


@query("SELECT o_orderkey, CAST(CASE WHEN y IN (1984, 2015) THEN y WHEN y BETWEEN 1985 AND 2014 THEN y - y % 5 END AS INTEGER) AS bucket FROM (SELECT o_orderkey, year(o_orderdate) + CAST(o_orderkey % 25 - 12 AS INTEGER) AS y FROM orders)")
def five_year_bucket(spark, d):
    year = F.year("o_orderdate") + (F.col("o_orderkey") % 25 - 12).cast("int")
    return t(spark, d, "orders").select("o_orderkey", bucket(year).alias("bucket"))


@query(f"WITH {CLEAN}, halves AS (SELECT user_id, max(cleaned) FILTER (day <= 15) AS early, max(cleaned) FILTER (day > 15) AS late FROM clean GROUP BY user_id) SELECT user_id, CAST(early - late AS INTEGER) AS reclaimed FROM halves")
def reclaimed(spark, d):
    halves = _clean(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("day") <= 15, F.col("cleaned"))).alias("early"), F.max(F.when(F.col("day") > 15, F.col("cleaned"))).alias("late"))
    return halves.select("user_id", (F.col("early") - F.col("late")).alias("reclaimed"))


@query("""
WITH top AS (SELECT max(value) AS m FROM events), hist AS (SELECT event_type, CAST(least(greatest(floor(value / m * 256), 0), 255) AS INTEGER) AS bin, count(*) AS n FROM events, top WHERE value IS NOT NULL GROUP BY ALL),
dense AS (SELECT event_type, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM hist) CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) LEFT JOIN hist USING (event_type, bin)),
sums AS (SELECT event_type, bin, sum(n) OVER w AS nb, sum(n) OVER a AS na, sum(n * bin) OVER w AS sb, sum(n * bin) OVER a AS sa FROM dense
 WINDOW w AS (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type)),
scored AS (SELECT event_type, bin, round(CASE WHEN nb = 0 OR na = nb THEN 0 ELSE nb::DOUBLE * (na - nb) * power(sb::DOUBLE / nb - (sa - sb)::DOUBLE / (na - nb), 2) END, 3) AS v FROM sums)
SELECT event_type, round((min(bin) + max(bin)) / 2.0::DOUBLE / 255, 6) AS threshold FROM (SELECT *, max(v) OVER (PARTITION BY event_type) AS best FROM scored) WHERE v = best GROUP BY event_type""")
def otsu_threshold(spark, d):
    events = t(spark, d, "events")
    joined = events.crossJoin(F.broadcast(events.agg(F.max("value").alias("m"))))  # one row
    return H.otsu(joined, ["event_type"], F.col("value") / F.col("m")).withColumn("threshold", F.round("threshold", 6))


def _points(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return t(spark, d, "labels").join(docs, "doc_id").select("lang", F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("actual"))


POINTS = "points AS (SELECT lang, n_chars AS score, quality = 1 AS actual FROM labels JOIN documents USING (doc_id))"
CURVE = POINTS + """, counts AS (SELECT score, count(*) FILTER (actual) AS p, count(*) FILTER (NOT actual) AS n FROM points GROUP BY score),
curve AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM counts) AS se, 1 - sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM counts) AS sp FROM counts)"""


@query(f"WITH {CURVE} SELECT score, round(se, 6) AS sensitivity, round(sp, 6) AS specificity FROM curve ORDER BY round(se + sp, 9) DESC, score LIMIT 1")
def roc_youden(spark, d):
    found = H.youden(_points(spark, d), [], "score", F.col("actual"))
    return found.select("score", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query(f"WITH {POINTS} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM points a JOIN points b ON a.actual AND NOT b.actual")
def roc_auc(spark, d):
    return H.auc(_points(spark, d), [], "score", F.col("actual")).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {POINTS}, m AS (SELECT lang, count(*) FILTER (actual AND score > 1000) AS tp, count(*) FILTER (NOT actual AND score > 1000) AS fp,
 count(*) FILTER (actual AND score <= 1000) AS fn, count(*) FILTER (NOT actual AND score <= 1000) AS tn FROM points GROUP BY lang),
r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / power(tp + fp + fn + tn, 2) AS pe FROM m)
SELECT lang, tp, fp, fn, tn, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round(tp / nullif(tp + fn, 0), 6) AS producers, round(tp / nullif(tp + fp, 0), 6) AS users FROM r""")
def confusion_kappa(spark, d):
    found = H.confusion(_points(spark, d), ["lang"], F.col("actual"), F.col("score") > 1000)
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "kappa", "producers", "users")})


@query("SELECT l_returnflag, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope1, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def loglog_fit(spark, d):
    found = H.regression(t(spark, d, "lineitem"), ["l_returnflag"], F.ln("l_extendedprice"), F.ln("l_quantity"))
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("intercept", "slope1", "r2")])


@query("""WITH x AS (SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS a, ln(1 + l_partkey) AS b FROM lineitem),
c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy FROM x),
s AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS s1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS s2 FROM c)
SELECT round(my - s1 * ma - s2 * mb, 5) AS intercept, round(s1, 5) AS slope1, round(s2, 5) AS slope2, round((s1 * ya + s2 * yb) / yy, 5) AS r2 FROM s""")
def loglog_fit2(spark, d):
    found = H.regression(t(spark, d, "lineitem"), [], F.ln("l_extendedprice"), F.ln("l_quantity"), F.ln(1 + F.col("l_partkey")))
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@query(f"""WITH {COMPOSITE}, set_cells AS (SELECT user_id AS x, day AS y FROM composite WHERE value > 40),
near AS (SELECT x + dx AS x, CAST(y + dy AS INTEGER) AS y FROM set_cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))
SELECT x, y, 'dilated' AS what FROM near GROUP BY x, y UNION ALL SELECT x, y, 'eroded' FROM near GROUP BY x, y HAVING count(*) = 9""")
def erode_dilate(spark, d):
    cells = _composite(spark, d).where("value > 40").select(F.col("user_id").alias("x"), F.col("day").alias("y"))
    return P.dilate(cells, "x", "y", []).select("x", "y", F.lit("dilated").alias("what")).union(P.erode(cells, "x", "y", []).select("x", "y", F.lit("eroded").alias("what")))


@query(f"WITH {CLEAN} SELECT user_id % {ZONES} AS zone, day, count(*) FILTER (cleaned = 1) AS cells, round(count(*) FILTER (cleaned = 1) * 900 / 1e6::DOUBLE, 6) AS km2 FROM clean GROUP BY ALL")
def extent_pipeline(spark, d):
    """Composite, threshold, classification, cleaning and zonal area in one plan."""
    mined = F.count_if(F.col("cleaned") == 1)
    cells = _clean(spark, d).withColumn("zone", F.col("user_id") % ZONES)
    return cells.groupBy("zone", "day").agg(mined.alias("cells"), F.round(mined * 900 / 1e6, 6).alias("km2"))
