"""Queries of grouped summaries and cleaning over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geostrata.functions import values as V
from geostrata.operators import relational as R
from geostrata.plans.catalog import query
from geostrata.sources.tables import duplicate_keys as find_duplicate_keys
from geostrata.sources.tables import read_table as t


def _sites(spark, d):
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    return t(spark, d, "customer").join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))


SITES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""
SELECT CASE WHEN grouping(r_name) = 1 THEN 'Total' ELSE r_name END AS r_name, count(*) AS num_permits, count(DISTINCT c_mktsegment) AS num_companies,
 CAST(count(*) FILTER (c_acctbal > 0) AS BIGINT) AS bonded, round(sum(c_acctbal), 4) AS full_bond, round(sum(c_acctbal) FILTER (c_acctbal > 0), 4) AS positive,
 round(avg(c_acctbal), 4) AS mean_bond, min(c_acctbal) AS least, max(c_acctbal) AS most, round(median(c_acctbal), 4) AS middle
FROM {SITES} GROUP BY ROLLUP (r_name)""")
def permit_stats_rollup(spark, d):
    x = F.col("c_acctbal")
    return R.rollup_total(
        _sites(spark, d), "r_name", F.count("*").alias("num_permits"), F.count_distinct("c_mktsegment").alias("num_companies"), F.count_if(x > 0).alias("bonded"),
        F.round(F.sum(x), 4).alias("full_bond"), F.round(R.sum_where(x, x > 0), 4).alias("positive"), F.round(F.avg(x), 4).alias("mean_bond"),
        F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.median(x), 4).alias("middle"),
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean_price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def weighted_mean_by_zone(spark, d):
    zones = t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = t(spark, d, "lineitem").join(zones, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("n_name").agg(F.round(R.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("mean_price"))


@query("""
SELECT p_brand, round(median(p_retailprice), 6) AS middle, round(stddev_samp(p_retailprice), 6) AS spread,
 round(quantile_cont(p_retailprice, 0.1), 6) AS base_elevation, round(quantile_cont(p_retailprice, 0.9), 6) AS top_elevation,
 round(quantile_cont(p_retailprice, 0.9) - quantile_cont(p_retailprice, 0.1), 6) AS height FROM part GROUP BY p_brand""")
def median_spread_by_brand(spark, d):
    x = F.col("p_retailprice")
    low, high = F.percentile(x, F.lit(0.1)), F.percentile(x, F.lit(0.9))
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.round(F.median(x), 6).alias("middle"), F.round(F.stddev_samp(x), 6).alias("spread"), F.round(low, 6).alias("base_elevation"), F.round(high, 6).alias("top_elevation"), F.round(high - low, 6).alias("height")
    )


@query("""
SELECT c_nationkey, o_orderpriority, round(100 * coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) / sum(o_totalprice), 6) AS share
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def conditional_share(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", "o_orderpriority").agg(F.round(R.percent_where(F.col("o_totalprice"), F.col("o_orderstatus") == "F"), 6).alias("share"))


@query("SELECT o_custkey, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def top10_holders(spark, d):
    return R.top_groups(t(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), 10).withColumn("total", F.round("total", 4))


@query("SELECT o_custkey, arg_min(o_orderstatus, row(o_orderdate, o_orderkey)) AS o_orderstatus, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS o_totalprice, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_by_group(spark, d):
    return R.first_by(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N'))")
def all_bonds_one_flag(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return R.groups_where(lines, ["l_orderkey"], every=F.col("l_returnflag") == "N")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'N') AND bool_or(l_returnflag = 'R'))")
def mixed_bonds(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return R.groups_where(lines, ["l_orderkey"], some=[F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"])


@query("SELECT l_suppkey, '[' || string_agg(l_returnflag, ', ' ORDER BY l_returnflag) || ']' AS flags FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY l_suppkey")
def id_list_per_site(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(V.id_list(F.sort_array(F.collect_set("l_returnflag"))).alias("flags"))


@query("SELECT p_partkey, CAST(CASE WHEN p_name = '' THEN 0 ELSE len(string_split(p_name, ' ')) END AS INTEGER) AS n_words FROM part")
def list_length(spark, d):
    return t(spark, d, "part").select("p_partkey", V.list_length(F.col("p_name"), " ").alias("n_words"))


@query("""
SELECT c_custkey, round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0), 4) AS cost,
 coalesce((SELECT '[' || string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) || ']' FROM orders WHERE o_custkey = c_custkey), '') AS ids FROM customer""")
def correlated_rollup(spark, d):
    found = R.rolled_up(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), "c_custkey", "o_custkey", {"cost": "o_totalprice"}, "o_orderkey")
    return found.select("c_custkey", F.round("cost", 4).alias("cost"), V.id_list(F.col("ids")).alias("ids"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_permits(spark, d):
    lines = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join_permits(spark, d):
    lines = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def _deficits(spark, d):
    """Costs by site against its bond; a bond that isn't positive is none."""
    costs = R.rolled_up(t(spark, d, "customer"), t(spark, d, "orders").where("o_orderstatus = 'O'"), "c_custkey", "o_custkey", {"cost": "o_totalprice"})
    bond = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 50).otherwise(0.0)
    return costs.select("c_custkey", "c_nationkey", "c_mktsegment", "cost", bond.alias("full_bond")).withColumn("deficit", F.col("cost") - F.col("full_bond"))


DEFICITS = """WITH costs AS (SELECT o_custkey, sum(o_totalprice) AS cost FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
deficits AS (SELECT c_custkey, c_nationkey, coalesce(cost, 0) AS cost, CASE WHEN c_acctbal > 0 THEN c_acctbal * 50 ELSE 0 END AS full_bond, coalesce(cost, 0) - CASE WHEN c_acctbal > 0 THEN c_acctbal * 50 ELSE 0 END AS deficit
FROM customer LEFT JOIN costs ON c_custkey = o_custkey)"""


@query(DEFICITS + " SELECT c_custkey, round(cost, 4) AS cost, round(full_bond, 4) AS full_bond, round(deficit, 4) AS deficit, CASE WHEN full_bond > 0 THEN round(100 * cost / full_bond, 6) END AS share FROM deficits")
def bond_deficit(spark, d):
    share = F.when(F.col("full_bond") > 0, F.round(100 * F.col("cost") / F.col("full_bond"), 6))
    return _deficits(spark, d).select("c_custkey", F.round("cost", 4).alias("cost"), F.round("full_bond", 4).alias("full_bond"), F.round("deficit", 4).alias("deficit"), share.alias("share"))


@query(DEFICITS + " SELECT n_name, count(*) FILTER (deficit > 0) AS bankrupted, count(*) FILTER (deficit > 0 AND full_bond > 0) AS bonded, count(*) FILTER (deficit > 0 AND full_bond = 0) AS unbonded FROM deficits JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def bankrupt_counts(spark, d):
    zones = F.broadcast(t(spark, d, "nation").select("n_nationkey", "n_name"))
    short = F.col("deficit") > 0
    return _deficits(spark, d).join(zones, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count_if(short).alias("bankrupted"), F.count_if(short & (F.col("full_bond") > 0)).alias("bonded"), F.count_if(short & (F.col("full_bond") == 0)).alias("unbonded")
    )


@query(DEFICITS + " SELECT CASE WHEN grouping(n_name) = 1 THEN 'Total' ELSE n_name END AS n_name, round(avg(deficit) FILTER (deficit > 0), 4) AS mean_deficit FROM deficits JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def underbonded_avg(spark, d):
    zones = F.broadcast(t(spark, d, "nation").select("n_nationkey", "n_name"))
    joined = _deficits(spark, d).join(zones, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.rollup_total(joined, "n_name", F.round(F.avg(F.when(F.col("deficit") > 0, F.col("deficit"))), 4).alias("mean_deficit"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-08-03' AND o_orderdate < TIMESTAMP '1999-01-01' AND month(o_orderdate) BETWEEN 5 AND 9")
def law_era_filter(spark, d):
    when = F.col("o_orderdate")
    return t(spark, d, "orders").where((when >= F.lit("1997-08-03").cast("timestamp_ntz")) & (when < F.lit("1999-01-01").cast("timestamp_ntz")) & F.month(when).between(5, 9)).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[scizhSCIZH]') AND p_brand NOT IN ('Brand#11', 'Brand#12') AND (p_size < 10 OR p_size = 40)")
def regex_filter(spark, d):
    return t(spark, d, "part").where(F.col("p_name").rlike("^[scizhSCIZH]") & ~F.col("p_brand").isin("Brand#11", "Brand#12") & ((F.col("p_size") < 10) | (F.col("p_size") == 40))).select("p_partkey", "p_name")


@query(f"""
WITH stats AS (SELECT CASE WHEN grouping(r_name) = 1 THEN 'Total' ELSE r_name END AS state, count(*)::DOUBLE AS permits, round(sum(c_acctbal), 4) AS bond, round(max(c_acctbal), 4) AS most FROM {SITES} GROUP BY ROLLUP (r_name)),
long AS (UNPIVOT stats ON permits, bond, most INTO NAME statistic VALUE v)
SELECT statistic, max(v) FILTER (state = 'AFRICA') AS "AFRICA", max(v) FILTER (state = 'ASIA') AS "ASIA", max(v) FILTER (state = 'EUROPE') AS "EUROPE", max(v) FILTER (state = 'Total') AS "Total" FROM long GROUP BY statistic""")
def stat_transpose(spark, d):
    stats = R.rollup_total(_sites(spark, d), "r_name", F.count("*").cast("double").alias("permits"), F.round(F.sum("c_acctbal"), 4).alias("bond"), F.round(F.max("c_acctbal"), 4).alias("most"))
    return R.transposed(stats, "r_name", ["permits", "bond", "most"], ["AFRICA", "ASIA", "EUROPE", "Total"])


@query("SELECT 'customer' AS origin, c_custkey AS id, c_nationkey AS zone, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier")
def union_states(spark, d):
    left = t(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("segment"))
    right = t(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"))
    return left.unionByName(right, allowMissingColumns=True)


@query("SELECT p_partkey AS key, 'unsold' AS side FROM part WHERE p_size < 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) UNION ALL SELECT DISTINCT l_partkey, 'unknown' FROM lineitem WHERE l_quantity >= 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def set_difference(spark, d):
    have = t(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("key"))
    sold = t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("key")).distinct()
    return have.join(sold, "key", "left_anti").select("key", F.lit("unsold").alias("side")).union(sold.join(have, "key", "left_anti").select("key", F.lit("unknown").alias("side")))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return find_duplicate_keys(t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT 'st_' || row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS st_id, c_custkey FROM customer")
def surrogate_ids(spark, d):
    return R.numbered(t(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], "st_id", "st_").select("st_id", "c_custkey")


@query("""
SELECT o_orderkey, TRY_CAST(replace(replace(written, ',', ''), '+', '') AS DOUBLE) AS amount
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '+' || format('{:,}', o_orderkey * 1000) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.5' WHEN 2 THEN 'n/a' ELSE '' END AS written FROM orders)""")
def clean_numeric(spark, d):
    k, r = F.col("o_orderkey"), F.col("o_orderkey") % 4
    written = F.when(r == 0, F.concat(F.lit("+"), F.format_number(k * 1000, 0))).when(r == 1, F.concat(k.cast("string"), F.lit(".5"))).when(r == 2, "n/a").otherwise("")
    return t(spark, d, "orders").select("o_orderkey", V.to_number(written).alias("amount"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS issued, CAST(o_orderdate AS DATE) AS from_millis FROM orders""")
def clean_dates(spark, d):
    r, when = F.col("o_orderkey") % 3, F.col("o_orderdate")
    written = F.when(r == 0, F.date_format(when, "MM/dd/yyyy")).when(r == 1, F.date_format(when, "yyyy-MM-dd")).otherwise("13/45/2020")
    millis = F.unix_millis(when.cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", V.to_date(written, "MM/dd/yyyy", "yyyy-MM-dd").alias("issued"), V.date_of_millis(millis).alias("from_millis"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS height, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS filled FROM customer")
def sentinel_null(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, -999.0).otherwise(F.col("c_acctbal"))
    height = V.sentinel_to_null(raw, -999.0)
    return t(spark, d, "customer").select("c_custkey", height.alias("height"), F.coalesce(height, F.lit(0.0)).alias("filled"))


@query("SELECT page_id, CASE WHEN contains(url, 'https') THEN 'final' ELSE 'provisional' END AS data_status, split_part(url, '/', 3) AS host FROM pages")
def substring_status(spark, d):
    return t(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("https")), "final").otherwise("provisional").alias("data_status"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS captured FROM events")
def json_properties(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("captured"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey LIMIT 50")
def deterministic_sample(spark, d):
    return R.sample_by_key(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS log_price, CAST(ceil(p_retailprice / 100) AS BIGINT) AS hundreds, p_size % 7 AS rest, round(p_size * 0.3048::DOUBLE, 6) AS metres, CAST(least(greatest(floor(p_size / 50.0 * 255), 0), 255) AS INTEGER) AS quantized FROM part")
def scalar_functions(spark, d):
    size = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", F.round(F.ln("p_retailprice"), 6).alias("log_price"), F.ceil(F.col("p_retailprice") / 100).alias("hundreds"), (size % 7).alias("rest"), F.round(V.feet_to_metres(size), 6).alias("metres"), V.quantized(size / 50).alias("quantized"))
