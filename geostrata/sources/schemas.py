"""Schemas of the engine's own tables: columns in order, keys, and empty tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geostrata.sources.tables import reindex

# Names, order and types that readers of these tables expect; geom holds polygons as GeoJSON text.
ANNUAL_MINING = "id string, mining_year int, area double, data_status string, geom string"
HIGHWALL_DETECTIONS = (
    "highwall_id int, rec_status string, rec_status_yr int, earliest_vis_yr int, first_mined_yr int, last_mined_yr int, max_age int, min_age int, mid_age double, "
    "age_uncertainty double, lidar_project string, lidar_yr int, mean_slope double, med_slope double, max_slope double, all_permit_ids string, segment_id int, "
    "raw_length double, length double, base_elevation double, top_elevation double, height double, min_cost double, mid_cost double, max_cost double, permit_id string, "
    "state string, permittee string, mine_name string, mine_status string, bond_status string, avail_bond double, full_bond double, geom string"
)
CUTS_FILLS = (
    "st_id int, type string, area_m2 double, volume_m3 double, elev_post_min double, elev_pre_min double, elev_change_min double, elev_post_max double, elev_pre_max double, "
    "elev_change_max double, elev_post_med double, elev_pre_med double, elev_change_med double, slope_post_med double, slope_pre_med double, slope_change_med double, geom string"
)
SCHEMAS = {"annual_mining": ANNUAL_MINING, "highwall_detections": HIGHWALL_DETECTIONS, "cuts_fills": CUTS_FILLS}
KEYS = {"annual_mining": ["id", "mining_year"], "highwall_detections": ["highwall_id"], "cuts_fills": ["st_id"]}


def create_table(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """The table of this name, made empty first where there is none; the schema is that of SCHEMAS unless given."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema or SCHEMAS[name]}) USING parquet")
    return spark.table(name)


def create_view(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """A view of df, or of some of its columns, in place of an earlier one of this name."""
    (df.select(*columns) if columns else df).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def conforming(df: DataFrame, name: str) -> DataFrame:
    """df's columns in a table's order and types, those it lacks null; others are an error."""
    wanted = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    strange = sorted(set(df.columns) - set(wanted.names))
    if strange:
        raise ValueError(f"{name} has no columns {strange}")
    return reindex(df, wanted.names, {f.name: f.dataType.simpleString() for f in wanted})
