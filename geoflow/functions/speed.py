"""Road types, speeds and travel times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road type of a highway tag; tags that are no roads.
HIGHWAY_TYPE = {
    "motorway": 1, "motorway_link": 1, "trunk": 1, "trunk_link": 1, "primary": 2, "primary_link": 2, "bus_guideway": 2, "secondary": 3, "secondary_link": 3, "tertiary": 4,
    "tertiary_link": 4, "residential": 5, "living_street": 5, "unclassified": 6, "service": 6, "road": 6, "cart_track": 7, "track": 7,
}
NO_ROAD = ("stopline", "footway", "bridleway", "step", "steps", "path", "pedestrian", "escape", "cycleway", "raceway", "bus", "services", "escalator", "sidewalk")
# Miles per hour by road type, with one or two lanes and with three to twelve.
SPEED_MPH = {1: (55, 65), 2: (45, 55), 3: (35, 45), 4: (30, 35), 5: (25, 30), 6: (20, 20), 7: (20, 20)}
UNPAVED, MPS_PER_MPH, DEFAULT_MPS = 0.75, 0.44704, 13.41
# Speed of each band of a binned speed raster.
BAND_SPEED = (7.5, 17.5, 25.0, 35.0, 45.0, 55.0, 65.0)


def speed_table(spark: SparkSession) -> DataFrame:
    """(road_type, lanes, base_mph): 7 types by 12 lane counts."""
    return spark.createDataFrame([(kind, lanes, float(few if lanes <= 2 else many)) for kind, (few, many) in SPEED_MPH.items() for lanes in range(1, 13)], "road_type int, lanes int, base_mph double")


def road_type(highway: Column, strict: bool = False) -> Column:
    """1 to 7; NULL for tags that are no roads, and for unknown ones, which stop the job if `strict`."""
    kinds = F.create_map(*(F.lit(x) for pair in HIGHWAY_TYPE.items() for x in pair))
    known = F.element_at(kinds, F.lower(highway))
    if strict:
        known = F.when(highway.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown highway tag: "), highway)).cast("int"))
    return F.when(highway.isin(*NO_ROAD), None).otherwise(known)


def add_road_speed(roads: DataFrame, kind: str = "road_type", lanes: str = "lanes", paved: str = "paved") -> DataFrame:
    """`roads` with inferred_speed_mph and inferred_speed_mps.

    `paved` is 1 or NULL for paved, 2 for unpaved. A type or lane count outside the table gives -1, as for no road.
    The table has 84 rows, so it is broadcast.
    """
    table = speed_table(roads.sparkSession).select(F.col("road_type").alias("_kind"), F.col("lanes").alias("_lanes"), "base_mph")
    joined = roads.join(F.broadcast(table), (F.col(kind) == F.col("_kind")) & (F.col(lanes) == F.col("_lanes")), "left")
    mph = F.coalesce(F.col("base_mph") * F.when(F.col(paved) == 2, UNPAVED).otherwise(1.0), F.lit(-1.0))
    return joined.withColumn("inferred_speed_mph", mph).withColumn("inferred_speed_mps", F.when(mph < 0, -1.0).otherwise(mph * MPS_PER_MPH)).drop("_kind", "_lanes", "base_mph")


def osm_road(highway: Column, kind: Column, type_: Column, tunnel: Column) -> Column:
    """Road type of an OSM feature: its highway tag, else its type where the class is 'highway'; NULL in tunnels."""
    tag = F.coalesce(highway, F.when(kind == "highway", type_))
    return F.when(F.coalesce(tunnel, F.lit("")) == "yes", None).otherwise(road_type(tag))


def travel_time(length: Column, speed: Column, default: float = DEFAULT_MPS) -> Column:
    """Seconds for `length` metres; a missing speed is the default."""
    return length / F.coalesce(speed, F.lit(default))


def speed_bin(mph: Column, width: int = 10) -> Column:
    return F.ceil(mph / width).cast("int")


def speed_burn(mph: Column, least: int = 15, most: int = 65, low: int = 127, high: int = 255) -> Column:
    """Linear ramp of speeds to raster values, never below `low`."""
    return F.greatest(F.lit(low), (F.lit(low) + (mph - least) * ((high - low) / (most - least))).cast("int"))


def speed_key(spark: SparkSession, step: int = 10, mult: int = 36) -> DataFrame:
    """(speed, burn_val, channel) for 1 to 65 mph in bins of `step`."""
    burn = F.ceil(F.col("speed") / step).cast("int") * mult
    return spark.range(1, 66).select(F.col("id").cast("int").alias("speed"), burn.alias("burn_val"), (burn / mult - 1).cast("int").alias("channel"))


def nearest_key(value: Column, keys: Column) -> Column:
    """The key nearest to `value`, the first of equals."""
    return F.array_min(F.transform(keys, lambda k, i: F.struct(F.abs(k - value).alias("d"), i.alias("i"), k.alias("k"))))["k"]


# Class of each speed value of a training mask.
SPEED_CLASS = {15: 1, 19: 1, 20: 1, 22: 2, 25: 2, 26: 3, 30: 3, 34: 4, 35: 4, 41: 5, 45: 5, 49: 6, 55: 7, 65: 8}


def speed_class(value: Column) -> Column:
    """Class 1 to 8 of a speed value; 0 and NULL stay, any other value is an error."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in SPEED_CLASS.items() for x in pair)), value.cast("int"))
    unknown = F.raise_error(F.concat(F.lit("no class for speed "), value.cast("string"))).cast("int")
    return F.when(value.isNull() | (value == 0), value.cast("int")).otherwise(F.coalesce(known, unknown))


def burn_speeds(keys: DataFrame, order: str) -> DataFrame:
    """(burn_val, speed) of a key table: of equal burn values the last by `order`."""
    return keys.groupBy("burn_val").agg(F.max_by("speed", order).alias("speed"))


def parsed_roads(roads: DataFrame) -> DataFrame:
    """`roads` with whole-number road_type, lanes, paved and bridge from the properties of older road files.

    lane_numbe goes before lane_number and bridge_typ before bridge_type. A road that lacks any of the four is taken
    for an unclassified paved road of one lane without a bridge.
    """
    either = lambda *names: F.coalesce(*(F.col(c) for c in names if c in roads.columns), F.lit(None)).cast("int")
    found = {"road_type": either("road_type"), "lanes": either("lane_numbe", "lane_number"), "paved": either("paved"), "bridge": either("bridge_typ", "bridge_type")}
    whole = F.lit(True)
    for c in found.values():
        whole = whole & c.isNotNull()
    instead = {"road_type": 6, "lanes": 1, "paved": 1, "bridge": 2}
    return roads.withColumns({name: F.when(whole, c).otherwise(instead[name]) for name, c in found.items()})
