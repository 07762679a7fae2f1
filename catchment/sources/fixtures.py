"""Spatial layers derived from the driver's TPC-H-style tables.

The driver tables carry no coordinates, so every layer gets deterministic
coordinates inside the analysis bbox from integer arithmetic on its key (the
same arithmetic the DuckDB oracle uses). Text coordinates and WKT vertices are
assembled from integers so both engines print identical strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Salts and the analysis bbox of the reference data.
STORE_SALT = 11
POI_SALT = 500009
ADDRESS_SALT = 1000003
TRACE_SALT = 2000003
BUILDING_SALT = 3000017
BBOX = {"lng_min": 18.54, "lat_min": 49.96, "lng_max": 20.12, "lat_max": 50.48}

# Building categories of the national building register (the first
# four are the residential ones) and the retail category.
RESIDENTIAL_CATEGORIES = [
    "budynkiMieszkalneJednorodzinne",
    "budynkiODwochMieszkaniach",
    "budynkiOTrzechIWiecejMieszkaniach",
    "budynkiZbiorowegoZamieszkania",
]
RETAIL_CATEGORY = "budynkiHandlowoUslugowe"
BUILDING_CATEGORIES = RESIDENTIAL_CATEGORIES + [RETAIL_CATEGORY]

# District hexagon vertex offsets in 1e-4 degrees (lng, lat).
DISTRICT_OFFSETS = [(-1580, -300), (-500, -520), (1200, -480), (1580, 200), (400, 520), (-1300, 450)]

# A concave analysis area inside the bbox (constant WKT).
AREA_WKT = (
    "POLYGON ((18.6000 50.0000, 19.3000 50.0500, 20.0500 50.0000, 20.0800 50.2500, "
    "19.7000 50.2000, 19.4000 50.4500, 19.0000 50.4400, 18.6500 50.3000, 18.6000 50.0000))"
)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat_units(z: Column) -> Column:
    """Latitude in 1e-4 degrees: 499600 + ((z*z*31 + z*7919 + 101) % 5200)."""
    return F.lit(499600) + (z * z * 31 + z * 7919 + 101) % 5200


def _lng_units(z: Column) -> Column:
    return F.lit(185400) + (z * z * 17 + z * 104729 + 37) % 15800


def coords(key: Column, salt: int) -> dict[str, Column]:
    z = key.cast("bigint") + F.lit(salt)
    return {
        "lat": F.lit(49.96) + ((z * z * 31 + z * 7919 + 101) % 5200) / F.lit(10000.0),
        "lng": F.lit(18.54) + ((z * z * 17 + z * 104729 + 37) % 15800) / F.lit(10000.0),
    }


def fixed_text(units: Column, decimals: int) -> Column:
    """Non-negative integer in 10^-decimals units -> exact decimal text."""
    scale = 10**decimals
    return F.concat(
        F.floor(units / F.lit(scale)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((units % F.lit(scale)).cast("string"), decimals, "0"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return s.select(
        F.col("s_suppkey").alias("location_id"),
        *[c.alias(n) for n, c in coords(F.col("s_suppkey"), STORE_SALT).items()],
        (F.lit(100000.0) + F.lit(30.0) * F.col("s_acctbal")).alias("monthly_revenue"),
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return p.select(
        F.col("p_partkey").alias("poi_id"),
        F.lower("p_type").alias("category"),
        F.col("p_name").alias("name"),
        *[c.alias(n) for n, c in coords(F.col("p_partkey"), POI_SALT).items()],
    )


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return p.where(F.col("p_size") % 5 == 0).select(
        F.col("p_partkey").alias("comp_id"),
        F.col("p_brand").alias("brand"),
        *[c.alias(n) for n, c in coords(F.col("p_partkey"), POI_SALT).items()],
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    households = (F.lit(1) + k % 7).cast("int")
    total = (F.lit(1) + k % 40).cast("int")
    return c.select(
        k.alias("id"),
        F.col("c_mktsegment").alias("city"),
        F.when(k % 11 != 0, F.concat(F.lit("St "), (k % 97).cast("string"))).alias("street"),
        (k % 200 + 1).cast("string").alias("house_number"),
        households.alias("households"),
        F.bround(total / households, 1).alias("household_size"),
        total.alias("total"),
        (total / 2).cast("int").alias("male"),
        (total - (total / 2).cast("int")).alias("female"),
        *[cc.alias(n) for n, cc in coords(k, ADDRESS_SALT).items()],
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile traces as the warehouse stores them: coordinates and time as text."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    k = F.col("event_id")
    z = k + F.lit(TRACE_SALT)
    bad = k % 997 == 0
    return e.select(
        k.alias("trace_id"),
        F.when(bad, F.lit("bad")).otherwise(fixed_text(_lat_units(z), 4)).alias("latitude"),
        F.when(bad, F.lit("bad")).otherwise(fixed_text(_lng_units(z), 4)).alias("longitude"),
        F.when(bad, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("occured_at"),
        F.col("user_id").alias("proxi_user_id"),
        F.col("event_type").alias("app_id"),
        F.lit(None).cast("string").alias("geohash"),
        F.lit(None).cast("string").alias("pairing_id"),
        F.lit(None).cast("string").alias("mac_address"),
        F.when(k % 3 == 0, -(F.lit(40) + k % 60)).cast("int").alias("rssi"),
    )


def _square_wkt(lng7: Column, lat7: Column, h: Column) -> Column:
    def v(dx, dy):
        return F.concat(fixed_text(lng7 + dx * h, 7), F.lit(" "), fixed_text(lat7 + dy * h, 7))

    return F.concat(
        F.lit("POLYGON (("),
        F.concat_ws(", ", v(-1, -1), v(1, -1), v(1, 1), v(-1, 1), v(-1, -1)),
        F.lit("))"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    z = k + F.lit(BUILDING_SALT)
    side = F.lit(5) + k % 20
    h7 = F.floor(side * F.lit(10000000) / F.lit(111320)).cast("bigint")
    cats = F.array(*[F.lit(c) for c in BUILDING_CATEGORIES])
    cat = F.element_at(cats, (k % 5 + 1).cast("int"))
    return o.select(
        k.alias("lokalnyid"),
        cat.alias("funogolnabudynku_desc"),
        F.concat(F.lit('["'), cat, F.lit('"]')).alias("funszczegolowabudynku_desc"),
        (F.lit(4.0) * side * side).alias("area"),
        _square_wkt(_lng_units(z) * 1000, _lat_units(z) * 1000, h7).alias("geometry"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    clng = F.lit(185400) + (F.lit(2) * (k % 5) + 1) * 1580
    clat = F.lit(499600) + (F.lit(2) * F.floor(k / 5).cast("int") + 1) * 520
    verts = [
        F.concat(fixed_text(clng + dx, 4), F.lit(" "), fixed_text(clat + dy, 4))
        for dx, dy in DISTRICT_OFFSETS + DISTRICT_OFFSETS[:1]
    ]
    return n.select(
        k.alias("district_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *verts), F.lit("))")).alias("geometry"),
    )


def area(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame([("Analysis area", AREA_WKT)], "area_name string, geometry string")
