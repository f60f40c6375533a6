"""Dimensions: S8 S9 J1 J5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType

from contrail.functions.numeric import strip_ws

AIRPORT_SCHEMA = StructType([
    StructField("iata", StringType()), StructField("name", StringType()), StructField("city", StringType()),
    StructField("lon", DoubleType()), StructField("lat", DoubleType()), StructField("tier", IntegerType()),
])
AIRLINE_SCHEMA = StructType([StructField("prefix", StringType()), StructField("name", StringType()),
                             StructField("iata", StringType())])
AIRCRAFT_DIM_SCHEMA = StructType([
    StructField("icao24", StringType()), StructField("registration", StringType()), StructField("model", StringType()),
    StructField("airline", StringType()), StructField("updated_at", TimestampNTZType()),
])
FLIGHT_EVENT_SCHEMA = StructType([
    StructField("icao24", StringType()), StructField("event_type", StringType()),
    StructField("event_time", TimestampNTZType()), StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
])


def read_dimension(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """A user-supplied dimension file with a declared schema."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.format(fmt).load(path)


def airline_lookup(df: DataFrame, airlines: DataFrame, callsign: str = "callsign") -> DataFrame:
    """``upper(strip(callsign))``; the 3-letter prefix, else the 2-letter
    prefix, else no airline. Keys of two or three letters or digits, one row
    each (the least of repeated ones): at most 36**3 + 36**2 rows, a bound that
    holds for any table, so it is broadcast and rows are not shuffled by airline.
    Keys are stripped and raised to upper case; any other key is an error."""
    key = F.upper(strip_ws(F.col("prefix")))
    known = F.when(key.rlike("^[A-Z0-9]{2,3}$"), key).otherwise(F.raise_error(F.concat(F.lit("airline key is not two or three letters or digits: "), key)))
    a = airlines.filter("prefix IS NOT NULL").withColumn("prefix", known).groupBy("prefix").agg(F.min(F.struct("name", "iata")).alias("a"))
    a = F.broadcast(a.select("prefix", "a.name", "a.iata"))
    clean = F.upper(strip_ws(F.col(callsign)))
    base = df.withColumn("_p3", F.substring(clean, 1, 3)).withColumn("_p2", F.substring(clean, 1, 2))
    a3 = a.select(F.col("prefix").alias("_k3"), F.col("name").alias("_n3"), F.col("iata").alias("_i3"))
    a2 = a.select(F.col("prefix").alias("_k2"), F.col("name").alias("_n2"), F.col("iata").alias("_i2"))
    j = base.join(a3, F.col("_p3") == F.col("_k3"), "left").join(a2, F.col("_p2") == F.col("_k2"), "left")
    hit3 = F.col("_k3").isNotNull()
    return j.select(
        *[F.col(c) for c in df.columns],
        F.when(hit3, F.col("_n3")).otherwise(F.col("_n2")).alias("airline_name"),
        F.when(hit3, F.col("_i3")).otherwise(F.col("_i2")).alias("airline_iata"),
    )


def enrich_aircraft(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join with the aircraft dimension on ``icao24``. The dimension
    grows with the fleet, so the strategy is left to Spark, which broadcasts
    it only below its byte threshold (at run time under AQE)."""
    return df.join(dim, "icao24", "left")
