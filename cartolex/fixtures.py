"""Places, properties and addresses projected from star-schema tables by integer arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"STANDARD": "mall", "PROMO": "pharmacy", "SMALL": "cafe", "LARGE": "school", "ECONOMY": "bus_station", "MEDIUM": "park"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; one of our own only where all run on this machine, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (set_to or "/tmp/checkpoints").rstrip("/")


def point(key: str, a: int, b: int) -> tuple:
    k = F.col(key).cast("long")
    return 41.95 + ((k * a) % 10000) / F.lit(100000.0), 21.35 + ((k * b) % 15000) / F.lit(100000.0)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poi_id, name, type, p_lat, p_lon, source, place_id, review_count, phone, closed."""
    lat, lon = point("p_partkey", 7919, 104729)
    kind = F.coalesce(*[F.when(F.col("p_type").startswith(k), v) for k, v in KINDS.items()], F.lit("yes"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("poi_id"), F.col("p_name").alias("name"), kind.alias("type"), lat.alias("p_lat"), lon.alias("p_lon"),
        F.when(k % 3 == 0, "google").otherwise("osm").alias("source"), F.when(k % 3 == 0, F.concat(F.lit("0x1:0x"), F.lower(F.hex(k)))).alias("place_id"),
        (F.col("p_size") * 3).cast("int").alias("review_count"), F.concat(F.lit("+389 "), F.col("p_brand")).alias("phone"), F.when(k % 97 == 0, 1).otherwise(0).alias("closed"),
    )


def names_by_remainder(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Names of the places that a key's remainder by ``n`` picks: _k (the remainder), name. The others, which no key can meet, stay out
    of the join: the table's file is so much smaller than its rows that all of them would be broadcast."""
    k = F.col("_k")
    return pois(spark, sf_dir).select((F.col("poi_id") - 1).alias("_k"), "name").where(k % n == k)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = point("c_custkey", 6151, 3571)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("property_id"), lat.alias("lat"), lon.alias("lon"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas or complexes: poi_id, name, p_lat, p_lon."""
    lat, lon = point("s_suppkey", 6151, 3571)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poi_id"), F.col("s_name").alias("name"), lat.alias("p_lat"), lon.alias("p_lon"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addr_id, street, housenumber, lat, lon, source: orders on streets named by their customers' nations."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    lat, lon = point("o_orderkey", 7919, 104729)
    joined = o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("a"))).otherwise((F.col("o_orderkey") % 40).cast("string"))
    return joined.select(F.col("o_orderkey").alias("addr_id"), F.concat(F.lit("ul. "), F.initcap("n_name")).alias("street"), number.alias("housenumber"), lat.alias("lat"), lon.alias("lon"), F.lit("").alias("source"))


# --- the same in SQL

_KIND_SQL = "case " + " ".join(f"when starts_with(p_type, '{k}') then '{v}'" for k, v in KINDS.items()) + " else 'yes' end"
POIS_SQL = f"""(select p_partkey as poi_id, p_name as name, {_KIND_SQL} as type, 41.95::double + ((p_partkey * 7919) % 10000) / 100000.0::double as p_lat,
  21.35::double + ((p_partkey * 104729) % 15000) / 100000.0::double as p_lon, case when p_partkey % 3 = 0 then 'google' else 'osm' end as source,
  case when p_partkey % 3 = 0 then '0x1:0x' || lower(to_hex(p_partkey)) end as place_id, (p_size * 3)::integer as review_count, '+389 ' || p_brand as phone,
  case when p_partkey % 97 = 0 then 1 else 0 end as closed from part)"""
PROPERTIES_SQL = """(select c_custkey as property_id, 41.95::double + ((c_custkey * 6151) % 10000) / 100000.0::double as lat,
  21.35::double + ((c_custkey * 3571) % 15000) / 100000.0::double as lon, c_nationkey as nation, c_name as name, c_mktsegment as segment from customer)"""
SUPPLIERS_SQL = """(select s_suppkey as poi_id, s_name as name, 41.95::double + ((s_suppkey * 6151) % 10000) / 100000.0::double as p_lat,
  21.35::double + ((s_suppkey * 3571) % 15000) / 100000.0::double as p_lon from supplier)"""
ADDRESSES_SQL = """(select o_orderkey as addr_id, 'ul. ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as street,
  case when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then (o_orderkey % 40)::varchar || 'a' else (o_orderkey % 40)::varchar end as housenumber,
  41.95::double + ((o_orderkey * 7919) % 10000) / 100000.0::double as lat, 21.35::double + ((o_orderkey * 104729) % 15000) / 100000.0::double as lon, '' as source
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371000.0::double * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
