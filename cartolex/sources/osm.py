"""Map extracts and overrides to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.functions.script import clean_name
from cartolex.functions.text import street_key

ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
#: Tags that give a place its type, in order; of the map's build and of the monthly pass.
BUILD_TAGS = ["amenity", "shop", "tourism", "leisure", "office", "healthcare", "historic", "man_made", "public_transport", "place"]
MONTHLY_TAGS = ["amenity", "shop", "tourism", "leisure", "office", "craft", "public_transport"]


def _elements(raw: DataFrame) -> DataFrame:
    e = raw.select(F.explode("elements").alias("e"))
    return e.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags").where("lat is not null and lon is not null")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON extracts: type, id, lat, lon, tags. Ways have their centre."""
    return _elements(spark.read.schema(ELEMENTS).option("multiLine", True).json(path))


def pois_of(elements: DataFrame, tags: list[str] = BUILD_TAGS, default: str = "other") -> DataFrame:
    """Named places, one for each name and point to five decimals (the smallest key): osm_key, name, type, lat, lon."""
    named = elements.where(F.col("tags")["name"].isNotNull())
    rows = named.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_key"), clean_name(F.col("tags")["name"]).alias("name"), F.coalesce(*[F.try_element_at("tags", F.lit(t)) for t in tags], F.lit(default)).alias("kind"), "lat", "lon")
    one = rows.groupBy("name", F.round("lat", 5), F.round("lon", 5)).agg(F.min_by(F.struct("osm_key", "kind", "lat", "lon"), "osm_key").alias("r"))
    return one.select("r.osm_key", "name", F.col("r.kind").alias("type"), "r.lat", "r.lon")


def addresses_of(elements: DataFrame) -> DataFrame:
    """street, housenumber, lat, lon, key of elements with a street or a place in their address; distinct."""
    street = F.coalesce(F.try_element_at("tags", F.lit("addr:street")), F.try_element_at("tags", F.lit("addr:place")))
    rows = elements.select(clean_name(street).alias("street"), F.coalesce(F.try_element_at("tags", F.lit("addr:housenumber")), F.lit("")).alias("housenumber"), "lat", "lon").where("street is not null")
    return rows.dropDuplicates(["street", "housenumber"]).withColumn("key", street_key(F.col("street")))


def expand_interpolation(ways: DataFrame) -> DataFrame:
    """Numbers along ways: way_id, num, lat, lon. ``ways``: way_id, first, last, step, points array<struct<lat, lon>>.

    Numbers lie at equal shares of the way's length; ways of one point or with a step below 1 give nothing.
    """
    p = ways.where((F.size("points") >= 2) & (F.col("step") >= 1) & (F.col("last") > F.col("first")))
    legs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.sqrt(F.pow((F.get("points", i + 1)["lat"] - F.get("points", i)["lat"]) * 111000, 2) + F.pow((F.get("points", i + 1)["lon"] - F.get("points", i)["lon"]) * 82000, 2)))
    p = p.withColumn("legs", legs)
    ends = F.aggregate("legs", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    p = p.withColumn("ends", ends).withColumn("num", F.explode(F.sequence("first", "last", "step")))
    p = p.withColumn("at", (F.col("num") - F.col("first")) / (F.col("last") - F.col("first")) * F.element_at("ends", -1))
    leg = F.least(F.size("legs") - 1, F.greatest(F.lit(0), F.size(F.filter("ends", lambda e: e <= F.col("at"))) - 1))
    p = p.withColumn("leg", leg).withColumn("t", F.coalesce(F.try_divide(F.col("at") - F.get("ends", F.col("leg")), F.get("legs", F.col("leg"))), F.lit(0.0)))
    mix = lambda k: F.get("points", F.col("leg"))[k] + F.col("t") * (F.get("points", F.col("leg") + 1)[k] - F.get("points", F.col("leg"))[k])
    return p.select("way_id", "num", mix("lat").alias("lat"), mix("lon").alias("lon"))


def apply_overrides(pois: DataFrame, added: DataFrame, replaced: DataFrame, pins: DataFrame) -> DataFrame:
    """pois (name, type, lat, lon, source) after overrides: rows of replaced names go for one row each; pins move names; a
    place is added unless its name is there. All three: name, type, lat, lon (pins: name, lat, lon)."""
    kept = pois.join(replaced.select("name"), "name", "left_anti")
    out = kept.unionByName(replaced.dropDuplicates(["name"]).withColumn("source", F.lit("override")))
    moved = out.join(pins.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "name", "left")
    out = moved.select("name", "type", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"), "source")
    new = added.dropDuplicates(["name"]).join(out.select("name").distinct(), "name", "left_anti")
    return out.unionByName(new.withColumn("source", F.lit("override")))


def alias_streets(addresses: DataFrame, aliases: DataFrame) -> DataFrame:
    """Address rows of each alias's own street again under the alias. ``aliases``: street, osm_street."""
    pairs = aliases.select(F.col("street").alias("_alias"), street_key(F.col("osm_street")).alias("key"))
    more = addresses.join(pairs, "key").withColumn("street", F.col("_alias")).withColumn("key", street_key(F.col("_alias"))).drop("_alias")
    return addresses.unionByName(more.select(*addresses.columns))


def heal_names(pois: DataFrame) -> DataFrame:
    """Rows whose name changes when it is cleaned: poi_id, name, healed."""
    return pois.select("poi_id", "name", clean_name(F.col("name")).alias("healed")).where("healed <> name")


def manifest_problems(files: DataFrame, stamp: DataFrame) -> DataFrame:
    """added, changed or missing files between two manifests (name, digest)."""
    j = files.select("name", F.col("digest").alias("a")).join(stamp.select("name", F.col("digest").alias("b")), "name", "full_outer")
    problem = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return j.select("name", problem.alias("problem")).where("problem is not null")
