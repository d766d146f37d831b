"""What trusted answers teach the address table, and points for properties that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.geo import inside
from cartolex.functions.text import house_number, street_key


def learn(addresses: DataFrame, answers: DataFrame) -> DataFrame:
    """The address table after trusted answers: street, housenumber, lat, lon, key, source, learned.

    ``addresses``: street, housenumber, lat, lon, key, source. ``answers``: id, address, lat, lon, exact. An exact answer adds its
    building unless the street has that number; another one becomes the street's anchor (source google_street, no number) in
    place of rows without a number. Answers outside the city box, without a street of 3 characters, or exact ones without a
    number teach nothing. Of several answers for one row the smallest id counts.
    """
    a = answers.where(inside(L.CITY_BOX, F.col("lat"), F.col("lon"))).select("id", "address", "lat", "lon", "exact", street_key(F.col("address")).alias("key"), house_number(F.col("address")).alias("num")).where(F.length("key") >= 3)
    one = lambda df, *by: df.groupBy(*by).agg(F.min_by(F.struct("address", "lat", "lon"), "id").alias("b"))
    houses = one(a.where("exact and num <> ''"), "key", "num").select(F.col("b.address").alias("street"), F.col("num").alias("housenumber"), "b.lat", "b.lon", "key", F.lit("").alias("source"))
    houses = houses.join(addresses.select("key", "housenumber").distinct(), ["key", "housenumber"], "left_anti")
    anchors = one(a.where("not exact"), "key").select(F.col("b.address").alias("street"), F.lit("").alias("housenumber"), "b.lat", "b.lon", "key", F.lit("google_street").alias("source"))
    bare = F.col("housenumber").isin("", "ББ")
    kept = addresses.where(~bare).unionByName(addresses.where(bare).join(anchors.select("key"), "key", "left_anti"))
    names = ["street", "housenumber", "lat", "lon", "key", "source"]
    return kept.select(*names, F.lit(False).alias("learned")).unionByName(houses.unionByName(anchors).select(*names, F.lit(True).alias("learned")))


def backfill(properties: DataFrame, *stages: tuple[str, DataFrame]) -> DataFrame:
    """Points for properties that have neither point nor source: property_id, lat, lon, geo_source of the first stage that answers
    inside the city box; properties that no stage answers keep nulls. Each stage: a name and property_id, lat, lon."""
    out = properties.where("lat is null and geo_source is null").select("property_id")
    found = []
    for i, (_, df) in enumerate(stages):
        good = df.where(inside(L.CITY_BOX, F.col("lat"), F.col("lon"))).groupBy("property_id").agg(F.min(F.struct("lat", "lon")).alias(f"s{i}"))
        out = out.join(good, "property_id", "left")
        found.append(F.when(F.col(f"s{i}").isNotNull(), F.struct(F.col(f"s{i}.lat").alias("lat"), F.col(f"s{i}.lon").alias("lon"), F.lit(stages[i][0]).alias("source"))))
    best = F.coalesce(*found)
    return out.select("property_id", best["lat"].alias("lat"), best["lon"].alias("lon"), best["source"].alias("geo_source"))


def upgrade_bare_rows(addresses: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows without a number move to the mean of their street's way centres; streets without ways stay.

    ``addresses``: addr_id, housenumber, lat, lon, key. ``ways``: key, lat, lon.
    """
    centre = ways.groupBy("key").agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
    j = addresses.join(centre, "key", "left")
    moves = F.col("housenumber").isin("", "ББ") & F.col("_lat").isNotNull()
    return j.select("addr_id", "key", "housenumber", F.when(moves, F.col("_lat")).otherwise(F.col("lat")).alias("lat"), F.when(moves, F.col("_lon")).otherwise(F.col("lon")).alias("lon"), moves.alias("moved"))
