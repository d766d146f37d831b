"""What a geocoder's payload says, and how far its point lies from what the map knows by that name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.functions.text import norm_name, street_key
from cartolex.operators.spatial import nearest_named
from cartolex.tables import cut

_PLACE = "struct<title:string,address:string,gps_coordinates:struct<latitude:double,longitude:double>>"
PAYLOAD = f"local_results array<{_PLACE}>, place_results {_PLACE}"
#: Letters of a needle at least, and of the runs by which needles meet names.
LEAST = 4


def parse_evidence(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds lat, lon, title, address of the first local result, else of the single place, that has a point; a point with a
    coordinate of 0 is none. Payloads that are null, no JSON or without a point keep nulls."""
    r = F.from_json(F.col(column), PAYLOAD)
    point = lambda p: F.when((p["gps_coordinates"]["latitude"] != 0) & (p["gps_coordinates"]["longitude"] != 0), p)
    best = F.coalesce(point(F.get(r["local_results"], F.lit(0))), point(r["place_results"]))
    return payloads.withColumn("_best", best).select(*payloads.columns, F.col("_best.gps_coordinates.latitude").alias("lat"), F.col("_best.gps_coordinates.longitude").alias("lon"), F.col("_best.title").alias("title"), F.col("_best.address").alias("address"))


def cross_distances(answers: DataFrame, addresses: DataFrame, pois: DataFrame) -> DataFrame:
    """For each answer (id, query, lat, lon) the metres to the nearest address of the street that the query names and to the
    nearest place whose folded name holds the folded query: id, street_distance_m, poi_distance_m; null where the map has none.

    ``addresses``: key, lat, lon. ``pois``: name, p_lat, p_lon. Streets meet on their key. Queries of LEAST letters or more
    meet distinct names on the query's first LEAST letters, which every name that holds it has; the rest is then compared.
    Distinct queries at distinct points look for the distinct points of a street, or of the names that hold them, in rings.
    """
    here = ["query", "lat", "lon"]
    asked = cut(answers.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*here).distinct(), "asked")
    asked_for = answers.select("query").distinct().select("query", street_key(F.col("query")).alias("key"), norm_name(F.col("query")).alias("needle"))
    at = addresses.select("key", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct()
    streets = asked_for.where("key <> ''").select("query", "key")
    least = lambda there, c: nearest_named(asked, there, "query", "lat", "lon").select(*here, F.col("b.distance").alias(c))
    street = least(cut(streets.join(at, "key").select("query", "p_lat", "p_lon"), "streets"), "street_distance_m")
    named = pois.select("name", "p_lat", "p_lon").distinct()
    norms = pois.select("name").distinct().select("name", norm_name(F.col("name")).alias("norm"))
    heads = norms.select("norm").distinct().where(F.length("norm") >= LEAST)
    heads = heads.withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("norm") - (LEAST - 1)), lambda i: F.substring(F.col("norm"), i, F.lit(LEAST))))))
    needles = asked_for.where(F.length("needle") >= LEAST).select("query", "needle").withColumn("head", F.substring("needle", 1, LEAST))
    holds = needles.join(heads, "head").where(F.col("norm").contains(F.col("needle"))).select("query", "norm").distinct()
    held = holds.join(norms, "norm").join(named, "name").select("query", "p_lat", "p_lon").distinct()
    poi = least(cut(held, "named"), "poi_distance_m")
    return answers.select("id", *here).join(street, here, "left").join(poi, here, "left").select("id", "street_distance_m", "poi_distance_m")
