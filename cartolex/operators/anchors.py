"""Places that texts mention, the landmark of a property by layers, and spelling variants that the map itself shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.functions.text import canonical_word_key
from cartolex.operators.lookup import fold, place_category
from cartolex.operators.spatial import radius_join

#: Words that open the mention of a place.
OPENERS = ["во близина на", "близу до", "спроти", "кај", "near", "opposite"]
MENTION = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(OPENERS) + r")\s+([^.,;!?\n]+)"


def mentions(texts: DataFrame, most: int = 3) -> DataFrame:
    """Names that texts mention in order: id, pos, name. ``texts``: id, text. Two names joined by "и" or "and" are two; a name
    of fewer than 3 characters is none; of equal names the first counts; at most ``most`` for each text."""
    parts = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)), lambda m: F.split(m, r"(?iu)\s+(?:и|and)\s+")))
    names = F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= 3))
    return texts.select("id", F.posexplode(F.slice(names, 1, most)).alias("pos", "name"))


def resolve_landmark(properties: DataFrame, feed: DataFrame, cached: DataFrame, mentioned: DataFrame, ring: DataFrame) -> DataFrame:
    """The landmark of each property by the first layer that has one: feed, cache, details, map, none.

    All layers: property_id, landmark; a layer's smallest landmark counts where it has several rows, the ring's by ``rn``.
    """
    layers = [(feed, "feed"), (cached, "cache"), (mentioned, "details")]
    every = ring.select("property_id", F.lit(3).alias("p"), F.col("rn").cast("string").alias("o"), F.col("poi_name").alias("landmark"), F.lit("map").alias("layer")).where("o = '1'")
    for i, (df, name) in enumerate(layers):
        every = every.unionByName(df.select("property_id", F.lit(i).alias("p"), F.col("landmark").alias("o"), "landmark", F.lit(name).alias("layer")))
    best = every.where("landmark <> ''").groupBy("property_id").agg(F.min_by(F.struct("landmark", "layer"), F.struct("p", "o")).alias("b"))
    return properties.select("property_id").join(best, "property_id", "left").select("property_id", F.col("b.landmark").alias("landmark"), F.coalesce("b.layer", F.lit("none")).alias("layer"))


def harvest_variants(pois: DataFrame, metres: float = 60.0, least: int = 1) -> DataFrame:
    """Words that differ between a Cyrillic and a Latin name of one class at one place, where each name has exactly one word that
    the other lacks: word, canonical, support. ``pois``: poi_id, name, p_lat, p_lon."""
    words = lambda c: F.filter(F.split(fold(F.col(c)), " "), lambda w: w != "")
    facts = pois.select("poi_id", "name", "p_lat", "p_lon", place_category(F.col("name")).alias("cat"), F.transform(words("name"), canonical_word_key).alias("keys"), F.col("name").rlike("[Ѐ-ӿ]").alias("cyr"))
    left = facts.where("cyr").select(F.col("poi_id").alias("a_id"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.col("cat").alias("a_cat"), F.col("keys").alias("a_keys"))
    near = radius_join(left, facts.where("not cyr").select("poi_id", "p_lat", "p_lon", "cat", "keys"), metres).where(F.col("a_cat").eqNullSafe(F.col("cat")))
    a, b = F.array_except("a_keys", "keys"), F.array_except("keys", "a_keys")
    one = near.where((F.size(a) == 1) & (F.size(b) == 1) & (F.size(F.array_intersect("a_keys", "keys")) > 0))
    return one.groupBy(F.get(a, F.lit(0)).alias("word"), F.get(b, F.lit(0)).alias("canonical")).agg(F.count("*").alias("support")).where(F.col("support") >= least)
