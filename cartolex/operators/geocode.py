"""Addresses to points in stages, and what addresses teach the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.functions.text import ascii_lower, house_number, house_value, street_key, within_one_edit


def resolve_keys(asked: DataFrame, keys: DataFrame, least: int = 6) -> DataFrame:
    """Adds ``key``: the street key itself if the map has it, else the only key one edit away (keys of ``least`` characters or
    more), else itself. ``asked``: raw_key. ``keys``: key, distinct. Misses and keys meet on what is left of them without
    one character, an equi-join that no pair one edit apart escapes."""
    here = keys.select("key").withColumn("_known", F.lit(True))
    j = asked.join(here, asked["raw_key"] == here["key"], "left")
    missed = j.where("_known is null").where(F.length("raw_key") >= least).select("raw_key").distinct()
    a = missed.select("raw_key", F.explode(_shortened("raw_key")).alias("h"))
    b = keys.select(F.col("key").alias("other"), F.explode(_shortened("key")).alias("h"))
    pairs = a.join(b, "h").where(within_one_edit(F.col("raw_key"), F.col("other"))).select("raw_key", "other").distinct()
    one = pairs.groupBy("raw_key").agg(F.count("*").alias("c"), F.first("other").alias("other")).where("c = 1").select("raw_key", "other")
    out = j.drop("key").join(one, "raw_key", "left")
    return out.withColumn("key", F.when(F.col("_known"), F.col("raw_key")).otherwise(F.coalesce("other", "raw_key"))).drop("_known", "other")


def _shortened(c: str):
    """A key and all that is left of it without one character: two keys one edit apart share one of these."""
    k = F.col(c)
    return F.array_distinct(F.concat(F.array(k), F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))))


def resolve_addresses(asked: DataFrame, addresses: DataFrame, strict_neighbour: bool = False) -> DataFrame:
    """Points for addresses: id, lat, lon, trusted, source.

    ``asked``: id, address. ``addresses``: addr_id, street, housenumber, lat, lon, key, source. Stages, the first that answers
    counts: the exact number; a compound number that holds it, shortest first; between two numbered neighbours (the upper one
    is the largest number of the street; with ``strict_neighbour`` the next); the street's own row; its first row.
    """
    q = asked.select("id", "address", street_key(F.col("address")).alias("raw_key"), house_number(F.col("address")).alias("num")).withColumn("target", house_value(F.col("num")))
    q = resolve_keys(q, addresses.select("key").distinct())
    # a street's rows of one number are one: its first and last row say all that the stages ask
    point = F.struct("lat", "lon")
    bare = F.struct("source", (-F.col("addr_id")).alias("i"), "lat", "lon")
    rows = addresses.groupBy("key", "housenumber").agg(F.min("addr_id").alias("i"), F.min_by(point, "addr_id").alias("first"), F.max_by(point, "addr_id").alias("last"), F.count("*").alias("n"), F.max(bare).alias("s"))
    rows = rows.withColumn("v", house_value(F.col("housenumber")))
    num, no = F.col("num"), F.col("housenumber")
    # and an address is asked once, however many ask for it
    j = q.where("raw_key <> ''").select("key", "num", "target").distinct().join(rows, "key")
    numbered = ~no.isin("", "ББ")
    exact = (num != "") & (ascii_lower(no) == ascii_lower(num))
    compound = (num != "") & ascii_lower(no).contains(ascii_lower(num))
    fits = (num != "") & numbered & F.col("v").isNotNull()
    low, high = fits & (F.col("v") <= F.col("target")), fits & (F.col("v") > F.col("target"))
    at = lambda c: F.struct("v", F.col(f"{c}.lat").alias("lat"), F.col(f"{c}.lon").alias("lon"))
    upper = F.min_by(at("first"), F.when(high, F.struct("v", no))) if strict_neighbour else F.max_by(at("last"), F.when(high, F.struct("v", no)))
    g = j.groupBy("key", "num", "target").agg(
        F.min_by("first", F.when(exact, F.struct(F.when(no == num, 0).otherwise(1), "i"))).alias("a"),
        F.min_by("first", F.when(compound, F.struct(F.length(no), "i"))).alias("c"),
        F.max_by(at("last"), F.when(low, F.struct("v", no))).alias("lo"),
        upper.alias("hi"),
        F.coalesce(F.sum(F.when(numbered & (num != ""), F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.when(~numbered, F.col("s"))).alias("s"),
        F.min_by("first", F.struct(no, "i")).alias("f"),
    )
    t = (F.col("target") - F.col("lo.v")) / (F.col("hi.v") - F.col("lo.v"))
    between = F.when((F.col("n") >= 2) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.struct((F.col("lo.lat") + t * (F.col("hi.lat") - F.col("lo.lat"))).alias("lat"), (F.col("lo.lon") + t * (F.col("hi.lon") - F.col("lo.lon"))).alias("lon")))
    side = F.when((F.col("n") >= 2) & (F.col("lo").isNotNull() | F.col("hi").isNotNull()), F.coalesce(F.when(F.col("lo").isNotNull(), F.struct(F.col("lo.lat").alias("lat"), F.col("lo.lon").alias("lon"))), F.struct(F.col("hi.lat").alias("lat"), F.col("hi.lon").alias("lon"))))
    made = lambda p, ok, src: F.when(p.isNotNull(), F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.lit(ok).alias("trusted"), F.lit(src).alias("source")))
    anchor = F.when(F.col("s.source") == "google_street", made(F.col("s"), True, "osm_street_anchor")).otherwise(made(F.col("s"), False, "osm_low_confidence"))
    best = F.coalesce(made(F.col("a"), True, "osm_building"), made(F.col("c"), True, "osm_building"), made(between, True, "osm_interpolated"), made(side, False, "osm_low_confidence"), anchor, made(F.col("f"), False, "osm_low_confidence"))
    out = q.select("id", F.when(F.col("raw_key") != "", F.col("key")).alias("key"), "num").join(g.select("key", "num", best.alias("b")), ["key", "num"], "left")
    return out.select("id", F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"), F.coalesce("b.trusted", F.lit(False)).alias("trusted"), F.coalesce("b.source", F.lit("osm_low_confidence")).alias("source"))
