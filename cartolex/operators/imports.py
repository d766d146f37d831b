"""New properties, street teaching, the roster of a feed, and the audit of public places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.classes import ranked_class
from cartolex.functions.geo import distance_m, inside, link_coords
from cartolex.functions.text import canonical_type, norm_type, type_rank
from cartolex.operators.lookup import is_shop
from cartolex.operators.spatial import enclosing_complex, nearest_of, nearest_pois


def import_geo(rows: DataFrame, resolved: DataFrame, ring: DataFrame) -> DataFrame:
    """Where new properties (property_id, address) are and what is left to do: property_id, lat, lon, geo_source, cached, queue.

    ``resolved``: property_id, lat, lon, source, trusted. ``ring``: property_id of those with a landmark around. An address
    that is missing or not resolved by a trusted stage is of low confidence and queued for a centre; a trusted one without a
    landmark is queued for that.
    """
    near = ring.select("property_id").distinct().withColumn("_near", F.lit(True))
    j = rows.select("property_id", "address").join(resolved.select("property_id", "lat", "lon", "source", "trusted"), "property_id", "left").join(near, "property_id", "left")
    said = F.coalesce(F.col("address"), F.lit("")) != ""
    good = said & F.coalesce("trusted", F.lit(False))
    cached = good & F.coalesce("_near", F.lit(False))
    queue = F.when(~good, "no_trusted_center").when(~cached, "no_landmark")
    return j.select("property_id", F.when(said, F.col("lat")).alias("lat"), F.when(said, F.col("lon")).alias("lon"), F.when(good, F.col("source")).otherwise("osm_low_confidence").alias("geo_source"), cached.alias("cached"), queue.alias("queue"))


def teach_streets(plan: DataFrame, answers: DataFrame, cap: int, budget: int, floor: int) -> DataFrame:
    """What a teaching run makes of its plan: pos, street, outcome (taught, miss, outside, limited, cap, budget).

    ``plan``: pos, street, cost (searches). ``answers``: pos, lat, lon, trusted, limited; several for a street with numbers.
    Streets go in order until one would pass the cap, the budget left is under the floor, or an answer is limited; what stops
    the run is the outcome of the street at which it stops and of those after it. A street is taught if an answer inside the
    city is trusted, outside if all its answers are, else a miss. Sums run over ranges of positions and their totals.
    """
    got = answers.groupBy("pos").agg(F.max("limited").alias("limited"), F.max(inside(L.CITY_BOX, F.col("lat"), F.col("lon")) & F.col("trusted")).alias("good"), F.max(inside(L.CITY_BOX, F.col("lat"), F.col("lon"))).alias("inside"))
    rows = plan.join(got, "pos", "left").withColumn("_block", F.floor(F.col("pos") / 4096))
    blocks = rows.groupBy("_block").agg(F.sum("cost").alias("_sum"))  # one row for 4096 positions
    before = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    rows = rows.join(before, "_block").withColumn("spent", F.col("_before") + F.sum("cost").over(Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stop = F.when(F.col("spent") > cap, "cap").when(budget - (F.col("spent") - F.col("cost")) < floor, "budget").when(F.coalesce("limited", F.lit(False)), "limited")
    rows = rows.withColumn("_stop", stop)
    halt = rows.where("_stop is not null").agg(F.min_by("_stop", "pos"), F.min("pos")).first()  # one row
    own = F.when(F.coalesce("good", F.lit(False)), "taught").when(F.col("inside") == False, "outside").otherwise("miss")  # noqa: E712
    return rows.select("pos", "street", (own if halt[1] is None else F.when(F.col("pos") >= halt[1], halt[0]).otherwise(own)).alias("outcome"))


def roster_slots(entries: DataFrame, centres: DataFrame, pois: DataFrame, complexes: DataFrame, most: int = 3, within_m: float = 200.0) -> DataFrame:
    """The landmarks that a feed's own list may claim: property_id, slot (from 1), name, distance_m.

    ``entries``: property_id, pos, name, type, url. ``centres``: property_id, lat, lon (both null or 0: no centre, no claim).
    ``pois``: name, p_lat, p_lon: the nearest row of an entry's name gives the point where its link has none. ``complexes``:
    poi_id, name, p_lat, p_lon: a shop's entry becomes the complex around it or goes. Entries without a point, farther than
    ``within_m``, or of a name that came before (case aside) go; the first ``most`` stay in order.
    """
    e = entries.where(F.trim("name") != "").select("property_id", "pos", F.trim("name").alias("name"), "type", link_coords(F.col("url")).alias("pin"))
    e = e.join(centres.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)").select("property_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), "property_id")
    at = pois.where("p_lat is not null and p_lon is not null").select(F.lower("name").alias("_n"), "p_lat", "p_lon").distinct()
    here = ["_n", "c_lat", "c_lon"]
    e = e.withColumn("_n", F.when(F.col("pin.lat").isNull() | F.col("pin.lon").isNull(), F.lower("name")))
    d = distance_m(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon"))
    known = nearest_of(e.where("_n is not null").select(*here).distinct(), at, "_n", d, "p_lat", "p_lon").select(*here, F.col("b").alias("_p"))
    e = e.join(known, here, "left").withColumn("lat", F.coalesce("pin.lat", "_p.p_lat")).withColumn("lon", F.coalesce("pin.lon", "_p.p_lon")).where("lat is not null and lon is not null").drop("_n")
    e = e.withColumn("shop", F.coalesce(is_shop(F.col("name"), F.col("type")), F.lit(False))).withColumn("shop_id", F.concat_ws(":", F.col("property_id").cast("string"), F.col("pos").cast("string")))
    plain = e.where("not shop").select("property_id", "pos", "name", "c_lat", "c_lon", "lat", "lon")
    inside_ = enclosing_complex(e.where("shop").select("shop_id", "lat", "lon"), complexes).where("poi_id is not null").select("shop_id", F.col("poi_id").alias("_c"))
    whole = complexes.select(F.col("poi_id").alias("_c"), F.col("name").alias("_name"), "p_lat", "p_lon")
    raised = e.where("shop").join(inside_, "shop_id").join(whole, "_c").select("property_id", "pos", F.col("_name").alias("name"), "c_lat", "c_lon", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    near = plain.unionByName(raised).withColumn("d", distance_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))).where(F.col("d") <= within_m)
    first = near.groupBy("property_id", F.lower("name").alias("_n")).agg(F.min_by(F.struct("pos", "name", "d"), "pos").alias("r"))
    slot = F.row_number().over(Window.partitionBy("property_id").orderBy("r.pos"))
    return first.withColumn("slot", slot).where(F.col("slot") <= most).select("property_id", "slot", F.col("r.name").alias("name"), F.floor(F.col("r.d") + 0.5).alias("distance_m"))


def rank_feed(entries: DataFrame, most: int = 3) -> DataFrame:
    """A feed's entries (property_id, name, type, distance_m), malls first, then the nearest, unmeasured ones last."""
    mall = F.when(type_rank(F.coalesce("type", F.lit(""))) >= L.TYPE_RANKS["mall"], 0).otherwise(1)
    rn = F.row_number().over(Window.partitionBy("property_id").orderBy(mall, F.col("distance_m").asc_nulls_last(), "name"))
    return entries.withColumn("rn", rn).where(F.col("rn") <= most).select("property_id", "rn", "name")


def type_problems(pois: DataFrame) -> DataFrame:
    """problem (unranked public, unranked paid, missing), kind, n: public types without a rank, and required classes without a row."""
    unranked = pois.groupBy(norm_type(F.col("type")).alias("kind")).agg(F.count("*").alias("n")).withColumn("c", ranked_class(F.col("kind"))).where("c is not null")
    present = pois.select(canonical_type(F.col("type")).alias("kind")).distinct()
    required = pois.sparkSession.createDataFrame([(c,) for c in L.REQUIRED_CLASSES], "kind string")
    missing = required.join(present, "kind", "left_anti").select(F.lit("missing").alias("problem"), "kind", F.lit(0).cast("long").alias("n"))
    return unranked.select(F.concat(F.lit("unranked "), "c").alias("problem"), "kind", "n").unionByName(missing)


def reachable(sample: DataFrame, pois: DataFrame, metres: float = 250.0, limit: int = 60) -> DataFrame:
    """Whether a search at its own pin serves each sampled place (poi_id, name, place_id, p_lat, p_lon): poi_id, served.

    One is served by a row of its id, of its name, or within 10 metres, among the ``limit`` best of a search."""
    pins = sample.select(F.col("poi_id").alias("sample_id"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    got = nearest_pois(pins, pois, metres, limit, "sample_id").join(pois.select("poi_id", F.col("place_id").alias("_pid")), "poi_id")
    own = sample.select(F.col("poi_id").alias("sample_id"), F.col("name").alias("_name"), F.col("place_id").alias("_own"))
    hit = got.join(own, "sample_id").where((F.col("_own") == F.col("_pid")) | (F.col("_name") == F.col("poi_name")) | (F.col("distance_m") <= 10)).select(F.col("sample_id").alias("poi_id")).distinct().withColumn("_hit", F.lit(True))
    return sample.select("poi_id").join(hit, "poi_id", "left").select("poi_id", F.coalesce("_hit", F.lit(False)).alias("served"))
