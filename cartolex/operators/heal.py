"""Identities of anchors handed to rows without one: a serial choice, made by rounds of offers that many tasks share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.operators.identity import TOKEN_M, tier_of, traits_of
from cartolex.operators.repair import embassy_anchors, tenant_absorbs_venue
from cartolex.operators.spatial import radius_join
from cartolex.tables import cut

#: Parts that the offers to one set of anchors are dealt over before the first of them are taken.
PARTS = 32


def heal_whole(osm: DataFrame, anchors: DataFrame, metres: float = TOKEN_M) -> DataFrame:
    """The anchor of each row that has one: osm_id, anchor_id, kind (merged: the row takes its identity; pin_only: its point alone).

    ``osm``: osm_id, name, type, lat, lon, rows without an identity. ``anchors``: anchor_id, anchor_name, anchor_type, p_lat, p_lon.
    Rows choose in the order of their ids. An embassy takes the one anchor in the city of a country that it names; if an earlier
    row has that, its point alone. Other rows take the nearest free anchor within ``metres`` that agrees with their name; a
    tenant never takes a mall by a part of its name, and names of different countries never agree. Rows or anchors without a
    point are chosen by nobody, and choose embassies alone.
    """
    alike = ["name", "type", "lat", "lon"]
    o = osm.groupBy(*alike).agg(F.min("osm_id").alias("o"))
    same = ["anchor_name", "anchor_type", "p_lat", "p_lon"]
    a = cut(anchors.groupBy(*same).agg(F.min("anchor_id").alias("a"), F.count("*").alias("room")), "anchors")
    traits = traits_of(o.select("name"), a.select("anchor_name"))
    venue, inner = tenant_absorbs_venue(F.col("anchor_type"), F.lit("")), tenant_absorbs_venue(F.lit("mall"), F.col("type"))
    near = radius_join(o.join(traits, "name").withColumn("inner", inner), a.join(traits.toDF("anchor_name", "anchor_traits"), "anchor_name").withColumn("venue", venue), metres)
    x, y = F.col("traits.countries"), F.col("anchor_traits.countries")
    apart = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    tier = tier_of(F.col("traits"), F.col("anchor_traits"), F.col("distance"), F.lit(False), F.lit(True))
    fit = near.where(~apart).withColumn("tier", tier).where((F.col("tier") != "none") & ~((F.col("tier") == "subset") & F.col("venue") & F.col("inner")))
    turn = F.row_number().over(Window.partitionBy("o").orderBy("distance", "a"))
    lists = fit.select("o", "a", turn.alias("turn"))
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in alike]
    rows = osm.alias("r").join(o.alias("s"), null_safe).select("osm_id", "o", "r.name")
    set_of = anchors.alias("r").join(a.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in same]).select("anchor_id", "a")
    embassy = embassy_anchors(rows.select(F.col("osm_id").alias("row_id"), "name"), anchors.select("anchor_id", F.col("anchor_name").alias("name"), "p_lat", "p_lon"), traits)
    embassy = cut(embassy.withColumnRenamed("row_id", "osm_id"), "embassies")
    # an embassy's list is its one anchor; lists of others are those of all rows alike
    fixed = embassy.join(set_of, "anchor_id").select("osm_id", (-F.col("osm_id") - 1).alias("o"), "a", F.lit(1).alias("turn"))
    asks = cut(rows.select("osm_id", "o").join(fixed.select("osm_id"), "osm_id", "left_anti").unionByName(fixed.select("osm_id", "o")), "rows")
    lists = cut(lists.unionByName(fixed.select("o", "a", "turn")), "lists")
    held = settled(asks, lists, a.select("a", "room"))
    # of a set of anchors the rows that it holds take one each, both by their ids
    nth = lambda c: F.row_number().over(Window.partitionBy("a").orderBy(c))
    won = held.withColumn("nth", nth("osm_id")).join(set_of.withColumn("nth", nth("anchor_id")), ["a", "nth"]).select("osm_id", "anchor_id", F.lit("merged").alias("kind"))
    pins = embassy.join(held.select("osm_id"), "osm_id", "left_anti").select("osm_id", "anchor_id", F.lit("pin_only").alias("kind"))
    return won.unionByName(pins)


def settled(rows: DataFrame, lists: DataFrame, room: DataFrame) -> DataFrame:
    """Who holds a place in the end: osm_id, a. ``rows``: osm_id, o. ``lists``: o, a, turn (from 1). ``room``: a, room (places).

    Each round the rows without a place offer themselves to the next on their list that may still take them, and each a holds the
    smallest ids that have ever offered, as many as it has places. As all hold by the same order, what is held when nobody offers
    any more is what rows choosing one after the other get. Offers that can only fail are not made: of rows of one o the earlier
    come no later on the list, so the n-th starts where the list has n places, and goes if it never has; and as the largest id
    that a full a holds only falls, a row passes over all that are full of smaller ids at once. There are as many rounds as the
    longest chain of rows that put out each other. Rows of one o and offers to one a are dealt over parts, whose first ones
    alone meet.
    """
    part = F.pmod(F.xxhash64("osm_id"), F.lit(PARTS))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("osm_id"))
    upto = F.sum("room").over(Window.partitionBy("o").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = cut(lists.join(room, "a").withColumn("upto", upto), "listed")
    early = rows.join(listed.groupBy("o").agg(F.max("upto").alias("_all")), "o").withColumn("_p", part)
    early = early.withColumn("_n", nth("o", "_p")).where("_n <= _all").withColumn("_n", nth("o")).where("_n <= _all")
    every = early.join(listed, "o").where("_n <= upto and _n > upto - room").select("osm_id", "o", "turn", "a", "room")
    while True:
        some = every.withColumn("_p", part).withColumn("_n", nth("a", "_p"))
        first = some.where("_n <= room").withColumn("_n", nth("a")).withColumn("ok", F.col("_n") <= F.col("room"))
        state = cut(some.where("_n > room").withColumn("ok", F.lit(False)).unionByName(first).select("osm_id", "o", "turn", "a", "room", "ok"), "held")
        held, out = state.where("ok"), state.where("not ok").select("osm_id", "o", F.col("turn").alias("_turn"))
        if not out.limit(1).count():
            return held.select("osm_id", "a")
        full = held.groupBy("a", "room").agg(F.max("osm_id").alias("_last"), F.count("*").alias("_held")).where("_held >= room").select("a", "_last")
        still = F.col("_last").isNull() | (F.col("_last") > F.col("osm_id"))
        again = out.join(listed.join(full, "a", "left"), "o").where((F.col("turn") > F.col("_turn")) & still)
        again = again.groupBy("osm_id", "o").agg(F.min(F.struct("turn", "a", "room")).alias("b")).select("osm_id", "o", "b.*")
        every = held.drop("ok").unionByName(again)
