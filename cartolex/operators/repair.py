"""Identities put right: contradictions, donations of dropped rows, reasons of merges, embassies and the whole repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.geo import inside
from cartolex.functions.text import identity_tokens, type_rank
from cartolex.operators.identity import countries_in, label_components, merge_decisions, survivor_key, suspect_pairs, traits_of

#: Fields that a dropped row gives to its survivor, as text.
DONATED = ("phone", "website", "plus_code", "price_level", "types", "place_url", "place_id")


def countries_of(name: Column) -> Column:
    return countries_in(F.array_distinct(identity_tokens(name)))


def contradict(a: Column, b: Column) -> Column:
    """Two names that both name countries, none of them the same."""
    x, y = countries_of(a), countries_of(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def tenant_absorbs_venue(anchor_type: Column, row_type: Column) -> Column:
    """A row inside a mall would take the mall's identity: the anchor has a mall's rank or more, the row has less."""
    venue = L.TYPE_RANKS["mall"]
    rank = lambda c: type_rank(F.coalesce(c, F.lit("")))
    return (rank(anchor_type) >= venue) & (rank(row_type) < venue)


def embassy_anchors(rows: DataFrame, anchors: DataFrame, traits: DataFrame | None = None) -> DataFrame:
    """For each embassy row (row_id, name) the one anchor (anchor_id, name, p_lat, p_lon) in the city of a country of its name,
    alike in being a residence or a consular section: row_id, anchor_id. Countries in the order in which they follow from the
    name, the first with exactly one such anchor counts. ``traits``: ``traits_of`` all names, where it is there already."""
    # what a row's name says hangs on the name alone, so each distinct name is asked about once
    traits = (traits or traits_of(rows.select("name"), anchors.select("name"))).where("traits.embassy").select("name", F.col("traits.qualified").alias("q"), F.col("traits.countries").alias("countries"))
    at = anchors.where(inside(L.CITY_BOX, F.col("p_lat"), F.col("p_lon"))).join(traits, "name")
    one = at.select("anchor_id", "q", F.explode("countries").alias("country")).groupBy("country", "q").agg(F.count("*").alias("n"), F.first("anchor_id").alias("anchor_id")).where("n = 1")
    # names that share a country do not contradict each other
    asked = traits.select("name", "q", F.posexplode("countries").alias("pos", "country"))
    found = asked.join(one, ["country", "q"]).groupBy("name").agg(F.min(F.struct("pos", "anchor_id")).alias("b"))
    return rows.join(found, "name").groupBy("row_id").agg(F.min("b").alias("b")).select("row_id", "b.anchor_id")


def donations(members: DataFrame) -> DataFrame:
    """What survivors get from the rows that are dropped for them: survivor_id and the fields after the merge.

    ``members``: survivor_id, poi_id, seq (the order of drops; null in the survivor's own row), the fields of DONATED,
    review_count, rating. An empty field takes the last dropped row's that is not; reviews where the survivor has none; so
    does the rating. Null and empty text are alike.
    """
    own = lambda c: F.max(F.when(F.col("seq").isNull(), F.col(c)))
    last = lambda c, some: F.max_by(F.when(some, F.col(c)), F.when(some & F.col("seq").isNotNull(), F.col("seq")))
    text = [F.coalesce(F.nullif(own(c), F.lit("")), last(c, F.col(c) != "")).alias(c) for c in DONATED]
    reviews = F.when(F.coalesce(own("review_count"), F.lit(0)) == 0, F.coalesce(last("review_count", F.col("review_count") > 0), own("review_count"))).otherwise(own("review_count"))
    return members.groupBy("survivor_id").agg(*text, reviews.alias("review_count"), F.coalesce(own("rating"), last("rating", F.col("rating").isNotNull())).alias("rating"))


def component_reasons(pois: DataFrame) -> DataFrame:
    """survivor_id and the distinct rules, sorted, by which the rows of its component merge."""
    decided = merge_decisions(suspect_pairs(pois), pois).where("merge")
    labels = label_components(decided.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    best = labels.join(pois.select(F.col("poi_id").alias("id"), survivor_key(F.col("review_count"), F.col("place_id"), F.col("name"), F.col("poi_id")).alias("key")), "id")
    best = best.groupBy("label").agg(F.max_by("id", "key").alias("survivor_id"))
    rules = decided.select(F.col("a_id").alias("id"), "rule").join(labels, "id").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("reasons"))
    return best.join(rules, "label").select("survivor_id", "reasons")


def repair_fusions(pois: DataFrame) -> DataFrame:
    """Rows after the undoing of fusions: poi_id, place_id, stripped.

    ``pois``: poi_id, name, source, place_id, osm_key. A row of the map's own source that carries the id of an anchor whose
    name contradicts its own loses the id first, so that it is not dropped as that anchor's copy; then the oldest row of each
    (source, place_id) stays, then the oldest of each (source, osm_key). Rows without the id or the key are no copies.
    """
    anchor = pois.where("source = 'google' and place_id is not null").groupBy("place_id").agg(F.min_by("name", "poi_id").alias("_anchor"))
    rows = pois.join(anchor, "place_id", "left")
    wrong = (F.col("source") == "osm") & F.coalesce(contradict(F.col("name"), F.col("_anchor")), F.lit(False))
    rows = rows.withColumn("stripped", wrong).withColumn("place_id", F.when(~wrong, F.col("place_id")))

    def first(df: DataFrame, key: str) -> DataFrame:
        """A row without the key is a partition of its own, by its id, so that none is large."""
        w = Window.partitionBy("source", key, F.when(F.col(key).isNull(), F.col("poi_id"))).orderBy("poi_id")
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    return first(first(rows, "place_id"), "osm_key").select("poi_id", "place_id", "stripped")
