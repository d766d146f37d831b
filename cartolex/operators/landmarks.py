"""Centres, caches, sweeps, audits and guards around the landmarks of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartolex.functions import lexicon as L
from cartolex.functions.geo import distance_m, inside, rounded
from cartolex.functions.text import house_number, once, spell_latin, street_key, to_latin, type_rank
from cartolex.operators.lookup import is_shop
from cartolex.operators.spatial import nearest_pois
from cartolex.tables import cut, dealt

#: Metres: a stored centre against the map's building; a cached place; a claimed distance; a geocoded pin.
MISMATCH_M, POISON_M, DRIFT_M, GUARD_M = 50.0, 200.0, 200.0, 500.0
#: Tiers of cached landmarks, the best first, and sources of points that are trusted.
TIERS = ["feed", "google", "extract", "osm_poi", "osm_low_confidence"]
TRUSTED_SOURCES = ["stored", "google_cached", "osm_building", "osm_interpolated", "osm_street_anchor"]
#: Lines that name an area and words that no query is checked by.
AREA_LINES = ["skopje", "grad skopje", "greater skopje", "skopje 1000", "north macedonia", "macedonia", "makedonija", "republic of north macedonia"]
QUERY_STOP = ["skopje", "severna", "makedonija", "macedonia", "north", "republic", "republicof"]


def has_point(lat: Column, lon: Column) -> Column:
    """Zero counts as missing."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))


def tier_rank(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, len(TIERS) - i) for i, t in enumerate(TIERS)], F.lit(0))


def center_trusted(geo_source: Column) -> Column:
    return F.coalesce(geo_source.isin(*TRUSTED_SOURCES), F.lit(False))


def search_centers(properties: DataFrame, resolved: DataFrame) -> DataFrame:
    """The centre to search around: id, c_lat, c_lon, trusted, center_source, mismatch_m (rounded).

    ``properties``: id, lat, lon, geo_source. ``resolved``: id, m_lat, m_lon, m_trusted, m_source of the offline map.
    """
    p = properties.join(resolved, "id", "left")
    weak = F.coalesce(F.col("geo_source").isin("osm_low_confidence", "osm_street_anchor"), F.lit(False))
    own = has_point(F.col("lat"), F.col("lon"))
    ok = F.coalesce(F.col("m_trusted"), F.lit(False)) & F.col("m_lat").isNotNull()
    building = F.col("m_source").isin("osm_building", "osm_interpolated")
    d = F.when(own & F.col("m_lat").isNotNull(), distance_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")))
    strong = own & ~weak
    moved = strong & ok & building & (d > MISMATCH_M)
    src = F.when(moved, "map").when(strong, "stored").when(ok, "map").when(F.col("m_lat").isNotNull(), "geocode").otherwise("none")
    p = p.withColumn("center_source", src).withColumn("_d", F.when(moved | (~strong & ok), rounded(d).cast("long")))
    pick = lambda a, b: F.when(F.col("center_source") == "stored", F.col(a)).when(F.col("center_source") == "none", 0.0).otherwise(F.col(b))
    return p.select("id", pick("lat", "m_lat").alias("c_lat"), pick("lon", "m_lon").alias("c_lon"), F.col("center_source").isin("stored", "map").alias("trusted"), "center_source", F.col("_d").alias("mismatch_m"))


def upgrade_cache(offers: DataFrame) -> DataFrame:
    """The landmark that stays for each property when a later one must have a strictly better tier: the first of the best.

    ``offers``: property_id, landmark, tier, seq.
    """
    key = F.struct(tier_rank(F.col("tier")).alias("r"), (-F.col("seq")).alias("s"))
    return offers.groupBy("property_id").agg(F.max_by(F.struct("landmark", "tier", "seq"), key).alias("b"), F.count("*").alias("offers")).select("property_id", "b.landmark", "b.tier", "b.seq", "offers")


def sweep_poison(cached: DataFrame, properties: DataFrame, places: DataFrame) -> DataFrame:
    """Verdicts on cached map landmarks: orphan (no property), downgraded, queued (already low) or verified.

    ``cached``: property_id, landmark, tier. ``properties``: property_id, lat, lon, geo_source. ``places``: name, p_lat, p_lon,
    one row for each name.
    """
    rows = cached.where(F.col("tier").isin("osm_poi", "osm_low_confidence"))
    j = rows.join(properties.withColumn("_there", F.lit(True)), "property_id", "left").join(places.withColumnRenamed("name", "landmark"), "landmark", "left")
    trusted = center_trusted(F.col("geo_source")) & has_point(F.col("lat"), F.col("lon"))
    far = F.coalesce(distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) > POISON_M, F.lit(False))
    verdict = F.when(F.col("_there").isNull(), "orphan").when(~trusted | far, F.when(F.col("tier") == "osm_poi", "downgraded").otherwise("queued")).otherwise("verified")
    return j.select("property_id", "landmark", "tier", verdict.alias("verdict"))


def same_place(stored: Column, map_name: Column) -> Column:
    """The stored words are a run of the map name's words, and hold its first one."""
    tok = lambda c: F.filter(F.split(F.lower(spell_latin(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    a, b = tok(stored), tok(map_name)
    run = F.exists(F.sequence(F.lit(1), F.greatest(F.size(b) - F.size(a) + 1, F.lit(1))), lambda i: F.slice(b, i, F.size(a)) == a)
    return (F.size(a) > 0) & (F.size(b) > 0) & F.array_contains(a, F.get(b, F.lit(0))) & run


def audit_feed(entries: DataFrame, places: DataFrame, drift_m: float = DRIFT_M) -> DataFrame:
    """Issues and warnings on named landmarks of a feed: property_id, pos, kind, measured_m.

    ``entries``: property_id, pos, landmark, claimed_m, lat, lon. ``places``: name, p_lat, p_lon. Names meet on their first word.
    Distinct landmarks meet distinct names, and distinct points of entries the distinct points of those names.
    """
    words = lambda c: F.filter(F.split(F.lower(spell_latin(F.col(c))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    named = entries.where(F.coalesce(F.trim("landmark"), F.lit("")) != "").select("landmark").distinct()
    # the map name's first word is one of the stored words
    on = places.select("name").distinct().withColumn("_w", F.get(words("name"), F.lit(0)))
    met = named.withColumn("_w", F.explode(F.array_distinct(words("landmark")))).join(on, "_w").where(same_place(F.col("landmark"), F.col("name"))).select("landmark", "name")
    here = ["landmark", "lat", "lon"]
    at = met.join(places.select("name", "p_lat", "p_lon").distinct(), "name").select("landmark", "p_lat", "p_lon").distinct()
    asked = entries.where(has_point(F.col("lat"), F.col("lon"))).select(*here).distinct()
    d = F.min(distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    far = asked.join(at, "landmark").groupBy(*here).agg(d.alias("d"))
    out = entries.join(met.select("landmark").distinct().withColumn("_met", F.lit(True)), "landmark", "left").join(far, here, "left")
    kind = (
        F.when(F.coalesce(F.trim("landmark"), F.lit("")) == "", "landmark-no-name").when(F.col("_met").isNull(), "landmark-not-on-map")
        .when(F.abs(F.col("d") - F.col("claimed_m")) > drift_m, "distance-drift").when(~has_point(F.col("lat"), F.col("lon")), "no-pin")
    )
    return out.withColumn("kind", kind).where("kind is not null").select("property_id", "pos", "kind", F.when(F.col("kind") == "distance-drift", rounded(F.col("d"))).cast("long").alias("measured_m"))


# --- the guard of geocoded answers


def norm_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(to_latin(c), r"[^a-z0-9]+", " "))


def is_area_line(c: Column) -> Column:
    n = F.trim(F.regexp_replace(F.regexp_replace(norm_line(c), r"\b\d+\b", " "), r"\s+", " "))
    return (n == "") | n.isin(*AREA_LINES) | n.rlike(r"(^| )(severna |north |republic of )*(macedon|makedon)(ia|ija)$")


def sanitize_query(c: Column) -> Column:
    """Without the area lines at its end."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.aggregate(F.reverse(parts), F.array().cast("array<string>"), lambda acc, p: F.when((F.size(acc) == 0) & is_area_line(p), acc).otherwise(F.concat(F.array(p), acc)))
    return F.array_join(F.when((F.size(kept) == 0) & (F.size(parts) > 0), F.slice(parts, 1, 1)).otherwise(kept), ", ")


def query_tokens(c: Column) -> Column:
    q = sanitize_query(c)
    words = F.flatten(F.transform(F.array(street_key(q), norm_line(q), norm_line(spell_latin(q))), lambda f: F.split(f, r"\s+")))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\d+$") & ~t.isin(*QUERY_STOP)))


def assess_geocode(answers: DataFrame) -> DataFrame:
    """Adds trusted, reason and exact_building to geocoded answers.

    ``answers``: query, lat, lon, title, address, street_distance_m, poi_distance_m (of the map's own rows, null: none).
    """
    # what texts say of each other is worked out once for each distinct three of them, by as many tasks as there are
    texts = ["query", "title", "address"]
    words = F.trim(F.concat_ws(" ", "title", "address"))
    line = F.trim(F.get(F.split(F.coalesce("address", F.lit("")), ","), F.lit(0)))
    both = F.array(norm_line(words), F.trim(F.regexp_replace(F.lower(spell_latin(words)), r"[^a-z0-9]+", " ")))
    held = once(both, lambda b: once(query_tokens(F.col("query")), lambda tokens: (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.exists(b, lambda x: F.contains(x, t)))))
    num = once(house_number(sanitize_query(F.col("query"))), lambda n: (n != "") & (n == house_number(line)))
    said = dealt(answers.select(*texts).distinct(), *texts).select(*[F.col(c).alias(f"_{c}") for c in texts], (words == "").alias("_empty"), is_area_line(line).alias("_area"), held.alias("_agree"), num.alias("_same"))
    reason = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no_evidence").when(~inside(L.CITY_BOX, F.col("lat"), F.col("lon")), "outside_bbox").when(F.col("_empty"), "no_evidence")
        .when(F.col("_area") & ~F.col("_agree"), "area_level_result").when(~F.col("_agree"), "query_mismatch").when(F.col("street_distance_m") > GUARD_M, "street_disagreement").when(F.col("poi_distance_m") > GUARD_M, "poi_disagreement").otherwise("ok")
    )
    judged = answers.join(said, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts]).withColumn("reason", reason).withColumn("trusted", F.col("reason") == "ok")
    return judged.withColumn("exact_building", F.col("trusted") & F.col("_same")).select(*answers.columns, "reason", "trusted", "exact_building")


def nearby_landmarks(ring: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` ranked places of a ring with distinct names: property_id, slot, landmark. ``ring``: property_id, rn, poi_name;
    the ``most`` best of distinct names are enough of it."""
    first = ring.groupBy("property_id", "poi_name").agg(F.min("rn").alias("rn"))
    slot = F.row_number().over(Window.partitionBy("property_id").orderBy("rn"))
    return first.withColumn("slot", slot).where(F.col("slot") <= most).select("property_id", "slot", F.col("poi_name").alias("landmark"))


#: Metres around a centre that are searched one after the other, and places that a search looks at.
GROWING_M, LOOKED_AT = (150.0, 400.0, 1000.0), 25


def adaptive_landmark(centres: DataFrame, pois: DataFrame, id_: str = "property_id") -> DataFrame:
    """The landmark of each centre by a radius that grows where nothing was found: id_, landmark, type, poi_id, radius_m, distance_m.

    Of the LOOKED_AT best places within the radius shops count only where nothing else does; the first that ranks as a mall or
    above is taken, else the first from a school upwards, else the first of all; names of fewer than 3 characters never are.
    A centre whose first radius with places has none that may be taken has no landmark. ``centres``: id_, lat, lon. ``pois``: as
    for ``nearest_pois``. Each radius is searched by cells of its own width, and only for the centres that are still open.
    """
    todo, found = centres.select(id_, "lat", "lon"), None
    for metres in GROWING_M:
        got = cut(nearest_pois(todo, pois, metres, LOOKED_AT, id_).withColumn("radius_m", F.lit(int(metres))), "ring")
        todo = todo.join(got.select(id_).distinct(), id_, "left_anti")
        found = got if found is None else found.unionByName(got)
    shop = F.coalesce(is_shop(F.col("poi_name"), F.col("poi_type")), F.lit(False))
    found = found.withColumn("shop", shop)
    places = found.groupBy(id_).agg(F.bool_and("shop").alias("_shops"))
    tier = F.when(F.col("rank") >= L.TYPE_RANKS["mall"], 0).when(F.col("rank") >= L.TYPE_RANKS["school"], 1).otherwise(2)
    kept = found.join(places, id_).where((~F.col("shop") | F.col("_shops")) & (F.length("poi_name") >= 3))
    best = kept.groupBy(id_).agg(F.min_by(F.struct("poi_name", "poi_type", "poi_id", "radius_m", "distance_m"), F.struct(tier, "rn")).alias("b"))
    return best.select(id_, F.col("b.poi_name").alias("landmark"), F.col("b.poi_type").alias("type"), "b.poi_id", "b.radius_m", "b.distance_m")
