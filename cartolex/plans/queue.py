"""Work queues: harvest from many sources through a ledger, and one drain pass under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.geo import inside
from cartolex.sources.mapsink import publish
from cartolex.tables import cut, running

BUDGET_STOP = 1


def queue_timestamp(c: Column) -> Column:
    """Milliseconds from a number, a number as text, or ISO text; null where it is none of these."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("bigint"), F.unix_millis(F.try_to_timestamp(text)))


def harvest_queues(canonical: DataFrame, sources: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Merges queues: ``queue`` (canonical and what is new), ``ledger`` (new imports), ``rejected`` (null reason or time).

    ``canonical``: property_id, reason, created_at. ``sources``: source, property_id, reason, created_at (any form). ``ledger``:
    source, property_id, reason, created_at. An event that the ledger has is skipped; a property that is queued keeps its row;
    of several new rows for one property the oldest counts, then the first source.
    """
    s = sources.withColumn("ms", queue_timestamp(F.col("created_at")))
    bad = F.col("reason").isNull() | F.col("ms").isNull() | F.col("property_id").isNull()
    rejected = s.where(bad).select("source", "property_id", "reason", F.col("created_at").cast("string").alias("created_at"))
    good = s.where(~bad).select("source", "property_id", "reason", F.col("ms").alias("created_at")).distinct()
    new = good.join(ledger.select("source", "property_id", "reason", "created_at"), ["source", "property_id", "reason", "created_at"], "left_anti")
    pick = new.groupBy("property_id").agg(F.min_by(F.struct("reason", "created_at"), F.struct("created_at", "source", "reason")).alias("b")).select("property_id", "b.reason", "b.created_at")
    added = pick.join(canonical.select("property_id"), "property_id", "left_anti")
    queue = canonical.select("property_id", "reason", "created_at", F.lit(False).alias("added")).unionByName(added.withColumn("added", F.lit(True)))
    return {"queue": queue, "ledger": new, "rejected": rejected}


def drain_queue(queue: DataFrame, properties: DataFrame, offline: DataFrame, geocoded: DataFrame, searches_left: int) -> DataFrame:
    """One pass over a queue: property_id, outcome, lat, lon, geo_source.

    Outcomes: orphan, kept (nothing to repair), no_address, offline, google, rejected, budget_stop (stays queued). Paid answers
    are taken in order of property_id while the budget lasts; rows that need none are processed behind a stop. ``offline``:
    property_id, m_lat, m_lon, m_trusted, m_source. ``geocoded``: property_id, g_lat, g_lon, g_trusted.
    """
    j = queue.select("property_id", "reason").join(properties.withColumn("_there", F.lit(True)), "property_id", "left").join(offline, "property_id", "left").join(geocoded, "property_id", "left")
    needs = (F.col("reason") == "center_mismatch") | F.col("lat").isNull() | F.col("lon").isNull() | F.coalesce(F.col("geo_source") == "osm_low_confidence", F.lit(False))
    addressed = F.length(F.trim(F.coalesce("address", F.lit("")))) >= 3
    free = F.coalesce(F.col("m_trusted") & inside(L.CITY_BOX, F.col("m_lat"), F.col("m_lon")), F.lit(False))
    step = F.when(F.col("_there").isNull(), "orphan").when(~needs, "kept").when(~addressed, "no_address").when(free, "offline").otherwise("paid")
    j = j.withColumn("step", step)
    # one list in the order of ids; only the rows that cost something are ranked, and the budget bounds what matters of them
    paid = j.where("step = 'paid'").select("property_id").orderBy("property_id").limit(max(0, searches_left - BUDGET_STOP + 1)).withColumn("_in", F.lit(True))
    j = j.join(paid, "property_id", "left")
    good = F.coalesce(F.col("g_trusted") & inside(L.CITY_BOX, F.col("g_lat"), F.col("g_lon")), F.lit(False))
    outcome = F.when(F.col("step") != "paid", F.col("step")).when(F.col("_in").isNull(), "budget_stop").when(good, "google").otherwise("rejected")
    j = j.withColumn("outcome", outcome)
    pick = lambda m, g, own: F.when(F.col("outcome") == "offline", F.col(m)).when(F.col("outcome") == "google", F.col(g) if isinstance(g, str) else g).otherwise(F.col(own))
    return j.select("property_id", "outcome", pick("m_lat", "g_lat", "lat").alias("lat"), pick("m_lon", "g_lon", "lon").alias("lon"), pick("m_source", F.lit("google_cached"), "geo_source").alias("geo_source"))


def budget_prefix(tasks: DataFrame, cap: int, cost: str = "cost", order: str = "pos") -> DataFrame:
    """Tasks in order while their running cost stays within the cap."""
    return running(tasks, [order], cost, "_place").drop("_place").where(F.col("spent") <= cap)


#: What a drain counts, in the order of its report.
COUNTERS = ("processed", "google_upgraded", "offline_upgraded", "landmark_cached", "map_learned", "geocode_rejected", "budget_stopped", "left_in_queue")


def drain_effects(queue: DataFrame, properties: DataFrame, offline: DataFrame, geocoded: DataFrame, landmarks: DataFrame, known: DataFrame, searches_left: int, counted: Observation | None = None) -> dict[str, DataFrame]:
    """All that one pass over a queue changes, from one plan: patches, learned, cached, queue, counters.

    ``patches``: property_id, lat, lon, geo_source of rows that got a better point. ``learned``: address, lat, lon, kind (building
    or street) that a paid answer taught the map, unless ``known`` (address, kind) has it; of rows with one address the one with
    the smallest id. ``cached``: property_id, landmark, which every row that left the queue but orphans and those without an
    address gets where ``landmarks`` (property_id, slot, landmark) has any. ``queue``: what stays, the rows that the budget
    stopped. ``counters``: one row of COUNTERS; ``counted`` observes them as the outcomes are written.
    ``geocoded`` has g_exact besides: whether the answer names the very building. The rest is as for ``drain_queue``.
    """
    told = drain_queue(queue, properties, offline, geocoded, searches_left)
    facts = properties.select("property_id", "address").join(geocoded.select("property_id", "g_exact"), "property_id", "left")
    facts = told.join(facts, "property_id", "left").join(queue.select("property_id", "reason"), "property_id")
    first = landmarks.where("slot = 1").select("property_id", "landmark")
    facts = facts.join(first, "property_id", "left").withColumn("landmark", F.when(~F.col("outcome").isin("orphan", "no_address", "budget_stop"), F.col("landmark")))
    kind = F.when(F.col("outcome") == "google", F.when(F.coalesce("g_exact", F.lit(False)), "building").otherwise("street"))
    facts = facts.withColumn("kind", kind).join(known.select("address", "kind").distinct().withColumn("_known", F.lit(True)), ["address", "kind"], "left")
    taught = F.col("kind").isNotNull() & F.col("_known").isNull()
    teacher = facts.where(taught).groupBy("address", "kind").agg(F.min("property_id").alias("property_id")).select("property_id", F.lit(True).alias("_taught"))
    facts = facts.drop("_known").join(teacher, "property_id", "left").withColumn("taught", F.coalesce("_taught", F.lit(False))).drop("_taught")
    n = lambda c: F.count_if(c)
    is_ = lambda what: F.col("outcome") == what
    counts = [n(~is_("budget_stop")), n(is_("google")), n(is_("offline")), n(F.col("landmark").isNotNull()), n(F.col("taught")), n(is_("rejected")), n(is_("budget_stop")), n(is_("budget_stop"))]
    counts = [c.alias(name) for c, name in zip(counts, COUNTERS, strict=True)]
    facts = cut(facts.observe(counted, *counts) if counted else facts, "drained")
    return {
        "patches": facts.where("outcome in ('google', 'offline')").select("property_id", "lat", "lon", "geo_source"),
        "learned": facts.where("taught").select("address", "lat", "lon", "kind"),
        "cached": facts.where("landmark is not null").select("property_id", "landmark"),
        "queue": facts.where("outcome = 'budget_stop'").select("property_id", "reason"),
        "counters": facts.agg(*counts),
    }


def commit_drain(effects: dict[str, DataFrame], path: str, base: int) -> int:
    """All effects of a pass as one version: a reader sees the queue without what left it and the patches, or neither."""
    return publish(effects, path, base)
