"""Centres, sweeps, audits, guards, queues, captures and the stream, over the projected tables."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import functions as F

from cartolex.catalog.registry import query
from cartolex.catalog.search import _NEAR
from cartolex.fixtures import POIS_SQL, PROPERTIES_SQL, distance_sql, names_by_remainder, pois, properties, shared_folder, table
from cartolex.operators import landmarks, spatial
from cartolex.plans import queue
from cartolex.sources import capture, mapsink
from cartolex.streaming import watch, workqueue

# --- properties with sources and what the offline map says of them

_PROPS_SQL = f"""(select property_id as id, case when property_id % 6 = 0 then null else lat end as lat, case when property_id % 6 = 0 then null else lon end as lon,
  case property_id % 4 when 0 then 'stored' when 1 then 'osm_low_confidence' when 2 then 'osm_building' else null end as geo_source from {PROPERTIES_SQL})"""
_MAP_SQL = f"""(select property_id as id, case when property_id % 5 = 0 then null else lat + (property_id % 3) * 0.0004 end as m_lat, case when property_id % 5 = 0 then null else lon end as m_lon,
  property_id % 5 <> 0 and property_id % 7 <> 0 as m_trusted, case when property_id % 2 = 0 then 'osm_building' else 'osm_street_anchor' end as m_source from {PROPERTIES_SQL})"""


def _props(spark, sf_dir):
    k = F.col("property_id")
    src = F.when(k % 4 == 0, "stored").when(k % 4 == 1, "osm_low_confidence").when(k % 4 == 2, "osm_building")
    return properties(spark, sf_dir).select(k.alias("id"), F.when(k % 6 != 0, F.col("lat")).alias("lat"), F.when(k % 6 != 0, F.col("lon")).alias("lon"), src.alias("geo_source"))


def _map(spark, sf_dir):
    k = F.col("property_id")
    return properties(spark, sf_dir).select(
        k.alias("id"), F.when(k % 5 != 0, F.col("lat") + (k % 3) * 0.0004).alias("m_lat"), F.when(k % 5 != 0, F.col("lon")).alias("m_lon"), ((k % 5 != 0) & (k % 7 != 0)).alias("m_trusted"), F.when(k % 2 == 0, "osm_building").otherwise("osm_street_anchor").alias("m_source")
    )


@query(f"""select id, case center_source when 'stored' then lat when 'none' then 0.0 else m_lat end as c_lat, case center_source when 'stored' then lon when 'none' then 0.0 else m_lon end as c_lon, center_source in ('stored', 'map') as trusted, center_source,
  case when moved or (not strong and ok) then floor(d + 0.5)::bigint end as mismatch_m from (
  select *, strong and ok and m_source in ('osm_building', 'osm_interpolated') and coalesce(d > 50, false) as moved, case when strong and ok and m_source in ('osm_building', 'osm_interpolated') and coalesce(d > 50, false) then 'map' when strong then 'stored' when ok then 'map' when m_lat is not null then 'geocode' else 'none' end as center_source
  from (select p.*, m.* exclude (id), p.lat is not null and coalesce(geo_source not in ('osm_low_confidence', 'osm_street_anchor'), true) as strong, m_trusted and m_lat is not null as ok, case when p.lat is not null and m_lat is not null then {distance_sql('p.lat', 'p.lon', 'm_lat', 'm_lon')} end as d
    from {_PROPS_SQL} p join {_MAP_SQL} m using (id)))""")
def search_center(spark, sf_dir):
    return landmarks.search_centers(_props(spark, sf_dir), _map(spark, sf_dir))


_TIER = "case event_type when 'purchase' then 'feed' when 'signup' then 'google' when 'click' then 'extract' when 'view' then 'osm_poi' else 'osm_low_confidence' end"
_TIER_MAP = {"purchase": "feed", "signup": "google", "click": "extract", "view": "osm_poi", "error": "osm_low_confidence"}


def _offers(events):
    tier = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in _TIER_MAP.items()])
    return events.select(F.col("user_id").alias("property_id"), F.concat(F.lit("place "), (F.col("event_id") % 97).cast("string")).alias("landmark"), tier.alias("tier"), F.col("event_id").alias("seq"))


_CACHE_SQL = f"""select property_id, landmark, tier, seq{{}} from (select *, row_number() over (partition by property_id order by r desc, seq) as n, count(*) over (partition by property_id) as offers from (
  select user_id as property_id, 'place ' || (event_id % 97) as landmark, {_TIER} as tier, event_id as seq, case event_type when 'purchase' then 5 when 'signup' then 4 when 'click' then 3 when 'view' then 2 else 1 end as r from events)) where n = 1"""


@query(_CACHE_SQL.format(", offers"))
def landmark_cache_upgrade(spark, sf_dir):
    return landmarks.upgrade_cache(_offers(table(spark, sf_dir, "events")))


@query(_CACHE_SQL.format(""))
def stream_watch(spark, sf_dir):
    """The same cache kept by a stream over the events, all that is there at once."""
    at = f"{queue_folder(spark)}/watch-{tempfile.mktemp(dir='')[1:]}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = watch.watch_cache(_offers(events), f"{at}/cache", f"{at}/checkpoint")
    q.awaitTermination()
    return watch.latest(spark, f"{at}/cache", q.lastProgress["batchId"] if q.lastProgress else 0)


def queue_folder(spark) -> str:
    return f"{shared_folder(spark)}/cartolex-streams"


_CACHED_SQL = f"(select property_id, n as landmark, case when property_id % 2 = 0 then 'osm_poi' when property_id % 5 = 0 then 'google' else 'osm_low_confidence' end as tier from (select property_id * 13 % 1700 as property_id, p.name as n from {PROPERTIES_SQL} c join {POIS_SQL} p on p.poi_id = c.property_id + 1))"
_PLACE_SQL = f"(select name, arg_min(p_lat, poi_id) as p_lat, arg_min(p_lon, poi_id) as p_lon from {POIS_SQL} group by name)"


@query(f"""select c.property_id, landmark, tier, case when p.id is null then 'orphan' when not (coalesce(geo_source in ('stored', 'google_cached', 'osm_building', 'osm_interpolated', 'osm_street_anchor'), false) and coalesce(lat <> 0 and lon <> 0, false))
  or coalesce({distance_sql('lat', 'lon', 'p_lat', 'p_lon')} > 200, false) then case when tier = 'osm_poi' then 'downgraded' else 'queued' end else 'verified' end as verdict
  from {_CACHED_SQL} c left join {_PROPS_SQL} p on p.id = c.property_id left join {_PLACE_SQL} m on m.name = landmark where tier in ('osm_poi', 'osm_low_confidence')""")
def poison_sweep(spark, sf_dir):
    p = pois(spark, sf_dir)
    k = F.col("property_id")
    cached = properties(spark, sf_dir).select("property_id").join(p.select((F.col("poi_id") - 1).alias("property_id"), F.col("name").alias("landmark")), "property_id").select((k * 13 % 1700).alias("property_id"), "landmark")
    cached = cached.withColumn("tier", F.when(k % 2 == 0, "osm_poi").when(k % 5 == 0, "google").otherwise("osm_low_confidence"))
    places = p.groupBy("name").agg(F.min_by("p_lat", "poi_id").alias("p_lat"), F.min_by("p_lon", "poi_id").alias("p_lon"))
    return landmarks.sweep_poison(cached, _props(spark, sf_dir).withColumnRenamed("id", "property_id"), places)


_ENTRY_SQL = f"""(select property_id, (property_id % 3)::integer as pos, case property_id % 8 when 0 then '' when 1 then 'nowhere at all' else (select min(name) from {POIS_SQL} where poi_id = property_id % 500 + 1) end as landmark, (property_id % 40) * 100.0 as claimed_m,
  case when property_id % 9 = 0 then null else lat end as lat, lon from {PROPERTIES_SQL})"""


@query(f"""select property_id, pos, kind, case when kind = 'distance-drift' then floor(d + 0.5)::bigint end as measured_m from (
  select property_id, pos, d, case when landmark = '' then 'landmark-no-name' when n = 0 then 'landmark-not-on-map' when abs(d - claimed_m) > 200 then 'distance-drift' when lat is null then 'no-pin' end as kind from (
    select property_id, pos, landmark, claimed_m, lat, count(p.name) as n, min(case when lat is not null then {distance_sql('lat', 'lon', 'p_lat', 'p_lon')} end) as d
    from {_ENTRY_SQL} e left join {POIS_SQL} p on p.name = landmark group by all)) where kind is not null""")
def feed_audit(spark, sf_dir):
    k = F.col("property_id")
    p = pois(spark, sf_dir)
    named = properties(spark, sf_dir).join(names_by_remainder(spark, sf_dir, 500).withColumnRenamed("name", "_n"), k % 500 == F.col("_k"), "left")
    entries = named.select("property_id", (k % 3).cast("int").alias("pos"), F.when(k % 8 == 0, "").when(k % 8 == 1, "nowhere at all").otherwise(F.col("_n")).alias("landmark"), ((k % 40) * 100.0).alias("claimed_m"), F.when(k % 9 != 0, F.col("lat")).alias("lat"), "lon")
    return landmarks.audit_feed(entries, p.select("name", "p_lat", "p_lon"))


@query(f"""with ring as (select *, row_number() over (partition by property_id order by stop, rank desc, d, prom desc, poi_name, poi_id) as rn from ({_NEAR}) where d <= 200),
one as (select property_id, poi_name, min(rn) as rn from ring group by all)
select property_id, slot::integer as slot, landmark from (select property_id, poi_name as landmark, row_number() over (partition by property_id order by rn) as slot from one) where slot <= 3""")
def nearby_landmarks(spark, sf_dir):
    return landmarks.nearby_landmarks(spatial.nearest_pois(properties(spark, sf_dir), pois(spark, sf_dir), 200.0, 3, by_name=True))


_ANSWERS_SQL = """(select p_partkey as id, p_name as n, (p_partkey % 90 + 1)::varchar as num, case when p_partkey % 13 = 0 then null when p_partkey % 11 = 0 then 43.98::double else 41.99::double end as lat, 21.43::double as lon,
  case when p_partkey % 2 = 0 then p_name end as title, case p_partkey % 5 when 0 then p_name || ' ' || (p_partkey % 90 + 1) || ', Skopje' when 1 then p_name || ' ' || (p_partkey % 90 + 2) when 2 then 'Skopje, North Macedonia'
  when 3 then 'Other Road ' || (p_partkey % 90 + 1) else '' end as address, case when p_partkey % 4 > 0 then p_partkey % 9 * 100.0::double end as sd, case when p_partkey % 3 = 0 then p_partkey % 7 * 150.0::double end as pd from part)"""


@query(f"""with a as (select *, list_filter(string_split(n, ' '), lambda t: length(t) >= 4) as tokens, trim(lower(concat_ws(' ', title, address))) as said, trim(string_split(address, ',')[1]) as line from {_ANSWERS_SQL}),
g as (select *, len(tokens) = 0 or len(list_filter(tokens, lambda t: contains(said, t))) > 0 as agree, line in ('Skopje', '') as area from a),
r as (select *, case when lat is null then 'no_evidence' when lat > 42.05 then 'outside_bbox' when said = '' then 'no_evidence' when area and not agree then 'area_level_result' when not agree then 'query_mismatch' when sd > 500 then 'street_disagreement' when pd > 500 then 'poi_disagreement' else 'ok' end as reason from g)
select id, reason = 'ok' as trusted, reason, reason = 'ok' and regexp_extract(line, '[0-9]+') = num as exact_building from r""")
def geocode_guard(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    num = lambda more: ((k % 90) + more).cast("string")
    address = [F.concat(n, F.lit(" "), num(1), F.lit(", Skopje")), F.concat(n, F.lit(" "), num(2)), F.lit("Skopje, North Macedonia"), F.concat(F.lit("Other Road "), num(1)), F.lit("")]
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("ul. "), n, F.lit(" "), num(1), F.lit(", Skopje, Severna Makedonija")).alias("query"), F.when(k % 13 == 0, None).when(k % 11 == 0, 43.98).otherwise(41.99).alias("lat"), F.lit(21.43).alias("lon"),
        F.when(k % 2 == 0, n).alias("title"), F.get(F.array(*address), (k % 5).cast("int")).alias("address"), F.when(k % 4 > 0, k % 9 * 100.0).alias("street_distance_m"), F.when(k % 3 == 0, k % 7 * 150.0).alias("poi_distance_m"),
    )
    return landmarks.assess_geocode(rows).select("id", "trusted", "reason", "exact_building")


# --- queues


@query("""with s as (select case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as source, user_id as property_id, case when event_type = 'error' then null else event_type end as reason, epoch_us(ts) // 1000 as created_at from events),
good as (select distinct * from s where reason is not null), fresh as (select * from good where created_at % 5 <> 0 or source <> 'a'),
pick as (select property_id, first(reason order by created_at, source, reason) as reason, min(created_at) as created_at from fresh group by 1),
canon as (select c_custkey as property_id, 'no_landmark' as reason, c_custkey * 1000 as created_at from customer where c_custkey % 4 = 0 and c_custkey < 100)
select property_id, reason, created_at, false as added from canon union all select property_id, reason, created_at, true from pick anti join canon using (property_id)""")
def queue_harvest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    form = F.when(F.col("event_id") % 2 == 0, ms.cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    src = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b").otherwise("c")
    sources = e.select(src.alias("source"), F.col("user_id").alias("property_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("reason"), form.alias("created_at"))
    ledger = sources.withColumn("created_at", queue.queue_timestamp(F.col("created_at"))).where("source = 'a' and created_at % 5 = 0 and reason is not null")
    canon = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0 and c_custkey < 100").select(F.col("c_custkey").alias("property_id"), F.lit("no_landmark").alias("reason"), (F.col("c_custkey") * 1000).alias("created_at"))
    return queue.harvest_queues(canon, sources, ledger)["queue"]


_DRAIN_SQL = f"""(select q.property_id, lat, lon, geo_source, m_lat, m_lon, m_trusted, m_source, case when p.id is null then 'orphan' when not (reason = 'center_mismatch' or lat is null or lon is null or coalesce(geo_source = 'osm_low_confidence', false)) then 'kept'
  when q.property_id % 10 = 3 then 'no_address' when coalesce(m_trusted and m_lat between 41.95 and 42.05 and m_lon between 21.35 and 21.50, false) then 'offline' else 'paid' end as step
  from (select distinct user_id * 11 as property_id, case when user_id % 3 = 0 then 'center_mismatch' else 'no_landmark' end as reason from events) q left join {_PROPS_SQL} p on p.id = q.property_id left join {_MAP_SQL} m on m.id = q.property_id)"""


@query(f"""select property_id, outcome, case outcome when 'offline' then m_lat when 'google' then 41.99 else lat end as lat, case outcome when 'offline' then m_lon when 'google' then 21.42 else lon end as lon, case outcome when 'offline' then m_source when 'google' then 'google_cached' else geo_source end as geo_source
  from (select *, case when step <> 'paid' then step when r > 12 then 'budget_stop' when property_id % 4 <> 1 then 'google' else 'rejected' end as outcome from (select *, row_number() over (partition by step order by property_id) as r from {_DRAIN_SQL}))""")
def queue_drain(spark, sf_dir):
    u = F.col("user_id")
    q = table(spark, sf_dir, "events").select((u * 11).alias("property_id"), F.when(u % 3 == 0, "center_mismatch").otherwise("no_landmark").alias("reason")).distinct()
    k = F.col("property_id")
    props = _props(spark, sf_dir).withColumnRenamed("id", "property_id").withColumn("address", F.when(k % 10 != 3, "ul. Nekoja 5"))
    offline = _map(spark, sf_dir).withColumnRenamed("id", "property_id")
    paid = q.select("property_id", F.lit(41.99).alias("g_lat"), F.lit(21.42).alias("g_lon"), (k % 4 != 1).alias("g_trusted"))
    return queue.drain_queue(q, props, offline, paid, searches_left=12)


_EFFECTS_SQL = f"""(select *, case when step <> 'paid' then step when r > 12 then 'budget_stop' when property_id % 4 <> 1 then 'google' else 'rejected' end as outcome,
  case when property_id % 10 <> 3 then 'ul. Nekoja ' || property_id % 6 end as address, case when property_id % 5 < 3 then 'building' else 'street' end as kind
  from (select *, row_number() over (partition by step order by property_id) as r from {_DRAIN_SQL}))"""


@query(f"""with e as (select e.*, l.landmark is not null and outcome not in ('orphan', 'no_address', 'budget_stop') as cached from {_EFFECTS_SQL} e left join (select property_id, name as landmark from {PROPERTIES_SQL} where property_id % 3 > 0) l using (property_id)),
taught as (select count(*) as n from (select distinct address, kind from e where outcome = 'google') where not (kind = 'street' and address = 'ul. Nekoja 2'))
select unnest(['processed', 'google_upgraded', 'offline_upgraded', 'landmark_cached', 'map_learned', 'geocode_rejected', 'budget_stopped', 'left_in_queue', 'patches', 'cached', 'learned', 'queue']) as name,
  unnest([count(*) filter (outcome <> 'budget_stop'), count(*) filter (outcome = 'google'), count(*) filter (outcome = 'offline'), count(*) filter (cached), any_value(n), count(*) filter (outcome = 'rejected'), count(*) filter (outcome = 'budget_stop'), count(*) filter (outcome = 'budget_stop'),
    count(*) filter (outcome in ('google', 'offline')), count(*) filter (cached), any_value(n), count(*) filter (outcome = 'budget_stop')])::bigint as n from e, taught""")
def drain_commit(spark, sf_dir):
    """The counters of a pass and how many rows each of its committed outputs has, read back from the version."""
    u, k = F.col("user_id"), F.col("property_id")
    q = table(spark, sf_dir, "events").select((u * 11).alias("property_id"), F.when(u % 3 == 0, "center_mismatch").otherwise("no_landmark").alias("reason")).distinct()
    address = F.when(k % 10 != 3, F.concat(F.lit("ul. Nekoja "), (k % 6).cast("string")))
    props = _props(spark, sf_dir).withColumnRenamed("id", "property_id").withColumn("address", address)
    paid = q.select("property_id", F.lit(41.99).alias("g_lat"), F.lit(21.42).alias("g_lon"), (k % 4 != 1).alias("g_trusted"), (k % 5 < 3).alias("g_exact"))
    ring = properties(spark, sf_dir).where(k % 3 > 0).select("property_id", F.lit(1).alias("slot"), F.col("name").alias("landmark"))
    known = props.select(F.lit("ul. Nekoja 2").alias("address"), F.lit("street").alias("kind")).distinct()
    effects = queue.drain_effects(q, props, _map(spark, sf_dir).withColumnRenamed("id", "property_id"), paid, ring, known, searches_left=12)
    at = f"{queue_folder(spark)}/drain-{tempfile.mktemp(dir='')[1:]}"
    queue.commit_drain(effects, at, 0)
    counters = mapsink.read(spark, at, "counters").select(F.explode(F.create_map(*[x for c in queue.COUNTERS for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    for name in ("patches", "cached", "learned", "queue"):
        counters = counters.unionByName(mapsink.read(spark, at, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return counters


# --- captures

@query("""with p as (select p_partkey as id, trim(p_name || case when p_partkey % 3 = 0 then '  ' else '' end) as name, p_partkey * 4294967311 as cid from part where p_partkey % 7 > 0 and p_partkey % 10 > 0)
select id, name, case when id % 4 = 0 then '0x1:0x' || lower(to_hex(id)) when id % 4 = 1 then '0x' || lower(to_hex(cid >> 32)) || ':0x' || lower(to_hex(cid & 4294967295)) when id % 4 = 2 then '0x0:0x' || lower(to_hex(id % 500)) end as place_id,
  case when id % 5 = 0 or id % 6 = 0 then 1 else 0 end as closed, case when id % 3 = 1 then null else (id % 90)::integer end as review_count, case when id % 8 = 0 then 'place' else 'mall' end as type from p""")
def capture_poi(spark, sf_dir):
    """Payloads made of parts: some without a point, some that are no JSON, ids by text, by a large and by a small number."""
    k = F.col("p_partkey")
    point = F.when(k % 7 > 0, F.struct((41.0 + k / 1e6).alias("latitude"), F.lit(21.0).alias("longitude")))
    title = F.concat(F.lit(" "), "p_name", F.when(k % 3 == 0, "  ").otherwise(""))
    cid = F.when(k % 4 == 1, k * 4294967311).when(k % 4 == 2, k % 500)
    payload = F.to_json(F.struct(
        title.alias("title"), F.when(k % 8 == 0, "").otherwise("mall").alias("type"), point.alias("gps_coordinates"), F.when(k % 4 == 0, F.concat(F.lit("0x1:0x"), F.lower(F.hex(k)))).alias("data_id"), cid.cast("string").alias("data_cid"),
        F.when(k % 3 != 1, k % 90).cast("double").alias("reviews"), (k % 5 == 0).alias("permanently_closed"), F.when(k % 6 == 0, "CLOSED_TEMPORARILY").alias("business_status"),
    ))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 10 == 0, "no json").otherwise(payload).alias("payload"))
    return capture.capture_pois(rows).select("id", "name", "place_id", "closed", "review_count", "type")


@query(f"""with old as (select place_id, name, p_lat, p_lon, case when poi_id % 2 = 0 then '' else phone end as phone from {POIS_SQL} where place_id is not null and poi_id % 9 <> 0),
new as (select place_id, 'new ' || name as name, p_lat + (poi_id % 5) * 0.001 as p_lat, p_lon, phone from {POIS_SQL} where place_id is not null),
j as (select coalesce(o.place_id, n.place_id) as place_id, o.name as on_, n.name as nn, o.p_lat as olat, n.p_lat as nlat, o.p_lon as olon, n.p_lon as nlon, o.phone as op, n.phone as np from old o full join new n on o.place_id = n.place_id),
c as (select *, case when on_ is null then 'inserted' when nn is not null and {distance_sql('olat', 'olon', 'nlat', 'nlon')} <= 300 and (olat <> nlat or olon <> nlon) then 'moved' when coalesce(op, '') = '' and coalesce(np, '') <> '' then 'filled' else 'none' end as change from j)
select place_id, coalesce(on_, nn) as name, case when change in ('inserted', 'moved') then nlat else olat end as p_lat, case when change in ('inserted', 'moved') then nlon else olon end as p_lon, coalesce(nullif(op, ''), np) as phone, change from c""")
def capture_upsert(spark, sf_dir):
    k = F.col("poi_id")
    p = pois(spark, sf_dir).where("place_id is not null")
    old = p.where(k % 9 != 0).withColumn("phone", F.when(k % 2 == 0, "").otherwise(F.col("phone")))
    new = p.select("place_id", F.concat(F.lit("new "), "name").alias("name"), (F.col("p_lat") + (k % 5) * 0.001).alias("p_lat"), "p_lon", "phone")
    return capture.capture_upsert(old, new)


@query()
def stream_queue(spark, sf_dir):
    """The keyed queue over the events, all that is there at once; its end equals a replay in memory (tests), timers included."""
    at = f"{queue_folder(spark)}/queue-{tempfile.mktemp(dir='')[1:]}"
    schema = table(spark, sf_dir, "events").schema
    session = workqueue.stream_session(spark)
    events = session.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.col("event_type")
    action = F.when(kind == "error", "put").when(kind == "signup", "put").when(kind == "purchase", "done").when(kind == "view", "fail").otherwise("other")
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), action.alias("action"), kind.alias("reason"), F.col("ts").cast("timestamp").alias("at"))
    workqueue.run_queue(rows, f"{at}/log", f"{at}/checkpoint", wait=6 * 3600.0, most=3).awaitTermination()
    log = session.read.schema(workqueue.LOG).parquet(f"{at}/log")
    return log.groupBy("key", "what").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


_PARTS = "(select p_partkey as k, p_name, lower(p_type) as kind, p_size from part)"


@query(f"""with fresh as (select 'x' || k % 300 as place_id, k as seq, p_name as name, kind as type, 41.0::double + k / 16.0::double as lat, case when k % 4 = 0 then 'u' || k end as place_url, p_size as review_count, 'p' || k as phone from {_PARTS} where k % 5 > 0),
one as (select place_id, arg_max(name, seq) as name, arg_max(type, seq) as type, arg_max(lat, seq) as lat, arg_max(place_url, seq) filter (place_url is not null) as place_url, arg_max(review_count, seq) as review_count, arg_min(phone, seq) as phone from fresh group by 1)
select coalesce(place_id, '') as place_id, name, type, lat, place_url, review_count, phone from one
union all select '', p_name, kind, 41.0::double + k / 16.0::double, null, p_size, null from {_PARTS} where k % 5 = 0""")
def map_publish(spark, sf_dir):
    """Version 1 holds places with ids in the order of their keys, version 2 a fresh extract with these behind it; a third that
    was made from the first is refused, and what a reader gets is the second."""
    at = f"{queue_folder(spark)}/map-{tempfile.mktemp(dir='')[1:]}"
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("seq"), (k % 5).alias("_f"), F.concat(F.lit("x"), (k % 300).cast("string")).alias("place_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("type"), (41.0 + k / 16.0).alias("lat"), F.lit(21.0).alias("lon"),
                    F.when(k % 4 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("place_url"), F.col("p_size").alias("review_count"), F.concat(F.lit("p"), k.cast("string")).alias("phone"))
    first = mapsink.upserted_pois(rows.where("_f > 0").drop("_f"))
    mapsink.publish({"pois": first}, at, 0)
    fresh = rows.where("_f = 0").select("name", "type", "lat", "lon", "review_count")
    mapsink.publish({"pois": mapsink.rebuilt_pois(fresh, mapsink.read(spark, at, "pois"))}, at, 1)
    with contextlib.suppress(mapsink.StaleVersion):
        mapsink.publish({"pois": fresh}, at, 1)
    return mapsink.read(spark, at, "pois").select(F.coalesce("place_id", F.lit("")).alias("place_id"), "name", "type", "lat", "place_url", "review_count", "phone")
