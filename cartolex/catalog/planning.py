"""Coverage, census, geocoding, gates and verification over the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.registry import query
from cartolex.fixtures import ADDRESSES_SQL, POIS_SQL, addresses, pois, table
from cartolex.functions.text import house_number, street_key
from cartolex.operators import geocode
from cartolex.plans import coverage

CATEGORIES = ["mall", "pharmacy", "cafe", "school", "bus_station", "park", "market", "hotel"]
_TILES = "(select printf('%.2f,%.2f', 41.96 + r * 0.01, 21.36 + c * 0.01) as tile_key from (select unnest(range(9)) as r) cross join (select unnest(range(15)) as c))"
_SEED = f"""(select printf('%.2f,%.2f', 41.96 + r * 0.01, 21.36 + c * 0.01) as tile_key, type as category, count(*) as n from (
  select type, floor((p_lat - 41.96) / 0.01 + 1e-9) as r, floor((p_lon - 21.36) / 0.01 + 1e-9) as c from {POIS_SQL} where poi_id % 3 = 0) where r between 0 and 8 and c between 0 and 14 group by all)"""
_OPEN = f"(select tile_key, category from {_TILES} cross join (select unnest([{', '.join(map(S.q, CATEGORIES))}]) as category) anti join {_SEED} using (tile_key, category))"


def _seed(spark, sf_dir):
    return coverage.seed_scans(pois(spark, sf_dir).where("poi_id % 3 = 0"))


@query(f"select tile_key, category, n from {_SEED}")
def tile_seed(spark, sf_dir):
    return _seed(spark, sf_dir)


@query(f"select tile_key, category from {_OPEN}")
def uncovered_pairs(spark, sf_dir):
    return coverage.uncovered_pairs(spark, CATEGORIES, _seed(spark, sf_dir))


@query(f"select 1080::bigint as total, 1080 - count(*) as scanned, count(*) as uncovered_pairs, count(distinct tile_key) as uncovered_tiles from {_OPEN}")
def coverage_plan(spark, sf_dir):
    return coverage.coverage_plan(spark, CATEGORIES, _seed(spark, sf_dir))


@query("""select tile_key, event_type as category, count(*) + max(s)::bigint as scans, greatest(max(ts), timestamp '2020-01-01') as last_scan from (
  select printf('%.2f,%.2f', 41.96 + (user_id % 9) * 0.01, 21.36 + (user_id % 15) * 0.01) as tile_key, event_type, ts, case when user_id % 2 = 0 then 1 else 0 end as s from events) group by all""")
def scan_ledger(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.format_string("%.2f,%.2f", 41.96 + (u % 9) * 0.01, 21.36 + (u % 15) * 0.01).alias("tile_key"), F.col("event_type").alias("category"), F.col("ts").alias("at"), u.alias("user_id"))
    old = e.where("user_id % 2 = 0").select("tile_key", "category").distinct().select("tile_key", "category", F.lit(1).cast("long").alias("scans"), F.lit("2020-01-01 00:00:00").cast(e.schema["at"].dataType).alias("last_scan"))
    return coverage.record_scans(old, e)


# --- streets

_CENSUS_SQL = f"""(with s as (
    select 'ul. ' || upper(n_name[1:1]) || lower(n_name[2:]) as text, 'map' as origin, n_nationkey::bigint as seq from nation where n_nationkey % 3 <> 0
    union all select 'ul. ' || upper(n_name[1:1]) || lower(n_name[2:]) || ' ' || (c_custkey % 17), 'feed', 1000 + c_custkey from customer join nation on c_nationkey = n_nationkey
    union all select 'Bulevar ' || r_name, 'osm', 100000000 + r_regionkey from region),
  p as (select trim(regexp_replace(trim(text), '\\s+\\d+(?:[\\s.\\-/]*(?:\\d+|[а-яa-z]+))*\\s*$', '', 'i')) as name, origin, seq, regexp_extract(text, '\\b(\\d+[a-zа-я]?)\\b', 1) as num from s),
  k as (select *, {S.street_key('name')} as key from p where length(name) >= 3),
  nums as (select key, list(num order by n desc, num::bigint, num) as numbers from (select key, num, count(*) as n from k where origin = 'feed' and num <> '' group by all) group by key),
  head as (select key, first(name order by (case when origin = 'map' then 0 else 1 end), (case when origin = 'map' then -seq else seq end)) as display, list_sort(list(distinct origin)) as origins from k where length(key) >= 3 group by key),
  known as (select {S.street_key("'ul. ' || upper(n_name[1:1]) || lower(n_name[2:])")} as key, n_nationkey::bigint % 4 as numbered from nation where n_nationkey % 3 <> 0)
  select h.key, display, origins, case when numbered < 2 and numbers is not null then numbers else []::varchar[] end as numbers, coalesce(numbered, 0) as map_numbers,
    case when numbered is null then 'unknown' when numbered < 2 and numbers is not null then 'thin' else 'known' end as class
  from head h left join nums using (key) left join known using (key))"""


def _census(spark, sf_dir):
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    street = F.concat(F.lit("ul. "), F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    own = n.where("n_nationkey % 3 <> 0").select(street.alias("text"), F.lit("map").alias("origin"), F.col("n_nationkey").cast("long").alias("seq"))
    feed = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.concat(street, F.lit(" "), (F.col("c_custkey") % 17).cast("string")).alias("text"), F.lit("feed").alias("origin"), (1000 + F.col("c_custkey")).alias("seq"))
    osm = r.select(F.concat(F.lit("Bulevar "), "r_name").alias("text"), F.lit("osm").alias("origin"), (100000000 + F.col("r_regionkey")).cast("long").alias("seq"))
    known = n.where("n_nationkey % 3 <> 0").select(street_key(street).alias("key"), (F.col("n_nationkey") % 4).cast("long").alias("numbered"))
    return coverage.census(own.unionByName(feed).unionByName(osm), known)


@query(f"select key, display, array_to_string(origins, ',') as origins, array_to_string(numbers, ',') as numbers, map_numbers, class from {_CENSUS_SQL}")
def street_census(spark, sf_dir):
    return _census(spark, sf_dir).select("key", "display", F.array_join("origins", ",").alias("origins"), F.array_join("numbers", ",").alias("numbers"), "map_numbers", "class")


@query(f"""select count(*) filter (class = 'known') as known, count(*) filter (class = 'thin') as thin, sum(case when class = 'thin' then len(numbers) else 0 end)::bigint as thin_numbers, count(*) filter (class = 'unknown') as unknown,
  (sum(case when class = 'thin' then len(numbers) else 0 end) + count(*) filter (class = 'unknown'))::bigint as searches from {_CENSUS_SQL}""")
def census_projection(spark, sf_dir):
    return coverage.census_projection(_census(spark, sf_dir))


@query(f"""select pos::integer as pos, key, display as street, class, array_to_string(numbers[1:greatest(0, 25 - spent)], ',') as numbers from (
  select *, row_number() over o as pos, sum(cost) over (o rows unbounded preceding) - cost as spent from (
    select *, (case when class = 'unknown' then 0 else 1000 end) + case when list_has_any(origins, ['feed', 'osm']) then 0 else 500 end as rank, case when class = 'unknown' then 1 else len(numbers) end as cost from {_CENSUS_SQL} where class <> 'known')
  window o as (order by rank, display, key)) where spent < 25""")
def teach_plan(spark, sf_dir):
    return coverage.teach_plan(_census(spark, sf_dir), cap=25).select("pos", "key", "street", "class", F.array_join("numbers", ",").alias("numbers"))


# --- geocoding

_ASKED_SQL = """(select s_suppkey as id, case s_suppkey % 5 when 0 then 'ul. ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')
  when 1 then array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' ' || (s_suppkey % 60) when 2 then upper(n_name) || ' ' || (s_suppkey % 9) || 'a'
  when 3 then n_name || 'x ' || (s_suppkey % 40) else 'Nowhere ' || s_suppkey end as address from supplier join nation on s_nationkey = n_nationkey)"""


def _asked(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k, cap = F.col("s_suppkey"), F.initcap("n_name")
    text = F.when(k % 5 == 0, F.concat(F.lit("ul. "), cap)).when(k % 5 == 1, F.concat(cap, F.lit(" "), (k % 60).cast("string"))).when(k % 5 == 2, F.concat(F.upper("n_name"), F.lit(" "), (k % 9).cast("string"), F.lit("a")))
    text = text.when(k % 5 == 3, F.concat("n_name", F.lit("x "), (k % 40).cast("string"))).otherwise(F.concat(F.lit("Nowhere "), k.cast("string")))
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(k.alias("id"), text.alias("address"))


_VALUE = "case when regexp_matches({0}, '^\\d') then regexp_extract({0}, '^\\d+')::double + case when regexp_matches({0}, '^\\d+[a-zа-я]$', 'i') then 0.5 else 0 end end".format
_KEYS_SQL = f"""q as (select id, address, {S.street_key('address')} as raw_key, regexp_extract(address, '\\b(\\d+[a-zа-яA-ZА-Я]?)\\b', 1) as num from {_ASKED_SQL}),
a as (select *, {S.street_key('street')} as key, {_VALUE('housenumber')} as v from {ADDRESSES_SQL}),
keys as (select distinct key from a),
fuzzy as (select raw_key, any_value(key) as key from (select distinct raw_key from q where raw_key not in (select key from keys) and length(raw_key) >= 6) m join keys on levenshtein(raw_key, key) <= 1 group by 1 having count(*) = 1),
k as (select q.*, coalesce(f.key, q.raw_key) as key, {_VALUE('num')} as target from q left join fuzzy f using (raw_key))"""


@query(f"with {_KEYS_SQL} select id, address, raw_key, key from k")
def fuzzy_street(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("raw_key", street_key(F.col("address")))
    keys = addresses(spark, sf_dir).select(street_key(F.col("street")).alias("key")).distinct()
    return geocode.resolve_keys(asked, keys).select("id", "address", "raw_key", "key")


@query(f"""with {_KEYS_SQL},
j as (select k.id, k.num, k.target, a.* exclude (key), housenumber not in ('', 'ББ') and v is not null and num <> '' as fits from k join a on k.key = a.key),
g as (select id, any_value(target) as target,
  first(struct_pack(lat := lat, lon := lon) order by (case when housenumber = num then 0 else 1 end), addr_id) filter (num <> '' and lower(housenumber) = lower(num)) as e,
  first(struct_pack(lat := lat, lon := lon) order by length(housenumber), addr_id) filter (num <> '' and contains(lower(housenumber), lower(num))) as c,
  first(struct_pack(v := v, lat := lat, lon := lon) order by v desc, housenumber desc, addr_id desc) filter (fits and v <= target) as lo,
  first(struct_pack(v := v, lat := lat, lon := lon) order by v desc, housenumber desc, addr_id desc) filter (fits and v > target) as hi,
  count(*) filter (housenumber not in ('', 'ББ') and num <> '') as n,
  first(struct_pack(lat := lat, lon := lon) order by addr_id) filter (housenumber in ('', 'ББ')) as s,
  first(struct_pack(lat := lat, lon := lon) order by housenumber, addr_id) as f from j group by id),
r as (select id, case when e is not null then struct_pack(lat := e.lat, lon := e.lon, ok := true, src := 'osm_building') when c is not null then struct_pack(lat := c.lat, lon := c.lon, ok := true, src := 'osm_building')
  when n >= 2 and lo is not null and hi is not null then struct_pack(lat := lo.lat + (target - lo.v) / (hi.v - lo.v) * (hi.lat - lo.lat), lon := lo.lon + (target - lo.v) / (hi.v - lo.v) * (hi.lon - lo.lon), ok := true, src := 'osm_interpolated')
  when n >= 2 and (lo is not null or hi is not null) then struct_pack(lat := coalesce(lo.lat, hi.lat), lon := coalesce(lo.lon, hi.lon), ok := false, src := 'osm_low_confidence')
  when s is not null then struct_pack(lat := s.lat, lon := s.lon, ok := false, src := 'osm_low_confidence') else struct_pack(lat := f.lat, lon := f.lon, ok := false, src := 'osm_low_confidence') end as b from g)
select k.id, round(b.lat, 7) as lat, round(b.lon, 7) as lon, coalesce(b.ok, false) as trusted, coalesce(b.src, 'osm_low_confidence') as source from k left join r using (id)""")
def geocode_resolve(spark, sf_dir):
    a = addresses(spark, sf_dir).withColumn("key", street_key(F.col("street")))
    got = geocode.resolve_addresses(_asked(spark, sf_dir), a)
    return got.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "trusted", "source")


# --- gates


@query(f"""select count(*) as pois, (select count(*) from (select place_id from {POIS_SQL} where place_id is not null group by 1 having count(*) > 1)) as duplicate_ids, count(*) filter (not (p_lat between 41.95 and 42.05 and p_lon between 21.35 and 21.50)) as outside,
  (select count(*) from {_OPEN}) as open_pairs, case when count(*) < 1000 then 'too few places' else '' end as violations, case when (select count(*) from {_OPEN}) > 0 then 'coverage open' else '' end as warnings from {POIS_SQL}""")
def run_verify(spark, sf_dir):
    return coverage.verify_map(pois(spark, sf_dir), coverage.uncovered_pairs(spark, CATEGORIES, _seed(spark, sf_dir)))


@query("""with g as (select s_suppkey as id, (s_suppkey * 37 % 3000)::integer as estimated, case when s_suppkey % 4 = 0 then null else (s_suppkey * 53 % 2600)::integer end as live, s_suppkey % 4 <> 0 and s_suppkey % 5 <> 0 as probe_ok,
  (s_nationkey % 10)::integer as keys, (s_suppkey % 3 * 100)::integer as floor from supplier)
select *, case when probe_ok then live else keys * 250 end as budget, case when probe_ok then 'live' else 'nominal' end as basis, estimated <= (case when probe_ok then live else keys * 250 end) - floor as go from g""")
def spend_gate(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k * 37 % 3000).cast("int").alias("estimated"), F.when(k % 4 != 0, (k * 53 % 2600).cast("int")).alias("live"), ((k % 4 != 0) & (k % 5 != 0)).alias("probe_ok"),
        (F.col("s_nationkey") % 10).cast("int").alias("keys"), (k % 3 * 100).cast("int").alias("floor"),
    )
    return coverage.spend_gate(asked)


@query("select o_orderstatus as status, o_orderpriority as priority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus::varchar <> 'P' group by all")
def rest_query_counts(spark, sf_dir):
    from cartolex.sources.rest import rest_query

    rows = rest_query(table(spark, sf_dir, "orders"), {"select": "o_orderstatus,o_orderpriority", "o_orderpriority": "in.(1-URGENT,2-HIGH)", "o_orderstatus": "neq.P"})
    return rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderstatus from orders where (o_orderstatus = 'F' or o_orderkey::varchar like '1%') order by o_orderkey::varchar desc limit 50 offset 5")
def rest_query(spark, sf_dir):
    from cartolex.sources.rest import rest_query as run

    return run(table(spark, sf_dir, "orders"), {"select": "o_orderkey,o_orderstatus", "or": "(o_orderstatus.eq.F,o_orderkey.like.1*)", "order": "o_orderkey.desc", "limit": "50", "offset": "5"})
