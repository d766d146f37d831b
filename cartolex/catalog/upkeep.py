"""Classes, guards, evidence, repairs, imports, audits and archives over the projected places."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.identity import _D, _DUP_SQL, _KEY, DECISIONS_SQL, _checkpointing, _duplicated, _fmt
from cartolex.catalog.keys import NAMES_SQL, RAW_KINDS_SQL, names, raw_kinds
from cartolex.catalog.registry import query
from cartolex.catalog.search import _NEAR
from cartolex.fixtures import ADDRESSES_SQL, POIS_SQL, PROPERTIES_SQL, addresses, distance_sql, pois, properties, shared_folder, table
from cartolex.functions import classes
from cartolex.functions import lexicon as L
from cartolex.functions.text import street_key, type_rank
from cartolex.operators import evidence, identity, imports, lookup, repair, spatial
from cartolex.sources import archive
from cartolex.tables import cut, dealt

_HOLDS = "case " + " ".join(f"when contains({{0}}, {S.q(k)}) then {S.q(v)}" for k, v in L.SCRAPED_TYPES.items()) + " else 'other' end"
#: Scraped types: those of captures, and each class with a word around it.
SCRAPED = ["Primary School", "Old Bridge house", "Grocery store", "Night Bar", None, "", "museum of art", "The Hotel", "Fire Station", "dentist"]
_SCRAPED_SQL = f"(select type from {RAW_KINDS_SQL} union all select unnest([{', '.join('null' if t is None else S.q(t) for t in SCRAPED)}]))"


def _map_type_sql(e: str) -> str:
    low = f"lower(coalesce({e}, ''))"
    return S.lookup(L.SCRAPED_TYPES, low, _HOLDS.format(low))


def _scraped(spark, sf_dir):
    return raw_kinds(spark, sf_dir).unionByName(spark.createDataFrame([(t,) for t in SCRAPED], "type string"))


@query(f"select type, {_map_type_sql('type')} as class, case when type <> '' then {S.lookup(L.SCRAPE_CATEGORIES, chr(40) + 'replace(lower(trim(type)), ' + S.q('_') + ', ' + S.q(' ') + ')' + chr(41), 'replace(lower(trim(type)), ' + S.q('_') + ', ' + S.q(' ') + ')')} end as category, count(*) as n from {_SCRAPED_SQL} group by 1")
def scraped_types(spark, sf_dir):
    t = F.col("type")
    return _scraped(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).select("type", classes.map_type(t).alias("class"), classes.scrape_category(t).alias("category"), "n")


_TILED = f"(select poi_id as seq, case when poi_id % 3 = 0 then upper(name) else replace(name, ' ', '  ') end as name, type from {POIS_SQL})"


@query(f"""select key, name, {_map_type_sql('type')} as type, seq from (select *, row_number() over (partition by key order by seq) as rn from (select *, regexp_replace(lower(name), '\\s+', ' ', 'g') as key from {_TILED})) where rn = 1""")
def tile_scrape(spark, sf_dir):
    k = F.col("poi_id")
    rows = pois(spark, sf_dir).select(k.alias("seq"), F.when(k % 3 == 0, F.upper("name")).otherwise(F.replace("name", F.lit(" "), F.lit("  "))).alias("name"), "type")
    return archive.first_by_name(rows)


_SAID = ["ул. Македонија 5", "кај Булевар Илинден", "факултет", "ПАТека", "пред 2 месеци", "2месеци", "во maj", "majka", "mart 8", "за недела", "Street 5", "Капитол"]
_SAID_SQL = f"(select s from {NAMES_SQL} union select unnest([{', '.join(map(S.q, _SAID))}]))"
_CLASS_SQL = "case " + " ".join(f"when regexp_matches(lower(s), {S.q(p.replace('(?=[A-Za-z0-9_])', '[A-Za-z0-9_]'))}) then {S.q(c)}" for c, p in L.NAME_CLASSES.items()) + " else 'other' end"
_STREET_SQL = f"regexp_matches(s, {S.q(f'(^|[^А-Яа-яA-Za-z])(?:{L.STREET_WORDS})($|[^А-Яа-яA-Za-z])')}, 'i')"
_TIME_SQL = f"regexp_matches(s, {S.q('пред\\s+\\d|[A-Za-z0-9_](?:' + '|'.join(L.TIME_WORDS) + ')|(^|[^A-Za-z0-9_])(?:' + '|'.join(L.MONTHS) + ')')}, 'i')"
_FLAT_SQL = f"regexp_matches(s, {S.q('(^|[^\\p{L}])(?:' + '|'.join(L.PROPERTY_WORDS) + ')($|[^\\p{L}])')}, 'i')"


@query(f"select s, {_CLASS_SQL} as class, {_STREET_SQL} as street, {_TIME_SQL} as time, {_FLAT_SQL} as flat, not {_STREET_SQL} and not {_TIME_SQL} as shown from {_SAID_SQL}")
def name_guards(spark, sf_dir):
    s = F.col("s")
    rows = names(spark, sf_dir).unionByName(spark.createDataFrame([(x,) for x in _SAID], "s string")).distinct()
    return rows.select("s", classes.name_class(s).alias("class"), classes.is_street_name(s).alias("street"), classes.is_time(s).alias("time"), classes.is_property_word(s).alias("flat"), classes.may_be_shown(s).alias("shown"))


_ENC = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"


@query(f"select c_custkey as id, regexp_replace(lower(coalesce(c_mktsegment, '') || ' | ' || c_name || '  (x)'), '\\s+', ' ', 'g') as key, 'https://www.google.com/maps/search/?api=1&query=' || {_ENC.format(chr(40) + 'c_name || ' + S.q(' & ќ (a)!~*') + chr(41))} as link from customer")
def place_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), classes.cache_key(F.col("c_mktsegment"), F.concat("c_name", F.lit("  (x)"))).alias("key"), classes.search_link(F.concat("c_name", F.lit(" & ќ (a)!~*"))).alias("link"))


_SERVE_SQL = f"""(select property_id, [null, '', 'osm_low_confidence', 'osm_poi', 'stored', 'google_verified'][property_id % 6 + 1] as tier, ['stored', 'google_cached', 'osm_building', 'osm_interpolated', 'osm_street_anchor', 'osm_low_confidence', null][property_id % 7 + 1] as geo_source from {PROPERTIES_SQL})"""


@query(f"select property_id, case when tier is null or tier in ('', 'osm_low_confidence') then false when tier = 'osm_poi' then coalesce(geo_source in ('stored', 'google_cached', 'osm_building', 'osm_interpolated', 'osm_street_anchor'), false) else true end as served from {_SERVE_SQL}")
def servable(spark, sf_dir):
    k = F.col("property_id")
    tier = F.get(F.array(*[F.lit(x) for x in (None, "", "osm_low_confidence", "osm_poi", "stored", "google_verified")]), (k % 6).cast("int"))
    source = F.get(F.array(*[F.lit(x) for x in ("stored", "google_cached", "osm_building", "osm_interpolated", "osm_street_anchor", "osm_low_confidence", None)]), (k % 7).cast("int"))
    return properties(spark, sf_dir).select("property_id", classes.can_serve(tier, source).alias("served"))


_FIRST_SQL = f"""(select poi_id, case when poi_id % 13 = 0 then 'Butik ' || name else name end as name, case when poi_id % 11 = 0 then 'gift shop' when poi_id % 17 = 0 then null else type end as type, case when poi_id % 7 <> 0 then (poi_id % 260)::double end as d from {POIS_SQL})"""
_SHOPS = ", ".join(map(S.q, L.SHOP_TYPES))


@query(f"""select poi_id, case when d is null then 'unmeasured' when d > 200 then 'far' when starts_with(name, 'Butik ') or coalesce(type in ({_SHOPS}), false) then 'shop' when {S.type_rank("coalesce(type, '')")} = 0 then 'unranked' end as problem from {_FIRST_SQL}""")
def first_landmarks(spark, sf_dir):
    k = F.col("poi_id")
    name, kind = F.when(k % 13 == 0, F.concat(F.lit("Butik "), "name")).otherwise(F.col("name")), F.when(k % 11 == 0, "gift shop").when(k % 17 != 0, F.col("type"))
    return pois(spark, sf_dir).select("poi_id", classes.first_landmark_problem(name, kind, F.when(k % 7 != 0, (k % 260).cast("double"))).alias("problem"))


FORMS = ["Пазарцето", "pazarceto", "тато", "Трговскиот!", "ab", "пазарот", "kej", "Centar", "цела"]
_ENDS = "coalesce(" + ", ".join(f"case when ends_with(w, {S.q(e)}) and length(w) - {len(e)} >= 4 then left(w, length(w) - {len(e)}) end" for e in L.DEFINITE_ENDINGS) + ")"


def _distinct_sql(e: str) -> str:
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


@query(f"""with b as (select s, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) as base from (select unnest([{', '.join(map(S.q, FORMS))}]) as s union select s from {NAMES_SQL})),
f as (select s, base, [base, regexp_replace(base, 'c([ei])', 'ch\\1', 'g'), regexp_replace(base, 'ц([еи])', 'ч\\1', 'g')] as all3 from b),
g as (select s, base, {_distinct_sql('all3')} as forms from f),
h as (select s, base, list_concat(forms, list_filter(list_transform(forms, lambda w: {_ENDS}), lambda x: x is not null)) as every from g)
select s, case when length(base) >= 3 then array_to_string({_distinct_sql('every')}, ',') else '' end as forms from h""")
def anchor_word_forms(spark, sf_dir):
    rows = names(spark, sf_dir).unionByName(spark.createDataFrame([(x,) for x in FORMS], "s string")).distinct()
    return rows.select("s", F.array_join(classes.word_forms(F.col("s")), ",").alias("forms"))


MARKETS = ["ТЦ Капитол", "Т.Ц. Бисер", "т. ц. Веро", "TC Plaza", "Трговски центар Капитол", "трговскиот центарот Мол", "Trgovski centar X", "Капитол", "тц"]


@query(f"""with m as (select s, regexp_extract(trim(s), '^(?:т\\.?\\s?ц\\.?|tc)\\s+(.+)$', 1, 'i') as a, regexp_extract(trim(s), '^(?:трговски(?:от)?\\s+центар(?:от)?|trgovski(?:ot)?\\s+centar)\\s+(.+)$', 1, 'i') as b
  from (select unnest([{', '.join(map(S.q, MARKETS))}]) as s union select s from {NAMES_SQL}))
select s, case when a <> '' then 'Трговски центар ' || a when b <> '' then 'ТЦ ' || b end as other from m""")
def market_forms(spark, sf_dir):
    rows = names(spark, sf_dir).unionByName(spark.createDataFrame([(x,) for x in MARKETS], "s string")).distinct()
    return rows.select("s", classes.market_form(F.col("s")).alias("other"))


# --- evidence


@query("""select c_custkey as id, case c_custkey % 4 when 0 then 41.5::double + c_custkey / 4096.0::double when 1 then 42.5::double end as lat, case c_custkey % 4 when 0 then 21.5::double when 1 then 21.25::double end as lon,
  case when c_custkey % 4 in (0, 1) then c_name end as title, case when c_custkey % 4 = 0 then c_mktsegment end as address from customer""")
def geocode_evidence(spark, sf_dir):
    k, at = F.col("c_custkey"), lambda lat, lon: F.struct(lat.alias("latitude"), F.lit(lon).alias("longitude"))
    place = lambda title, address, point: F.struct(title.alias("title"), address.alias("address"), point.alias("gps_coordinates"))
    nowhere = F.lit(None).cast("struct<latitude:double,longitude:double>")
    here = place(F.col("c_name"), F.col("c_mktsegment"), at(41.5 + k / 4096.0, 21.5))
    local = F.struct(F.array(here, place(F.lit("second"), F.lit(None).cast("string"), nowhere)).alias("local_results"))
    single = F.struct(F.array(F.struct(F.lit("no point").alias("title"))).alias("local_results"), F.struct(F.col("c_name").alias("title"), at(F.lit(42.5), 21.25).alias("gps_coordinates")).alias("place_results"))
    zero = F.struct(F.struct(F.col("c_name").alias("title"), at(F.lit(0.0), 21.0).alias("gps_coordinates")).alias("place_results"))
    payload = F.when(k % 4 == 0, F.to_json(local)).when(k % 4 == 1, F.to_json(single)).when(k % 4 == 2, F.to_json(zero)).otherwise("no json")
    return evidence.parse_evidence(table(spark, sf_dir, "customer").select(k.alias("id"), payload.alias("payload"))).drop("payload")


_ASKED_SQL = f"""(select property_id as id, case property_id % 4 when 0 then 'ul. Nation_' || (property_id % 30) || ' 5' when 1 then 'Bolt' when 2 then 'gear!' else 'axe' end as query, lat, lon from {PROPERTIES_SQL})"""


@query(f"""with q as (select *, {S.street_key('query')} as key, {S.norm_name('query')} as needle from {_ASKED_SQL}), a as (select lat as alat, lon as alon, {S.street_key('street')} as key from {ADDRESSES_SQL}),
s as (select id, min({distance_sql('q.lat', 'q.lon', 'alat', 'alon')}) as d from q join a on q.key = a.key and q.key <> '' group by 1),
p as (select id, min({distance_sql('q.lat', 'q.lon', 'p_lat', 'p_lon')}) as d from q join {POIS_SQL} p on length(needle) >= 4 and contains({S.norm_name('p.name')}, needle) group by 1)
select id, floor(s.d + 0.5)::bigint as street_m, floor(p.d + 0.5)::bigint as poi_m from q left join s using (id) left join p using (id)""")
def cross_distances(spark, sf_dir):
    k = F.col("property_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("ul. Nation_"), (k % 30).cast("string"), F.lit(" 5"))).when(k % 4 == 1, "Bolt").when(k % 4 == 2, "gear!").otherwise("axe")
    asked = properties(spark, sf_dir).select(k.alias("id"), text.alias("query"), "lat", "lon")
    a = addresses(spark, sf_dir).select("street", "lat", "lon").distinct()
    keys = cut(dealt(a.select("street").distinct(), "street").select("street", street_key(F.col("street")).alias("key")), "keys")
    a = a.join(keys, "street").select("key", "lat", "lon")
    out = evidence.cross_distances(asked, a, pois(spark, sf_dir))
    return out.select("id", F.floor(F.col("street_distance_m") + 0.5).alias("street_m"), F.floor(F.col("poi_distance_m") + 0.5).alias("poi_m"))


# --- identities

MISSIONS = [
    (1, "Embassy of France", 42.0, 21.40), (2, "Амбасада на Турција", 42.0, 21.41), (3, "Embassy of Turkey residence", 42.0, 21.42), (4, "Embassy of Turkey", 42.0, 21.43), (5, "Embassy of Spain", 40.0, 21.4),
    (6, "Ambasada na Germanija", 42.0, 21.44), (7, "Embassy of Montenegro", 42.0, 21.45), (8, "Embassy of Germany", 42.0, 21.46), (9, "City Mall", 42.0, 21.4),
]
_COUNTRIES_SQL = "list_distinct(list_concat(list_filter(list_distinct({0}), lambda w: w in (" + ", ".join(map(S.q, L.COUNTRIES)) + ")), " + ", ".join("case when len(list_filter({0}, lambda w: w in (" + ", ".join(map(S.q, [k, *v])) + ") and w in (" + ", ".join(map(S.q, L.COUNTRIES)) + "))) > 0 then [" + ", ".join(map(S.q, [k, *v])) + "] else [] end" for k, v in L.COUNTRY_ALIASES.items()) + "))"


def _countries_sql(e: str) -> str:
    return _COUNTRIES_SQL.replace("{0}", S.identity_tokens(e))


_NAMED_SQL = f"(select s from {NAMES_SQL} where length(s) % 7 = 0 union select unnest([{', '.join(S.q(m[1]) for m in MISSIONS)}]) union select 'Embassy of ' || unnest([{', '.join(map(S.q, L.COUNTRIES))}]))"
_MISSIONS_SQL = "(select * from (values " + ", ".join(f"({i}, {S.q(n)})" for i, n, _, _ in MISSIONS) + ") t(i, m))"


@query(f"""with a as (select s, {_countries_sql('s')} as c from (select s from {NAMES_SQL} union select 'Embassy of ' || unnest([{', '.join(map(S.q, L.COUNTRIES))}]))), b as (select i, {_countries_sql('m')} as d from {_MISSIONS_SQL})
select s, i, len(c) > 0 and len(d) > 0 and not list_has_any(c, d) as contradict from a cross join b where len(c) > 0""")
def country_contradictions(spark, sf_dir):
    every = names(spark, sf_dir).unionByName(spark.createDataFrame([("Embassy of " + c,) for c in L.COUNTRIES], "s string")).distinct()
    # countries once for each name and not again for each of the stated set. Names are written first: a filter on what follows from
    # them would go down to the scans, to every word of every text and to one task where a table is a small file
    every = cut(dealt(every, "s"), "names")
    c = repair.countries_of(F.col("s"))
    every = every.select("s", c.alias("c")).where(F.size("c") > 0)
    missions = spark.createDataFrame([(i, n) for i, n, _, _ in MISSIONS], "i int, m string").select("i", repair.countries_of(F.col("m")).alias("d"))
    return every.crossJoin(F.broadcast(missions)).select("s", "i", ((F.size("d") > 0) & ~F.arrays_overlap("c", "d")).alias("contradict"))


@query(f"""with t as (select distinct type from {RAW_KINDS_SQL}) select a.type as anchor_type, b.type as row_type, {S.type_rank('a.type')} >= 5 and {S.type_rank('b.type')} < 5 as vetoed from t a, (select unnest([{', '.join(map(S.q, L.TYPE_RANKS))}]) as type) b""")
def tenant_vetoes(spark, sf_dir):
    t = raw_kinds(spark, sf_dir).select("type").distinct()
    pairs = t.select(F.col("type").alias("anchor_type"), F.explode(F.array(*[F.lit(x) for x in L.TYPE_RANKS])).alias("row_type"))
    return pairs.withColumn("vetoed", repair.tenant_absorbs_venue(F.col("anchor_type"), F.col("row_type")))


@query()
def embassy_anchors(spark, sf_dir):
    rows = spark.createDataFrame([(i, n) for i, n, _, _ in MISSIONS], "row_id int, name string").unionByName(pois(spark, sf_dir).select((F.col("poi_id") + 100).cast("int").alias("row_id"), "name"))
    anchors = spark.createDataFrame([(i, n, a, b) for i, n, a, b in MISSIONS if i not in (2, 6)], "anchor_id int, name string, p_lat double, p_lon double")
    return repair.embassy_anchors(rows, anchors)


_MEMBERS_SQL = f"""(select poi_id // 5 * 5 as survivor_id, poi_id, case when poi_id % 5 = 0 then null else poi_id end as seq, case when poi_id % 3 = 0 then '' else phone end as phone, case when poi_id % 4 = 1 then 'w' || poi_id end as website, null::varchar as plus_code,
  case when poi_id % 2 = 0 then '$' end as price_level, type as types, case when poi_id % 7 = 0 then 'u' || poi_id end as place_url, place_id, case when poi_id % 5 in (0, 1) then 0 else review_count end as review_count, case when poi_id % 6 = 2 then poi_id / 8.0::double end as rating from {POIS_SQL})"""


def _last(c: str, some: str) -> str:
    return f"arg_max({c}, seq) filter (seq is not null and {some})"


@query(f"""select survivor_id, {', '.join(f"coalesce(nullif(max({c}) filter (seq is null), ''), {_last(c, c + " <> ''")}) as {c}" for c in repair.DONATED)},
  case when coalesce(max(review_count) filter (seq is null), 0) = 0 then coalesce({_last('review_count', 'review_count > 0')}, max(review_count) filter (seq is null)) else max(review_count) filter (seq is null) end as review_count,
  coalesce(max(rating) filter (seq is null), {_last('rating', 'rating is not null')}) as rating from {_MEMBERS_SQL} group by 1""")
def merge_donations(spark, sf_dir):
    k, none = F.col("poi_id"), F.lit(None).cast("string")
    rows = pois(spark, sf_dir).select(
        (F.floor(k / 5) * 5).alias("survivor_id"), "poi_id", F.when(k % 5 != 0, k).alias("seq"), F.when(k % 3 == 0, "").otherwise(F.col("phone")).alias("phone"), F.when(k % 4 == 1, F.concat(F.lit("w"), k.cast("string"))).alias("website"), none.alias("plus_code"),
        F.when(k % 2 == 0, "$").alias("price_level"), F.col("type").alias("types"), F.when(k % 7 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("place_url"), "place_id", F.when((k % 5).isin(0, 1), 0).otherwise(F.col("review_count")).alias("review_count"), F.when(k % 6 == 2, k / 8.0).alias("rating"),
    )
    return repair.donations(rows)


@query(f"""with recursive d as materialized (select a_id, b_id, rule from {DECISIONS_SQL} where merge), link as materialized (select a_id as a, b_id as b from d union select b_id, a_id from d),
reach(x, y) as (select a, b from link union select r.x, l.b from reach r join link l on r.y = l.a),
lab as (select x as id, least(x, min(y)) as label from reach group by x),
best as (select label, first(id order by k desc) as survivor_id from (select lab.id, label, {_fmt(_KEY, p='p')} as k from lab join {POIS_SQL} p on p.poi_id = lab.id) group by label),
why as (select label, string_agg(distinct rule, ',' order by rule) as reasons from d join lab on a_id = id group by label)
select survivor_id, reasons from best join why using (label)""")
def component_reasons(spark, sf_dir):
    _checkpointing(spark)
    return repair.component_reasons(pois(spark, sf_dir))


_FUSED_SQL = f"""(select * replace (case when poi_id % 8 = 0 then 'Embassy of France' when poi_id % 8 = 3 then 'Амбасада на Кина' else name end as name), case when poi_id % 4 <> 1 then 'node/' || (poi_id // 2) end as osm_key from
  (select * replace (coalesce(place_id, case when poi_id % 6 = 1 then '0x1:0x' || lower(to_hex(poi_id // 6)) end) as place_id) from {_DUP_SQL}))"""


@query(f"""with p as (select *, {_countries_sql('name')} as c from {_FUSED_SQL}), a as (select place_id, arg_min(c, poi_id) as d from p where source = 'google' and place_id is not null group by 1),
s as (select poi_id, source, osm_key, place_id as was, source = 'osm' and coalesce(len(c) > 0 and len(d) > 0 and not list_has_any(c, d), false) as stripped from p left join a using (place_id)),
t as (select *, case when not stripped then was end as place_id from s), one as (select * from (select *, row_number() over (partition by source, place_id order by poi_id) as n from t) where n = 1 or place_id is null),
two as (select * from (select * exclude (n), row_number() over (partition by source, osm_key order by poi_id) as m from one) where m = 1 or osm_key is null)
select poi_id, place_id, stripped from two""")
def repair_fusions(spark, sf_dir):
    k = F.col("poi_id")
    p = _duplicated(spark, sf_dir).withColumn("place_id", F.coalesce("place_id", F.when(k % 6 == 1, F.concat(F.lit("0x1:0x"), F.lower(F.hex(F.floor(k / 6)))))))
    p = p.withColumn("name", F.when(k % 8 == 0, "Embassy of France").when(k % 8 == 3, "Амбасада на Кина").otherwise(F.col("name"))).withColumn("osm_key", F.when(k % 4 != 1, F.concat(F.lit("node/"), F.floor(k / 2).cast("string"))))
    return repair.repair_fusions(p)


# --- imports, teaching, rosters, audits

_RESOLVED_SQL = f"(select property_id, lat, lon, case when property_id % 3 = 0 then 'osm_building' else 'osm_interpolated' end as source, property_id % 5 <> 0 as trusted from {PROPERTIES_SQL} where property_id % 7 <> 0)"


@query(f"""with near as (select distinct property_id from ({_NEAR}) where d <= 200)
select c.property_id, case when c.property_id % 11 <> 0 then r.lat end as lat, case when c.property_id % 11 <> 0 then r.lon end as lon, case when c.property_id % 11 <> 0 and coalesce(trusted, false) then r.source else 'osm_low_confidence' end as geo_source,
  c.property_id % 11 <> 0 and coalesce(trusted, false) and n.property_id is not null as cached, case when c.property_id % 11 = 0 or not coalesce(trusted, false) then 'no_trusted_center' when n.property_id is null then 'no_landmark' end as queue
from {PROPERTIES_SQL} c left join {_RESOLVED_SQL} r using (property_id) left join near n using (property_id)""")
def import_geo(spark, sf_dir):
    p, k = properties(spark, sf_dir), F.col("property_id")
    resolved = p.where(k % 7 != 0).select("property_id", "lat", "lon", F.when(k % 3 == 0, "osm_building").otherwise("osm_interpolated").alias("source"), (k % 5 != 0).alias("trusted"))
    rows = p.select("property_id", F.when(k % 11 != 0, F.col("name")).alias("address"))
    return imports.import_geo(rows, resolved, spatial.nearest_pois(p, pois(spark, sf_dir), 200.0, 1))


_TAUGHT_SQL = "(select s_suppkey as pos, s_name as street, s_suppkey % 3 + 1 as cost, s_suppkey % 6 in (0, 1, 2) as trusted, case when s_suppkey % 4 = 0 then 50.0::double else 42.0::double end as lat, s_suppkey % 5 <> 0 as answered from supplier)"


@query(f"""with t as (select *, sum(cost) over (order by pos) as spent, max(pos) over () as top from {_TAUGHT_SQL}), s as (select *, case when spent > 150 then 'cap' when 100 - (spent - cost) < 20 then 'budget' end as stop from t), f as (select min(pos) as halt, arg_min(stop, pos) as why from s where stop is not null)
select pos, street, case when pos >= halt then why when not answered then 'miss' when lat > 42.05 then 'outside' when trusted then 'taught' else 'miss' end as outcome from s cross join f""")
def street_teach(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    plan = rows.select(k.alias("pos"), F.col("s_name").alias("street"), (k % 3 + 1).alias("cost"))
    answers = rows.where(k % 5 != 0).select(k.alias("pos"), F.when(k % 4 == 0, 50.0).otherwise(42.0).alias("lat"), F.lit(21.4).alias("lon"), (k % 6).isin(0, 1, 2).alias("trusted"), F.lit(False).alias("limited"))
    return imports.teach_streets(plan, answers, cap=150, budget=100, floor=20)


_ROSTER_SQL = f"""(select property_id, pos, case pos when 0 then 'red bolt' when 1 then ' Butik X ' when 2 then 'Own ' || property_id when 3 then 'OWN ' || property_id else 'no such place' end as name, case when pos = 1 then 'boutique' else 'mall' end as type,
  case when pos in (2, 3) then 'https://maps.google.com/?q=' || round(lat::decimal(18, 10) + 0.001, 6) || ',' || round(lon::decimal(18, 10), 6) when pos = 1 then 'https://maps.google.com/?q=' || round(lat::decimal(18, 10), 6) || ',' || round(lon::decimal(18, 10), 6) end as url, lat, lon
  from {PROPERTIES_SQL}, (select unnest([0, 1, 2, 3, 4]) as pos))"""


@query()
def roster_slots(spark, sf_dir):
    p = properties(spark, sf_dir)
    at = lambda dlat: F.format_string("https://maps.google.com/?q=%.6f,%.6f", F.col("lat") + dlat, F.col("lon"))
    entry = lambda pos, name, kind, url: F.struct(F.lit(pos).alias("pos"), name.alias("name"), F.lit(kind).alias("type"), url.alias("url"))
    k, none = F.col("property_id").cast("string"), F.lit(None).cast("string")
    every = F.array(entry(0, F.lit("red bolt"), "mall", none), entry(1, F.lit(" Butik X "), "boutique", at(0.0)), entry(2, F.concat(F.lit("Own "), k), "mall", at(0.001)), entry(3, F.concat(F.lit("OWN "), k), "mall", at(0.001)), entry(4, F.lit("no such place"), "mall", none))
    entries = p.select("property_id", F.explode(every).alias("e")).select("property_id", "e.*")
    malls = pois(spark, sf_dir).where("type = 'mall'").select("poi_id", "name", "p_lat", "p_lon")
    return imports.roster_slots(entries, p.select("property_id", "lat", "lon"), pois(spark, sf_dir).select("name", "p_lat", "p_lon"), malls)


@query(f"""select property_id, rn::integer as rn, name from (select poi_id // 6 as property_id, name, row_number() over (partition by poi_id // 6 order by case when {S.type_rank('type')} >= 5 then 0 else 1 end, case when poi_id % 5 <> 0 then poi_id * 37 % 500 end nulls last, name) as rn
  from (select poi_id, name || poi_id as name, type from {POIS_SQL})) where rn <= 3""")
def feed_ranking(spark, sf_dir):
    k = F.col("poi_id")
    return imports.rank_feed(pois(spark, sf_dir).select(F.floor(k / 6).alias("property_id"), F.concat("name", k.cast("string")).alias("name"), "type", F.when(k % 5 != 0, k * 37 % 500).alias("distance_m")))


@query(f"""with t as (select {S.norm_type('type')} as kind, count(*) as n from {RAW_KINDS_SQL} group by 1), c as (select distinct {S.lookup(L.TYPE_ALIASES, 'kind', 'kind')} as kind from t)
select 'unranked ' || case when regexp_matches(kind, {S.q(L.PAID_SCHOOLS)}) then 'paid' else 'public' end as problem, kind, n from t where {S.type_rank('kind')} = 0 and regexp_matches(kind, {S.q(L.PUBLIC_ROOTS)})
union all select 'missing', kind, 0 from (select unnest([{', '.join(map(S.q, L.REQUIRED_CLASSES))}]) as kind) anti join c using (kind)""")
def type_problems(spark, sf_dir):
    return imports.type_problems(raw_kinds(spark, sf_dir))


_SAMPLE_SQL = f"(select poi_id from (select poi_id, row_number() over (partition by type order by poi_id) as n3 from {POIS_SQL} where {S.type_rank('type')} >= 4) where n3 <= 3)"


@query(f"""with near as (select s.poi_id as sample_id, p.poi_id, p.name, p.place_id, s.name as own, s.place_id as oid, {_D} as d, row_number() over (partition by s.poi_id order by p.type in ('bus_station', 'tram_station', 'tram_stop'), {S.type_rank('p.type')} desc, {_D}, case when p.closed = 1 then -1.0 else log10(p.review_count + 1.0) + case when p.source = 'google' then 0.01 else 0 end end desc, p.name, p.poi_id) as rn
  from (select * from {POIS_SQL} where poi_id in {_SAMPLE_SQL}) s join (select * from {POIS_SQL} where type not in ('yes', 'company', 'place', 'house')) p on p.p_lat between s.p_lat - 0.004 and s.p_lat + 0.004 and {_D} <= 250)
select s.poi_id, coalesce(bool_or(oid = near.place_id or own = near.name or floor(d + 0.5) <= 10) filter (rn <= 60), false) as served from {_SAMPLE_SQL} s left join near on sample_id = s.poi_id group by 1""".replace(_D, distance_sql("s.p_lat", "s.p_lon", "p.p_lat", "p.p_lon")))
def reachable_places(spark, sf_dir):
    from pyspark.sql.window import Window

    p = pois(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("type").orderBy("poi_id"))
    return imports.reachable(p.where(type_rank(F.col("type")) >= 4).withColumn("n3", first).where("n3 <= 3"), p)


# --- archives


@query("select p_partkey::varchar as p_partkey, p_name, null::varchar as website, null::double as rating, p_size::bigint as p_size from part")
def tolerant_scan(spark, sf_dir):
    return archive.tolerant(table(spark, sf_dir, "part"), {"p_partkey": "string", "p_name": "string", "website": "string", "rating": "double", "p_size": "bigint"})


VARIANTS = '{"variants": [{"word": "Bolt", "canonical": "screw", "reviewed": true}, {"word": "gear", "canonical": "cog", "reviewed": false}, {"word": "bolt", "canonical": "stud", "reviewed": true}, {"word": null, "canonical": "x", "reviewed": true}]}'


@query(f"select distinct w as word, coalesce(nullif({S.sound_key('x')}, ''), regexp_replace({S.to_latin('x')}, '[^a-z0-9]', '', 'g')) as key from (select w, case when lower(w) = 'bolt' then 'screw' else w end as x from (select s as w from {NAMES_SQL} union select split_part(p_name, ' ', 2) from part))")
def variant_keys(spark, sf_dir):
    words = names(spark, sf_dir).unionByName(table(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("s"))).distinct().select(F.col("s").alias("word"))
    return archive.variant_keys(words, archive.read_variants(spark.createDataFrame([(VARIANTS,)], "json string")))


_OLD_NEW = f"""(select *, 0 as o from (select * replace ('old ' || name as name), case when poi_id % 4 = 0 then 'https://maps.google.com/?q=' || poi_id end as u from {_DUP_SQL} where poi_id % 2 = 0) union all select *, 1 from (select *, case when poi_id % 8 = 3 then 'n' || poi_id end as u from {_DUP_SQL} where poi_id % 2 = 1))"""


@query(f"""select place_id, arg_max(name, k) as name, arg_max(type, k) as type, arg_max(p_lat, k) as p_lat, arg_max(p_lon, k) as p_lon, arg_max(source, k) as source, arg_max(review_count, k) as review_count, arg_max(closed, k) as closed,
  arg_max(u, k) filter (u is not null) as place_url, arg_min(phone, k) as phone, count(*) as n from (select *, o * 100000000 + poi_id as k from {_OLD_NEW}) where place_id is not null group by 1""")
def carry_through(spark, sf_dir):
    k = F.col("poi_id")
    rows = _duplicated(spark, sf_dir).withColumn("seq", k)
    old = rows.where(k % 2 == 0).withColumn("name", F.concat(F.lit("old "), "name")).withColumn("place_url", F.when(k % 4 == 0, F.concat(F.lit("https://maps.google.com/?q="), k.cast("string"))))
    new = rows.where(k % 2 == 1).withColumn("place_url", F.when(k % 8 == 3, F.concat(F.lit("n"), k.cast("string"))))
    return archive.carry_through(old, new)


@query("select s_suppkey as id, s_name, s_nationkey, s_suppkey % 2 = 0 as even, case when s_suppkey % 3 = 0 then 'kept' else 'restored' end as origin from supplier")
def backup_restore(spark, sf_dir):
    k = F.col("id")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", "s_nationkey").withColumn("even", k % 2 == 0)
    at = archive.backup(s.where(k % 3 != 0).withColumn("origin", F.lit("restored")), f"{shared_folder(spark)}/cartolex-backups")
    return archive.restore(spark, at, "id long, s_name string, s_nationkey long, even boolean, origin string", s.withColumn("origin", F.lit("kept")).select("id", "s_name", "s_nationkey", "even", "origin"))


@query("""with l as (select o_orderkey as k, concat_ws('|', coalesce(o_orderkey::varchar, ''), coalesce(o_custkey::varchar, ''), coalesce(o_orderstatus, '')) as l from orders), p as (select k // 65536 as p, count(*) as n, sha256(string_agg(l, chr(10) order by k)) as d from l group by 1)
select sum(n)::bigint as n, sha256(string_agg(d, chr(10) order by p)) as digest from p""")
def table_stamp(spark, sf_dir):
    return archive.stamp(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(f"select poi_id, name from (select *, case when poi_id % 4 = 0 then 'u' when poi_id % 4 = 1 then '' end as url from {POIS_SQL}) where place_id is not null and coalesce(url, '') = '' order by name, poi_id limit 50")
def rows_without_url(spark, sf_dir):
    k = F.col("poi_id")
    return archive.without_url(pois(spark, sf_dir).withColumn("place_url", F.when(k % 4 == 0, "u").when(k % 4 == 1, "")), 50)


# --- lookups around a centre


@query()
def find_anchors(spark, sf_dir):
    k = F.col("property_id")
    word = F.get(F.array(*[F.lit(w) for w in ("red bolt", "gearot", "Aнвил", "anvilte", "zzz")]), (k % 5).cast("int"))
    return lookup.find_anchors(properties(spark, sf_dir).select(k.alias("word_id"), word.alias("word"), "lat", "lon"), pois(spark, sf_dir))


_ASK = ["bolt", "red bolt", "Anvil", "zzz"]
_PH = S.phonetic_keys


@query(f"""with q as (select property_id as needle_id, [{', '.join(map(S.q, _ASK))}][property_id % 4 + 1] as text, lat, lon from {PROPERTIES_SQL}), n as (select needle_id, lat, lon, {_PH('text')} as q from q),
a as (select poi_id, name, p_lat, p_lon, {_PH('name')} as r from {POIS_SQL} where type = 'park')
select needle_id, poi_id, name from (select needle_id, poi_id, name, row_number() over (partition by needle_id order by len(list_filter(r, lambda w: not list_contains(q, w))), case when q = r then 0 else 1 end, {distance_sql('lat', 'lon', 'p_lat', 'p_lon')}, length(name), name, poi_id) as rn
  from n join a on list_has_all(r, q)) where rn = 1""")
def settlements_named(spark, sf_dir):
    k = F.col("property_id")
    text = F.get(F.array(*[F.lit(w) for w in _ASK]), (k % 4).cast("int"))
    needles = properties(spark, sf_dir).select(k.alias("needle_id"), text.alias("text"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"))
    return lookup.settlements_named(needles, pois(spark, sf_dir).where("type = 'park'").select("poi_id", "name", "p_lat", "p_lon"))
