"""Mentions, landmark layers and spelling variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.names import _CATEGORY
from cartolex.catalog.registry import query
from cartolex.catalog.search import _NEAR
from cartolex.fixtures import POIS_SQL, PROPERTIES_SQL, distance_sql, pois, properties, table
from cartolex.functions import lexicon as L
from cartolex.functions.text import to_cyrillic
from cartolex.operators import anchors, landmarks, spatial

DETAILS = [
    (1, "Стан кај Сити Мол и спроти Воена болница. Близу до парк."), (2, "Во близина на Карпош 3, кај Капитол и Бит Пазар"), (3, "nothing is said"), (4, "Flat near City Mall and Central Park; opposite City Mall"),
    (5, "кај А"), (6, "некај Сити Мол"), (7, ""), (8, "Кај Едно. Кај Две. Кај Три. Кај Четири."),
]
_OPEN = "|".join(anchors.OPENERS)


@query(f"""with m as (select id, list_filter(list_transform(flatten(list_transform(regexp_extract_all(' ' || text, '(?i)[^\\p{{L}}\\p{{N}}](?:{_OPEN})\\s+([^.,;!?\\n]+)', 1), lambda x: regexp_split_to_array(x, '(?i)\\s+(?:и|and)\\s+'))), lambda p: trim(p)), lambda p: length(p) >= 3) as n
  from (select * from (values {", ".join(f"({i}, {S.q(t)})" for i, t in DETAILS)}) t(id, text) union all select 1000 + doc_id, text from documents)),
d as (select id, n, list_filter(range(1, len(n) + 1), lambda i: list_position(n, n[i]) = i) as keep from m)
select id, (pos - 1)::integer as pos, n[keep[pos]] as name from (select id, n, keep, unnest(range(1, least(3, len(keep)) + 1)) as pos from d)""")
def details_landmarks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return anchors.mentions(spark.createDataFrame(DETAILS, "id long, text string").unionByName(docs))


@query(f"""with ring as (select property_id, poi_name, row_number() over (partition by property_id order by stop, rank desc, d, prom desc, poi_name, poi_id) as rn from ({_NEAR}) where d <= 200),
every as (select property_id, 0 as p, 'feed ' || segment as landmark, 'feed' as layer from {PROPERTIES_SQL} where property_id % 7 = 0 union all select property_id, 1, 'cached ' || name, 'cache' from {PROPERTIES_SQL} where property_id % 5 = 0
  union all select property_id, 2, case when property_id % 2 = 0 then '' else 'told ' || name end, 'details' from {PROPERTIES_SQL} where property_id % 3 = 0 union all select property_id, 3, poi_name, 'map' from ring where rn = 1),
best as (select property_id, first(landmark order by p) as landmark, first(layer order by p) as layer from every where landmark <> '' group by 1)
select c.property_id, landmark, coalesce(layer, 'none') as layer from {PROPERTIES_SQL} c left join best b using (property_id)""")
def resolve_landmark(spark, sf_dir):
    p, k = properties(spark, sf_dir), F.col("property_id")
    layer = lambda every, text: p.where(k % every == 0).select("property_id", text.alias("landmark"))
    told = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("told "), "name"))
    ring = spatial.nearest_pois(p, pois(spark, sf_dir), 200.0, 1)
    return anchors.resolve_landmark(p, layer(7, F.concat(F.lit("feed "), "segment")), layer(5, F.concat(F.lit("cached "), "name")), layer(3, told), ring)


def _twins(spark, sf_dir):
    """Each part's name in Cyrillic, and beside it a Latin one whose second word is written backwards."""
    p = pois(spark, sf_dir)
    word = lambda i: F.get(F.split("name", " "), F.lit(i))
    cyr = p.select("poi_id", to_cyrillic(F.col("name")).alias("name"), "p_lat", "p_lon")
    lat = p.select((-F.col("poi_id") - 1).alias("poi_id"), F.concat_ws(" ", word(0), F.reverse(word(1))).alias("name"), (F.col("p_lat") + 0.0001).alias("p_lat"), "p_lon")
    return cyr.unionByName(lat)


_CANON = lambda e: f"coalesce(nullif({S.sound_key(e)}, ''), regexp_replace({S.to_latin(e)}, '[^a-z0-9]', '', 'g'))"


@query(f"""with t as (select poi_id, {S.to_cyrillic('name')} as name, p_lat, p_lon, true as cyr from {POIS_SQL}
  union all select -poi_id - 1, string_split(name, ' ')[1] || ' ' || reverse(string_split(name, ' ')[2]), p_lat + 0.0001, p_lon, false from {POIS_SQL}),
words as (select distinct unnest(string_split(name, ' ')) as z from t), keys as materialized (select z, {_CANON('z')} as k from words),
n as (select name, list(k) as keys from (select name, unnest(string_split(name, ' ')) as z from (select distinct name from t)) join keys using (z) group by name),
c as materialized (select a.*, s as s, {_CATEGORY} as cat, n.keys from (select *, name as s from t) a join n using (name)),
j as (select list_filter(list_distinct(a.keys), lambda x: not list_contains(b.keys, x)) as x, list_filter(list_distinct(b.keys), lambda x: not list_contains(a.keys, x)) as y, list_intersect(a.keys, b.keys) as shared
  from (select *, p_lat as lat, p_lon as lon from c where cyr) a join c b on not b.cyr and b.p_lat between lat - 60 / 111000.0::double and lat + 60 / 111000.0::double and b.p_lon between lon - 60 / 82000.0::double and lon + 60 / 82000.0::double
    and a.cat is not distinct from b.cat where {distance_sql('lat', 'lon', 'b.p_lat', 'b.p_lon')} <= 60)
select x[1] as word, y[1] as canonical, count(*) as support from j where len(x) = 1 and len(y) = 1 and len(shared) > 0 group by all""")
def variant_harvest(spark, sf_dir):
    return anchors.harvest_variants(_twins(spark, sf_dir))


def _mixed(spark, sf_dir):
    """Places of which a quarter are shops, some with a name of two characters."""
    k = F.col("poi_id")
    return pois(spark, sf_dir).withColumn("type", F.when(k % 4 == 0, "boutique").otherwise(F.col("type"))).withColumn("name", F.when(k % 9 == 0, F.substring("name", 1, 2)).otherwise(F.col("name")))


_MIXED = f"(select * replace (case when poi_id % 4 = 0 then 'boutique' else type end as type, case when poi_id % 9 = 0 then name[1:2] else name end as name) from {POIS_SQL})"


@query(f"""with near as materialized (select property_id, p.*, {S.type_rank('p.type')}::integer as rank, {distance_sql('c.lat', 'c.lon', 'p_lat', 'p_lon')} as d from {PROPERTIES_SQL} c join {_MIXED} p
  on p_lat between c.lat - 1000 / 111000.0::double and c.lat + 1000 / 111000.0::double and p_lon between c.lon - 1000 / 82000.0::double and c.lon + 1000 / 82000.0::double where p.type not in ('yes', 'company', 'place', 'house')),
reach as (select *, case when min(d) over w <= 150 then 150 when min(d) over w <= 400 then 400 else 1000 end as radius_m from near window w as (partition by property_id)),
top as (select * from (select *, row_number() over (partition by property_id order by type in ('bus_station', 'tram_station', 'tram_stop'), rank desc, d, case when closed = 1 then -1.0 else log10(review_count + 1.0) + case when source = 'google' then 0.01 else 0 end end desc, name, poi_id) as rn
  from reach where d <= radius_m) where rn <= 25),
kept as (select * from (select *, bool_and(type = 'boutique') over (partition by property_id) as shops from top) where (type <> 'boutique' or shops) and length(name) >= 3)
select property_id, name as landmark, type, poi_id, radius_m, floor(d + 0.5)::bigint as distance_m from (select *, row_number() over (partition by property_id order by case when rank >= {L.TYPE_RANKS['mall']} then 0 when rank >= {L.TYPE_RANKS['school']} then 1 else 2 end, rn) as best from kept) where best = 1""")
def adaptive_landmark(spark, sf_dir):
    return landmarks.adaptive_landmark(properties(spark, sf_dir), _mixed(spark, sf_dir))
