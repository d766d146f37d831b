"""Suspect pairs, merges, twins, upserts and links over the projected places."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.registry import query
from cartolex.fixtures import POIS_SQL, distance_sql, pois, shared_folder, table
from cartolex.functions import geo
from cartolex.functions import lexicon as L
from cartolex.operators import heal, identity

_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
_D = distance_sql("a.p_lat", "a.p_lon", "b.p_lat", "b.p_lon")

SUSPECTS_SQL = f"""(select a_id, b_id, a_name, b_name, kind, distance_m from (
  select *, row_number() over (partition by least(a_name, b_name), greatest(a_name, b_name), la, lb order by a_id, b_id) as n from (
    select a_id, b_id, a_name, b_name, distance_m, la, lb, case when ap = bp and pa <> pb then 'same-place_id-different-name' when pa = pb and distance_m > 50 then 'same-name-drifted'
      when aph = bph and aph <> '' and pa <> pb and distance_m > 50 then 'same-phone' when ap <> bp and distance_m < 30 and (contains(pa, pb) or contains(pb, pa)) then 'dual-identified-near' end as kind
    from (select a.poi_id as a_id, b.poi_id as b_id, a.name as a_name, b.name as b_name, a.place_id as ap, b.place_id as bp, a.phone as aph, b.phone as bph, {_PLAIN('a.name')} as pa, {_PLAIN('b.name')} as pb,
        floor(a.p_lat * 400 + 0.5) as la, floor(b.p_lat * 400 + 0.5) as lb, floor({_D} + 0.5)::bigint as distance_m
      from {POIS_SQL} a join {POIS_SQL} b on floor(a.p_lat * 400 + 0.5) = floor(b.p_lat * 400 + 0.5) and floor(a.p_lon * 260 + 0.5) = floor(b.p_lon * 260 + 0.5) and a.poi_id < b.poi_id))
  where kind is not null) where n = 1)"""
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')".format
_DESC = ", ".join(map(S.q, L.DESCRIPTORS))
_KEY = "[coalesce({p}.review_count, 0), case when {p}.place_id is null then 0 else 1 end, -len(list_filter(" + _TOKENS("{p}.name") .replace("{L}", "{{L}}").replace("{N}", "{{N}}") + ", lambda w: w in (" + _DESC + "))), length({p}.name), -{p}.poi_id]"
_MALL = "mall|shopping|trgovski|трговски|kompleks|комплекс|\\bmol\\b|centar|центар"
_HOLDS = "(regexp_matches({a}.name, '(?i)" + _MALL + "') or regexp_matches(replace({a}.type, '_', ' '), '(?i)" + _MALL + "')) and length({pa}) >= 4 and contains({pb}, {pa}) and {pa} <> {pb}"


def _fmt(s: str, **k: str) -> str:
    for name, v in k.items():
        s = s.replace("{" + name + "}", v)
    return s.replace("{{", "{").replace("}}", "}")


_PA, _PB = _PLAIN("a_name"), _PLAIN("b_name")
_CORE = "array_to_string(list_filter({}, lambda w: w not in ({})), '')".format
DECISIONS_SQL = f"""(select a_id, b_id, kind, distance_m, rule, not starts_with(rule, 'review') as merge, case when aw then a_id else b_id end as survivor_id, case when aw then b_id else a_id end as dropped_id from (
  select *, case when rule = 'inside-a' then true when rule = 'inside-b' then false else ka > kb end as aw from (
    select s.*, case when kind = 'same-phone' then 'phone' when kind = 'same-place_id-different-name' then 'place_id' when {_fmt(_HOLDS, a='a', pa=_PA, pb=_PB)} then 'inside-a' when {_fmt(_HOLDS, a='b', pa=_PB, pb=_PA)} then 'inside-b'
      when kind = 'same-name-drifted' then case when distance_m <= 100 then 'same-name' else 'review-far' end
      when {_CORE(_TOKENS('a_name'), _DESC)} <> '' and {_CORE(_TOKENS('a_name'), _DESC)} = {_CORE(_TOKENS('b_name'), _DESC)} then 'core-name' else 'review-names' end as rule,
      {_fmt(_KEY, p='a')} as ka, {_fmt(_KEY, p='b')} as kb
    from {SUSPECTS_SQL} s join {POIS_SQL} a on a.poi_id = a_id join {POIS_SQL} b on b.poi_id = b_id)))"""


@query(f"select a_id, b_id, a_name, b_name, kind, distance_m from {SUSPECTS_SQL}")
def suspect_pairs(spark, sf_dir):
    return identity.suspect_pairs(pois(spark, sf_dir))


@query(f"select * from {DECISIONS_SQL}")
def merge_decisions(spark, sf_dir):
    p = pois(spark, sf_dir)
    return identity.merge_decisions(identity.suspect_pairs(p), p)


@query(f"""with recursive link as materialized (select a_id as a, b_id as b from {DECISIONS_SQL} where merge union select b_id, a_id from {DECISIONS_SQL} where merge),
reach(x, y) as (select a, b from link union select r.x, l.b from reach r join link l on r.y = l.a),
lab as (select x as id, least(x, min(y)) as label from reach group by x),
best as (select label, first(id order by k desc) as survivor_id, list(id order by id) as ids from (select lab.id, label, {_fmt(_KEY, p='p')} as k from lab join {POIS_SQL} p on p.poi_id = lab.id) group by label)
select survivor_id, (len(ids) - 1)::bigint as n_dropped, array_to_string(list_filter(ids, lambda i: i <> survivor_id), ',') as dropped from best""")
def merge_components(spark, sf_dir):
    _checkpointing(spark)
    return identity.merge_components(pois(spark, sf_dir))


def _checkpointing(spark) -> None:
    """The shared folder that the session names; one of our own only where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/cartolex")


@query(f"select poi_id, {_CORE(_TOKENS('name'), _DESC)} as core, len(list_filter({_TOKENS('name')}, lambda w: w in ({_DESC})))::bigint as descriptors from {POIS_SQL}")
def core_names(spark, sf_dir):
    n = F.size(F.filter(identity.name_tokens(F.col("name")), lambda w: w.isin(*L.DESCRIPTORS))).cast("long")
    return pois(spark, sf_dir).select("poi_id", identity.core_name(F.col("name")).alias("core"), n.alias("descriptors"))


#: Rows of one id: the part's own and one made from its size, so that ids repeat.
_DUP_SQL = f"(select * replace (case when poi_id % 3 = 0 then '0x1:0x' || lower(to_hex(poi_id // 6)) end as place_id) from {POIS_SQL})"


def _duplicated(spark, sf_dir):
    k = F.col("poi_id")
    return pois(spark, sf_dir).withColumn("place_id", F.when(k % 3 == 0, F.concat(F.lit("0x1:0x"), F.lower(F.hex(F.floor(k / 6))))))


@query(f"select place_id, count(*) as n, min(poi_id) as keep from {_DUP_SQL} where place_id is not null group by 1 having count(*) > 1")
def dup_place_ids(spark, sf_dir):
    return identity.duplicate_place_ids(_duplicated(spark, sf_dir))


@query(f"select poi_id, source, place_id from (select *, row_number() over (partition by source, place_id order by poi_id) as n from {_DUP_SQL}) where place_id is null or n = 1")
def identity_dedupe(spark, sf_dir):
    return identity.dedupe_by_identity(_duplicated(spark, sf_dir)).select("poi_id", "source", "place_id")


@query(f"""select place_id, arg_max(name, poi_id) as name, arg_max(type, poi_id) as type, arg_max(p_lat, poi_id) as p_lat, arg_max(p_lon, poi_id) as p_lon, arg_max(source, poi_id) as source,
  arg_max(review_count, poi_id) as review_count, arg_max(closed, poi_id) as closed, arg_max(u, poi_id) filter (u is not null) as place_url, arg_min(phone, poi_id) as phone, count(*) as n
  from (select *, case when poi_id % 4 = 0 then 'https://maps.google.com/?q=' || poi_id end as u from {_DUP_SQL}) where place_id is not null group by place_id""")
def place_upsert(spark, sf_dir):
    rows = _duplicated(spark, sf_dir).withColumn("place_url", F.when(F.col("poi_id") % 4 == 0, F.concat(F.lit("https://maps.google.com/?q="), F.col("poi_id").cast("string"))))
    return identity.place_upsert(rows.withColumn("seq", F.col("poi_id")))


_TWIN_SQL = f"(select poi_id + 1000000 as poi_id, name, type, p_lat + (poi_id % 4) * 0.00001 as p_lat, p_lon, case when poi_id % 5 = 0 then place_id when poi_id % 7 = 0 then '0x2:0x1' end as place_id from {POIS_SQL} where poi_id % 2 = 0)"


@query(f"""with near as (select l.poi_id as legacy_id, e.poi_id as element_id, l.place_id as lp, e.place_id as ep from {POIS_SQL} l join {_TWIN_SQL} e on {_PLAIN('l.name')} = {_PLAIN('e.name')} and l.type = e.type
  where {distance_sql('l.p_lat', 'l.p_lon', 'e.p_lat', 'e.p_lon')} <= 3)
select legacy_id, any_value(element_id) as element_id, case when any_value(lp) is not null and any_value(ep) is null then 'adopted' when any_value(lp) is null or any_value(lp) = any_value(ep) then 'dropped' else 'conflict' end as fate from near group by 1 having count(*) = 1""")
def geometry_twins(spark, sf_dir):
    p = pois(spark, sf_dir)
    k = F.col("poi_id")
    e = p.where(k % 2 == 0).select((k + 1000000).alias("poi_id"), "name", "type", (F.col("p_lat") + (k % 4) * 0.00001).alias("p_lat"), "p_lon", F.when(k % 5 == 0, F.col("place_id")).when(k % 7 == 0, "0x2:0x1").alias("place_id"))
    return identity.geometry_twins(p, e)


_TA, _TB = (f"list_distinct({S.identity_tokens(e)})" for e in ("name", "an"))
_QUALIFIED = "(regexp_matches(array_to_string({0}, ' '), '(?i)" + L.IDENTITY_QUALIFIERS + "') or regexp_matches({1}, '(?i)" + L.IDENTITY_QUALIFIERS + "'))"
_MISSION = "(regexp_matches({0}, '(?i)" + L.EMBASSY + "') or regexp_matches(lower({1}), '(?i)" + L.EMBASSY + "'))"
_COUNTRY = ", ".join(map(S.q, L.COUNTRIES))


@query(f"""with p as (select * replace (coalesce(place_id, case when poi_id % 6 = 1 then '0x1:0x' || lower(to_hex(poi_id // 6)) end) as place_id) from {_DUP_SQL}),
a as (select place_id, min(poi_id) as anchor_id, arg_min(name, poi_id) as an, arg_min(p_lat, poi_id) as alat, arg_min(p_lon, poi_id) as alon from p where source = 'google' and place_id is not null group by 1),
j as (select poi_id, anchor_id, name, an, {distance_sql('p_lat', 'p_lon', 'alat', 'alon')} as d, {_TA} as ta, {_TB} as tb from p join a using (place_id) where source = 'osm'),
t as (select poi_id, anchor_id, case when len(ta) = 0 or len(tb) = 0 then 'none' when list_has_all(ta, tb) and list_has_all(tb, ta) and d <= 120 then 'token'
  when {_MISSION.format(S.semantic_key('name'), 'name')} and {_MISSION.format(S.semantic_key('an'), 'an')} and {_QUALIFIED.format('ta', 'name')} = {_QUALIFIED.format('tb', 'an')} and list_has_any(list_filter(ta, lambda w: w in ({_COUNTRY})), list_filter(tb, lambda w: w in ({_COUNTRY}))) and d <= 200 then 'embassy' else 'none' end as tier from j)
select poi_id, anchor_id, tier, tier = 'none' as stripped from t""")
def blind_fusions(spark, sf_dir):
    k = F.col("poi_id")
    p = _duplicated(spark, sf_dir).withColumn("place_id", F.coalesce("place_id", F.when(k % 6 == 1, F.concat(F.lit("0x1:0x"), F.lower(F.hex(F.floor(k / 6)))))))
    return identity.strip_blind_fusions(p)


@query()
def identity_heal(spark, sf_dir):
    _checkpointing(spark)
    p = pois(spark, sf_dir)
    anchors = p.where("source = 'google'").select(F.col("poi_id").alias("anchor_id"), F.col("name").alias("anchor_name"), "p_lat", "p_lon")
    k = F.col("poi_id")
    osm = p.where("source = 'google'").select((k * 10 + k % 3).alias("osm_id"), "name", (F.col("p_lat") + (k % 4) * 0.0002).alias("lat"), F.col("p_lon").alias("lon"))
    osm = osm.unionByName(osm.withColumn("osm_id", F.col("osm_id") + 5))
    return identity.heal_places(osm, anchors)


@query()
def heal_whole(spark, sf_dir):
    """The whole repair: embassies, tenants and what is left of an anchor's identity. A serial choice, which SQL cannot say; tests
    walk through it row after row."""
    p = pois(spark, sf_dir)
    k = F.col("poi_id")
    kind = F.when(k % 11 == 0, "embassy").when(k % 5 == 0, "mall").otherwise(F.col("type"))
    name = F.when(k % 11 == 0, F.concat(F.lit("Embassy of "), F.get(F.array(*[F.lit(c) for c in ("Turkey", "Greece", "Serbia")]), (k % 3).cast("int")))).otherwise(F.col("name"))
    anchors = p.where(k % 3 == 0).select(k.alias("anchor_id"), name.alias("anchor_name"), kind.alias("anchor_type"), "p_lat", "p_lon")
    osm = p.select((k * 4).alias("osm_id"), F.when(k % 7 == 0, F.concat(name, F.lit(" market"))).otherwise(name).alias("name"), F.col("type"), (F.col("p_lat") + (k % 4) * 0.0002).alias("lat"), F.when(k % 13 > 0, F.col("p_lon")).alias("lon"))
    osm = osm.unionByName(osm.where("osm_id % 8 = 0").withColumn("osm_id", F.col("osm_id") + 1))
    return heal.heal_whole(osm, anchors)


@query(f"select poi_id from {POIS_SQL} where poi_id % 17 = 0 or (p_lat + 0.02 between 41.95 and 42.05 and p_lon + 0.02 between 21.35 and 21.50)")
def prune_bbox(spark, sf_dir):
    """Places in the city's box; those without a point stay."""
    lat = F.when(F.col("poi_id") % 17 > 0, F.col("p_lat") + 0.02)
    return pois(spark, sf_dir).where(lat.isNull() | geo.inside(L.CITY_BOX, lat, F.col("p_lon") + 0.02)).select("poi_id")


@query(f"select poi_id, poi_id % 10 = 0 or {distance_sql('p_lat', 'p_lon', 'p_lat + (poi_id % 9) * 0.0005', 'p_lon')} <= 300 as may_move from {POIS_SQL}")
def pin_drift(spark, sf_dir):
    k = F.col("poi_id")
    old = F.when(k % 10 != 0, F.col("p_lat"))
    return pois(spark, sf_dir).select("poi_id", geo.pin_may_move(old, F.col("p_lon"), F.col("p_lat") + (k % 9) * 0.0005, F.col("p_lon")).alias("may_move"))


@query(f"select poi_id, place_id, (poi_id)::varchar as cid, 'https://maps.google.com/?cid=' || poi_id as link from {POIS_SQL} where place_id is not null")
def cid_links(spark, sf_dir):
    p = pois(spark, sf_dir).where("place_id is not null")
    return p.select("poi_id", "place_id", geo.cid(F.col("place_id")).alias("cid"), geo.cid_link(F.col("place_id")).alias("link"))


@query(f"""select poi_id, 'https://maps.google.com/?q=' || round(p_lat::varchar::decimal(18, 10), 3)::decimal(18, 3) || ',' || round(p_lon::varchar::decimal(18, 10), 3)::decimal(18, 3) as area,
  case when place_id is not null then 'https://maps.google.com/?cid=' || poi_id else printf('https://maps.google.com/?q=%.5f,%.5f', p_lat, p_lon) end as landmark from {POIS_SQL}""")
def links(spark, sf_dir):
    lat, lon = F.col("p_lat"), F.col("p_lon")
    return pois(spark, sf_dir).select("poi_id", geo.area_link(lat, lon).alias("area"), geo.landmark_link(F.lit(None).cast("string"), F.col("place_id"), lat, lon).alias("landmark"))


@query("""with u as (select page_id, url from pages union all select -1, 'https://maps.google.com/?q=41.99,21.43' union all select -2, 'https://www.google.com/maps/search/x' union all select -3, 'https://maps.google.com/?q=Skopje'
 union all select -4, 'https://maps.app.goo.gl/abc' union all select -5, 'https://www.google.com/maps/place/x/@41.99,21.43,17z/data=!3d41.995!4d21.431' union all select -6, 'https://maps.google.com/?api=1&q=1,2')
select page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1, 'i') in ('maps.google.com', 'www.google.com', 'google.com', 'maps.app.goo.gl', 'goo.gl', 'www.openstreetmap.org', 'openstreetmap.org')
  and not regexp_matches(url, '/search|[?&]query=|[?&]api=1', 'i') and (regexp_extract(url, '[?&]q=([^&#]*)', 1) = '' or regexp_matches(url_decode(regexp_extract(url, '[?&]q=([^&#]*)', 1)), '^-?\\d+(?:\\.\\d+)?,\\s*-?\\d+(?:\\.\\d+)?$')) as allowed,
  case when regexp_matches(url, '!3d-?\\d') then regexp_extract(url, '!3d(-?\\d+(?:\\.\\d+)?)', 1)::double when regexp_matches(url, '@-?\\d+(?:\\.\\d+)?,-?\\d') then regexp_extract(url, '@(-?\\d+(?:\\.\\d+)?),', 1)::double
    when regexp_matches(url, '[?&]q=-?\\d+(?:\\.\\d+)?,-?\\d') then regexp_extract(url, '[?&]q=(-?\\d+(?:\\.\\d+)?),', 1)::double end as lat from u""")
def url_guard(spark, sf_dir):
    extra = ["https://maps.google.com/?q=41.99,21.43", "https://www.google.com/maps/search/x", "https://maps.google.com/?q=Skopje", "https://maps.app.goo.gl/abc", "https://www.google.com/maps/place/x/@41.99,21.43,17z/data=!3d41.995!4d21.431", "https://maps.google.com/?api=1&q=1,2"]
    u = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(extra)], "page_id long, url string"))
    return u.select("page_id", geo.allowed_link(F.col("url")).alias("allowed"), geo.link_coords(F.col("url"))["lat"].alias("lat"))
