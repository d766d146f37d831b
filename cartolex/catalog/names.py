"""Lookups by name, categories, script repair, extracts and overrides."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.keys import NAMES_SQL, names
from cartolex.catalog.registry import query
from cartolex.fixtures import POIS_SQL, distance_sql, pois, properties, table
from cartolex.functions import lexicon as L
from cartolex.functions.script import clean_name
from cartolex.operators import collapse, lookup
from cartolex.sources import osm

NEEDLES = [(1, "red bolt", 41.99, 21.42), (2, "Bolt", 42.0, 21.4), (3, "кај anvil", 41.97, 21.45), (4, "gizm", 41.98, 21.38), (5, "zzz", 41.98, 21.38), (6, "LARGE plate", 42.01, 21.43)]
_NEEDLE_SQL = "(values " + ", ".join(f"({i}, {S.q(t)}, {a}, {b})" for i, t, a, b in NEEDLES) + ") n(needle_id, text, center_lat, center_lon)"


def _needles(spark):
    return spark.createDataFrame(NEEDLES, "needle_id int, text string, center_lat double, center_lon double")


@query(f"""select needle_id, poi_id, floor(d + 0.5)::bigint as distance_m from (select needle_id, poi_id, {distance_sql('center_lat::double', 'center_lon::double', 'p_lat', 'p_lon')} as d
  from {_NEEDLE_SQL} join {POIS_SQL} p on contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) where d <= 900""")
def find_pois_like(spark, sf_dir):
    return lookup.find_pois_like(_needles(spark), pois(spark, sf_dir))


@query(f"""select needle_id, rn::integer as rn, name from (select needle_id, name, row_number() over (partition by needle_id order by length(name), name) as rn from (
  select distinct needle_id, name from {_NEEDLE_SQL} join (select distinct name from {POIS_SQL}) p on contains(lower(name), lower(regexp_replace(text, '^(кај|спроти|как)\\s+', '', 'i'))))) where rn <= 8""")
def find_pois_by_name(spark, sf_dir):
    return lookup.find_pois_by_name(_needles(spark), pois(spark, sf_dir).select("name", "type").distinct())


LOOKUPS = [(1, "Католичка црква"), (2, "katolicka crkva"), (3, "Sitty Mol"), (4, "Воена болница"), (5, "Bunjakovec"), (6, "Karpos 3"), (7, "Pelister hotell"), (8, "nothing here"), (9, "ab"), (10, "Амбасада на Турција")]
PLACES = ["Catholic Church Католичка црква", "Skopje City Mall", "Воена болница", "Воена академија", "Буњаковец", "Карпош 3", "Карпош", "Hotel Pelister", "Embassy of Turkey", "ТЦ Бисер"]
LOOKUP_WANT = [(1, 2, "Catholic Church Католичка црква"), (2, 3, "Catholic Church Католичка црква"), (3, 4, "Skopje City Mall"), (4, 1, "Воена болница"), (5, 1, "Буњаковец"), (6, 3, "Карпош 3"), (7, 4, "Hotel Pelister"), (10, 1, "Embassy of Turkey")]


@query()
def find_poi_by_name(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in PLACES], "name string").unionByName(pois(spark, sf_dir).select("name").distinct())
    return lookup.find_poi_by_name(spark.createDataFrame(LOOKUPS, "needle_id int, text string"), names)


_CATEGORY = "list_filter(list_transform(" + S.words(f"trim(regexp_replace({S.to_latin('s')}, '[^a-z0-9]+', ' ', 'g'))") + f", lambda w: coalesce({S.lookup(L.CATEGORY_WORDS, 'w', 'null')}, case " + " ".join(f"when starts_with(w, '{a}') then '{b}'" for a, b in L.CATEGORY_STEMS) + " end)), lambda x: x is not null)[1]"


@query(f"select s, {_CATEGORY} as category from (select s from {NAMES_SQL} union select unnest([{', '.join(map(S.q, PLACES))}]))")
def place_categories(spark, sf_dir):
    return names(spark, sf_dir).unionByName(spark.createDataFrame([(n,) for n in PLACES], "s string")).distinct().select("s", lookup.place_category(F.col("s")).alias("category"))


HEALS = [("Eуpoфapм", "Еурофарм"), ("Post Officе", "Post Office"), ("Капиšтец", "Капиштец"), ("Карпош III", "Карпош III"), ("Глуво куче;Gluvo Kuče", "Глуво куче;Gluvo Kuče"), ("Aмбасада", "Амбасада"), ("  two   words ", "two words"), ("Buba Мara", "Buba Mara"), ("Туpиcт", "Турист"), ("Ресторан Кej", "Ресторан Кеј")]


@query("select * from (values " + ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in HEALS) + """) t(s, healed) union all select text, trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')) from conversations
  union all select '  ' || p_name || '  x ', p_name || ' x' from part""")
def name_heal(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select(F.col("text").alias("s"))
    made = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit("  x ")).alias("s"))
    return spark.createDataFrame([(a,) for a, _ in HEALS], "s string").unionByName(told).unionByName(made).select("s", clean_name(F.col("s")).alias("healed"))


@query()
def nearest_pois_merged(spark, sf_dir):
    return collapse.nearest_places(properties(spark, sf_dir), pois(spark, sf_dir), 200.0, 3)


EXTRACT = {
    "elements": [
        {"type": "node", "id": 1, "lat": 42.0, "lon": 21.4, "tags": {"name": "Kipper", "shop": "supermarket"}},
        {"type": "node", "id": 2, "lat": 42.000001, "lon": 21.4, "tags": {"name": "Kipper", "amenity": "cafe"}},
        {"type": "way", "id": 3, "center": {"lat": 41.99, "lon": 21.41}, "tags": {"name": "Eуpoфapм", "amenity": "pharmacy"}},
        {"type": "node", "id": 4, "lat": 41.98, "lon": 21.42, "tags": {"addr:street": "Kоце Mеталец", "addr:housenumber": "5"}},
        {"type": "node", "id": 5, "tags": {"name": "No point"}},
    ]
}


@query("""select * from (values ('node/1', 'Kipper', 'supermarket', 42.0::double), ('way/3', 'Еурофарм', 'pharmacy', 41.99::double)) t(osm_key, name, type, lat)
  union all select 'node/' || (1000 + c_custkey), c_name, case when c_custkey % 2 = 0 then lower(c_mktsegment) else 'other' end, 41.0::double + c_custkey / 16.0::double from customer""")
def osm_source(spark, sf_dir):
    k = F.col("c_custkey")
    tags = F.when(k % 2 == 0, F.create_map(F.lit("name"), "c_name", F.lit("shop"), F.lower("c_mktsegment"))).otherwise(F.create_map(F.lit("name"), F.col("c_name")))
    element = F.struct(F.lit("node").alias("type"), (k + 1000).alias("id"), (41.0 + k / 16.0).alias("lat"), F.lit(21.0).alias("lon"), tags.alias("tags"))
    more = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("j"))
    raw = spark.createDataFrame([(json.dumps(EXTRACT),)], "j string").unionByName(more).select(F.from_json("j", osm.ELEMENTS).alias("r")).select("r.*")
    return osm.pois_of(osm._elements(raw)).select("osm_key", "name", "type", "lat")


@query("""select 7 as way_id, n::integer as num, round(42.0::double + (n - 1) / 8.0::double * 0.004, 9) as lat from (select unnest([1, 3, 5, 7, 9]) as n)
  union all select s_suppkey + 100, n, round(41.0::double + s_suppkey / 16.0::double + (n - 1) / 10.0::double * 0.005, 9) from supplier, (select unnest(range(1, 12, 5)) as n)""")
def interpolated_numbers(spark, sf_dir):
    way = spark.createDataFrame([(7, 1, 9, 2, [(42.0, 21.4), (42.001, 21.4), (42.004, 21.4)]), (8, 1, 9, 2, [(42.0, 21.4)])], "way_id int, first int, last int, step int, points array<struct<lat:double,lon:double>>")
    lat = 41.0 + F.col("s_suppkey") / 16.0
    points = F.array(*[F.struct((lat + d).alias("lat"), F.lit(21.0).alias("lon")) for d in (0.0, 0.001, 0.005)])
    ways = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).cast("int").alias("way_id"), F.lit(1).alias("first"), F.lit(11).alias("last"), F.lit(5).alias("step"), points.alias("points"))
    way = way.unionByName(ways)
    return osm.expand_interpolation(way).select("way_id", "num", F.round("lat", 9).alias("lat"))


@query(f"""with p as (select name, type, p_lat as lat, p_lon as lon, 'map' as source from {POIS_SQL}),
o as (select * from p where name <> 'red bolt' union all select 'red bolt', 'mall', 42.0, 21.4, 'override'),
m as (select name, type, case when name = 'blue bolt' then 41.5 else lat end as lat, case when name = 'blue bolt' then 21.5 else lon end as lon, source from o)
select name, source, count(*) as n, sum(round(lat * 100000)::bigint)::bigint as lats from (select * from m union all select 'brand new', 'park', 41.99, 21.43, 'override') group by all""")
def overrides_apply(spark, sf_dir):
    p = pois(spark, sf_dir).select("name", "type", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.lit("map").alias("source"))
    shape = "name string, type string, lat double, lon double"
    out = osm.apply_overrides(p, spark.createDataFrame([("brand new", "park", 41.99, 21.43), ("blue bolt", "park", 1.0, 1.0)], shape), spark.createDataFrame([("red bolt", "mall", 42.0, 21.4)], shape), spark.createDataFrame([("blue bolt", 41.5, 21.5)], "name string, lat double, lon double"))
    return out.groupBy("name", "source").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("lat") * 100000 + 0.5)).alias("lats"))


#: A schedule's lines by the number of a part, whose name is what they run.
CRON = ["@reboot run {} # BOOT", "*/5 * * * * sync-prices {}", "0 3 * * * refresh-map {}", "# 0 3 * * * refresh-map {}", "", "0 1 * * * {}", "@reboot {}", "  # sync-prices {}"]
_CRON_SQL = "(select p_partkey as line_no, replace([" + ", ".join(f"'{c}'" for c in CRON) + "][p_partkey % 8 + 1], '{}', p_name) as raw from part)"


@query(f"""with l as (select line_no, trim(raw) as r, case when contains(raw, '@reboot') and contains(raw, 'BOOT') then 'boot' when contains(raw, 'sync-') then 'sync' when contains(raw, 'refresh-map') then 'forbidden' else 'other' end as kind from {_CRON_SQL})
select line_no, kind, r <> '' and not starts_with(r, '#') as active, not (kind = 'forbidden' and r <> '' and not starts_with(r, '#')) as stays from l""")
def cron_classify(spark, sf_dir):
    from cartolex.plans.cron import classify_lines, strip_forbidden

    line = F.get(F.array(*map(F.lit, CRON)), (F.col("p_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.replace(line, F.lit("{}"), F.col("p_name")).alias("raw"))
    told = classify_lines(rows, boot="BOOT", sync=["sync-"], forbidden=["refresh-map"])
    stays = strip_forbidden(told).select("line_no", F.lit(True).alias("stays"))
    return told.join(stays, "line_no", "left").select("line_no", "kind", "active", F.coalesce("stays", F.lit(False)).alias("stays"))


@query(f"""select p_name as wanted from (select distinct p_name from part) where not exists (select 1 from {_CRON_SQL} where raw <> '' and not starts_with(trim(raw), '#') and line_no % 3 > 0 and regexp_matches(raw, 'sync-prices ' || p_name || '$'))""")
def cron_missing(spark, sf_dir):
    """Names whose price sync no active line of a thinned schedule holds."""
    from cartolex.plans.cron import classify_lines, missing_sync

    parts = table(spark, sf_dir, "part")
    line = F.get(F.array(*map(F.lit, CRON)), (F.col("p_partkey") % 8).cast("int"))
    rows = parts.where("p_partkey % 3 > 0").select(F.replace(line, F.lit("{}"), F.col("p_name")).alias("raw"))
    required = parts.select(F.concat(F.lit("sync-prices "), "p_name").alias("pattern"), F.col("p_name").alias("wanted")).distinct()
    return missing_sync(classify_lines(rows, boot="BOOT", sync=["sync-"], forbidden=["refresh-map"]), required).select("wanted")


@query("""with a as (select 'f' || p_partkey % 40 as name, max(p_brand) as digest from part group by 1), b as (select 'f' || p_partkey % 50 as name, min(p_brand) as digest from part where p_partkey % 50 > 5 group by 1)
select coalesce(a.name, b.name) as name, case when b.name is null then 'added' when a.name is null then 'missing' else 'changed' end as problem from a full join b on a.name = b.name where a.name is null or b.name is null or a.digest <> b.digest""")
def manifest_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = p.groupBy(F.concat(F.lit("f"), (k % 40).cast("string")).alias("name")).agg(F.max("p_brand").alias("digest"))
    b = p.where(k % 50 > 5).groupBy(F.concat(F.lit("f"), (k % 50).cast("string")).alias("name")).agg(F.min("p_brand").alias("digest"))
    return osm.manifest_problems(a, b)
