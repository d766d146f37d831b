"""The whole name lookup over whole tables: needles from customers, places from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.names import _CATEGORY
from cartolex.catalog.registry import query
from cartolex.fixtures import POIS_SQL, PROPERTIES_SQL, distance_sql, names_by_remainder, pois, properties
from cartolex.functions import lexicon as L
from cartolex.operators import cascade

KINDS = ["mall", "bus_station", "bank", "residential", "park", "suburb"]


def places(spark, sf_dir):
    k, n = F.col("poi_id"), F.col("name")
    named = F.when(k % 8 == 0, F.concat(n, F.lit(" mall"))).when(k % 8 == 1, F.concat(n, F.lit(" parking"))).when(k % 8 == 2, F.concat(F.lit("shop "), n)).when(k % 8 == 3, F.concat(F.lit("the "), F.substring(n, 1, 2), F.lit(" ("), n, F.lit(")"))).otherwise(n)
    return pois(spark, sf_dir).select("poi_id", named.alias("name"), F.get(F.array(*map(F.lit, KINDS)), (k % 6).cast("int")).alias("type"), "p_lat", "p_lon")


def needles(spark, sf_dir):
    """A name, a word of one, or one in capitals; every third without a centre."""
    k = F.col("property_id")
    said = names_by_remainder(spark, sf_dir, 500).select("_k", F.split("name", " ").alias("w"), F.col("name").alias("n"))
    p = properties(spark, sf_dir).withColumn("_k", k % 500).join(said, "_k")
    text = F.when(k % 4 == 0, F.col("n")).when(k % 4 == 1, F.get("w", F.lit(1))).when(k % 4 == 2, F.get("w", F.lit(0))).otherwise(F.upper("n"))
    return p.select(k.alias("needle_id"), text.alias("text"), F.when(k % 3 != 0, F.col("lat")).alias("c_lat"), F.when(k % 3 != 0, F.col("lon")).alias("c_lon"), "w")


_PLACES = f"""(select poi_id, case poi_id % 8 when 0 then name || ' mall' when 1 then name || ' parking' when 2 then 'shop ' || name when 3 then 'the ' || name[1:2] || ' (' || name || ')' else name end as name,
  [{", ".join(map(S.q, KINDS))}][poi_id % 6 + 1] as type, p_lat, p_lon from {POIS_SQL})"""


def _needles(text: str) -> str:
    return f"""(select property_id as needle_id, {text} as text, case when property_id % 3 <> 0 then lat end as c_lat, case when property_id % 3 <> 0 then lon end as c_lon
  from {PROPERTIES_SQL} join (select poi_id - 1 as k0, name as said, string_split(name, ' ') as w from {POIS_SQL}) on property_id % 500 = k0)"""


_SAID = _needles("case property_id % 4 when 0 then said when 1 then w[2] when 2 then w[1] else upper(said) end")
_SOUNDS = lambda e: f"list_transform({S.words(e)}, lambda z: coalesce({S.phonetic_keys('z')}[1], lower(z)))"
_D = distance_sql("c_lat", "c_lon", "p_lat", "p_lon")


def _typed(e: str, table: list[str]) -> str:
    return f"{e} in ({', '.join(map(S.q, table))})"


@query(f"""with f as (select *, low as s, {_CATEGORY.replace('lower(s)', 'lower(low)')} as cat from (select distinct name, type, lower(name) as low, {S.spell_latin('name')} as spelled, {S.type_rank('type')} as rank,
  {_typed('string_split(name, chr(32))[1]', L.SHOP_FIRST_WORDS)} as shop, {_typed('type', L.TRANSIT_TYPES)} as stop, {_typed('type', cascade.SERVICE_POINTS)} as service, {_typed('type', cascade.RESIDENTIAL)} as home, {_typed('type', cascade.SETTLEMENTS)} as area,
  {_SOUNDS('name')} as sounds from {_PLACES})),
said as (select *, {_CATEGORY} as a_cat from (select distinct text, text as s, lower(text) as n, {S.spell_latin('text')} as n_sp, {S.spell_latin(S.to_cyrillic('text'))} as n_lat, {_SOUNDS('text')} as a_sounds from {_SAID})),
kinds as (select * from said join f on (cat is null or a_cat is null or cat = a_cat) and (false {"".join(f" or (length({n}) >= 3 and regexp_matches({h}, '(^|[^a-z0-9])' || {n} || case when length({n}) >= 4 then '' else '([^a-z0-9]|$)' end))" for h, n in (("low", "n"), ("spelled", "n"), ("spelled", "n_lat")))})),
v as (select needle_id, c_lat, k.*, p.poi_id, {_D} as d from {_SAID} q join kinds k using (text) join {_PLACES} p on p.name = k.name and p.type = k.type where not shop),
r1 as (select * from (select *, max((not stop)::int) over a as places, max((not stop and d <= 1000)::int) over a as near from v window a as (partition by needle_id)) where not (stop and places = 1 and (c_lat is null or near = 1))),
r2 as (select * from (select *, max((not service)::int) over (partition by needle_id) as others from r1) where not (service and others = 1)),
r3 as (select * from (select *, max((not home)::int) over (partition by needle_id) as venues from r2) where not (home and venues = 1)),
m as (select *, case when low = n or spelled = n_sp then 0 when contains(low, '(' || n || ')') then 1 when starts_with(low, n) or starts_with(spelled, n_sp) then 2 else 3 end as mr, (sounds <> a_sounds)::int as wn from r3),
t as (select * from (select *, max((mr = 3 and rank >= {L.TYPE_RANKS['mall']})::int) over (partition by needle_id) as malls from m) where malls = 0 or mr <> 3 or rank >= {L.TYPE_RANKS['mall']})
select needle_id, name, type, poi_id from (select *, row_number() over (partition by needle_id order by regexp_matches(name, '(^| )(parking|shop)( |$)')::int, mr, wn, (not (wn = 0 and area))::int,
  case when c_lat is null and mr = 2 then -rank else 0 end, coalesce(d, length(name)), length(name), name, type, poi_id) as rn from t) where rn = 1""")
def ranked_lookup(spark, sf_dir):
    return cascade.ranked_lookup(needles(spark, sf_dir).drop("w"), places(spark, sf_dir))


_STRIPPED = "case " + " ".join(f"when ends_with(y, '{e}') and length(y) >= {len(e) + 4} then y[1:length(y) - {len(e)}]" for e in ("ot", "ov", "ta", "to", "te", "iot")) + " else y end"


def _tokens(e: str) -> str:
    t = S.words(S.replaced(S.cleaned(S.spell_latin(e), "a-z0-9"), L.PHRASES))
    stops = ", ".join(map(S.q, L.STOP_WORDS))
    return f"list_filter(list_distinct(list_transform({t}, lambda y: {S.lookup(L.WORDS, 'y', S.lookup(L.WORDS, _STRIPPED, 'y'))})), lambda y: y not in ({stops}))"


_TURNED = _needles("w[2] || case when property_id % 5 = 0 then ' mol' else '' end || ' ' || w[1]")


@query(f"""with f as (select *, {_CATEGORY} as cat from (select distinct name, type, name as s, {_tokens('name')} as tokens, {S.type_rank('type')} as rank from {_PLACES}) where not ({_typed('string_split(name, chr(32))[1]', L.SHOP_FIRST_WORDS)})),
said as (select *, {_CATEGORY} as a_cat from (select distinct text, text as s, {_tokens('text')} as want from {_TURNED})),
kinds as (select text, name, type, len(tokens) - len(want) as extra, rank from said join f on list_has_all(tokens, want) and (cat is null or a_cat is null or cat = a_cat))
select needle_id, name, poi_id from (select needle_id, p.name, p.poi_id, row_number() over (partition by needle_id order by extra, -rank, coalesce({_D}, length(p.name)), length(p.name), p.name, p.type, p.poi_id) as rn
  from {_TURNED} q join kinds k using (text) join {_PLACES} p on p.name = k.name and p.type = k.type) where rn = 1""")
def token_set_lookup(spark, sf_dir):
    k = F.col("needle_id")
    turned = F.concat_ws(" ", F.get("w", F.lit(1)), F.when(k % 5 == 0, "mol"), F.get("w", F.lit(0)))
    return cascade.token_set_lookup(needles(spark, sf_dir).withColumn("text", turned).drop("w"), places(spark, sf_dir))


def slipped(spark, sf_dir):
    """Needles with a letter doubled, two letters swapped, or words in another order."""
    k = F.col("needle_id")
    n = needles(spark, sf_dir)
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    swap = F.concat(F.substring(b, 1, 1), F.substring(b, 3, 1), F.substring(b, 2, 1), F.substr(b, F.lit(4)))
    text = F.when(k % 3 == 0, F.concat_ws(" ", a, F.concat(b, F.substring(b, -1, 1)))).when(k % 3 == 1, F.concat_ws(" ", swap, a)).otherwise(F.concat_ws(" ", b, a))
    return n.withColumn("text", text).drop("w")


@query()
def typo_lookup(spark, sf_dir):
    """No SQL: each word takes a word of the name in turn; tests walk through it word by word."""
    return cascade.typo_lookup(slipped(spark, sf_dir), places(spark, sf_dir))


@query()
def resolve_places(spark, sf_dir):
    """All passes and alternatives, which SQL cannot say in one; tests walk through them ask by ask."""
    return cascade.resolve_places(needles(spark, sf_dir).drop("w").unionByName(slipped(spark, sf_dir).withColumn("needle_id", -F.col("needle_id") - 1)), places(spark, sf_dir))
