"""Learned addresses, backfilled points and bare rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.registry import query
from cartolex.catalog.service import _PROPS_SQL, _props
from cartolex.fixtures import ADDRESSES_SQL, addresses, table
from cartolex.functions.text import street_key
from cartolex.operators import learning

_CAP = "array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_ANSWERS_SQL = f"(select s_suppkey as id, {_CAP} || ' ' || (s_suppkey % 70) as address, 41.96::double + (s_suppkey % 12) * 0.01::double as lat, 21.40::double as lon, s_suppkey % 2 = 0 as exact from supplier join nation on s_nationkey = n_nationkey)"


@query(f"""with a as (select *, {S.street_key('street')} as key from {ADDRESSES_SQL}),
t as (select *, {S.street_key('address')} as key, regexp_extract(address, '\\b(\\d+[a-zа-я]?)\\b', 1) as num from {_ANSWERS_SQL} where lat between 41.95 and 42.05 and lon between 21.35 and 21.50),
h as (select key, num as housenumber, first(address order by id) as street from t where exact and num <> '' group by all),
g as (select key, first(address order by id) as street from t where not exact group by key),
r as (select street, housenumber, key, source, false as learned from a where housenumber not in ('', 'ББ') or key not in (select key from g)
  union all select street, housenumber, key, '', true from h anti join a using (key, housenumber) union all select street, '', key, 'google_street', true from g)
select key, source, learned, count(*) as n, min(housenumber) as least, max(street) as street from r group by all""")
def learn_addresses(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    answers = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(k.alias("id"), F.concat(F.initcap("n_name"), F.lit(" "), (k % 70).cast("string")).alias("address"), (41.96 + (k % 12) * 0.01).alias("lat"), F.lit(21.40).alias("lon"), (k % 2 == 0).alias("exact"))
    a = addresses(spark, sf_dir).withColumn("key", street_key(F.col("street"))).select("street", "housenumber", "lat", "lon", "key", "source")
    return learning.learn(a, answers).groupBy("key", "source", "learned").agg(F.count("*").alias("n"), F.min("housenumber").alias("least"), F.max("street").alias("street"))


@query(f"""select id as property_id, case when id % 5 = 0 then 41.97 when id % 7 = 0 then 41.98 end as lat, case when id % 5 = 0 or id % 7 = 0 then 21.41 end as lon, case when id % 5 = 0 then 'geocode' when id % 7 = 0 then 'street' end as geo_source
from (select * replace (case when id % 2 = 0 then null else geo_source end as geo_source) from {_PROPS_SQL}) where lat is null and geo_source is null""")
def backfill_points(spark, sf_dir):
    k = F.col("property_id")
    p = _props(spark, sf_dir).withColumnRenamed("id", "property_id").withColumn("geo_source", F.when(k % 2 != 0, F.col("geo_source")))
    stage = lambda every, lat: p.where(k % every == 0).select("property_id", F.lit(lat).alias("lat"), F.lit(21.41).alias("lon"))
    return learning.backfill(p, ("geocode", stage(5, 41.97)), ("outside", stage(3, 50.0)), ("street", stage(7, 41.98)))


@query(f"""with a as (select *, {S.street_key('street')} as key from {ADDRESSES_SQL}), w as (select key, avg(lat) as wlat from a where housenumber not in ('', 'ББ') and addr_id % 2 = 0 and not starts_with(key, 'c') group by 1)
select key, housenumber in ('', 'ББ') and wlat is not null as moved, count(*) as n, round(sum(case when housenumber in ('', 'ББ') and wlat is not null then wlat else lat end), 5) as lats from a left join w using (key) group by all""")
def bare_rows(spark, sf_dir):
    a = addresses(spark, sf_dir).withColumn("key", street_key(F.col("street")))
    ways = a.where("housenumber not in ('', 'ББ') and addr_id % 2 = 0 and not startswith(key, 'c')").select("key", "lat", "lon")
    return learning.upgrade_bare_rows(a, ways).groupBy("key", "moved").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 5).alias("lats"))
