"""Radius searches, nearest areas and complexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.registry import query
from cartolex.fixtures import POIS_SQL, PROPERTIES_SQL, SUPPLIERS_SQL, distance_sql, pois, properties, suppliers
from cartolex.operators import spatial

_NEAR = f"""select property_id, p.poi_id, p.name as poi_name, p.type as poi_type, {S.type_rank('p.type')}::integer as rank, {distance_sql('c.lat', 'c.lon', 'p_lat', 'p_lon')} as d,
  p.type in ('bus_station', 'tram_station', 'tram_stop') as stop, case when closed = 1 then -1.0 else log10(review_count + 1.0) + case when source = 'google' then 0.01 else 0 end end as prom
  from {PROPERTIES_SQL} c join {POIS_SQL} p on p_lat between c.lat - 200 / 111000.0::double and c.lat + 200 / 111000.0::double and p_lon between c.lon - 200 / 82000.0::double and c.lon + 200 / 82000.0::double
  where p.type not in ('yes', 'company', 'place', 'house')"""


@query(f"""select property_id, rn::integer as rn, poi_id, poi_name, poi_type, rank, floor(d + 0.5)::bigint as distance_m from (
  select *, row_number() over (partition by property_id order by stop, rank desc, d, prom desc, poi_name, poi_id) as rn from ({_NEAR}) where d <= 200) where rn <= 3""")
def nearest_pois(spark, sf_dir):
    return spatial.nearest_pois(properties(spark, sf_dir), pois(spark, sf_dir), 200.0, 3)


@query(f"""select c.property_id, b.poi_id, b.name, floor(d + 0.5)::bigint as distance_m from {PROPERTIES_SQL} c left join (
  select *, row_number() over (partition by property_id order by d, poi_id) as rn from (
    select property_id, poi_id, s.name, {distance_sql('c.lat', 'c.lon', 'p_lat', 'p_lon')} as d from {PROPERTIES_SQL} c join {SUPPLIERS_SQL} s
      on p_lat between c.lat - 2500 / 111000.0::double and c.lat + 2500 / 111000.0::double and p_lon between c.lon - 2500 / 82000.0::double and c.lon + 2500 / 82000.0::double) where d <= 2500) b
  on b.property_id = c.property_id and rn = 1""")
def area_at(spark, sf_dir):
    return spatial.area_at(properties(spark, sf_dir), suppliers(spark, sf_dir))


@query(f"""with shops as (select poi_id as shop_id, p_lat as lat, p_lon as lon from {POIS_SQL} where type = 'cafe'),
comp as (select poi_id, case when poi_id % 4 = 0 then 'TC ' || name else name end as name, p_lat, p_lon from {POIS_SQL} where type = 'mall')
select s.shop_id, b.poi_id, b.name, floor(d + 0.5)::bigint as distance_m from shops s left join (
  select *, row_number() over (partition by shop_id order by (case when starts_with(name, 'TC ') then 0 else 1 end), d, poi_id) as rn from (
    select shop_id, poi_id, name, {distance_sql('lat', 'lon', 'p_lat', 'p_lon')} as d from shops join comp on p_lat between lat - 250 / 111000.0::double and lat + 250 / 111000.0::double and p_lon between lon - 250 / 82000.0::double and lon + 250 / 82000.0::double)
  where d <= 250) b on b.shop_id = s.shop_id and rn = 1""")
def enclosing_complex(spark, sf_dir):
    p = pois(spark, sf_dir)
    shops = p.where("type = 'cafe'").select(F.col("poi_id").alias("shop_id"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    named = F.when(F.col("poi_id") % 4 == 0, F.concat(F.lit("TC "), "name")).otherwise(F.col("name"))
    malls = p.where("type = 'mall'").select("poi_id", named.alias("name"), "p_lat", "p_lon")
    return spatial.enclosing_complex(shops, malls)


@query(f"""select poi_id, name, type from (select *, row_number() over (order by type, n3, poi_id) as total from (select *, row_number() over (partition by type order by poi_id) as n3 from {POIS_SQL}) where n3 <= 3) where total <= 240""")
def audit_sample(spark, sf_dir):
    from pyspark.sql.window import Window

    first = pois(spark, sf_dir).withColumn("n3", F.row_number().over(Window.partitionBy("type").orderBy("poi_id"))).where("n3 <= 3")
    return first.orderBy("type", "n3", "poi_id").limit(240).select("poi_id", "name", "type")
