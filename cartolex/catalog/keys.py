"""Text keys over names, streets and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolex.catalog import sqltext as S
from cartolex.catalog.registry import query
from cartolex.fixtures import ADDRESSES_SQL, POIS_SQL, addresses, pois, table
from cartolex.functions import text as T

#: Names in both scripts, with marks, numbers and phrases.
NAMES = [
    "Амбасада на Црна Гора", "Embassy of Montenegro", "Бит Пазар 1", "Бит Пазар 2", "Kapištec", "Čair", "Železara", "Католичка црква", "katolicka", "katolichka",
    "Штип", "Буњаковец", "Карпош 3", "ЌИП", "Џам", "Љубов", "Жена", "Скопје Сити Мол", "Skopje City Mall", "дајмонд", "Diamond", "Kipper Market - Butel", "ТЦ Мавровка",
    "Mavrovka Mall", "ООУ Лазо Ангеловски", "City Siti", "Embassy of the Republic of Turkey", "", "ООУ", "Ѓорче Петров", "Beverly Hils", "КАМ", "Ňřó Ďakovo",
]
STREETS = [
    "ул. Борис Трајковски 12", "Boris Trajkovski", "Бул. АСНОМ Бр.134", "Јане Сандански 25 - 17", "Кузман Јосифовски Питу 19/5", "Рузвелтова 51 2-10", "11 Октомври 25", "Тоне Томшиќ Бр.25",
    "Мраморец 12а", "Народен Фронт 19A", "Бр134", "БИСЕР", "blvd. Partizanski Odredi 62a", "Улица Македонија", "street Main 5 b",
]
#: The names above, those of places, suppliers and customers, and every word of every document.
NAMES_SQL = f"""(select unnest([{', '.join(map(S.q, NAMES))}]) as s union select p_name from part union select s_name from supplier union select c_name from customer
  union select x from (select unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) as x from documents) where x <> '')"""
STREETS_SQL = f"(select unnest([{', '.join(map(S.q, STREETS))}]) as s union select street || ' ' || housenumber from {ADDRESSES_SQL})"


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def names(spark, sf_dir):
    of = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("s"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("s")).where("s <> ''")
    every = strings(spark, NAMES).unionByName(of("part", "p_name")).unionByName(of("supplier", "s_name")).unionByName(of("customer", "c_name"))
    return every.unionByName(words).distinct()


def streets(spark, sf_dir):
    of = addresses(spark, sf_dir).select(F.concat("street", F.lit(" "), "housenumber").alias("s"))
    return strings(spark, STREETS).unionByName(of).distinct()


@query(f"select s, {S.to_latin('s')} as latin, {S.to_cyrillic('s')} as cyrillic, {S.spell_latin('s')} as spelled from {NAMES_SQL}")
def latin_fold(spark, sf_dir):
    s = F.col("s")
    return names(spark, sf_dir).select("s", T.to_latin(s).alias("latin"), T.to_cyrillic(s).alias("cyrillic"), T.spell_latin(s).alias("spelled"))


@query(f"select doc_id, length({S.to_latin('text')}) as n, md5({S.to_latin('text')}) as folded_md5 from documents")
def latin_fold_documents(spark, sf_dir):
    latin = T.to_latin(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(latin).cast("long").alias("n"), F.md5(latin).alias("folded_md5"))


@query(f"select s, {S.norm_name('s')} as name_key, {S.semantic_key('s')} as semantic from {NAMES_SQL}")
def name_keys(spark, sf_dir):
    s = F.col("s")
    return names(spark, sf_dir).select("s", T.norm_name(s).alias("name_key"), T.semantic_key(s).alias("semantic"))


@query(f"select s, {S.normalize_street('s')} as street, {S.street_key('s')} as key from {STREETS_SQL}")
def street_keys(spark, sf_dir):
    s = F.col("s")
    return streets(spark, sf_dir).select("s", T.normalize_street(s).alias("street"), T.street_key(s).alias("key"))


@query(f"select s, array_to_string({S.phonetic_keys('s')}, ' ') as keys from {NAMES_SQL}")
def phonetic_keys(spark, sf_dir):
    return names(spark, sf_dir).select("s", F.array_join(T.phonetic_keys(F.col("s")), " ").alias("keys"))


@query(f"select s, {S.sound_key('s')} as key from {NAMES_SQL}")
def sound_keys(spark, sf_dir):
    return names(spark, sf_dir).select("s", T.sound_key(F.col("s")).alias("key"))


@query(f"select s, {S.identity_key('s')} as key from {NAMES_SQL}")
def identity_keys(spark, sf_dir):
    return names(spark, sf_dir).select("s", T.identity_key(F.col("s")).alias("key"))


@query(f"""
with a as (select s from {STREETS_SQL}),
h as (select s, regexp_extract(s, '\\b(\\d+[a-zа-яA-ZА-Я]?)\\b', 1) as house from a)
select s, house, case when regexp_matches(house, '^\\d') then regexp_extract(house, '^\\d+')::double + case when regexp_matches(house, '^\\d+[a-zа-яA-ZА-Я]$') then 0.5 else 0 end end as value from h""")
def house_numbers(spark, sf_dir):
    rows = streets(spark, sf_dir).withColumn("house", T.house_number(F.col("s")))
    return rows.withColumn("value", T.house_value(F.col("house")))


@query(f"select {S.norm_type('type')} as kind, {S.type_rank('type')}::integer as rank, count(*) as n from {POIS_SQL} group by all")
def type_ladder(spark, sf_dir):
    return pois(spark, sf_dir).groupBy(T.norm_type(F.col("type")).alias("kind"), T.type_rank(F.col("type")).cast("int").alias("rank")).agg(F.count("*").alias("n"))


#: Types as captures have them: the projected ones, and parts' own as raw classes.
RAW_KINDS_SQL = f"(select type from {POIS_SQL} union all select lower(p_type) || case p_partkey % 4 when 0 then ' school' when 1 then ' store' when 2 then ' dance school' else '' end from part)"


def raw_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.when(k == 0, " school").when(k == 1, " store").when(k == 2, " dance school").otherwise("")).alias("type"))
    return pois(spark, sf_dir).select("type").unionByName(raw)


@query(f"select type, count(*) as n from {RAW_KINDS_SQL} where {S.type_rank('type')} = 0 group by 1")
def unranked_types(spark, sf_dir):
    return raw_kinds(spark, sf_dir).where(T.type_rank(F.col("type")) == 0).groupBy("type").agg(F.count("*").alias("n"))


RAW_TYPES = ["Elementary school", "marketplace;fire_station", "Shopping  Mall", " MALL ", "garbage_type", "Bus Stop", "inn;hotel", None, "", "Government office"]


@query(f"select t, {S.type_rank('t')}::integer as rank from (select unnest([{', '.join(S.q(t) if t is not None else 'null' for t in RAW_TYPES)}]) as t union all select type from {RAW_KINDS_SQL})")
def raw_type_ranks(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in RAW_TYPES], "t string").unionByName(raw_kinds(spark, sf_dir).select(F.col("type").alias("t")))
    return rows.select("t", T.type_rank(F.col("t")).cast("int").alias("rank"))


PAIRS = [("karpos", "karpoš"), ("bolnica", "bulnica"), ("pelister", "peliter"), ("abcde", "abdce"), ("abc", "abd"), ("kultura", "peliter"), ("diamond", "diamnod"), ("same", "same"), ("", "x")]


@query(f"""select a, b, a = b or (levenshtein(x, y) <= 1 or (length(x) = length(y) and damerau_levenshtein(x, y) <= 1)) and length(x) >= 5 and length(y) >= 5 and x[1] = y[1] or (x = y and x <> '') as almost
from (select a, b, {S.to_latin('a')} as x, {S.to_latin('b')} as y from (select unnest([{', '.join(S.q(a) for a, _ in PAIRS)}]) as a, unnest([{', '.join(S.q(b) for _, b in PAIRS)}]) as b
  union all select distinct split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) from part union all select distinct s_name, c_name from supplier join customer on s_suppkey = c_custkey))""")
def almost_equal_words(spark, sf_dir):
    words = F.split("p_name", " ")
    of_parts = table(spark, sf_dir, "part").select(words[0].alias("a"), words[1].alias("b")).distinct()
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_name").alias("a"), F.col("c_name").alias("b")).distinct()
    rows = spark.createDataFrame(PAIRS, "a string, b string").unionByName(of_parts).unionByName(joined)
    return rows.select("a", "b", T.words_almost_equal(F.col("a"), F.col("b")).alias("almost"))
