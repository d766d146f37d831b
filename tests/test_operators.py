"""Operators that SQL does not express, against plain Python and hand-made cases."""

import random

from pyspark.sql import functions as F

from cartolex.catalog.names import LOOKUP_WANT, LOOKUPS, PLACES
from cartolex.functions import text as T
from cartolex.operators import collapse, identity, lookup
from cartolex.sources.rest import rest_query


def test_key_pairs(spark):
    def one(f, s):
        return spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]

    assert one(T.street_key, "ул. Борис Трајковски 12") == one(T.street_key, "Boris Trajkovski") == "boris trajkovski"
    assert [one(T.to_cyrillic, s) for s in ("Kapištec", "Čair", "Železara")] == ["капиштец", "чаир", "железара"]
    assert [one(T.spell_latin, s) for s in ("ЌИП", "Џам", "Шиш", "Љубов", "Жена")] == ["kjip", "dzham", "shish", "ljubov", "zhena"]
    assert {tuple(one(T.phonetic_keys, s)) for s in ("Католичка", "katolicka", "katolichka", "католицка")} == {("katolicka",)}
    assert one(T.canonical_word_key, "дајмонд") == one(T.canonical_word_key, "Diamond") and one(T.canonical_word_key, "Јоле") != one(T.canonical_word_key, "Оле")
    assert one(T.identity_key, "Амбасада на Црна Гора") == one(T.identity_key, "Embassy of Montenegro") and one(T.identity_key, "Бит Пазар 1") != one(T.identity_key, "Бит Пазар 2")
    assert [one(T.house_number, s) for s in ("Мраморец 12а", "Народен Фронт 19A", "Бул. АСНОМ Бр.134", "БИСЕР")] == ["12", "19A", "134", ""]
    assert [one(T.house_value, s) for s in ("19A", "29/3", "70b", "x")] == [19.5, 29.0, 70.5, None]
    assert one(identity.core_name, "NLB Banka ATM") == "nlb" and one(identity.core_name, "Skopje City Mall") == ""


def test_same_place_tiers(spark):
    cases = [
        ("Амбасада на Турција", "Embassy of Republic of Turkey", 100.0, False, False, "token"), ("Бит Пазар 1", "Бит Пазар 2", 5.0, True, False, "none"), ("Рептил", "Reptil Market br.3 Kisela Voda", 30.0, False, True, "subset"),
        ("Kipper", "Kipper Market - Butel", 30.0, False, False, "none"), ("Амбасада на Чешка", "Embassy of Czech Residence", 150.0, True, False, "none"), ("Амбасада на Црна Гора стара", "Embassy of Montenegro", 190.0, False, False, "embassy"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, d double, ia boolean, ib boolean, want string")
    for r in df.select("a", "want", identity.same_place_tier(F.col("a"), F.col("b"), F.col("d"), F.col("ia"), F.col("ib")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_heal_equals_serial_choice(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/cartolex-tests")
    rng = random.Random(8)
    rows = [(o, a, float(rng.randint(1, 50))) for o in range(40) for a in rng.sample(range(25), rng.randint(0, 5))]
    taken, want = set(), {}
    for o in range(40):
        free = sorted((d, a) for x, a, d in rows if x == o and a not in taken)
        if free:
            want[o] = free[0][1]
            taken.add(free[0][1])
    df = spark.createDataFrame(rows, "osm_id int, anchor_id int, distance double")
    assert {r["osm_id"]: r["anchor_id"] for r in identity.identity_heal(df, df, df).collect()} == want


def test_heal_of_a_hot_name_is_whole(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/cartolex-tests")
    df = spark.range(300 * 300).selectExpr("cast(id div 300 as int) as osm_id", "cast(id % 300 as int) as anchor_id", "cast((id div 300 * 7 + id % 300 * 11) % 97 as double) as distance")
    taken, want = set(), {}
    for o in range(300):
        _, a = min(((o * 7 + a * 11) % 97, a) for a in range(300) if a not in taken)
        want[o] = a
        taken.add(a)
    assert {r["osm_id"]: r["anchor_id"] for r in identity.identity_heal(df, df, df).collect()} == want


def test_lookup_cascade(spark):
    got = lookup.find_poi_by_name(spark.createDataFrame(LOOKUPS, "needle_id int, text string"), spark.createDataFrame([(n,) for n in PLACES], "name string")).collect()
    assert sorted((r["needle_id"], r["pass"], r["name"]) for r in got) == LOOKUP_WANT


def test_lookup_hits_after_a_short_first_word(spark):
    needles = spark.createDataFrame([(1, "TC Bis"), (2, "11 Oktomvri")], "needle_id int, text string")
    names = spark.createDataFrame([(n,) for n in ("TC Biser", "Ul 11 Oktomvri 5", "TCX Bis", "Oktomvri")], "name string")
    got = sorted((r["needle_id"], r["pass"], r["name"]) for r in lookup.find_poi_by_name(needles, names).collect())
    assert got == [(1, 2, "TC Biser"), (2, 2, "Ul 11 Oktomvri 5")]


def test_collapse_keeps_the_local_name_and_the_rated_pin(spark):
    shape = "poi_id long, name string, type string, p_lat double, p_lon double, source string, place_id string, review_count int, closed int"
    rows = [(1, "Еурофарм", "pharmacy", 42.0, 21.4, "osm", None, None, 0), (2, "Eurofarm", "Pharmacy", 42.0001, 21.4, "google", "0x1:0x2", 9, 0), (3, "Kipper", "supermarket", 42.0002, 21.4, "osm", None, None, 0), (4, "Kipper Market - Butel", "supermarket", 42.0003, 21.4, "osm", None, None, 0), (5, "x", "house", 42.0, 21.4, "osm", None, None, 0)]
    got = collapse.nearest_places(spark.createDataFrame([(1, 42.0, 21.4)], "property_id int, lat double, lon double"), spark.createDataFrame(rows, shape), 200.0, 10).orderBy("rn").collect()
    assert [r["poi_name"] for r in got] == ["Еурофарм", "Kipper", "Kipper Market - Butel"] and got[0]["distance_m"] == 11


def test_rest_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (10, "c", "y")], "id int, k string, v string")
    ids = lambda p: [r["id"] for r in rest_query(df, {"select": "id", "order": "id.asc", **p}).collect()]
    assert ids({}) == [1, 10, 2] and ids({"v": "is.null"}) == [1] and ids({"id": "gt.1"}) == [10, 2]
    assert ids({"or": "(k.eq.a,v.eq.y)"}) == [1, 10] and ids({"k": "in.(b,c)", "limit": "1", "offset": "1"}) == [2]
