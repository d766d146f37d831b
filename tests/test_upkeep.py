"""Operators without SQL, and edges of those with it, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from cartolex.fixtures import pois, properties
from cartolex.functions import classes
from cartolex.operators import imports, repair
from cartolex.sources import archive

SF = "/root/testdata/sf0.001"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_roster_slots(spark):
    from cartolex.catalog.upkeep import roster_slots

    got = {}
    for r in roster_slots(spark, SF).collect():
        got.setdefault(r["property_id"], []).append((r["slot"], r["name"], r["distance_m"]))
    rows = pois(spark, SF).select("poi_id", "name", "type", "p_lat", "p_lon").collect()
    malls = [r for r in rows if r["type"] == "mall"]
    named = lambda n: (0 if any(w in n.lower().split() for w in ("tc", "mall", "mol", "mallot", "centar", "center", "centre", "trgovski")) else 1)
    want = {}
    for p in properties(spark, SF).collect():
        lat, lon, slots = p["lat"], p["lon"], []
        bolts = [(metres(lat, lon, r["p_lat"], r["p_lon"]), "red bolt") for r in rows if r["name"] == "red bolt"]
        slots += sorted(bolts)[:1]
        a, b = round(lat, 6), round(lon, 6)
        near = sorted((named(m["name"]), d, m["poi_id"], m) for m in malls if (d := metres(a, b, m["p_lat"], m["p_lon"])) <= 250 and abs(m["p_lat"] - a) <= 250 / 111000 and abs(m["p_lon"] - b) <= 250 / 82000)
        if near:
            m = near[0][3]
            slots.append((metres(lat, lon, m["p_lat"], m["p_lon"]), m["name"]))
        slots.append((metres(lat, lon, round(lat + 0.001, 6), b), f"Own {p['property_id']}"))
        out, seen = [], set()
        for d, n in slots:
            if d <= 200 and n.lower() not in seen and len(out) < 3:
                seen.add(n.lower())
                out.append((len(out) + 1, n, math.floor(d + 0.5)))
        if out:
            want[p["property_id"]] = out
    assert {k: sorted(v) for k, v in got.items()} == want


def test_embassies_by_country(spark):
    from cartolex.catalog.upkeep import embassy_anchors

    got = {r["row_id"]: r["anchor_id"] for r in embassy_anchors(spark, SF).collect()}
    # Turkey's row pairs with the embassy, its residence with the residence; Spain's anchor is out of town
    assert got == {1: 1, 2: 4, 3: 3, 4: 4, 6: 8, 7: 7, 8: 8}


def test_teaching_stops(spark):
    plan = spark.createDataFrame([(i, f"s{i}", 1) for i in range(9000)], "pos long, street string, cost long")
    answers = spark.createDataFrame([(i, 42.0, 21.4, i % 2 == 0, i == 8000) for i in range(9000)], "pos long, lat double, lon double, trusted boolean, limited boolean")
    out = {r["pos"]: r["outcome"] for r in imports.teach_streets(plan, answers, 10**6, 10**6, 0).collect()}
    assert out[0] == "taught" and out[1] == "miss" and out[7999] == "miss" and {out[i] for i in range(8000, 9000)} == {"limited"}
    out = imports.teach_streets(plan, answers, 5000, 10**6, 0).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in out} == {"taught": 2500, "miss": 2500, "cap": 4000}


def test_donations_take_the_last_that_has_one(spark):
    shape = "survivor_id int, poi_id int, seq int, " + ", ".join(f"{c} string" for c in repair.DONATED) + ", review_count int, rating double"
    row = lambda i, seq, phone, reviews, rating: (1, i, seq, phone, *[None] * 6, reviews, rating)
    rows = spark.createDataFrame([row(1, None, "", 0, None), row(2, 1, "a", 5, 1.0), row(3, 2, "b", 0, None), row(4, 3, None, None, 4.0)], shape)
    (r,) = repair.donations(rows).collect()
    assert (r["phone"], r["review_count"], r["rating"], r["website"]) == ("b", 5, 4.0, None)


def test_backup_keeps_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, [1, 2], {"a": "b"}, None), (2, None, None, None, "é\n\"")], "id long, b boolean, l array<int>, m map<string,string>, s string")
    at = archive.backup(rows, str(tmp_path))
    back = archive.restore(spark, at, "id long, b boolean, l array<int>, m map<string,string>, s string")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    lines = spark.read.text(at).collect()
    assert any('"b":"1"' in r[0] for r in lines)


@pytest.mark.parametrize("word,want", [("медицинското", "медицинско"), ("градежниот", "градежн"), ("тато", "тато"), ("институтот", "институт"), ("x", "x")])
def test_articles(spark, word, want):
    assert spark.range(1).select(classes.without_article(F.lit(word)).alias("w")).first()["w"] == want
