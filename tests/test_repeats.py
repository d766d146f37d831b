"""Copies of points and names are compared once: right rows, and no join that grows with copies times copies."""

import math
import random
import re

from pyspark.sql import functions as F

from cartolex.functions import lexicon as L
from cartolex.functions.text import street_key, type_rank
from cartolex.operators import anchors, collapse, evidence, identity, imports, landmarks, lookup, spatial
from tests.test_upkeep import metres


def widest(df):
    """The rows, and the most rows that a join of their plan has put out."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def sorted_rows(df):
    """The most rows that a sort of the plan has taken in."""
    df.collect()
    most, todo = 0, [(df._jdf.queryExecution().executedPlan(), False)]
    while todo:
        node, below = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append((node.executedPlan(), below))
        elif kind.endswith("QueryStageExec"):
            todo.append((node.plan(), below))
        if below and node.metrics().contains("numOutputRows"):
            most, below = max(most, node.metrics().apply("numOutputRows").value()), False
        below = kind == "SortExec" or below and "Exchange" not in kind
        todo += [(node.children().apply(i), below) for i in range(node.children().size())]
    return most


def grid(spark, n, key, lat, lon):
    """n rows on 100 points, no two as far apart as two others around them."""
    i, j = F.col("id") % 10, (F.col("id") / 10).cast("long") % 10
    return spark.range(n).select(F.col("id").alias(key), (42.0 + i * 0.001 + i * i * 0.00003).alias(lat), (21.4 + j * 0.00107 + j * j * 0.00001).alias(lon))


def test_nearest_area_of_many_copies(spark):
    points, areas = grid(spark, 2000, "property_id", "lat", "lon"), grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("a"))
    rows, most = widest(spatial.area_at(points, areas))
    assert {r["property_id"]: (r["poi_id"], r["distance_m"]) for r in rows} == {i: (i % 100, 0) for i in range(2000)}
    assert most < 30_000


def test_nearest_area_at_any_latitude_and_distance(spark):
    rng = random.Random(5)
    for centre in (0.0, 42.0, 70.0, -84.0):
        at = lambda n: [(i, centre + rng.uniform(-0.03, 0.03), 21.4 + rng.uniform(-0.04, 0.04)) for i in range(n)]  # noqa: E731, B023
        left, right = [*at(60), (60, None, 21.4), (61, centre, 25.0)], at(25)
        got = spatial.area_at(spark.createDataFrame(left, "property_id long, lat double, lon double"), spark.createDataFrame([(*r, "a") for r in right], "poi_id long, p_lat double, p_lon double, name string"))
        want = {}
        for i, lat, lon in left:
            near = sorted((metres(lat, lon, la, lo), j) for j, la, lo in right if abs(la - lat) <= 2500 / 111000 and abs(lo - lon) <= 2500 / 82000) if lat is not None else []
            want[i] = next((j for d, j in near if d <= 2500), None)
        assert {r["property_id"]: r["poi_id"] for r in got.collect()} == want


def test_anchors_of_many_copies(spark):
    words = grid(spark, 2000, "word_id", "lat", "lon").withColumn("word", F.when(F.col("word_id") % 2 == 0, "Капитол").otherwise("zzz"))
    words = words.unionByName(spark.createDataFrame([(5000, None, 21.4, "Капитол")], "word_id long, lat double, lon double, word string"))
    rows, most = widest(lookup.find_anchors(words, grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Капитол"))))
    assert {r["word_id"]: (r["poi_id"], r["name"], r["distance_m"]) for r in rows} == {i: (i % 100, "Капитол", 0) for i in range(0, 2000, 2)}
    assert most < 30_000


def places(spark, n):
    """n places on 100 points, of 7 names; those of one point differ by reviews alone, a few are closed or stops."""
    k = F.col("poi_id")
    kind = F.when(k % 11 == 0, "bus_station").when(k % 13 == 0, "house").otherwise(F.get(F.array(F.lit("cafe"), F.lit("mall")), (k % 2).cast("int")))
    return grid(spark, n, "poi_id", "p_lat", "p_lon").select("*", F.concat(F.lit("n"), (k % 7).cast("string")).alias("name"), kind.alias("type"), F.lit("osm").alias("source"), (k % 5).cast("int").alias("review_count"), (k % 17 == 0).cast("int").alias("closed"))


def ring(places, lat, lon, radius):
    """A ranked ring in plain Python: rows in order."""
    rank = {"mall": 5, "bus_station": 3, "cafe": 1}
    prom = lambda r: -1.0 if r["closed"] else math.log10(r["review_count"] + 1.0)
    near = [(r["type"] == "bus_station", -rank.get(r["type"], 0), d, -prom(r), r["name"], r["poi_id"]) for r in places if r["type"] != "house" and (d := metres(lat, lon, r["p_lat"], r["p_lon"])) <= radius]
    return sorted(near)


def test_import_of_many_copies(spark):
    centres, pois = grid(spark, 2000, "property_id", "lat", "lon"), places(spark, 3000)
    centres = centres.unionByName(spark.createDataFrame([(9000, 43.0, 21.4)], "property_id long, lat double, lon double"))
    near = spatial.nearest_pois(centres, pois, 200.0, 1)
    answers = centres.select("*", F.lit("osm_building").alias("source"), F.lit(True).alias("trusted"))
    rows, most = widest(imports.import_geo(centres.select("property_id", F.lit("a").alias("address")), answers, near))
    assert {r["property_id"]: (r["cached"], r["queue"]) for r in rows} == {**{i: (True, None) for i in range(2000)}, 9000: (False, "no_landmark")}
    assert most < 30_000


def test_merged_ring_of_many_copies(spark):
    centres = grid(spark, 2000, "property_id", "lat", "lon")
    pois = places(spark, 1500).withColumn("place_id", F.when(F.col("poi_id") % 3 == 0, F.concat(F.lit("0x1:0x"), F.lower(F.hex("poi_id")))))
    rows, most = widest(collapse.nearest_places(centres, pois, 200.0, 3))
    alone = collapse.nearest_places(centres.where("property_id < 100"), pois, 200.0, 3).collect()
    want = sorted((r["property_id"] + 100 * i, *r[1:]) for r in alone for i in range(20))
    assert sorted(map(tuple, rows)) == want and len({r["property_id"] for r in alone}) == 100
    assert most < 30_000


def test_merged_ring_equals_a_plain_fold(spark):
    rng = random.Random(4)
    kinds = ["Еурофарм", "Eurofarm", "Kipper", "Kipper Market", "Embassy of Turkey", "Амбасада на Турција нова", "Kipper 2", "x"]
    rows = [(i, rng.choice(kinds), rng.choice(["cafe", "mall", "pharmacy"]), 42 + rng.uniform(-0.001, 0.001), 21.4 + rng.uniform(-0.001, 0.001), rng.choice(["osm", "google"]), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 3, 9]), rng.choice([0, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "poi_id long, name string, type string, p_lat double, p_lon double, source string, place_id string, review_count int, closed int")
    tokens = F.array_distinct(collapse.identity_tokens(F.col("name")))
    facts = {r["name"]: (frozenset(r["t"]), r["q"], r["e"], frozenset(r["c"])) for r in df.select("name", tokens.alias("t"), collapse.has_qualifier(F.col("name")).alias("q"), collapse.is_embassy(F.col("name")).alias("e"), collapse.countries_in(tokens).alias("c")).distinct().collect()}
    ranks, found = {"mall": 5, "pharmacy": 3, "cafe": 1}, []
    for r in sorted(({**r.asDict(), "d": metres(42.0, 21.4, r["p_lat"], r["p_lon"]), "rank": ranks[r["type"]], "stop": False} for r in df.collect()), key=lambda r: (r["d"], r["name"], r["poi_id"])):
        r["distance"] = r["d"]

        def same(p):
            if p["place_id"] and p["place_id"] == r["place_id"]:  # noqa: B023
                return True
            within = collapse.agreement(facts[p["name"]], facts[r["name"]])[bool(p["place_id"]) != bool(r["place_id"])]  # noqa: B023
            return within > 0 and metres(p["p_lat"], p["p_lon"], r["p_lat"], r["p_lon"]) <= within  # noqa: B023

        at = next((p for p in found if same(p)), None)
        if at is None:
            found.append(r)
        else:
            collapse._merge(at, r, 42.0, 21.4)
    prom = lambda p: -1.0 if p["closed"] == 1 else math.log10((p["review_count"] or 0) + 1) + (0.01 if p["source"] == "google" else 0.0)
    want = [p["poi_id"] for p in sorted(found, key=lambda p: (-p["rank"], p["distance"], -prom(p), p["name"], p["poi_id"]))]
    got = collapse.nearest_places(spark.createDataFrame([(1, 42.0, 21.4)], "property_id int, lat double, lon double"), df, 200.0, 1000).orderBy("rn").collect()
    assert [r["poi_id"] for r in got] == want and len(want) < 200


def test_settlements_of_many_copies(spark):
    needles = grid(spark, 2000, "needle_id", "center_lat", "center_lon").withColumn("text", F.when(F.col("needle_id") % 2 == 0, "Bolt").otherwise("zzz"))
    needles = needles.unionByName(spark.createDataFrame([(5000, None, 21.4, "Bolt"), (5001, 42.0, 21.4, None)], "needle_id long, center_lat double, center_lon double, text string"))
    areas = grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.when(F.col("poi_id") % 3 == 0, "Red Bolt").otherwise("Bolt"))
    rows, most = widest(lookup.settlements_named(needles, areas))
    # of the copies of a point the first that is plainly named so; without a centre the first of all
    plain = {i: min(j for j in range(i, 2000, 100) if j % 3) for i in range(100)}
    assert {r["needle_id"]: (r["poi_id"], r["name"]) for r in rows} == {**{i: (plain[i % 100], "Bolt") for i in range(0, 2000, 2)}, 5000: (1, "Bolt")}
    assert most < 30_000


def test_distances_of_many_copies(spark):
    asked = grid(spark, 2000, "id", "lat", "lon").withColumn("query", F.get(F.array(F.lit("ul. Ilindenska 5"), F.lit("Bolt"), F.lit("axe")), (F.col("id") % 3).cast("int")))
    asked = asked.unionByName(spark.createDataFrame([(5000, None, 21.4, "Bolt"), (5001, 42.0, 21.4, None)], "id long, lat double, lon double, query string"))
    at = grid(spark, 2000, "k", "lat", "lon").select(street_key(F.lit("ul. Ilindenska")).alias("key"), "lat", "lon")
    rows, most = widest(evidence.cross_distances(asked, at, grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Red Bolt"))))
    near = {0: (0.0, None), 1: (None, 0.0), 2: (None, None)}
    assert {r["id"]: (r["street_distance_m"], r["poi_distance_m"]) for r in rows} == {**{i: near[i % 3] for i in range(2000)}, 5000: (None, None), 5001: (None, None)}
    assert most < 30_000


def test_slots_of_many_copies(spark):
    centres, pois = grid(spark, 2000, "property_id", "lat", "lon"), places(spark, 3000)
    rows, most = widest(landmarks.nearby_landmarks(spatial.nearest_pois(centres, pois, 200.0, 3, by_name=True)))
    got, every = {}, pois.collect()
    for r in rows:
        got.setdefault(r["property_id"], []).append((r["slot"], r["landmark"]))
    want = [list(enumerate(list(dict.fromkeys(x[-2] for x in ring(every, c["lat"], c["lon"], 200.0)))[:3], 1)) for c in centres.orderBy("property_id").limit(100).collect()]
    assert [sorted(got[i]) for i in range(2000)] == want * 20
    assert most < 30_000


def test_landmark_of_many_copies(spark):
    centres, pois = grid(spark, 2000, "property_id", "lat", "lon"), places(spark, 3000)
    far = spark.createDataFrame([(9000, 43.0, 21.4)], "property_id long, lat double, lon double")
    none = spark.createDataFrame([], "property_id long, landmark string")
    rows, most = widest(anchors.resolve_landmark(centres.unionByName(far), none, none, none, spatial.nearest_pois(centres.unionByName(far), pois, 200.0, 1)))
    every = pois.collect()
    want = [(ring(every, c["lat"], c["lon"], 200.0)[0][-2], "map") for c in centres.orderBy("property_id").limit(100).collect()]
    got = {r["property_id"]: (r["landmark"], r["layer"]) for r in rows}
    assert [got[i] for i in range(2000)] == want * 20 and got[9000] == (None, "none")
    assert most < 30_000


def test_ring_of_one_ranks_rows_that_differ_by_more_than_their_id(spark):
    centres = grid(spark, 100, "property_id", "lat", "lon")
    pois = places(spark, 100).crossJoin(spark.range(100).select((F.col("id") * 1000).alias("_more"))).withColumn("poi_id", F.col("poi_id") + F.col("_more")).drop("_more")
    odd = spark.createDataFrame([(-1, None, None, 42.0, 21.4, None, None, None), (-2, "far", "mall", None, 21.4, "osm", 1, 0)], "poi_id long, name string, type string, p_lat double, p_lon double, source string, review_count int, closed int")
    near = spatial.nearest_pois(centres, pois.select(odd.columns).unionByName(odd), 200.0, 1)
    rows = places(spark, 100).collect()
    want = {c["property_id"]: ring(rows, c["lat"], c["lon"], 200.0)[0][-1] for c in centres.collect()}
    assert {r["property_id"]: r["poi_id"] for r in near.collect()} == want
    assert sorted_rows(near) < 5000


def test_audit_of_many_copies(spark):
    k = F.col("property_id")
    name = F.when(k % 4 == 0, "red bolt").when(k % 4 == 1, "nowhere").when(k % 4 == 2, " ").otherwise("old red bolt")
    entries = grid(spark, 2000, "property_id", "lat", "lon").select("property_id", F.lit(0).alias("pos"), name.alias("landmark"), F.when(k % 3 == 0, 900.0).otherwise(0.0).alias("claimed_m"), F.when(k % 5 != 0, F.col("lat")).alias("lat"), "lon")
    rows, most = widest(landmarks.audit_feed(entries, grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Red Bolt"))))
    want = {}
    for i in range(2000):
        if i % 4 == 0:
            fate = ("no-pin", None) if i % 5 == 0 else ("distance-drift", 0) if i % 3 == 0 else None
        else:
            fate = {1: ("landmark-not-on-map", None), 2: ("landmark-no-name", None), 3: ("landmark-not-on-map", None)}[i % 4]
        if fate:
            want[i] = fate
    assert {r["property_id"]: (r["kind"], r["measured_m"]) for r in rows} == want
    assert most < 30_000


def test_heal_of_many_copies(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/cartolex-tests")
    rng = random.Random(6)
    at = lambda n: [(i, rng.choice(["Kipper", "Bolt"]), 42.0 + rng.randint(0, 4) * 0.0007, 21.4) for i in rng.sample(range(10 * n), n)]
    osm, points = at(400), at(300)
    free, want = dict((r[0], r[1:]) for r in points), {}
    for i, name, lat, lon in sorted(osm):
        near = sorted((d, a) for a, (n, la, lo) in free.items() if n == name and (d := metres(lat, lon, la, lo)) <= 120)
        if near:
            want[i] = near[0][1]
            del free[near[0][1]]
    df = identity.heal_places(spark.createDataFrame(osm, "osm_id long, name string, lat double, lon double"), spark.createDataFrame(points, "anchor_id int, anchor_name string, p_lat double, p_lon double"))
    rows, most = widest(df)
    assert {r["osm_id"]: r["anchor_id"] for r in rows} == want and len(want) == len(rows) > 200
    assert most <= 700


def test_roster_of_many_copies(spark):
    centres = grid(spark, 2000, "property_id", "lat", "lon")
    entry = lambda pos, name, kind, url: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(url).cast("string").alias("url"))
    every = F.array(entry(0, "Red Bolt", "mall", None), entry(1, "Butik X", "boutique", "https://maps.google.com/?q=42.0,21.4"), entry(2, "nowhere", "mall", None), entry(3, None, "mall", None))
    entries = centres.select("property_id", F.explode(every).alias("e")).select("property_id", "e.*")
    pois = grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("red bolt")).unionByName(spark.createDataFrame([(9000, "RED BOLT", None, 21.4)], "poi_id long, name string, p_lat double, p_lon double"))
    malls = grid(spark, 2000, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Mall"))
    rows, most = widest(imports.roster_slots(entries, centres, pois.drop("poi_id"), malls))
    got = {}
    for r in rows:
        got.setdefault(r["property_id"], []).append((r["slot"], r["name"], r["distance_m"]))
    away = {r["property_id"]: metres(r["lat"], r["lon"], 42.0, 21.4) for r in centres.collect()}
    want = {i: [(1, "Red Bolt", 0)] + ([(2, "Mall", math.floor(away[i] + 0.5))] if away[i] <= 200 else []) for i in range(2000)}
    assert {i: sorted(x) for i, x in got.items()} == want
    assert most < 30_000


def test_ring_of_many_copies(spark):
    centres, pois = grid(spark, 2000, "property_id", "lat", "lon"), places(spark, 3000)
    rows, most = widest(spatial.nearest_pois(centres, pois, 200.0, 3))
    got = {}
    for r in rows:
        got.setdefault(r["property_id"], []).append((r["rn"], r["poi_id"], r["distance_m"]))
    every = pois.collect()
    want = [[(n + 1, x[-1], math.floor(x[2] + 0.5)) for n, x in enumerate(ring(every, c["lat"], c["lon"], 200.0)[:3])] for c in centres.orderBy("property_id").limit(100).collect()]
    assert [sorted(got[i]) for i in range(2000)] == want * 20
    assert most < 30_000


def test_rank_of_types(spark):
    norm = lambda t: re.sub(r"\s+", " ", (t or "").strip(" ").lower(), flags=re.ASCII)
    rank = lambda t: max(L.TYPE_RANKS.get(L.TYPE_ALIASES.get(p, p), 0) for p in map(norm, norm(t).split(";")))
    plain = [*L.TYPE_RANKS, *L.TYPE_ALIASES]
    kinds = [None, "", ";", "nowhere", "cafe;", ";mall", " MALL ", "\tcafe", "bus\t stop", *plain, *map(str.upper, plain), *[f"{a} ; {b}" for a, b in zip(plain, plain[7:], strict=False)]]
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, t string").select("i", type_rank(F.col("t")).alias("rank"))
    assert {r["i"]: r["rank"] for r in df.collect()} == {i: rank(t) for i, t in enumerate(kinds)}


def test_plain_types_are_looked_up_without_arrays(spark):
    plan = spark.range(9).select(type_rank(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split(" ELSE ")[-1]
