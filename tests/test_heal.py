"""Identities by rounds of offers against rows that choose one after the other."""

import random

from pyspark.sql import functions as F

from cartolex.operators import heal
from cartolex.operators.identity import same_place_tier
from cartolex.operators.repair import contradict, tenant_absorbs_venue
from tests.test_cascade import metres

NAMES = ["Biser Shopping Center", "Бисер", "Anhoch Бисер", "Rekord", "Рекорд", "Rekord Market", "Embassy of Turkey", "Амбасада на Турција", "Embassy of Greece", "Амбасада на Грција конзуларна", "City Park", "Градски парк"]
TYPES = ["mall", "shop", "park", None, "embassy"]
SHAPE = "osm_id long, name string, type string, lat double, lon double"
ANCHORS = "anchor_id long, anchor_name string, anchor_type string, p_lat double, p_lon double"


def made(seed=4, n=160, m=50):
    rng = random.Random(seed)
    spot = lambda: (round(41.99 + rng.random() * 0.004, 6), round(21.42 + rng.random() * 0.004, 6))
    osm = [(i * 2, rng.choice(NAMES), rng.choice(TYPES), *spot()) for i in range(n)]
    osm += [(1001 + i, *osm[i % 7][1:]) for i in range(20)] + [(2000, "Бисер", "shop", None, None), (2001, "Embassy of Turkey", None, None, None)]
    anchors = [(i, rng.choice(NAMES), rng.choice(TYPES), *spot()) for i in range(m)]
    anchors = [a for a in anchors if "Turkey" not in a[1] and "Турција" not in a[1]] + [(500, "Embassy of Turkey", "embassy", 42.0, 21.43)]
    anchors += [(600 + i, *anchors[i % 5][1:]) for i in range(12)] + [(700, "Rekord", None, None, None)]
    return osm, anchors


def test_rounds_equal_a_serial_choice(spark):
    osm, anchors = made()
    o, a = spark.createDataFrame(osm, SHAPE), spark.createDataFrame(anchors, ANCHORS)
    from cartolex.operators.repair import embassy_anchors

    fixed = {r["row_id"]: r["anchor_id"] for r in embassy_anchors(o.select(F.col("osm_id").alias("row_id"), "name"), a.select("anchor_id", F.col("anchor_name").alias("name"), "p_lat", "p_lon")).collect()}
    assert fixed
    pairs = [(*x, *y, metres(x[3], x[4], y[3], y[4])) for x in osm for y in anchors if x[3] is not None and y[3] is not None]
    df = spark.createDataFrame([p for p in pairs if p[-1] <= 150], f"{SHAPE}, {ANCHORS}, d double")
    tier = same_place_tier(F.col("name"), F.col("anchor_name"), F.col("d"), F.lit(False), F.lit(True))
    ok = df.withColumn("t", tier).where("t <> 'none'").where(~contradict(F.col("name"), F.col("anchor_name"))).where(~((F.col("t") == "subset") & tenant_absorbs_venue(F.col("anchor_type"), F.col("type"))))
    reach = {}
    for r in ok.select("osm_id", "anchor_id", "d").collect():
        reach.setdefault(r["osm_id"], []).append((r["d"], r["anchor_id"]))
    want, taken = {}, set()
    for i in sorted(x[0] for x in osm):
        if i in fixed:
            want[i] = (fixed[i], "pin_only" if fixed[i] in taken else "merged")
            taken.add(fixed[i])
            continue
        free = [p for p in reach.get(i, []) if p[1] not in taken]
        if free:
            want[i] = (min(free)[1], "merged")
            taken.add(want[i][0])
    got = {r["osm_id"]: (r["anchor_id"], r["kind"]) for r in heal.heal_whole(o, a, 150.0).collect()}
    assert got == want and {k for _, k in got.values()} == {"merged", "pin_only"} and len(want) > 30
    assert heal.heal_whole(o.limit(0), a, 150.0).count() == 0


def test_one_name_with_very_many_rows(spark):
    """100,000 rows want the same three sets of anchors; places go to the smallest ids in the order of the list."""
    rows = spark.range(100_000).select((F.col("id") * 7 % 100_000).alias("osm_id"), F.lit(0).alias("o")).repartition(8)
    lists = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (0, 7, 3)], "o int, a long, turn int")
    got = sorted((r["osm_id"], r["a"]) for r in heal.settled(rows, lists, spark.createDataFrame([(5, 3), (6, 1), (7, 2)], "a long, room long")).collect())
    assert got == [(0, 5), (1, 5), (2, 5), (3, 6), (4, 7), (5, 7)]


def test_rounds_do_not_grow_with_the_list(spark, monkeypatch):
    """300 rows of one list of 60 sets take one round, not one for each set."""
    rows = spark.range(300).select(F.col("id").alias("osm_id"), F.lit(0).alias("o"))
    lists = spark.range(60).select(F.lit(0).alias("o"), F.col("id").alias("a"), (F.col("id") + 1).cast("int").alias("turn"))
    made = []
    monkeypatch.setattr(heal, "cut", lambda df, name, f=heal.cut: (made.append(name), f(df, name))[1])
    got = {r["osm_id"]: r["a"] for r in heal.settled(rows, lists, spark.range(60).select(F.col("id").alias("a"), F.lit(2).alias("room"))).collect()}
    assert got == {i: i // 2 for i in range(120)} and made.count("held") == 1, made


def test_names_with_nothing_in_common_do_not_meet(spark, monkeypatch):
    """of dense places only those that can agree are compared, and all of them are found."""
    from pyspark.sql import functions as F

    from cartolex.functions.geo import distance_m
    from cartolex.operators import identity

    met, join = [], identity.radius_join
    monkeypatch.setattr(identity, "radius_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    names = ["Alfa Market", "Market Alfa", "Alfa Market Karpos", "Karpos", "Embassy of Turkey", "Turkish Embassy", "Embassy of Greece", "abc", "abc def", "Alfa Market 3", "", *[f"{c}{d}lenta" for c in "bdfgklmnp" for d in "aeiou"]]
    rows = [(n * 10 + i, name, 41.98 + i * 0.0002, 21.43 + i * 0.0001) for n, name in enumerate(names) for i in range(4)]
    o = spark.createDataFrame(rows, "osm_id long, name string, lat double, lon double")
    a = spark.createDataFrame([(i + 5000, *r) for i, *r in rows], "anchor_id long, anchor_name string, p_lat double, p_lon double")
    traits, d = identity.name_traits, distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    plain = o.withColumn("x", traits(F.col("name"))).crossJoin(a.withColumn("y", traits(F.col("anchor_name")))).withColumn("d", d).where("d <= 120")
    plain = plain.where(identity.tier_of(F.col("x"), F.col("y"), F.col("d"), F.lit(False), F.lit(True)) != "none")
    want = {(r["osm_id"], r["anchor_id"]) for r in plain.select("osm_id", "anchor_id").collect()}
    seen, alike = [], identity.heal_alike
    monkeypatch.setattr(identity, "heal_alike", lambda osm, anchors, pairs: seen.append(pairs) or alike(osm, anchors, pairs))
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    healed = identity.heal_places(o, a).collect()
    assert {(r["o"], r["a"]) for r in seen[0].collect()} == want and len(want) > 16 * len(names)
    assert len({r["anchor_id"] for r in healed}) == len(healed) > 4 * len(names) - 10
    assert sum(m.count() for m in met) < 3 * len(want)
