"""Many points of one name, all different: searches stay near, whatever the name; names' own work is done once for each."""

from pyspark.sql import functions as F

from cartolex.functions.text import street_key
from cartolex.operators import evidence, identity, landmarks, lookup, spatial
from tests.test_repeats import widest
from tests.test_upkeep import metres

N = 1500


def line(spark, key, lat, lon, n=N):
    """n points, a kilometre of latitude apart."""
    return spark.range(n).select(F.col("id").alias(key), (F.col("id") * 0.01 + 40.0).alias(lat), F.lit(21.4).alias(lon))


def test_twins_of_one_name(spark):
    e = line(spark, "poi_id", "p_lat", "p_lon").select((F.col("poi_id") + 10_000).alias("poi_id"), F.lit("Bolt!").alias("name"), F.lit("park").alias("type"), "p_lat", "p_lon", F.lit(None).cast("string").alias("place_id"))
    l = e.withColumn("poi_id", F.col("poi_id") - 10_000).withColumn("name", F.lit("bolt")).withColumn("place_id", F.lit("x"))
    rows, most = widest(identity.geometry_twins(l, e.unionByName(e.where("poi_id = 10007").withColumn("poi_id", F.lit(90_000).cast("long")))))
    assert {(r["legacy_id"], r["element_id"], r["fate"]) for r in rows} == {(i, i + 10_000, "adopted") for i in range(N) if i != 7}
    assert most < 10 * N


def test_pairs_anywhere_on_the_globe(spark):
    left = [(0, 89.99999, 10.0), (1, 60.0, 180.0), (2, 0.0, 0.0), (3, -45.0, 30.0), (4, None, 1.0)]
    right = [(0, 89.99999, -170.0), (1, 60.0, -179.99999), (2, 0.00002, 0.0), (3, -45.0, 30.00004), (4, 0.0, 1.0)]
    l, r = spark.createDataFrame(left, "i int, lat double, lon double"), spark.createDataFrame(right, "j int, p_lat double, p_lon double")
    for wide in (2.0, 16.0):
        got = {(x["i"], x["j"]) for x in spatial.sphere_join(l.withColumn("n", F.lit(1)), r.withColumn("n", F.lit(1)), 3.0, ["n"], wide=wide).collect()}
        assert got == {(i, j) for i, a, b in left for j, c, d in right if a is not None and metres(a, b, c, d) <= 3.0} and len(got) >= 3


def test_anchors_of_one_name(spark):
    words = line(spark, "word_id", "lat", "lon").withColumn("word", F.lit("Капитол"))
    rows, most = widest(lookup.find_anchors(words, line(spark, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Капитол"))))
    assert {(r["word_id"], r["poi_id"], r["distance_m"]) for r in rows} == {(i, i, 0) for i in range(N)}
    assert most < 10 * N


def test_settlements_of_one_name(spark):
    needles = line(spark, "needle_id", "center_lat", "center_lon").withColumn("text", F.lit("Bolt"))
    rows, most = widest(lookup.settlements_named(needles, line(spark, "poi_id", "p_lat", "p_lon").where("poi_id % 20 < 19").withColumn("name", F.lit("Bolt"))))
    assert len(rows) == N and all(r["poi_id"] == r["needle_id"] for r in rows if r["needle_id"] % 20 < 19)
    assert all(abs(r["poi_id"] - r["needle_id"]) == 1 for r in rows if r["needle_id"] % 20 == 19)
    assert most < 10 * N


def test_distances_to_one_street(spark):
    asked = line(spark, "id", "lat", "lon").withColumn("query", F.lit("ul. Ilindenska 5"))
    at = line(spark, "k", "lat", "lon").select(street_key(F.lit("ul. Ilindenska")).alias("key"), (F.col("lat") + 0.001).alias("lat"), "lon")
    rows, most = widest(evidence.cross_distances(asked, at, line(spark, "poi_id", "p_lat", "p_lon").withColumn("name", F.lit("Red Bolt"))))
    assert len(rows) == N and all(abs(r["street_distance_m"] - metres(40.0, 21.4, 40.001, 21.4)) < 0.01 and r["poi_distance_m"] is None for r in rows)
    assert most < 10 * N


def test_guard_works_on_distinct_texts(spark):
    rows = spark.range(2000).select(F.col("id"), F.lit("ul. Ilindenska 5").alias("query"), F.lit(41.99).alias("lat"), F.lit(21.43).alias("lon"), F.when(F.col("id") % 2 == 0, "Ilindenska").alias("title"), F.lit("Ilindenska 5, Skopje").alias("address"), F.lit(None).cast("double").alias("street_distance_m"), F.lit(None).cast("double").alias("poi_distance_m"))
    out = landmarks.assess_geocode(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("trusted and exact_building").count() == 2000 and out.columns[:8] == rows.columns
    assert "Aggregate [" in plan and "Repartition" in plan
