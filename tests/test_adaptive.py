"""Growing radii by hand: shops step aside, ranks in tiers, short names, centres that stay open."""

from cartolex.operators import landmarks

POIS = [(1, "Shop", "boutique", 42.0005, 21.4), (2, "Cafe", "cafe", 42.0008, 21.4), (3, "Big Mall", "mall", 42.002, 21.4), (4, "School", "school", 42.1005, 21.4), (5, "Mall", "mall", 42.1009, 21.4), (6, "Only Shop", "boutique", 42.203, 21.4), (7, "ab", "mall", 42.3001, 21.4), (8, "Far", "park", 42.408, 21.4), (9, "Stop", "bus_station", 42.5001, 21.4)]


def test_growing_radii(spark):
    pois = spark.createDataFrame([(i, n, t, a, b, "osm", 0, 0) for i, n, t, a, b in POIS], "poi_id long, name string, type string, p_lat double, p_lon double, source string, review_count int, closed int")
    centres = spark.createDataFrame([(1, 42.0, 21.4), (2, 42.1, 21.4), (3, 42.2, 21.4), (4, 42.3, 21.4), (5, 42.4, 21.4), (6, 42.5, 21.4), (7, 43.0, 21.4), (8, None, None)], "property_id long, lat double, lon double")
    got = {r["property_id"]: (r["landmark"], r["radius_m"]) for r in landmarks.adaptive_landmark(centres, pois).collect()}
    # 4 finds a place without a name worth saying and looks no further; 7 and 8 have nothing
    assert got == {1: ("Cafe", 150), 2: ("Mall", 150), 3: ("Only Shop", 400), 5: ("Far", 1000), 6: ("Stop", 150)}
    assert landmarks.adaptive_landmark(centres.limit(0), pois).count() == 0
