"""A drain's effects and counters by hand, and ordered sums without one task."""

import random

import pytest
from pyspark.sql import Observation

from cartolex.plans import queue
from cartolex.sources import mapsink
from cartolex.tables import running


def test_effects(spark, tmp_path):
    q = spark.createDataFrame([(1, "no_landmark"), (2, "center_mismatch"), (3, "no_landmark"), (4, "no_landmark"), (5, "no_landmark"), (6, "no_landmark"), (7, "no_landmark"), (99, "poison_sweep")], "property_id long, reason string")
    props = spark.createDataFrame([(1, "ul. A 1", 42.0, 21.4, "stored"), (2, "ul. B 2", 42.0, 21.4, "stored"), (3, "", None, None, None), (4, "ul. C 3", None, None, None), (5, "ul. C 3", None, None, None), (6, "ul. D 4", None, None, None), (7, "ul. E 5", None, None, None)],
                                  "property_id long, address string, lat double, lon double, geo_source string")
    offline = spark.createDataFrame([(2, 42.01, 21.41, True, "osm_building"), (4, 42.0, 21.4, False, "osm_street_anchor")], "property_id long, m_lat double, m_lon double, m_trusted boolean, m_source string")
    paid = spark.createDataFrame([(4, 42.0, 21.42, True, True), (5, 42.0, 21.42, True, True), (6, 42.0, 21.42, False, False), (7, 42.0, 21.42, True, False)], "property_id long, g_lat double, g_lon double, g_trusted boolean, g_exact boolean")
    ring = spark.createDataFrame([(1, 1, "Park"), (1, 2, "Mall"), (3, 1, "Zoo"), (5, 1, "Fort"), (7, 1, "Gate"), (99, 1, "None")], "property_id long, slot int, landmark string")
    known = spark.createDataFrame([("ul. E 5", "street"), ("ul. C 3", "street")], "address string, kind string")
    seen = Observation("drain")
    out = queue.drain_effects(q, props, offline, paid, ring, known, searches_left=3, counted=seen)
    rows = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in out[name].collect())
    assert rows("patches", "property_id", "lat", "geo_source") == [(2, 42.01, "osm_building"), (4, 42.0, "google_cached"), (5, 42.0, "google_cached")]
    assert rows("learned", "address", "kind") == [("ul. C 3", "building")]
    assert rows("cached", "property_id", "landmark") == [(1, "Park"), (5, "Fort")]
    assert rows("queue", "property_id", "reason") == [(7, "no_landmark")]
    want = dict(zip(queue.COUNTERS, (7, 2, 1, 2, 1, 1, 1, 1), strict=True))
    assert out["counters"].first().asDict() == want and {c: seen.get[c] for c in queue.COUNTERS} == want
    at = str(tmp_path / "drain")
    assert queue.commit_drain(out, at, 0) == 1 and mapsink.read(spark, at, "queue").count() == 1
    with pytest.raises(mapsink.StaleVersion):
        queue.commit_drain(out, at, 0)
    again = queue.drain_effects(out["queue"], props, offline, paid, ring, known, searches_left=3)
    assert again["counters"].first()["google_upgraded"] == 1 and again["counters"].first()["map_learned"] == 0
    assert queue.drain_effects(q.limit(0), props, offline, paid, ring, known, 3)["counters"].first()["processed"] == 0


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 50), rng.choice([None, 0, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a int, cost int").repartition(7)
    got = {r["k"]: (r["pos"], r["spent"]) for r in running(df, ["a", "k"], "cost").collect()}
    total, want = 0, {}
    for pos, (k, _, cost) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += cost or 0
        want[k] = (pos, total)
    assert got == want
    tasks = spark.createDataFrame([(i, 3) for i in range(10)], "pos int, cost int")
    assert sorted(r["pos"] for r in queue.budget_prefix(tasks, 10).collect()) == [0, 1, 2]
    assert running(df.limit(0), ["a"], "cost").count() == 0
