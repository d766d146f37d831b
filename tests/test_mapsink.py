"""Upserts, versions, stale commits and readers of the map's sink."""

import threading

import pytest

from cartolex.sources import mapsink

ROWS = [("Eуpoфapм", "pharmacy", 42.0, 21.4, "osm", None, None, None, "p1", 0), ("Kipper", "shop", 42.0, 21.4, None, "u1", "a", 5, "p2", 1), ("Kipper Market", "mall", 42.1, 21.5, "google", None, "a", None, "p3", 2),
        ("Other", "cafe", 1.0, 2.0, "google", "u2", "b", 7, None, 3), ("Other", "cafe", 1.0, 2.0, "google", "u3", "b", 8, "p4", 4), (" No  id ", "cafe", 1.0, 2.0, "osm", None, None, None, None, 5), (" No  id ", "cafe", 1.0, 2.0, "osm", None, None, None, None, 6)]
SHAPE = "name string, type string, lat double, lon double, source string, place_url string, place_id string, review_count int, phone string, seq int"


def test_upserts(spark):
    out = mapsink.upserted_pois(spark.createDataFrame(ROWS, SHAPE))
    assert out.columns == mapsink.POI_COLUMNS
    got = sorted((r["place_id"] or "", r["name"], r["type"], r["source"], r["place_url"], r["review_count"], r["phone"], r["closed"]) for r in out.collect())
    assert got == [("", "No id", "cafe", "osm", None, None, None, 0), ("", "No id", "cafe", "osm", None, None, None, 0), ("", "Еурофарм", "pharmacy", "osm", None, None, "p1", 0),
                   ("a", "Kipper Market", "mall", "google", "u1", None, "p2", 0), ("b", "Other", "cafe", "google", "u3", 8, None, 0)]
    assert mapsink.upserted_pois(spark.createDataFrame([], SHAPE)).count() == 0


def test_versions(spark, tmp_path):
    at = str(tmp_path / "map")
    rows = spark.createDataFrame(ROWS, SHAPE)
    pois = mapsink.upserted_pois(rows)
    addresses = mapsink.keyed_addresses(spark.createDataFrame([("Kоце Mеталец", None, 1.0, 2.0)], "street string, housenumber string, lat double, lon double"))
    with pytest.raises(FileNotFoundError):
        mapsink.read(spark, at, "pois")
    assert mapsink.publish({"pois": pois, "addresses": addresses}, at, 0) == 1
    assert mapsink.read(spark, at, "addresses").first()["street"] == "Коце Металец"
    # a rebuild keeps what the version before knows of places with an id
    again = mapsink.rebuilt_pois(spark.createDataFrame([("Fresh", "park", 1.0, 1.0)], "name string, type string, lat double, lon double"), mapsink.read(spark, at, "pois"))
    assert mapsink.publish({"pois": again}, at, 1) == 2
    assert sorted(r["name"] for r in mapsink.read(spark, at, "pois").collect()) == ["Fresh", "Kipper Market", "Other"]
    assert mapsink.read(spark, at, "pois", 1).count() == 5
    with pytest.raises(mapsink.StaleVersion):
        mapsink.publish({"pois": pois}, at, 1)
    assert [n for n, _ in mapsink.versions(spark, at)] == [1, 2]
    # an entry that is not fully written is no version yet
    (tmp_path / "map" / "_versions" / f"{3:012d}").write_text(f"{at}/half")
    assert mapsink.read(spark, at, "pois").count() == 3
    with pytest.raises(mapsink.StaleVersion):
        mapsink.publish({"pois": pois}, at, 2)
    assert mapsink.clean(spark, at, keep=1) == [1] and mapsink.read(spark, at, "pois").count() == 3
    assert len([f for f in (tmp_path / "map").iterdir() if f.name.startswith("v-")]) == 1


def test_of_writers_at_once_one_wins(spark, tmp_path):
    at, won = str(tmp_path / "map"), []
    one = spark.range(3)

    def write():
        try:
            won.append(mapsink.publish({"t": one}, at, 0))
        except mapsink.StaleVersion:
            won.append(None)

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, won)) == ["1", "None", "None", "None"] and mapsink.read(spark, at, "t").count() == 3
