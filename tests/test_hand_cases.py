"""Cases by hand of the guard, payloads, variants, schedules and gates, next to the queries over whole tables."""

from cartolex.operators import anchors, landmarks
from cartolex.plans import coverage, cron
from cartolex.sources import capture

GUARDS = [
    (1, "ул. Борис Трајковски 12, Скопје", 41.98, 21.43, "Boris Trajkovski 12", "Boris Trajkovski 12, Skopje 1000", 20.0, None, True, "ok", True),
    (2, "Партизански Одреди 62", 41.98, 21.43, None, "Skopje, North Macedonia", None, None, False, "area_level_result", False),
    (3, "Партизански Одреди 62", 43.98, 21.43, "Partizanski Odredi", "Partizanski Odredi 62", None, None, False, "outside_bbox", False),
    (4, "Партизански Одреди 62", 41.99, 21.43, "Ilindenska Street", "Ilindenska 5, Skopje", None, None, False, "query_mismatch", False),
    (5, "Партизански Одреди 62", 41.99, 21.43, "Partizanski Odredi", "Bul. Partizanski Odredi 60", 700.0, None, False, "street_disagreement", False),
    (6, "Партизански Одреди 62", 41.99, 21.43, "Partizanski Odredi", "Bul. Partizanski Odredi 60", 100.0, 900.0, False, "poi_disagreement", False),
    (7, "Партизански Одреди 62", None, None, "x", "y", None, None, False, "no_evidence", False),
    (8, "Партизански Одреди 62", 41.99, 21.43, None, None, None, None, False, "no_evidence", False),
    (9, "Карпош 3, Скопје, Северна Македонија", 41.99, 21.40, "Карпош 3", "Карпош, Скопје", None, None, True, "ok", False),
]

PAYLOADS = [
    (1, '{"title": " City Mall ", "type": "Shopping mall", "gps_coordinates": {"latitude": 42.0, "longitude": 21.4}, "data_cid": "16634210817354128158", "reviews": 120, "rating": 4.5, "price": "$$", "types": ["a", "b"]}', "City Mall", "0xe6d8969b:0x475a5b1e", 0),
    (2, '{"title": "X", "gps_coordinates": {"latitude": 42.0, "longitude": 21.4}}', None, None, 0),
    (3, '{"title": "No point"}', None, None, 0),
    (4, '{"title": "Gone", "gps_coordinates": {"latitude": 42.0, "longitude": 21.4}, "data_id": "0x1:0x2", "business_status": "CLOSED_PERMANENTLY"}', "Gone", "0x1:0x2", 1),
    (5, "no json", None, None, 0),
    (6, '{"title": "Small id", "gps_coordinates": {"latitude": 42.0, "longitude": 21.4}, "data_cid": "255", "permanently_closed": true}', "Small id", "0x0:0xff", 1),
]

TWINS = [(1, "Сити Мол", 42.0, 21.4), (2, "City Mall", 42.0001, 21.4), (3, "Аптека Здравје", 42.01, 21.4), (4, "Pharmacy Zdravje", 42.0101, 21.4), (5, "Капитол Центар", 42.02, 21.4), (6, "Capitol Plaza", 42.0201, 21.4), (7, "Бел Дом", 42.03, 21.4), (8, "White Dom", 42.0301, 21.4), (9, "Far Dom", 42.04, 21.4)]
CRON = ["@reboot run # BOOT", "*/5 * * * * sync-prices", "0 3 * * * refresh-map", "# 0 3 * * * refresh-map", "", "0 1 * * * other"]
GATES = [(1, 510, 2000, True, 3, 0), (2, 510, 13, True, 3, 0), (3, 2000, 2000, True, 1, 0), (4, 510, None, False, 8, 0), (5, 510, None, False, 1, 0), (6, 1900, 2000, True, 2, 200)]


def test_guard(spark):
    rows = spark.createDataFrame([g[:8] for g in GUARDS], "id int, query string, lat double, lon double, title string, address string, street_distance_m double, poi_distance_m double")
    got = landmarks.assess_geocode(rows).orderBy("id").select("trusted", "reason", "exact_building").collect()
    assert [tuple(r) for r in got] == [tuple(g[8:]) for g in GUARDS]


def test_payloads(spark):
    got = capture.capture_pois(spark.createDataFrame([p[:2] for p in PAYLOADS], "id int, payload string")).orderBy("id").select("id", "name", "place_id", "closed").collect()
    assert [tuple(r) for r in got] == [(p[0], *p[2:]) for p in PAYLOADS if p[2]]


def test_variants(spark):
    got = anchors.harvest_variants(spark.createDataFrame(TWINS, "poi_id long, name string, p_lat double, p_lon double")).collect()
    assert sorted(map(tuple, got)) == [("bl", "t", 1), ("ptk", "frmk", 1), ("sntr", "pls", 1)]


def test_schedule(spark):
    lines = cron.classify_lines(spark.createDataFrame([(i, c) for i, c in enumerate(CRON)], "line_no int, raw string"), boot="BOOT", sync=["sync-"], forbidden=["refresh-map"])
    got = lines.orderBy("line_no").collect()
    assert [(r["kind"], r["active"]) for r in got] == [("boot", True), ("sync", True), ("forbidden", True), ("forbidden", False), ("other", False), ("other", True)]
    left = cron.strip_forbidden(lines)
    assert sorted(r["line_no"] for r in left.collect()) == [0, 1, 3, 4, 5] and cron.strip_forbidden(left).count() == 5
    required = spark.createDataFrame([("sync-prices",), ("sync-stock",), ("refresh-map",)], "pattern string")
    assert {r["pattern"] for r in cron.missing_sync(left, required).collect()} == {"refresh-map", "sync-stock"}


def test_gates(spark):
    got = coverage.spend_gate(spark.createDataFrame(GATES, "id int, estimated int, live int, probe_ok boolean, keys int, floor int")).orderBy("id").collect()
    assert [(r["budget"], r["basis"], r["go"]) for r in got] == [(2000, "live", True), (13, "live", False), (2000, "live", True), (2000, "nominal", True), (250, "nominal", False), (2000, "live", False)]
