"""The whole name lookup against a plain walk through its passes over collected features."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cartolex.catalog import lookups, service
from cartolex.functions import forms
from cartolex.functions import lexicon as L
from cartolex.operators import cascade

NAMES = ["Трговски центар Капитол", "Ramstore - Kapitol", "ТЦ Капитол", "Карпош", "Карпош 3", "Хотел Карпош", "Biser Shopping Center", "Бисер Травел", "Skopje City Mall", "City Mall Food Court",
         "ГТЦ Кула 1", "Градски трговски центар (ГТЦ)", "Литература Store - Diamond mall (Дајмонд мол)", "Diamond Mall", "Civil - Diamond Mall", "Leptokarija", "ТЦ Лептокарија", "Leptokarija Mall",
         "Католичка црква", "Воена академија", "Болница 8ми Септември", "ГОБ 8-ми Септември", "Embassy of Turkey", "Медицинско училиште", "Економски факултет", "KAM Market", "KAN Market", "Џевахир кула А",
         "Shopping Center Bunjakovec", "KAM Market - Bunjakovec Shopping Center", "Суто Оризари", "Ria Shutka (suto orizari)", "Butik Mara", "Комерцијална банка", "Image Plus", "Apartmani Skopje", "red bolt", "bolt red"]
TYPES = ["mall", "bus_station", "bank", "residential", "suburb", "boutique", "park", "hospital", "supermarket", "yes", "holiday apartment", "city"]
NEEDLES = ["Капитол", "КАПИТОЛ", "kapitol", "ТЦ Капитол", "Карпош", "KARPOS", "karpos 3", "Бисер", "biser", "city mall", "ГТЦ", "дајмонд мол", "Diamond Mall", "dajmond mol", "Лептокарија", "leptokarija", "католичка",
           "KATOLICKA", "воена болница", "VOENA BOLNICA", "турска амбасада", "медицинското", "Bunjakovec trgovski", "suto orizari", "Butik Mara", "Mara", "кај банката", "има", "ИМА", "sajt", "za iznajmuvanje",
           "APARTMAN", "red bolt", "bolt", "red boltt", "KAL Market", "tc dzevahir", "Diamant Mall", "Sity Mol ' Ruski Zgradi", "автобус до ТЦ Капитол", "image", "mage", "trgovskiot centar", "Kapitoll", "", "  ", "...", "ri"]


def metres(a, b, c, d):
    r = math.radians
    return 2 * 6371000.0 * math.asin(math.sqrt(math.sin(r(c - a) / 2) ** 2 + math.cos(r(a)) * math.cos(r(c)) * math.sin(r(d - b) / 2) ** 2))


def aligned(hay, needle):
    if len(needle) < 3:
        return False
    for m in re.finditer(re.escape(needle), hay):
        before, after = hay[m.start() - 1 : m.start()], hay[m.end() : m.end() + 1]
        if not before.isalnum() and (not after.isalnum() or len(needle) >= 4):
            return True
    # matches that overlap
    return any(hay.startswith(needle, i) and not hay[i - 1 : i].isalnum() and (len(needle) >= 4 or not hay[i + 3 : i + 4].isalnum()) for i in range(len(hay)))


def slip(x, y):
    if len(x) < 5 or len(y) < 5 or x[0] != y[0]:
        return False
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        d = [i for i in range(len(x)) if x[i] != y[i]]
        return len(d) <= 1 or (len(d) == 2 and d[1] == d[0] + 1 and x[d[0]] == y[d[1]] and x[d[1]] == y[d[0]])
    a, b = sorted((x, y), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


class Plain:
    """One ask after the other, row by row; what words fold to comes from the features of both sides."""

    def __init__(self, rows, feats, latin, said):
        self.rows = [r | feats[r["name"], r["type"]] for r in rows]
        self.latin, self.said = latin, said

    def slips(self, a):
        if not a["a_typed"]:
            return []
        bare = lambda w: re.sub("[^a-z0-9]", "", self.latin[w])
        out = []
        for r in self.rows:
            if r["shop"] or (a["a_cat"] and r["cat"] and a["a_cat"] != r["cat"]):
                continue
            used = []
            for w, k in zip(a["a_typed"], a["a_typed_keys"], strict=True):
                free = [i for i in range(len(r["typed"])) if i not in used]
                at = [i for i in free if r["typed_keys"][i] == k]
                at = at or [i for i in free if len(w) >= 5 and len(r["typed"][i]) >= 5 and bare(w) and (bare(w) == bare(r["typed"][i]) or slip(bare(w), bare(r["typed"][i])))]
                if not at:
                    break
                used.append(at[0])
            else:
                out.append(r)
        return out

    def far(self, a, r):
        return metres(a["c_lat"], a["c_lon"], r["p_lat"], r["p_lon"]) if a["c_lat"] is not None else len(r["name"])

    def first(self, a, rows, key):
        return sorted(rows, key=lambda r: (*key(r), self.far(a, r), len(r["name"]), r["name"], r["type"] or "", r["poi_id"]))

    def core(self, a):
        ok = [r for r in self.rows if not (a["a_cat"] and r["cat"] and a["a_cat"] != r["cat"])]
        hits = [r for r in ok if any(aligned(h, n) for h, n in ((r["low"], a["n"]), (r["low"], a["n_cyr"]), (r["spelled"], a["n"]), (r["spelled"], a["n_lat"])))]
        rows, shops = [r for r in hits if not r["shop"]], [r for r in hits if r["shop"]]
        if not re.search(cascade.ASKS_STOP[5:], a["clean"], re.I):
            others = [r for r in rows if not r["stop"]]
            if others and (a["c_lat"] is None or any(self.far(a, r) <= 1000 for r in others)):
                rows = others
        for flag in ("service", "home"):
            rows = [r for r in rows if not r[flag]] or rows
        number = 1
        if not rows and len(a["words"]) > 2:
            number = 2
            two = [" ".join(x).lower() for x in (a["words"][:2], a["words"][-2:])]
            two = [t for t in two if len(t) >= 3]
            for t in two + [self.latin[t, "cyr"] for t in two]:
                rows = [r for r in ok if t in r["low"] or t in r["spelled"]]
                if rows:
                    break
        if rows:
            for r in rows:
                names = [a["n"], a["n_cyr"]]
                r["mr"] = 0 if r["low"] in names or r["spelled"] == a["n_sp"] else 1 if any(re.search(rf"[（(]\s*{re.escape(n)}\s*[)）]", r["name"], re.I) for n in names) else 2 if any(r["low"].startswith(n) for n in names) or r["spelled"].startswith(a["n_sp"]) else 3
            mall = L.TYPE_RANKS["mall"]
            if not re.search(cascade.ASKS_TENANT[5:], a["clean"], re.I) and any(r["mr"] == 3 and r["rank"] >= mall for r in rows):
                rows = [r for r in rows if r["mr"] != 3 or r["rank"] >= mall]
            wn = lambda r: int(not self.said[a["clean"]] or self.said[a["clean"]] != r["sounds"])
            key = lambda r: (any(t in cascade.PART_WORDS and t not in a["tokens_all"] for t in r["tokens"]), r["mr"], wn(r), not (wn(r) == 0 and r["area"]), -r["rank"] if a["c_lat"] is None and r["mr"] == 2 else 0)
            return number, self.first(a, rows, key)[0]
        venues = [r for r in ok if not r["shop"]]
        if a["a_tokens"] and all(len(w) >= 3 for w in a["a_tokens"]):
            rows = [r for r in venues if set(a["a_tokens"]) <= set(r["tokens"])]
            if rows:
                return 3, self.first(a, rows, lambda r: (len(r["tokens"]) - len(a["a_tokens"]), -r["rank"]))[0]
        if len(a["clean"]) >= 5:
            if a["a_phon"]:
                rows = [r for r in venues if set(a["a_phon"]) <= set(r["phon"])]
                asks_mall = bool({w for w in re.split(r"[\W_]+", a["clean"].lower())} & set(cascade.MALL_WORDS))
                if rows:
                    return 4, self.first(a, rows, lambda r: (asks_mall and r["building"], len(r["phon"]) - len(a["a_phon"]), int(not self.said[a["clean"]] or self.said[a["clean"]] != r["sounds"]), not r["area"]))[0]
            rows = self.first(a, self.slips(a), lambda r: (len(r["typed"]),))
            if rows and not (len(rows) > 1 and len(rows[0]["typed"]) == len(rows[1]["typed"]) and rows[0]["ident"] != rows[1]["ident"]):
                return 5, rows[0]
            if a["a_canon"]:
                rows = [r for r in venues if set(a["a_canon"]) <= set(r["canon"])]
                if rows:
                    return 6, self.first(a, rows, lambda r: (len(r["phon"]) - len(set(a["a_canon"])),))[0]
        return (7, self.first(a, shops, lambda r: (len(r["name"]),))[0]) if shops else None


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(6)
    rows = []
    for i, (n, _) in enumerate(itertools.product(NAMES, range(3))):
        rows.append({"poi_id": i, "name": n, "type": rng.choice([*TYPES, "mall", None]), "p_lat": round(41.95 + rng.random() * rng.choice([0.01, 0.1]), 6), "p_lon": round(21.35 + rng.random() * rng.choice([0.01, 0.15]), 6)})
    rows += [rows[3] | {"poi_id": 900}, rows[8] | {"poi_id": 901}]
    order = ["poi_id", "name", "type", "p_lat", "p_lon"]
    df = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], "poi_id long, name string, type string, p_lat double, p_lon double")
    needles = [(i, t, c[0], c[1]) for i, (t, c) in enumerate(itertools.product(NEEDLES + rng.sample(NAMES, 20), [(None, None), (41.953, 21.353), (42.03, 21.44)]))]
    return rows, df, needles, spark.createDataFrame(needles, "needle_id int, text string, c_lat double, c_lon double")


def plain_of(spark, rows, df, texts):
    feats = {(r["name"], r["type"]): r.asDict() for r in cascade.place_features(df).collect()}
    words = sorted({w for f in feats.values() for w in f["typed"]} | {w for t in texts for w in re.split(r"[\W_]+", t) if w} | {" ".join(x).lower() for t in texts for x in (t.split()[:2], t.split()[-2:])})
    from cartolex.functions.text import to_cyrillic, to_latin

    cyr = lambda c: F.when(c.rlike("[Ѐ-ӿ]"), c).otherwise(to_cyrillic(c))
    told = spark.createDataFrame([(w,) for w in words], "w string").select("w", to_latin(F.col("w")).alias("l"), cyr(F.col("w")).alias("c")).collect()
    latin = {r["w"]: r["l"] for r in told} | {(r["w"], "cyr"): r["c"] for r in told}
    said = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", cascade.sounds(F.col("t")).alias("k")).collect()}
    return Plain(rows, feats, latin, said)


def test_lookup_equals_a_plain_walk(spark, made):
    rows, df, _, needles = made
    asks = needles.select(F.to_json(F.struct("text", "c_lat", "c_lon")).alias("ask"), "text", "c_lat", "c_lon").distinct()
    told = [r.asDict() for r in cascade.ask_features(asks).withColumn("tokens_all", forms.lookup_tokens(F.col("clean"))).collect()]
    walk = plain_of(spark, rows, df, sorted({a["clean"] for a in told}))
    want = {}
    for a in told:
        if hit := walk.core(a):
            want[a["ask"]] = (hit[0], hit[1]["name"], hit[1]["type"], hit[1]["poi_id"])
    got = {r["ask"]: (r["pass"], r["name"], r["type"], r["poi_id"]) for r in cascade.lookup_rows(asks, df).collect()}
    assert got == want
    assert len({v[0] for v in want.values()}) >= 6


def test_slips_alone_equal_a_plain_walk(spark, made):
    rows, df, raw, needles = made
    asks = needles.where("text <> ''").select(F.to_json(F.struct("text", "c_lat", "c_lon")).alias("ask"), F.trim("text").alias("clean"), "c_lat", "c_lon", "text").distinct()
    from cartolex.operators.lookup import opener_off, place_category

    t = F.filter(F.split("clean", r"[^0-9\p{L}]+"), lambda w: F.length(w) >= 3)
    from cartolex.functions.text import canonical_word_key

    opened = opener_off(F.col("text"))
    told = asks.where(~forms.too_generic(opened, place_category(opened))).select("ask", "clean", "c_lat", "c_lon", place_category(F.col("clean")).alias("a_cat"), t.alias("a_typed"), F.transform(t, canonical_word_key).alias("a_typed_keys")).collect()
    walk = plain_of(spark, rows, df, sorted({r["clean"] for r in told}))
    want = {}
    for a in told:
        found = walk.first(a, walk.slips(a), lambda r: (len(r["typed"]),))
        if found and not (len(found) > 1 and len(found[0]["typed"]) == len(found[1]["typed"]) and found[0]["ident"] != found[1]["ident"]):
            want[a["ask"]] = found[0]["poi_id"]
    got = cascade.typo_lookup(needles.withColumn("needle_id", F.to_json(F.struct("text", "c_lat", "c_lon"))).distinct(), df).collect()
    assert {r["needle_id"]: r["poi_id"] for r in got} == want and len(want) > 20


def test_resolved_places(spark):
    rows = [(1, "Трговски центар Капитол", "mall", 41.98, 21.46), (2, "ТЦ Капитол", "bus_station", 41.981, 21.46), (3, "Карпош", "suburb", 42.0, 21.39), (4, "Карпош 3", "mall", 42.001, 21.4), (5, "Болница 8ми Септември", "hospital", 42.0, 21.4),
            (6, "Медицинско училиште", "school", 41.99, 21.42), (7, "Ria Shutka (suto orizari)", "money_transfer", 42.05, 21.43), (8, "Шуто Оризари", "suburb", 42.04, 21.42), (9, "Apartmani Skopje", "holiday apartment", 41.99, 21.43), (10, "Embassy of Turkey", "embassy", 42.0, 21.41)]
    said = ["ТЦ Капитол", "автобус ТЦ Капитол", "KARPOS", "воена болница", "медицинското", "suto orizari", "Apartmani Skopje", "да ли има", "турска амбасада", "karpos 3"]
    df = spark.createDataFrame(rows, "poi_id long, name string, type string, p_lat double, p_lon double")
    needles = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(said)], "needle_id int, text string, c_lat double, c_lon double")
    got = {said[r["needle_id"]]: (r["turn"], r["poi_id"]) for r in cascade.resolve_places(needles, df).collect()}
    assert got["ТЦ Капитол"] == (2, 1) and got["KARPOS"] == (0, 3) and got["воена болница"] == (4, 5) and got["медицинското"][1] == 6
    assert got["suto orizari"] == (0, 8) and "Apartmani Skopje" not in got and "да ли има" not in got and got["турска амбасада"][1] == 10 and got["karpos 3"][1] == 4
    assert cascade.resolve_places(needles.limit(2), df.limit(0)).count() == 0


def test_forms(spark):
    said = lambda f, *texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert said(forms.lookup_tokens, "BUNJAKOVEC TRGOVSKIOT", "Shopping Center Bunjakovec", "") == [["bunjakovec", "shopping"], ["shopping", "center", "bunjakovec"], []]
    assert said(forms.school_forms, "МЕДИЦИНСКОТО УЧИЛИШТЕ", "економското", "abc") == [["МЕДИЦИНСКО УЧИЛИШТЕ"], ["економско", "економско училиште", "економско гимназија"], []]
    assert said(forms.official_name, "кај државна болница", "градска кафеана", "VOENATA BOLNICA") == ["Клинички центар", None, "ГОБ 8-ми Септември"]
    assert said(forms.only_grammar, "има ли", "DA", "има Бисер", "", "kaj na") == [True, True, False, True, True]
    assert said(forms.only_service, "za iznajmuvanje", "изнајмување", "изнајмување кола") == [True, True, False]
    assert said(forms.embassy_name, "Црногорската амбасада", "турска амбасада", "амбасада") == ["Embassy of Montenegro", "Embassy of Turkey", None]
    pairs = [("Зелена", "Зелена Пазара", True), ("kaj Diamond Mall", "Civil - Diamond Mall", True), ("novo lisice", "ELS Novo Lisice", False), ("", "x", False), ("pa aerodrom", "Аеродром", True)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, w boolean")
    assert [r[0] for r in df.orderBy("i").select(forms.covers(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_names_are_sought_once_a_text(spark, monkeypatch):
    """what a text's centres have in common is in no table once a centre; each centre has its own answer."""
    sizes, cut = {}, cascade.cut

    def counted(df, name="t"):
        out = cut(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(cascade, "cut", counted)
    rng = random.Random(3)
    rows = [(i, f"Kapitol {i}", "bus_station" if i % 3 else "park", 41.95 + rng.random() * 0.05, 21.35 + rng.random() * 0.05) for i in range(18)]
    centres = [(i, "Kapitol", 41.95 + rng.random() * 0.08, 21.35 + rng.random() * 0.08) for i in range(60)] + [(99, "Kapitol", None, None)]
    df = spark.createDataFrame(rows, "poi_id long, name string, type string, p_lat double, p_lon double")
    needles = spark.createDataFrame(centres, "needle_id int, text string, c_lat double, c_lon double")
    want = {}
    for i, _, lat, lon in centres:
        far = lambda r: metres(lat, lon, r[3], r[4]) if lat is not None else 0  # noqa: B023, E731
        parks = [r for r in rows if r[2] == "park"]
        left = parks if lat is None or any(far(r) <= cascade.LOCAL_M for r in parks) else rows
        want[i] = min(left, key=lambda r: (far(r), len(r[1]), r[1]))[0]  # noqa: B023
    assert {r["needle_id"]: r["poi_id"] for r in cascade.ranked_lookup(needles, df).collect()} == want
    assert {any(r[0] == w and r[2] == "park" for r in rows) for w in want.values()} == {True, False}
    assert sizes["hits"] <= 2 * len(rows)


@pytest.mark.parametrize("asks", [lookups.needles, service.feed_audit])
def test_names_that_no_remainder_picks_are_not_joined(spark, monkeypatch, tmp_path, asks):
    """Keys' remainders by 500 are 999 at most, however many names the table has; keys below 0 have their own."""
    at = str(tmp_path)
    part = spark.range(-600, 3000).selectExpr("id as p_partkey", "concat('red n', id) as p_name", "'PROMO' as p_type", "1 as p_size", "'b' as p_brand")
    part.write.parquet(f"{at}/part.parquet")
    spark.range(-700, 700).selectExpr("id as c_custkey", "1 as c_nationkey", "'c' as c_name", "'s' as c_mktsegment").write.parquet(f"{at}/customer.parquet")
    joined, join = [], type(part).join

    def counted(self, other, on=None, how=None):
        if "_k" in other.columns:
            joined.append(other.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(part), "join", counted)
    out = asks(spark, at)
    assert joined == [999]
    if asks is lookups.needles:
        said = {k: f"red n{int(math.fmod(k, 500)) + 1}" for k in range(-700, 700)}
        assert {r["needle_id"]: " ".join(r["w"]) for r in out.collect()} == said
