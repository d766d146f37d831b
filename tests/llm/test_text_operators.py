"""MinHash, components, PII, secrets, and URL rules against plain Python."""

import random
import re
import time

from cartolex.llm import components, minhash, pii, secrets, urls

ODD = [(None, "a b c d"), (None, None), (801, None), (802, ""), (803, " \n"), (804, "one"), (805, "ONE"), (806, "two words"), (807, "x " * 20000)]


def groups(ids, link):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in link:
            lo = min(label[a], label[b])
            if label[a] != lo or label[b] != lo:
                label[a] = label[b] = lo
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    link = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 700)]
    ids = {x for e in link for x in e}
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(link, "u long, v long")).collect()}
    want = groups(ids, link)
    assert {i: got.get(i, i) for i in ids} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_minhash(spark, rows, size):
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, n string")
    out = minhash.near_duplicates(docs, size=size).collect()
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    ids = [d for d in sets if d is not None and sets[d]]
    link = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = groups(ids, link)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label.get(r["doc_id"], r["doc_id"])), r
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_minhash(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(["q", "r", "s"]) * rng.randint(1, 3)
        else:
            w = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 70))]
        rows.append((i, " ".join(w).upper() if i % 11 == 0 else "\n".join(w)))
    rows += ODD + [rows[3], rows[4]]
    for size in (2, 5):
        check_minhash(spark, rows, size)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_large_family(spark):
    """Many variants of one text, whose links chain through members that the first one does not reach."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    check_minhash(spark, rows, 2)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_pii_base_is_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", ".", "1", "22", "300", "4", "-", " ", "+", "(", ")", "@", "x", "5555", "@a", ".b", "é", "٣"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_pii(t), t
    assert pii.base_spans("1" * 200000 + ".") == [] and pii.base_spans("0" * 9000 + "1.2.3.4") == [(0, 9007, 1)]


def test_pii_model_on_held_out_lines():
    weights = pii.train()
    hit = missed = wrong = 0
    for text, gold in pii.examples(150, seed=99):
        got = set(pii.decode(text, pii._tokens(text, 0, len(text)), weights))
        hit, missed, wrong = hit + len(got & set(gold)), missed + len(set(gold) - got), wrong + len(got - set(gold))
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9


def test_pii_rows(spark):
    rows = [*ODD, (1, "mail a.b@c.de or +1 (437) 555-0689, 10.0.0.1"), (2, "write to jane [at] example.org now"), (3, "call (555) 123-4567 today")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")
    out = pii.find_pii(docs, keep=("doc_id",), redact=True).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] == "mail [email] or [phone], [ip]" and all(s["base"] for s in by[1]["spans"])
    assert [s["kind"] for s in by[2]["spans"]] == ["email"] and not by[2]["spans"][0]["base"]
    assert by[801]["text"] is None and by[807]["spans"] == []
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_secrets(spark):
    shared, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    upper = "AB12CD34" * 4
    rows = [(1, f"token = \"{shared}\"", "a"), (2, f"é token: {shared}", "b"), (3, f"PASSWORD='{own}' AKIA{'Z' * 16} AKIA12", "a"), (4, f"x {upper} y", "a"), (5, "secret=12345", None), (None, None, None), (6, "", "a"), (3, "api_key = abcdef", "a"), (7, f"{shared} {upper}", "c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, spans string")
    out = secrets.scan_secrets(docs).collect()
    assert len(out) == len(rows)
    patterns = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24)}
    want = sorted(sorted((m.start(), m.end(), k) for k, (p, n) in patterns.items() for m in re.finditer(p, t or "") if len(m[1]) >= n) for _, t, _ in rows)
    assert sorted(sorted((s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]) for r in out) == want
    by = {r["doc_id"]: {s["kind"]: s for s in r["spans"]} for r in out if r["doc_id"] not in (3, None)}
    assert by[1]["hex"]["n_owners"] == 3 and not by[1]["hex"]["live"]
    assert "upperhex" not in by[4] and by[7]["hex"]["n_repos"] == 3
    live = [s for r in out if r["doc_id"] == 3 for s in r["spans"] if s["kind"] == "hex"]
    assert live[0]["live"] and live[0]["n_owners"] == 1
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_urls(spark):
    from cartolex.llm.queries import URL_RULES

    cases = {
        "http://a.EXAMPLE.com/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "https://b.com/en/": ("b.com", "/en/", "com/en/", "block"), "https://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"),
        "ftp://example.net/de/8#t": ("example.net", "/de/8", "example.net/de/8", "block"), "http://q.net/de/": ("q.net", "/de/", "net/de/", "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"), "http://com?/en/": ("com", "", None, "allow"), "http://com/en/x://y": ("com", "/en/x://y", "com/en/", "block"), "a\nb://org/es/\n": ("org", "/es/\n", "org/es/", "block"),
    }
    rows = [(i, u, "k") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "k"), (None, "https://b.com/en/", "k")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), spark.createDataFrame(URL_RULES, "host string, path string, action string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r
    none = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), spark.createDataFrame([], "host string, path string, action string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_pii_in_long_regions_is_whole():
    line = "Ana Kos 415-555-0134\n"
    base, added = pii.all_spans(line * 300, pii.train(500))
    assert not base and added == [(i * len(line) + 8, i * len(line) + 20, 3) for i in range(300)]


def test_pii_without_white_space():
    weights = pii.train(500)
    text = ("x" * 300 + ",tel:415-555-0134;").join(["", *["y" * 50] * 3, ""])
    _, added = pii.all_spans(text, weights)
    assert len(added) == len(set(added)) == 4
    took = []
    for n in (50, 400):
        began = time.perf_counter()
        base, added = pii.all_spans((",tel:415-555-0134;" + "z" * 300) * n, weights)
        took.append(time.perf_counter() - began)
        assert not base and len(added) == n
    assert took[1] < 24 * took[0]
    base, added = pii.all_spans("q" * 1_000_000 + ",mail:a.b@c.de;" + "w" * 1_000_000, weights)
    assert [s[2] for s in base] == [0] and not added


def test_decode_is_the_best_segmentation():
    """Against all segmentations of short lines."""
    weights = pii.train(500)
    for text in ["tel 415-555-0134", "a at b", "1.2.3.4 x", "x [at] y.com", "call +1 555 0134567"]:
        tokens = pii._tokens(text, 0, len(text))
        by_start = {}
        for i, j, y in pii._segments(text, tokens):
            by_start.setdefault(i, []).append((j, y, sum(weights.get(f, 0.0) for f in pii.features(text, tokens, i, j, y))))

        def best(at, last, n=len(tokens), by_start=by_start):
            if at == n:
                return 0.0, []
            return max((own + weights.get(f"T:{last}:{y}", 0.0) + (rest := best(j, y))[0], [(at, j, y), *rest[1]]) for j, y, own in by_start[at])

        want = [(tokens[i][0], tokens[j - 1][1], y - 1) for i, j, y in best(0, 0)[1] if y]
        assert pii.decode(text, tokens, weights) == want, text


def test_secrets_in_long_texts(spark):
    patterns = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24)}
    text = "".join(f"é{'x' * (i % 7)} token={i:06d}{'a' * (i % 3)} " + ("0123456789abcdef" * 2 if i % 5 == 0 else "12") for i in range(30000)) + "k" * 1_000_000
    for t in (text, "token=abcdef"):
        (got,) = secrets.scan_secrets(spark.createDataFrame([(1, t, "s")], "doc_id long, text string, source string")).collect()
        want = sorted((m.start(), m.end(), k) for k, (p, n) in patterns.items() for m in re.finditer(p, t) if len(m[1]) >= n)
        assert sorted((s["start"], s["end"], s["kind"]) for s in got["spans"] if s["base"]) == want


def test_urls_with_very_many_labels(spark):
    """A host of 100,000 labels and one of empty labels; rules of several depths."""
    from cartolex.llm import urls

    deep = "a." * 99_998 + "example.com"
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "/x", "block"), ("b.a.example.com", "/x", "allow")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, f"http://{deep}/en/77"), (2, f"http://{deep}/x"), (3, "http://...com/en/"), (4, "http://" + "." * 50_000 + "/en/"), (5, "http://com/en/"), (6, "http://b.a.EXAMPLE.com/xy")], "page_id long, url string")
    urls.filter_urls(pages.limit(1), rules).collect()
    at = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert time.time() - at < 20
    assert got == {1: ("example.com/en/7", "allow"), 2: ("a.example.com/x", "block"), 3: ("com/en/", "block"), 4: (None, "allow"), 5: ("com/en/", "block"), 6: ("b.a.example.com/x", "allow")}


def test_pii_on_a_megabyte_of_digits_and_signs():
    """Texts that are candidates all through; the times are bounds for one task."""
    score = pii.Scorer(pii.train(500))
    for text in (" ".join(str(i % 10) for i in range(500_000)), " ".join(map(str, range(150_000))), "a@" * 500_000):
        at = time.time()
        base, added = pii.all_spans(text, score)
        assert time.time() - at < 60 and not base
        assert all(0 <= a < b <= len(text) for a, b, _ in added)


def test_scores_of_blocks_are_those_of_features(monkeypatch):
    """Every candidate's score against the sum over its features, and the best path's against all that the features allow."""
    rng = random.Random(3)
    weights = pii.train(500)
    score = pii.Scorer(weights)
    bits = ["1", "22", "333", "4444", "123456", " ", "  ", "-", ".", "+", "(", ")", "/", "@", "[at]", "(AT)", " at ", "bc", "é", "tel:", "card", "²", "٣", "_", "\n", "4111 1111 1111 1111", "192.168.1.1", "+389 70 123 456", "me@x.com", "[ @ ]", "x (at) y.com", "日"]
    for block in (8192, 7):
        monkeypatch.setattr(pii, "BLOCK", block)
        for _ in range(150):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
            tokens = pii._tokens(text, 0, len(text))
            if not tokens:
                continue
            segs = list(pii._segments(text, tokens))
            own = {s: sum(weights.get(f, 0.0) for f in pii.features(text, tokens, *s)) for s in segs}
            region = pii.Region(text, tokens)
            firsts, lasts = ({y: score.by_char(y, what, marks) for y in range(1, 5)} for what, marks in (("first", region.first), ("last", region.last)))
            got = region.scores(score, 0, len(tokens), firsts, lasts)
            assert {(i, j, y): round(float(got[j - 1, j - i - 1, y - 1]), 9) for i, j, y in segs if y} == {s: round(w, 9) for s, w in own.items() if s[2]}
            assert (got > -float("inf")).sum() == sum(y > 0 for _, _, y in segs)
            best = {(0, 0): 0.0}
            for i, j, y in segs:
                for x in range(5):
                    if (i, x) in best:
                        best[j, y] = max(best.get((j, y), -1e300), best[i, x] + own[i, j, y] + weights.get(f"T:{x}:{y}", 0.0))
            starts, ends = {a: t for t, (a, _) in enumerate(tokens)}, {b: t + 1 for t, (_, b) in enumerate(tokens)}
            path = [(starts[a], ends[b], y + 1) for a, b, y in pii.decode(text, tokens, score)]
            inside = {t for i, j, _ in path for t in range(i, j)}
            total, last = 0.0, 0
            for s in sorted(path + [(t, t + 1, 0) for t in range(len(tokens)) if t not in inside]):
                total, last = total + own[s] + weights.get(f"T:{last}:{s[2]}", 0.0), s[2]
            assert abs(total - max(w for (j, _), w in best.items() if j == len(tokens))) < 1e-9
