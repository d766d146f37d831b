"""Vector codes against plain loops over integers."""

import math

import numpy as np

from cartolex.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string, code int, v string"


def plain(rows, entries, rounds, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**63), min(2**63 - 1, x)) for x in v] + [0] * (-len(v) % parts), label) for i, v, label in kept]
    out, books = [], {}
    for w in {len(v) for _, v, _ in kept}:
        own = sorted((x for x in kept if len(x[1]) == w), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        s = w // parts
        cut = [[tuple(v[p * s : p * s + s]) for p in range(parts)] for _, v, _ in own]
        book = [[c[p] for c in cut[:entries]] for p in range(parts)]
        near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), i) for i, e in enumerate(b))
        for _ in range(rounds):
            for p in range(parts):
                by = {}
                for c in cut:
                    by.setdefault(near(c[p], book[p])[1], []).append(c[p])
                for e, members in by.items():
                    book[p][e] = tuple(sum(col) // len(members) for col in zip(*members, strict=True))
        books[w] = book
        for (i, _, label), c in zip(own, cut, strict=True):
            best = [near(c[p], book[p]) for p in range(parts)]
            out.append((i, tuple(b[1] for b in best), min(sum(b[0] for b in best), 2**63 - 1), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted((repr((i, code, error, min(sums[label], 2**63 - 1))) for i, code, error, label in out)), books


def said(df, **kw):
    return sorted(repr((r["vec_id"], tuple(r["code"]), r["error"], r["label_error"])) for r in codes.compress_vectors(df, **kw).collect())


def made(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, dim)), np.round(rng.normal(size=(n - n // 2, dim)))])  # the rounded half ties
    rng.shuffle(x)
    return [(i * 3, [float(y) for y in v], [None, "a", "b", "a"][i % 4], 0, "s") for i, v in enumerate(x)]


def test_codes_equal_plain_loops(spark):
    rows = made()
    odd = [(1, None, "a", 0, ""), (2, [], "a", 0, ""), (4, [None] + [1.0] * 7, "a", 0, ""), (5, [math.nan] * 8, None, 0, ""), (7, [math.inf] * 8, None, 0, ""), (None, [0.5] * 8, "z", 0, ""), (0, [0.25] * 8, "z", 0, ""), rows[4], rows[4]]
    other = [(8, [1.0, 2.0, 3.0], "a", 0, ""), (9, [1.5, -2.0, 3.0], "q", 0, ""), (10, [0.1], "a", 0, "")]
    rows = rows + odd + other
    df = spark.createDataFrame(rows, SCHEMA)
    for entries in (16, 400):
        assert said(df, entries=entries, rounds=3) == plain(rows, entries, 3)[0]
    assert said(df.limit(0)) == []
    assert codes.compress_vectors(df, entries=16).select("codebooks_sha256").distinct().count() == 2  # lengths 8 and, filled up, 4


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(y) for y in v], "a", 0, "") for i, v in enumerate(rng.normal(size=(40, 4)) * 1e14)] + [(90, [1e300, -1e300, 0.0, 1e15], "b", 0, "")]
    assert said(spark.createDataFrame(rows, SCHEMA), entries=5, rounds=2) == plain(rows, 5, 2)[0]


def test_exponion_equals_a_full_search_and_makes_fewer_distances():
    rng = np.random.default_rng(9)
    centres = rng.integers(-3000, 3000, size=(256, 16))
    x = (centres[rng.integers(0, 256, 20_000)] + rng.integers(-200, 200, size=(20_000, 16))).astype(np.int64)
    search = codes.Exponion(centres)
    full = codes.distances(x, centres)
    start = np.where(rng.random(len(x)) < 0.1, rng.integers(0, 256, len(x)), full.argmin(1))
    found, least, made = search.nearest(x, start)
    assert (found == full.argmin(1)).all() and (least == full.min(1)).all() and made < 0.3 * full.size
    same = np.zeros((4, 3), np.int64)
    assert codes.Exponion(same).nearest(np.ones((5, 3), np.int64), np.array([3, 2, 1, 0, 3]))[0].tolist() == [0] * 5


def test_the_digest_is_that_of_the_final_entries(spark):
    import hashlib

    rows = made(60)
    got = {r[0] for r in codes.compress_vectors(spark.createDataFrame(rows, SCHEMA), entries=10).select("codebooks_sha256").collect()}
    book = plain(rows, 10, 4)[1][8]
    assert got == {hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()}
