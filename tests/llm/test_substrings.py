"""Repeated passages against plain Python."""

import random
import re

from cartolex.llm import substrings


def plain(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    starts = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                starts[k] = min(starts.get(k, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and starts[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3)
    passages = [[word() for _ in range(rng.randint(13, 40))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, None), (1000, rows[3][1]), (5, "x " * 40), (6, None), (7, ""), (8, "é " * 30), (9, "é " * 30), (10, "a\u00a0b c\u0085d " * 30), (11, "q a\u00a0b c\u0085d " * 30 + "x" * 200000), (12, "y " * 100000)]
    return rows


def check(spark, rows, window=13, **more):
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, tag string")
    got = substrings.remove_repeats(docs, window, **more).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in got), key=repr) == plain(rows, window)


def test_against_plain(spark):
    check(spark, made(1))


def test_joined_level(spark):
    check(spark, made(2), table_bits=8)


def test_hot_windows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {text} c{i}") for i in range(1300)]
    check(spark, rows)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y z " * 9), ("a", "q " + "x y z " * 9)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert got == {"a": 0, "b": 27}
