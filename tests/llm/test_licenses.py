"""Licence scan against plain searches of words and a recursive evaluation of expressions."""

import random
import re

from cartolex.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_places(text):
    words = WORD.findall(lower(text or ""))
    found = []
    for phrases, base in ((licenses.BASE, True), (licenses.NOTICES, False)):
        for phrase, label in phrases:
            p = phrase.split()
            found += [(i, label, base) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_places_equal_a_plain_search(spark):
    rng = random.Random(3)
    some = [w for p, _ in licenses.BASE + licenses.NOTICES for w in p.split()] + ["x", "Éa", "cc", "by", "日本"]
    texts = ["".join(rng.choice(some + [" ".join(p for p, _ in licenses.BASE)]).upper() + rng.choice([" ", "-", ",\n", "$$", "  \t"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["", None, "...", "CC-BY-NC cc by nc", "under the mit licenses", "sunder the mit license", "cc by nc by nc", "ÀCC BY NC", "éCC BY NCé cc_by_nc"]
    rows = [(i, t, "n", "s") for i, t in enumerate(texts)] + [(None, texts[0], None, None), (3, texts[3], "n", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, labels string")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    want = sorted(repr((r[0], *plain_places(r[1]))) for r in rows)
    assert sorted(repr((r["doc_id"], r["n_words"], sorted((p["word"], p["label"], p["base"]) for p in r["places"]))) for r in got) == want
    for r in got:
        labels = sorted({p["label"] for p in r["places"]})
        assert r["labels"] == labels and r["score"] == min([licenses.FREEDOM[x] for x in labels], default=0.0)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    kept = licenses.scan_licenses(df, keep=("labels",)).columns
    assert kept[:2] == ["doc_id", "labels"]


def test_a_long_text_and_columns_that_clash(spark):
    text = "word " * 400_000 + "(under the MIT license)" + " x" * 100_000
    df = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, score string")
    row = licenses.scan_licenses(df).first()
    assert row["n_words"] == 500_004 and [tuple(p) for p in row["places"]] == [(400_000, "mit", True)]
    assert licenses.scan_licenses(df.select(df.text.alias("labels"), df.doc_id), text="labels").first()["labels"] == ["mit"]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["MIT", "Apache-2.0", "GPL-2.0-or-later", "CC-BY-NC-SA-4.0", "LicenseRef-own", "BSD-3-Clause", "ISC"])
        return ("with", name, "Classpath-exception-2.0") if rng.random() < 0.25 else ("id", name)
    return (rng.choice(["and", "or"]), tree(rng, depth - 1), tree(rng, depth - 1))


def written(rng, t, least=0):
    if t[0] == "id":
        out, own = t[1], 4
    elif t[0] == "with":
        out, own = f"{t[1]} WITH {t[2]}", 3
    else:
        own = {"and": 2, "or": 1}[t[0]]
        out = f"{written(rng, t[1], own)} {t[0].upper() if rng.random() < 0.5 else t[0]} {written(rng, t[2], own + 1)}"
    return f"( {out})" if own < least or rng.random() < 0.1 and own < 3 else out


def value(t):
    if t[0] == "id":
        label, free = licenses.family(t[1])
        return free, [label]
    if t[0] == "with":
        label, free = licenses.family(t[1])
        return (1 + free) / 2, [f"{label} with {t[2].lower()}"]
    a, b = value(t[1]), value(t[2])
    if t[0] == "and":
        return min(a[0], b[0]), a[1] + b[1]
    return a if a[0] >= b[0] else b


def test_expressions_equal_a_recursive_evaluation():
    rng = random.Random(5)
    for _ in range(2000):
        t = tree(rng, rng.randint(0, 4))
        said = written(rng, t)
        raw = said.encode()
        assert licenses.evaluate(raw, 0, len(raw)) == (*value(t), len(raw)), said


def test_expressions_that_break_off():
    ev = lambda s: licenses.evaluate(s.encode(), 0, len(s))
    assert ev("") is None and ev("and MIT") is None and ev("(((") is None and ev(") MIT") is None
    assert ev("MIT */") == (0.95, ["mit"], 3)
    assert ev("MIT or") == (0.95, ["mit"], 3) and ev("(MIT and (Apache-2.0 or") == (0.9, ["mit", "apache-2"], 20)
    assert ev("MIT this file is") == (0.95, ["mit"], 3)
    assert ev("(MIT or ISC) with x") == (0.95, ["mit"], 12)
    assert ev("GPL-2.0 with a with b")[2] == 14
    assert ev("mit." * 3)[1] == ["mit"]
    many = " and ".join(f"LicenseRef-{i}" for i in range(100_000))
    assert len(ev(many)[1]) == 100_000
    deep = "(" * 50_000 + "MIT" + ")" * 50_000
    assert ev(deep) == (0.95, ["mit"], len(deep))


def test_tags_in_texts(spark):
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nrest\r# spdx-license-identifier:CC-BY-NC-4.0 */\nSPDX License Identifier: ISC. SPDX-License-Identifier:\nMIT cc by nc"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(e["word"], e["text"], e["score"], e["labels"]) for e in row["expressions"]] == [
        (0, "(MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception", 0.95, ["mit", "apache-2 with llvm-exception"]),
        (17, "CC-BY-NC-4.0", 0.1, ["cc-by-nc"]),
    ]
    assert row["labels"] == ["apache-2 with llvm-exception", "cc-by-nc", "mit"] and row["score"] == 0.1
    assert [(p["label"], p["base"]) for p in row["places"]] == [("cc-by-nc", True)] * 2  # in the identifier, and in words
