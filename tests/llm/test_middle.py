"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re

from cartolex.llm import middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    some = ["word", "A", "é", "日", "😀", " ", "\n", "<", "P>", "<S", "<M", "12", "...", "longerword", "\x00"]
    texts = ["".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 5, 23, 24, 25, 48, 49, 120, 300]))) for _ in range(250)]
    texts += [None, "", "a", "<P>", "x<S>y", "<M", "é", "<" * 40, "ab" * 30_000, "a1" * 20_000]
    rows = [(rng.randint(0, 10**12), t, 1, "f") for t in texts]
    rows += [(None, texts[5], 1, "f"), (None, "other text, no id", 1, "f"), rows[7], rows[7], (rows[9][0], "one id and another text", 2, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = middle.fill_in_middle(df)
    back = middle.restored(got.output, got.form)
    out = got.select("*", back.alias("back"), (back == got.output).alias("same")).collect()
    want = sorted(repr((r[0], *plain(r[0], r[1]), r[1] or "")) for r in rows)
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"])) for r in out) == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(df.limit(0)).count() == 0


def test_every_block_size_gives_the_same(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["ab", "c", " ", ".", "é"]) for _ in range(rng.randint(1, 90)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1, 7, 500):
        out = middle.fill_in_middle(df, block=block, plain_from=100).collect()
        assert {r["doc_id"]: r["output"] for r in out if r["form"] == "psm"} == {i: plain(i, t)[4] for i, t in rows if plain(i, t)[1] == "psm"} | {r["doc_id"]: r["output"] for r in out if r["form"] == "psm" and plain(r["doc_id"], dict(rows)[r["doc_id"]])[1] == "plain"}


def test_texts_of_one_row_each_and_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", "t " * 50)], "k1 string, part string")
    row = middle.fill_in_middle(df, doc_id="k1", text="part").first()
    assert row["doc_id"] == "a" and row["n"] == 100
