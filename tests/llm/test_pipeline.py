"""The pipeline's stages against the operators they call and plain Python."""

import importlib
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_in_order(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SF)
        if name != "bpe":
            assert kept.columns == docs.columns
        kept = kept.cache()
        seen[name] = kept.collect()
    first = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in seen["quality"]}
    assert all(r["text"] == first[r["doc_id"]]["text"] for r in seen["quality"])
    assert sum(d in good for d, q in labels.items() if q == 1) >= 0.99 * sum(q == 1 for q in labels.values())
    assert sum(d not in good for d, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())

    # near duplicates: five words, 0.8, one of each group
    sets = {}
    for r in seen["quality"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    label = {i: i for i in ids}
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        moved = False
        for a, b in links:
            lo = min(label[a], label[b])
            moved |= label[a] != lo or label[b] != lo
            label[a] = label[b] = lo
        if not moved:
            break
    assert sorted(r["doc_id"] for r in seen["minhash"]) == [i for i in ids if label[i] == i]

    # personal data gives way to marks, everything else stays
    from cartolex.llm import pii

    weights = pii.train()
    plain = {}
    for r in seen["minhash"]:
        base, added = pii.all_spans(r["text"] or "", weights)
        plain[r["doc_id"]] = pii._redacted(r["text"] or "", sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], s[2], s[1])))
    assert {r["doc_id"]: r["text"] for r in seen["pii"]} == plain and all(r["n_chars"] == len(r["text"]) for r in seen["pii"])

    # the mix: no document more than twice, each source near its target
    from cartolex.llm import mixing

    times = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(times) <= set(plain) and max(times.values()) <= 2
    words = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in seen["pii"]}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d, (s, n) in words.items():
        sizes[s] += n
        taken[s] += n * times[d]
        largest[s] = max(largest[s], n)
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest[s]

    assert Counter(r["doc_id"] for r in seen["bpe"]) == times and all(r["same"] for r in seen["bpe"])


def test_run_is_the_stages(spark, pipeline):
    out = pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 0


CLASHES = ("spans", "size", "kept", "perplexity", "threshold", "ids", "decoded", "n_tokens", "target", "taken", "source_size", "_key", "_times", "__further_3", "text_sha256", "row", "label")


def test_odd_rows_and_names(spark, pipeline):
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").limit(40).collect()]
    rows = [(5000 + i, t, "en", f"s{i % 3}" if i % 4 else None, len(t)) for i, t in enumerate(good)]
    long = " ".join(good) * 12
    rows += [rows[0], rows[1], (5000, "another text of the same id", "en", "s1", 5), (None, good[5], None, None, None), (None, None, None, None, None), (1, None, "en", "s0", 0), (2, "", "en", "s0", 0), (3, " \n", None, "s0", 2), (4, long, "en", "s1", len(long)), (6, "write to ana@kos.mk " + good[3], "de", "s2", 0), (7, "x" * 300000, "en", "s2", 0)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, shape)
    wide = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], f"{shape}, " + ", ".join(f"`{c}` string" for c in CLASHES))
    empty = plain.limit(0)
    for name, stage in pipeline.STAGES:
        a, b = (stage(spark, d, SF) for d in (plain, wide))
        c = stage(spark, empty, SF)
        got, more = a.collect(), b.collect()
        assert c.columns == a.columns and c.count() == 0
        key = lambda r, cols=a.columns: repr([r[x] for x in cols])
        assert sorted(map(key, got)) == sorted(map(key, more)), name
        if name != "bpe":
            assert a.columns == plain.columns and b.columns == wide.columns
            assert all(r[x] == f"{x}{r['doc_id']}" for r in more for x in CLASHES)
        texts = [r["text"] for r in got] if name != "bpe" else []
        if name == "quality":
            assert not {None, "", " \n"} & set(texts)
        if name == "minhash":
            ids = [r["doc_id"] for r in got]
            assert ids.count(5000) == 1 and {1, 2, 3} <= set(ids) and ids.count(None) == 2
        if name == "pii":
            assert len(got) == len(rows) and not any(t and "ana@kos.mk" in t for t in texts)
        if name == "mixing":
            assert not {None, "", " \n"} & set(texts)
        if name == "bpe":
            assert len(got) == len(rows) and all(r["same"] for r in got)
