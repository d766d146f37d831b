"""Near vectors and exact top-k against numpy."""

import math

import numpy as np
import pyarrow as pa

from cartolex.llm import pivots, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def made(n=420, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(60, n, 7):
        base[i] = base[i % 60] + rng.normal(size=dim) * 0.08  # near copies, some just around the threshold
    base[9] = base[3]
    base[11] = base[3] * 2
    rows = [(int(i), [float(x) for x in v.astype(np.float32)], 0, "k") for i, v in enumerate(base)]
    odd = [(9001, None, 0, None), (9002, [], 0, None), (9003, [0.0] * dim, 0, None), (9004, [math.nan] + [1.0] * (dim - 1), 0, None), (9005, [math.inf] + [1.0] * (dim - 1), 0, None), (9006, [None] + [1.0] * (dim - 1), 0, None), (9007, [1.0, 2.0], 0, None)]
    return rows, [*rows, rows[5], *odd, (None, rows[0][1], 1, None)]


def test_near_vectors(spark):
    good, rows = made()
    good = [*good, good[5]]
    x = np.array([r[1] for r in good], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.95
    np.fill_diagonal(link, False)
    want = {}
    seen: dict[int, int] = {}
    for i in range(len(good)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for b in np.flatnonzero(link[todo.pop()]):
                    if b not in group:
                        group.add(int(b))
                        todo.append(int(b))
            for g in group:
                seen[g] = min(good[g][0] for g in group)
    for i, r in enumerate(good):
        want[r[0]] = (int(link[i].sum()), seen[i])
    out = pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None and r["vec_id"] < 9000}
    found, true = sum(a for a, _ in got.values()), sum(a for a, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.9 * true
    assert got[9][0] >= 2 and all((r["component_id"] == r["vec_id"]) == r["kept"] for r in out if r["vec_id"] is not None)
    assert all(r["n_links"] == 0 and r["kept"] for r in out if r["vec_id"] is None or r["vec_id"] >= 9000)
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(700, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(700, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.952 * a + math.sqrt(1 - 0.952**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))]
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.9 * 1400


def test_recall_in_a_dense_group(spark):
    rng = np.random.default_rng(3)
    n, dim = 20_000, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hot = np.arange(0, n, 3)
    x[hot] = x[0] + 0.22 * x[hot]  # pairs of cosine 0.94 to 0.97 around one centre
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[i : i + 2000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, n, 2000)])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float64()))})).repartition(4)
    got = pivots.near_vectors(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert want[hot].sum() > 1_000_000 and (got <= want).all() and got.sum() >= 0.999 * want.sum()


def test_top_k(spark, monkeypatch):
    _, rows = made(300)
    df = spark.createDataFrame(rows, SCHEMA)
    good = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in good]
    want = {}
    for qid, q in ints:
        if qid % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ints if i != qid)[:10]
            want |= {(qid, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    for block in (8192, 2):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k_inner(df, df.where("vec_id % 50 = 0")).collect()}
        assert got == want
    few = spark.createDataFrame([(0, [1e30, 1.0], 0, None), (1, [1e30, 1.0], 0, None)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k_inner(few, few.where("vec_id = 0")).collect()] == [(0, 1, 2**63 - 1)]
    assert topk.top_k_inner(df.limit(0), df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    """Each length is searched by itself, whatever the share of its rows."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for dim, base, n in ((8, 0, 60), (5, 1000, 25), (1, 2000, 6)):
        x = np.round(rng.normal(size=(n, dim)), 2) + 0.001
        x[1] = x[0] * 2
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = (u @ u.T >= 0.95).sum(1) - 1
        ints = [[math.floor(1024 * y) for y in v] for v in x.tolist()]
        for i, v in enumerate(x.tolist()):
            rows.append((base + i, v))
            best = sorted((-sum(a * b for a, b in zip(ints[i], w, strict=True)), base + j) for j, w in enumerate(ints) if j != i)[:3]
            want[base + i] = int(links[i]), [(-s, j) for s, j in best]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(df).collect()}
    assert got == {i: w[0] for i, w in want.items()}
    some = df.where("vec_id % 10 = 0")
    found = {}
    for r in topk.top_k_inner(df, some, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert found == {i: w[1] for i, w in want.items() if i % 10 == 0}
