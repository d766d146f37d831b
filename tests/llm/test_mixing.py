"""Targets, flow and seeded choice against plain Python."""

import itertools
import random
import time
from collections import defaultdict
from fractions import Fraction

from cartolex.llm import mixing


def plain_targets(sizes):
    """Shares by weight in the order of code points, null last; what stops at twice its size is found one at a time."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight, stopped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        open_ = [s for s in order if s not in stopped]
        left = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        out = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: Fraction(2 * sizes[s]) for s in stopped}
        above = [s for s in open_ if out[s] > 2 * sizes[s]]
        if not above:
            return out
        stopped |= {max(above, key=lambda s: out[s] / max(1, sizes[s]))}


def test_targets_are_the_plain_ones():
    rng = random.Random(4)
    for _ in range(200):
        sizes = {s: rng.choice([0, rng.randint(1, 10), rng.randint(1, 1000)]) for s in rng.sample(["a", "b", "é", "z", "Ω", "aa", None], rng.randint(1, 7))}
        if sum(sizes.values()):
            assert mixing.targets(sizes) == plain_targets(sizes)


def test_route_costs_the_least_of_all_flows():
    """Against every way to fill the quotas as far as can be."""
    rng = random.Random(7)
    for _ in range(40):
        names = ["a", "b"]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, 2)))), rng.randint(1, 3)) for _ in range(3)]
        quotas = {s: rng.randint(0, 6) for s in names}

        def cost(used):
            return sum(max(0, min(n, u - r * n)) * r * r for (_, n), u in zip(patterns, used, strict=True) for r in range(2))

        ways = itertools.product(*[[(x, y) for x in range(2 * n + 1 if "a" in ss else 1) for y in range(2 * n + 1 if "b" in ss else 1) if x + y <= 2 * n] for ss, n in patterns])
        fits = [w for w in ways if sum(x for x, _ in w) <= quotas["a"] and sum(y for _, y in w) <= quotas["b"]]
        most = max(sum(x + y for x, y in w) for w in fits)
        least = min(cost([x + y for x, y in w]) for w in fits if sum(x + y for x, y in w) == most)
        sent = mixing.route(patterns, quotas)
        assert sum(sum(x.values()) for x in sent) == most and cost([sum(x.values()) for x in sent]) == least
        assert all(sum(x.get(s, 0) for x in sent) <= quotas[s] for s in names)


def test_very_many_sources(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"site{rng.randint(0, 400)}" if i % 50 else None, rng.choice([0, 1, rng.randint(0, 500)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    want = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 50)
    got = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert all(abs(g[4] - w[4]) <= 1e-9 * max(1.0, w[4]) for g, w in zip(got, want, strict=True))


def test_ties_and_repeated_rows(spark):
    rows = [(1, "x", 5)] * 4 + [(2, "x", 5), (3, "y", 100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    aim = {r["source"]: r["target"] for r in got}
    assert len(got) == 6 and abs(sum(r["taken"] for r in got if r["source"] == "x") - aim["x"]) <= 1


def test_targets_stop_at_twice_the_size():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300}
    out = mixing.targets(sizes)
    assert sum(out.values()) == Fraction(3, 2) * sum(sizes.values())
    assert all(out[s] <= 2 * sizes[s] for s in sizes) and out["a"] == 20 and out["c"] == 10
    # what is open shares by weight
    assert out["b"] / 1 == out[None] / 3 or out[None] == 600


def test_route_repeats_no_more_than_needed():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b",), 5)]
    sent = mixing.route(patterns, {"a": 15, "b": 10})
    used = [sum(x.values()) for x in sent]
    assert sum(x.get("a", 0) for x in sent) == 15 and sum(x.get("b", 0) for x in sent) == 10
    assert used == [10, 10, 5]
    sent = mixing.route(patterns, {"a": 20, "b": 25})
    assert sum(map(sum, (x.values() for x in sent))) == 45 and all(sum(x.values()) <= 2 * p[1] for x, p in zip(sent, patterns, strict=True))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", "z", None, "é"]) if i % 3 else "x", rng.randint(0, 90), "k") for i in range(3000)]
    rows += [(None, "x", 5, None), (None, "x", None, None), (7, rows[7][1], rows[7][2], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, target string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, aim = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"] or 0
        taken[r["source"]] += r["taken"]
        aim[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * (r["size"] or 0)
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert aim[s] == float(want[s]) and abs(taken[s] - aim[s]) <= 1
        assert all(r["source_size"] == sizes[s] for r in got if r["source"] == s)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"] or 0, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_patterns(spark):
    rows = [(i, ["a"] if i % 2 else ["b", "a"], 10) for i in range(40)] + [(99, [], 10)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source array<string>, size long")).collect()
    assert {r["taken"] for r in got if not r["source"]} == {0}
    assert all(r["taken"] <= 20 for r in got) and sum(r["taken"] for r in got) > 400


def test_route_with_many_patterns():
    """20,000 and 200,000 patterns, half of them of several sources, with quotas that bind here and not there."""
    rng = random.Random(12)
    for n in (20_000, 200_000):
        names = [f"s{i}" for i in range(n // 10)]
        made = {}
        while len(made) < n:
            made[tuple(sorted(rng.sample(names, 1 if len(made) % 2 and len(made) < n // 5 else rng.randint(2, 4))))] = rng.randint(1, 1000)
        patterns = list(made.items())
        quotas = {s: rng.choice([0, 500, 3000, 20_000]) for s in names}
        at = time.time()
        sent = mixing.route(patterns, quotas)
        assert time.time() - at < 60
        used = [sum(x.values()) for x in sent]
        assert all(set(x) <= set(p[0]) and u <= 2 * p[1] for x, p, u in zip(sent, patterns, used, strict=True))
        left = dict(quotas)
        for x in sent:
            for s, k in x.items():
                left[s] -= k
        assert min(left.values()) >= 0
        # no source that is open can be reached from a pattern that has words left: the flow is a largest one
        fed = defaultdict(list)
        for i, x in enumerate(sent):
            for s in x:
                fed[s].append(i)
        todo = [i for i, u in enumerate(used) if u < 2 * patterns[i][1]]
        seen, reached = set(todo), set()
        while todo:
            for s in patterns[todo.pop()][0]:
                if s not in reached:
                    reached.add(s)
                    assert not left[s]
                    new = [i for i in fed[s] if i not in seen]
                    seen.update(new)
                    todo += new


def test_a_third_copy_costs_more():
    patterns = [(("a",), 4), (("a", "b"), 4)]
    used = [sum(x.values()) for x in mixing.route(patterns, {"a": 14, "b": 6}, most=3)]
    assert sum(used) == 20 and sum(max(0, min(4, u - 4 * r)) * r * r for u in used for r in range(3)) == 24
    used = [sum(x.values()) for x in mixing.route([*patterns, (("b", "c"), 4)], {"a": 8, "b": 8, "c": 8}, most=3)]
    assert used == [8, 8, 8]
