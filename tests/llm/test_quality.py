"""The quality classifier against plain Kneser-Ney sums."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cartolex.llm import quality, spelling


def discounts(counts, least=0.0):
    n = [sum(c == i for c in counts) for i in range(6)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
    d = [max(least, min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0) for i in (1, 2, 3)]
    return lambda c: d[min(c, 3) - 1]


def coded(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


class Plain:
    """The word model by dictionaries over the trusted texts."""

    def __init__(self, texts):
        split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
        words, byte = np.zeros(spelling.ENTRIES), np.zeros(256)
        for t in texts:
            data, off = coded(t)
            for w in re.findall(r"[^\x20\x09-\x0D]+", t):
                line = [spelling.SPACE] * 3 + [spelling.SYMBOL[c.encode()[0]] for c in w] + [spelling.SPACE]
                for i in range(3, len(line)):
                    words[sum(int(line[i - j]) << (5 * j) for j in range(4))] += 1
            byte += np.bincount(data, minlength=256)
        self.table, self.byte = (-np.log(np.maximum(spelling.kneser_ney(words), 1e-12))).astype(np.float32), spelling.byte_costs(byte)
        self.two, by = Counter(), defaultdict(set)
        for t, w in zip(texts, split, strict=True):
            for p in zip(["|", *w], [*w, "|"], strict=True):
                self.two[p] += 1
                by[p].add(t)
        self.held = {p for p in by if len(by[p]) > 1}
        front, who, self.n = defaultdict(set), defaultdict(set), Counter()
        for (v, w), n in self.two.items():
            front[w].add(v)
            who[w] |= by[v, w]
            self.n[w] += n
        self.c = {w: len(x) for w, x in front.items()}
        self.known = {w for w in who if len(who[w]) > 1}
        self.d1, self.d2 = discounts(list(self.c.values()), 0.05), discounts(list(self.two.values()), 0.05)
        self.total = sum(self.c.values())
        self.rest = 1 - sum(self.c[w] - self.d1(self.c[w]) for w in self.known) / self.total

    def spell(self, w):
        if w == "|":
            s = float(self.table[spelling.ALL_SPACES])
        else:
            (s,) = spelling.Lines(*coded(w)).spelled(self.table, self.byte)
        return float(np.float16(s))

    def one(self, w):
        return ((self.c[w] - self.d1(self.c[w])) / self.total if w in self.known else 0.0) + self.rest * math.exp(-self.spell(w))

    def pair(self, v, w):
        if v not in self.known:
            return self.one(w)
        less = lambda p: self.two[p] - self.d2(self.two[p]) if p in self.held else 0.0
        free = self.n[v] - sum(less(p) for p in self.held if p[0] == v)
        return less((v, w)) / self.n[v] + free / self.n[v] * self.one(w)

    def perplexity(self, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return math.exp(-sum(math.log(self.pair(a, b)) for a, b in zip(["|", *w], [*w, "|"], strict=True)) / len(text)) if w else None


def made():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéк") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [rng.choice([" ", "\n", "  "]).join(["the" if rng.random() < 0.3 else rng.choice(words[: rng.randint(5, 60)]) for _ in range(rng.randint(1, 80))]) for _ in range(120)]
    texts += [texts[0], texts[1], "solo word alone", "", " \n", "x y z\u0085q", "long " * 30000]
    return [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("head", [quality.HEAD, 40, 0])
def test_perplexity_is_that_of_plain_kneser_ney(spark, monkeypatch, head):
    if head == 40:
        monkeypatch.setattr(quality, "FLUSH", 300)
        monkeypatch.setattr(quality, "REST_SHARD", 30)
        monkeypatch.setattr(quality, "ASKED_BYTES", 100)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = [r for r in rows if r[0] % 2 == 0]
    plain = Plain([t for _, t, _ in trusted])
    out = quality.judge_quality(docs, spark.createDataFrame([(r[0],) for r in trusted], "doc_id long"), head=head).collect()
    texts = {d: t for d, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        want = plain.perplexity(texts[r["doc_id"]])
        assert (r["perplexity"] is None) == (want is None)
        assert want is None or abs(math.log(r["perplexity"] / want)) < 1e-4, r["doc_id"]


def test_character_model_is_plain_kneser_ney():
    rng = random.Random(2)
    counts = np.zeros(spelling.ENTRIES, np.int64)
    for _ in range(400):
        counts[sum(rng.choice([0, 1, 2, 27]) << (5 * j) for j in range(4))] += rng.randint(1, 4)
    p = spelling.kneser_ney(counts)
    assert np.abs(p.reshape(-1, 32).sum(1) - 1).max() < 1e-9 and p.min() > 0
    grams = [{tuple(int(i) >> (5 * j) & 31 for j in (3, 2, 1, 0)): int(counts[i]) for i in np.flatnonzero(counts)}]
    for _ in range(3):
        grams.append(Counter(g[1:] for g in grams[-1]))
    cuts = [discounts(list(g.values()), 0.05) for g in grams]

    def plain(h, x):
        if not h:
            level, d = grams[3], cuts[3]
            total = sum(level.values())
            return (level.get((x,), 0) - (d(level[x,]) if (x,) in level else 0)) / total + sum(map(d, level.values())) / total / 32
        level, d = grams[3 - len(h)], cuts[3 - len(h)]
        after = {g[-1]: n for g, n in level.items() if g[:-1] == h}
        if not after:
            return plain(h[1:], x)
        total = sum(after.values())
        return (after.get(x, 0) - (d(after[x]) if x in after else 0)) / total + sum(map(d, after.values())) / total * plain(h[1:], x)

    for _ in range(60):
        g = tuple(rng.choice([0, 1, 2, 27, 5]) for _ in range(4))  # first symbol first
        assert abs(p[sum(x << (5 * (3 - j)) for j, x in enumerate(g))] - plain(g[:3], g[3])) < 1e-9


def test_rows_and_verdicts(spark):
    rng = random.Random(6)
    words = ["the", "of", "and", "tion", "in", "that", "ering", "with", "onthe", "resh"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) + ".", "en" if i % 4 else None) for i in range(300)]
    junk = [(1000 + i, " | ".join(rng.choice(words).upper() + "###" for _ in range(40)), "en") for i in range(30)]
    docs = spark.createDataFrame([(*r, "k") for r in [*clean, *junk, (None, "of the and", "xx"), (2000, None, "en"), (2001, "", None), clean[0]]], "doc_id long, text string, lang string, kept string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,)], "doc_id long")
    out = quality.judge_quality(docs, trusted).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 334 and sum(by[i]["kept"] for i in range(300)) >= 299 and not any(by[1000 + i]["kept"] for i in range(30))
    assert not by[2000]["kept"] and by[2000]["perplexity"] is None and not by[2001]["kept"]
    free = quality.judge_quality(docs, trusted.limit(0)).collect()
    assert sum(r["kept"] for r in free) == 332
    assert quality.judge_quality(docs.limit(0), trusted).count() == 0


def test_words_and_their_order_count(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(60)] + ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(60)]
    after = {w: rng.sample(words[:60] if i < 60 else words[60:], 3) for i, w in enumerate(words)}

    def walk(w, n):
        out = [w]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    clean = [(i, " ".join(walk(rng.choice(words), 60)), "en") for i in range(300)]
    shuffled = [" ".join(rng.sample(t.split(), 60)) for _, t, _ in clean[1:41:2]]
    invented = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for _, t, _ in clean[1:121:3]]
    docs = spark.createDataFrame([*clean, *[(1000 + i, t, "en") for i, t in enumerate([*shuffled, *invented])], (1, clean[1][1], "en")], "doc_id long, text string, lang string")
    out = quality.judge_quality(docs, spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == len(clean) + len(shuffled) + len(invented) + 1 and sum(kept[i] for i in range(300)) >= 297
    assert not any(kept[i] for i in kept if i >= 1000)
