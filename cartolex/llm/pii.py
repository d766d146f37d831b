"""Personal data by a semi-Markov conditional random field over the places where it can be, on top of a base scan."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import binary_column, small_batches, tidy, working

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base scan.
EMAIL_LOCAL, EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED, CARD, PHONE = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), leftmost non-overlapping in each kind, failing matches dropped; linear in the text."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in DOTTED.finditer(text):
            if m.end() - m.start() >= 7:
                parts, place = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                        out.append((place, place + size, 1))
                    place += size + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _ascii_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_ascii_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- the model

#: Labels: 0 is outside, then the kinds. A segment of a kind has at most LONGEST tokens, so that a region costs
#: tokens * LONGEST * labels**2.
LABELS, LONGEST = ("O", *KINDS), 16
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: What a region is built around: a long enough run of digits and joints, or a spelled-out address.
_TRIGGER = re.compile(r"[0-9](?:[ ().\-/]{0,2}[0-9]){6,}|[\[({<] ?(?:at|AT|@) ?[\])}>]|@")
_SPACE = re.compile(r"\s")
#: Characters on both sides of a trigger that belong to its region at least.
AROUND = 80
_SPELLED = re.compile(r"[\[({<] ?(?:at|AT|@) ?[\])}>]")
#: Words that announce a kind.
CUES = {
    "email": ("email", "mail", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "whatsapp"),
}


def _tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def _shape(part: str) -> str:
    """The joints between runs of digits and letters, runs as one mark with a bounded length."""
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 5)}", re.sub(r"[^\W\d_]+", "w", part))[:24]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, label: int) -> list[str]:
    """Features of the whole segment tokens[i:j] under a label."""
    kind = LABELS[label]
    part = text[tokens[i][0] : tokens[j - 1][1]]
    if not label:
        what = "num" if part[0].isdigit() else "word" if part[0].isalpha() else part
        size = min(len(part), 12) if what == "num" else 0
        return [f"O:{what}:{size}"]
    digits = _ascii_digits(part)
    n = len(digits)
    out = [f"{kind}:bias", f"{kind}:n{min(n, 20)}", f"{kind}:shape:{_shape(part)}", f"{kind}:first:{part[0] if not part[0].isalnum() else 'd' if part[0].isdigit() else 'w'}", f"{kind}:last:{'d' if part[-1].isdigit() else 'w' if part[-1].isalpha() else part[-1]}"]
    out.append(f"{kind}:letters:{any(c.isalpha() for c in part)}")
    out.append(f"{kind}:luhn:{14 <= n <= 19 and luhn(digits)}")
    dots = part.split(".")
    out.append(f"{kind}:octets:{len(dots) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in dots)}")
    out.append(f"{kind}:at:{bool(re.search(r'@|[\[({<] ?(?:at|AT|@) ?[\])}>]', part))}")
    before = [text[a:b].lower() for a, b in tokens[max(0, i - 2) : i]]
    out.append(f"{kind}:cue:{any(w in CUES[kind] for w in before)}")
    touch = (tokens[i][0] > 0 and text[tokens[i][0] - 1].isalnum()) or (tokens[j - 1][1] < len(text) and text[tokens[j - 1][1]].isalnum())
    out.append(f"{kind}:touches:{touch}")
    gap = any(b - a > 1 for (_, a), (b, _) in zip(tokens[i : j - 1], tokens[i + 1 : j], strict=True))
    out.append(f"{kind}:gap:{gap}")
    return out


def _segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Candidate segments in the order of their ends: one token outside; up to LONGEST tokens that hold an at sign, from word to word, as
    an email; up to LONGEST tokens with 7 digits or more, from a digit, plus or bracket to a digit, as the other kinds."""
    n = len(tokens)
    words = [text[a:b] for a, b in tokens]
    digits = np.concatenate([[0], np.cumsum([len(w) if w[0] in "0123456789" else 0 for w in words])]).tolist()
    at = np.concatenate([[0], np.cumsum([w == "@" or (w in ("at", "AT") and t > 0 and words[t - 1] in "[({<") for t, w in enumerate(words)])]).tolist()
    joints = [w[0] in "0123456789+().-/ " for w in words]
    for j in range(1, n + 1):
        yield j - 1, j, 0
        end = words[j - 1]
        if end.isalnum():
            number = end[0] in "0123456789"
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                if at[j] > at[i] and words[i].isalnum() and "@" != words[i]:
                    yield i, j, 1
                if number:
                    number = joints[i]
                    if number and digits[j] - digits[i] >= 7 and words[i][0] in "0123456789+(":
                        yield from ((i, j, y) for y in range(2, len(LABELS)))
                    elif number and digits[j] - digits[i] >= 4 and words[i][0] in "0123456789":
                        yield i, j, 2


#: Tokens whose segments are scored at a time.
BLOCK = 8192
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Its inverse modulo 2 ** 64.
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Scorer:
    """The weights by feature, as arrays, so that all segments of a block of tokens are scored at once."""

    FLAGS = ("letters", "luhn", "octets", "at", "cue", "touches", "gap")

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.trans = np.array([[weights.get(f"T:{x}:{y}", 0.0) for y in range(len(LABELS))] for x in range(len(LABELS))])
        self.bias, self.n, self.flags, self.shape = {}, {}, {}, {}
        for y, kind in enumerate(LABELS):
            self.bias[y] = weights.get(f"{kind}:bias", 0.0)
            self.n[y] = np.array([weights.get(f"{kind}:n{n}", 0.0) for n in range(21)])
            self.flags[y] = {f: np.array([weights.get(f"{kind}:{f}:{v}", 0.0) for v in (False, True)]) for f in self.FLAGS}
            shapes = {k.split(":", 2)[2]: w for k, w in weights.items() if k.startswith(f"{kind}:shape:")}
            back = _powers(_BACK, 25)
            hashed = sorted((int((_codes(x) * back[: len(x)]).sum(dtype=np.uint64)), w) for x, w in shapes.items())
            self.shape[y] = np.array([h for h, _ in hashed], np.uint64), np.array([w for _, w in hashed])

    def by_char(self, y: int, what: str, marks: list[str]) -> np.ndarray:
        known = {m: self.weights.get(f"{LABELS[y]}:{what}:{m}", 0.0) for m in set(marks)}
        return np.array([known[m] for m in marks])


class Region:
    """What the segments of a stretch of tokens are scored by: sums and marks of its tokens, made once."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.size = text, len(tokens)
        words = [text[a:b] for a, b in tokens]
        self.words = words
        flag = lambda values: np.fromiter(values, bool, len(words))
        summed = lambda values: np.concatenate([[0], np.cumsum(values)])
        self.number = flag(w[0] in "0123456789" for w in words)
        self.alnum = flag(w.isalnum() for w in words)
        self.opens = self.number | flag(w[0] in "+(" for w in words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.digits = summed(np.where(self.number, lengths, 0))
        self.breaks = summed(~(self.number | flag(w in "+().-/ " for w in words)))
        spelled = (w == "@" or (w in ("at", "AT") and t > 0 and words[t - 1] in "[({<") for t, w in enumerate(words))
        self.at = summed(flag(spelled))
        self.signs = summed(flag(w == "@" for w in words))
        self.letters = summed(flag(w[0].isalpha() or any(map(str.isalpha, w)) for w in words))
        starts, ends = np.array(tokens, np.int64).T
        gaps = np.append(starts[1:] - ends[:-1], 0)
        self.wide, self.spaced = summed(gaps > 1), summed(gaps > 0)
        # brackets around a spelled at sign, by their first and last token
        whole = [m.span() for m in _SPELLED.finditer(text, tokens[0][0], tokens[-1][1])]
        first, last = np.searchsorted(starts, [x for x, _ in whole]), np.searchsorted(ends, [y for _, y in whole])
        self.opened = summed(np.bincount(first, minlength=self.size)[: self.size])
        self.closed = summed(np.bincount(last, minlength=self.size)[: self.size])
        self.octet = self.number & (lengths <= 3) & flag(w[0] in "0123456789" and len(w) <= 3 and int(w) <= 255 for w in words)
        self.dot = flag(w == "." for w in words)
        self.before = flag(a > 0 and text[a - 1].isalnum() for a, _ in tokens)
        self.after = flag(b < len(text) and text[b].isalnum() for _, b in tokens)
        low = [w.lower() for w in words]
        self.cue = {}
        for y in range(1, len(LABELS)):
            said = flag(w in CUES[LABELS[y]] for w in low)
            one = np.concatenate([[False], said])
            self.cue[y] = one[: self.size] | np.concatenate([[False, False], said])[: self.size]
        self.first = [w[0] if not w[0].isalnum() else "d" if w[0].isdigit() else "w" for w in words]
        self.last = ["d" if w[-1].isdigit() else "w" if w[-1].isalpha() else w[-1] for w in words]
        # digits by place, for sums that double every second one
        d = np.array([int(c) for w, n in zip(words, self.number, strict=True) if n for c in w], np.int64)
        even = np.arange(len(d)) % 2 == 0
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        self.plain = [summed(np.where(even, d, 0)), summed(np.where(even, 0, d))]
        self.doubled = [summed(np.where(even, twice, 0)), summed(np.where(even, 0, twice))]
        # the shape of the whole stretch; a segment's shape is a part of it
        pieces = [f"d{min(len(w), 5)}" if n else "w" if w[0].isalnum() and not w[0].isdecimal() else w for w, n in zip(words, self.number, strict=True)]
        joined = "".join(p + text[e : e + g] for p, (_, e), g in zip(pieces, tokens, gaps.tolist(), strict=True))
        width = np.fromiter(map(len, pieces), np.int64, self.size)
        self.place = summed(width + gaps)[:-1]
        self.stop = self.place + width
        codes = _codes(joined)
        self.hash = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BACK, len(codes)), dtype=np.uint64)])
        self.power = _powers(_PRIME, len(codes) + 1)

    def scores(self, score: Scorer, lo: int, hi: int, firsts: dict, lasts: dict) -> np.ndarray:
        """(ends lo + 1 to hi, tokens less one, label less one): the scores of candidate segments, minus infinity for others."""
        out = np.full((hi - lo, LONGEST, len(LABELS) - 1), -np.inf)
        j = np.arange(lo + 1, hi + 1)[:, None]
        i = j - np.arange(1, LONGEST + 1)[None, :]
        there = (i >= 0) & self.alnum[j - 1]
        i = np.maximum(i, 0)
        digits = self.digits[j] - self.digits[i]
        email = there & (self.at[j] > self.at[i]) & self.alnum[i]
        joint = there & self.number[j - 1] & (self.breaks[j] == self.breaks[i])
        many = joint & (digits >= 7) & self.opens[i]
        few = joint & (digits >= 4) & self.number[i] & ~many
        for y in range(1, len(LABELS)):
            some = email if y == 1 else many | few if y == 2 else many
            row, col = np.nonzero(some)
            if not len(row):
                continue
            a, b = i[row, col], row + lo + 1
            n = digits[row, col]
            at, end = self.digits[a], self.digits[b]
            odd = (end - 1) % 2
            total = np.where(odd == 0, self.plain[0][end] - self.plain[0][at] + self.doubled[1][end] - self.doubled[1][at], self.plain[1][end] - self.plain[1][at] + self.doubled[0][end] - self.doubled[0][at])
            seven = (b - a == 7) & (self.spaced[b - 1] == self.spaced[a])
            step = lambda k: np.minimum(a + k, self.size - 1)
            for k in range(7):
                seven &= (self.dot if k % 2 else self.octet)[step(k)]
            values = {
                "letters": self.letters[b] > self.letters[a],
                "luhn": (n >= 14) & (n <= 19) & (total % 10 == 0),
                "octets": seven,
                "at": (self.signs[b] > self.signs[a]) | (self.closed[b] > self.opened[a]),
                "cue": self.cue[y][a],
                "touches": self.before[a] | self.after[b - 1],
                "gap": self.wide[b - 1] > self.wide[a],
            }
            start = self.place[a]
            size = np.minimum(self.stop[b - 1] - start, 24)
            shape = (self.hash[start + size] - self.hash[start]) * self.power[start]
            known, weight = score.shape[y]
            if len(known):
                slot = np.minimum(np.searchsorted(known, shape), len(known) - 1)
                shaped = np.where(known[slot] == shape, weight[slot], 0.0)
            else:
                shaped = np.zeros(len(row))
            own = score.bias[y] + score.n[y][np.minimum(n, 20)] + shaped + firsts[y][a] + lasts[y][b - 1]
            for f in Scorer.FLAGS:
                own = own + score.flags[y][f][values[f].astype(np.int8)]
            out[row, col, y - 1] = own
        return out


def decode(text: str, tokens: list[tuple[int, int]], weights: dict[str, float] | Scorer) -> list[tuple[int, int, int]]:
    """The best segmentation's segments of a kind, by dynamic programming over ends and labels; linear in the tokens.

    Segments are scored for a block of tokens at once, from sums over the tokens: the same features and weights as in training,
    without a string for each segment."""
    score = weights if isinstance(weights, Scorer) else Scorer(weights)
    n, k = len(tokens), len(LABELS)
    if not n:
        return []
    region = Region(text, tokens)
    firsts = {y: score.by_char(y, "first", region.first) for y in range(1, k)}
    lasts = {y: score.by_char(y, "last", region.last) for y in range(1, k)}
    outside = [score.weights.get(f"O:{'num' if w[0].isdigit() else 'word' if w[0].isalpha() else w}:{min(len(w), 12) if w[0].isdigit() else 0}", 0.0) for w in region.words]
    # the best score up to a token with the step to each label, and the label it comes from
    onward, via = np.empty((n + 1, k)), np.zeros((n + 1, k), np.int8)
    back = np.zeros((n + 1, k), np.int32)
    trans, labels, still = score.trans, np.arange(k - 1), score.trans[0]
    onward[0] = still
    ends = np.empty(k)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        own = region.scores(score, lo, hi, firsts, lasts)
        some = (own > -np.inf).any((1, 2)).tolist()
        for j in range(lo + 1, hi + 1):
            first = onward[j - 1, 0] + outside[j - 1]
            if some[j - 1 - lo]:
                m = min(j, LONGEST)
                way = onward[j - m : j, 1:][::-1] + own[j - 1 - lo, :m]
                pick = way.argmax(0)
                ends[0], ends[1:] = first, way[pick, labels]
                back[j, 1:] = pick
                step = ends[:, None] + trans
                via[j] = step.argmax(0)
                onward[j] = step.max(0)
            else:
                onward[j] = first + still
    if not some[-1]:
        ends[0], ends[1:] = first, -np.inf
    out, at, label = [], n, int(ends.argmax())
    while at:
        start = at - 1 - int(back[at, label])
        if label:
            out.append((tokens[start][0], tokens[at - 1][1], label - 1))
        at, label = start, int(via[start, label])
    return out[::-1]


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines: personal data in many spellings between words, and numbers that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiounrtslmd") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + num(rng.choice([13, 14, 14, 14]))
        full = next(body + d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep and len(full) == 16 else full

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{rng.randint(1, 99)} {a} {b} {c}"])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        user, host, tld = word() + rng.choice(["", num(2), "." + num(2)]), word() + rng.choice(["", num(1)]), rng.choice(["com", "org", "net"])
        return rng.choice([f"{user}@{host}.{tld}", f"{user}@{host}.example.{tld}", f"{user} [at] {host} [dot] {tld}", f"{user} (at) {host}.{tld}"])

    def none() -> str:
        return rng.choice([num(rng.randint(1, 6)), f"{num(1)}.{num(1)}.", f"20{num(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", num(rng.choice([8, 9, 20, 24])), f"{num(1)}.{num(1)}.{num(1)}", f"{num(3)} {word()} {num(4)}", f"@{word()}", f"{num(4)}/{num(4)}", f"{num(2)}:{num(2)}:{num(2)}", f"300.{num(3)}.400.{num(1)}"])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        line, gold = "", []
        for _ in range(rng.randint(1, 3)):
            line += " ".join(word() for _ in range(rng.randint(0, 3)))
            line += " " if line and not line.endswith(" ") else ""
            y = rng.randint(0, 5)
            if y < 4:
                if rng.random() < 0.3:
                    line += rng.choice(CUES[KINDS[y]]) + rng.choice([" ", ": "])
                part = makers[y]()
                gold.append((len(line), len(line) + len(part), y))
                line += part
            else:
                line += none()
            line += rng.choice([" ", ", ", ". ", "!! "])
        out.append((line + word(), gold))
    return out


@lru_cache(maxsize=2)
def train(n: int = 500, epochs: int = 5, seed: int = 11, rate: float = 0.25, decay: float = 1e-4) -> dict[str, float]:
    """Weights by stochastic gradient of the conditional log-likelihood: forward and backward sums over all segmentations."""
    k = len(LABELS)
    weights: dict[str, float] = {}
    prepared = []
    for text, gold in examples(n, seed):
        tokens = _tokens(text, 0, len(text))
        starts, ends = {a: t for t, (a, _) in enumerate(tokens)}, {b: t + 1 for t, (_, b) in enumerate(tokens)}
        true, covered, fine = [], set(), True
        for a, b, y in gold:
            if a not in starts or b not in ends or ends[b] - starts[a] > LONGEST:
                fine = False
                break
            true.append((starts[a], ends[b], y + 1))
            covered |= set(range(starts[a], ends[b]))
        if not fine:
            continue
        true = sorted(true + [(t, t + 1, 0) for t in range(len(tokens)) if t not in covered])
        segs = list(_segments(text, tokens))
        if not set(true) <= set(segs):
            continue
        feats = [features(text, tokens, *s) for s in segs]
        prepared.append((len(tokens), segs, feats, true, {s: f for s, f in zip(segs, feats, strict=True)}))
    order, rng = list(range(len(prepared))), random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate / (1 + epoch)
        for e in order:
            size, segs, feats, true, by = prepared[e]
            trans = np.array([[weights.get(f"T:{x}:{y}", 0.0) for y in range(k)] for x in range(k)])
            own = np.array([sum(weights.get(f, 0.0) for f in fs) for fs in feats])
            alpha, beta = np.full((size + 1, k), -np.inf), np.full((size + 1, k), -np.inf)
            alpha[0, 0] = 0.0
            beta[size] = 0.0
            for (i, j, y), s in zip(segs, own, strict=True):
                alpha[j, y] = np.logaddexp(alpha[j, y], s + np.logaddexp.reduce(alpha[i] + trans[:, y]))
            for (i, j, y), s in sorted(zip(segs, own, strict=True), key=lambda x: -x[0][1]):
                beta[i] = np.logaddexp(beta[i], trans[:, y] + s + beta[j, y])
            total = np.logaddexp.reduce(alpha[size])
            grad: dict[str, float] = {}
            last = 0
            for s in true:
                for f in (*by[s], f"T:{last}:{s[2]}"):
                    grad[f] = grad.get(f, 0.0) + 1.0
                last = s[2]
            for (i, j, y), s, fs in zip(segs, own, feats, strict=True):
                each = np.exp(alpha[i] + trans[:, y] + s + beta[j, y] - total)
                p = float(each.sum())
                if p > 1e-6:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) - p
                    for x in range(k):
                        if each[x] > 1e-6:
                            f = f"T:{x}:{y}"
                            grad[f] = grad.get(f, 0.0) - float(each[x])
            for f, g in grad.items():
                weights[f] = weights.get(f, 0.0) * (1 - decay) + step * g
    return weights


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, widened to white space; those that meet are one, however long. No character is passed more
    than twice, so a text without white space costs no more than others."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi, last = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND), found[-1][1] if found else 0
        while lo > last and not text[lo - 1].isspace():
            lo -= 1
        if hi > last:
            space = _SPACE.search(text, hi)
            hi = space.start() if space else len(text)
        if found and lo <= last:
            found[-1][1] = max(last, hi)
        else:
            found.append([lo, hi])
    return [(lo, hi) for lo, hi in found]


class Taken:
    """Stretches that spans cover, to ask whether another one meets them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.lo: list[int] = []
        self.hi: list[int] = []
        for a, b, _ in sorted(spans):
            if self.hi and a <= self.hi[-1]:
                self.hi[-1] = max(self.hi[-1], b)
            else:
                self.lo.append(a)
                self.hi.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.hi, a)
        return i < len(self.lo) and self.lo[i] < b


def all_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """The base spans, and those that the model adds: they share no character with a base span."""
    base = base_spans(text)
    added = []
    taken = Taken(base)
    for lo, hi in regions(text):
        tokens = _tokens(text, lo, hi)
        # where the base scan explains every digit and at sign, nothing can be added
        if any(text[a] in "0123456789@" or (text[a:b] in ("at", "AT") and a and text[a - 1] in " [({<") for a, b in tokens if not taken.meets(a, b)):
            added += [s for s in decode(text, tokens, weights) if not taken.meets(s[0], s[1])]
    return base, added


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), redact: bool = False, sample: int = 500) -> DataFrame:
    """One row for each row of ``docs``: the id, columns ``keep``, ``spans`` and, with ``redact``, the text with marks in place.

    ``spans``: array of struct(kind, start, end, base), code points, end exclusive, by start, then kind as listed. Base spans
    always stay; the model adds spans that share no character with them. Null text is empty (and stays null when redacted);
    null ids and repeated rows pass like others; texts are decoded whole, in time that grows with their length, with or without
    white space. Other columns are not used. An empty table gives no rows. ``sample``: the number of made-up lines that the
    model is trained on, the same at every size of the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Scorer(train(sample)))
    names = [doc_id, *[c for c in keep if c not in (doc_id, text)]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    shape = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            col = binary_column(batch, text)
            null = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
            spans, clean = [], []
            for i, raw in enumerate(col):
                t = raw.as_py().decode("utf-8", "replace")
                base, added = all_spans(t, sent.value) if "@" in t or _DIGIT.search(t) or _SPELLED.search(t) else ([], [])
                found = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], s[2], s[1]))
                spans.append([{"kind": KINDS[y], "start": a, "end": b, "base": x} for a, b, y, x in found])
                if redact:
                    clean.append(None if null[i] else _redacted(t, found))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.list_(kind)), *([pa.array(clean, pa.string())] if redact else [])], [*names, "spans", *([text] if redact else [])])

    return docs.select(*names, text).mapInArrow(tidy(run), f"{fields}, spans {shape}" + f", `{text}` string" * redact)


def _redacted(text: str, found: list[tuple]) -> str:
    """Each stretch that spans cover becomes the mark of its first span."""
    if not found:
        return text
    out, at = [], 0
    stretch: list[list] = []
    for a, b, y, _ in found:
        if stretch and a < stretch[-1][1]:
            stretch[-1][1] = max(stretch[-1][1], b)
        else:
            stretch.append([a, b, y])
    for a, b, y in stretch:
        out += [text[at:a], f"[{KINDS[y]}]"]
        at = b
    return "".join([*out, text[at:]])
