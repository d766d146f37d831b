"""Characters in 32 classes: n-gram codes of running text and of single words, and the small Kneser-Ney tables of both.

The tables have SYMBOLS ** ORDER entries whatever the input, so they are solved in one place and sent to every executor. They
are the lowest level of the word model (``quality``), which has no such bound, and judge repeated words besides.
"""

from __future__ import annotations

import numpy as np

from cartolex.llm.common import _IS_SPACE

#: Symbols: 26 small letters and six classes of other characters.
SYMBOLS, ORDER = 32, 4
ENTRIES = SYMBOLS**ORDER
OTHER_LETTER, CAPITAL, DIGIT, SPACE, STOP, OTHER = 26, 27, 28, 29, 30, 31


def _symbols() -> np.ndarray:
    """Symbol of a byte; 255 for the later bytes of a character, which count with its first."""
    out = np.full(256, OTHER, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91] = CAPITAL
    out[48:58] = DIGIT
    out[[32, 9, 10, 11, 12, 13]] = SPACE
    out[[ord(c) for c in ".,;:'"]] = STOP
    out[128:192] = 255
    out[192:] = OTHER_LETTER
    return out


SYMBOL = _symbols()
#: The code of the end of a word without characters, which spells the end of a text.
ALL_SPACES = sum(SPACE << (5 * j) for j in range(ORDER))


class Lines:
    """The symbols of all rows in one line, ORDER - 1 spaces before each row, and what the two character models read in it."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        inside = ~_IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = off[:-1][off[:-1] < len(data)]
        first[edge] |= inside[edge]
        #: The byte at which each word starts; words are those of ``word_hashes``.
        self.start = np.flatnonzero(first)
        self.data, rows, pad = data, len(off) - 1, ORDER - 1
        sym = SYMBOL[data]
        sym[self.start[sym[self.start] == 255]] = OTHER  # bytes that are no UTF-8
        keep = sym != 255
        #: Offsets of the rows' characters.
        self.chars = np.concatenate([[0], np.cumsum(keep)])[off]
        n = int(self.chars[-1])
        line = np.full(n + pad * rows + pad + 1, SPACE, np.int32)
        self.place = np.arange(n) + pad * (np.repeat(np.arange(rows), np.diff(self.chars)) + 1)
        line[self.place] = sym[keep]
        self.line, self.back = line[pad:], [line[pad - j : len(line) - j] for j in range(1, ORDER)]

    def running(self) -> np.ndarray:
        """Codes of the n-grams of running text (5 bits a symbol), one for each character."""
        code = self.line.copy()
        for j, x in enumerate(self.back, 1):
            code |= x << (5 * j)
        return code[self.place - (ORDER - 1)]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams at every place, spaces before each word; and at which places a word has a character or ends."""
        code, seen = self.line | (self.back[0] << 5), self.back[0]
        for j, x in enumerate(self.back[1:], 2):
            seen = np.where(seen == SPACE, SPACE, x)
            code |= seen << (5 * j)
        return code, (self.line != SPACE) | (self.back[0] != SPACE)

    def spelled(self, table: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Minus the log-probability of each word's spelling: of its symbols, and of each byte among those of its symbol."""
        code, counted = self.words()
        sums = np.concatenate([[0.0], np.cumsum(np.where(counted, table[code], np.float32(0)), dtype=np.float64)])
        here, before = self.line != SPACE, self.back[0] != SPACE
        bytes_ = np.concatenate([[0.0], np.cumsum(np.where(_IS_SPACE[self.data], 0.0, byte[self.data]))])
        return sums[np.flatnonzero(~here & before) + 1] - sums[np.flatnonzero(here & ~before)] + np.diff(bytes_[np.append(self.start, len(self.data))])


def byte_costs(n: np.ndarray) -> np.ndarray:
    """Minus the log-probability of each of the 256 bytes among those of its symbol, one added to each count."""
    count = n + 1.0
    return np.log(np.bincount(SYMBOL, count, 256)[SYMBOL] / count)


def discounts(n1: float, n2: float, n3: float, n4: float, least: float = 0.0) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and above, from the numbers of counts 1 to 4; ``least`` at least."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    return tuple(max(least, min(i, max(0.0, i - (i + 1) * y * b / a)) if a else 0.0) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """The interpolated modified Kneser-Ney probability of every n-gram's last symbol after its first ones.

    ``counts``: of the n-grams, by code. Lower orders count the distinct symbols before an n-gram; without any count all
    symbols are equally likely.
    """
    levels = [counts.astype(np.float64)]
    for _ in range(ORDER - 1):
        above = levels[-1].reshape(SYMBOLS, -1)
        levels.append((above > 0).sum(0).astype(np.float64))
    p = np.full(1, 1.0 / SYMBOLS)
    for level in reversed(levels):
        by = level.reshape(-1, SYMBOLS)
        d = np.array([0.0, *discounts(*[float((level == i).sum()) for i in (1, 2, 3, 4)], least=0.05)])[np.minimum(by, 3).astype(int)]
        total = by.sum(1, keepdims=True)
        lower = np.broadcast_to(p.reshape(-1, SYMBOLS) if len(p) > 1 else p, (SYMBOLS if by.shape[0] > 1 else 1, by.shape[0] // (SYMBOLS if by.shape[0] > 1 else 1), SYMBOLS))
        lower = lower.reshape(by.shape)
        p = np.where(total > 0, (by - d + d.sum(1, keepdims=True) * lower) / np.maximum(total, 1), lower).ravel()
    return p
