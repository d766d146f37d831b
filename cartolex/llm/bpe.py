"""Byte-level BPE over Arrow batches: the tokenizers library merges, a byte table maps bytes to characters and back."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cartolex.llm.common import KEPT, binary_column, byte_chunks, small_batches, tidy, working

#: Longer pieces are merged by the ranks of tokens at once.
CHECKED_BYTES = 256
#: Units that a worker keeps in each of two generations, and the characters of one at most.
KEPT_UNITS, KEPT_LENGTH = 80_000, 32
#: Pieces that the library gets in one text, kept apart by a character that is in none of them; bytes of texts in one pass.
BLOCK, APART, PASS_BYTES = 4000, "\0", 2 << 20


def byte_table() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}


def gathered(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + size], one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Decoder:
    """The bytes of ids, by the byte table turned round; a worker that only decodes holds nothing else."""

    built: dict = {}

    def __init__(self, named: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_table())}
        tokens = {i: bytes(map(back.__getitem__, name)) for name, i in named.items()}
        most = max(tokens, default=-1) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(most)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(most)), np.uint8)

    @classmethod
    def of(cls, key: int, text: bytes, *more):
        working("bpe")
        KEPT["bpe"] = _forget
        if (key, *more) not in cls.built:
            cls.built[key, *more] = cls(named_tokens(read_ranks(text)), *more)
        return cls.built[key, *more]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after another, and where each row of ids, which end at ``ends``, ends in them."""
        return gathered(self.start[ids], self.size[ids], self.bytes), np.concatenate([[0], np.cumsum(self.size[ids])])[ends]


def rank_merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by merging, again and again, the leftmost of the neighbours whose join has the lowest rank."""
    n = len(raw)
    after, before, token = [*range(1, n), -1], [-1, *range(n - 1)], [raw[i : i + 1] for i in range(n)]
    heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, joined = heappop(heap)
        j = after[i]
        if not token[i] or j < 0 or token[i] + token[j] != joined:
            continue  # one of the two has been merged since
        token[i], token[j], after[i] = joined, b"", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0 and (r := ranks.get(t := token[x] + token[after[x]])) is not None:
                heappush(heap, (r, x, t))
    return [ranks[t] for t in token if t]


def named_tokens(ranks: dict[bytes, int]) -> dict[str, int]:
    """Rank by the characters that stand for a token's bytes."""
    table = byte_table()
    return {"".join(table[b] for b in token): rank for token, rank in ranks.items()}


class Coder(Decoder):
    """Encodes and decodes with one set of ranks; built once in a Python worker."""

    built: dict = {}

    def __init__(self, named: dict[str, int], pattern: str):
        super().__init__(named)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = {self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes(): i for i in named.values()}
        merges, self.several = [], set()
        for token in sorted(named, key=named.get):
            halves = sorted((named[token[:i]], named[token[i:]], i) for i in range(1, len(token)) if token[:i] in named and token[i:] in named)
            merges += [(token[:i], token[i:]) for _, _, i in halves]
            if len(halves) > 1:
                at = self.start[named[token]]
                self.several.add(self.bytes[at : at + len(token)].tobytes())
        self.bpe = Tokenizer(models.BPE(vocab=named, merges=merges, ignore_merges=True, cache_capacity=0))
        self.bpe.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(APART, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(pattern).findall
        # the pattern of the rank files keeps words apart at a lone space, whatever stands around it
        self.by_words = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.wide = re.compile(r"^\s|\s\s|\s\Z").search

    def tied(self, raw: bytes) -> bool:
        """Whether a token that more than one pair of tokens makes occurs twice in a piece.

        The library's merges are pairs, each with a rank of its own; by the ranks of tokens, all pairs that make one token
        are equal and the leftmost goes first. Only where two such pairs stand in one piece can the two orders differ.
        """
        if len(raw) > CHECKED_BYTES:
            return True
        size = 3  # tokens of two bytes have one pair
        while True:
            seen: set[bytes] = set()
            twice = {g for i in range(len(raw) - size + 1) if (g := raw[i : i + size]) in seen or seen.add(g)}
            if not twice:
                return False
            if not self.several.isdisjoint(twice):
                return True
            size += 1

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces by the library's merges, and how many each has; where pairs of one token compete in a piece, by
        the ranks of tokens."""
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        alone = [k for k, p in enumerate(pieces) if APART in p] if APART in "".join(pieces) else []
        sent = list(pieces)
        for k in alone:
            sent[k] = "a"
        blocks = [APART.join(sent[i : i + BLOCK]) for i in range(0, len(sent), BLOCK)]
        ids = np.concatenate([np.array(x.ids, np.int64) for x in self.bpe.encode_batch_fast(blocks, add_special_tokens=False)])
        raw = np.frombuffer(APART.join([*blocks, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 0)
        size = np.diff(ends, prepend=-1) - 1
        # tokens and pieces end at the same bytes
        n = np.diff(np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size)), prepend=-1)
        number = np.repeat(np.arange(len(size)), size + 1)
        wide = raw.astype(np.int64)
        gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        gram = np.sort(((number[:-2] << 24) | gram)[(n[number[:-2]] > 1) & (raw[:-2] > 0) & (raw[1:-1] > 0) & (raw[2:] > 0)])
        twice = np.unique(gram[1:][gram[1:] == gram[:-1]] >> 24).tolist()
        other = {k: rank_merge(p, self.ranks) for k in twice if self.tied(p := pieces[k].encode())} | {k: rank_merge(pieces[k].encode(), self.ranks) for k in alone}
        if other:
            start, at = np.cumsum(n) - n, np.array(sorted(other))
            values = np.concatenate([ids, *(np.array(other[k], np.int64) for k in at)])
            fresh = np.array([len(other[k]) for k in at])
            start[at], n[at] = len(ids) + np.cumsum(fresh) - fresh, fresh
            ids = gathered(start, n, values)
        return ids, n

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, which pieces never cross, as 32-bit integers. Units that come again and again are kept in two
        generations: a new one begins when the last has KEPT_UNITS."""
        young, old = self.young, self.old
        found = [young.get(u) or old.get(u) for u in units]
        new = [k for k, x in enumerate(found) if x is None]
        pieces, parts = [], []
        for k in new:
            u = units[k]
            got = [u] if u[1:].isalpha() and (u[0] == " " or u[0].isalpha()) else self.split(u)
            pieces += got
            parts.append(len(got))
        ids, n = self.piece_ids(pieces)
        ends = (4 * np.concatenate([[0], np.cumsum(n)])[np.cumsum(parts, dtype=np.int64)]).tolist()
        raw, at = ids.astype(np.int32).tobytes(), 0
        for k, end in zip(new, ends, strict=True):
            found[k] = raw[at:end]
            at = end
        for u, x in zip(units, found, strict=True):
            if len(u) <= KEPT_LENGTH:
                young[u] = x
                if len(young) >= KEPT_UNITS:
                    self.old, self.young = young, {}
                    young, old = self.young, self.old
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and where each text ends in them. What texts share is encoded once."""
        plain = [bool(t) and self.by_words and not self.wide(t) for t in texts]
        units: list[str] = []
        codes: list = [np.empty(0, np.int64)] * len(texts)
        some = [i for i, p in enumerate(plain) if p]
        if some:
            lists = pc.split_pattern(pa.array([texts[i] for i in some], pa.large_string()), " ")
            off = lists.offsets.to_numpy()
            words = lists.flatten().dictionary_encode()
            first = lists.flatten().take(pa.array(off[:-1])).dictionary_encode()
            code = words.indices.to_numpy().astype(np.int64)
            units += [" " + w for w in words.dictionary.to_pylist()]
            code[off[:-1]] = len(units) + first.indices.to_numpy()
            units += first.dictionary.to_pylist()
            for i, a, b in zip(some, off[:-1], off[1:], strict=True):
                codes[i] = code[a:b]
        number: dict[str, int] = {}
        for i, p in enumerate(plain):
            if not p and texts[i]:
                codes[i] = np.array([number.setdefault(u, len(number)) for u in self.split(texts[i])], np.int64) + len(units)
        found = self.unit_ids([*units, *number])
        ids, size = np.frombuffer(b"".join(found), np.int32), np.array([len(x) >> 2 for x in found], np.int64)
        start = np.cumsum(size) - size
        order = np.concatenate(codes) if codes else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size[order])])[np.cumsum([len(c) for c in codes], dtype=np.int64)]
        return gathered(start[order], size[order], ids).astype(np.int64), ends

    def starts(self, text: str) -> list[int]:
        """The code point at which each token starts; tokens inside one split character share its place."""
        pieces = self.split(text)
        ids, _ = self.piece_ids(pieces)
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        point = np.cumsum((raw & 0xC0) != 0x80) - 1
        size = self.size[ids]
        return point[np.cumsum(size) - size].tolist()


def _forget() -> None:
    Decoder.built.clear()
    Coder.built.clear()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that end at ``ends``."""
    off = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _with(docs: DataFrame, added: str):
    return f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {added}"


def encode_bpe(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", offsets: bool = False, decode: bool = False) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; with ``offsets`` also ``starts`` (code points),
    with ``decode`` also ``decoded`` (binary: the bytes of the ids again, without a second set of workers).

    The columns of ``docs`` other than the text stay as they are; the text itself is dropped. Null text counts as empty
    and gives no tokens; bytes that are not UTF-8 count as U+FFFD. Rows are independent, so repeated rows repeat.
    Columns that are called ids, n_tokens, starts or decoded are replaced.
    ``ranks``: the content of the rank file, sent once to each executor (its size is fixed by the vocabulary).
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast(ranks), hash((ranks, pattern))
    kept = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "starts", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(key, sent.value, pattern)
        for batch in batches:
            for lo, hi, data, off in byte_chunks(binary_column(batch, text), PASS_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
                ids, ends = coder.encode(texts)
                part = batch.slice(lo, hi - lo)
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                cols += [_binary(ids.astype("<u4").view(np.uint8), 4 * ends), pa.array(np.diff(ends, prepend=0), pa.int64())]
                names = [*kept, "ids", "n_tokens"]
                if offsets:
                    cols.append(pa.array([coder.starts(t) for t in texts], pa.list_(pa.int32())))
                    names.append("starts")
                if decode:
                    cols.append(_binary(*coder.decode(ids, ends)))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    rest = docs.select(*[docs[c] for c in kept])
    added = "ids binary, n_tokens bigint" + ", starts array<int>" * offsets + ", decoded binary" * decode
    return docs.select(*kept, text).mapInArrow(tidy(run), _with(rest, added) if kept else added)


def decode_bpe(tokens: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids. A character that tokens split is whole again once they are joined.

    Null ids decode to no bytes. A column that is called decoded is replaced.
    """
    sent, key = tokens.sparkSession.sparkContext.broadcast(ranks), hash(ranks)
    kept = [c for c in tokens.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder.of(key, sent.value)
        for batch in batches:
            for lo, hi, data, off in byte_chunks(binary_column(batch, ids), PASS_BYTES):
                part = batch.slice(lo, hi - lo)
                out = _binary(*coder.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), off[1:] // 4))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), out], [*kept, "decoded"])

    return tokens.select(*kept).mapInArrow(tidy(run), _with(tokens.select(*kept), "decoded binary"))
