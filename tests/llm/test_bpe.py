"""Byte-level BPE against the tiktoken library, text by text."""

import base64
import random
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

from cartolex.llm import bpe

RANKS = Path(P.path("byte_bpe_multi_50k.tiktoken")).read_bytes()


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["\0", "the", " ", "  ", "\n", "\t", "ing", "é", "ß", "日本", "😀", "'s", "'", "!!", "=====", "aaaaaaa", "anananan", "12345", ".", " ", "\u0085", "İ", "\r\n", "x" * 60, "<|endoftext|>", "é", "Ⅷ", "़"]
    yield from ["", " ", "\n", "a\n \nw", "a\n\n b", " \n", "a  b", "a   b", "don't we'll", "word " * 50, "=" * 37, "ab" * 33, "\n".join(["one two", "three", "four five six"])]
    for _ in range(1500):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.named_tokens(bpe.read_ranks(RANKS)), P.PATTERN)


def test_same_ids_as_the_rank_merge_of_the_other_library(exact, coder):
    some = list(texts())
    ids, ends = coder.encode(some)
    raw, raw_ends = coder.decode(ids, ends)
    at = back = 0
    for t, end, raw_end in zip(some, ends, raw_ends, strict=True):
        assert ids[at:end].tolist() == exact.encode_ordinary(t), repr(t)
        assert raw[back:raw_end].tobytes() == t.encode()
        assert coder.encode([t])[0].tolist() == exact.encode_ordinary(t), repr(t)
        at, back = end, raw_end


def test_same_ids_on_whole_documents(exact, coder):
    import pyarrow.parquet as pq

    docs = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids, ends = coder.encode(docs)
    assert ids.tolist() == [i for t in docs for i in exact.encode_ordinary(t)] and len(ends) == len(docs)


def test_ties_are_found(exact, coder):
    """Pieces of few letters, where pairs of one token compete."""
    rng = random.Random(3)
    pieces = [" " * rng.randint(0, 1) + "".join(rng.choice("aenst") for _ in range(rng.randint(4, 14))) for _ in range(30000)]
    ids, n = coder.piece_ids(pieces)
    ends = n.cumsum()
    want = [exact.encode_ordinary(p) for p in pieces]
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want
    plain = [x.ids for x in coder.bpe.encode_batch_fast(pieces, add_special_tokens=False)]
    assert all(coder.tied(p.encode()) for p, a, b in zip(pieces, plain, want, strict=True) if a != b)
    long = "zaz" * 40000
    assert coder.encode([long])[0].tolist() == exact.encode_ordinary(long)


def test_starts_share_split_characters(coder):
    t = "日 😀a"
    starts, (ids, _) = coder.starts(t), coder.encode([t])
    assert len(starts) == len(ids) and starts == sorted(starts) and max(starts) < len(t)


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "z" * 30000 + " é", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    back = bpe.decode_bpe(bpe.encode_bpe(docs, RANKS, P.PATTERN, offsets=True), RANKS)
    assert back.columns == ["doc_id", "ids", "n_tokens", "starts", "decoded"]
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode(), r["n_tokens"]) for r in back.collect())
    assert [g[:2] for g in got] == sorted((d or 0, t or "") for d, t, _ in rows) and got[0][2] == 0
    assert bpe.encode_bpe(docs.limit(0), RANKS, P.PATTERN).count() == 0
