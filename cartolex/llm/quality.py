"""Quality by an interpolated modified Kneser-Ney word bigram model of trusted text over a character model that spells words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.llm import spelling
from cartolex.llm.common import binary_column, bit_table, byte_chunks, cut, in_table, mixed, sized, small_batches, tidy, trimmed, word_hashes

#: Stands before the first and after the last word of a text, so that it is counted as often in front as behind.
MARK = np.uint64(1)
#: Words are told apart by 48 bits of hash: 6 bytes each on their way.
WORD_BYTES = 6
#: Tokens that a task counts before it sends them, and tokens of all trusted text for each shard of pairs.
FLUSH, SHARD_TOKENS, LEAST_SHARDS = 1_000_000, 1_000_000, 32
#: Entries of the rest for each shard, and bytes of keys that meet them in one task.
REST_SHARD, ASKED_BYTES = 300_000, 32 << 20
#: Entries of the model that are sent to every executor: the most frequent ones, 40 MB at most. Texts are joined to the rest.
HEAD = 3_000_000
#: Bits of the table that tells a text's task which entries of the rest exist at all; it saves rows and decides nothing.
REST_BITS = 1 << 28
#: Words with more than a 32nd of all tokens are spread over the shards; a chunk reports those above half of that.
HOT = 32


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (h,), bounds = word_hashes(data, off, (0x9E3779B97F4A7C15,))
    return np.maximum(h >> np.uint64(64 - 8 * WORD_BYTES), MARK + np.uint64(1)), bounds


def tokens(data: np.ndarray, off: np.ndarray, cost: np.ndarray, end: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word and of the end of each row: the word, the one before, row, spelling (to half precision, as counted)."""
    word, bounds = word_keys(data, off)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    ends = bounds[1:] + np.arange(rows)
    w, s, owner = np.full(len(word) + rows, MARK), np.full(len(word) + rows, end), np.empty(len(word) + rows, np.int64)
    at = np.arange(len(word)) + row
    w[at], s[at], owner[at], owner[ends] = word, cost, row, np.arange(rows)
    before = np.concatenate([[MARK], w[:-1]]).astype(np.uint64)
    before[bounds[:-1] + np.arange(rows)] = MARK
    return w, before, owner, np.minimum(s, 60000.0).astype(np.float16).astype(np.float64)


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F) + token)


def single_keys(token: np.ndarray) -> np.ndarray:
    return mixed(token + np.uint64(0x2545F4914F6CDD1D))


def _packed(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").ravel()


def count_characters(known: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Of all rows: counts of running and of words' codes, of bytes, of tokens, and the words with a 32nd of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, words, byte, n = np.zeros(spelling.ENTRIES, np.int64), np.zeros(spelling.ENTRIES, np.int64), np.zeros(256, np.int64), 0
        hot: dict[int, int] = {}
        for batch in batches:
            for _, _, data, off in byte_chunks(binary_column(batch, text)):
                lines = spelling.Lines(data, off)
                running += np.bincount(lines.running(), minlength=spelling.ENTRIES)
                code, counted = lines.words()
                words += np.bincount(code[counted], minlength=spelling.ENTRIES)
                byte += np.bincount(data, minlength=256)
                word, _ = word_keys(data, off)
                n += len(word) + len(off) - 1
                each, times = np.unique(word, return_counts=True)
                for i in np.flatnonzero(times * 2 * HOT >= len(word)):
                    hot[int(each[i])] = hot.get(int(each[i]), 0) + int(times[i])
        for kind, codes, times in ((0, np.arange(spelling.ENTRIES), running), (1, np.arange(spelling.ENTRIES), words), (2, np.arange(256), byte), (3, np.zeros(1, np.int64), np.array([n])), (4, np.array(list(hot), np.int64), np.array(list(hot.values()), np.int64))):
            some = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int8)), pa.array(codes[some], pa.int64()), pa.array(times[some], pa.int64())], ["kind", "code", "n"])

    summed = cut(known.select(text).mapInArrow(tidy(run), "kind tinyint, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n")), "characters")
    n = int(summed.where("kind = 3").agg(F.sum("n")).first()[0] or 0)
    # two tables of SYMBOLS ** ORDER entries, 256 bytes and at most 2 * HOT words
    got = summed.where((F.col("kind") < 3) | ((F.col("kind") == 4) & (F.col("n") * 2 * HOT >= n))).toArrow()
    kind, code, times = (got[c].to_numpy() for c in ("kind", "code", "n"))
    out = []
    for k, size in ((0, spelling.ENTRIES), (1, spelling.ENTRIES), (2, 256)):
        table = np.zeros(size, np.int64)
        table[code[kind == k]] = times[kind == k]
        out.append(table)
    hot = np.sort(code[kind == 4]).astype(np.uint64)
    del got, kind, code, times
    trimmed()
    return *out, n, hot


def count_pairs(known: DataFrame, sent, n_tokens: int, hot: np.ndarray, text: str) -> DataFrame:
    """Counts of words and pairs of neighbours, from one shuffle of packed, pre-summed pairs in shards by the later word.

    Rows by ``kind``: 0 (a: 1 to 4, n: pairs that often), 1 (a: 1 to 4, n: words with that many words before them; a: 0, the
    sum of all), 2 (a: word, n: its tokens, c: distinct words before it, x: its spelling), 3 (a: word before, b: word, n:
    tokens of the pair, c and x of the word). Pairs and words that one text alone holds (told by 16 bits of the text's hash;
    copies are one text) come in the sums only. Words in ``hot`` are spread over shards, so their rows of kind 2 are partial
    and come in any case (b: the mark of the one text that holds them, or 0), and their pairs come with c = 0.
    """
    shards = max(LEAST_SHARDS, -(-n_tokens // SHARD_TOKENS))

    def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        w, v, mark, s = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = (mixed(w) % np.uint64(shards)).astype(np.int32)
        spread = np.isin(w, hot)
        shard[spread] = (mixed(w[spread] ^ mixed(v[spread])) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((v, w, shard))
        w, v, mark, s, shard = w[order], v[order], mark[order], s[order], shard[order]
        new_w = np.concatenate([[True], (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])])
        at = np.flatnonzero(new_w | np.concatenate([[True], v[1:] != v[:-1]]))
        lo, hi = np.minimum.reduceat(mark, at), np.maximum.reduceat(mark, at)
        text_mark = np.where(lo == hi, lo, 0).astype(np.uint16)
        n = np.diff(np.append(at, len(w))).astype(np.uint32)
        w, v, s, shard = w[at], v[at], s[at], shard[at]
        first = np.flatnonzero(new_w[at])
        runs = np.diff(np.append(first, len(w))).astype(np.uint32)
        ends, w_ends = np.searchsorted(shard, np.arange(shards + 1)), np.searchsorted(shard[first], np.arange(shards + 1))
        rows = [i for i in range(shards) if ends[i] < ends[i + 1]]
        cols: list[list[bytes]] = [[] for _ in range(6)]
        for i in rows:
            a, b, p, q = ends[i], ends[i + 1], w_ends[i], w_ends[i + 1]
            for c, x in zip(cols, (_packed(w[first[p:q]]), runs[p:q].tobytes(), s[first[p:q]].astype(np.float16).tobytes(), _packed(v[a:b]), n[a:b].tobytes(), text_mark[a:b].tobytes()), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["shard", "w", "runs", "s", "v", "n", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, byte = sent.value
        held, size = [], 0
        for batch in batches:
            marks = (batch.column(1).to_numpy().view(np.uint64) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
            for lo, hi, data, off in byte_chunks(binary_column(batch, text)):
                w, v, owner, s = tokens(data, off, spelling.Lines(data, off).spelled(table, byte), float(table[spelling.ALL_SPACES]))
                held.append((w, v, marks[lo:hi][owner], s))
                size += len(w)
                if size >= FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)

    def settled(key, group):
        w, s, v, n, mark = [], [], [], [], []
        for i in range(group.num_rows):
            cell = lambda c, i=i: group.column(c)[i].as_py()
            runs = np.frombuffer(cell("runs"), np.uint32)
            w.append(np.repeat(_unpacked(cell("w")), runs))
            s.append(np.repeat(np.frombuffer(cell("s"), np.float16), runs))
            v.append(_unpacked(cell("v")))
            n.append(np.frombuffer(cell("n"), np.uint32))
            mark.append(np.frombuffer(cell("mark"), np.uint16))
        w, s, v, n, mark = (np.concatenate(x) for x in (w, s, v, n, mark))
        order = np.lexsort((v, w))
        w, v, s = w[order], v[order], s[order]
        new_w = np.concatenate([[True], w[1:] != w[:-1]])
        at = np.flatnonzero(new_w | np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.add.reduceat(n[order].astype(np.int64), at)
        lo, hi = np.minimum.reduceat(mark[order], at), np.maximum.reduceat(mark[order], at)
        w, v, s, first = w[at], v[at], s[at], np.flatnonzero(new_w[at])
        c = np.diff(np.append(first, len(w)))
        low, high = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        solo = (low == high) & (low > 0)
        spread = np.isin(w[first], hot)
        word = np.flatnonzero(~solo | spread)
        pair = np.flatnonzero((lo != hi) | (lo == 0))
        of = np.repeat(np.arange(len(first)), c)[pair]
        each = np.where(spread, 0, c)
        kinds = [
            (0, np.arange(1, 5), None, np.bincount(np.minimum(n, 5), minlength=6)[1:5], None, None),
            (1, np.arange(5), None, np.concatenate([[each.sum()], np.bincount(np.minimum(each, 5), minlength=6)[1:5]]), None, None),
            (2, w[first[word]], np.where(solo, low, 0)[word], np.add.reduceat(n, first)[word], c[word], s[first[word]]),
            (3, v[pair], w[pair], n[pair], each[of], s[pair]),
        ]
        parts = []
        for kind, a, b, n_, c_, x in kinds:
            m = len(a)
            long = lambda y, m=m: pa.array(np.zeros(m, np.int64) if y is None else y.astype(np.int64), pa.int64())
            parts.append(pa.table({"kind": pa.array(np.full(m, kind, np.int8)), "a": long(a), "b": long(b), "n": long(n_), "c": long(c_), "x": pa.array(np.zeros(m, np.float32) if x is None else x.astype(np.float32))}))
        return pa.concat_tables(parts)

    packed = known.select(text, F.xxhash64(text).alias("_mark")).mapInArrow(tidy(run), "shard int, w binary, runs binary, s binary, v binary, n binary, mark binary")
    return cut(packed.groupBy("shard").applyInArrow(settled, "kind tinyint, a bigint, b bigint, n bigint, c bigint, x float"), "pairs")


def word_model(counts: DataFrame, hot: np.ndarray) -> tuple[DataFrame, float]:
    """The model as a sum: (key, value, n), and the log weight of spelling.

    log p(w | v) is the log weight of spelling, less the spelling of w, plus the value of w as a word and of v as the word
    before, which one entry holds together, plus the value of the pair; what is not counted has no entry and the value 0.
    The table grows with the text, stays sharded by key and meets others in equi-joins.
    """
    spark = counts.sparkSession
    sums = {(r["kind"], r["a"]): float(r["n"]) for r in counts.where("kind < 2").groupBy("kind", "a").agg(F.sum("n").alias("n")).collect()}  # nine numbers
    words = counts.where("kind = 2").select(F.col("a").alias("w"), F.col("b").alias("mark"), "n", "c", "x")
    pairs = counts.where("kind = 3").select(F.col("a").alias("v"), F.col("b").alias("w"), "n", "c", "x")
    if len(hot):
        # at most 2 * HOT words, summed over their shards
        whole = words.where(F.col("w").isin(hot.astype(np.int64).tolist())).groupBy("w").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("x").alias("x"), F.min("mark").alias("lo"), F.max("mark").alias("hi")).collect()
        for r in whole:
            for k in (0, r["c"] if r["c"] < 5 else 5):
                sums[1, k] = sums.get((1, k), 0.0) + (r["c"] if k == 0 else 1)
        table = spark.createDataFrame([(r["w"], r["n"], r["c"], r["x"], r["lo"] == r["hi"] > 0) for r in whole], "w long, n long, c long, x float, solo boolean")
        pairs = pairs.join(F.broadcast(table.select("w", F.col("c").alias("whole"))), "w", "left").select("v", "w", "n", F.coalesce("whole", "c").alias("c"), "x")
        words = words.where(~F.col("w").isin(hot.astype(np.int64).tolist())).drop("mark").unionByName(table.where("not solo").drop("solo"))
    total = sums.get((1, 0), 0.0)
    if not total:
        return spark.range(0).select(F.col("id").alias("key"), F.lit(0.0).cast("float").alias("value"), F.lit(0).cast("long").alias("n")), 0.0
    less = lambda n, cuts: n - F.when(n == 1, cuts[0]).when(n == 2, cuts[1]).otherwise(cuts[2])
    cut_two, cut_one = (spelling.discounts(*[sums.get((k, i), 0.0) for i in (1, 2, 3, 4)], least=0.05) for k in (0, 1))
    known = words.agg(F.sum(less(F.col("c"), cut_one))).first()[0] or 0.0
    rest = float(np.log(1 - known / total))
    p = less(F.col("c"), cut_one) / total + F.exp(rest - F.col("x"))
    behind = pairs.groupBy("v").agg(F.sum(less(F.col("n"), cut_two)).alias("held"))
    words = cut(words.join(behind, F.col("w") == F.col("v"), "left").select("w", "n", "c", "x", (F.col("n") - F.coalesce("held", F.lit(0.0))).alias("free")), "words")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            key = single_keys(a) if b.null_count else pair_keys(a, b.to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], ["v", "key", "x", "n"])

    hashed = lambda df: df.mapInArrow(keyed, "v bigint, key bigint, x float, n bigint")
    single = words.select(F.col("w").alias("v"), F.lit(None).cast("long").alias("w"), (F.log(p) - rest + F.col("x") + F.log(F.col("free") / F.col("n"))).cast("float").alias("x"), "n")
    double = hashed(pairs.select("v", "w", (less(F.col("n"), cut_two) / p).cast("float").alias("x"), "n")).join(words.select(F.col("w").alias("v"), "free"), "v")
    double = double.select("key", F.log1p(F.col("x") / F.col("free")).cast("float").alias("value"), "n")
    return cut(hashed(single).select("key", F.col("x").alias("value"), "n").unionByName(double), "model"), rest


class Head:
    """Entries by the first bits of their keys: where each start begins, the next 32 bits of the keys there, and the values."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        key, self.value = key[order], value[order]
        self.bits = max(8, int(len(key)).bit_length())
        self.start = np.searchsorted(key >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.tail = self._tail(key)
        self.most = int(np.diff(self.start).max(initial=0))

    def _tail(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(32 - self.bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def sums(self, key: np.ndarray, owner: np.ndarray, rows: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the values for each row, each counted so many ``times``, and which keys have none here."""
        first = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        at, left = self.start[first], self.start[first + 1]
        open_ = np.flatnonzero(at < left)
        at, left, tail = at[open_], left[open_], self._tail(key[open_])
        total, missed = np.zeros(rows), np.ones(len(key), bool)
        while len(open_):
            hit = self.tail[at] == tail
            found = open_[hit]
            total += np.bincount(owner[found], self.value[at[hit]] * (np.float64(1) if times is None else times[found]), rows)
            missed[found] = False
            at += 1
            on = ~hit & (at < left)
            open_, at, left, tail = open_[on], at[on], left[on], tail[on]
        return total, missed


def split_head(model: DataFrame, head: int) -> tuple[Head, DataFrame, int]:
    """The ``head`` most frequent entries at most, and the rest with its number of rows."""
    capped = F.least("n", F.lit(10_000))
    by_n = sorted(((r["n"], r["m"]) for r in model.groupBy(capped.alias("n")).agg(F.count("*").alias("m")).collect()), reverse=True)  # 10,000 rows at most
    room, limit, part = head, 0, 0
    for n, m in by_n:
        if m > room:
            limit, part = n, room * 1024 // m
            break
        room -= m
    inside = (capped > limit) | ((capped == limit) & (F.pmod(F.col("key"), F.lit(1024)) < part))
    got = model.where(inside).select("key", "value").toArrow()  # ``head`` rows at most
    return Head(got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()), model.where(~inside), sum(m for _, m in by_n) - got.num_rows


#: What scoring gives of texts and of what they ask.
ROW = {"part": "bigint", "i": "bigint", "t": "bigint", "n": "bigint", "x": "double", "y": "double", "shard": "int", "keys": "binary", "ns": "binary", "ids": "binary"}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}


def _row(**cols) -> pa.RecordBatch:
    size = len(cols["part"])
    return pa.RecordBatch.from_arrays([pa.array(cols[c], _ARROW[k]) if c in cols else pa.nulls(size, _ARROW[k]) for c, k in ROW.items()], list(ROW))


def judge_quality(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.999, margin: float = 0.05, slack: float = 0.35, head: int = HEAD) -> DataFrame:
    """Adds to every row ``perplexity``, ``threshold`` and ``kept``: perplexity at most the threshold of its language.

    The model counts the words and the pairs of neighbouring words of all trusted text, with no bound on either; words that it
    has not counted are spelled by character. Words and pairs that one text alone holds count for the discounts and the
    weight of what is unseen, and are unseen themselves: else trusted texts would be judged by what they alone have brought.
    Perplexity is that of a character. A row is kept if a model of the classes of characters in running text, under its own
    threshold, keeps it as well: that one sees repeated words, which the word model lets pass.

    ``trusted``: the ids of trusted documents (column doc_id); the model counts all of their text. A language's threshold is
    exp(log quantile + margin + slack / sqrt(characters / 100)): the ``quantile`` of its trusted documents' log-perplexities,
    with more room for short texts, whose averages scatter. Languages without trusted documents, null among them, take the
    quantile over all. Null texts and those without a word have perplexity null and are rejected; without any trusted
    document all others are kept. Rows are judged one by one, so repeated rows repeat, and any two rows of one text have one
    value; a text of any length is judged whole. Columns of the added names are replaced; an empty table gives no rows.

    ``head``: the most frequent entries of the model, that many, are sent to every executor; texts are joined to the rest by
    key, those keys alone that a table of bits does not rule out. The result does not depend on ``head``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = ("perplexity", "threshold", "kept")
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*kept)
    ids = sized(trusted.select(F.col("doc_id").alias(doc_id)).dropna().distinct(), 24)
    theirs = docs.join(ids, doc_id, "left_semi").where(F.col(text).isNotNull()).select(lang, text)

    running, words, byte, n_tokens, hot = count_characters(theirs, text)
    tables = [(-np.log(np.maximum(spelling.kneser_ney(t), 1e-12))).astype(np.float32) for t in (running, words)]
    sent = spark.sparkContext.broadcast((*tables, spelling.byte_costs(byte)))
    counts = count_pairs(theirs, sent, n_tokens, hot, text)
    model, rest = word_model(counts, hot)
    top, others, n_others = split_head(model, head)
    sent_top = spark.sparkContext.broadcast(top)
    del top
    trimmed()
    bits = spark.sparkContext.broadcast(bit_table(others.select(F.col("key").alias("k")), n_others, REST_BITS)) if n_others else None

    shards = max(1, -(-n_others // REST_SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every text, by its hash t and number i in a part: characters n, the loss x of the words as far as it is known
        here, the loss y of the classes. Of the keys that the rest may hold, by shard: the keys, how often and in which text."""
        classes, table, costs = sent.value
        part, i, held = TaskContext.get().partitionId() << 32, 0, []

        def asked() -> pa.RecordBatch:
            key, n, own = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = np.mod(key.view(np.int64), shards)
            order = np.lexsort((own, shard))
            key, n, own, shard = key[order] >> np.uint64(16), n[order].astype(np.uint32), own[order].astype(np.uint32), shard[order]
            ends = np.searchsorted(shard, np.arange(shards + 1))
            some = [(j, slice(ends[j], ends[j + 1])) for j in range(shards) if ends[j] < ends[j + 1]]
            return _row(part=[part] * len(some), shard=[j for j, _ in some], keys=[_packed(key[x]) for _, x in some], ns=[n[x].tobytes() for _, x in some], ids=[np.diff(own[x], prepend=np.uint32(0)).tobytes() for _, x in some])

        for batch in batches:
            hashes = batch.column(0).to_numpy()
            for lo, hi, data, off in byte_chunks(binary_column(batch, text)):
                t, one = np.unique(hashes[lo:hi], return_index=True)  # copies ask once
                rows, lines = hi - lo, spelling.Lines(data, off)
                number = np.full(rows, -1)
                number[one] = np.arange(i, i + len(t))
                w, v, owner, s = tokens(data, off, lines.spelled(table, costs), float(table[spelling.ALL_SPACES]))
                sums = np.concatenate([[0.0], np.cumsum(classes[lines.running()], dtype=np.float64)])
                size = np.diff(lines.chars)
                loss = np.bincount(owner, s - rest, rows)
                for key in (pair_keys(v, w), single_keys(w)):
                    gain, missed = sent_top.value.sums(key, owner, rows)
                    loss -= gain
                    if bits is None:
                        continue
                    missed &= number[owner] >= 0
                    missed[missed] = in_table(bits.value, key[missed])
                    key, own = key[missed], number[owner[missed]]
                    if len(key):
                        order = np.lexsort((key, own))
                        key, own = key[order], own[order]
                        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
                        held.append((key[at], np.diff(np.append(at, len(key))), own[at]))
                n = np.where(np.bincount(owner, minlength=rows) > 1, size, 0)
                yield _row(part=[part] * len(t), i=range(i, i + len(t)), t=t, n=n[one], x=loss[one], y=((sums[lines.chars[1:]] - sums[lines.chars[:-1]]) / np.maximum(1, size))[one])
                i += len(t)
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield asked()
                    part, i, held = part + 1, 0, []
        if held:
            yield asked()

    def answered(key, asks, rest_):
        keys = rest_.column("key").to_numpy().view(np.uint64)
        of = Head(keys & ~np.uint64(0xFFFF), rest_.column("value").to_numpy())
        parts, ids, sums = [], [], []
        for r in range(asks.num_rows):
            own = np.cumsum(np.frombuffer(asks.column("ids")[r].as_py(), np.uint32), dtype=np.uint32)
            each, back = np.unique(own, return_inverse=True)
            total, _ = of.sums(_unpacked(asks.column("keys")[r].as_py()) << np.uint64(16), back, len(each), np.frombuffer(asks.column("ns")[r].as_py(), np.uint32))
            some = total != 0
            parts.append(asks.column("part")[r].as_py())
            ids.append(each[some].tobytes())
            sums.append(total[some].tobytes())
        return pa.table({"part": pa.array(parts, pa.int64()), "ids": pa.array(ids, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def summed(key, group):
        ids = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("ids")])
        each, back = np.unique(ids, return_inverse=True)
        g = np.bincount(back, np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in group.column("sums")]), len(each))
        return pa.table({"part": pa.array([key[0].as_py()] * len(each), pa.int64()), "i": pa.array(each.astype(np.int64)), "g": pa.array(g)})

    found = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), text).mapInArrow(tidy(run), ", ".join(f"{c} {k}" for c, k in ROW.items()))
    if n_others:
        found = cut(found, "found")
        asks, entries = found.where("shard is not null").select("part", "shard", "keys", "ns", "ids"), others.select(F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"), "key", "value")
        size = asks.agg(F.sum(F.length("keys"))).first()[0] or 0
        slices = max(1, -(-size // (shards * ASKED_BYTES)))
        asks = asks.withColumn("slice", F.pmod(F.xxhash64("part"), F.lit(slices)).cast("int"))
        entries = entries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        replies = asks.groupBy("shard", "slice").cogroup(entries.groupBy("shard", "slice")).applyInArrow(answered, "part bigint, ids binary, sums binary")
        more = replies.groupBy("part").applyInArrow(summed, "part bigint, i bigint, g double")
        found = found.where("shard is null").join(more, ["part", "i"], "left").withColumn("x", F.col("x") - F.coalesce("g", F.lit(0.0)))
    # a text comes once for each chunk that holds copies of it, with the same numbers
    seen = found.groupBy("t").agg(*[F.max(c).alias(c) for c in ("n", "x", "y")])
    seen = cut(seen.select("t", F.col("n").alias("_chars"), (F.col("x") / F.greatest(F.lit(1), "n")).alias("_loss"), F.col("y").alias("_classes")), "scores")
    # no later plan runs what was sent
    for x in (sent, sent_top, *([bits] if bits else [])):
        x.unpersist()
    by_text = sized(seen, 64)

    def scores(some: DataFrame) -> DataFrame:
        """Adds _chars, _loss (of the word model) and _classes (of the other), both for a character; null texts have none."""
        return some.withColumn("_t", F.xxhash64(text)).join(by_text, (F.col("_t") == by_text["t"]) & F.col(text).isNotNull(), "left").withColumn("_chars", F.coalesce("_chars", F.lit(0))).drop("_t", "t")

    room = slack / F.sqrt(F.greatest(F.lit(1), "_chars") / 100)
    # thresholds need the numbers of the trusted documents alone
    sample = cut(scores(theirs).drop(text), "trusted").where("_chars > 0").select(lang, (F.col("_loss") - room).alias("a"), (F.col("_classes") - room).alias("b"))
    # exact on a grid of 0.0001, so that reruns agree and a task holds as many values as the grid has
    at = [F.percentile(F.round(c, 4), quantile).alias(f"_{c}") for c in ("a", "b")]
    overall = sample.agg(*at).first()
    by_lang = cut(sample.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(*at), "thresholds")
    out = scores(docs).join(sized(by_lang, 64), F.col(lang) == F.col("_lang"), "left")
    limit = lambda c: F.coalesce(f"_{c}", F.lit(overall[f"_{c}"])) + margin + room
    fits: Column = F.coalesce(F.col("_loss") <= limit("a"), F.lit(True)) & F.coalesce(F.col("_classes") <= limit("b"), F.lit(True))
    some = F.col("_chars") > 0
    return out.select(*kept, F.when(some, F.exp("_loss")).alias("perplexity"), F.when(some, F.exp(limit("a"))).alias("threshold"), (some & fits).alias("kept"))
