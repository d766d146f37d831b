"""Repeated passages by level-wise doubling: only windows that repeat at one length are extended to twice that length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import BROADCAST_BYTES, binary_column, byte_chunks, cut, mixed, sized, small_batches, window_hashes, word_hashes

#: The words of a text's bytes.
_WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall
_BASES = (0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25)
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: The survivors of the first level are sent as a bit table of at most this size; with more than its eighth, they are joined.
TABLE_BITS = 1 << 28


def _first_of_run(value: np.ndarray, span: int) -> np.ndarray:
    """Places of the leftmost least value in each run of ``span`` consecutive values."""
    if len(value) < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(value, span)
    out = np.empty(len(view), np.int64)
    for i in range(0, len(view), 1 << 17):
        part = view[i : i + (1 << 17)]
        out[i : i + len(part)] = part.argmin(1) + np.arange(i, i + len(part))
    return out


def _windows(data, off, window: int, short: int):
    """Of the rows in a slice: word offsets; rows of all windows; for each window the place of its anchor; anchor hashes.

    The anchor of a window is its leftmost short run of least hash, so equal windows have equal anchors.
    """
    words, bounds = word_hashes(data, off, _BASES)
    grams = window_hashes(words[0], short, _STEP[0])
    anchor = _first_of_run(grams, window - short + 1)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    whole = row[: len(anchor)] == row[window - 1 :] if len(anchor) else np.empty(0, bool)
    return words, bounds, row, np.flatnonzero(whole), anchor, grams


def _anchor_rows(batch: pa.RecordBatch, window: int, short: int):
    """(row numbers, anchor hashes) of a batch of id, tag and text."""
    for lo, _, data, off in byte_chunks(binary_column(batch, "text")):
        _, _, row, whole, anchor, grams = _windows(data, off, window, short)
        at = np.unique(anchor[whole])
        yield pa.array(row[at] + lo), _signed(grams[at])


def _signed(v: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(v).view(np.int64), pa.int64())


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys) & np.uint64(bits - 1)).astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (binary: the kept words joined by one space).

    A word goes when a window of ``window`` consecutive words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null text has no words; rows with a null id neither remove nor lose anything;
    rows that share an id do not remove each other's words. Texts with fewer words than a window stay. Other columns are
    not used; an empty table gives no rows.

    Levels: runs of half a window first, of those only each window's anchor (its run of least hash), then whole windows
    around repeated anchors. Whole windows meet by 128 bits of hash in one shuffle, sorted by id, so that a stream over them
    sees the smallest first. Windows that hold more than a 2000th of the anchors' rows, at most 2000, are summed before any
    shuffle and never enter that one. Exact copies leave before the first level: all but the smallest id of a text with a
    window or more lose every word. (Texts of one id are told apart by 31 bits of their digest.)
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    short = (window + 1) // 2
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tk", F.unhex(F.md5("text")))
    rows = rows.withColumn("tag", F.conv(F.substring(F.hex("tk"), 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF))
    texts = rows.where("doc_id is not null").groupBy("tk").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    copies = cut(rows.where("doc_id is not null").select("doc_id", "tag", "tk").join(sized(texts.select("tk", "rep"), 40), "tk").where("doc_id > rep").select("doc_id", "tag").distinct(), "copies")
    reps = rows.where("doc_id is not null").join(sized(copies, 24), ["doc_id", "tag"], "left_anti").select("doc_id", "tag", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in byte_chunks(binary_column(batch, "text")):
                _, _, row, whole, anchor, grams = _windows(data, off, window, short)
                at = np.unique(anchor[whole])
                key, owner = grams[at], row[at]
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([_signed(key[new])], ["g"])

    # a run that two rows hold; each row gives it once
    again = cut(reps.select("text").mapInArrow(anchors, "g bigint").groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "anchors")
    n_again, held = again.agg(F.count("*"), F.sum("m")).first()
    bits = 1 << min(max(16, int(16 * n_again).bit_length()), table_bits.bit_length() - 1)

    if n_again * 8 > table_bits:
        with_key = lambda batches: (pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), g], ["doc_id", "tag", "g"]) for b in batches for i, g in _anchor_rows(b, window, short))
        per_doc = reps.mapInArrow(with_key, f"doc_id {kind}, tag bigint, g bigint").join(again, "g").groupBy("doc_id", "tag").agg(F.collect_set("g").alias("gs"))
        level = reps.join(per_doc, ["doc_id", "tag"]).select("doc_id", "tag", "text", "gs")
        sent = None
    else:
        place = lambda batches: (pa.RecordBatch.from_arrays([_signed(_place(b.column(0).to_numpy().view(np.uint64), bits).view(np.uint64))], ["p"]) for b in batches)
        words = again.select("g").mapInArrow(place, "p bigint").groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
        found = words.toArrow()  # at most table_bits / 64 rows, whatever the input
        table = np.zeros(bits // 64, np.int64)
        table[found["w"].to_numpy()] = found["b"].to_numpy()
        sent = spark.sparkContext.broadcast(table)
        level = reps

    def candidates(batch: pa.RecordBatch, only: np.ndarray | None):
        """Of the windows around repeated anchors (around those in ``only``): hashes, row of the batch, place in the row."""
        for lo, hi, data, off in byte_chunks(binary_column(batch, "text")):
            words, bounds, row, whole, anchor, grams = _windows(data, off, window, short)
            if only is not None:
                good = np.isin(grams, only)
            elif sent is not None:
                at = _place(grams, bits)
                good = (sent.value[at >> 6] >> (at & 63)) & 1 == 1
            else:
                good = np.zeros(len(grams), bool)
                for r in range(lo, hi):
                    own = slice(bounds[r - lo], min(bounds[r - lo + 1], len(grams)))
                    good[own] = np.isin(grams[own], np.array(batch.column(3)[r].as_py(), np.int64).view(np.uint64))
            at = whole[good[anchor[whole]]]
            keys = [window_hashes(w, window, s)[at] for w, s in zip(words, _STEP, strict=True)]
            yield keys[0], keys[1], row[at] + lo, at - bounds[row[at]]

    # windows that very many rows hold
    often = max(1000, (held or 0) // 2000)
    hot_anchors = np.array([r["g"] for r in again.where(F.col("m") > often).select("g").collect()], np.int64).view(np.uint64)  # at most 2000
    hot: dict = {}
    if len(hot_anchors):
        def near_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each task sums its own windows first."""
            held: list[pd.DataFrame] = []

            def summed() -> pd.DataFrame:
                return pd.concat(held).groupby(["h1", "h2"], as_index=False, sort=False).agg(m=("m", "sum"), lo=("lo", "min"))

            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for a, b, r, _ in candidates(batch, hot_anchors):
                    if len(a):
                        held.append(pd.DataFrame({"h1": a.view(np.int64), "h2": b.view(np.int64), "m": np.ones(len(a), np.int64), "lo": ids[r]}))
                if sum(map(len, held)) > 1_000_000:
                    held = [summed()]
            if held:
                out = summed()
                yield pa.RecordBatch.from_arrays([pa.array(out["h1"]), pa.array(out["h2"]), pa.array(out["m"], pa.int64()), pa.array(out["lo"], from_pandas=True)], ["h1", "h2", "m", "lo"])

        many = reps.mapInArrow(near_hot, f"h1 bigint, h2 bigint, m bigint, lo {kind}").groupBy("h1", "h2").agg(F.sum("m").alias("m"), F.min("lo").alias("lo")).where(F.col("m") > often)
        hot = {(r["h1"], r["h2"]): r["lo"] for r in many.orderBy(F.desc("m")).limit(2000).collect()}
    hot_sent = spark.sparkContext.broadcast(hot)

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of windows; those of hot windows come decided: no hash and only where a smaller id holds them."""
        hot = hot_sent.value
        firsts = np.array([k[0] for k in hot], np.int64)
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1).to_numpy()
            for a, b, r, at in candidates(batch, None):
                a, b = a.view(np.int64), b.view(np.int64)
                pos, own = (tags[r] << 32) | at, ids.take(pa.array(r))
                sort = np.zeros(len(a), np.int8)
                if hot:
                    for i in np.flatnonzero(np.isin(a, firsts)):
                        lo = hot.get((int(a[i]), int(b[i])))
                        if lo is not None:
                            sort[i] = 1 if own[int(i)].as_py() > lo else 2
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), own, pa.array(pos, pa.int64()), pa.array(sort)], ["h1", "h2", "doc_id", "pos", "decided"]).filter(pa.array(sort < 2))

    second = level.mapInArrow(whole_windows, f"h1 bigint, h2 bigint, doc_id {kind}, pos bigint, decided tinyint")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows those whose id is larger than the first one with the same hashes."""
        last, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = last != (a[0], b[0])
            start = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            ids = batch.column(2)
            values = ids.to_numpy(zero_copy_only=False)
            first = values[np.maximum(start, 0)]
            if start[0] < 0:
                first = np.where(start < 0, least, first) if values.dtype == object else np.where(start < 0, np.asarray(least, values.dtype), first)
            last, least = (a[-1], b[-1]), first[-1]
            yield pa.RecordBatch.from_arrays([ids, batch.column(3)], ["doc_id", "pos"]).filter(pa.array(np.asarray(values > first, bool)))

    settled = second.where("decided = 1").select("doc_id", "pos")
    open_ = second.where("decided = 0").select("h1", "h2", "doc_id", "pos").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id")
    taken = open_.mapInArrow(later, f"doc_id {kind}, pos bigint")
    if hot:
        taken = taken.unionByName(settled)
    taken = taken.select("doc_id", F.shiftright("pos", 32).alias("tag"), F.col("pos").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches [start, end) of words that the windows at these places cover."""
        for batch in batches:
            starts, ends = [], []
            for places in batch.column(2):
                at = np.sort(places.values.to_numpy(zero_copy_only=False))
                gap = np.flatnonzero(np.diff(at) > window)
                starts.append(at[np.concatenate([[0], gap + 1])].tolist())
                ends.append((at[np.concatenate([gap, [len(at) - 1]])] + window).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "tag", "starts", "ends"])

    # places of one text, as many as it has words at most
    shape = "starts array<int>, ends array<int>"
    covered = taken.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at")).mapInArrow(spans, f"doc_id {kind}, tag bigint, {shape}")
    nothing = F.lit(None).cast("array<int>")
    lost = cut(covered.unionByName(copies.select("doc_id", "tag", nothing.alias("starts"), nothing.alias("ends"))), "lost")
    size = lost.agg(F.sum(F.lit(48) + 8 * F.greatest(F.size("starts"), F.lit(0)))).first()[0] or 0

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched, starts, ends = (batch.column(i).to_pylist() for i in (2, 3, 4))
            count, gone, left = [], [], []
            for i, raw in enumerate(binary_column(batch, "text")):
                words = _WORD(raw.as_py())
                n = len(words)
                count.append(n)
                if touched[i] and n >= window:
                    keep, at = [], 0
                    for a, b in zip(starts[i], ends[i], strict=True) if starts[i] is not None else [(0, n)]:
                        keep += words[at:a]
                        at = b
                    words = keep + words[at:]
                gone.append(n - len(words))
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    lost = lost.withColumn("touched", F.lit(True))
    both = rows.join(F.broadcast(lost) if size <= BROADCAST_BYTES else lost, ["doc_id", "tag"], "left")
    return both.select("doc_id", "text", "touched", "starts", "ends").mapInArrow(kept, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")
