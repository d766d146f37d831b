"""MinHash near-duplicates: universal hash minima, bands, signature check, full-set confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import binary_column, byte_chunks, cut, forest, mixed, sized, small_batches, tidy, window_hashes, word_hashes, working
from cartolex.llm.components import components

#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 5e-8.
BANDS, ROWS = 32, 4
#: Members of one tile of a bucket at most, and shingles of all of them about.
TILE, TILE_KEYS = 1024, 400_000
#: Agreeing bits of the 128 one-bit minima that a pair needs: at similarity 0.8, 115 are expected; 92 is 6 deviations less.
LEAST_BITS = 92
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift on 32-bit keys is strongly universal: odd and even 64-bit factors from a fixed seed."""
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False), rng.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False)


def shingle_sets(col: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of a slice's rows, their row offsets).

    Words are lower-cased A-Z; a row with fewer words than ``size`` has its whole sequence as one shingle.
    """
    for lo, hi, data, off in byte_chunks(col):
        (word,), bounds = word_hashes(data, off, _BASES[:1], lower=True)
        n = np.diff(bounds)
        row = np.repeat(np.arange(hi - lo), n)
        grams = window_hashes(word, size, _BASES[1])
        whole = row[: len(grams)] == row[size - 1 :] if len(grams) else np.empty(0, bool)
        keys, rows = grams[whole], row[: len(grams)][whole]
        few = np.flatnonzero((n > 0) & (n < size))
        if len(few):
            extra = []
            for r in few:
                part = word[bounds[r] : bounds[r + 1]]
                extra.append(mixed(window_hashes(part, len(part), _BASES[0]) + np.uint64(len(part)))[0])
            keys, rows = np.concatenate([keys, np.array(extra, np.uint64)]), np.concatenate([rows, few])
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
        yield lo, keys, np.searchsorted(rows, np.arange(hi - lo + 1))


def _sketches(size: int, doc_id: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("minhash")
        a, b = _universal()
        shift = np.uint64(32)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(doc_id))
            for lo, keys, off in shingle_sets(binary_column(batch, text), size):
                rows = len(off) - 1
                n = np.diff(off)
                full = np.flatnonzero(n)
                minima = np.zeros((BANDS * ROWS, rows), np.uint64)
                one = np.zeros(rows, np.uint64)
                two = np.zeros(rows, np.uint64)
                if len(full):
                    at, x = off[:-1][full], keys >> shift
                    for k in range(BANDS * ROWS):
                        minima[k, full] = np.minimum.reduceat((x * a[k] + b[k]) >> shift, at)
                    one[full], two[full] = np.add.reduceat(keys, at), np.add.reduceat(mixed(keys), at)
                bands = np.zeros((BANDS, rows), np.uint64)
                for k in range(BANDS * ROWS):
                    bands[k // ROWS] = mixed(bands[k // ROWS] ^ minima[k])
                bits = (mixed(minima) & np.uint64(1)).astype(np.uint64)
                weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None]
                half = BANDS * ROWS // 2
                signed = lambda v: pa.array(v.view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, rows),
                        pa.array(n, pa.int64()),
                        signed(one),
                        signed(two),
                        signed((bits[:half] * weights).sum(0, dtype=np.uint64)),
                        signed((bits[half:] * weights).sum(0, dtype=np.uint64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), signed(np.ascontiguousarray(bands.T).ravel())),
                    ],
                    ["doc_id", "n", "k1", "k2", "s1", "s2", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("minhash")
        for batch in batches:
            ids = batch.column(0)
            for lo, keys, off in shingle_sets(binary_column(batch, "text"), size):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(off) - 1), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(keys.view(np.int64), pa.int64()))], ["rep", "keys"])

    return run


def _block_links(percent: int):
    """Compares the sets of two tiles of a bucket where components differ."""

    def run(key, group):
        group = group.combine_chunks()
        n = group.num_rows
        labels, second = group.column("label").combine_chunks(), group.column("second").to_numpy()
        code = labels.dictionary_encode().indices.to_numpy()
        keys = group.column("keys").combine_chunks()
        size = keys.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(n), size)
        _, number, times = np.unique(keys.flatten().to_numpy(), return_inverse=True, return_counts=True)
        # keys of one member meet none
        shared = times[number] > 1
        owner, number = owner[shared], number[shared]
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        left, right = (np.arange(n),) * 2 if key[2] == key[3] else (np.flatnonzero(~second), np.flatnonzero(second))
        both = np.zeros((len(left), len(right)), np.int64)
        at = 0
        while at < len(number):
            end = int(np.searchsorted(number, number[at] + 4096))
            cells = np.zeros((n, 4096), np.float32)
            cells[owner[at:end], number[at:end] - number[at]] = 1
            both += (cells[left] @ cells[right].T).astype(np.int64)  # 4096 at most, exact
            at = end
        link = both * 100 >= (size[left][:, None] + size[right][None, :] - both) * percent
        link &= code[left][:, None] != code[right][None, :]
        u, v = np.nonzero(link)
        root = forest(left[u], right[v], n)
        some = np.flatnonzero(root != np.arange(n))
        ids = group.column("rep").combine_chunks()
        return pa.table({"u": ids.take(pa.array(some)), "v": ids.take(pa.array(root[some]))})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; ``component_id`` is the
    smallest doc_id that links reach, ``kept`` says that it is the row's own. Texts that are null or hold no word have an
    empty set and stand alone; so do rows with a null id (component_id null, kept true). Repeated rows are copies of each
    other under one id. Texts of any length count whole. Other columns are not used. An empty table gives no rows.

    Copies (equal sets) are one class first. A bucket then links its members to its smallest one; only buckets that this
    leaves with different components compare their members with each other, tile by tile, so that a large group of near
    copies costs one comparison a member and band, and no link between different components is lost.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketch = cut(rows.mapInArrow(tidy(_sketches(size, "doc_id", "text")), f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, s1 bigint, s2 bigint, bands array<bigint>"), "sketch")
    known = sketch.where("doc_id is not null and n > 0")
    first = cut(known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")), "classes")
    banded = first.select("rep", "n", "s1", "s2", F.posexplode("bands").alias("band", "hash"))
    head = banded.groupBy("band", "hash").agg(F.min("rep").alias("head"), F.count("*").alias("m")).where("m > 1").select("band", "hash", "head")
    shared = cut(banded.join(head, ["band", "hash"]), "buckets")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) with sizes and signatures that the similarity allows."""
        bits = F.lit(128) - F.bit_count(F.col("us1").bitwiseXOR(F.col("vs1"))) - F.bit_count(F.col("us2").bitwiseXOR(F.col("vs2")))
        return pairs.where((F.least("un", "vn") * 100 >= F.greatest("un", "vn") * percent) & (bits >= LEAST_BITS)).select("u", "v").distinct()

    def full_sets(wanted: DataFrame) -> DataFrame:
        """The sets of some rows: rep, keys."""
        texts = rows.join(sized(wanted, 24), "doc_id", "left_semi")
        return cut(texts.mapInArrow(tidy(_sets(size)), f"rep {kind}, keys array<bigint>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm."""
        sets = full_sets(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct())
        u, v = sets.select(F.col("rep").alias("u"), F.col("keys").alias("uk")), sets.select(F.col("rep").alias("v"), F.col("keys").alias("vk"))
        both = F.size(F.array_intersect("uk", "vk"))
        return pairs.join(u, "u").join(v, "v").where(both * 100 >= (F.size("uk") + F.size("vk") - both) * percent).select("u", "v").distinct()

    star = shared.where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v"), F.col("n").alias("un"), F.col("s1").alias("us1"), F.col("s2").alias("us2")).distinct()
    star = star.join(first.select(F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("s1").alias("vs1"), F.col("s2").alias("vs2")), "v")
    joined = components(linked(cut(near(star), "pairs")))

    # what a bucket still holds of different components: its members' full sets meet in tiles, and a task gives a forest of
    # the links that it finds, at most one row for each member
    label = joined.select(F.col("u").alias("rep"), F.col("v").alias("label"))
    marked = shared.select("band", "hash", "rep", "n").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    split = marked.groupBy("band", "hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_KEYS)).cast("int").alias("tiles"), F.struct(F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64(F.lit(1), "rep")), F.count("*")).alias("sums")).where("lo < hi").select("band", "hash", "tiles", "sums")
    # buckets of the same members hold the same pairs: one of them is compared
    split = split.groupBy("sums").agg(F.min_by(F.struct("band", "hash", "tiles"), F.struct("band", "hash")).alias("b")).select("b.*")
    open_ = cut(marked.join(split, ["band", "hash"]).drop("n"), "open")
    if open_.limit(1).count():
        sets = full_sets(open_.select(F.col("rep").alias("doc_id")).distinct())
        tiled = open_.withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.join(sets, "rep").select("band", "hash", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") == F.greatest("t", "o")).alias("second"), "rep", "label", "keys")
        found = tiled.groupBy("band", "hash", "a", "b").applyInArrow(_block_links(percent), f"u {kind}, v {kind}").distinct()
        joined = components(joined.unionByName(cut(found, "links")))

    class_of = first.select("k1", "k2", "n", "rep").join(joined.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left").select("k1", "k2", "n", F.coalesce("label", "rep").alias("label"))
    out = known.select("doc_id", "k1", "k2", "n").join(class_of, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), (F.col("doc_id") == F.col("label")).alias("kept"))
    alone = sketch.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
