"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document, as many words long as a benchmark item, is compared to the items of that
length by weighted Jaccard similarity of five-word shingles (a shingle weighs its number
of letters times its repeats).  Fingerprints are 64-bit SimHashes of the weighted shingles.
Items and windows meet in a multi-index: two fingerprints within ``RADIUS`` bits differ by at most
``RADIUS // BLOCKS`` bits in at least one of ``BLOCKS`` blocks, and the items list every block value that
close, so the join finds every fingerprint within the radius.  The exact similarity decides.

A window that reaches the threshold has that share of its weight in shingles of items of its
length.  A bit table of those (length, shingle) pairs, of bounded size, therefore leaves out windows
that cannot reach it before they get a fingerprint; its false positives only cost time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import Powers, Words, mix, text_slices
from skyloom.llm.scratch import Scratch

WIDTH = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
TABLE_BITS = 23  # the largest table: 1 MB
NEAR = sorted(sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(BLOCK_BITS), k))


class _Shingled:
    """Shingles of one slice with their weights; a text of fewer words than a shingle is one shingle."""

    def __init__(self, data, offsets, powers: Powers):
        self.words = words = Words(data, offsets)
        self.hash, self.doc, first = words.shingles(powers, WIDTH)
        letters = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        end = np.minimum(first + WIDTH, words.first[1:][self.doc])
        self.weight = letters[end] - letters[first]
        self.begin = np.searchsorted(self.doc, np.arange(words.docs + 1))


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of shingle ranges [start, end)."""
    out = np.zeros(len(starts), dtype=np.uint64)
    spread = mix(hashes)
    for bit in range(64):
        signed = np.where((spread >> np.uint64(bit)) & np.uint64(1) == 1, weights, -weights)
        sums = np.concatenate([[0], np.cumsum(signed)])
        out |= ((sums[ends] - sums[starts]) > 0).astype(np.uint64) << np.uint64(bit)
    return out


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind) -> pa.ListArray:
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values[at].astype(kind)))


def _items(batches):
    powers = Powers()
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            s = _Shingled(data, offsets, powers)
            some = np.flatnonzero(s.words.counts > 0)
            lo, hi = s.begin[:-1][some], s.begin[1:][some]
            prints = simhash(s.hash, s.weight, lo, hi)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(some)), pa.array(s.words.counts[some].astype(np.int32)), pa.array(prints.view(np.int64)),
                 _lists(s.hash.view(np.int64), lo, hi, np.int64), _lists(s.weight, lo, hi, np.int32)], ["item_id", "words", "print", "shingles", "weights"])


def _at(hashes: np.ndarray, words: int, size: int) -> np.ndarray:
    salt = np.uint64(words * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(hashes ^ salt) & np.uint64(size - 1)).astype(np.int64)


def _bit_rows(size: int):
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            shingles = batch.column(1)
            for i, w in enumerate(words):
                h = shingles[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                for at in (np.unique(_at(h, w, size)), np.unique(_at(h, 0, size))):  # by length, and of any length
                    yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at.astype(np.uint64) & np.uint64(63))).view(np.int64))], ["word", "bits"])

    return run


def _windows(table, lengths, threshold: float):
    def run(batches):
        powers, bits, sizes = Powers(), table.value, lengths.value
        size = len(bits) * 64

        def held(hashes, words):
            at = _at(hashes, words, size)
            return (bits[at >> 6] >> (at.astype(np.uint64) & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                s = _Shingled(data, offsets, powers)
                near = held(s.hash, 0)
                if not near.any():
                    continue
                total = np.concatenate([[0], np.cumsum(s.weight)])
                out = [[], [], [], []]
                hits = np.flatnonzero(near)
                for words in sizes:
                    width = max(1, words - WIDTH + 1)
                    good = hits[held(s.hash[hits], words)]
                    if not len(good):
                        continue
                    weight = np.zeros(len(s.hash), dtype=np.int64)
                    weight[good] = s.weight[good]
                    sums = np.concatenate([[0], np.cumsum(weight)])
                    # Starts whose window holds a good shingle; a text shorter than the window is one window.
                    of = s.doc[good]
                    lo = np.maximum(good - width + 1, s.begin[:-1][of])
                    hi = np.minimum(good, np.maximum(s.begin[1:][of] - width, s.begin[:-1][of]))
                    mark = np.zeros(len(s.hash) + 1, dtype=np.int64)
                    np.add.at(mark, lo, 1)
                    np.add.at(mark, np.maximum(hi, lo) + 1, -1)
                    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    ends = np.minimum(starts + width, s.begin[1:][s.doc[starts]])
                    keep = (sums[ends] - sums[starts]) >= threshold * (total[ends] - total[starts]) - 1e-9
                    out[0].append(starts[keep])
                    out[1].append(ends[keep])
                    out[2].append(np.full(int(keep.sum()), words))
                starts, ends, words = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in out[:3])
                if not len(starts):
                    continue
                prints = simhash(s.hash, s.weight, starts, ends)
                doc = s.doc[starts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), pa.array((starts - s.begin[:-1][doc]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(prints.view(np.int64)),
                     _lists(s.hash.view(np.int64), starts, ends, np.int64), _lists(s.weight, starts, ends, np.int32)], ["doc_id", "start", "words", "print", "shingles", "weights"])

    return run


def _similarity(batches):
    """Weighted Jaccard similarity of two shingle lists per row."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out = []
        for a, x, b, y in zip(*(cols[n] for n in ("shingles", "weights", "item_shingles", "item_weights"))):
            a, x, b, y = (v.values.to_numpy(zero_copy_only=False) for v in (a, x, b, y))
            keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            p, q = np.bincount(at[:len(a)], weights=x, minlength=len(keys)), np.bincount(at[len(a):], weights=y, minlength=len(keys))
            most = np.maximum(p, q).sum()
            out.append(float(np.minimum(p, q).sum() / most) if most else 1.0)
        yield pa.RecordBatch.from_arrays([cols["doc_id"], cols["start"], cols["item_id"], pa.array(out, pa.float64())], ["doc_id", "start", "item_id", "similarity"])


def _blocks(prints: str):
    return [F.shiftrightunsigned(prints, BLOCK_BITS * b).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int") for b in range(BLOCKS)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_windows, start, similarity) per document and item that a window of it matches.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; more columns are ignored.  A match
    is a window of the item's number of words (or a whole shorter text) with a similarity of at
    least ``threshold``; n_windows counts them, and start (in words) and similarity are those of the best,
    the first of equals.  NULL, empty and blank texts match nothing; items with equal texts are
    reported each; rows with one doc_id count as one document; empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    clean = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    # Items with one text are one from here on.
    named = scratch.put(clean(benchmark, "item_id").mapInArrow(_items, "item_id long, words int, print long, shingles array<long>, weights array<int>"))
    items = named.groupBy("words", "print", "shingles", "weights").agg(F.min("item_id").alias("item"))
    items = scratch.put(items)
    lengths = sorted(r[0] for r in items.select("words").distinct().collect())  # bounded: lengths of items
    size = 1 << min(TABLE_BITS, max(12, int(16 * (items.agg(F.sum(F.size("shingles"))).first()[0] or 0)).bit_length()))
    bits = items.select("words", "shingles").mapInArrow(_bit_rows(size), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, dtype=np.uint64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    make = _windows(spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(lengths), threshold)
    windows = clean(docs, "doc_id").mapInArrow(make, "doc_id long, start int, words int, print long, shingles array<long>, weights array<int>")
    # Equal windows of copied documents are compared once.
    windows = scratch.put(windows)
    unique = windows.select("words", "print").distinct()
    probe = unique.select("words", "print", F.posexplode(F.array(*_blocks("print"))).alias("block", "value"))
    listed = items.select("words", F.col("print").alias("item_print"), F.posexplode(F.array(*_blocks("print"))).alias("block", "_own")).distinct()
    listed = listed.select("words", "item_print", "block", F.explode(F.transform(F.array(*[F.lit(x) for x in NEAR]), lambda x: F.col("_own").bitwiseXOR(x))).alias("value"))
    pairs = probe.join(listed, ["words", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = pairs.select("words", "print", "item_print").distinct()
    full = items.select("words", F.col("print").alias("item_print"), F.col("item").alias("item_id"), F.col("shingles").alias("item_shingles"), F.col("weights").alias("item_weights"))
    checked = windows.join(pairs, ["words", "print"]).join(full, ["words", "item_print"]).select(
        "doc_id", "start", "shingles", "weights", "item_id", "item_shingles", "item_weights").mapInArrow(_similarity, "doc_id long, start int, item_id long, similarity double")
    best = checked.filter(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(
        F.countDistinct("start").alias("n_windows"), F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("_b"))
    names = named.join(items, ["words", "print", "shingles", "weights"]).select(F.col("item_id").alias("_each"), F.col("item").alias("_one"))
    out = best.join(names, F.col("item_id").eqNullSafe(F.col("_one")))
    return out.select("doc_id", F.col("_each").alias("item_id"), "n_windows", (-F.col("_b.back")).alias("start"), F.col("_b.similarity").alias("similarity"))
