"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Every shingle is hashed once; the hash's top bits choose one of ``bins`` bins and the least
hash of each bin is kept.  A bin that no shingle fell into borrows from a filled one by optimal
densification: bin i tries the bins (a_i t + b_i) mod ``bins``, t = 0, 1, ..., a permutation of
its own, and takes the first filled one.  Of each bin only the four low-order bits are stored,
packed as one hexadecimal digit, so two unlike bins agree by chance in C = 1/16 of all cases;
an agreement of E estimates the Jaccard likeness (E - C) / (1 - C).
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 512
WIDTH = 5  # words to a shingle
TRIES = 16  # steps of a bin's permutation that are tried one by one
CHANCE = 1 / 16
BLANKS = r"[\x20\x09-\x0D]+"
CHUNK_ROWS, MOST_CHUNKS, PER_CHUNK = 4096, 1 << 16, 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def steps(bins: int) -> list[int]:
    """Per bin a_i (odd), its inverse mod ``bins`` and b_i, packed 16 bits each from the lowest on."""
    draw, out = random.Random(bins), []
    for _ in range(bins):
        a = draw.randrange(bins) | 1
        out.append(a | pow(a, -1, bins) << 16 | draw.randrange(bins) << 32)
    return out


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the ``width``-word shingles of lower-cased (A-Z) words; fewer words form one shingle, none form none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    bare = F.btrim(lower, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, F.array(F.xxhash64(w))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))))


def fingerprint(text: Column, bins: int = BINS, width: int = WIDTH) -> Column:
    """``bins`` hexadecimal digits; '' for a text without words (NULL too).  ``bins`` is a power of two up to 2^15."""
    bits = bins.bit_length() - 1
    shift = 64 - bits
    low = (1 << shift) - 1
    # A sentinel behind every bin's hashes marks the bin: after the sort, the first entry of each bin is
    # its least hash, or the sentinel of an empty bin.
    sentinels = F.array(*[F.lit((i << shift) | low) for i in range(-bins // 2, bins // 2)])
    bin_of = lambda h: F.shiftright(h, shift)
    firsts = lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))
    value = lambda h: F.when(h.bitwiseAND(F.lit(low)) != low, h.bitwiseAND(F.lit(15)))
    sparse = lambda hashes: F.transform(let(F.sort_array(F.concat(hashes, sentinels)), firsts), value)  # NULL: empty

    def dense(v: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda j: F.get(v, j.cast("int")).isNotNull())

        def fill(f: Column) -> Column:
            def one(x: Column, step: Column) -> Column:
                start = F.shiftright(step, 32)
                tried = [F.get(v, (step * t + start if t else start).bitwiseAND(F.lit(bins - 1)).cast("int")) for t in range(TRIES)]
                # Beyond these tries: the filled bin that the permutation reaches first, by its inverse.
                turn = lambda j: (F.shiftright(step, 16) * (j - start)).bitwiseAND(F.lit(bins - 1))
                rest = F.array_min(F.transform(f, lambda j: turn(j) * bins + j)).bitwiseAND(F.lit(bins - 1))
                return F.coalesce(x, *tried, F.get(v, rest.cast("int")))

            return F.zip_with(v, F.array(*[F.lit(s).cast("long") for s in steps(bins)]), one)

        return let(filled, fill)

    digits = lambda d: F.array_join(F.transform(d, lambda x: F.substring(F.lit("0123456789abcdef"), x.cast("int") + 1, F.lit(1))), "")
    return let(shingle_hashes(text, width), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(digits(let(sparse(h), dense))))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness (0 to 1) of two fingerprints: 1 if they are equal, 0 if one alone is ''."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    estimate = (same / F.lit(float(bins)) - CHANCE) / (1 - CHANCE)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(estimate, F.lit(0.0)))


def with_fingerprints(docs: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with one more column, for every row; NULL and empty texts give ''."""
    return docs.withColumn(out, fingerprint(F.col(f"`{column}`")))


def _chunk_starts(keys: DataFrame, chunk_rows: int) -> DataFrame:
    """One row: two arrays with the first key (descending id, text hash) of every chunk.

    A hash sample of the keys, sixteen to a chunk, is thinned by rank; there are at most 65,536
    chunks, so the table is bounded (1 MB) whatever the number of documents.
    """
    n = keys.agg(F.count(F.lit(1))).first()[0]
    chunks = max(1, min(MOST_CHUNKS, n // chunk_rows))
    rate = max(1, n // (chunks * PER_CHUNK))
    sample = keys.filter(F.pmod(F.xxhash64("_down", "_hash"), F.lit(rate)) == 0).distinct()
    ranked = sample.withColumn("_r", F.row_number().over(Window.orderBy("_down", "_hash"))).filter(F.col("_r") % PER_CHUNK == 0)
    starts = keys.agg(F.min(F.struct("_down", "_hash")).alias("s")).filter("s IS NOT NULL").unionByName(ranked.select(F.struct("_down", "_hash").alias("s")))
    return starts.agg(F.array_sort(F.collect_set("s")).alias("_s")).select(F.col("_s._down").alias("_downs"), F.col("_s._hash").alias("_hashes"))


def in_order(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, Window]:
    """Rows of ``docs`` (doc_id, text) dealt into chunks by descending doc_id, and the window of a chunk.

    ``_chunk`` numbers the chunks.  The first row of each chunk stands also at the end of the one before
    it (that of the first at the end of the last), marked ``_guest``: a ``lead`` over the window finds every
    row's successor, the first row following the last.  NULL ids come last; rows of one id are ordered
    by a hash of their texts, so they too are divided among chunks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))  # rises as the id falls
    rows = rows.withColumns({"_down": down, "_hash": F.xxhash64("text")})
    placed = rows.crossJoin(F.broadcast(_chunk_starts(rows.select("_down", "_hash"), chunk_rows)))  # one row
    at_or_after = lambda k: (F.get("_downs", k) < F.col("_down")) | ((F.get("_downs", k) == F.col("_down")) & (F.get("_hashes", k) <= F.col("_hash")))
    # Binary search for the last chunk whose first key is not greater.
    halves = F.array(*[F.lit(MOST_CHUNKS >> k) for k in range(MOST_CHUNKS.bit_length())])
    found = F.aggregate(halves, F.lit(0), lambda k, step: F.when(F.coalesce(at_or_after(k + step), F.lit(False)), k + step).otherwise(k))
    placed = placed.withColumn("_c", found)
    first = (F.get("_downs", F.col("_c")) == F.col("_down")) & (F.get("_hashes", F.col("_c")) == F.col("_hash"))
    before = F.when(F.col("_c") == 0, F.size("_downs") - 1).otherwise(F.col("_c") - 1)
    spot = lambda chunk, guest: F.struct(chunk.alias("_chunk"), guest.alias("_guest"))
    wrap = F.when(F.col("_c") == 0, 2).otherwise(1)
    spots = F.when(first, F.array(spot(F.col("_c"), F.lit(0)), spot(before, wrap))).otherwise(F.array(spot(F.col("_c"), F.lit(0))))
    dealt = placed.select("doc_id", "text", "_down", "_hash", F.inline(spots))
    return dealt, Window.partitionBy("_chunk").orderBy((F.col("_guest") == 2), "_down", "_hash", "_guest")


def compare_with_edits(docs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each document against an edit of itself and against the next one, by fingerprints.

    The next document is the one with the next smaller doc_id (after the last: the first; a single one
    is its own next).  The edit's last half (code points, rounded down) is replaced by the next
    text's first as many, or all.  Result: doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next.  NULL texts count as empty; every row gives one row, repeated rows too;
    other columns are not read.
    """
    dealt, window = in_order(docs, chunk_rows)
    n, half = F.char_length("text").cast("long"), F.floor(F.char_length("text") / 2).cast("int")
    both = dealt.withColumn("_next", F.lead("text").over(window)).withColumn("fingerprint", fingerprint(F.col("text")))
    # A second lead over the same window needs neither an exchange nor a sort.
    both = both.withColumn("_next_fp", F.lead("fingerprint").over(window)).filter("_guest = 0")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = both.withColumns({"n_chars": n, "edited": edited})
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("_next_fp")).alias("near_next"))
