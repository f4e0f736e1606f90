"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word leads one window of ``longest`` words whose
further words come from lead columns (the words shifted by one, two, ...), padded where
the piece ends.  A word sequence of k words is a window's first k words exactly once per
occurrence, so ROLLUP over (group, lead 0, lead 1, ...) sums the counts of all shorter
phrases, single words and the group's total out of the one table of counted windows.

Most windows of a corpus occur once, and only phrases of a least frequency matter.  A first
pass therefore adds up hashes of window prefixes; as colliding hashes can only add, a prefix
whose hash counts less than ``least`` is rare for certain, and the second pass pads windows
from there on.  That moves no count: a padded window still sums into its shorter prefixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.hashing import Powers, Words, mix, text_slices
from skyloom.llm.scratch import Scratch

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
SALTS = 64
TABLE_BITS = 27  # the table of frequent prefixes has at most 2^27 bits (16 MB); a fuller one lets more windows through, all of them counted rightly

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_IS_WORD = ~_BREAK
_IS_WORD[list(BLANKS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Leads:
    """Words of a slice, the hash of every window prefix and whether the prefix lies within a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], powers: Powers, longest: int):
        self.words = Words(data, offsets, _IS_WORD)
        w = self.words
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        piece = breaks[w.starts] + w.doc  # rises at each break and at each text
        self.names = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        self.lang = np.array([self.names[x] for x in langs], dtype=np.int64)[w.doc]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], dtype=np.uint64)
        word = w.hashes(powers)
        at, n = seeds[self.lang], len(word)
        self.hash, self.within = [], []
        for k in range(longest):
            shifted, same = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
            shifted[:max(n - k, 0)] = word[k:]
            same[:max(n - k, 0)] = piece[k:] == piece[:max(n - k, 0)]
            at = mix(at * np.uint64(0xFF51AFD7ED558CCD) + shifted + np.uint64(k + 1))
            self.hash.append(at)
            self.within.append(same)


def _prefixes(longest: int):
    """(hash, n) of the prefixes of two words and more, added up per slice."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                leads = _Leads(data, offsets, rows.column(1).to_pylist(), powers, longest)
                found = np.concatenate([h[ok] for h, ok in zip(leads.hash[1:], leads.within[1:])] or [np.zeros(0, np.uint64)])
                if len(found):
                    keys, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["hash", "n"])

    return run


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    return [(h & np.uint64(size - 1)).astype(np.int64) for h in (hashes, hashes >> np.uint64(32))]


def _windows(table, longest: int):
    """Windows (lang, w0, w1, ..., f), padded with '' beyond their piece and from the first rare prefix on.

    A slice's equal windows are added up by their words' numbers in the slice's dictionary.
    """

    def run(batches):
        powers, bits = Powers(), table.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                leads = _Leads(data, offsets, rows.column(1).to_pylist(), powers, longest)
                w, n = leads.words, len(leads.words.starts)
                if not n:
                    continue
                inside = _IS_WORD[data]
                ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]]))
                coded = text.dictionary_encode()
                known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1  # 0 pads
                base = len(known) + 1
                group, keep, columns = leads.lang, np.ones(n, dtype=bool), []
                for k in range(longest):
                    if k:
                        keep = keep & leads.within[k]
                        for at in _bits(leads.hash[k], len(bits) * 64):
                            keep &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    lead = np.zeros(n, dtype=np.int64)
                    lead[:n - k] = code[k:]
                    lead[~keep] = 0
                    columns.append(lead)
                    # Renumbered from 0 after each column, so the product stays within 64 bits.
                    _, group = np.unique(group * base + lead, return_inverse=True)
                _, first, count = np.unique(group, return_index=True, return_counts=True)
                words = pa.concat_arrays([pa.array([""], pa.large_string()), known])
                names = pa.array(list(leads.names), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(leads.lang[first])), *[words.take(pa.array(c[first])).cast(pa.string()) for c in columns], pa.array(count)],
                    ["lang", *[f"w{k}" for k in range(longest)], "f"])

    return run


def lead_windows(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """Added-up windows: ``lang``, the lead columns ``w0``, ``w1``, ... and ``f``; '' pads."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    frequent = Scratch(spark).put(rows.mapInArrow(_prefixes(longest), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash"))
    size = 1 << min(TABLE_BITS, max(10, (16 * frequent.count()).bit_length()))
    at = F.explode(F.array(F.col("hash").bitwiseAND(size - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(size - 1)))
    bits = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, dtype=np.uint64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    leads = ", ".join(f"w{k} string" for k in range(longest))
    return rows.mapInArrow(_windows(spark.sparkContext.broadcast(table), longest), f"lang string, {leads}, f long")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to ``longest`` words that occur ``least`` times or more.

    Each language's number of words comes as the row without words (``phrase`` '').  A NULL
    lang is ``und``; NULL and empty texts hold no word; repeated rows count each time.
    """
    leads = [f"w{k}" for k in range(longest)]
    windows = lead_windows(docs, longest, least).groupBy("lang", *leads).agg(F.sum("f").alias("f"))
    summed = windows.rollup("lang", *leads).agg(F.sum("f").alias("f"), F.grouping_id().alias("_left"))
    # grouping_id has a bit per summed column: k words are kept where the last longest - k bits are set.
    words = F.lit(None).cast("array<string>")
    for k in range(longest + 1):
        words = F.when(F.col("_left") == (1 << (longest - k)) - 1, F.array(*leads[:k]).cast("array<string>")).otherwise(words)
    found = summed.select("lang", words.alias("words"), "f").filter(F.col("words").isNotNull() & ~F.array_contains("words", ""))
    kept = found.filter((F.size("words") == 0) | (F.col("f") >= least))
    return kept.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with a = f(phrase) >= ``least`` is a candidate; cut after
    its first k words it scores floor(1000000 a^2 / (l r)), the lowest cut counts (ties: the
    smallest k).  Candidates inside a longer candidate with at least ``inside`` per cent of
    their occurrences go.  Order: score and a descending, then the phrase's bytes.
    Columns of ``docs`` other than text and lang are not read; an empty table gives no row.
    """
    return ranked(Scratch(docs.sparkSession).put(phrase_counts(docs, longest, least)), top, inside)


def ranked(known: DataFrame, top: int = 2000, inside: int = 50) -> DataFrame:
    """``collocations`` from the table that ``phrase_counts`` gives."""
    part = known.filter("phrase <> ''").select("lang", "phrase", "f")
    candidates = known.filter(F.size("words") >= 2).select("lang", "words", "phrase", F.col("f").alias("a"))
    # Both parts of a cut occur at least as often as the phrase, so they are among the counted ones.
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("right"))
    cuts = cuts.join(part.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(
        part.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    # Decimals keep the products exact; the score is at most 1000000, as a exceeds neither l nor r.
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    scored = cuts.withColumns({"_top": (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "_below": l * r})
    scored = scored.withColumn("score", F.expr("_top div _below").cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut")).select("lang", "phrase", "a", "_cut.score", "_cut.l", "_cut.r")
    # Contiguous shorter parts of two words or more.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    within = candidates.filter(size >= 3).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("_longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < inside * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # A language's best are found per salt first, so its candidates never meet in one task.
    first = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = known.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
