"""Exact Jaccard join of documents on word shingles by multiple-global-order prefix filtering.

Two sets of n and m shingles with Jaccard similarity of at least t share at least
``ceil(t (n + m) / (1 + t))`` shingles.  Hence, whatever global order the shingles are put
in, they share one among the first ``n - ceil(t n) + 1`` of each: candidates must do so in
*every* order used.  All orders put shingles that repeat often last, so passages that
many documents quote seldom reach a prefix, and break ties by different hashes.

1. One pass takes each document's set key (identical sets are one node from here on) and
   counts, in a fixed number of buckets, the shingles that repeat.
2. One pass emits the prefixes of the first order; one exchange by shingle keeps those that
   different sets share.  The place of a shared shingle bounds the overlap, which discards
   most pairs at once.
3. Each set meets two leaders of its shared shingles.  Pairs whose prefixes have enough in common
   and that share a prefix shingle in every other order are verified exactly and contracted into
   components.  Only shingles that still join different components go on: while such pairs
   would be many, further rounds use other leaders; in the end all of them are verified.
   Links inside a component decide nothing more, so a group of near copies never costs the
   square of its size, and no link that joins two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.hashing import _BASE, Powers, Words, mix, text_slices
from skyloom.llm.scratch import Scratch
from skyloom.operators.components import connected_components

BUCKET_BITS = 21  # counters of repeated shingles, whatever the input's size: 2 MB
FILTER_BITS = 24  # the largest filter of candidate keys: 2 MB
PAIRS_PER_ROW = 100  # up to this many crossing pairs per remaining row are all compared by their places
BLOCK_ROWS = 1 << 16  # rows of a shingle that meet all its others in one round; pairs stream, so a block bounds what a join holds per key
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


class _Sets:
    """Distinct shingles of one slice's documents, sorted by document and by ``order``."""

    def __init__(self, data, offsets, powers: Powers, width: int, classes: np.ndarray | None):
        words = Words(data, offsets)
        tokens, doc, _ = words.shingles(powers, width)
        rank = tokens >> np.uint64(6)
        if classes is not None:
            rank = rank | (classes[tokens >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(58))
        at = np.lexsort((rank, doc))
        tokens, doc = tokens[at], doc[at]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
        self.tokens, self.doc = tokens[new], doc[new]
        self.n = np.bincount(self.doc, minlength=words.docs).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        sums = np.zeros(len(self.tokens) + 1, dtype=np.uint64)
        np.cumsum(mix(self.tokens ^ _SEEDS[0]), out=sums[1:])
        self.key = mix((sums[self.begin[1:]] - sums[self.begin[:-1]]) ^ self.n.astype(np.uint64)).view(np.int64)

    def place(self) -> np.ndarray:
        return np.arange(len(self.tokens)) - self.begin[:-1][self.doc]


def _prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (num * n + den - 1) // den + 1


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        weight = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settle():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            np.add.at(weight, values[many] >> np.uint64(64 - BUCKET_BITS), counts[many])

        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                sets = _Sets(data, offsets, powers, width, None)
                fresh = np.zeros(len(sets.n), dtype=bool)
                for i, k in enumerate(sets.key.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                held.append(sets.tokens[fresh[sets.doc]])
                size += len(held[-1])
                if size > 1_000_000:
                    settle()
                    held, size = [], 0
                none = pa.nulls(len(sets.n), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets.n), pa.array(sets.key), none.cast(pa.int32()), none],
                                                 ["id", "n", "key", "bucket", "weight"])
        if held:
            settle()
        full = np.flatnonzero(weight)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(full.astype(np.int32)), pa.array(weight[full])],
                                         ["id", "n", "key", "bucket", "weight"])

    return run


def _prefixes(width: int, num: int, den: int, classes):
    def run(batches):
        powers, seen = Powers(), set()
        for batch in batches:
            for _, data, offsets in text_slices(batch):
                sets = _Sets(data, offsets, powers, width, classes.value)
                fresh = np.zeros(len(sets.n), dtype=bool)
                for i, k in enumerate(sets.key.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh[i] = True
                place = sets.place()
                keep = np.flatnonzero((place < _prefix_length(sets.n, num, den)[sets.doc]) & fresh[sets.doc])
                doc = sets.doc[keep]
                # The number of shingles from this one on, and of all: what the overlap's bound needs.
                packed = ((sets.n[doc] - place[keep]) << np.int64(32)) | sets.n[doc]
                yield pa.RecordBatch.from_arrays([pa.array(sets.tokens[keep].view(np.int64)), pa.array(sets.key[doc]), pa.array(packed)], ["token", "key", "size"])

    return run


def _full_sets(width: int, num: int, den: int, classes, bits):
    def run(batches):
        powers, seen, table = Powers(), set(), bits.value
        mask = np.uint64(len(table) * 64 - 1)

        def held(at):
            return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        def arrays(values, doc, keep, kind=np.int64):
            counts = np.bincount(doc, minlength=len(keep))[keep]
            chosen = values[np.isin(doc, np.flatnonzero(keep))]
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.view(np.int64).astype(kind)))

        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                sets = _Sets(data, offsets, powers, width, None)
                ids = rows.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                bare = _tag(sets.key, ids)
                keep = held(bare & mask) & held((bare >> np.uint64(FILTER_BITS)) & mask) & (sets.n > 0)
                for i in np.flatnonzero(keep).tolist():
                    k = int(sets.key[i])
                    if k in seen:
                        keep[i] = False
                    seen.add(k)
                if not keep.any():
                    continue
                of = keep[sets.doc]
                tokens, doc = sets.tokens[of], sets.doc[of]
                parts = []
                for seed in _SEEDS:
                    rank = (mix(tokens ^ seed) >> np.uint64(6)) | (classes.value[tokens >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(58))
                    at = np.lexsort((rank, doc))
                    begin = np.searchsorted(doc, doc)
                    first = np.arange(len(at)) - begin < _prefix_length(sets.n, num, den)[doc]
                    # Half of each hash does to rule a shared shingle out.
                    parts.append(arrays(tokens[at][first], doc[first], keep, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(sets.key[keep]), pa.array(ids[keep]), pa.array(sets.n[keep]), arrays(tokens, doc, keep), *parts],
                                                 ["key", "id", "n", "tokens", "second", "third"])

    return run


def _tag(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ (ids.astype(np.int64).view(np.uint64) * _BASE)


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Both sizes and the places of a shared shingle still allow the threshold."""
    na, nb = F.col(f"{a}size").bitwiseAND(0xFFFFFFFF), F.col(f"{b}size").bitwiseAND(0xFFFFFFFF)
    rest = F.least(F.shiftright(f"{a}size", 32), F.shiftright(f"{b}size", 32))
    return ((num + den) * rest >= num * (na + nb)) & (den * F.least(na, nb) >= num * F.greatest(na, nb))


class _Join:
    def __init__(self, docs: DataFrame, num: int, den: int, width: int):
        self.docs, self.num, self.den, self.width = docs, num, den, width
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)

    def describe(self) -> DataFrame:
        rows = self.scratch.put(self.docs.mapInArrow(_describe(self.width), "id long, n long, key long, bucket int, weight long"))
        counted = rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.length(F.bin(F.sum("weight"))).cast("tinyint").alias("class")).toArrow()
        classes = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
        classes[counted.column("bucket").to_numpy()] = counted.column("class").to_numpy()
        self.classes = self.spark.sparkContext.broadcast(classes)
        described = rows.filter("bucket IS NULL").select("id", "n", "key")
        # One document stands for each set: where sets are needed whole, only its text gives them.
        self.first = self.scratch.put(described.groupBy("key").agg(F.min("id").alias("first")))
        return described

    def shared(self) -> DataFrame:
        """Prefix rows of shingles that at least two different sets have there, with the first and last such set."""
        rows = self.docs.mapInArrow(_prefixes(self.width, self.num, self.den, self.classes), "token long, key long, size long")
        # Tasks drop repeated sets they see; a set seen by several tasks counts once here by its key.
        w = Window.partitionBy("token")
        rows = rows.withColumns({"lo": F.min("key").over(w), "hi": F.max("key").over(w), "n": F.count(F.lit(1)).over(w)})
        rows = self.scratch.put(rows.filter("lo <> hi").select("token", "key", "size", "n"))
        self.prefixes = self.scratch.put(rows.groupBy("key").agg(F.max("size").alias("size"), F.collect_set("token").alias("first")))
        return rows

    def star(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each set with two leaders of its shingles, from other components.

        Copies of a text share with each other what each shares with the text, so the set whose
        shingles are shared most leads: near copies of one text mostly meet that text.
        """
        hub = rows.groupBy("key").agg(F.sum("n").alias("hub"))
        rows = rows.join(hub, "key")
        lead = rows.groupBy("token").agg(F.max_by(F.struct("key", "size", "part", "hub"), F.struct("hub", "key")).alias("l"))
        lead = lead.select("token", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("key", "size", "part", "hub")])
        met = rows.join(lead, "token").filter((F.col("part") != F.col("l_part")) & _fits("", "l_", self.num, self.den))
        two = F.array(F.max_by("l_key", F.struct("l_hub", "l_key")), F.max_by("l_key", F.xxhash64("l_key", F.lit(turn))))
        return met.groupBy(F.col("key").alias("u")).agg(two.alias("v")).select("u", F.explode("v").alias("v"))

    def block(self, rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of every row with a block of some ``BLOCK_ROWS`` rows of its shingle, and the rows without those blocks.

        A block's rows have then met all others of their shingle and are done with, so rounds of blocks come
        to an end whatever links; a shingle of fewer rows is settled at once.
        """
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1))
        rows = rows.withColumn("lead", F.pmod(F.xxhash64("key", "token", F.lit(turn)), blocks) == 0)
        a = rows.filter("lead").select("token", *[F.col(c).alias(f"a_{c}") for c in ("key", "size", "part")])
        b = rows.select("token", "lead", *[F.col(c).alias(f"b_{c}") for c in ("key", "size", "part")])
        met = a.join(b, "token").filter((~F.col("lead") | (F.col("a_key") < F.col("b_key"))) & (F.col("a_part") != F.col("b_part")) & _fits("a_", "b_", self.num, self.den))
        return met.select(F.col("a_key").alias("u"), F.col("b_key").alias("v")), self.scratch.put(rows.filter("NOT lead").select("token", "key", "size"))

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Those of the pairs (u, v) that share prefixes in the other orders and reach the threshold, and how many were tested."""
        pairs = self.scratch.put(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        # Both prefixes of the first order hold so many common shingles, if the sets are similar.
        side = lambda name: self.prefixes.select(F.col("key").alias(name), F.col("size").bitwiseAND(0xFFFFFFFF).alias(f"{name}_n"), F.col("first").alias(f"{name}_first"))
        met = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")
        need = F.least(self.surplus("u_n", "v_n"), self.surplus("v_n", "u_n"))
        pairs = self.scratch.put(met.filter(F.size(F.array_intersect("u_first", "v_first")) >= need).select("u", "v"))
        of = lambda name: self.first.select(F.col("key").alias(name), F.coalesce("first", F.lit(-1)).alias(f"{name}_id"))
        pairs = self.scratch.put(pairs.join(of("u"), "u").join(of("v"), "v"))
        keys = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.col("u_id").alias("id")), F.struct(F.col("v").alias("key"), F.col("v_id").alias("id")))).alias("k")).select("k.*").distinct()
        tested = pairs.count()
        size = 1 << min(FILTER_BITS, max(10, (32 * tested).bit_length()))
        tag = F.col("key").bitwiseXOR(F.col("id") * F.lit(int(_BASE.view(np.int64))))
        at = F.explode(F.array(tag.bitwiseAND(size - 1), F.shiftrightunsigned(tag, FILTER_BITS).bitwiseAND(size - 1)))
        bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
        table = np.zeros(size // 64, dtype=np.uint64)
        table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
        sets = self.scratch.put(self.docs.mapInArrow(
            _full_sets(self.width, self.num, self.den, self.classes, self.spark.sparkContext.broadcast(table)),
            "key long, id long, n long, tokens array<long>, second array<int>, third array<int>"))
        side = lambda name: sets.select(F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in sets.columns if c != "key"])
        # The same joins at every size: the sets are large and the pairs grow with the input.
        # The id leaves out copies that only the filter's collisions let through.
        both = pairs.join(side("u").hint("merge"), ["u", "u_id"]).join(side("v").hint("merge"), ["v", "v_id"])
        both = both.filter(F.arrays_overlap("u_second", "v_second") & F.arrays_overlap("u_third", "v_third"))
        common = F.size(F.array_intersect("u_tokens", "v_tokens"))
        out = self.scratch.put(both.filter((self.den + self.num) * common >= self.num * (F.col("u_n") + F.col("v_n"))).select("u", "v"))
        self.scratch.forget(1)
        return out, tested

    def surplus(self, n: str, m: str) -> Column:
        """Common shingles that a prefix of a set of ``n`` holds at least: its length less what the other of ``m`` may lack."""
        num, den = self.num, self.den
        length = F.col(n) - F.ceil(F.lit(num) * F.col(n) / F.lit(den)) + 1
        return length - F.col(n) + F.ceil(F.lit(num) * (F.col(n) + F.col(m)) / F.lit(num + den))

    def mixed(self, shared: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of shingles that still lie in more than one component."""
        rows = shared.select("token", "key", "size").join(parts, F.col("key") == F.col("node"), "left")
        rows = rows.select("token", "key", "size", F.coalesce("root", "key").alias("part"))
        w = Window.partitionBy("token")
        rows = rows.withColumns({"_a": F.min("part").over(w), "_b": F.max("part").over(w), "n": F.count(F.lit(1)).over(w)}).filter("_a <> _b").drop("_a", "_b")
        return self.scratch.put(rows)

    def run(self) -> DataFrame:
        described = self.describe()
        shared = self.shared()
        num, den = self.num, self.den
        rows = shared.withColumn("part", F.col("key"))
        links, parts, turn = None, None, 0
        while True:
            pairs, last = self.star(rows, turn), False
            if turn:
                load = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(
                    F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum("n")).first()
                crossing, count = load[0] or 0, load[1] or 0
                if not count:
                    break
                # Leaders go on while they still link what they meet and crossing pairs are many to a row.
                last = crossing <= PAIRS_PER_ROW * count
                if not last and 10 * linked <= tested:
                    pairs, shared = self.block(rows, turn)
                elif last:
                    a, b = [rows.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("key", "size", "part")]) for x in ("a", "b")]
                    pairs = a.join(b, "token").filter((F.col("a_key") < F.col("b_key")) & (F.col("a_part") != F.col("b_part")) & _fits("a_", "b_", num, den))
                    pairs = pairs.select(F.col("a_key").alias("u"), F.col("b_key").alias("v"))
            more, tested = self.verified(pairs)
            linked = more.count()
            links = more if links is None else links.unionByName(more)
            if linked or parts is None:
                parts = self.scratch.put(connected_components(links))
            turn += 1
            if last:
                break
            rows = self.mixed(shared, parts)
        sets = self.first.join(parts, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
        least = sets.groupBy("root").agg(F.min("first").alias("component_id"))
        of = sets.join(least, "root").select("key", "component_id")
        out = described.filter("n > 0").join(of, "key", "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
        out = out.unionByName(described.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
        out = self.scratch.put(out)
        self.scratch.drop()
        return out


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text; more columns are ignored).

    Documents link when ``den * intersection >= num * union`` of their distinct shingles of
    ``width`` words; fewer words make one shingle.  ``component_id`` is the smallest
    ``doc_id`` that links reach.  NULL, empty and blank texts have no shingle and link with
    nothing; rows with one doc_id are separate documents; a NULL doc_id never becomes a
    component's id unless its whole component has none.  An empty table gives an empty
    result.  Identical sets are recognised by 64-bit keys of their 64-bit shingle hashes.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold lies above 0 and at most at 1")
    return _Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), num, den, width).run()
