"""Packing tokenised documents into sequences by shortest-pack-first over the length histogram.

A document's full sequences stand alone; what remains counts in a histogram of at most
``size`` lengths.  The plan is made from the histogram only: lengths are placed longest first,
many documents at a time, into the pack pattern that is shortest so far, and patterns carry
counts.  Where patterns stay open, the emptiest are taken apart again and cut so that they fill
the gaps of the others.  Documents of one length are then ranked, and a pattern's rank ranges
join back to them.  The driver sees the histogram and the plan, whose sizes don't grow with the input.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import zlib
from array import array
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.scratch import Scratch

CACHED_WORDS = 700_000
CACHED_LENGTH = 64
RANKED_ROWS = 50_000  # rows of one length that a window ranks together
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, doc_crc32 long"


# Under these steps a lower-case word of Latin letters, or a run of marks, is one piece that reaches the model as the stand-ins of its bytes.
WORD_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}


class WordTokens:
    """Token ids of whole texts as little-endian bytes, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are its words'
    ids in order, and words repeat.  Words with unusual characters go to it as they are.  Under
    ``WORD_STEPS`` other words go straight to its model, as the steps before it leave them alone.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        steps = (state(self.encoder.normalizer), state(self.encoder.pre_tokenizer))
        self.model = self.encoder.model if steps == WORD_STEPS and self.encoder.post_processor is None else None
        # Case and closing marks of common words are settled here: fewer different words to encode.
        self.common = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*]*)" if self.model else "([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
        self.known: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return self._bytes([e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)])

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        if self.model is None:
            return self._encode(words)
        tokenize = self.model.tokenize
        pieces = (w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS) for w in words)
        return self._bytes([[t.id for t in tokenize(w)] for w in pieces])

    @staticmethod
    def _bytes(found: list[list[int]]) -> list[bytes]:
        if array("I").itemsize != 4 or sys.byteorder != "little":
            return [b"".join(i.to_bytes(4, "little") for i in ids) for ids in found]
        return [array("I", ids).tobytes() for ids in found]

    def _learn(self, words: set[str]) -> None:
        parts, odd, new = {}, [], set()
        for w in words:
            m = self.common(w)
            if m is None:
                odd.append(w)
                continue
            letters, mark = m.groups()
            parts[w] = letters, mark = letters.lower(), mark
            new.add(letters)
            if mark:
                new.add(mark)
        fresh = [w for w in new if w not in self.plain]
        self.plain.update(zip(fresh, self._encode_plain(fresh)))
        plain = self.plain
        self.known.update((w, plain[a] + plain[b] if b else plain[a]) for w, (a, b) in parts.items())
        self.known.update(zip(odd, self._encode(odd)))

    def ids(self, texts: list[str]):
        """Id bytes of each text, closed by the end id."""
        for lo in range(0, len(texts), 500):
            split = [t.replace("\n", " ").split(" ") for t in texts[lo:lo + 500]]
            if len(self.known) > CACHED_WORDS:
                self.known, self.plain = {"": b""}, {}
            # One call of the encoder for all new words of some hundred texts.
            missing = set().union(*split).difference(self.known)
            self._learn(missing)
            for words in split:
                yield b"".join(map(self.known.__getitem__, words)) + self.end
            for w in missing:
                if len(w) > CACHED_LENGTH:
                    del self.known[w]


def _pieces(path: str, end_id: int, size: int):
    def run(batches):
        encoder = WordTokens(path, end_id)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, ids in zip(docs, encoder.ids([t or "" for t in texts])):
                total, whole = len(ids) // 4, zlib.crc32(ids)
                for at in range(0, total, size):
                    part = ids[4 * at:4 * (at + size)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), total, whole))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"])

    return run


def _cut_checksums(path: str, end_id: int):
    """Checksums of wanted id ranges of documents that the plan cuts."""
    def run(batches):
        encoder = WordTokens(path, end_id)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            wanted = batch.column("wanted").to_pylist()
            rows = []
            for doc, parts, ids in zip(batch.column("doc_id").to_pylist(), wanted, encoder.ids(texts)):
                total, whole = len(ids) // 4, zlib.crc32(ids)
                rows += [(doc, whole, total, p["start"], p["length"], zlib.crc32(ids[4 * p["start"]:4 * (p["start"] + p["length"])]))
                         for p in parts if p["doc_crc32"] == whole and p["doc_tokens"] == total]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "doc_crc32", "doc_tokens", "start", "length", "crc"])

    return run


@dataclass(frozen=True)
class Lot:
    """``count`` parts of equal length: ids from ``start`` on of the pieces of length ``of`` with ranks from ``lo`` on."""

    length: int
    of: int
    lo: int
    start: int
    count: int

    def split(self, k: int) -> tuple[Lot, Lot]:
        return replace(self, count=k), replace(self, lo=self.lo + k, count=self.count - k)


class Patterns:
    """Pack patterns by fill; a pattern is (count, lots) and each of its lots gives every pack one part."""

    def __init__(self, size: int):
        self.size, self.by_fill = size, {}
        self.fills: list[int] = []

    def add(self, count: int, lots: tuple[Lot, ...]) -> None:
        fill = sum(x.length for x in lots)
        if fill not in self.by_fill:
            self.by_fill[fill] = []
            heapq.heappush(self.fills, fill)
        self.by_fill[fill].append((count, lots))

    def shortest(self) -> int | None:
        while self.fills and not self.by_fill.get(self.fills[0]):
            self.by_fill.pop(heapq.heappop(self.fills), None)
        return self.fills[0] if self.fills else None

    def place(self, lot: Lot) -> None:
        """Shortest pack first; a new pack only where the shortest has no room."""
        while lot.count:
            fill = self.shortest()
            if fill is None or fill + lot.length > self.size:
                each = self.size // lot.length
                packs = lot.count // each
                if packs:
                    parts = []
                    for _ in range(each):
                        part, lot = lot.split(packs)
                        parts.append(part)
                    self.add(packs, tuple(parts))
                if lot.count:
                    parts = []
                    for _ in range(lot.count):
                        part, lot = lot.split(1)
                        parts.append(part)
                    self.add(1, tuple(parts))
                return
            count, lots = self.by_fill[fill].pop()
            k = min(count, lot.count)
            part, lot = lot.split(k)
            taken = [x.split(k) for x in lots]
            self.add(k, (*[t[0] for t in taken], part))
            if count > k:
                self.add(count - k, tuple(t[1] for t in taken))

    def groups(self) -> list[tuple[int, tuple[Lot, ...]]]:
        return [g for fill in sorted(self.by_fill) for g in self.by_fill[fill]]


def plan(histogram: dict[int, int], size: int, slack: int = 8) -> list[tuple[int, tuple[Lot, ...]]]:
    """Pack patterns for ``histogram`` (length: count); gaps of more than ``slack`` tokens are filled by cutting."""
    packs = Patterns(size)
    for length in sorted(histogram, reverse=True):
        packs.place(Lot(length, length, 0, 0, histogram[length]))
    groups = packs.groups()
    fill = lambda g: sum(x.length for x in g[1])
    closed = lambda f: f + slack >= size or f & (f - 1) == 0
    done = [g for g in groups if closed(fill(g))]
    open_groups = sorted((g for g in groups if not closed(fill(g))), key=fill)
    # Take the emptiest apart until they hold what the others lack.
    lack = sum(g[0] * (size - fill(g)) for g in open_groups)
    pool: list[tuple[int, int, Lot]] = []
    first, held, tick = 0, 0, 0
    while first < len(open_groups):
        count, lots = open_groups[first]
        gap, need = size - fill((count, lots)), lack - held
        if need <= 0:
            break
        # Each pack taken apart gives its tokens and lacks its gap no longer: ``size`` together.
        k = min(count, -(-need // size))
        cut = [x.split(k) for x in lots]
        for part, _ in cut:
            tick += 1
            heapq.heappush(pool, (-part.length, tick, part))
        lack -= k * gap
        held += k * fill((1, lots))
        if k < count:
            open_groups[first] = (count - k, tuple(rest for _, rest in cut))
            break
        first += 1
    receivers = open_groups[first:][::-1]
    while receivers:
        count, lots = receivers.pop()
        gap = size - sum(x.length for x in lots)
        if gap <= slack or not pool:
            done.append((count, lots))
            continue
        _, _, lot = heapq.heappop(pool)
        k = min(count, lot.count)
        mine, other = lot.split(k)
        if other.count:
            tick += 1
            heapq.heappush(pool, (-other.length, tick, other))
        cut = [x.split(k) for x in lots]
        if count > k:
            receivers.append((count - k, tuple(rest for _, rest in cut)))
        take = replace(mine, length=min(gap, mine.length))
        if mine.length > gap:
            tick += 1
            heapq.heappush(pool, (gap - mine.length, tick, replace(mine, start=mine.start + gap, length=mine.length - gap)))
        receivers.append((k, (*[part for part, _ in cut], take)))
    rest = Patterns(size)
    while pool:
        rest.place(heapq.heappop(pool)[2])
    out = []
    for group in done + rest.groups():
        # What stays open at the very end is cut into powers of two, which need no padding.
        out += [group] if closed(fill(group)) else _powers(*group)
    return out


def _powers(count: int, lots: tuple[Lot, ...]) -> list[tuple[int, tuple[Lot, ...]]]:
    out, left = [], list(lots)
    while left:
        room = 1 << (sum(x.length for x in left).bit_length() - 1)
        mine = []
        while room:
            lot = left.pop(0)
            take = min(room, lot.length)
            mine.append(replace(lot, length=take))
            if take < lot.length:
                left.insert(0, replace(lot, start=lot.start + take, length=lot.length - take))
            room -= take
        out.append((count, tuple(mine)))
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` (doc_id, text; more columns are ignored) is tokenised whole and closed
    by ``end_id``; NULL and empty texts are that id alone.  Each id lies in one piece, pieces lie
    gapless from offset 0 in their sequence and a sequence holds at most ``size`` ids.  Rows with one
    doc_id, or a NULL one, are documents of their own.  An empty table gives no piece.
    ``tokenizer_path`` must be readable on every executor.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.put(texts.mapInArrow(_pieces(tokenizer_path, end_id, size), PIECES))
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in sizes}
    rows, sequence = [], 0
    for count, lots in plan(histogram, size):
        offset = 0
        for lot in lots:
            rows.append((lot.of, lot.lo, lot.lo + count, lot.start, lot.length, sequence, offset))
            offset += lot.length
        sequence += count
    spark = docs.sparkSession
    plan_rows = spark.createDataFrame(rows, "length int, _lo long, _hi long, _start int, _len int, _base long, offset long")
    # Ranks within a length: counted per bucket first, so that no task ranks a whole frequent length.
    buckets = max(1, sum(histogram.values()) // RANKED_ROWS)
    split = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "doc_crc32"), F.lit(buckets)))
    before = split.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "doc_crc32"))
    ranked = split.withColumn("_place", place).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    # The plan's size is bounded by the number of lengths, not by the input.
    laid = ranked.join(F.broadcast(plan_rows), "length").filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    laid = laid.select(
        "doc_id", (F.col("start") + F.col("_start")).alias("start"), F.col("_len").cast("long").alias("length"),
        F.when(F.col("_len") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens", "doc_crc32",
        (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")
    laid = scratch.put(laid)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = laid.filter("ids_crc32 IS NULL")
    # Only documents that were cut are read and tokenised again, for their parts' checksums.
    wanted = cut.groupBy("doc_id").agg(F.collect_set(F.struct("doc_crc32", "doc_tokens", "start", "length")).alias("wanted"))
    again = texts.alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id")).select("d.doc_id", "d.text", "w.wanted")
    sums = again.mapInArrow(_cut_checksums(tokenizer_path, end_id), "doc_id long, doc_crc32 long, doc_tokens long, start long, length long, crc long").distinct()
    keys = ["doc_crc32", "doc_tokens", "start", "length"]
    same = F.expr("a.doc_id <=> b.doc_id")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    filled = cut.alias("a").join(sums.alias("b"), same, "left").select(
        *[F.col(f"a.{c}") if c != "ids_crc32" else F.col("b.crc").alias(c) for c in out])
    return laid.filter("ids_crc32 IS NOT NULL").select(*out).unionByName(filled)
