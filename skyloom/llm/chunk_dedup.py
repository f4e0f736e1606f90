"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; it depends on the last 16 bytes only.  A border
falls where no place within ``REACH`` on either side has a smaller one: at the same place of a
passage wherever the passage stands, and text inserted before it shifts no later border.
Chunks are compared by 128-bit digests; runs of chunks that the corpus holds earlier, grown byte by
byte at both ends as far as the earlier copy agrees, are the duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.hashing import _BASE, _BYTE_VALUES, Powers, mix, text_slices
from skyloom.llm.schema import with_fields
from skyloom.llm.scratch import Scratch

REACH = 11  # places on either side that a border's hash lies below: chunks of 2 * REACH + 1 bytes on average
LEAST, MOST = 15, 256  # bytes of a text before its first border, of a chunk
SIDE, WIDER = 128, 8  # bytes first compared at either end of a run; times as many where all of them agree
_GEAR = (_BYTE_VALUES >> np.uint64(40)).astype(np.uint16)


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all chunks of a slice (every non-empty text's start among them), ascending."""
    # h(i) = sum of gear(byte i - j) * 2^j over j < 16, by doubling the span four times.
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    # Mixed one to one, so that equal values come from equal bits alone.
    h = h * np.uint16(0x9E37)
    h = (h ^ (h >> np.uint16(7))) * np.uint16(0x2C1B)
    # Bytes of the text before must not count: a text's first places are above all values.
    top = np.uint32(1 << 16)
    h = h.astype(np.uint32)
    for k in range(LEAST):
        at = offsets[:-1] + k
        h[at[at < offsets[1:]]] = top
    # REACH is at most LEAST, so what lies beyond a text's end within reach is above all values too.
    wall = np.full(REACH, top, dtype=np.uint32)
    low = np.lib.stride_tricks.sliding_window_view(np.concatenate([wall, h, wall]), REACH).min(axis=1)
    cut = np.flatnonzero((h < top) & (h <= low[:len(h)]) & (h <= low[REACH + 1:])) + 1
    # Equal ones within reach come from bytes that repeat themselves.  Of such a row, at even steps, every
    # so many count that chunks have their size: whichever they are, the chunks between them are equal.
    if len(cut):
        step = np.diff(cut, prepend=cut[0] - REACH - 1)
        fresh = step > REACH
        fresh[2:] |= (step[2:] != step[1:-1]) & ~fresh[1:-1]
        at = np.flatnonzero(fresh)
        own = np.arange(len(cut)) - np.repeat(at, np.diff(at, append=len(cut)))
        cut = cut[own % -(-(REACH + 1) // np.minimum(np.where(fresh, REACH + 1, step), REACH + 1)) == 0]
    cut = cut[~np.isin(cut, offsets)]
    starts = np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])
    if not len(starts):
        return starts.astype(np.int64)
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    parts = -(-sizes // MOST)
    first = np.repeat(starts, parts)
    return first + (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of byte ranges, as two 64-bit halves from independent polynomials."""
    up, down = powers.upto(len(data) + 1)
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)):
        values = mix(_BYTE_VALUES ^ salt)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:-1], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE).view(np.int64))
    return out[0], out[1]


def _chunks(batches):
    powers = Powers()
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            starts = borders(data, offsets)
            ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
            a, b = digests(data, starts, ends, powers)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            first = np.searchsorted(starts, offsets[:-1])
            place = np.arange(len(starts)) - first[doc]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array((starts - offsets[doc]).astype(np.int32)),
                 pa.array((ends - starts).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "place", "start", "length", "a", "b"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, place, start, length, a, b) per chunk; start and length in bytes of UTF-8; a, b: digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_chunks, "doc_id long, place int, start int, length int, a long, b long")


def _agreement(width: int):
    """(doc_id, run, side, n, more): bytes that an end's windows agree in; more: all of them, and there may be further ones."""
    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for n, i in zip(batch.schema.names, range(batch.num_columns))}
            counts, more = [], []
            for side, own, first in zip(cols["side"], cols["own"], cols["first"]):
                n = min(len(own), len(first))
                a, b = (np.frombuffer(x[len(x) - n:][::-1] if side == 0 else x[:n], dtype=np.uint8) for x in (own, first))
                differ = np.flatnonzero(a != b)
                k = int(differ[0]) if len(differ) else n
                more.append(k == width)
                # A span takes no part of a character.
                if side == 0:
                    while k and own[len(own) - k] & 0xC0 == 0x80:
                        k -= 1
                else:
                    while k and k < len(own) and own[k] & 0xC0 == 0x80:
                        k -= 1
                counts.append(k)
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "run", "side")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(counts, pa.int32()), pa.array(more, pa.bool_())], ["doc_id", "run", "side", "n", "more"])

    return run


def _windows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, pos, side, bytes): up to ``width`` bytes before (side 0) or from (side 1) each wanted place of a text.

    Texts that share a doc_id and differ there have none.
    """
    places = wanted.distinct().groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list(F.struct("pos", "side")).alias("_places"))  # bounded by a text's chunks
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("_raw")).filter("_raw IS NOT NULL")
    window = lambda p: F.when(p["side"] == 0, F.substring("_raw", F.greatest(p["pos"] - width, F.lit(0)) + 1, F.least(p["pos"], F.lit(width)))).otherwise(
        F.substring("_raw", p["pos"] + 1, F.lit(width)))
    cut = raw.join(places, F.expr("doc_id <=> _of")).select("doc_id", F.explode(F.transform("_places", lambda p: F.struct(p["pos"].alias("pos"), p["side"].alias("side"), window(p).alias("bytes")))).alias("_w"))
    one = cut.select("doc_id", "_w.*").groupBy("doc_id", "pos", "side").agg(F.min("bytes").alias("bytes"), F.max("bytes").alias("_other"))
    return one.filter("bytes = _other").drop("_other")


def _grown(docs: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """``runs`` with start and end moved outwards as far as the first copy of the end chunk agrees."""
    end = lambda side, pos, first, at: F.struct(F.lit(side).alias("side"), F.col(pos).alias("pos"), F.col(f"{first}.first_doc").alias("first_doc"), F.expr(at).alias("first_pos"))
    ends = runs.select("doc_id", F.col("start").alias("run"), F.explode(F.array(
        end(0, "start", "head", "head.first_start"), end(1, "end", "tail", "tail.first_start + tail.length"))).alias("_e")).select("doc_id", "run", "_e.*")
    found, width = [], SIDE
    while True:
        wanted = ends.select("doc_id", "pos", "side").unionByName(ends.select(F.col("first_doc").alias("doc_id"), F.col("first_pos").alias("pos"), "side"))
        windows = scratch.put(_windows(docs, wanted, width))
        own = windows.select(F.col("doc_id").alias("_d"), F.col("pos").alias("_p"), F.col("side").alias("_s"), F.col("bytes").alias("own"))
        first = windows.select(F.col("doc_id").alias("_fd"), F.col("pos").alias("_fp"), F.col("side").alias("_fs"), F.col("bytes").alias("first"))
        both = ends.join(own, F.expr("doc_id <=> _d AND pos = _p AND side = _s")).join(first, F.expr("first_doc <=> _fd AND first_pos = _fp AND side = _fs"))
        grown = scratch.put(both.select("doc_id", "run", "side", "own", "first").mapInArrow(_agreement(width), "doc_id long, run int, side int, n int, more boolean"))
        found.append(grown.filter("NOT more"))
        # Few ends agree in the whole window; they are looked at again in a wider one, to the end of the agreement.
        open_ends = grown.filter("more").select(F.col("doc_id").alias("_d"), F.col("run").alias("_r"), F.col("side").alias("_s"))
        if open_ends.isEmpty():
            break
        ends = scratch.put(ends.join(open_ends, F.expr("doc_id <=> _d AND run = _r AND side = _s"), "left_semi"))
        width *= WIDER
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    moves = every.groupBy(F.col("doc_id").alias("_d"), F.col("run").alias("_r")).agg(
        F.coalesce(F.max(F.expr("CASE WHEN side = 0 THEN n END")), F.lit(0)).alias("_left"), F.coalesce(F.max(F.expr("CASE WHEN side = 1 THEN n END")), F.lit(0)).alias("_right"))
    return runs.join(moves, F.expr("doc_id <=> _d AND start = _r"), "left").select(
        "doc_id", (F.col("start") - F.coalesce("_left", F.lit(0))).alias("start"), (F.col("end") + F.coalesce("_right", F.lit(0))).alias("end"), "n_chunks", "first_doc_id")


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_run``: ranges [start, end) of one document that touch or overlap share a number."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    new = F.when(F.col("start") <= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_spans(docs: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id) per duplicate span of at least ``least_bytes`` bytes.

    A chunk is a duplicate where an earlier one (by doc_id, then start) has its digest; adjacent
    duplicates of one document form a span (bytes of UTF-8, end exclusive), which grows at both ends
    by the bytes that stand there in the first copy of its end chunk too, and only then is measured.
    Spans that meet are one.  ``first_doc_id`` is the smallest document that holds one of the span's
    chunks.  A passage is found if a whole chunk lies in it.  NULL and empty texts have no
    chunk; rows with one doc_id are read as one document's repeated copies, so that all but one are
    duplicates; a NULL doc_id sorts first.
    """
    scratch = Scratch(docs.sparkSession)
    # Texts are cut twice, which is cheaper than keeping all chunks: the first time only half
    # digests are counted (combined before the exchange: a chunk that a third of all rows holds is one row per task).
    keys = scratch.put(chunk_table(docs).groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"))
    chunks = scratch.put(chunk_table(docs).select("doc_id", "start", "length", "a", "b").join(keys, "a", "left_semi"))
    found = chunks.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    repeats = found.filter("n > 1").select("a", "b", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    rows = chunks.join(repeats, ["a", "b"])
    # The first copy stays; where several rows share its doc_id and start, they are copies of each other.
    rows = rows.filter(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))))
    ranges = rows.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end"), "length", "first_doc", "first_start")
    one = F.struct("start", "first_doc", "first_start", "length")
    runs = scratch.put(_runs(ranges).groupBy("doc_id", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc").alias("first_doc_id"),
        F.min(one).alias("head"), F.max(F.struct("end", "first_doc", "first_start", "length")).alias("tail")).drop("_run"))
    spans = _runs(_grown(docs, runs, scratch)).groupBy("doc_id", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.filter(F.col("end") - F.col("start") >= least_bytes).select("doc_id", "start", "end", "n_chunks", "first_doc_id")


def _cut(batches):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        out = []
        for text, cuts in zip(texts, spans):
            if not cuts or text is None:
                out.append(text)
                continue
            raw, parts, done = text.encode(), [], 0
            for c in sorted(cuts, key=lambda c: c["start"]):
                parts.append(raw[done:c["start"]])
                done = max(done, c["end"])
            out.append(b"".join([*parts, raw[done:]]).decode("utf-8", "ignore"))
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(out, pa.string())], [*[batch.schema.names[i] for i in keep], "text"])


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the spans cut out of their texts; a character cut in two goes whole."""
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans")).withColumnRenamed("doc_id", "_of")
    rows = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("_of")), "left").select(*docs.columns, "_spans")
    return rows.mapInArrow(_cut, with_fields(docs, "text string")).select(*docs.columns)
