"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Random cosines of the standardised statistics approximate a Gaussian kernel.  Each task adds up
its part of the normal equations, Spark sums the parts, and the driver solves one small system;
the raw scores' label shares per bin, made monotone by pooling, turn them into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import Powers, Words, text_slices
from skyloom.llm.schema import with_fields

STATISTICS = ["length", "word_bytes", "symbols", "digits", "upper", "marks", "bangs", "bars", "different", "repeated", "phrases", "short", "long", "line_words", "wide"]
BINS = 400
LOW, HIGH = -0.5, 1.5


def _classes() -> np.ndarray:
    """One bit per kind of byte: symbol, digit, upper case, punctuation, exclamation, bar, line end, non-ASCII."""
    out = np.zeros(256, dtype=np.uint8)
    for bit, chars in enumerate(("#*$%&<>{}=", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:'\"()", "!?", "|", "\n")):
        out[[ord(c) for c in chars]] |= 1 << bit
    out[128:] |= 1 << 7
    return out


def _statistics(batches):
    powers, kinds = Powers(), _classes()
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            words = Words(data, offsets)
            docs, n = words.docs, words.counts
            hashes = words.hashes(powers)
            some = np.maximum(n, 1)
            size = np.maximum(np.diff(offsets), 1)
            flags = kinds[data]
            share = []
            for bit in range(8):
                sums = np.concatenate([[0], np.cumsum((flags >> bit) & 1, dtype=np.int64)])
                share.append(sums[offsets[1:]] - sums[offsets[:-1]])
            lengths = words.ends - words.starts
            total = lambda weights: np.bincount(words.doc, weights=weights, minlength=docs)
            at = np.lexsort((hashes, words.doc))
            h, d = hashes[at], words.doc[at]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            again = np.zeros(len(h), dtype=bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
            phrases, of, _ = words.shingles(powers, 3)
            at = np.lexsort((phrases, of))
            p, o = phrases[at], of[at]
            first = np.ones(len(p), dtype=bool)
            first[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
            made = np.maximum(np.bincount(o, minlength=docs), 1)
            values = np.column_stack([
                np.log1p(n), total(lengths) / some, np.log1p(100 * share[0] / size), share[1] / size, share[2] / size, share[3] / size, np.log1p(100 * share[4] / size),
                np.log1p(100 * share[5] / size), np.bincount(d[new], minlength=docs) / some, total(again) / some, np.bincount(o[first], minlength=docs) / made,
                total(lengths <= 3) / some, total(lengths >= 12) / some, np.log1p(n / (share[6] + 1)), share[7] / size])
            flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).reshape(-1))
            ends = pa.array(np.arange(docs + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.ListArray.from_arrays(ends, flat)], [*rows.schema.names[1:], "stats"])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the array ``stats`` per row of ``docs``; a NULL or empty text has the statistics of no word."""
    kept = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    return kept.mapInArrow(_statistics, with_fields(kept, "stats array<double>"))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # calibrated probability per bin of the raw score

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([waves, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((raw - LOW) / (HIGH - LOW) * BINS), 0, BINS - 1).astype(np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    stats = batch.column(batch.schema.get_field_index("stats"))
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(STATISTICS))


def _equations(model):
    def run(batches):
        known = QualityModel(**model.value)
        side = len(known.phases) + 1
        total = np.zeros((side, side + 1))
        for batch in batches:
            x = known.features(_matrix(batch))
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            total += x.T @ np.column_stack([x, y])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1).astype(np.int32)), pa.array(j.reshape(-1).astype(np.int32)), pa.array(total.reshape(-1))], ["i", "j", "v"])

    return run


def _binned(model):
    def run(batches):
        known = QualityModel(**model.value)
        total = np.zeros((BINS, 2))
        for batch in batches:
            at = known.bins(known.raw(_matrix(batch)))
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            total[:, 0] += np.bincount(at, minlength=BINS)
            total[:, 1] += np.bincount(at, weights=y, minlength=BINS)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used, 0]), pa.array(total[used, 1])], ["bin", "n", "ones"])

    return run


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing probabilities per bin by pooling adjacent violators; empty bins are interpolated."""
    used = np.flatnonzero(n)
    if not len(used):
        return np.full(len(n), 0.5)
    blocks: list[list[float]] = []  # weight, sum, number of bins
    for k in used.tolist():
        blocks.append([n[k], ones[k], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            weight, total, count = blocks.pop()
            blocks[-1] = [blocks[-1][0] + weight, blocks[-1][1] + total, blocks[-1][2] + count]
    # One pseudo-observation of either label keeps scores off 0 and 1.
    fitted = np.concatenate([np.full(int(c), (s + 0.5) / (w + 1)) for w, s, c in blocks])
    return np.interp(np.arange(len(n)), used, np.maximum.accumulate(fitted))


def train(stats: DataFrame, waves: int = 192, width: float = 3.0, ridge: float = 1e-4, seed: int = 11) -> QualityModel:
    """Model from rows (stats, label 0/1, or NULL for unlabelled ones, which only help to standardise).

    All labelled rows count; the driver gets sums only.  Without labelled rows every score is 0.5.
    """
    spark = stats.sparkSession
    moments = stats.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    for i, m, s in moments:
        mean[i], scale[i] = m, s if s and s > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(size=(len(STATISTICS), waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.full(BINS, 0.5))
    labelled = stats.filter("label IS NOT NULL").select("stats", F.col("label").cast("double").alias("label"))
    parts = labelled.mapInArrow(_equations(spark.sparkContext.broadcast(vars(model))), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    if parts.num_rows:
        system = np.zeros((waves + 1, waves + 2))
        system[parts.column("i").to_numpy(), parts.column("j").to_numpy()] = parts.column("v").to_numpy()
        count = max(system[-1, waves], 1.0)
        model.weights = np.linalg.solve(system[:, :-1] + ridge * count * np.eye(waves + 1), system[:, -1])
        bins = labelled.mapInArrow(_binned(spark.sparkContext.broadcast(vars(model))), "bin int, n double, ones double").groupBy("bin").agg(
            F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
        n, ones = np.zeros(BINS), np.zeros(BINS)
        for b, k, s in bins:
            n[b], ones[b] = k, s
        model.levels = isotonic(n, ones)
    return model


def _score(model):
    def run(batches):
        known = QualityModel(**model.value)
        edges = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        for batch in batches:
            keep = [i for i, name in enumerate(batch.schema.names) if name != "stats"]
            raw = known.raw(_matrix(batch))
            score = np.clip(np.interp(raw, edges, known.levels), 0, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(score)], [*[batch.schema.names[i] for i in keep], "score"])

    return run


def score(stats: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) for every row of ``stats``."""
    kept = stats.select(*keep, "stats")
    return kept.mapInArrow(_score(stats.sparkSession.sparkContext.broadcast(vars(model))), with_fields(kept, "score double", ("stats",)))
