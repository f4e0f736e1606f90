"""Toxicity of documents after noisy-channel deobfuscation.

A token that may be disguised (digits or signs for letters, repeated letters, letters set apart by
blanks or dots) becomes a lattice of the letters each character may stand for.  The Viterbi path
through the lattice under a character trigram model of the corpus, at the channel's costs, is
the restored word; a token without such characters has a lattice of one path and stays.  Words and
their beginnings are the features of a logistic model fitted on labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import Words, text_slices
from skyloom.llm.language_id import SYMBOLS, _Letters
from skyloom.llm.schema import with_fields
from skyloom.llm.scratch import Scratch
from skyloom.llm.unicode import CodePoints

# What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
        "€": "e", "£": "l", "(": "c", "¡": "i"}
SUBSTITUTION, COLLAPSE = 1.0, 0.5  # channel costs
CACHED_WORDS = 400_000
SIDE = 64
_EDGES = ".,;:!?\"'()[]{}<>*_~-«»¿¡…"
_SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:?] ){3,}[^\s.,;:?](?!\S)")


def symbol(code: np.ndarray) -> np.ndarray:
    """0: border, 1-26: a-z, 27-63: all other letters."""
    code = code.astype(np.int64)
    return np.where((code >= 97) & (code <= 122), code - 96, np.where(code == 0, 0, 27 + code % 37))


_SYMBOL_OF = symbol(np.arange(SYMBOLS))


def _count_trigrams(batches):
    tables = CodePoints()
    counts = np.zeros(SIDE ** 3, dtype=np.int64)
    for batch in batches:
        for _, data, offsets in text_slices(batch):
            letters = _Letters(data, offsets, tables)
            if not len(letters.first):
                continue
            here, before = _SYMBOL_OF[letters.bigrams % SYMBOLS], _SYMBOL_OF[letters.bigrams // SYMBOLS]
            earlier = np.concatenate([[0], before[:-1]])
            earlier[letters.first] = 0
            counts += np.bincount((earlier * SIDE + before) * SIDE + here, minlength=SIDE ** 3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["item", "n"])


def train_characters(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of the third letter given two, from every text; the driver gets at most 64^3 counters."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_count_trigrams, "item int, n long").groupBy("item").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIDE ** 3)
    counts[found.column("item").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(SIDE, SIDE, SIDE)
    pairs = counts.sum(axis=0)
    back = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * SIDE)
    return np.log((counts + 4 * back[None]) / (counts.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


class Restorer:
    """Restores tokens by the Viterbi path of their lattice."""

    def __init__(self, scores: np.ndarray):
        self.scores = scores.tolist()

    @staticmethod
    def _symbol(c: str) -> int:
        k = ord(c)
        return k - 96 if 97 <= k <= 122 else 27 + (k if k < 384 else 384 + (k * 2654435761 % 2 ** 32 >> 25) % 128) % 37

    def lattice(self, token: str) -> list[list[tuple[str, float]]] | None:
        """Options (letters, cost) per run of equal characters; None if there is only one path."""
        parts, several, at = [], False, 0
        while at < len(token):
            c, run = token[at], 1
            while at + run < len(token) and token[at + run] == c:
                run += 1
            at += run
            if c in LEET:
                options = [(x * k, SUBSTITUTION + COLLAPSE * (k < run)) for x in LEET[c] for k in {1, min(run, 2)}]
            elif run > 1:
                options = [(c * k, COLLAPSE * (k < run)) for k in (1, 2)]
            else:
                options = [(c, 0.0)]
            several = several or len(options) > 1 or c in LEET
            parts.append(options)
        return parts if several else None

    def restore(self, token: str) -> str:
        """The likeliest word behind a lower-cased token; tokens without letters stay."""
        token = token.strip(_EDGES)
        letters = sum(map(str.isalpha, token))
        if not letters:
            return token
        pieces = re.split(r"[.\-_*~·]+", token)
        if len(pieces) > 3 and all(len(p) == 1 for p in pieces):
            token = "".join(pieces)
        parts = self.lattice(token)
        if parts is None:
            return token
        beams: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in parts:
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in beams.items():
                for letters_, cost in options:
                    p, q, s = a, b, score - cost
                    for c in letters_:
                        k = self._symbol(c)
                        s += self.scores[p][q][k]
                        p, q = q, k
                    if (p, q) not in new or new[p, q][0] < s:
                        new[p, q] = (s, text + letters_)
            beams = new
        return max((score + self.scores[a][b][0], text) for (a, b), (score, text) in beams.items())[1]


_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")


def _squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


def _features(word: str) -> tuple[str, ...]:
    if not word:
        return ()
    return (word, *[f"^{word[:k]}" for k in range(4, min(len(word), 8))])


class Reader:
    """Features of a text's words, restored where they may be disguised; repeated tokens are looked up."""

    def __init__(self, scores: np.ndarray, known: dict[str, int] | None):
        self.restorer, self.known, self.cache = Restorer(scores), known, {}
        # Restoring letters only changes runs of them: what can become a known feature shares its squeezed form.
        self.squeezed = {_squeeze(f) for f in known or ()}

    def of_token(self, token: str):
        low = token.lower().strip(_EDGES)
        found = _features(low)
        plain_letters = low.isalpha()
        if plain_letters and not _DOUBLE.search(low):
            return self._coded(found)
        if plain_letters and self.known is not None:
            squeezed = _squeeze(low)
            if squeezed not in self.squeezed and not any("^" + squeezed[:k] in self.squeezed for k in range(1, min(len(squeezed), 7) + 1)):
                return self._coded(found)
        restored = self.restorer.restore(token.lower())
        return self._coded(found + _features(restored) if restored != low else found)

    def of_spaced(self, letters: str):
        word = self.restorer.restore(letters.lower())
        found = set(_features(word))
        if self.known is not None:  # neighbours may be letters, too: any part may be the word
            parts = {word[i:j] for i in range(len(word)) for j in range(i + 4, min(len(word), i + 24) + 1)}
            found = found.union(*[_features(p) for p in parts if p in self.known])
        return self._coded(tuple(found))

    def _coded(self, found):
        return found if self.known is None else tuple(self.known[f] for f in found if f in self.known)

    def documents(self, batch: pa.RecordBatch):
        """(row of the slice's batch, set of features) of every document, in order."""
        for rows, data, offsets in text_slices(batch):
            words = Words(data, offsets)
            short = np.concatenate([words.ends - words.starts <= 2, [False] * 3])
            # Documents with four single letters in a row: only they can hold a spaced word.
            four = short[:-3] & short[1:-2] & short[2:-1] & short[3:]
            spaced = np.zeros(rows.num_rows, dtype=bool)
            spaced[words.doc[four]] = True
            for i, text in enumerate(rows.column(0).to_pylist()):
                tokens = set((text or "").split())
                if len(self.cache) > CACHED_WORDS:
                    self.cache = {}
                cache = self.cache
                for t in tokens.difference(cache):
                    cache[t] = self.of_token(t)
                found = set().union(*set(map(cache.__getitem__, tokens)))
                if spaced[i]:
                    for m in _SPACED.finditer(text):
                        found.update(self.of_spaced(m[0].replace(" ", "")))
                yield rows, i, found


def _frequent(scores):
    def run(batches):
        reader, counts = Reader(scores.value, None), Counter()
        for batch in batches:
            for _, _, found in reader.documents(batch):
                counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return run


def _present(scores, names):
    def run(batches):
        reader = Reader(scores.value, {f: i for i, f in enumerate(names.value)})
        for batch in batches:
            hits, rows = [], 0
            labels = batch.column(1)
            for _, _, found in reader.documents(batch):
                hits.append(sorted(found))
                rows += 1
            yield pa.RecordBatch.from_arrays([labels, pa.array(hits, pa.list_(pa.int32()))], ["label", "items"])

    return run


@dataclass
class ToxicityModel:
    scores: np.ndarray
    names: list[str]
    weights: np.ndarray
    bias: float


def _logistic(row: np.ndarray, item: np.ndarray, label: np.ndarray, items: int, ridge: float = 0.05, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on a sparse 0/1 matrix by steps scaled with each column's size."""
    weights, bias = np.zeros(items), float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))) if len(label) else -4.0
    if not len(label):
        return weights, bias
    most = max(1, np.bincount(row, minlength=len(label)).max() if len(row) else 1)
    size = np.bincount(item, minlength=items)
    step = 1.0 / (0.25 * size * min(most, 8) + ridge)
    for _ in range(rounds):
        z = bias + np.bincount(row, weights=weights[item], minlength=len(label))
        off = label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        weights += step * (np.bincount(item, weights=off[row], minlength=items) - ridge * weights)
        bias += off.sum() / (0.25 * len(label))
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, least: float = 0.002, odds: float = 2.5) -> ToxicityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Character statistics come from every text.  The word weights are fitted on at most
    ``max_labelled`` labelled documents, those of the smallest hashed ids; this bound is what
    makes their ids and features small enough for the driver.  A feature needs the share ``least`` of the
    toxic ones (three at least) and log-odds of ``odds``.  A NULL label or id is left out; of several labels the
    highest counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    shared = spark.sparkContext.broadcast(train_characters(docs))
    sample = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = scratch.put(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    often = rows.filter("label = 1").mapInArrow(_frequent(shared), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    needed = max(3, least * sample.filter("label = 1").count())
    names = sorted(r[0] for r in often.filter(F.col("n") >= needed).select("feature").collect())
    seen = scratch.put(rows.mapInArrow(_present(shared, spark.sparkContext.broadcast(names)), "label int, items array<int>"))
    total = dict(seen.groupBy("label").count().collect())
    toxic, other = total.get(1, 0), sum(n for k, n in total.items() if k != 1)
    flat = seen.select("label", F.explode("items").alias("item")).groupBy("item").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
    chosen = [item for item, a, n in flat.collect()
              if np.log((a + 0.5) / (toxic + 1)) - np.log((n - a + 0.5) / (other + 1)) >= odds]
    if chosen:
        picked = spark.createDataFrame([(c,) for c in sorted(chosen)], "item int").agg(F.collect_list("item").alias("chosen"))
        table = seen.crossJoin(F.broadcast(picked)).select("label", F.array_intersect("items", "chosen").alias("items"))  # one row
    else:
        table = seen.select("label", F.array().cast("array<int>").alias("items"))
    # Bounded by max_labelled rows of the few chosen features each.
    table = table.toArrow()
    label = table.column("label").to_numpy().astype(float) if table.num_rows else np.zeros(0)
    place = {c: i for i, c in enumerate(sorted(chosen))}
    lists = table.column("items").to_pylist()
    row = np.array([i for i, x in enumerate(lists) for _ in x], dtype=np.int64)
    item = np.array([place[c] for x in lists for c in x], dtype=np.int64)
    weights, bias = _logistic(row, item, label, len(chosen))
    scratch.drop(0)
    return ToxicityModel(shared.value, [names[c] for c in sorted(chosen)], weights, bias)


def _score(model):
    def run(batches):
        known = ToxicityModel(**model.value)
        reader = Reader(known.scores, {f: i for i, f in enumerate(known.names)})
        for batch in batches:
            z = [known.bias + sum(known.weights[i] for i in found) for _, _, found in reader.documents(batch)]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) for every row of ``docs`` (text; whole texts).

    NULL, empty and wordless texts get the score of a document without features.  Repeated rows
    are scored each; other columns are ignored.
    """
    kept = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return kept.mapInArrow(_score(shared), with_fields(kept, "score double"))
