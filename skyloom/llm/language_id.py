"""Language identification of mixed-language text.

A character-bigram model per language (with word borders as characters) scores every word; the
script of a word's first letter narrows its candidates to the languages that use that
script in the training text.  A Viterbi path over the words, with a penalty per switch, labels
spans; the language of most letters is the document's.

The path is exact however long the text is: words are cut into pieces, each piece's best
score from state to state is a small matrix, the matrices are chained per document, and
the states inside the pieces are then traced, all pieces of a batch side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import text_slices
from skyloom.llm.schema import with_fields
from skyloom.llm.unicode import SCRIPT_NAMES, TABLE, CodePoints, code_points

DIRECT = 384  # letters below have symbols of their own, the others share 128
SYMBOLS = 512
PIECE = 32
UNKNOWN = "und"
SPANS = "array<struct<start:int,end:int,lang:string>>"


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # languages x bigrams, log-probabilities
    uses: np.ndarray  # scripts x languages: is the script one of the language's


class _Letters:
    """Words (runs of letters) of one slice and the bigram under each of their characters."""

    def __init__(self, data, offsets, tables: CodePoints):
        points, self.offsets = code_points(data, offsets)
        inside = np.zeros(len(points) + 2, dtype=bool)
        small = np.minimum(points, TABLE - 1)
        inside[1:-1] = tables.is_letter[small] & (points < TABLE)
        begins, finishes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(points))]
        touching = edge[inside[edge] & inside[edge + 1]]
        begins[touching] = finishes[touching] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes)
        self.lengths = self.ends - self.starts
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        low = tables.lower[small]
        symbol = np.where(low < DIRECT, low, DIRECT + (low * np.uint32(2654435761) >> np.uint32(25)) % np.uint32(SYMBOLS - DIRECT)).astype(np.int32)
        self.script = tables.script[small[self.starts]] if len(self.starts) else np.zeros(0, dtype=np.int8)
        # One bigram per letter (with what stands before it) and one for the word's end.
        total = int(self.lengths.sum()) + len(self.starts)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        place = np.arange(total) - np.repeat(self.first, self.lengths + 1)
        source = np.repeat(self.starts, self.lengths + 1) + place
        last = place == np.repeat(self.lengths, self.lengths + 1)
        here = np.where(last, 0, symbol[np.minimum(source, max(len(points) - 1, 0))]) if total else np.zeros(0, dtype=np.int32)
        before = np.where(place == 0, 0, symbol[source - 1]) if total else here
        self.bigrams = before.astype(np.int64) * SYMBOLS + here


def _count(batches):
    tables = CodePoints()
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        done = 0
        for rows, data, offsets in text_slices(batch):
            letters = _Letters(data, offsets, tables)
            names = langs[done:done + rows.num_rows]
            done += rows.num_rows
            code = {n: i for i, n in enumerate(dict.fromkeys(names))}
            of = np.array([code[n] for n in names], dtype=np.int64)[letters.doc] if len(letters.doc) else letters.doc
            wide = np.repeat(of, letters.lengths + 1)
            for name, i in code.items():
                counts.setdefault(name, np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64))
                scripts.setdefault(name, np.zeros(len(SCRIPT_NAMES), dtype=np.int64))
                counts[name] += np.bincount(letters.bigrams[wide == i], minlength=SYMBOLS * SYMBOLS)
                mine = of == i
                scripts[name] += np.bincount(letters.script[mine], weights=letters.lengths[mine], minlength=len(SCRIPT_NAMES)).astype(np.int64)
    for name, values in counts.items():
        for kind, found in (("bigram", values), ("script", scripts[name])):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])],
                                             ["lang", "kind", "item", "n"])


def train(labelled: DataFrame, share: float = 0.02) -> LanguageModel:
    """Model from (text, lang); rows without a language are left out.

    Tasks add up bigram counts per language, Spark sums them; the driver gets at most
    ``SYMBOLS ** 2`` counters per language.  A script belongs to a language if at least ``share``
    of its letters are of that script.
    """
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "lang").filter("lang IS NOT NULL")
    found = rows.mapInArrow(_count, "lang string, kind string, item int, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    names, kinds, items, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "kind", "item", "n"))
    langs = sorted(set(names.tolist()))
    counts = np.zeros((len(langs), SYMBOLS * SYMBOLS))
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    for i, lang in enumerate(langs):
        mine = names == lang
        b, s = mine & (kinds == "bigram"), mine & (kinds == "script")
        counts[i, items[b]] = n[b]
        scripts[items[s], i] = n[s]
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    scores = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * seen)
    uses = scripts >= share * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    # A script that no language uses narrows nothing.
    uses[~uses.any(axis=1)] = True
    return LanguageModel(langs, scores.astype(np.float32), uses)


def best_path(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """State per word of the best path of each document; ``counts`` words each, a switch costs ``penalty``."""
    total, states = scores.shape
    if not total:
        return np.zeros(0, dtype=np.int64)
    pieces = -(-counts // PIECE)
    first_word, first_piece = np.concatenate([[0], np.cumsum(counts)])[:-1], np.concatenate([[0], np.cumsum(pieces)])[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    slot = first_piece[doc] * PIECE + np.arange(total) - first_word[doc]
    n = int(pieces.sum())
    # Places behind a document's last word score 0 in every state, which leaves its path alone.
    x = np.zeros((n * PIECE, states), dtype=np.float32)
    x[slot] = scores
    x = x.reshape(n, PIECE, states)
    through = np.full((n, states, states), -np.inf, dtype=np.float32)
    through[:, np.arange(states), np.arange(states)] = 0
    for t in range(PIECE):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + x[:, t, None, :]
    entry = np.zeros((n, states), dtype=np.float32)
    value = np.zeros((len(counts), states), dtype=np.float32)
    rounds = int(pieces.max())
    order = np.argsort(-pieces, kind="stable")
    longer = np.searchsorted(-pieces[order], -np.arange(rounds), side="left")  # documents with more than k pieces
    for k in range(rounds):
        live = order[:longer[k]]
        at = first_piece[live] + k
        entry[at] = value[live]
        value[live] = (value[live][:, :, None] + through[at]).max(axis=1)
    last = np.zeros(n, dtype=np.int64)
    state = value.argmax(axis=1)
    for k in range(rounds - 1, -1, -1):
        live = order[:longer[k]]
        at = first_piece[live] + k
        last[at] = state[live]
        state[live] = (entry[at] + through[at, :, state[live]]).argmax(axis=1)
    held = np.zeros((PIECE + 1, n, states), dtype=np.float32)
    held[0] = entry
    for t in range(PIECE):
        held[t + 1] = np.maximum(held[t], held[t].max(axis=1, keepdims=True) - penalty) + x[:, t]
    path = np.zeros((n, PIECE), dtype=np.int64)
    state, every = last, np.arange(n)
    for t in range(PIECE - 1, -1, -1):
        path[:, t] = state
        top = held[t].argmax(axis=1)
        state = np.where(held[t][every, state] >= held[t][every, top] - penalty, state, top)
    return path.reshape(-1)[slot]


def _label(model, penalty: float, lead: int):
    """``lead`` is the first column to hand on: 1 leaves the text out."""

    def run(batches):
        tables, known = CodePoints(), LanguageModel(**model.value)
        states = len(known.langs)
        names = pa.array(known.langs, pa.string())
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                docs = rows.num_rows
                letters = _Letters(data, offsets, tables)
                words = len(letters.starts)
                scores = np.empty((words, states), dtype=np.float32)
                for i in range(states):
                    scores[:, i] = np.add.reduceat(known.scores[i][letters.bigrams], letters.first) if words else 0
                scores[~known.uses[letters.script]] = -1e4
                scores -= scores.max(axis=1, keepdims=True)
                path = best_path(scores, np.bincount(letters.doc, minlength=docs), penalty)
                mass = np.bincount(letters.doc * states + path, weights=letters.lengths, minlength=docs * states).reshape(docs, states)
                total = mass.sum(axis=1)
                best = mass.argmax(axis=1)
                score = np.where(total > 0, mass[np.arange(docs), best] / np.maximum(total, 1), 0.0)
                new = np.ones(words, dtype=bool)
                new[1:] = (path[1:] != path[:-1]) | (letters.doc[1:] != letters.doc[:-1])
                at = np.flatnonzero(new)
                end = letters.ends[np.concatenate([at[1:] - 1, [words - 1]])] if words else letters.ends
                base = letters.offsets[letters.doc[at]]
                spans = pa.StructArray.from_arrays(
                    [pa.array((letters.starts[at] - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), names.take(pa.array(path[at]))], ["start", "end", "lang"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(letters.doc[at], minlength=docs))]).astype(np.int32)
                lang = names.take(pa.array(best, mask=total == 0)).fill_null(UNKNOWN)
                yield pa.RecordBatch.from_arrays([*rows.columns[lead:], lang, pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)],
                                                 [*rows.schema.names[lead:], "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: LanguageModel, keep: list[str | Column], penalty: float = 12.0, with_text: bool = False) -> DataFrame:
    """``keep`` columns plus lang_pred, score and spans for every row of ``docs`` (text; whole texts).

    ``with_text`` hands the text on, as the first column, NULL as ''; it need not travel a second time among ``keep``.

    ``score`` is the share of letters in spans of the predicted language; ``spans`` gives
    (start, end, lang) in code points.  NULL, empty and letterless texts are ``und`` with score
    0 and no span, as is every text under a model without languages.  Ties go to the
    alphabetically first language.
    """
    kept = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    lead = 0 if with_text else 1
    fields = [f for f in kept.schema.fields[lead:]]
    if not model.langs:
        return kept.select(*[f.name for f in fields], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: executors need not import this module
    return kept.mapInArrow(_label(shared, penalty, lead), with_fields(kept, f"lang_pred string, score double, spans {SPANS}", () if with_text else ("text",)))
