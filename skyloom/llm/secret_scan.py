"""Secrets in text: fixed rules, and random-looking strings by character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are counted
over the corpus from labelled samples: what a fixed rule takes for a secret's value is random; in
texts without one, runs of identifier characters that seldom change between lower case, upper case,
digits and signs are ordinary.  (Unknown secrets change often, so they don't teach the ordinary
model themselves.)  Of each run outside the base rules' spans the parts
with the most evidence are reported: those where the log-likelihood ratio of the two models, less a toll
per character, sums highest, if their ratio in all exceeds a threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import text_slices
from skyloom.llm.schema import with_fields

# The base rules, and how long a match (for ``assign`` its value) must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BORDER = len(ALPHABET)
SIDE = BORDER + 1
SHORTEST = 8  # runs of fewer characters teach nothing and are never reported
_CODE = np.full(256, BORDER, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(BORDER)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed rules' matches, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of 32 is found in the same place as the longest run that holds it.
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _secret_values(text: str) -> list[str]:
    low = text.lower()
    values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(k in low for k in KEYWORDS) else []
    values += [m[0][4:] for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    return values + [m[0] for m in HEX.finditer(text)]


# Lower case 0, upper case 1, digit 2, sign 3.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
CHANGES = 0.3  # ordinary runs change kind at most this often per character
SHORT = 20  # parts with fewer characters must also change kind more often


def _steady(run: np.ndarray) -> bool:
    kind = _KIND[run]
    return np.count_nonzero(kind[1:] != kind[:-1]) <= CHANGES * len(run)


class _Runs:
    """Runs of identifier characters of one slice, and the transition into each character."""

    def __init__(self, data, offsets, shortest: int):
        code = np.full(len(data) + 2, BORDER, dtype=np.int64)
        code[1:-1] = _CODE[data]
        inside = code != BORDER
        begins, finishes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        touching = edge[inside[edge] & inside[edge + 1]]
        begins[touching] = finishes[touching] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
        long = ends - starts >= shortest
        self.starts, self.ends = starts[long], ends[long]
        before = code[:-2].copy()
        before[starts] = BORDER
        self.step = before * SIDE + code[1:-1]
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        kind = _KIND[data]
        changed = np.concatenate([[0, 0], np.cumsum(kind[1:] != kind[:-1])])
        # Changes between the first and the last character of a run.
        self.steady = changed[self.ends] - changed[np.minimum(self.starts + 1, len(data))] <= CHANGES * (self.ends - self.starts)

    def counts(self, chosen) -> np.ndarray:
        mark = np.zeros(len(self.step) + 1, dtype=np.int64)
        np.add.at(mark, self.starts[chosen], 1)
        np.add.at(mark, self.ends[chosen], -1)
        return np.bincount(self.step[np.cumsum(mark[:-1]) > 0], minlength=SIDE * SIDE)


def _value_counts(values: list[str]) -> np.ndarray:
    out = np.zeros(SIDE * SIDE, dtype=np.int64)
    for v in values:
        code = np.concatenate([[BORDER], _CODE[np.frombuffer(v.encode(), dtype=np.uint8)]])
        np.add.at(out, code[:-1] * SIDE + code[1:], 1)
    return out


def _count(batches):
    random, ordinary = np.zeros(SIDE * SIDE, dtype=np.int64), np.zeros(SIDE * SIDE, dtype=np.int64)
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            runs = _Runs(data, offsets, SHORTEST)
            plain = np.ones(rows.num_rows, dtype=bool)
            for i, text in enumerate(rows.column(0).to_pylist()):
                values = _secret_values(text) if text else []
                if values:
                    plain[i] = False
                    random += _value_counts(values)
            ordinary += runs.counts(plain[runs.doc] & runs.steady)
    for name, counts in (("random", random), ("ordinary", ordinary)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["model", "step", "n"])


@dataclass
class SecretModel:
    ratio: np.ndarray  # log-likelihood ratio of each transition
    evidence: float = 20.0  # of a part, in nats
    toll: float = 0.5  # a character below this ratio does not prolong a part


def train(docs: DataFrame, evidence: float = 20.0, toll: float = 0.5) -> SecretModel:
    """Both character models from every text of ``docs``; the driver gets two tables of transitions.

    A part of ``SHORTEST`` characters or more is reported if its log-likelihood ratio reaches ``evidence``.
    Without any sample a model is uniform, so nothing is reported beyond the base rules.
    """
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_count, "model string, step int, n long").groupBy("model", "step").agg(F.sum("n").alias("n")).collect()
    counts = {"random": np.zeros(SIDE * SIDE), "ordinary": np.zeros(SIDE * SIDE)}
    for model, step, n in found:
        counts[model][step] += n
    logs = {}
    for name, c in counts.items():
        square = c.reshape(SIDE, SIDE)
        # Random characters hardly depend on what stands before: back off to their own shares.
        share = (square.sum(axis=0) + 1) / (square.sum() + SIDE)
        logs[name] = np.log((square + 20 * share[None, :]) / (square.sum(axis=1, keepdims=True) + 20))
    return SecretModel((logs["random"] - logs["ordinary"]).reshape(-1), evidence, toll)


def _maximal(x: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-sum ranges of ``x`` (Ruzzo and Tompa), in one pass over its stretches of one sign."""
    borders = np.concatenate([[0], np.flatnonzero(np.diff(x > 0)) + 1])
    total = 0.0
    left, right, starts, ends, lower = [], [], [], [], []  # sums before and after each range; the last range that begins lower
    for start, end, sum_ in zip(borders.tolist(), [*borders[1:].tolist(), len(x)], np.add.reduceat(x, borders).tolist()):
        before, total = total, total + sum_
        if sum_ <= 0:
            continue
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= before:
                j = lower[j]
            if j < 0 or right[j] >= total:
                break
            # The range grows back over that one and all since.
            before, start = left[j], starts[j]
            for part in (left, right, starts, ends, lower):
                del part[j:]
        for part, value in zip((left, right, starts, ends, lower), (before, total, start, end, j)):
            part.append(value)
    return list(zip(starts, ends))


def _parts(run: np.ndarray, ratio: np.ndarray, free: np.ndarray, evidence: float, toll: float) -> list[tuple[int, int]]:
    """Disjoint ranges of one run, clear of base spans, of ``evidence`` or more.

    A range of fewer than ``SHORT`` characters that seldom changes kind is of the ordinary sort by definition.
    Fewer than ``SHORTEST`` characters beside a range, up to the stretch's end or the next range, belong to it.
    """
    found = []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if hi - lo < SHORTEST:
            continue
        done = lo
        mine = [(lo + s, lo + e) for s, e in _maximal(ratio[lo:hi] - toll)]
        mine = [(s, e) for s, e in mine if e - s >= SHORTEST and ratio[s:e].sum() >= evidence and (e - s >= SHORT or not _steady(run[s:e]))]
        for k, (s, e) in enumerate(mine):
            after = mine[k + 1][0] if k + 1 < len(mine) else hi
            s, e = done if s - done < SHORTEST else s, after if after - e < SHORTEST else e
            found.append((s, e))
            done = e
    return found


def _scan(model, redact: str | None):
    def run(batches):
        known = SecretModel(**model.value)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                runs = _Runs(data, offsets, SHORTEST)
                ratio = known.ratio[runs.step]
                gains = np.concatenate([[0.0], np.cumsum(np.maximum(ratio - known.toll, 0))])
                # A run whose gains all together stay below what a part needs above the toll is passed over.
                least = known.evidence - known.toll * (runs.ends - runs.starts)
                odd = np.flatnonzero((gains[runs.ends] - gains[runs.starts] > 0) & (gains[runs.ends] - gains[runs.starts] >= least))
                first = np.searchsorted(runs.doc[odd], np.arange(rows.num_rows + 1))
                spans, texts = [], []
                for i, text in enumerate(rows.column(0).to_pylist()):
                    mine = base_spans(text) if text else []
                    hits = odd[first[i]:first[i + 1]]
                    if len(hits):
                        raw = data[offsets[i]:offsets[i + 1]]
                        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        taken = np.zeros(int(point[-1]) + 1, dtype=bool)
                        for _, s, e in mine:
                            taken[s:e] = True
                        for s, e in zip(runs.starts[hits].tolist(), runs.ends[hits].tolist()):
                            at = int(point[s - offsets[i]])  # runs are of single bytes
                            mine += [("markov", at + x, at + y) for x, y in _parts(data[s:e], ratio[s:e], ~taken[at:at + e - s], known.evidence, known.toll)]
                        mine.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in mine])
                    if redact is not None:
                        texts.append(_without(text, mine, redact))
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                more, names = ([pa.array(texts, pa.string())], ["redacted"]) if redact is not None else ([], [])
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(spans, kind), *more], [*rows.schema.names[1:], "spans", *names])

    return run


def _without(text: str | None, spans, mark: str) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def scan(docs: DataFrame, model: SecretModel, keep: list[str], redact: str | None = None) -> DataFrame:
    """``keep`` columns and ``spans`` (kind, start, end in code points) for every row of ``docs`` (text; whole texts).

    Spans come by start and then kind; the base rules' may overlap across kinds, ``markov``
    spans overlap none of them.  With ``redact``, ``redacted`` holds the text with every span (joined
    where they overlap) replaced by that mark.  NULL and empty texts have no span; a NULL text
    stays NULL.
    """
    kept = docs.select(F.col("text").cast("string").alias("text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: executors need not import this module
    return kept.mapInArrow(_scan(shared, redact), with_fields(kept, f"spans {SPANS}" + (", redacted string" if redact is not None else "")))
