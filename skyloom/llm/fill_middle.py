"""Fill-in-the-middle transformation by secondary-sort assembly.

A map step cuts every text at two token borders and emits its output as pieces of at most
``UNITS`` tokens, keyed by document and output position.  Rows are dealt by document and
sorted within partitions by position (the DataFrame form of repartitionAndSortWithinPartitions),
so one pass streams the pieces of each document, in order, into an incremental digest of the
output.  The same pass finds the markers in what streams by and hands the pieces on under the
position they have in the source; sorted again within the same partitions, they stream
into the digest of the restored text.  No task ever holds a document's output as a whole, and the
texts are exchanged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.hashing import text_slices

UNITS = 4096  # tokens to a piece
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
ROWS = 2000  # rows to an Arrow batch that leaves a task

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = True
_LETTER[97:123] = True

# Facts about a document travel with the piece at position 0.
FACTS = "n long, form string, prefix_chars long, middle_chars long"
KEY = ["doc_id", "_text", "_from"]
PIECES = f"doc_id long, _text long, _from int, _at int, data binary, {FACTS}"
RESTORED = f"doc_id long, _text long, _from int, _part int, _at int, data binary, {FACTS}, output_sha256 string, copies long"
OUTPUT = "doc_id long, form string, output string"
RESULT = f"doc_id long, {FACTS}, output_sha256 string, restored_sha256 string"


class Tokens:
    """Byte offsets of the tokens ``[A-Za-z]+|[^A-Za-z]`` of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter = _LETTER[data]
        inside = np.zeros(len(data), dtype=bool)  # letters that continue a run
        inside[1:] = letter[1:] & letter[:-1]
        edge = offsets[1:-1]
        inside[edge[edge < len(data)]] = False  # a text's first letter begins a token
        point = (data & 0xC0) != 0x80
        self.starts = np.flatnonzero(point & ~inside)
        self.first = np.searchsorted(self.starts, offsets)
        self.points = np.concatenate([[0], np.cumsum(point)])
        self.offsets = offsets

    def count(self, doc: int) -> int:
        return int(self.first[doc + 1] - self.first[doc])

    def at(self, doc: int, unit: int) -> int:
        """Byte offset of a document's token ``unit``; its number of tokens gives its end."""
        k = self.first[doc] + unit
        return int(self.starts[k]) if k < self.first[doc + 1] else int(self.offsets[doc + 1])

    def chars(self, start: int, end: int) -> int:
        return int(self.points[end] - self.points[start])


def choices(doc_id: int | None) -> list[int]:
    """h1 to h4 of a document; a NULL id stands for no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], dtype=">u4").tolist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces of the output."""
    for batch in batches:
        for rows, data, offsets in text_slices(batch, limit=1 << 22):
            tokens, out = Tokens(data, offsets), _Rows(PIECES)
            task = rows.column(2).to_pylist()
            for i, doc_id in enumerate(rows.column(0).to_pylist()):
                whole = data[offsets[i]:offsets[i + 1]].tobytes()
                n = tokens.count(i)
                h1, h2, h3, h4 = choices(doc_id)
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                plain = not whole or h3 % 100 >= 90 or any(m in whole for m in MARKS)
                x, y = tokens.at(i, a), tokens.at(i, b)
                key = (doc_id, int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True), task[i])
                if plain:
                    parts, facts = [(b"", 0, n)], (n, "plain", None, None)
                else:
                    spm = h4 % 100 < 20
                    prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, n)
                    parts = [suffix, prefix] if spm else [prefix, suffix]
                    parts.append((MIDDLE, a, b))
                    facts = (n, "spm" if spm else "psm", tokens.chars(int(offsets[i]), x), tokens.chars(x, y))
                at = 0
                for mark, lo, hi in parts:
                    for start in range(lo, max(hi, lo + 1), UNITS):
                        end = min(start + UNITS, hi)
                        piece = mark + data[tokens.at(i, start):tokens.at(i, end)].tobytes()
                        out.add(*key, at, piece, *(facts if at == 0 else (None,) * 4))
                        mark, at = b"", at + 1
                if len(out) >= ROWS:
                    yield out.batch()
            if len(out):
                yield out.batch()


class _Rows:
    """Rows of a fixed schema, gathered into Arrow batches."""

    TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def __init__(self, ddl: str):
        fields = [f.strip().split(" ") for f in ddl.split(",")]
        self.schema = pa.schema([(name, self.TYPES[kind]) for name, kind in fields])
        self.rows: list[tuple] = []

    def add(self, *row) -> None:
        self.rows.append(row)

    def extend(self, rows: list[tuple]) -> None:
        self.rows += rows

    def __len__(self) -> int:
        return len(self.rows)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return out


class Restorer:
    """Splits a streamed output at its markers: ``feed`` and ``close`` give (part, bytes).

    Parts are numbered as they follow in the source: prefix 0, middle 1, suffix 2.  Two bytes are
    held back, as a marker may lie across pieces; no part holds one, so the first one found is right.
    """

    PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

    def __init__(self, form: str):
        self.ahead = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}[form]
        self.part, self.held = 0, b""

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        out, self.held = [], self.held + data
        while self.ahead:
            mark = self.ahead[0]
            at = self.held.find(mark)
            if at < 0:
                keep = min(len(mark) - 1, len(self.held))
                done, self.held = self.held[:len(self.held) - keep], self.held[len(self.held) - keep:]
                return out + ([(self.part, done)] if done else [])
            if at:
                out.append((self.part, self.held[:at]))
            self.held, self.part, self.ahead = self.held[at + len(mark):], self.PART[mark], self.ahead[1:]
        done, self.held = self.held, b""
        return out + ([(self.part, done)] if done else [])

    def close(self) -> list[tuple[int, bytes]]:
        done, self.held = self.held, b""
        return [(self.part, done)] if done else []


def _by_document(batches: Iterator[pa.RecordBatch], place: list[str]) -> Iterator[tuple[tuple, bool, int, dict]]:
    """(key, first row of its document, rows equal in key and place so far, row), in sorted order.

    Repeated rows of ``documents`` send equal pieces to the same place: they are counted, and
    only the first goes on.
    """
    last_key = last_place = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in KEY)
            at = tuple(row[c] for c in place)
            new = key != last_key
            yield key, new, (not new and at == last_place), row
            last_key, last_place = key, at


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to digests of the output (part -1) and pieces in source order."""
    out, now = _Rows(RESTORED), None

    def emit(found):
        for part, data in found:
            out.add(*now["key"], part, now["at"], data, *(None,) * 6)
            now["at"] += 1

    def finish():
        emit(now["parse"].close())
        out.add(*now["key"], -1, 0, None, *now["facts"], now["digest"].hexdigest(), now["copies"])

    for key, new, again, row in _by_document(batches, ["_at"]):
        if new:
            if now:
                finish()
            facts = (row["n"], row["form"], row["prefix_chars"], row["middle_chars"])
            now = {"key": key, "facts": facts, "digest": hashlib.sha256(), "parse": Restorer(row["form"]), "at": 0, "copies": 1}
        elif again:
            now["copies"] += row["_at"] == 0
            continue
        now["digest"].update(row["data"])
        emit(now["parse"].feed(row["data"]))
        if len(out) >= ROWS:
            yield out.batch()
    if now:
        finish()
    if len(out):
        yield out.batch()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to one row per document with its whole output."""
    out, head, parts, copies = _Rows(OUTPUT), None, [], 0
    for _, new, again, row in _by_document(batches, ["_at"]):
        if new:
            if head:
                out.extend([(head["doc_id"], head["form"], b"".join(parts).decode())] * copies)
                yield out.batch()
            head, parts, copies = row, [row["data"]], 1
        elif again:
            copies += row["_at"] == 0
        else:
            parts.append(row["data"])
    if head:
        out.extend([(head["doc_id"], head["form"], b"".join(parts).decode())] * copies)
        yield out.batch()


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in source order to one row per document."""
    out, head, digest = _Rows(RESULT), None, None

    def finish():
        row = (head["doc_id"], head["n"], head["form"], head["prefix_chars"], head["middle_chars"], head["output_sha256"], digest.hexdigest())
        for _ in range(head["copies"]):
            out.add(*row)
            if len(out) >= ROWS:
                yield out.batch()

    for _, new, _, row in _by_document(batches, ["_part", "_at"]):
        if new:
            if head:
                yield from finish()
            head, digest = row, hashlib.sha256()  # the digest's row has part -1 and comes first
        else:
            digest.update(row["data"])
    if head:
        yield from finish()
    if len(out):
        yield out.batch()


def _pieces(docs: DataFrame) -> DataFrame:
    """Output pieces, each document's in one partition and in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A repeated row is split by the task that read it, so copies of one row do not meet in one task.
    pieces = rows.withColumn("_from", F.spark_partition_id()).select("doc_id", "text", "_from").mapInArrow(_cut, PIECES)
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "_at")


def transform(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    ``docs`` has doc_id and text; other columns are not read.  A NULL text counts as empty, an
    empty text is plain; a NULL doc_id takes part with an id of no digits.  Rows that share a
    doc_id are told apart by their texts; rows that repeat both give one row each.
    """
    placed = _pieces(docs).mapInArrow(_assemble, RESTORED).sortWithinPartitions(*KEY, "_part", "_at")
    return placed.mapInArrow(_restore, RESULT)


def outputs(docs: DataFrame) -> DataFrame:
    """The transformed texts: doc_id, form, output; rows, NULLs and repeated rows as in ``transform``.

    A task holds one output at a time, which is hardly longer than its text was as a row.
    """
    return _pieces(docs).mapInArrow(_join, OUTPUT)
