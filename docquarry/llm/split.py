"""Cutting oversized texts into overlapping pieces at natural boundaries.

Every position of a text has a boundary strength. A sparse table over the strengths
answers range-maximum queries, so each cut is the strongest boundary of its permissible
window, the rightmost one among equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_500, 100

#: Characters for which one sparse table is built at a time.
BLOCK = 200_000

#: Strengths of a cut before a position, from none to a paragraph's end.
NONE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+\s*")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"(?<=[.!?])[)\]\"'”’»]*\s+(?=\S)|[。！？]+(?=\S)")
_CLAUSE = re.compile(r"[;:,]\s+(?=\S)|[、，；：](?=\S)")
_SPACE = re.compile(r"\s+(?=\S)")
_RUN = re.compile(r"[^\W_]+")


def strengths(text: str) -> np.ndarray:
    """Boundary strength of a cut before each character (int8)."""
    s = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in ((WORD, _SPACE), (CLAUSE, _CLAUSE), (SENTENCE, _SENTENCE), (LINE, _LINE), (PARAGRAPH, _PARAGRAPH)):
        ends = [m.end() for m in pattern.finditer(text)]
        if ends:
            s[ends] = strength
    return s[: len(text)]


class RangeMaximum:
    """Sparse table: the rightmost maximum of any range in constant time, after n log n work."""

    def __init__(self, values: np.ndarray, widest: int | None = None):
        n = len(values)
        # ties break rightward: the key of a position grows with the position
        key = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [key]
        width = 1
        while 2 * width <= min(n, widest or n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """Position and value of the rightmost maximum within ``low``..``high`` inclusive."""
        level = (high - low + 1).bit_length() - 1
        best = int(max(self.levels[level][low], self.levels[level][high - (1 << level) + 1]))
        return best % (self.n + 1), best // (self.n + 1)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of the pieces of ``text``, each at most ``limit`` characters.

    Each cut is the strongest boundary of the permissible window (the second half of
    the limit, so that pieces aren't tiny; where that has no boundary, all that is longer
    than the overlap), rightmost among equals; without any boundary the piece is cut hard
    at the limit. The next piece begins ``overlap``
    characters before the cut. A text within the limit is one piece; the empty text none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)] if n else []
    strength = strengths(text)
    out, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit >= base + table.n:  # a table for each stretch bounds memory
            base, table = start, RangeMaximum(strength[start : start + max(BLOCK, limit + 1)], limit + 1)
        low, high = start - base + max(overlap + 1, limit // 2), start - base + limit
        at, s = table.query(low, high)
        if s == NONE:
            at, s = table.query(start - base + overlap + 1, high)
        at += base
        if s == NONE:
            at = start + limit
        out.append((start, at, s))
        start = at - overlap
    out.append((start, n, PARAGRAPH))
    return out


def cut_level(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """``hard`` where a run of letters and digits exceeds the limit, ``paragraph`` where every paragraph keeps it, else ``within``.

    The cuts of :func:`pieces` decide where they can: a run over the limit forces a cut
    without any boundary, and cuts at paragraphs alone leave every paragraph whole within
    a piece. The definition decides the rest. Paragraphs are the stretches between
    boundaries of the greatest strength, without outer white space.
    """
    cuts = {s for _, _, s in pieces(text, limit, overlap)[:-1]}
    if NONE in cuts and any(m.end() - m.start() > limit for m in _RUN.finditer(text)):
        return "hard"
    if cuts <= {PARAGRAPH}:
        return "paragraph"
    ends = np.flatnonzero(strengths(text) == PARAGRAPH).tolist()
    parts = [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]
    return "paragraph" if all(len(p) <= limit for p in parts) else "within"


def _long(df: DataFrame, text: str, limit: int) -> DataFrame:
    return df.where(F.length(F.col(text)) > limit)


def split(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, chunk_id: str = "id", text: str = "raw_text", offset: str = "offset_start", label: str = "section_label") -> DataFrame:
    """Pieces of all texts longer than ``limit`` characters.

    Columns: chunk_id, piece_no (from 1), start and end within the text, offset_start,
    offset_end (of the document; within the text itself, with offset_known false, where
    the chunk has no offset), section_label, cut_strength, piece. A record counts once
    per id; null and short texts have no pieces. Offsets follow from offset_start alone,
    so an offset_end that doesn't fit the text does no harm.
    """
    long = _long(df, text, limit).select(F.col(chunk_id).cast("string").alias("chunk_id"), F.col(offset).cast("bigint").alias("base"), F.col(label).cast("string").alias("section_label"), F.col(text).alias("text")).dropDuplicates(["chunk_id"])

    schema = pa.schema([("chunk_id", pa.string()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("offset_start", pa.int64()), ("offset_end", pa.int64()), ("offset_known", pa.bool_()), ("section_label", pa.string()), ("cut_strength", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for r in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, base, section, value = (x.as_py() for x in r)
                for no, (a, b, s) in enumerate(pieces(value, limit, overlap), 1):
                    rows.append((key, no, a, b, (base or 0) + a, (base or 0) + b, base is not None, section, s, value[a:b]))
                    size += b - a
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return long.mapInArrow(run, "chunk_id string, piece_no int, start bigint, end bigint, offset_start bigint, offset_end bigint, offset_known boolean, section_label string, cut_strength int, piece string")


def cut_levels(df: DataFrame, limit: int = LIMIT, chunk_id: str = "id", text: str = "raw_text") -> DataFrame:
    """chunk_id and cut_level of the texts longer than ``limit`` characters, once per id."""
    long = _long(df, text, limit).select(F.col(chunk_id).cast("string").alias("chunk_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [cut_level(t.as_py(), limit) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.string())], names=["chunk_id", "cut_level"])

    return long.mapInArrow(run, "chunk_id string, cut_level string").dropDuplicates(["chunk_id"])
