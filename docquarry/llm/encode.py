"""Encoding texts with a public tokenizer (byte-level BPE by tiktoken)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default folder of the vocabulary files; every caller may pass another.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts longer than this are cut at safe boundaries before encoding.
LONG = 100_000

#: A blank after a visible character and before a visible one always begins a new
#: piece of PATTERN (no alternative holds a blank after a visible character, and
#: the look-ahead of white space can't reach back over one), so a cut there never
#: changes the ids.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tiktoken encoding of the rank file ``folder/name.tiktoken`` (once per process)."""
    import tiktoken

    ranks = {}
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            ranks[base64.b64decode(piece)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = LONG) -> Iterator[str]:
    """Cut ``text`` into stretches of about ``size`` characters at safe boundaries.

    A stretch without any safe boundary stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[int]:
    """Ids of one text; null and empty texts give the empty list. Special tokens are ordinary text."""
    if not text:
        return []
    coder = encoding(name, folder)
    if len(text) <= LONG:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text):
        ids.extend(coder.encode_ordinary(part))
    return ids


def decode_ids(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The raw bytes of ``ids``; ids may end inside a character, so bytes, not text."""
    return encoding(name, folder).decode_bytes(ids)


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, count_only: bool = False) -> DataFrame:
    """One row per input row: ``key`` and ``ids`` (array<int>), or ``n_tokens`` with ``count_only``.

    Null and empty texts give an empty list (0 tokens); white space alone is encoded
    as it stands. Repeated rows are each encoded. Other columns are dropped. A single
    pass without shuffle: Arrow batches in, Arrow lists out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.int64() if count_only else pa.list_(pa.int32())
        for batch in batches:
            ids, size = [], 0
            keys = batch.column(0)
            at = 0
            for i, value in enumerate(batch.column(1)):
                one = encode_text(value.as_py(), name, folder)
                ids.append(len(one) if count_only else one)
                size += len(one)
                if size > 4_000_000 and not count_only:  # bounds memory where texts are long
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), pa.array(ids, out_type)], names=[key, "ids"])
                    ids, size, at = [], 0, i + 1
            if len(keys) > at:
                yield pa.RecordBatch.from_arrays([keys.slice(at), pa.array(ids, out_type)], names=[key, "n_tokens" if count_only else "ids"])

    out = f"`{key}` {kind}, " + ("n_tokens bigint" if count_only else "ids array<int>")
    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, out)


def decode(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``bytes`` (binary): the raw bytes of each list of ids; null lists give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else decode_ids(v, name, folder) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "bytes"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, bytes binary")
