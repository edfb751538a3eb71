"""Packing pages into chunks, splitting at headings and into windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.functions.text import section_numbers, section_title, topics


def pack(pages: Iterator[tuple[int | None, str | None]], most: int, emit_empty: bool = False) -> Iterator[tuple[int | None, int | None, str]]:
    """(page_from, page_to, text) of the chunks of one document's pages in order."""
    buffer, start, page = "", None, None
    for page, text in pages:
        for para in (p.strip() for p in (text or "").split("\n\n")):
            if not para:
                continue
            if not buffer:
                start = page
            if len(buffer) + len(para) > most:
                if buffer or emit_empty:
                    yield start, page, buffer
                buffer, start = "", page
            buffer += para + "\n\n"
    if buffer:
        yield start, page, buffer


def pack_pages(pages: DataFrame, key: str = "source_document_id", most: int = 1500, emit_empty: bool = False) -> DataFrame:
    """Paragraphs (parted by blank lines) packed greedily into chunks across the pages of a document.

    A chunk is closed when the next paragraph would exceed ``most`` characters; its page_to
    is then the page of that paragraph, and the document's last page for the last chunk. An
    overlong paragraph is a chunk of its own. ``emit_empty`` also gives the empty chunk that
    closes in front of an overlong first paragraph. Pages are streamed in order, so a long
    document is never held in memory; rows without a document are left out.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pages.select(F.col(key).cast("string").alias(key), F.col("page_number").cast("int").alias("page_number"), "text").where(F.col(key).isNotNull())
    names = [key, "chunk_no", "page_from", "page_to", "raw_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for doc, own in groupby(rows, key=lambda r: r[0]):
            for no, (a, z, text) in enumerate(pack(((r[1], r[2]) for r in own), most, emit_empty), 1):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([no], pa.int32()), pa.array([a], pa.int32()), pa.array([z], pa.int32()), pa.array([text], pa.string())], names=names)

    return ordered.repartition(parts, key).sortWithinPartitions(key, "page_number").mapInArrow(run, f"`{key}` string, chunk_no int, page_from int, page_to int, raw_text string")


def annotate_chunks(chunks: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds sections (in order), section_label (the first), section_title and topics of each chunk."""
    listed = chunks.withColumn("sections", section_numbers(text)).withColumn("section_label", F.get("sections", F.lit(0)))
    return listed.withColumn("section_title", section_title(text, "section_label")).withColumn("topics", topics(text))


def split_at_headings(df: DataFrame, key: str, text: str, heading: str = r"^\s*\d+(?:\.\d+)+\s+\S") -> DataFrame:
    """key, segment_no, segment: lines from one heading to the next; blank lines are dropped."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).where("trim(line) <> ''")
    numbered = rows.withColumn("segment_no", F.sum(F.col("line").rlike(heading).cast("int")).over(W.partitionBy(key).orderBy("n")))
    first = F.min("segment_no").over(W.partitionBy(key))
    segments = numbered.withColumn("segment_no", F.col("segment_no") - first + 1).groupBy(key, "segment_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return segments.select(key, F.col("segment_no").cast("int").alias("segment_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("segment"))


def windows(text: str | None, size: int = 6000, overlap: int = 200) -> list[str]:
    """Windows of at most ``size`` characters, cut at the last blank beyond the first 200, with an overlap."""
    t = (text or "").strip()
    if not t:
        return []
    size = max(1000, size)
    out, start = [], 0
    back = max(100, min(size // 5, overlap))
    while True:
        end = min(len(t), start + size)
        if end < len(t) and (cut := t.rfind(" ", start, end)) > start + 200:
            end = cut
        if piece := t[start:end].strip():
            out.append(piece)
        if end >= len(t):
            return out
        start = end - back


def char_windows(df: DataFrame, key: str, text: str, size: int = 6000, overlap: int = 200) -> DataFrame:
    """key, window_no (from 1), window: see :func:`windows`; texts within the size are one window, blank ones none."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: windows(t, size, overlap)), "array<string>")
    return df.select(key, F.posexplode(cut(F.coalesce(F.col(text), F.lit("")))).alias("n", "window")).select(key, (F.col("n") + 1).alias("window_no"), "window")
