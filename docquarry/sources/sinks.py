"""Sinks: tables with unique names, documents as markdown, reports, key-value chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.tables import unique_names


def as_text(df: DataFrame) -> DataFrame:
    """All cells as text, nulls as '', column names made unique."""
    named = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return named.select(*[F.coalesce(F.col(f"__{i}").cast("string"), F.lit("")).alias(n) for i, n in enumerate(unique_names(df.columns))])


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Writes ``path``/csv and ``path``/json; returns the manifest: path, columns, n_rows and the first ten rows as JSON."""
    text = as_text(df)
    text.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    text.write.mode("overwrite").json(f"{path}/json")
    saved = df.sparkSession.read.schema(text.schema).json(f"{path}/json")
    preview = [r["r"] for r in saved.limit(10).select(F.to_json(F.struct("*")).alias("r")).collect()]
    shown = F.array(*[F.lit(x) for x in preview]).cast("array<string>")
    return saved.agg(F.count("*").alias("n_rows")).select(F.lit(path).alias("path"), F.array(*[F.lit(c) for c in text.columns]).alias("columns"), "n_rows", shown.alias("preview"))


def markdown_documents(pages: DataFrame, key: str, tables: DataFrame | None = None) -> DataFrame:
    """key, markdown: pages in order with ``## Page n`` heads, their text (or a placeholder), then their tables (key, page_number, at, markdown).

    Pages of one document come together in one row, as the document does.
    """
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("_No extractable text._"))
    rows = pages.select(key, F.col("page_number").cast("int").alias("page_number"), F.lit(0).alias("at"), F.concat(F.lit("## Page "), F.col("page_number").cast("string"), F.lit("\n\n"), text).alias("part"))
    if tables is not None:
        rows = rows.unionByName(tables.select(key, F.col("page_number").cast("int").alias("page_number"), (F.col("at") + 1).cast("int").alias("at"), F.col("markdown").alias("part")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "at", "part"))), lambda x: x["part"])
    return rows.groupBy(key).agg(F.array_join(parts, "\n\n").alias("markdown"))


def sidecars(df: DataFrame, key: str, text: str, path: str) -> None:
    """One JSON record per key under ``path``, partitioned by a digest of the key."""
    df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(64)).alias("part")).write.mode("overwrite").partitionBy("part").json(path)


def chunk_fields(chunks: DataFrame, key: str, index: str) -> DataFrame:
    """key, field (chunk:00001), value (JSON) for a key-value store."""
    rest = [c for c in chunks.columns if c != key]
    return chunks.select(key, F.concat(F.lit("chunk:"), F.lpad(F.col(index).cast("string"), 5, "0")).alias("field"), F.to_json(F.struct(*rest)).alias("value"))


def run_report(log: DataFrame, stage: str = "stage", status: str = "status", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Counts per stage (processed, failed, skipped), and counts of errors by the text before the first colon."""
    counts = log.groupBy(stage).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("processed", "failed", "skipped")])
    errors = log.where(F.col(error).isNotNull()).groupBy(F.trim(F.substring_index(error, ":", 1)).alias("error")).agg(F.count("*").alias("n"))
    return counts, errors


def commented_documents(pages: DataFrame, key: str) -> DataFrame:
    """key, markdown: pages in order behind ``<!-- Page n -->`` comments; null texts are empty pages."""
    rows = pages.select(key, F.col("page_number").cast("int").alias("n"), F.concat(F.lit("<!-- Page "), F.col("page_number").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit(""))).alias("part"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def asset_rows(df: DataFrame, keys: list[str], tables: str, kind: str = "table", preview: int = 10) -> DataFrame:
    """keys, kind, index_on_page (from 1), columns, row_count, preview (first rows) and caption (single blanks) of each element of an array of tables; null arrays have none."""
    rows = df.select(*keys, F.posexplode(tables).alias("__i", "t"))
    caption = F.trim(F.regexp_replace(F.coalesce("t.caption", F.lit("")), r"\s+", " "))
    return rows.select(*keys, F.lit(kind).alias("kind"), (F.col("__i") + 1).alias("index_on_page"), F.col("t.columns").alias("columns"), F.size("t.rows").alias("row_count"), F.slice("t.rows", 1, preview).alias("preview"), caption.alias("caption"))
