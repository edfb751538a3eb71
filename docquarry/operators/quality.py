"""Quality checks and coverage of documents and sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import alnum_key, module_number, path_section_keys, section_keys, short_module


def page_coverage(pages: DataFrame, key: str = "source_document_id") -> DataFrame:
    """Per document: pages, pages with text, coverage, and whether it needs recognition (no text of over 50 characters on the first three pages)."""
    once = pages.select(key, "page_number", F.trim(F.coalesce("text", F.lit(""))).alias("t"), "id").dropDuplicates(["id"])
    return once.groupBy(key).agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("t") != "").alias("n_text"), F.bround(F.count_if(F.col("t") != "") / F.count("*"), 3).alias("coverage"), (F.coalesce(F.max(F.when(F.col("page_number") <= 3, F.length("t"))), F.lit(0)) <= 50).alias("needs_ocr")
    )


def confidence(text_share, table_share, has_pairs):
    """0.6 text + 0.3 tables (at most 1) + 0.1 key-value pairs, rounded half to even."""
    return F.bround(0.6 * text_share + 0.3 * F.least(F.lit(1.0), table_share) + 0.1 * has_pairs, 3)


def blank_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_blank, n_distinct, unique_ratio over all rows, in one pass."""
    aggs = [f for c in columns for f in (F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(f"{c}__b"), F.count_distinct(F.col(c).cast("string")).alias(f"{c}__d"))]
    one = df.agg(F.count("*").alias("n"), *aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__b").alias("n_blank"), F.col(f"{c}__d").alias("n_distinct"), F.when(F.col("n") > 0, F.round(F.col(f"{c}__d") / F.col("n"), 6)).alias("unique_ratio")) for c in columns])
    return one.select(F.inline(items))


def issues(documents: DataFrame) -> DataFrame:
    """id, severity, message of file records: one rule is one filter, and all rules share one scan.

    Warnings: no study number in the name, name and module disagree, no section; error:
    deleted before upload.
    """
    rules = [
        ("warning", "name without study number", ~F.col("file_name").rlike(r"[A-Za-z]{2}\d{2}[-_ ]?\d{7}")),
        ("warning", "no section", F.trim(F.coalesce("ctd_section", F.lit(""))) == ""),
        ("warning", "unknown module", module_number(short_module("module")).isNull()),
        ("error", "deleted before upload", F.col("deleted_at") < F.col("uploaded_at")),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, c in rules]), lambda x: x.isNotNull())
    return documents.dropDuplicates(["id"]).select("id", F.explode(hits).alias("i")).select("id", "i.severity", "i.message")


def module_coverage(documents: DataFrame) -> DataFrame:
    """module 1 to 5 with n_files, n_deleted (zeros kept) and the first five names in order."""
    once = documents.dropDuplicates(["id"]).withColumn("m", module_number(short_module("module")))
    ranked = once.groupBy("m").agg(F.count("*").alias("n_files"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"))
    names = once.where("file_name is not null").select("m", "file_name").distinct()
    from docquarry.operators.relational import top_per_key

    sample = top_per_key(names, ["m"], [F.col("file_name")], 5).groupBy("m").agg(F.array_sort(F.collect_list("file_name")).alias("sample"))
    five = documents.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("module"))
    out = five.join(ranked, F.col("module") == F.col("m"), "left").drop("m").join(sample, F.col("module") == F.col("m"), "left").drop("m")
    return out.select("module", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def section_gaps(required: DataFrame, section: str, evidence: dict[str, tuple[DataFrame, str, bool]]) -> DataFrame:
    """section, one count per kind of evidence, and missing.

    ``evidence``: name -> (rows, column, is_path): section labels meet the section and its
    descendants, paths those that mention it. Labels are counted once, then expanded to the
    sections they may meet for an equi-join.
    """
    need = required.select(section).where(F.col(section) != "").distinct()
    out = need
    for name, (df, column, is_path) in evidence.items():
        label = df.select(F.col(column).alias("__e")).where("__e is not null and __e <> ''").groupBy("__e").agg(F.count("*").alias("__n"))
        keys = path_section_keys("__e") if is_path else section_keys("__e")
        wanted = need.select(section, F.explode(F.array(F.col(section), F.concat(F.lit("#"), F.replace(section, F.lit("."), F.lit("")))) if is_path else F.array(section)).alias("__k"))
        met = label.withColumn("__k", F.explode(keys)).join(wanted, "__k").select("__e", "__n", section)
        counted = (met.distinct() if is_path else met).groupBy(section).agg(F.sum("__n").alias(f"n_{name}"))
        out = out.join(counted, section, "left").fillna(0, [f"n_{name}"])
    total = reduce(lambda a, b: a + b, [F.col(f"n_{n}") for n in evidence])
    return out.withColumn("missing", total == 0)


def same_content(df: DataFrame, key: str, text: str) -> DataFrame:
    """class_key (normalised text digest), first key and number of rows of each content held more than once."""
    norm = F.sha2(alnum_key(text), 256)
    return df.where(F.col(text).isNotNull()).groupBy(norm.alias("class_key")).agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")
