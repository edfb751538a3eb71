"""Sections, pages and spans of markdown documents; section families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import checkpointed
from docquarry.functions.text import section_ancestors


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), offset (characters before the line) and line of every line; null texts have none."""
    split = df.select(F.col(key), F.split(F.col(text), "\n").alias("__l")).where("__l is not null")
    starts = F.aggregate(F.col("__l"), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    return split.withColumn("__s", starts).select(key, F.posexplode(F.arrays_zip(F.col("__l"), F.slice("__s", F.lit(1), F.size("__l")))).alias("line_no", "z")).select(key, "line_no", F.col("z")["1"].alias("offset"), F.col("z")["__l"].alias("line"))


_NUMBERED = r"^\s{0,6}(?:(?:Section|SECTION|Sec\.?)\s*)?(\d+(?:\.\d+){1,3}(?:-[A-Za-z0-9]+)?)(.*)$"


def section_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_number, section_title, offset: lines that begin with a dotted number, the first one of each number.

    Headings of markdown, table rows and lines of a table of contents (dot leaders with a
    page) are no markers, nor are numbers followed by something without letters.
    """
    numbered = lines(df, key, text).where(F.col("line").rlike(_NUMBERED) & ~F.ltrim("line").startswith("#") & ~F.ltrim("line").startswith("|") & ~F.col("line").rlike(r"\.{2,}\s*\d+\s*$"))
    tail = F.regexp_extract("line", _NUMBERED, 2)
    title = F.trim(F.regexp_replace(F.regexp_replace(tail, r"^[\s\-:).]+", ""), r"\s{2,}", " "))
    found = numbered.select(key, F.regexp_extract("line", _NUMBERED, 1).alias("section_number"), F.when(title.rlike("(?U)\\p{L}"), F.substring(title, 1, 200)).alias("section_title"), tail.alias("tail"), "offset")
    kept = found.where(F.col("section_title").isNotNull() | ~F.col("tail").rlike("(?U)[\\p{L}\\d]"))
    return kept.withColumn("__n", F.row_number().over(W.partitionBy(key, "section_number").orderBy("offset"))).where("__n = 1").drop("__n", "tail")


def page_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, offset of ``## Page n`` and ``<!-- Page n -->`` lines."""
    rx = r"^(?:##\s+Page\s+(\d+)\b|<!--\s*Page\s+(\d+)\s*-->)"
    page = F.coalesce(*[F.nullif(F.regexp_extract("line", rx, i), F.lit("")) for i in (1, 2)]).cast("int")
    return lines(df, key, text).where(F.col("line").rlike(rx)).select(key, page.alias("page"), "offset")


def as_of(events: DataFrame, markers: DataFrame, key: str, at: str, marker_at: str, value: str, out: str) -> DataFrame:
    """For each event the value of the last marker at or before it; null without one. No join: one sort per key."""
    e = events.withColumn("__m", F.lit(1)).withColumn("__v", F.lit(None).cast(markers.schema[value].dataType)).withColumn("__at", F.col(at))
    m = markers.select(key, F.col(value).alias("__v"), F.col(marker_at).alias("__at")).withColumn("__m", F.lit(0))
    both = e.unionByName(m, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("__at", "__m")
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__m = 1").drop("__m", "__v", "__at")


def section_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_number, section_title, char_start, char_end (of the next marker, or the text's length), page_start, page_end."""
    markers = section_markers(df, key, text).join(df.select(key, F.length(text).alias("__len")), key)
    spans = markers.withColumn("char_end", F.lead("offset", 1).over(W.partitionBy(key).orderBy("offset"))).select(key, "section_number", "section_title", F.col("offset").alias("char_start"), F.coalesce("char_end", "__len").alias("char_end"))
    pages = page_markers(df, key, text)
    first = as_of(spans, pages, key, "char_start", "offset", "page", "page_start")
    last = first.withColumn("__end", F.greatest("char_start", F.col("char_end") - 1))
    return as_of(last, pages, key, "__end", "offset", "page", "page_end").drop("__end")


def family_join(left: DataFrame, section: str, families: DataFrame, family: str) -> DataFrame:
    """Rows of ``left`` with every family that their section belongs to (itself or an ancestor).

    An equi-join on exploded ancestors instead of a prefix comparison of all pairs.
    """
    up = left.withColumn("__a", F.explode(section_ancestors(F.col(section))))
    return up.join(families.select(F.col(family).alias("__a"), F.col(family).alias(f"{family}_family")).distinct(), "__a").drop("__a")


def tree_paths(nodes: DataFrame, key: str, parent: str, most: int = 1_000) -> DataFrame:
    """key, root, depth, path of a self-referencing tree, level by level; cycles and orphans are not reached. A tree deeper than ``most`` is an error."""
    level = nodes.where(F.col(parent).isNull()).select(F.col(key), F.col(key).alias("root"), F.lit(0).alias("depth"), F.array(F.col(key)).alias("path"))
    out = level
    for _ in range(most):
        up = level.select(F.col(key).alias("__p"), "root", "depth", "path")
        level = nodes.join(up, F.col(parent) == F.col("__p")).select(F.col(key), "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.col(key))).alias("path"))
        level = checkpointed(level)  # else each level computes all before it again
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {most} levels")
