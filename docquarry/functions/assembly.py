"""Assembling texts and lists: keywords, embedding texts, anchors, coerced fields, cut prompts, required fields."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import _c, blank_to_null, let, ordered_distinct
from docquarry.sources.readers import required_fields


def listed(c: Column | str) -> Column:
    """Comma-separated text as trimmed items without blanks; null gives the empty list."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def keywords(items: Column, most: int, nothing: tuple[str, ...] = ("n/a", "none", "null")) -> Column:
    """The first ``most`` keywords, trimmed, distinct but for case; blanks and words for nothing dropped."""
    plain = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*nothing))
    return F.slice(ordered_distinct(plain), 1, most)


def padded_keywords(items: Column, candidates: Column, least: int, most: int) -> Column:
    """Keywords filled up from candidates to at least ``least`` where there are fewer, and ``most`` at most."""
    own = keywords(items, most)
    return let(own, lambda k: F.when(F.size(k) >= least, k).otherwise(F.slice(ordered_distinct(F.concat(k, keywords(candidates, 2**31 - 1))), 1, least)))


def title_words(c: Column | str, most: int) -> Column:
    """Lower-case words of a title (parted by blanks and slashes) of three characters or more with a letter."""
    words = F.transform(F.split(F.translate(F.coalesce(_c(c), F.lit("")), "/", " "), r"\s+"), lambda w: F.regexp_replace(w, r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", ""))
    return F.slice(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}")), lambda w: F.lower(w)), 1, most)


def embedding_text(name: Column, labelled: list[tuple[str, Column]], summary: Column, body: Column, most: int = 9_000) -> Column:
    """The text to embed: document, labelled fields that aren't blank, summary, body; parted by blank lines and cut."""
    fields = [F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{label}: "), c)) for label, c in labelled]
    said = F.when(blank_to_null(summary).isNotNull(), F.concat(F.lit("Summary:\n"), summary))
    return F.substring(F.regexp_replace(F.concat_ws("\n\n", F.concat(F.lit("Document: "), name), *fields, said, F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")), r"\s+$", ""), 1, most)


def with_anchors(markdown: Column, topics: Column) -> Column:
    """Markdown behind a list of its topics (structs title, anchor), each anchor set before the first mention of its title, or at the end."""
    lines = F.transform(topics, lambda t: F.concat(F.lit("- ["), t["title"], F.lit("](#"), t["anchor"], F.lit(")")))
    head = F.concat(F.lit("## Key Topics\n"), F.array_join(lines, "\n"), F.lit("\n\n"))

    def anchored(text: Column, t: Column) -> Column:
        tag = F.concat(F.lit('<a id="'), t["anchor"], F.lit('"></a>'))
        at = F.instr(F.lower(text), F.lower(t["title"]))
        placed = F.concat(F.substring(text, F.lit(1), at - 1), tag, F.substring(text, at, F.length(text)))
        return F.when(F.contains(text, tag), text).when(at > 0, placed).otherwise(F.concat(text, F.lit("\n\n"), tag, F.lit("\n")))

    return F.when(F.size(topics) > 0, F.aggregate(topics, F.concat(head, markdown), anchored)).otherwise(markdown)


def coerced(c: Column | str) -> Column:
    """A JSON value as text: lists joined by ", ", objects by their value or text, blanks null."""
    t = F.ltrim(_c(c))
    items = F.filter(F.transform(F.from_json(F.when(t.startswith("["), t), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    inner = F.coalesce(F.nullif(F.get_json_object(F.when(t.startswith("{"), t), "$.value"), F.lit("")), F.get_json_object(F.when(t.startswith("{"), t), "$.text"))
    return blank_to_null(F.when(t.startswith("["), F.nullif(F.array_join(items, ", "), F.lit(""))).when(t.startswith("{"), inner).otherwise(_c(c)))


#: Shares kept at each attempt, and the least length.
SHARES, LEAST = (0.8, 0.6, 0.45), 600


def cut_prompt(c: Column | str, attempt: int) -> Column:
    """A prompt cut to its share at an attempt, with a note on what is left out; null where nothing can be cut."""
    if attempt >= len(SHARES):
        return F.lit(None).cast("string")
    t = _c(c)
    target = F.greatest(F.lit(LEAST), F.floor(F.length(t) * SHARES[attempt]).cast("int"))
    note = F.concat(F.lit("\n\n[TRUNCATED FOR CONTEXT LIMIT: "), (F.length(t) - target).cast("string"), F.lit(" trailing characters omitted.]"))
    return F.when(target < F.length(t), F.concat(F.regexp_replace(F.substring(t, F.lit(1), F.greatest(F.lit(0), target - F.length(note))), r"\s+$", ""), note))


def most_specific(numbers: Column) -> Column:
    """The section number with most dots, then the longest, then the first; null for none."""
    ranked = F.transform(numbers, lambda x, i: F.struct((F.length(F.replace(x, F.lit("."), F.lit(""))) - F.length(x)).alias("a"), (-F.length(x)).alias("b"), i.alias("c"), x.alias("x")))
    return F.get(F.array_sort(ranked), F.lit(0))["x"]


def accepted_spans(given: Column, found: Column) -> Column:
    """Spans (structs start, end) of a payload if any of them isn't empty, else those found."""
    return F.when(F.exists(F.coalesce(given, F.array().cast("array<struct<start:int,end:int>>")), lambda s: s["end"] > s["start"]), given).otherwise(found)


def with_required_fields(df: DataFrame, entry: str, out: str = "required") -> DataFrame:
    """Adds the required fields of a nested requirement in JSON (any depth); empty for null and anything that isn't an object."""
    kept = df.drop(out)

    def read(text: str | None) -> list[str]:
        try:
            value = json.loads(text or "")
        except ValueError:
            return []
        return required_fields(value) if isinstance(value, dict) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read(t) for t in batch.column(entry).to_pylist()], pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))
