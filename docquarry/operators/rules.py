"""Extraction rules of templates: keywords, table cues and patterns by section, matched against texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rules held by every task at most (templates have hundreds).
MOST_RULES = 5_000


def rule_lines(df: DataFrame, section: str, position: str, text: str) -> DataFrame:
    """section, kind, term: the terms of all rules of a section, each once, in order of rule, line and place.

    A line with ``keyword`` or ``table cue`` lists terms behind its first colon (parted by
    commas or semicolons, quotes dropped); one with ``regex`` holds one pattern. Other
    lines, blank terms and null rules say nothing.
    """
    line = df.select(F.col(section).alias("section"), F.col(position).alias("__p"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("__l", "line")).withColumn("line", F.trim("line"))
    low = F.lower("line")
    kind = F.when(F.contains(low, F.lit("keyword")), "keyword").when(F.contains(low, F.lit("table cue")), "table_cue").when(F.contains(low, F.lit("regex")), "regex")
    rest = F.when(F.contains("line", F.lit(":")), F.regexp_replace("line", r"^[^:]*:", "")).otherwise("")
    listed = F.transform(F.split(F.translate(rest, ";", ","), ","), lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), '^"+|"+$', ""), "^'+|'+$", ""))
    terms = F.when(kind == "regex", F.array(F.trim(rest))).otherwise(listed)
    rows = line.select("section", kind.alias("kind"), "__p", "__l", F.posexplode(terms).alias("__i", "term")).where("kind is not null and term <> ''")
    return rows.groupBy("section", "kind", "term").agg(F.min(F.struct("__p", "__l", "__i")).alias("place"))


@dataclass(frozen=True)
class Rule:
    """One section's rules; patterns that aren't valid are left out."""

    section: str
    keywords: tuple[str, ...]
    cues: tuple[str, ...]
    patterns: tuple[str, ...]


def read_rules(df: DataFrame, section: str, position: str, text: str, most: int = MOST_RULES) -> list[Rule]:
    """The rules of a template as objects; their number is checked."""
    lists = rule_lines(df, section, position, text).groupBy("section", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    rows = lists.groupBy("section").pivot("kind", ["keyword", "table_cue", "regex"]).agg(F.first("terms")).orderBy("section").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sections with rules")

    def valid(pattern: str) -> bool:
        try:
            re.compile(pattern, re.I)
        except re.error:
            return False
        return True

    return [Rule(r["section"], tuple(r["keyword"] or ()), tuple(r["table_cue"] or ()), tuple(p for p in r["regex"] or () if valid(p))) for r in rows]


def rule_hits(df: DataFrame, key: str, texts: Column, rules: list[Rule], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """key, section, keywords, table_cues, regex: every rule with a hit in a text (keywords and cues as parts of the lower-case text, patterns ignoring case).

    ``prefixes`` keeps the sections that begin with one of them. Null and blank texts hit nothing. One pass over the texts.
    """
    used = [(r, [(k, k.lower()) for k in r.keywords], [(c, c.lower()) for c in r.cues], [(p, re.compile(p, re.I)) for p in r.patterns]) for r in rules if not prefixes or r.section.startswith(prefixes)]
    words = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("section", T.StringType()), *[T.StructField(n, words) for n in ("keywords", "table_cues", "regex")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[], [], [], []]
            for i, value in enumerate(batch.column(1).to_pylist()):
                if not value or not value.strip():
                    continue
                low = value.lower()
                for rule, keywords, cues, patterns in used:
                    found = [k for k, x in keywords if x in low], [c for c, x in cues if x in low], [p for p, rx in patterns if rx.search(value)]
                    if any(found):
                        at.append(i)
                        for column, item in zip(out, (rule.section, *found), strict=True):
                            column.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, f.type) for c, f in zip(out, list(arrow)[1:], strict=True)]], schema=arrow)

    return df.select(F.col(key), texts.alias("__t")).mapInArrow(run, schema)


def kept_by_rules(df: DataFrame, key: str, texts: Column, rules: list[Rule]) -> DataFrame:
    """Rows that any rule hits; all rows where there are no rules."""
    return df.join(rule_hits(df, key, texts, rules).select(key).distinct(), key, "left_semi") if rules else df
