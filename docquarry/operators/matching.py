"""Matching of texts, columns and sections: fuzzy choice, schema similarity, overrides, field presence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from docquarry.cluster import stored
from docquarry.functions.fuzzy import Labels, Titles, partial_ratio
from docquarry.functions.text import squeeze, study_ids
from docquarry.operators.relational import top_per_key

# Header names with one meaning, after lower case and without punctuation, and their beginnings.
HEADERS = {
    "doses": ["dose", "dose level", "dose levels", "dose mg kg", "doses mg kg", "dosage"],
    "dose concentration": ["dose concentration", "concentration"],
    "method of administration": ["route of administration", "route", "administration route", "method of admin", "method of administrationistration", "method of admin istration"],
    "endpoints assays": ["endpoint", "endpoints", "assay", "assays", "endpoint assay", "endpoint assays", "endpoints assay", "endpoints assays"],
    "study number": ["study id", "study no", "study number no", "report study no", "report study number", "report number"],
    "species strain or test system": ["species strain or test system", "species strain or test system or species"],
    "organ systems evaluated": ["organ system", "organ systems", "systems evaluated", "system evaluated", "organ systems assessed", "target organ", "target organs", "safety pharmacology domain", "organ systems evaluated"],
    "glp compliance": ["glp", "glp status", "glp statement", "qa statement", "compliance with glp"],
    "gender": ["sex"],
    "gender and no per group": ["gender and no per group", "sex and no per group"],
    "noteworthy findings": ["noteworthy findings", "key findings", "key results", "findings", "observations", "conclusion", "conclusions", "result summary"],
}
HEADER_BEGINNINGS = [("doses", r"^doses? "), ("organ systems evaluated", r"^organ system|\borgan\b.*\bsystem")]
#: Words that say nothing about a required field.
STOP_WORDS = ("the", "and", "of", "for", "to", "in", "a", "an", "or", "with", "by", "on", "required")


def header_token(c: Column) -> Column:
    """A table header in its canonical form: by its whole name, else by how it begins."""
    bare = squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = reduce(lambda out, kv: out.when(bare.isin(*kv[1]), kv[0]), HEADERS.items(), F)
    return reduce(lambda out, kv: out.when(bare.rlike(kv[1]), kv[0]), HEADER_BEGINNINGS, names).otherwise(bare)


def _few(df: DataFrame, most: int, what: str) -> list[tuple]:
    """The rows of a template or list of labels, whose number is checked while it is read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}; block them first")
    return sorted(map(tuple, rows))


def _per_text(df: DataFrame, key: str, text: Column, schema: str, found: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """key and the rows that ``found`` gives for each text, in one pass without pairs or joins; null texts have none."""
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for row in found(value) if value is not None else ():
                    at.append(i), rows.append(row)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * (len(arrow) - 1), list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], schema=arrow)

    return df.select(F.col(key), text.alias("__t")).mapInArrow(run, out)


def _distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """The distinct texts as ``__x``, in even partitions of an explicit number, as coalesced ones would leave the comparison to a single task."""
    return df.select(F.col(text).alias("__x")).where("__x is not null").distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Labels of one shard: a list within it is sent to every task, a longer one is cut into shards.
SHARD = 50_000


def best_by_labels(df: DataFrame, key: str, text: str, candidates: DataFrame, candidate: str, labels: str, least: float = 70.0, shard: int | None = None) -> DataFrame:
    """key, candidate, score: the id named in the text (101), else the candidate with the best token set ratio of a label (at least ``least``), else the first id parsed (-1).

    ``candidates``: any number of ids with arrays of labels. Exact hits and parsed ids are Spark's work; only texts
    without a hit are compared, each distinct one once. Up to ``shard`` (SHARD) labels are held by every task; a longer
    list is cut into shards, which texts meet all, and the best of the shards' winners counts, so the result is the same.
    """
    shard = shard or SHARD
    flat = candidates.select(F.col(candidate).alias("__c"), F.explode(F.concat(F.array(F.col(candidate)), F.coalesce(F.col(labels), F.array().cast("array<string>")))).alias("__l")).where("__c is not null and __l is not null")
    known = flat.select(F.upper("__c").alias("__id"), "__c").distinct()
    named = df.select(F.col(key), F.col(text).alias("__t"), study_ids(text).alias("__ids"))
    exact = named.select(key, F.explode("__ids").alias("__id")).join(known, "__id").groupBy(key).agg(F.min("__c").alias("candidate")).withColumn("score", F.lit(101.0))
    open_ = named.join(exact.select(key), key, "left_anti")
    distinct = flat.groupBy("__l").agg(F.min("__c").alias("__c"))
    listed = [(r["__c"], r["__l"]) for r in distinct.limit(shard + 1).collect()]
    if len(listed) > shard:
        open_ = stored(open_, "open_texts")
        fuzzy = _nearest_in_shards(open_.select(F.col("__t").alias("__x")).where("__x is not null").distinct(), distinct, shard, least)
    else:
        built: list[Labels] = []

        def nearest(value: str) -> Iterable[tuple]:
            if not built:  # once per task, if there is a text
                built.append(Labels(listed))
            won = built[0].best(value, least)
            return [won] if won else []

        fuzzy = _per_text(_distinct_texts(open_, "__t"), "__x", F.col("__x"), "__c string, __s double", nearest)
    # a parsed id counts where no text of its key has a label
    rest = open_.join(fuzzy, F.col("__t") == F.col("__x"), "left").withColumn("__hit", F.max("__s").over(W.partitionBy(key)))
    rest = rest.where("__s is not null or (__hit is null and size(__ids) > 0)").select(key, F.coalesce("__c", F.get("__ids", F.lit(0))).alias("candidate"), F.coalesce("__s", F.lit(-1.0)).alias("score"))
    return exact.unionByName(rest)


def _nearest_in_shards(texts: DataFrame, labels: DataFrame, shard: int, least: float) -> DataFrame:
    """__x, __c, __s: the best candidate of each text that has one, for a list of labels in shards.

    Labels of a shard come first in its group and are indexed; texts stream behind. Without texts no label is copied.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, shards = min(parts, texts.count()), -(-labels.count() // shard)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"))
    left = texts.select(F.pmod(F.hash("__x"), F.lit(slices)).alias("slice"), copies(shards).alias("shard"), F.lit(None).cast("string").alias("__c"), F.col("__x").alias("t"))
    right = labels.select(copies(slices).alias("slice"), F.pmod(F.hash("__l"), F.lit(shards)).alias("shard"), "__c", F.col("__l").alias("t"))
    rows = right.unionByName(left).repartition(parts, "slice", "shard").sortWithinPartitions("slice", "shard", F.col("__c").isNull())
    schema = T.StructType.fromDDL("__x string, __c string, __s double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, listed, index = None, [], None
        for batch in batches:
            out = []
            for *here, c, t in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if here != group:
                    group, listed, index = here, [], None
                if c is not None:
                    listed.append((c, t))
                    continue
                if index is None:
                    index = Labels(listed)
                if won := index.best(t, least):
                    out.append((t, *won))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, arrow, strict=True)], schema=arrow)

    won = rows.mapInArrow(run, schema)
    best = won.groupBy("__x").agg(F.min_by(F.struct("__c", "__s"), F.struct((-F.col("__s")).alias("a"), F.col("__c").alias("b"))).alias("w"))
    return best.select("__x", "w.__c", "w.__s")


#: Characters of a text compared with titles, as the reference sets it; null compares whole texts.
COMPARED = 8_000


def similar_sections(df: DataFrame, key: str, text: str, sections: DataFrame, number: str, title: str, n: int = 5, cut: int | None = COMPARED, most: int = 2_000) -> DataFrame:
    """key, number, score, rank: the ``n`` template sections most similar to a text by partial ratio of title, or number and title (0 to 1), ties by number.

    ``cut`` None compares whole texts. Distinct texts are compared once and joined back.
    """
    few = [(num, (t or "").lower(), f"{num} {t or ''}".strip().lower()) for num, t in _few(sections.select(number, title).where(F.col(number).isNotNull()), most, "sections")]

    titles = Titles([x for _, t, blob in few for x in (t, blob)])

    def scored(value: str) -> Iterable[tuple]:
        if not value.strip():
            return []
        found = titles.partial_ratios(value.lower()[:cut])
        ranked = sorted((-max(a, b), num) for (num, _, _), a, b in zip(few, found[::2], found[1::2], strict=True))
        return [(num, round(-s / 100, 3), i) for i, (s, num) in enumerate(ranked[:n], 1)]

    alike = _per_text(_distinct_texts(df, text), "__x", F.col("__x"), "number string, score double, rank int", scored)
    return df.select(key, F.col(text).alias("__x")).join(alike, "__x").select(key, "number", "score", "rank")


def section_in_text(df: DataFrame, key: str, text: str, sections: DataFrame, number: str, position: str) -> DataFrame:
    """key, number, confidence 0.98: the first section (in template order) whose dotted number occurs as a word (an equi-join on the numbers of the text)."""
    few = sections.where(F.contains(F.col(number), F.lit("."))).select(F.col(number).alias("number"), F.col(position).alias("__p"))
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\w.])\d+(?:\.\d+)+(?![\w])"), F.lit(0)))).alias("number"))
    return top_per_key(found.join(few, "number"), [key], [F.col("__p")]).select(key, "number", F.lit(0.98).alias("confidence"))


def section_of_name(df: DataFrame, key: str, name: str, sections: DataFrame, number: str, most: int = 10_000) -> DataFrame:
    """key, number, confidence of the most specific dotted number in a name: 0.99 for a section of the template, else by its nearest number and its depth (at most 0.95)."""
    known = sorted({r[0] for r in _few(sections.select(number).where(F.col(number).isNotNull()), most, "sections")})
    exact = frozenset(known)

    def guess(value: str) -> Iterable[tuple]:
        found = re.findall(r"\b\d+(?:\.\d+)+\b", value, re.ASCII)
        if not found:
            return []
        best = max(found, key=lambda s: (s.count("."), len(s)))
        if best in exact:
            return [(best, 0.99)]
        near = max((partial_ratio(best, s) / 100 for s in known), default=0.0)
        return [(best, round(min(0.95, max(near, 0.5) + min(0.2, 0.05 * best.count("."))), 3))]

    return _per_text(df, key, F.col(name), "number string, confidence double", guess)


def classified(df: DataFrame, key: str, name: str, text: str, sections: DataFrame, number: str, title: str, position: str) -> DataFrame:
    """key, number, confidence, method: the section by file name, else by a number in the text, else by similarity of titles. Each step sees only what the one before left open."""
    by_name = section_of_name(df, key, name, sections, number).withColumn("method", F.lit("filename"))
    open_ = df.join(by_name.select(key), key, "left_anti")
    by_number = section_in_text(open_, key, text, sections, number, position).withColumn("method", F.lit("regex"))
    rest = open_.join(by_number.select(key), key, "left_anti")
    alike = similar_sections(rest, key, text, sections, number, title, 1).select(key, "number", F.col("score").alias("confidence"), F.lit("heuristic").alias("method"))
    return by_name.unionByName(by_number).unionByName(alike)


def chosen_family(first: Column, second: Column) -> Column:
    """Which of two classifications (structs number, confidence) counts: the second unless it is null, of module 2, or without a module less certain."""
    module = F.regexp_extract(second["number"], r"^(\d+)", 1)
    return F.when(second.isNull(), first).when(first.isNull(), second).when((module != "") & (module != "2"), second).when(module == "2", first).when(second["confidence"] > first["confidence"], second).otherwise(first)


def realign(tables: DataFrame, key: str, subsection: str, columns: str, specs: DataFrame, spec: str, spec_columns: str) -> DataFrame:
    """key, subsection, moved: a table goes to the specification that shares most of its columns.

    Share = common columns over the specification's; a move needs 0.6, and 0.75 or 0.15 more than where it stands, whichever is more.
    """
    t = tables.select(F.col(key).alias("k"), F.col(subsection).alias("now"), F.explode(F.array_distinct(F.transform(F.col(columns), header_token))).alias("c"))
    s = specs.select(F.col(spec).alias("spec"), F.array_distinct(F.transform(F.col(spec_columns), header_token)).alias("cs")).select("spec", F.size("cs").alias("n"), F.explode("cs").alias("c"))
    shares = t.join(s, "c").groupBy("k", "now", "spec").agg((F.count("*") / F.first("n")).alias("share"))
    best = top_per_key(shares, ["k"], [F.desc("share"), F.col("spec")])
    here = shares.where("spec = now").select("k", F.col("share").alias("current"))
    base = tables.select(F.col(key).alias("k"), F.col(subsection).alias("old"))
    joined = base.join(best.select("k", "spec", "share"), "k", "left").join(here, "k", "left").fillna(0.0, ["share", "current"])
    move = (F.col("spec") != F.col("old")) & (F.col("share") >= 0.6) & (F.col("share") >= F.greatest(F.col("current") + 0.15, F.lit(0.75)))
    return joined.select(F.col("k").alias(key), F.when(move, F.col("spec")).otherwise(F.col("old")).alias(subsection), F.coalesce(move, F.lit(False)).alias("moved"))


def by_specification(specs: DataFrame, spec: str, tables: DataFrame, subsection: str, position: str) -> DataFrame:
    """Every specification with its table: the last one of its subsection, or none."""
    last = top_per_key(tables, [subsection], [F.desc(position)])
    return specs.join(last, F.col(spec) == F.col(subsection), "left")


def with_overrides(template: DataFrame, overrides: DataFrame, key: str, payload: str) -> DataFrame:
    """Template entries with overrides merged in by JSON key (the override wins); overrides without an entry are added. Payloads are maps."""
    t, o = template.select(key, F.col(payload).alias("__t")), overrides.select(key, F.col(payload).alias("__o"))
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("__t", empty), F.coalesce("__o", empty)
    return t.join(o, key, "full").select(key, F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b).alias(payload))


def fields_present(df: DataFrame, key: str, corpus: str, fields: DataFrame, field: str, most: int = 5_000) -> DataFrame:
    """key, field, present: the field's text is in the corpus, or nearly (partial ratio 88), or enough of its words are (60 %, at least one). Blank fields are left out; a null corpus holds none."""
    names = [r[0] for r in _few(fields.select(F.col(field).cast("string").alias("f")).where("trim(f) <> ''").distinct(), most, "fields")]
    wanted = [(f, f.strip().lower(), [w for w in re.findall("[a-z0-9]+", f.lower()) if len(w) > 1 and w not in STOP_WORDS]) for f in names]

    def present(value: str) -> Iterable[tuple]:
        low = value.lower()
        for name, plain, words in wanted:
            held = sum(w in low for w in words)
            yield name, bool(low) and (plain in low or (bool(words) and held >= max(1, int(0.6 * len(words)))) or partial_ratio(plain, low) >= 88)

    return _per_text(df, key, F.coalesce(F.col(corpus), F.lit("")), "field string, present boolean", present)


def round_trip_sections(module: Column, mapping: dict[str, str]) -> Column:
    """The section a number is mapped to: that of the longest mapped number it equals or descends from; null without one."""
    out = F.lit(None).cast("string")
    for prefix in sorted(mapping, key=len):
        out = F.when((module == prefix) | module.startswith(prefix + "."), mapping[prefix]).otherwise(out)
    return out


def prefix_with_most(df: DataFrame, key: str, mark: str) -> DataFrame:
    """prefix, n: the folder with most keys that hold ``mark``; the first in order on ties."""
    folder = F.regexp_extract(F.col(key), r"^(.*/)[^/]*$", 1)
    return df.where(F.contains(F.col(key), F.lit(mark))).groupBy(folder.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


def folder_keys(base: str, tree: dict) -> list[str]:
    """Keys of all folders of a nested structure, parents first."""
    out: list[str] = []
    for name, below in tree.items():
        out.append(f"{base.rstrip('/')}/{name}/".lstrip("/"))
        if isinstance(below, dict):
            out += folder_keys(out[-1], below)
    return out


def within_budget(tiers: list[tuple[int, ...]], build, most: int):
    """The first tier whose built context has at most ``most`` characters, else the last."""
    for tier in tiers:
        text = build(*tier)
        if len(text) <= most:
            return text
    return build(*tiers[-1])
