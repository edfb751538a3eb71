"""Repair of drafted tables: candidates matched to rows, missing cells filled, best row of each study, identifiers normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored
from docquarry.functions.inference import meaningful_cells
from docquarry.functions.text import blank_to_null, natural_key, study_ids
from docquarry.operators.matching import best_by_labels
from docquarry.operators.relational import token_overlap, top_per_key


def filled(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns aren't blank."""
    return sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in columns), F.lit(0))


def first_id(c: str) -> Column:
    return F.get(study_ids(c), F.lit(0))


def merged_candidates(rows: DataFrame, candidates: DataFrame, study: str, columns: list[str], position: str, least: float = 0.25, unmatched_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a drafted table after candidates (known studies) are worked in: one row per study, columns ``study``, ``columns`` and ``position``.

    A row keeps its first study id if a candidate has it; an id of no candidate, or text
    without an id, is dropped. A row without an id takes that of the candidate whose words it
    shares most (``least`` of the candidate's). Candidates of no row are added behind. Blank
    cells are filled from the study's candidate, and the fullest row of each study stays
    (the first on ties). Rows that denote no candidate aren't in the result. ``unmatched_by``:
    columns not compared by words. Candidates must be unique by study.
    """
    key = "__id"
    known = candidates.select(F.upper(first_id(study)).alias(key), *[F.col(c).alias(f"__{c}") for c in columns]).where(F.col(key).isNotNull()).dropDuplicates([key])
    compared = [c for c in columns if c not in unmatched_by]
    base = rows.select(study, *columns, position).withColumn(key, F.upper(first_id(study)))
    named = base.where(F.col(key).isNotNull()).join(known.select(key), key, "left_semi")
    words = lambda cs: F.concat_ws(" ", *[F.col(c).cast("string") for c in cs])
    open_ = base.where(F.col(key).isNull()).drop(key)
    best = token_overlap(open_.select(position, words(compared).alias("__t")), position, "__t", known.select(key, words([f"__{c}" for c in compared]).alias("__u")), key, "__u", least)
    guessed = open_.join(best.select(position, key), position)
    matched = named.unionByName(guessed)
    last = F.lit(2**62)
    added = known.join(matched.select(key), key, "left_anti").select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (study, *columns)], last.cast(rows.schema[position].dataType if rows.schema[position].dataType.simpleString() == "bigint" else "bigint").alias(position), key)
    every = matched.withColumn(position, F.col(position).cast("bigint")).unionByName(added).join(known, key)
    whole = every.select(F.col(key).alias(study), *[F.coalesce(blank_to_null(F.col(c).cast("string")), F.col(f"__{c}").cast("string")).alias(c) for c in columns], position)
    return top_per_key(whole.withColumn("__n", filled(whole, columns)), [study], [F.desc("__n"), F.col(position)]).drop("__n")


def best_rows(df: DataFrame, study: str, columns: list[str], position: str) -> DataFrame:
    """Rows with something to say: per study id the one with most meaningful cells (the first on ties), and all without an id; ``order`` sorts ids naturally, others behind by position."""
    rows = df.withColumn("__q", meaningful_cells({c: F.col(c).cast("string") for c in columns}, {})).where("__q > 0").withColumn("__id", first_id(study))
    kept = top_per_key(rows.where("__id is not null"), ["__id"], [F.desc("__q"), F.col(position)]).withColumn(study, F.col("__id"))
    every = kept.unionByName(rows.where("__id is null"))
    order = F.struct(F.when(F.col("__id").isNull(), 1).otherwise(0).alias("a"), natural_key("__id").alias("b"), F.when(F.col("__id").isNull(), F.col(position)).alias("c"))
    return every.withColumn("order", order).drop("__q", "__id")


#: Entries that say no study was done.
NO_STUDY = ("none", "none conducted", "not conducted")


def with_study_ids(df: DataFrame, key: str, study: str, location: str | None, columns: list[str], candidates: DataFrame, candidate: str, labels: str) -> DataFrame:
    """``study`` filled or made canonical: from its own ids, else from the location, else from the other cells of the row.

    Statements that no study was done stay. Each source is compared only for rows that those before left open; what
    the first two give is stored, as one plan for all three takes more than 1.5 GB of the driver.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    base = df.select(key, study, *([location] if location else []), *[c for c in columns if c not in (study, location)])
    open_ = base.where(~F.lower(blank(study)).isin(*NO_STUDY))
    own = F.size(study_ids(study)) > 0
    first = open_.select(key, F.when(own, blank(study)).otherwise(blank(location) if location else F.lit("")).alias("__t")).where("__t <> ''")
    seen = stored(best_by_labels(first, key, "__t", candidates, candidate, labels), "seen_ids")
    left = open_.where(~own).join(seen.select(key), key, "left_anti").select(key, F.concat_ws(" ", *[F.col(c).cast("string") for c in columns if c != study]).alias("__t")).where("trim(__t) <> ''")
    seen = seen.unionByName(best_by_labels(left, key, "__t", candidates, candidate, labels))
    return df.join(seen.select(key, F.col("candidate").alias("__c")), key, "left").withColumn(study, F.coalesce("__c", F.col(study))).drop("__c")


def labels_by_id(df: DataFrame, study: str, labels: list[str]) -> DataFrame:
    """study_id (upper case), labels: the distinct non-blank labels of all rows that name it, in order."""
    rows = df.select(F.explode(study_ids(study)).alias("study_id"), F.explode(F.array(*[F.col(c).cast("string") for c in labels])).alias("label"))
    return rows.where("trim(label) <> ''").groupBy("study_id").agg(F.array_sort(F.collect_set(F.trim("label"))).alias("labels"))


def grouped_in_order(df: DataFrame, group: str, position: str, item: str, most: int | None = None) -> DataFrame:
    """group, n, first_position, items: the first ``most`` items of each group in order (all counts kept); groups sort by first_position as first seen."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(position)))
    shown = F.when(F.col("__n") <= (most or 2**31 - 1), F.struct("__n", F.col(item).alias("v")))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.min(position).alias("first_position"), F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["v"]).alias("items"))


def aligned_specifications(specs: DataFrame, section: str, columns: str, overrides: dict[str, list[str]]) -> DataFrame:
    """Specifications whose section has an override get its columns, and the header text that lists them."""
    chosen = F.coalesce(*[F.when(F.col(section) == s, F.array(*[F.lit(c) for c in cs])) for s, cs in overrides.items()], F.col(columns)) if overrides else F.col(columns)
    return specs.withColumn(columns, chosen).withColumn("columns_header", F.array_join(columns, " | "))


def statement_rows(tables: DataFrame, section: str, n_rows: str, statements: dict[str, str]) -> DataFrame:
    """section, statement: the fixed statement of each table without rows whose section has one."""
    said = F.coalesce(*[F.when(F.col(section) == s, F.lit(t)) for s, t in statements.items()], F.lit(None).cast("string"))
    return tables.where(F.coalesce(F.col(n_rows), F.lit(0)) == 0).select(section, said.alias("statement")).where("statement is not null")
