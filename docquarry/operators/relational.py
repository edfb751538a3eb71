"""Joins, windows, aggregates and mutations of the retrieval and status queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored
from docquarry.functions.text import tokens

# Latest and best rows


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (add a unique column for a defined result)."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Every row with its rank (from 1) in ``order``: a range sort, ranks within its partitions and the sizes of those before."""
    at = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per partition of the sort
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return at.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__before")


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; null times last, equal times by the larger ``tie``."""
    return top_per_key(df, keys, [F.desc_nulls_last(time), F.desc(tie)])


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows: one of each group (in group order) in every round."""
    ranked = df.withColumn("round", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("round") <= n)
    return ranked.orderBy("round", group).limit(n)


def head_then_longest(df: DataFrame, group: str, position: str, text: str, head: int, limit: int) -> DataFrame:
    """The first ``head`` rows of a group, then the longest texts (earlier first on ties), ``limit`` rows in all."""
    first = df.withColumn("__p", F.row_number().over(W.partitionBy(group).orderBy(position)))
    order = [F.when(F.col("__p") <= head, F.col("__p")).otherwise(2**31 - 1), F.desc(F.when(F.col("__p") > head, F.coalesce(F.length(text), F.lit(0))).otherwise(0)), F.col("__p")]
    return top_per_key(first, [group], order, limit).drop("__p")


def running_offsets(df: DataFrame, group: str, order: list[Column], text: str) -> DataFrame:
    """offset_start and offset_end of texts joined with one character between them."""
    size = F.coalesce(F.length(text), F.lit(0))
    before = F.coalesce(F.sum(size + 1).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("offset_start", before).withColumn("offset_end", before + size)


def count_chunks(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """chunk_index (from 1) of every ``n`` rows of a group."""
    if n <= 0:
        raise ValueError("chunk size must be positive")
    return df.withColumn("chunk_index", (F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / n) + 1).cast("int"))


def ordered_distinct_list(df: DataFrame, group: list[str], value: Column, order: list[Column], most: int) -> DataFrame:
    """group and items: the first ``most`` values that differ but for case, in order, first spelling."""
    rows = df.withColumn("__v", value).where("__v is not null")
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy(*group, F.lower("__v")).orderBy(*order))).where("__n = 1")
    ranked = first.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= most)
    return ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias("items"))


# Joins


def exists_any(left: DataFrame, key: str, rights: list[DataFrame]) -> DataFrame:
    """Rows with a partner in any of several tables: one semi join instead of outer joins that multiply rows."""
    return left.join(reduce(DataFrame.union, [r.select(key) for r in rights]), key, "left_semi")


def expand_interval(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """One row for each integer from start to end; rows with a null bound or an empty interval have none."""
    ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    return ok.withColumn(out, F.explode(F.sequence(start, end)))


def interval_join(left: DataFrame, start: str, end: str, right: DataFrame, at: str, keys: list[str], margin: int = 0, null_meets_all: bool = False) -> DataFrame:
    """Rows whose integer ``at`` lies within start - margin .. end + margin (a null end is the start): intervals are expanded for an equi-join.

    ``null_meets_all``: a null start or a null ``at`` meets every row of its keys; else it meets none.
    """
    wide = left.withColumn("__s", F.col(start) - margin).withColumn("__e", F.coalesce(F.col(end), F.col(start)) + margin)
    met = expand_interval(wide, "__s", "__e", at).join(right, [*keys, at]).drop("__s", "__e")
    if not null_meets_all:
        return met
    columns = met.columns
    open_start = left.where(F.col(start).isNull()).join(right, keys)
    open_at = left.where(F.col(start).isNotNull()).join(right.where(F.col(at).isNull()), keys)
    return met.unionByName(open_start.select(*columns)).unionByName(open_at.select(*columns))


def attach_in_order(left: DataFrame, key: str, ids: str, right: DataFrame, right_id: str, fields: list[str], out: str) -> DataFrame:
    """For an array of ids the fetched rows in array order; ids without a row are dropped, repeated ones kept."""
    places = left.select(key, F.posexplode(ids).alias("pos", "__id"))
    met = places.join(right.select(F.col(right_id).alias("__id"), *fields), "__id")
    lists = met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))
    return left.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast(lists.schema[out].dataType)))


def token_overlap(left: DataFrame, key: str, text: str, right: DataFrame, right_key: str, right_text: str, least: float = 0.25) -> DataFrame:
    """key, right_key, score: best share of the right side's words found on the left, at least ``least``; ties by right key.

    Only pairs with a common word are compared (an equi-join on words with counts).
    """
    a = left.select(key, F.explode(F.array_distinct(tokens(text))).alias("w"))
    b = right.select(right_key, F.array_distinct(tokens(right_text)).alias("ws")).select(right_key, F.size("ws").alias("n"), F.explode("ws").alias("w"))
    shared = a.join(b, "w").groupBy(key, right_key).agg((F.count("*") / F.first("n")).alias("score")).where(F.col("score") >= least)
    return top_per_key(shared, [key], [F.desc("score"), F.col(right_key)])


def alias_join(left: DataFrame, key: str, aliases: list[Column], right: DataFrame, right_key: str, right_aliases: list[Column]) -> DataFrame:
    """key, right_key of rows that share any alias, ignoring case and outer blanks; blank aliases meet nothing."""
    flat = lambda df, k, cs: df.select(k, F.explode(F.array_distinct(F.filter(F.transform(F.array(*cs), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))).alias("__a"))
    return flat(left, key, aliases).join(flat(right, right_key, right_aliases), "__a").select(key, right_key).distinct()


# Mutations: (current, changes) -> next


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], overwrite: list[str], sticky: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Rows of both sides by key. ``overwrite``: the change wins, null too; ``sticky``: the change wins unless null;
    ``fill``: only null or blank current values are replaced. Null keys match nothing (both rows stay).
    Changes must be unique by key. Columns in none of the lists keep the current value."""
    c, n = current.alias("c"), changes.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys])
    joined = c.withColumn("__c", F.lit(True)).alias("c").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full")
    known, changed = F.col("c.__c").isNotNull(), F.col("n.__n").isNotNull()

    def column(name: str) -> Column:
        if name not in changes.columns:
            return F.col(f"c.{name}")
        old, new = F.col(f"c.{name}"), F.col(f"n.{name}")
        if name in keys:
            return F.coalesce(old, new)
        if name in overwrite:
            return F.when(changed, new).otherwise(old)
        if name in sticky:
            return F.coalesce(new, old)
        if name in fill:
            blank = F.nullif(F.trim(old.cast("string")), F.lit("")).isNull()
            return F.when(blank, F.coalesce(new, old)).otherwise(old)
        return F.when(known, old).otherwise(new)

    return joined.select(*[column(x).alias(x) for x in current.columns])


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and those new ones whose key is absent."""
    return current.unionByName(rows.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_children(current: DataFrame, rows: DataFrame, parent: str, empty_deletes: DataFrame | None = None) -> DataFrame:
    """All children of the parents in ``rows`` are replaced; ``empty_deletes`` names parents whose children go though none come."""
    touched = rows.select(parent)
    if empty_deletes is not None:
        touched = touched.union(empty_deletes.select(parent))
    return current.join(touched.distinct(), parent, "left_anti").unionByName(rows)


def cascade_delete(parents: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Children without those that refer to the deleted parents."""
    gone = parents.select(key).distinct()
    return [child.join(gone.withColumnRenamed(key, ref), ref, "left_anti") for child, ref in children]


def violations(df: DataFrame, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """key, field, value of values outside their domain (nulls pass)."""
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, allowed in domains.items()]
    return df.select(key, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("v")).select(key, "v.field", "v.value")
