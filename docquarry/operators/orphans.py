"""References to records that do not exist (yet, or any more).

Keys are placed in equal ranges of their 64-bit digests. Each range holds the parents
as one sorted array; batches of references are probed by binary search, and a hit is
confirmed by comparing the key itself. Ranges with many references (a hot key) are
split: the references are salted and the range's parents, a bounded array, are sent to
each part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.cluster import stored

#: White space cut from the ends of keys.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

#: Parents kept in one range, and references probed in one part of a range (rows).
PARENTS_PER_RANGE = 100_000
REFERENCES_PER_PART = 400_000


def clean_key(key: Column) -> Column:
    """Lower case without outer white space; blank keys become null."""
    return F.nullif(F.btrim(F.lower(key.cast("string")), F.lit(BLANKS)), F.lit(""))


def parents(df: DataFrame, name: str, key: str, born: str, died: str | None = None) -> DataFrame:
    """Parent records: parent, ref_key, born, died. Null keys are no parents."""
    gone = F.col(died) if died else F.lit(None)
    return df.select(F.lit(name).alias("parent"), clean_key(F.col(key)).alias("ref_key"), F.col(born).cast("timestamp_ntz").alias("born"), gone.cast("timestamp_ntz").alias("died")).where("ref_key is not null")


def references(df: DataFrame, table_name: str, field: str, record_id: str, at: str, parent: str, array: bool = False) -> DataFrame:
    """References: parent, table_name, field_name, record_id, ref_key, at. Null and blank keys are no references."""
    key = F.explode(F.array_distinct(F.transform(F.col(field), clean_key))) if array else clean_key(F.col(field))
    return df.select(F.lit(parent).alias("parent"), F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), F.col(record_id).cast("string").alias("record_id"), key.alias("ref_key"), F.col(at).cast("timestamp_ntz").alias("at")).where("ref_key is not null")


def _probe(parent: pa.Table, refs: pa.Table) -> pa.Table:
    """States of the references of one part of one range."""
    digests = parent["digest"].to_numpy()
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    wanted = refs["digest"].to_numpy()
    keys, names = parent["ref_key"].take(pa.array(order)), parent["parent"].take(pa.array(order))
    hit = np.full(len(wanted), -1, dtype=np.int64)
    if len(digests):
        at = np.searchsorted(digests, wanted, side="left")
        open_ = np.flatnonzero(at < len(digests))
        while len(open_):  # more than one round only where digests or keys repeat
            open_ = open_[digests[at[open_]] == wanted[open_]]
            if not len(open_):
                break
            same = pc.and_(pc.equal(keys.take(pa.array(at[open_])), refs["ref_key"].take(pa.array(open_))), pc.equal(names.take(pa.array(at[open_])), refs["parent"].take(pa.array(open_)))).to_numpy()
            hit[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(digests)]
    micro = lambda column: pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
    when = pc.fill_null(refs["at"].cast(pa.timestamp("us")).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
    known = ~refs["at"].is_null().to_numpy()
    state = np.full(len(wanted), "", dtype=object)
    state[hit < 0] = "missing"
    found = np.flatnonzero((hit >= 0) & known)
    if len(found):
        at = order[hit[found]]
        died, born = micro(parent["died"])[at], parent["born"]
        late = (pc.fill_null(born.cast(pa.timestamp("us")).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()[at]) > when[found]
        state[found[late]] = "late"
        state[found[died <= when[found]]] = "deleted"
    keep = pa.array(np.flatnonzero(state != ""))
    return pa.table([refs[c].take(keep) for c in ("table_name", "field_name", "record_id", "ref_key", "at")] + [pa.array(state, pa.string()).take(keep)], names=["table_name", "field_name", "record_id", "ref_key", "at", "state"])


def unique_parents(parent: DataFrame) -> DataFrame:
    """Each parent once. Of different deliveries of one key the one that makes fewest references wrong counts: the earliest birth, and no death or the latest."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    once = parent.groupBy("parent", "ref_key").agg(F.min(F.coalesce("born", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("born"), F.max(F.coalesce("died", far)).alias("died"))
    return once.select("parent", "ref_key", "born", F.nullif("died", far).alias("died"))


def orphans(parent: DataFrame, refs: DataFrame, parents_per_range: int = PARENTS_PER_RANGE, references_per_part: int = REFERENCES_PER_PART) -> DataFrame:
    """References whose record is ``missing``, ``deleted`` (died at or before the reference's time) or ``late`` (born after it).

    Inputs as of :func:`parents` and :func:`references`; one row per record and key
    (repeated deliveries of a record count once). A reference without a time can only
    be missing. A parent delivered more than once is one parent (:func:`unique_parents`),
    so a range never holds more than its share of distinct keys. Empty inputs give an empty
    result or all references as missing.
    """
    once = stored(unique_parents(parent), "parents")
    ranges = max(1, -(-once.count() // parents_per_range))
    place = lambda df: df.withColumn("digest", F.xxhash64("parent", "ref_key")).withColumn("range", F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    placed, probed = place(once), stored(place(refs), "references")
    parts = {r["range"]: -(-r["count"] // references_per_part) for r in probed.groupBy("range").count().collect()}  # one row per range
    split = {k: v for k, v in parts.items() if v > 1}
    if split:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col("range")), F.lit(1))
        probed = probed.withColumn("part", F.pmod(F.xxhash64("record_id", "field_name"), many).cast("int"))
        placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    else:
        probed, placed = probed.withColumn("part", F.lit(0)), placed.withColumn("part", F.lit(0))
    found = placed.groupBy("range", "part").cogroup(probed.groupBy("range", "part")).applyInArrow(
        lambda left, right: _probe(left, right),
        "table_name string, field_name string, record_id string, ref_key string, at timestamp_ntz, state string",
    )
    return found.dropDuplicates(["table_name", "field_name", "record_id", "ref_key"])


def orphan_counts(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Per table, field and month of the record's time: references, and those missing, deleted and late.

    ``totals`` are the references; months without orphans appear with zeros. The month
    of a record without a time is null.
    """
    month = F.date_format("at", "yyyy-MM").alias("month")
    keys = ["table_name", "field_name", "month"]
    every = totals.select("table_name", "field_name", month, "record_id", "ref_key").distinct().groupBy(*keys).agg(F.count("*").alias("n_refs"))
    bad = found.groupBy("table_name", "field_name", month).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("missing", "deleted", "late")])
    joined = every.alias("e").join(bad.alias("b"), reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "left")
    return joined.select(*[F.col(f"e.{k}") for k in keys], "n_refs", *[F.coalesce(F.col(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in ("missing", "deleted", "late")])
