"""Mapping free-entered values to the entries of a reference list.

Entries stand in a BK-tree per field under the Damerau-Levenshtein distance (a true
metric), and the triangle inequality prunes the search for all entries within the
threshold. Values are looked up whole and by stretches of their words, so that
qualifiers, inflection, changed word order and spelling don't hide a term.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.edit import distance, plain_words


class BKTree:
    """Entries under a metric; ``within`` returns every entry within a radius."""

    def __init__(self, entries: list[str]):
        self.root: tuple[str, dict] | None = None
        for entry in entries:
            self.add(entry)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while d := distance(entry, node[0]):
            if d not in node[1]:
                node[1][d] = (entry, {})
                return
            node = node[1][d]

    def within(self, value: str, radius: int) -> list[tuple[int, str]]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            entry, children = open_.pop()
            d = distance(value, entry)
            if d <= radius:
                found.append((d, entry))
            open_ += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return found


#: Words of the trade that mean the same in names of findings.
_SAME = {"reduced": "decreased", "lowered": "decreased", "lower": "decreased", "low": "decreased", "reduction": "decreased", "decrease": "decreased", "elevated": "increased", "raised": "increased", "higher": "increased", "elevation": "increased", "increase": "increased", "gl": "gland"}

def words(value: str) -> list[str]:
    """Plain words, those that mean the same in one form."""
    return [_SAME.get(w, w) for w in plain_words(value)]


def _british(w: str) -> str:
    return re.sub(r"^oe(?=[sd])", "e", w).replace("haem", "hem").replace("naem", "nem").replace("rrhoea", "rrhea")


def _threshold(n: int) -> int:
    """Edits allowed for a stretch of ``n`` letters: none in short words, where one edit makes another word."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


class Terms:
    """The reference entries of one field, ready for lookup; ``length`` and ``short`` (words and letters of names) of the whole list, where this is a shard of it."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], length: int | None = None, short: int | None = None):
        self.exact: dict[str, int] = {}
        self.sorted: dict[str, int] = {}
        self.terms: dict[str, bool] = {}
        self.length = 1
        for first, names in ((True, lambda e: [e[1]]), (False, lambda e: e[2] or [])):  # terms before other names
            for entry in sorted(entries):
                for name in names(entry):
                    if ws := words(name or ""):
                        self.length = max(self.length, len(ws))
                        key = _british("".join(ws))
                        if key not in self.exact:
                            self.exact[key], self.terms[key] = entry[0], first
                        self.sorted.setdefault(_british("".join(sorted(ws))), entry[0])
        self.tree = BKTree(sorted(self.exact))
        self.sorted_tree = BKTree(sorted(self.sorted))
        self.short = min(map(len, self.exact), default=0)
        self.length, self.short = length or self.length, self.short if short is None else short

    def look_up(self, value: str) -> int:
        """The entry that ``value`` denotes, or 0."""
        best = self.best(value)
        return best[1] if best else 0

    def best(self, value: str) -> tuple[tuple, int] | None:
        """Rank (less is better, comparable between shards) and entry that ``value`` denotes."""
        ws = [_british(w) for w in words(value)]
        if not ws:
            return None
        # the whole value, then stretches of its words; longer ones first
        spans = [(i, j) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + self.length + 2) + 1)]
        spans.sort(key=lambda s: (-(sum(map(len, ws[s[0] : s[1]]))), s))
        for at, (i, j) in enumerate(spans):
            for ordered, (forms, key) in enumerate(((self.exact, "".join(ws[i:j])), (self.sorted, "".join(sorted(ws[i:j]))))):
                for cut, k in enumerate((key, key.removesuffix("s"), key.removesuffix("es"))):
                    if k in forms and (len(k) > 3 or k == key or j - i == len(ws)):
                        return (0, at, ordered, cut, not self.terms.get(k, False), forms[k]), forms[k]
        best: tuple[float, int, int] | None = None
        for i, j in spans:
            size = sum(map(len, ws[i:j]))
            radius = _threshold(size)
            if not radius or size + radius < self.short:
                continue
            for tree, forms, keys in ((self.tree, self.exact, ["".join(ws[i:j])]), (self.sorted_tree, self.sorted, ["".join(sorted(ws[i:j]))] if j - i > 1 else [])):
                for key in keys:
                    for d, name in tree.within(key, radius):
                        if d > _threshold(len(name)):
                            continue
                        # fewer edits first, then the name that explains more of the value
                        rank = (d - 0.34 * len(name) / max(len(name), 10) * (j - i == len(ws)), -len(name), forms[name])
                        if best is None or rank < best:
                            best = rank
        return ((1, *best), best[2]) if best else None


#: Reference entries of one shard; a list within it is sent to every worker, a longer one is cut into shards.
SHARD = 50_000

#: Trees by the digest of their list: a worker builds them once, not once per task.
_BUILT: dict[str, dict[str, Terms]] = {}


def _built(digest: str, lists: dict[str, list]) -> dict[str, Terms]:
    if digest not in _BUILT:
        _BUILT.clear()  # one list at a time
        _BUILT[digest] = {f: Terms(e) for f, e in lists.items()}
    return _BUILT[digest]


def map_values(df: DataFrame, terms: DataFrame, shard: int | None = None) -> DataFrame:
    """field, value, term_id for the distinct values of ``df`` (field, value); 0 where no entry is denoted.

    ``terms``: field, term_id, term, alt_names. A list of up to SHARD entries is sent to
    every worker, which builds its trees once. A longer one is cut into shards by the digest
    of its entries; values meet every shard, and the best of the shards' winners counts, so
    the result is that of one list.
    """
    shard = shard or SHARD
    # even partitions in an explicit number, as coalesced ones would leave the search to a single task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select("field", "value").distinct()
    every = terms.select("field", F.col("term_id").cast("int").alias("term_id"), "term", F.coalesce("alt_names", F.array().cast("array<string>")).alias("alt_names")).where("field is not null and term_id is not null")
    rows = every.limit(shard + 1).collect()
    if len(rows) > shard:
        return _map_by_shards(values, every, -(-every.count() // shard), parts)
    lists: dict[str, list] = {}
    for r in rows:
        lists.setdefault(r["field"], []).append((r["term_id"], r["term"], list(r["alt_names"])))
    digest = hashlib.sha256(repr(sorted((f, sorted(e, key=repr)) for f, e in lists.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _built(digest, lists)
        for batch in batches:
            found = [built[f].look_up(v) if f in built else 0 for f, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["field", "value", "term_id"])

    return values.repartition(parts).mapInArrow(run, "field string, value string, term_id int")


def _map_by_shards(values: DataFrame, terms: DataFrame, shards: int, slices: int) -> DataFrame:
    """As :func:`map_values`, for a reference list in shards."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [(f, words(n or "")) for f, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n in (t, *a)]
            names = [(f, ws) for f, ws in names if ws]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in names], pa.string()), pa.array([len(ws) for _, ws in names], pa.int32()), pa.array([len(_british("".join(ws))) for _, ws in names], pa.int32())], names=["field", "length", "short"])

    bounds = terms.select("field", "term", "alt_names").mapInArrow(measure, "field string, length int, short int").groupBy("field").agg(F.max("length").alias("length"), F.min("short").alias("short"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = values.withColumn("slice", F.pmod(F.hash("value"), F.lit(slices))).withColumn("shard", copies(shards))
    right = terms.join(bounds, "field").withColumn("shard", F.pmod(F.hash("term_id", "term"), F.lit(shards))).withColumn("slice", copies(slices))

    def look_up(own: pa.Table, entries: pa.Table) -> pa.Table:
        lists: dict[str, list] = {}
        bound: dict[str, tuple[int, int]] = {}
        for f, *entry, length, short in zip(*(entries[c].to_pylist() for c in ("field", "term_id", "term", "alt_names", "length", "short")), strict=True):
            lists.setdefault(f, []).append(tuple(entry))
            bound[f] = (length, short)
        built = {f: Terms(e, *bound[f]) for f, e in lists.items()}
        out = []
        for f, v in zip(own["field"].to_pylist(), own["value"].to_pylist(), strict=True):
            if f in built and (best := built[f].best(v)):
                out.append((f, v, [float(x) for x in best[0]], best[1]))
        kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.int32())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["field", "value", "rank", "term_id"])

    won = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(look_up, "field string, value string, rank array<double>, term_id int")
    best = won.groupBy("field", "value").agg(F.min_by("term_id", "rank").alias("term_id"))
    return values.join(best, ["field", "value"], "left").select("field", "value", F.coalesce("term_id", F.lit(0)).alias("term_id"))


def entries(df: DataFrame, field: str, record_id: str) -> DataFrame:
    """field, record_id, value of one column; null and blank values are no cases."""
    return df.select(F.lit(field).alias("field"), F.col(record_id).cast("string").alias("record_id"), F.col(field).cast("string").alias("value")).where("value is not null and value rlike '(?U)\\\\S'")


def denoted(values: DataFrame, terms: DataFrame) -> DataFrame:
    """field, record_id, term_id of every value that isn't exactly a term of its field (0: none denoted).

    ``values`` as of :func:`entries`. A record counts once. Distinct values are looked up
    once and joined back; a value held by many rows is one lookup, and the join leaves
    its skew to the adaptive plan.
    """
    names = terms.select("field", F.col("term").alias("value"))
    free = values.join(names, ["field", "value"], "left_anti").dropDuplicates(["field", "record_id", "value"])
    return free.join(map_values(free, terms), ["field", "value"]).select("field", "record_id", "term_id").distinct()


def unmatched(values: DataFrame, terms: DataFrame) -> DataFrame:
    """field, value, n: the values that denote no entry and how many records hold them."""
    names = terms.select("field", F.col("term").alias("value"))
    free = values.join(names, ["field", "value"], "left_anti").dropDuplicates(["field", "record_id", "value"])
    counted = free.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counted.join(map_values(counted, terms).where("term_id = 0"), ["field", "value"], "left_semi")
