"""Checking new batches of files against all history, without going through it again.

Incremental record linkage. Blocking keys (content hash; study, title and version of the
name) are persisted with the class of their records. A batch probes the persisted keys,
candidate agreements are scored with learned weights, and a union-find mapping of
representatives is updated only for the classes that the batch touches.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.cluster import checkpointed, shared_dir, stored
from docquarry.functions.edit import distance

#: Fixed value: the SHA-256 of no bytes at all, which proves nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: Chance that two different files have the same SHA-256.
CHANCE_HASH = 2.0**-256

#: A title is canonical if at least this share of the named records has it (so there are at most 1 / share).
TITLE_SHARE, TITLE_LEAST = 0.001, 3


def content_hash(value: Column) -> Column:
    """64 hexadecimal digits in lower case, however written; null for blanks and placeholders."""
    bare = F.regexp_replace(F.lower(value.cast("string")), r"(?U)^\s*(sha-?_?256\s*[:=]?|0x)?\s*|[\s:-]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$") & ~bare.rlike(r"^(.)\1{63}$") & (bare != EMPTY), bare)


def _plain(name: Column) -> Column:
    """Lower-case file name without path, escapes, extensions, copy marks and time stamps."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name))
    for pattern, new in (
        (r"^.*[/\\]", ""),
        (r"(?U)(\s*\.(pdf|docx?|rtf|txt|tmp|zip))+\s*$", ""),
        (r"(?U)\s*\(\d+\)\s*$", ""),
        (r"(?U)[\s_-]+(copy|kopie|copie|copia)(\s*\(\d+\))?\s*$", ""),
        (r"(?U)\s*\(\d+\)\s*$", ""),
        (r"(?U)(\s*\.(pdf|docx?|rtf|txt|tmp|zip))+\s*$", ""),
        (r"(?U)^\s*((copy of|scan|fwd?|re)[\s_:-]+)+", ""),
        (r"^(\d{4}-\d{2}-\d{2}|\d{9,13})[\s_-]+", ""),
        (r"(?U)^\s*((copy of|scan)[\s_:-]+)+", ""),
    ):
        plain = F.regexp_replace(plain, pattern, new)
    return plain


_STUDY = r"(?<![a-z])([a-z]{2})[-_ .]?(\d{2})[-_ .]?(\d{7})(?!\d)"
_VERSION = r"(?<![a-z])(?:version|ver|v|revision|rev)[\s._-]*(\d+(?:\.\d+)*)(?![a-z\d])"


def described(df: DataFrame) -> DataFrame:
    """id, batch_no, hash, study, version, raw_title of the records, once per id.

    The last three are null where the name gives no study number.
    """
    named = df.select(F.col("id").cast("string").alias("id"), F.col("batch_no").cast("int").alias("batch_no"), content_hash(F.col("sha256")).alias("hash"), _plain(F.col("file_name").cast("string")).alias("plain"))
    named = named.where("id is not null").dropDuplicates(["id"])
    study = F.nullif(F.concat(*[F.regexp_extract("plain", _STUDY, i) for i in (1, 2, 3)]), F.lit(""))
    version = F.regexp_replace(F.regexp_replace(F.regexp_extract("plain", _VERSION, 1), r"^0+(?=\d)", ""), r"(\.0+)+$", "")
    rest = F.regexp_replace(F.regexp_replace("plain", _STUDY, " "), _VERSION, " ")
    title = F.btrim(F.regexp_replace(rest, r"(?U)[\W_]+", " "))
    return named.withColumn("study", study).select("id", "batch_no", "hash", "study", F.when(F.col("study").isNotNull(), version).alias("version"), F.when(F.col("study").isNotNull(), title).alias("raw_title"))


def _abbreviates(short: str, long: str) -> bool:
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    if long.startswith(short):
        return True
    rest = iter(long)
    return short[-1] == long[-1] and len(short) <= 5 and all(c in rest for c in short)


def _alike(words: list[str], model: list[str]) -> float | None:
    """How far a title is from a canonical one: edits, and a little for each abbreviation; null if too far."""
    if len(words) != len(model):
        joined, other = "".join(words), "".join(model)
        return float(d) if abs(len(joined) - len(other)) <= 2 and len(other) > 8 and (d := distance(joined, other)) <= 2 and [w for w in words if w.isdigit()] == [w for w in model if w.isdigit()] else None
    total = 0.0
    for a, b in zip(words, model, strict=True):
        if a == b:
            continue
        if a.isdigit() or b.isdigit() or len(b) < 4:
            return None
        if _abbreviates(a, b):
            total += 0.1 if b.startswith(a) else 0.2
            continue
        d = distance(a, b)
        if d > (2 if len(b) > 5 else 1):
            return None
        total += d
    return total if total <= 4 else None


class Titles:
    """Canonical titles with their counts; ``resolve`` gives the canonical form of any title."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.models = {t: t.split() for t in counts}
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)

    def _nearest(self, title: str, least: int) -> str | None:
        words, best = title.split(), None
        for model, parts in self.models.items():
            if model != title and self.counts[model] > least and (d := _alike(words, parts)) is not None:
                best = min(best or (d, -self.counts[model], model), (d, -self.counts[model], model))
        return best[2] if best else None

    def _resolve(self, title: str) -> str:
        # an abbreviated or misspelt form may itself be frequent: it gives way to a more frequent one
        for _ in range(4):
            nearer = self._nearest(title, 2 * self.counts.get(title, 0))
            if nearer is None:
                return title
            title = nearer
        return title


def learn_titles(records: DataFrame) -> dict[str, int]:
    """Frequent titles and their counts: at most 1 / TITLE_SHARE of them, however many records there are."""
    named = records.where("raw_title is not null")
    total = named.count()
    rows = named.groupBy("raw_title").count().where(F.col("count") >= max(TITLE_LEAST, TITLE_SHARE * total)).collect()
    return {r["raw_title"]: r["count"] for r in rows}


def keyed(records: DataFrame, titles: dict[str, int]) -> DataFrame:
    """Records with their canonical title (one pass, no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Titles(titles)
        for batch in batches:
            found = [None if t is None else known.resolve(t) for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(found, pa.string())], names=["id", "batch_no", "hash", "study", "version", "title"])

    return records.select("id", "batch_no", "hash", "study", "version", "raw_title").mapInArrow(run, "id string, batch_no int, hash string, study string, version string, title string")


@dataclass(frozen=True)
class Weights:
    """Log-odds for agreement and disagreement of each field (missing values weigh nothing)."""

    hash: tuple[float, float]
    study: tuple[float, float]
    title: tuple[float, float]
    version: tuple[float, float]


_FIELDS = ["hash", "study", "title", "version"]
_NAME = ["study", "title", "version"]


def learn_weights(records: DataFrame) -> Weights:
    """Agreement weights (Fellegi and Sunter) from all records, by counts of pairs without forming them.

    Among records with equal hashes (surely the same file) the share of pairs that agree
    in a field gives m; the sum of squared shares of the field's values gives u. For the
    hash itself m comes from records with equal study, title and version, and u is that
    of the digest, so that equal hashes outweigh any disagreement of names.
    """
    pairs = lambda c: c * (c - 1) / 2
    every = lambda names: F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])).alias("f")
    known = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns]))
    values = known(records.select(every(_FIELDS)).select("f.field", "f.value")).groupBy("field", "value").agg(F.count("*").cast("double").alias("c"))
    chance = {r["field"]: min(0.9, max(1e-9, r["sq"] / r["n"] ** 2)) for r in values.groupBy("field").agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("n")).collect()}  # one row per field

    def agreement(rows: DataFrame, by: list[str]) -> dict[str, float]:
        inner = known(rows).groupBy("field", *by, "value").agg(F.count("*").alias("c"))
        groups = inner.groupBy("field", *by).agg(F.sum("c").alias("n"), F.sum(pairs(F.col("c"))).alias("same"))
        return {r["field"]: (r["same"] + 1) / (r["all"] + 2) for r in groups.groupBy("field").agg(F.sum("same").alias("same"), F.sum(pairs(F.col("n"))).alias("all")).collect()}

    agree = agreement(records.select("hash", every(_NAME)).select("hash", "f.field", "f.value"), ["hash"])
    agree |= agreement(records.select(F.struct(*_NAME).alias("name"), *_NAME, F.lit("hash").alias("field"), F.col("hash").alias("value")).dropna(subset=_NAME).drop(*_NAME), ["name"])

    def odds(field: str) -> tuple[float, float]:
        u = chance.get(field, 1e-9)
        m = max(agree.get(field, 0.5), u)
        return math.log(m / u), math.log(max(1 - m, 1e-3) / (1 - u))

    agreed, differ = odds("hash")
    # other files share a 256-bit digest with probability 2**-256, whatever share of the records are copies
    return Weights((max(agreed, -math.log(CHANCE_HASH)), differ), *(odds(f) for f in _NAME))


#: Records of the backlog for each part of the tables, and parts at least.
PART_RECORDS, LEAST_PARTS = 100_000, 4
#: Generations after which the tables are compacted.
GENERATIONS = 12
#: Links of a batch that are united in one task (some 100 bytes each); more are united by rounds over all executors.
LOCAL_LINKS = 500_000

_TABLES = {
    "keys": "key string, rep string, hash string, study string, title string, version string",
    "members": "id string, batch_no int, rep string, held boolean",
    "mapping": "rep string, root string, at int",
    "classes": "root string, rep string",
}
#: The column by whose digest each table is divided into parts.
_PLACED = {"keys": "key", "members": "id", "mapping": "rep", "classes": "root"}


@dataclass(frozen=True)
class State:
    """What is kept of all history, in a folder: titles, weights and four tables in parts, written one generation per batch.

    ``keys``: key, rep and the fields of a representative; ``members``: id, batch_no, rep, and
    ``held``, whether the file was held already when the record came; ``mapping``: rep and
    the root of its class from generation ``at`` on (the latest counts); ``classes``: the
    representatives of a root. A manifest names the generations that count, so a batch that
    fails leaves no trace, and :func:`open_state` goes on in another session.
    """

    spark: SparkSession
    path: str
    titles: dict[str, int]
    weights: Weights
    parts: int
    generations: tuple[int, ...] = ()

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table, or those of its parts that are named (no others are read)."""
        schema = f"{_TABLES[name]}, part int"
        folders = [f"{self.path}/{name}/g={g}" for g in self.generations]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return (rows if only is None else rows.where(F.col("part").isin(only))).drop("part", "g")

    def place(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def write(self, name: str, rows: DataFrame, generation: int) -> None:
        """Rows as a generation of a table, one file for each part."""
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        placed = rows.select(*columns, self.place(_PLACED[name]).alias("part"))
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/g={generation}")

    def save(self) -> State:
        """Writes the manifest; from then on the state's generations count."""
        text = json.dumps({"titles": self.titles, "weights": asdict(self.weights), "parts": self.parts, "generations": self.generations})
        fs, folder = _files(self.spark, self.path)
        out = fs.create(folder(f"{self.path}/manifest-{max(self.generations, default=0):08d}.json"), True)
        out.write(text.encode())
        out.close()
        return self


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(spark._jsc.hadoopConfiguration()), folder


def open_state(spark: SparkSession, path: str) -> State:
    """The state as of the last batch that was completed."""
    fs, folder = _files(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder(path)) if s.getPath().getName().startswith("manifest-"))
    kept = json.loads("".join(r[0] for r in spark.read.text(f"{path}/{names[-1]}").collect()))
    weights = Weights(**{f: tuple(w) for f, w in kept["weights"].items()})
    return State(spark, path, kept["titles"], weights, kept["parts"], tuple(kept["generations"]))


def _keys(records: DataFrame) -> DataFrame:
    name = F.when(F.col("study").isNotNull(), F.concat_ws("|", F.lit("n"), "study", "title", "version"))
    by_hash = F.when(F.col("hash").isNotNull(), F.concat_ws("|", F.lit("h"), "hash"))
    return records.withColumn("key", F.explode(F.filter(F.array(by_hash, name), lambda k: k.isNotNull())))


def _score(weights: Weights, left: str, right: str) -> Column:
    total = F.lit(0.0)
    for field in _FIELDS:
        agree, differ = getattr(weights, field)
        a, b = F.col(f"{left}.{field}"), F.col(f"{right}.{field}")
        total = total + F.when(a.isNull() | b.isNull(), 0.0).when(a == b, agree).otherwise(differ)
    return total


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of the bipartite ``edges`` (node, key).

    Labels spread over the keys and are followed to their own labels (pointer jumping),
    so the rounds grow with the logarithm of the longest chain.
    """
    edges = checkpointed(edges)
    labels = edges.select("node").distinct().withColumn("root", F.col("node"))
    while True:
        via = edges.join(labels, "node").groupBy("key").agg(F.min("root").alias("low"))
        spread = edges.join(via, "key").groupBy("node").agg(F.min("low").alias("low"))
        near = labels.join(spread, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = checkpointed(near.join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")))
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def united(edges: DataFrame) -> DataFrame:
    """node, root, as of :func:`components`, by union-find in one task for up to LOCAL_LINKS edges."""
    if edges.count() > LOCAL_LINKS:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        nodes: dict[str, None] = {}
        for batch in batches:
            for node, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes[node] = None
                a, b = (find(parent.setdefault(x, x) and x) for x in (node, f"{_KEY}{key}"))
                # nodes come before keys, so the least node is the root
                low, high = (a, b) if (a[:1] == _KEY, a) < (b[:1] == _KEY, b) else (b, a)
                parent[high] = low
        yield pa.RecordBatch.from_arrays([pa.array(list(nodes), pa.string()), pa.array([find(n) for n in nodes], pa.string())], names=["node", "root"])

    return edges.select("node", "key").coalesce(1).mapInArrow(run, "node string, root string")


#: Stands before keys in the union-find mapping.
_KEY = "\0"


def start(records: DataFrame, path: str | None = None, parts: int | None = None) -> State:
    """An empty history in a folder; titles and weights are learned from ``records`` (the backlog, or a first batch)."""
    spark = records.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    titles = learn_titles(records)
    rows = stored(keyed(records, titles), "keyed")
    return State(spark, path, titles, learn_weights(rows), parts or max(LEAST_PARTS, -(-rows.count() // PART_RECORDS))).save()


def _hit(rows: DataFrame, *places: Column) -> list[list[int]]:
    """The parts that rows hit, by each of several places: at most the number of parts."""
    got = rows.agg(*[F.collect_set(p).alias(str(i)) for i, p in enumerate(places)]).first()
    return [sorted(got[str(i)]) for i in range(len(places))]


def add_batch(state: State, batch: DataFrame, threshold: float = 0.0) -> State:
    """The history after ``batch`` (as of :func:`described`).

    Only the parts of the tables that the batch's ids and keys fall into are read, only
    classes hit by it take part in the union, and only rows of the batch and of united
    classes are written, as the next generation. Ids already held are not added again.
    Agreements that score below ``threshold`` are no links.
    """
    generation = max(state.generations, default=0) + 1
    came = stored(keyed(batch, state.titles), "batch")
    (ids,) = _hit(came, state.place("id"))
    records = came.join(state.table("members", ids).select("id"), "id", "left_anti") if state.generations else came
    keys = stored(_keys(records), "batch_keys")
    # within the batch one record stands for a key; others are compared with it
    first = keys.groupBy("key").agg(F.min_by(F.struct("id", *_FIELDS), "id").alias("first"))
    if state.generations:
        (hit,) = _hit(keys, state.place("key"))
        met = state.table("keys", hit).join(keys.select("key").distinct(), "key", "left_semi")
        met = stored(met, "met")
        (reps,) = _hit(met, state.place("rep"))
        current = state.table("mapping", reps).groupBy("rep").agg(F.max_by("root", "at").alias("root"))
        held = met.join(current, "rep", "left").select("key", F.struct(F.coalesce("root", "rep").alias("id"), *_FIELDS).alias("held"))
    else:
        held = first.select("key", F.lit(None).cast(first.schema["first"].dataType).alias("held")).where("false")
    first = first.join(held, "key", "left")
    compared = keys.select("key", F.struct("id", *_FIELDS).alias("r")).join(first, "key")
    linked = lambda other: (F.col("r.id") == F.col(f"{other}.id")) | (_score(state.weights, "r", other) >= threshold)
    ends = F.explode(F.array(F.when(linked("first"), F.struct(F.col("r.id").alias("node"), F.lit(False).alias("old"))), F.when(F.col("held").isNotNull() & linked("held"), F.struct(F.col("held.id").alias("node"), F.lit(True).alias("old"))))).alias("e")
    shared = stored(compared.select("key", ends).where("e is not null").select("key", "e.node", "e.old").distinct(), "links")
    # a key met once, by one record, ties nothing together
    busy = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    roots = stored(united(shared.join(busy, "key", "left_semi")), "roots")
    old = shared.where("old").select("node").distinct()
    touched = old.join(roots, "node")
    moved = touched.where("node <> root")
    met_classes = touched.select(F.col("root").alias("rep"), F.lit(True).alias("met")).distinct()
    new_members = records.join(roots, F.col("id") == F.col("node"), "left").select("id", "batch_no", F.coalesce("root", "id").alias("rep"))
    lead = new_members.groupBy("rep").agg(F.min(F.struct(F.coalesce("batch_no", F.lit(0)), "id"))["id"].alias("lead"))
    new_members = new_members.join(lead, "rep").join(met_classes, "rep", "left").select("id", "batch_no", "rep", (F.coalesce("met", F.lit(False)) | (F.col("lead") != F.col("id"))).alias("held"))
    fresh = first.where("held is null").select("key", F.col("first.id").alias("rep"), *[F.col(f"first.{f}").alias(f) for f in _FIELDS])
    fresh = fresh.join(roots, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("rep"), *_FIELDS)
    state.write("members", new_members, generation)
    state.write("keys", fresh, generation)
    # all representatives of united classes point to the new root
    (from_,) = _hit(moved, state.place("node"))
    others = state.table("classes", from_).join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root").select("rep", F.col("new").alias("root"))
    changed = stored(moved.select(F.col("node").alias("rep"), "root").unionByName(others).distinct(), "moved")
    state.write("mapping", changed.withColumn("at", F.lit(generation)), generation)
    state.write("classes", changed, generation)
    after = replace(state, generations=(*state.generations, generation))
    return compacted(after) if len(after.generations) > GENERATIONS else after.save()


def compacted(state: State) -> State:
    """The same history in one generation: the latest root of each representative, and classes by it."""
    generation = max(state.generations, default=0) + 1
    current = stored(state.table("mapping").groupBy("rep").agg(F.max_by("root", "at").alias("root")).withColumn("at", F.lit(generation)), "current")
    for name, rows in (("keys", state.table("keys")), ("members", state.table("members")), ("mapping", current), ("classes", current)):
        state.write(name, rows, generation)
    after = replace(state, generations=(generation,)).save()
    fs, folder = _files(state.spark, state.path)
    for name in _TABLES:
        for g in state.generations:
            fs.delete(folder(f"{state.path}/{name}/g={g}"), True)
    return after


def classes(state: State) -> DataFrame:
    """id, batch_no, class_id of all records held, and whether their file was ``held`` when they came."""
    current = state.table("mapping").groupBy("rep").agg(F.max_by("root", "at").alias("root"))
    return state.table("members").join(current, "rep", "left").select("id", "batch_no", F.coalesce("root", "rep").alias("class_id"), "held")


def class_sizes(held: DataFrame) -> DataFrame:
    """id, class_id, n_links: one row per record, with the number of others of its class."""
    return held.select("id", "class_id").join(held.groupBy("class_id").agg((F.count("*") - 1).alias("n_links")), "class_id").select("id", "class_id", "n_links")


def load(df: DataFrame, single: int = 5, path: str | None = None) -> State:
    """History of a whole table: the backlog in one step, the last ``single`` batches one by one.

    Titles and weights are learned from the backlog alone.
    """
    records = stored(described(df), "records")
    batches = sorted(r[0] for r in records.select("batch_no").distinct().collect() if r[0] is not None)
    last = batches[len(batches) - single :] if len(batches) > single else []
    backlog = records.where(~F.col("batch_no").isin(last) | F.col("batch_no").isNull()) if last else records
    state = add_batch(start(backlog, path), backlog)
    for number in last:
        state = add_batch(state, records.where(F.col("batch_no") == number))
    return state


def same_file_pairs(held: DataFrame) -> DataFrame:
    """id_a < id_b: all pairs of records of one class. Classes of one record are left out before the join."""
    many = held.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    rows = held.join(many, "class_id", "left_semi").select("class_id", "id")
    other = rows.select("class_id", F.col("id").alias("id_b"))
    return rows.withColumnRenamed("id", "id_a").join(other, "class_id").where("id_a < id_b").select("id_a", "id_b")


def batch_report(held: DataFrame) -> DataFrame:
    """batch_no, n_records, n_held: records of files that an earlier batch, or an earlier id of the same batch, already held when they came."""
    return held.groupBy("batch_no").agg(F.count("*").alias("n_records"), F.count_if("held").alias("n_held"))
