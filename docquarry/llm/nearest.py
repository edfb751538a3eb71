"""The k most similar vectors of every vector, by cosine similarity.

Balanced posting lists around centroids: boundary vectors stand in several lists, a graph
over the centroids held in memory finds the lists of a query, and the ratio of distances
prunes them. Every vector is indexed; only the centroids, and the number of lists probed,
are fitted on a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored

#: Bound of the sample on which centroids and probes are fitted (rows).
SAMPLE = 32_768
#: Vectors a list should hold, replicas apart.
LIST = 1_500
#: Lists a vector stands in at most, and the largest ratio of its distance to their centroid and to the nearest.
REPLICAS, REPLICA_RATIO = 4, 1.25
#: Lists a query looks into at most, and the largest ratio of distances.
PROBES, PROBE_RATIO = 48, 1.6
#: Bytes of vectors of one part of a list's members, and of the queries that meet them in one task.
PART, QUERIES = 10_000_000, 15_000_000


@dataclass
class Index:
    """Centroids (unit rows), their graph (ids of near centroids), entry points, probes and estimated members per list."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    probes: int
    parts: np.ndarray
    blocks: np.ndarray
    replicas: int = REPLICAS


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # else squares of tiny or huge values vanish or overflow
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def balanced_centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; lists larger than the mean pay a growing penalty, so that sizes even out."""
    rng = np.random.default_rng(seed)
    centroids, penalty = sample[rng.choice(len(sample), n, replace=False)].copy(), np.zeros(n, np.float32)
    for _ in range(rounds):
        near = np.concatenate([(block @ centroids.T - penalty).argmax(1) for block in np.array_split(sample, len(sample) // 8192 + 1)])
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        centroids[norm > 0] = total[norm > 0] / norm[norm > 0, None]
        empty = np.flatnonzero(norm == 0)
        centroids[empty] = sample[rng.choice(len(sample), len(empty), replace=False)]
        penalty = (0.05 * np.log1p(size / max(1.0, len(sample) / n))).astype(np.float32)
    return centroids


def centroid_graph(centroids: np.ndarray, degree: int = 24, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Near neighbours of each centroid and a few far ones (which keep the graph in one piece); entry points."""
    n = len(centroids)
    near = min(degree, n - 1)
    graph = np.empty((n, near), np.int32)
    for at in range(0, n, 1024):
        sims = centroids[at : at + 1024] @ centroids.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        graph[at : at + 1024] = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else 0
    rng = np.random.default_rng(seed)
    far = np.concatenate([rng.integers(0, n, (n, 3)), ((np.arange(n) + 1) % n)[:, None]], axis=1).astype(np.int32)
    return np.concatenate([graph, far], axis=1), rng.choice(n, min(n, 16), replace=False)


def find_lists(index: Index, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest centroids of each query and their similarities, best first, by beam search over the graph."""
    n, b = len(index.centroids), len(queries)
    k = min(k, n)
    width = min(n, max(2 * k, 24))
    seen = np.zeros((b, n), bool)
    row = np.arange(b)[:, None]
    ids = np.broadcast_to(index.entries, (b, len(index.entries))).copy()
    seen[row, ids] = True
    sims = queries @ index.centroids[index.entries].T
    fresh = np.ones_like(ids, bool)
    while True:
        if ids.shape[1] > width:
            keep = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims, fresh = ids[row, keep], sims[row, keep], fresh[row, keep]
        if not fresh.any():
            break
        step = min(4, ids.shape[1])
        best = np.argpartition(-np.where(fresh, sims, -9), step - 1, axis=1)[:, :step]
        open_ = fresh[row, best]
        fresh[row, best] = False
        more = index.graph[ids[row, best]].reshape(b, -1)
        new = ~seen[row, more] & np.repeat(open_, index.graph.shape[1], axis=1)
        order = np.argsort(more, axis=1, kind="stable")
        again = np.zeros_like(new)
        sorted_ids = more[row, order]
        again[row, order[:, 1:]] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
        new &= ~again
        s = np.full(more.shape, -9, np.float32)
        r, c = np.nonzero(new)
        seen[r, more[r, c]] = True
        s[r, c] = np.einsum("ij,ij->i", queries[r], index.centroids[more[r, c]])
        ids, sims, fresh = np.concatenate([ids, more], 1), np.concatenate([sims, s], 1), np.concatenate([fresh, new], 1)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return ids[row, top], sims[row, top]


def _within(sims: np.ndarray, ratio: float) -> np.ndarray:
    """Which lists are near enough: distance at most ``ratio`` times that to the nearest centroid."""
    d = np.sqrt(np.maximum(0, 2 - 2 * sims))
    return d <= ratio * np.maximum(d[:, :1], 1e-3)


def _all_lists(centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest REPLICAS lists by looking at all centroids (for the sample only)."""
    sims, k = x @ centroids.T, min(REPLICAS, len(centroids))
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    return near, np.take_along_axis(sims, near, 1)


def fit(sample: np.ndarray, total: int, k: int, min_cos: float | None, target: float, seed: int = 7) -> Index:
    """Centroids, graph and the fewest probes that reach ``target`` recall on held-out queries of the sample."""
    n = max(1, min(len(sample) // 8 or 1, math.ceil(total / LIST)))
    centroids = balanced_centroids(sample, n, seed=seed)
    graph, entries = centroid_graph(centroids, seed=seed)
    index = Index(centroids, graph, entries, n, np.ones(n, np.int64), np.ones(n, np.int64))
    lists, sims = zip(*(_all_lists(centroids, block) for block in np.array_split(sample, len(sample) // 2048 + 1)), strict=True)
    lists, sims = np.concatenate(lists), np.concatenate(sims)
    held = _within(sims, REPLICA_RATIO)
    sizes = np.bincount(lists[held], minlength=n) * (total / len(sample))
    width = sample.shape[1] * sample.itemsize
    index.parts = np.maximum(1, np.ceil(sizes * width / PART)).astype(np.int64)
    rng = np.random.default_rng(seed)
    q = rng.choice(len(sample), min(512, len(sample)), replace=False)
    top, best = [], []
    for rows in np.array_split(q, len(q) // 64 + 1):
        exact = sample[rows] @ sample.T
        exact[np.arange(len(rows)), rows] = -9
        m = min(k, exact.shape[1])
        top.append(np.argpartition(-exact, m - 1, axis=1)[:, :m])
        best.append(np.take_along_axis(exact, top[-1], 1))
    top, best = np.concatenate(top), np.concatenate(best)
    wanted = best > -2
    if min_cos is not None and (near := wanted & (best >= min_cos)).sum() >= 100:
        wanted = near
    probed, psims = find_lists(index, sample[q], min(n, PROBES))
    probed = np.where(_within(psims, PROBE_RATIO), probed, -1)
    for p in range(min(2, probed.shape[1]), probed.shape[1] + 1):
        hit = ((np.where(held[top], lists[top], -2)[:, :, :, None] == probed[:, None, None, :p]).any((2, 3)))[wanted]
        index.probes = p
        if not len(hit) or hit.mean() >= target:
            break
    asked = np.bincount(probed[:, : index.probes][probed[:, : index.probes] >= 0], minlength=n) * (total / len(q))
    index.blocks = np.maximum(1, np.ceil(asked * width / QUERIES)).astype(np.int64)
    return index


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _place(index: Index, dim: int):
    """A row per vector, list and cell of the list: whether the cell holds it, and whether it asks there.

    A long list is cut into parts of members and blocks of queries; each block meets each part.
    """
    schema = pa.schema([("list", pa.int32()), ("cell", pa.int32()), ("vid", pa.int64()), ("member", pa.bool_()), ("asks", pa.bool_()), ("vec", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vids, x = batch.column(0).to_numpy(), _unit(_vectors(batch.column(1), dim))
                lists, sims = find_lists(index, x, max(index.probes, index.replicas))
                probe, member = _within(sims, PROBE_RATIO), _within(sims, REPLICA_RATIO)
                probe[:, index.probes :], member[:, index.replicas :] = False, False
                r, c = np.nonzero(probe | member)
                times = (index.parts * index.blocks)[lists[r, c]]
                cell = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                r, c = np.repeat(r, times), np.repeat(c, times)
                chosen, digest = lists[r, c], vids[r].astype(np.uint64)
                parts, blocks = index.parts[chosen], index.blocks[chosen]
                own = member[r, c] & ((digest % parts.astype(np.uint64)).astype(np.int64) == cell // blocks)
                asks = probe[r, c] & (((digest >> np.uint64(20)) % blocks.astype(np.uint64)).astype(np.int64) == cell % blocks)
                kept = own | asks
                r, chosen, cell, own, asks = r[kept], chosen[kept], cell[kept], own[kept], asks[kept]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * dim), pa.array(x[r].ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(vids[r]), pa.array(own), pa.array(asks), vec], schema=schema)

    return run


def _meet(dim: int, k: int, min_cos: float | None):
    """The best ``k`` members of one list (part) for each of its queries."""

    def run(group: pa.Table) -> pa.Table:
        vids, member, asks = (group[c].to_numpy() for c in ("vid", "member", "asks"))
        x = _vectors(group["vec"], dim)
        own, ids = x[member], vids[member]
        x, vids = x[asks], vids[asks]
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(x) if len(ids) else 0, 512):
            q = x[at : at + 512]
            sims = q @ own.T
            sims[vids[at : at + 512, None] == ids[None, :]] = -9
            if min_cos is not None:
                r, c = np.nonzero(sims >= min_cos - 1e-4)
                if len(r) > k * len(q):
                    kept = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    r, c = np.repeat(np.arange(len(q)), kept.shape[1]), kept.ravel()
            else:
                m = min(k, sims.shape[1])
                c = np.argpartition(-sims, m - 1, axis=1)[:, :m].ravel()
                r = np.repeat(np.arange(len(q)), m)
            ok = sims[r, c] > -2
            r, c = r[ok], c[ok]
            exact = np.minimum(1.0, np.einsum("ij,ij->i", q[r].astype(np.float64), own[c].astype(np.float64)))
            out_q.append(vids[at : at + 512][r]), out_v.append(ids[c]), out_s.append(exact)
        cat = lambda parts, t: np.concatenate(parts) if parts else np.array([], t)
        return pa.table({"vid": pa.array(cat(out_q, np.int64), pa.int64()), "other": pa.array(cat(out_v, np.int64), pa.int64()), "cos": pa.array(cat(out_s, np.float64), pa.float64())})

    return run


def usable_vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """key and raw vector, once per key; null, empty, all-zero and not finite vectors are left out."""
    usable = df.select(F.col(key).cast("string").alias("key"), F.col(embedding).cast("array<float>").alias("raw")).where("key is not null and raw is not null").where(
        "size(raw) > 0 and not exists(raw, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(raw, x -> x <> 0)"
    )
    return usable.dropDuplicates(["key"])


def distinct_vectors(once: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, vid) and classes of equal vectors (vid, vec, first k + 1 keys).

    ``vid`` is a 64-bit digest of the vector; where two vectors share one, another salt is taken.
    """
    for salt in range(64):
        digested = once.withColumn("vid", F.xxhash64("raw", F.lit(salt)))
        members = stored(digested, "vectors")
        if members.groupBy("vid").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").isEmpty():
            break
    first = members.withColumn("n", F.row_number().over(W.partitionBy("vid").orderBy("key"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("vid").agg(F.first("raw").alias("vec"), F.array_sort(F.collect_list("key")).alias("keys"))
    return members.select("key", "vid"), classes


def class_neighbours(classes: DataFrame, k: int, min_cos: float | None, target: float) -> DataFrame:
    """vid and near: up to ``k`` structs (ncos, other), the nearest other classes, best first."""
    total = classes.count()
    dim = (classes.select(F.size("vec")).first() or [0])[0]
    if not total:
        return classes.sparkSession.createDataFrame([], "vid bigint, near array<struct<ncos:double,other:bigint>>")
    share = min(1.0, SAMPLE / total)
    sample = classes.select("vec").where(F.pmod(F.xxhash64("vid", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000).limit(2 * SAMPLE).toArrow()
    x = _vectors(sample["vec"], dim) if sample.num_rows else np.array(classes.select("vec").limit(1).collect()[0][0], np.float32)[None, :]
    index = fit(_unit(x), total, k, min_cos, target)
    placed = classes.select("vid", "vec").mapInArrow(_place(index, dim), "list int, cell int, vid bigint, member boolean, asks boolean, vec array<float>")
    met = placed.groupBy("list", "cell").applyInArrow(_meet(dim, k, min_cos), "vid bigint, other bigint, cos double")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("ncos"), "other"))), 1, k)
    if min_cos is not None:
        met = met.where(F.col("cos") >= min_cos)
    return met.groupBy("vid").agg(best.alias("near"))


def neighbours(df: DataFrame, key: str = "chunk_id", embedding: str = "embedding", k: int = 10, min_cos: float | None = None, target: float = 0.97) -> DataFrame:
    """chunk, neighbour, rank, cosine: the ``k`` most similar other keys of every key, ties by smaller key.

    ``min_cos`` leaves out less similar neighbours (the same rows as a later filter).
    Vectors are compared with those of their own length. Equal vectors are searched once: a class of equal vectors brings its first k + 1
    keys, which is all that any result can need. Null, zero and not finite vectors are in
    no row; an empty table gives no rows; other columns are ignored.
    """
    once = stored(usable_vectors(df, key, embedding), "usable")
    sizes = [r[0] for r in once.select(F.size("raw").alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    each = [_neighbours(once.where(F.size("raw") == n) if len(sizes) > 1 else once, k, min_cos, target) for n in sorted(sizes) or [1]]
    return reduce(DataFrame.unionByName, each)


#: Different lengths of vectors in one table at most.
LENGTHS = 16


def _neighbours(once: DataFrame, k: int, min_cos: float | None, target: float) -> DataFrame:
    """As :func:`neighbours`, for usable vectors of one length."""
    members, classes = distinct_vectors(once, k)
    classes = stored(classes, "classes")
    near = class_neighbours(classes, k, min_cos, target)
    other = classes.select(F.col("vid").alias("other"), F.col("keys").alias("other_keys"))
    via = near.select("vid", F.explode("near").alias("n")).select("vid", "n.other", (-F.col("n.ncos")).alias("cosine")).join(other, "other").select("vid", "cosine", F.explode("other_keys").alias("neighbour"))
    # equal vectors first: cosine 1, then the neighbours of the class
    own = classes.where(F.size("keys") > 1).select("vid", F.lit(1.0).alias("cosine"), F.explode("keys").alias("neighbour"))
    listed = own.unionByName(via).groupBy("vid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("ncos"), "neighbour"))), 1, 12 * k).alias("c"))
    lists = listed.select("vid", F.slice("c", 1, k + 1).alias("c"))
    rows = members.join(lists, "vid").select("key", F.slice(F.filter("c", lambda x: x["neighbour"] != F.col("key")), 1, k).alias("c"))
    return rows.select(F.col("key").alias("chunk"), F.posexplode("c").alias("rank", "n")).select("chunk", F.col("n.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("n.ncos")).alias("cosine"))


def mutual_pairs(found: DataFrame) -> DataFrame:
    """chunk_a < chunk_b where each is among the other's neighbours."""
    a = found.select(F.least("chunk", "neighbour").alias("chunk_a"), F.greatest("chunk", "neighbour").alias("chunk_b"), (F.col("chunk") < F.col("neighbour")).alias("up"))
    return a.groupBy("chunk_a", "chunk_b").agg(F.count_if("up").alias("u"), F.count_if(~F.col("up")).alias("d")).where("u > 0 and d > 0").select("chunk_a", "chunk_b")
