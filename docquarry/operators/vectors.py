"""Vectors: exact nearest rows of a stated query set, weighted means, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.values import cosine_distance
from docquarry.operators.relational import top_per_key


def nearest(queries: DataFrame, query_id: str, rows: DataFrame, row_id: str, vector: str, k: int = 5, most_queries: int = 10_000) -> DataFrame:
    """query_id, row_id, distance, rank: the ``k`` nearest rows by cosine distance, ties by id.

    A stated set of queries against all rows: the queries are sent to every task if they are
    few (checked), and each task keeps its own best k before the shuffle. Zero vectors and
    other lengths are no neighbours.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("__q"))
    n = q.count()
    if n > most_queries:
        raise ValueError(f"{n} queries; more than {most_queries} need the index")
    r = rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("__r"))
    scored = r.join(F.broadcast(q), F.col("row_id") != F.col("query_id")).select("query_id", "row_id", cosine_distance("__q", "__r").alias("distance")).where("distance is not null")
    return top_per_key(scored.withColumn("rank", F.lit(0)), ["query_id"], [F.col("distance"), F.col("row_id")], k).drop("rank")


def mean_vector(df: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """keys, pos, mean: element-wise weighted mean; rows with null or no positive weight are left out."""
    rows = df.select(*keys, weight.cast("double").alias("w"), F.posexplode(vector).alias("pos", "v")).where("w > 0")
    return rows.groupBy(*keys, "pos").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("mean"))


def wrong_dimension(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """key, n_dims of vectors that don't have ``n`` elements (null vectors: null)."""
    return df.select(key, F.when(F.col(vector).isNotNull(), F.size(vector)).alias("n_dims")).where(f"n_dims is null or n_dims <> {n}")
