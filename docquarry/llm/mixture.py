"""Mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored
from docquarry.llm.encode import TOKENIZERS, encode_text


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, source, digest of the text and n_tokens of every text that isn't blank (one pass)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts: dict[str, int] = {}
            out = []
            for value in batch.column(3).to_pylist():
                if value not in counts:
                    counts[value] = len(encode_text(value, name, folder))
                out.append(counts[value])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], names=[key, "source", "digest", "n_tokens"])

    rows = df.select(F.col(key), F.col(source).cast("string").alias("source"), F.sha2(F.col(text).cast("string"), 256).alias("digest"), F.col(text).cast("string").alias("t")).where("t is not null and t rlike '(?U)\\\\S'")
    return rows.mapInArrow(run, f"`{key}` {kind}, source string, digest string, n_tokens bigint")


def rates(texts: DataFrame, target: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of ``target``: target_share, max_repeat, n_texts, n_tokens, rate, wanted_tokens.

    The rate is target_share x total / tokens, at most max_repeat. Without ``total`` it is
    the largest for which no source is repeated more often than its max_repeat, so that
    every share is met; with a larger one sources that are too small fall short. A source without texts, with a
    null or no share has rate 0 and doesn't bound the total.
    """
    have = texts.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    goal = target.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeat").cast("int").alias("max_repeat")).dropDuplicates(["source"])
    joined = goal.join(have, "source", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0))).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeat") > 0)
    # one row per target source, so a single window over them is small
    least = F.min(F.when(usable, F.col("max_repeat") * F.col("n_tokens") / F.col("target_share"))).over(W.partitionBy())
    rate = F.when(usable, F.least(F.round(F.col("target_share") * F.col("total") / F.col("n_tokens"), 9), F.col("max_repeat").cast("double"))).otherwise(0.0)
    whole = least if total is None else F.lit(float(total))
    return joined.withColumn("total", whole).withColumn("rate", rate).withColumn("wanted_tokens", F.coalesce(F.col("target_share") * F.col("total"), F.lit(0.0))).drop("total")


def mix(df: DataFrame, target: DataFrame, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, copy_no, n_tokens) of ``total`` tokens (see :func:`rates`) and the report per source with its shortfall.

    Every text is emitted floor(rate) times, and once more with the probability of the
    fraction, drawn by a hash of text and seed. A text that stands under several keys
    counts as one, that of the least key among the listed sources, so no text is used more
    often than its source's max_repeat. Blank and null texts and unlisted sources are not used.
    """
    listed = target.select(F.col("source").cast("string").alias("source")).where("source is not null").distinct()
    every = stored(sized(df, key, text, source, name, folder), "sizes")
    texts = every.join(listed, "source", "left_semi").groupBy("digest").agg(F.min_by(F.struct(key, "source", "n_tokens"), F.struct(key, "source")).alias("t")).select("digest", "t.*")
    rate = rates(texts, target, total)
    draw = F.xxhash64("digest", F.lit(seed)) / F.lit(2.0**64) + 0.5
    copies = F.floor("rate").cast("int") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    mixed = texts.join(rate.select("source", "rate"), "source").withColumn("copies", copies).where("copies > 0").select(key, "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens")
    got = mixed.groupBy("source").agg(F.count("*").alias("n_emitted"), F.sum("n_tokens").alias("tokens_emitted"))
    sums = rate.join(got, "source", "left").withColumn("n_emitted", F.coalesce("n_emitted", F.lit(0))).withColumn("tokens_emitted", F.coalesce("tokens_emitted", F.lit(0)))
    report = sums.withColumn("whole", F.sum("tokens_emitted").over(W.partitionBy())).withColumn("actual_share", F.when(F.col("whole") > 0, F.round(F.col("tokens_emitted") / F.col("whole"), 6)).otherwise(0.0)).drop("whole")
    report = report.withColumn("shortfall", F.round(F.greatest(F.lit(0.0), F.col("wanted_tokens") - F.col("tokens_emitted"))).cast("bigint")).drop("wanted_tokens")
    return mixed, report
