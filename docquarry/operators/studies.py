"""Study profiles: child facts aggregated before they are joined, merged records, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import compact_number, sex_label
from docquarry.operators.relational import ordered_distinct_list, top_per_key


def exposure_summary(metrics: DataFrame, most: int = 8) -> DataFrame:
    """study_id, items: "parameter value unit (timepoint)" in order of id, distinct but for case."""
    text = F.concat_ws(" ", F.nullif(F.trim("parameter"), F.lit("")), F.nullif(compact_number("value"), F.lit("")), F.nullif(F.trim("unit"), F.lit("")), F.when(F.trim("timepoint") != "", F.concat(F.lit("("), F.trim("timepoint"), F.lit(")"))))
    rows = metrics.where("parameter is not null and value is not null").dropDuplicates(["id"])
    return ordered_distinct_list(rows, ["study_id"], text, [F.col("id")], most)


def finding_summary(findings: DataFrame, most: int = 6) -> DataFrame:
    """study_id, items: "organ: finding (severity)" in order of id, distinct but for case; findings without a term left out."""
    organ = F.when(F.trim("organ") != "", F.concat(F.trim("organ"), F.lit(": "))).otherwise("")
    text = F.concat(organ, F.trim("finding_term"), F.when(F.trim("severity") != "", F.concat(F.lit(" ("), F.trim("severity"), F.lit(")"))).otherwise(""))
    return ordered_distinct_list(findings.where("trim(finding_term) <> ''").dropDuplicates(["id"]), ["study_id"], text, [F.col("id")], most)


def dose_summary(groups: DataFrame) -> DataFrame:
    """study_id, doses, sexes of the dose groups in order of id.

    Doses are distinct compact numbers; a vehicle or control group, or a dose of 0, adds
    "(plus vehicle control)". Sexes are distinct with their group sizes; a single one gets " (1 group)".
    """
    rows = groups.dropDuplicates(["id"])
    control = F.coalesce(F.lower("name").rlike("vehicle|control"), F.lit(False)) | F.coalesce(F.col("dose_mg_per_kg") == 0, F.lit(False))
    dose = F.when(F.col("dose_mg_per_kg").isNotNull() & (F.col("dose_mg_per_kg") != 0), compact_number("dose_mg_per_kg"))
    sex = F.when(sex_label("sex") != "", F.concat(sex_label("sex"), F.coalesce(F.concat(F.lit(", n="), F.col("n_animals").cast("string")), F.lit(""))))
    doses = ordered_distinct_list(rows, ["study_id"], dose, [F.col("id")], 2**31 - 1).select("study_id", F.array_join("items", ", ").alias("d"))
    sexes = ordered_distinct_list(rows, ["study_id"], sex, [F.col("id")], 2**31 - 1)
    base = rows.groupBy("study_id").agg(F.bool_or(control).alias("control"))
    joined = base.join(doses, "study_id", "left").join(sexes, "study_id", "left")
    d = F.coalesce("d", F.lit(""))
    text = F.when(F.col("control"), F.when(d == "", "Vehicle control").otherwise(F.concat(d, F.lit(" (plus vehicle control)")))).otherwise(d)
    s = F.coalesce(F.array_join("items", "; "), F.lit(""))
    return joined.select("study_id", text.alias("doses"), F.when(F.size("items") == 1, F.concat(s, F.lit(" (1 group)"))).otherwise(s).alias("sexes"))


def profiles(studies: DataFrame, metrics: DataFrame, findings: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per study with the number of its facts and the summaries; every child is aggregated before its join."""
    once = studies.dropDuplicates(["study_id"]).select("study_id", "sponsor_study_id", "species", "route", "noael_mg_per_kg")
    n = lambda df, out: df.dropDuplicates(["id"]).groupBy("study_id").agg(F.count("*").alias(out))
    joined = once.join(n(metrics, "n_metrics"), "study_id", "left").join(n(findings, "n_findings"), "study_id", "left").join(n(groups, "n_groups"), "study_id", "left")
    joined = joined.fillna(0, ["n_metrics", "n_findings", "n_groups"])
    return joined.join(dose_summary(groups), "study_id", "left")


def completeness(*cs: str) -> Column:
    """How many columns hold something."""
    return sum((F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in cs), F.lit(0))


def most_complete(df: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with most filled columns; the first in ``order`` on ties."""
    return top_per_key(df.withColumn("score", completeness(*columns)), [key], [F.desc("score"), *order])


def merged_records(df: DataFrame, key: str, first: list[str], merge: list[str], order: str) -> DataFrame:
    """One row per key: the first non-blank value of some columns, distinct texts of others joined by "; "."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    picked = [F.min_by(blank(c), F.when(blank(c).isNotNull(), F.col(order))).alias(c) for c in first]
    joined = [F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(blank(c).isNotNull(), F.struct(F.col(order), blank(c).alias("v"))))), lambda x: x["v"])), "; ").alias(c) for c in merge]
    return df.groupBy(key).agg(*picked, *joined)
