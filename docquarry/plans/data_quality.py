"""Queries over references and units of the study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.operators import orphans as O
from docquarry.operators import units as U
from docquarry.tables import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents, chunks, studies = (table(spark, d, n) for n in ("ncd_source_document", "ncd_text_chunk", "tox_study_summary"))
    parent = O.parents(documents, "document", "id", "uploaded_at", "deleted_at").unionByName(O.parents(studies, "study", "study_id", "created_at", "deleted_at")).unionByName(O.parents(chunks, "chunk", "id", "created_at"))
    refs = (
        O.references(chunks, "ncd_text_chunk", "source_document_id", "id", "created_at", "document")
        .unionByName(O.references(chunks, "ncd_text_chunk", "study_id", "id", "created_at", "study"))
        .unionByName(O.references(studies, "tox_study_summary", "source_chunk_ids", "study_id", "updated_at", "chunk", array=True))
    )
    return parent, refs


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(*_sides(spark, d)).select("table_name", "field_name", "record_id", "ref_key", "state")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    parent, refs = _sides(spark, d)
    return O.orphan_counts(O.orphans(parent, refs), refs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return U.same_quantity(*(table(spark, d, n) for n in ("ncd_exposure_metric", "ncd_dose_group", "tox_study_summary", "ref_term", "ref_unit")))


def p2_exposures(spark: SparkSession, d: str) -> DataFrame:
    return U.exposure_values(*(table(spark, d, n) for n in ("ncd_exposure_metric", "tox_study_summary", "ref_term", "ref_unit")))


def p2_doses(spark: SparkSession, d: str) -> DataFrame:
    return U.dose_values(*(table(spark, d, n) for n in ("ncd_dose_group", "tox_study_summary", "ref_term", "ref_unit")))


def p2_inferred(spark: SparkSession, d: str) -> DataFrame:
    return U.inferred_units(p2_exposures(spark, d), table(spark, d, "ref_unit"), p2_doses(spark, d))


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_CLEAN = "nullif(trim(lower({0}), " + _BLANKS + "), '')"
_REFS = f"""
parents as (
  select distinct 'document' as parent, {_CLEAN.format('id')} as k, uploaded_at as born, deleted_at as died from ncd_source_document
  union all select distinct 'study', {_CLEAN.format('study_id')}, created_at, deleted_at from tox_study_summary
  union all select distinct 'chunk', {_CLEAN.format('id')}, created_at, null from ncd_text_chunk),
refs as (
  select distinct 'document' as parent, 'ncd_text_chunk' as table_name, 'source_document_id' as field_name, id as record_id, {_CLEAN.format('source_document_id')} as ref_key, created_at as t from ncd_text_chunk
  union all select distinct 'study', 'ncd_text_chunk', 'study_id', id, {_CLEAN.format('study_id')}, created_at from ncd_text_chunk
  union all select distinct 'chunk', 'tox_study_summary', 'source_chunk_ids', study_id, {_CLEAN.format('c')}, t from (select study_id, unnest(source_chunk_ids) as c, updated_at as t from tox_study_summary)),
states as (
  select r.*, case when p.k is null then 'missing' when p.died <= r.t then 'deleted' when p.born > r.t then 'late' end as state
  from refs r left join parents p on p.parent = r.parent and p.k = r.ref_key where r.ref_key is not null)"""

QUERIES = {"p2_found": p2_found, "p2_exposures": p2_exposures, "p2_doses": p2_doses, "p2_inferred": p2_inferred, "p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p6_found": f"with {_REFS} select distinct table_name, field_name, record_id, ref_key, state from states where state is not null",
    "p6_counts": f"""with {_REFS} select table_name, field_name, strftime(t, '%Y-%m') as month, count(*) as n_refs,
      count(*) filter (state = 'missing') as n_missing, count(*) filter (state = 'deleted') as n_deleted, count(*) filter (state = 'late') as n_late
      from states group by all""",
}
