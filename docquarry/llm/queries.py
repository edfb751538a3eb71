"""Queries over texts and embeddings, with SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import canonical as C
from docquarry.llm import encode as E
from docquarry.llm import incremental as I
from docquarry.llm import mixture as M
from docquarry.llm import nearest as N
from docquarry.llm import pages as P
from docquarry.llm import split as S
from docquarry.llm import truncated as T
from docquarry.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.encode(table(spark, d, "documents"), "doc_id", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return P.line_kinds(table(spark, d, "ncd_document_page"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return P.paragraphs(table(spark, d, "ncd_document_page"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return N.mutual_pairs(N.neighbours(table(spark, d, "ncd_text_chunk_embedding"), min_cos=0.9, target=1.0))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbours(table(spark, d, "ncd_text_chunk_embedding"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return S.cut_levels(table(spark, d, "ncd_text_chunk"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split(table(spark, d, "ncd_text_chunk"))


def _entered(spark: SparkSession, d: str) -> DataFrame:
    findings, studies = table(spark, d, "ncd_finding"), table(spark, d, "tox_study_summary")
    values = [C.entries(findings, f, "id") for f in ("finding_term", "organ")] + [C.entries(studies, f, "study_id") for f in ("species", "route")]
    return reduce(DataFrame.unionByName, values)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return C.denoted(_entered(spark, d), table(spark, d, "ref_term"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return C.unmatched(_entered(spark, d), table(spark, d, "ref_term"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return I.same_file_pairs(I.classes(I.load(table(spark, d, "ncd_source_document"))))


def p7_batches(spark: SparkSession, d: str) -> DataFrame:
    return I.batch_report(I.classes(I.load(table(spark, d, "ncd_source_document"))))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return T.find(table(spark, d, "documents"))[1].select("doc_id")


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    return T.limits(T.inspect(table(spark, d, "documents")))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return T.shares(*T.find(table(spark, d, "documents")))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p7_found": p7_found, "p7_batches": p7_batches, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_limits": p10_limits, "p10_shares": p10_shares}

_OUTER = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+$"
_NEIGHBOURS = """v as (select chunk_id, any_value(cast(embedding as double[])) as e from ncd_text_chunk_embedding where embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
 s as (select a.chunk_id as chunk, b.chunk_id as neighbour, case when a.e = b.e then 1.0 else list_cosine_similarity(a.e, b.e) end as cosine from v a join v b on a.chunk_id <> b.chunk_id),
 k as (select * from s qualify row_number() over (partition by chunk order by round(cosine, 12) desc, neighbour) <= 10)"""

SQL: dict[str, str] = {
    "p3_found": f"with {_NEIGHBOURS} select a.chunk as chunk_a, a.neighbour as chunk_b from k a join k b on a.chunk = b.neighbour and a.neighbour = b.chunk where a.chunk < a.neighbour and a.cosine >= 0.9",
    "p4_found": rf"""with t as (select distinct on (id) id, raw_text as t from ncd_text_chunk where length(raw_text) > 1500), p as (select id, t, list_transform(string_split_regex(t, '(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+'), lambda x: length(regexp_replace(x, '{_OUTER}', '', 'g'))) as ns from t)
 select id as chunk_id, case when list_max(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda x: length(x))) > 1500 then 'hard' when list_max(ns) <= 1500 then 'paragraph' else 'within' end as cut_level from p""",
}
