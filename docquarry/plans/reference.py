"""Queries for the retrieval, profile, status and text operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions import values as V
from docquarry.operators import chunking as K
from docquarry.operators import quality as Q
from docquarry.operators import relational as R
from docquarry.operators import sections as S
from docquarry.operators import studies as P
from docquarry.operators import tables as B
from docquarry.operators import vectors as N
from docquarry.plans.registry import registry, sql_labels
from docquarry.streaming import jobs as J

query, QUERIES, SQL = registry()


# Latest and best rows


@query("select id, source_document_id, created_at from (select distinct id, source_document_id, created_at from ncd_text_chunk) qualify row_number() over (partition by source_document_id order by created_at desc nulls last, id desc) = 1")
def latest_chunk_per_document(ncd_text_chunk):
    return R.latest(ncd_text_chunk.select("id", "source_document_id", "created_at").distinct(), ["source_document_id"], "created_at", "id")


@query("select event_id, user_id, event_type, ts from events qualify row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id desc) = 1")
def latest_event_per_key(events):
    return R.latest(events, ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type", "ts")


@query("select study_id, sponsor_study_id, updated_at from (select distinct study_id, sponsor_study_id, species, updated_at, created_at from tox_study_summary) qualify row_number() over (partition by species order by (case when sponsor_study_id like 'A%' then 0 else 1 end), updated_at desc nulls last, created_at desc, study_id) = 1")
def best_study_per_species(tox_study_summary):
    own = F.when(F.col("sponsor_study_id").startswith("A"), 0).otherwise(1)
    rows = tox_study_summary.select("study_id", "sponsor_study_id", "species", "updated_at", "created_at").distinct()
    return R.top_per_key(rows, ["species"], [own, F.desc_nulls_last("updated_at"), F.desc("created_at"), F.col("study_id")]).select("study_id", "sponsor_study_id", "updated_at")


@query("select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_shipdate, r as round from (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as r from lineitem) order by r, l_suppkey limit 50")
def round_robin_lines(lineitem):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return R.round_robin(lineitem, "l_suppkey", order, 50).select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "round")


@query("""with p as (select doc_id, source, n_chars, text, row_number() over (partition by source order by doc_id) as p from documents),
 o as (select *, row_number() over (partition by source order by case when p <= 2 then p else 2147483647 end, case when p > 2 then coalesce(length(text), 0) else 0 end desc, p) as r from p)
 select doc_id, source, n_chars from o where r <= 6""")
def head_then_longest_documents(documents):
    return R.head_then_longest(documents, "source", "doc_id", "text", 2, 6).select("doc_id", "source", "n_chars")


@query("""with c as (select distinct id, source_document_id, raw_text, created_at from ncd_text_chunk),
 s as (select *, coalesce(sum(coalesce(length(raw_text), 0) + 1) over (partition by source_document_id order by created_at, id rows between unbounded preceding and 1 preceding), 0) as a from c)
 select id, cast(a as bigint) as offset_start, cast(a + coalesce(length(raw_text), 0) as bigint) as offset_end from s""")
def running_offsets(ncd_text_chunk):
    rows = ncd_text_chunk.select("id", "source_document_id", "raw_text", "created_at").distinct()
    return R.running_offsets(rows, "source_document_id", [F.col("created_at"), F.col("id")], "raw_text").select("id", "offset_start", "offset_end")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor((row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1) / 3) + 1 as integer) as chunk_index from lineitem""")
def count_chunks(lineitem):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    return R.count_chunks(lineitem, "l_orderkey", order, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chunk_index")


@query("""with f as (select distinct study_id, id, trim(finding_term, ' ') as v from ncd_finding where trim(finding_term, ' ') <> ''),
 d as (select * from f qualify row_number() over (partition by study_id, lower(v) order by id) = 1),
 r as (select *, row_number() over (partition by study_id order by id) as n from d)
 select study_id, list(v order by n) as items from r where n <= 8 group by study_id""")
def distinct_findings(ncd_finding):
    rows = ncd_finding.select("study_id", "id", F.trim("finding_term").alias("v")).where("v <> ''").distinct()
    return R.ordered_distinct_list(rows, ["study_id"], F.col("v"), [F.col("id")], 8)


@query("""select c_custkey, c_name, row_number() over (order by cast(regexp_extract(c_name, '[0-9]+') as bigint), c_custkey) as rank from customer""")
def natural_order(customer):
    return R.ranked(customer.select("c_custkey", "c_name"), [X.natural_key("c_name"), F.col("c_custkey")])


@query("""select c_custkey, 'Study' || c_custkey || case when c_custkey % 2 = 0 then '-b2' else '-b10' end as name, row_number() over (order by c_custkey) as rank from customer""")
def natural_order_unpadded(customer):
    """Names whose numbers have no leading zeros, so that plain text order differs."""
    name = F.concat(F.lit("Study"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "-b2").otherwise("-b10"))
    return R.ranked(customer.select("c_custkey", name.alias("name")), [X.natural_key("name"), F.col("c_custkey")])


# Joins


@query("""select n.n_name, s.s_name, s.s_acctbal from nation n left join supplier s on s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000""")
def left_join_predicate_in_on(nation, supplier):
    return nation.join(supplier.where("s_acctbal > 5000"), nation.n_nationkey == supplier.s_nationkey, "left").select("n_name", "s_name", "s_acctbal")


@query("select n.n_name, r.r_name, s.s_name, c.c_name from nation n join region r on n.n_regionkey = r.r_regionkey join supplier s on s.s_nationkey = n.n_nationkey left join customer c on c.c_nationkey = n.n_nationkey and c.c_custkey % 100 = s.s_suppkey % 100")
def multi_way_join(nation, region, supplier, customer):
    j = nation.join(region, nation.n_regionkey == region.r_regionkey).join(supplier, nation.n_nationkey == supplier.s_nationkey)
    return j.join(customer, (customer.c_nationkey == nation.n_nationkey) & (F.col("c_custkey") % 100 == F.col("s_suppkey") % 100), "left").select("n_name", "r_name", "s_name", "c_name")


@query("""select distinct study_id, sponsor_study_id from tox_study_summary s where exists (select 1 from ncd_dose_group g where g.study_id = s.study_id)
 or exists (select 1 from ncd_finding f where f.study_id = s.study_id and f.adverse) or exists (select 1 from ncd_exposure_metric e where e.study_id = s.study_id and e.parameter = 'Cmax')""")
def studies_with_data(tox_study_summary, ncd_dose_group, ncd_finding, ncd_exposure_metric):
    rights = [ncd_dose_group, ncd_finding.where("adverse"), ncd_exposure_metric.where("parameter = 'Cmax'")]
    return R.exists_any(tox_study_summary.select("study_id", "sponsor_study_id").distinct(), "study_id", rights)


@query("""select distinct o_orderkey, o_totalprice from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')""")
def semi_join_returned(orders, lineitem):
    return orders.join(lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice").distinct()


_KEYED_CHUNKS = "(select distinct id, lower(trim(source_document_id, ' ' || chr(9) || chr(10) || chr(13))) as source_document_id, page_from, page_to from ncd_text_chunk)"
_PAGES = "(select distinct id as page_id, source_document_id, page_number from ncd_document_page)"


def _chunk_pages(ncd_text_chunk):
    from docquarry.operators.orphans import clean_key

    return ncd_text_chunk.select("id", clean_key(F.col("source_document_id")).alias("source_document_id"), "page_from", "page_to").distinct()


@query(f"select c.id, p.page_id from {_KEYED_CHUNKS} c join {_PAGES} p on p.source_document_id = c.source_document_id and p.page_number between c.page_from and c.page_to")
def chunks_on_pages(ncd_text_chunk, ncd_document_page):
    pages = ncd_document_page.select(F.col("id").alias("page_id"), "source_document_id", "page_number").distinct()
    return R.interval_join(_chunk_pages(ncd_text_chunk), "page_from", "page_to", pages, "page_number", ["source_document_id"]).select("id", "page_id")


@query(f"select c.id, p.page_id from {_KEYED_CHUNKS} c join {_PAGES} p on p.source_document_id = c.source_document_id and (p.page_number is null or c.page_from is null or p.page_number between c.page_from - 1 and coalesce(c.page_to, c.page_from) + 1)")
def chunks_near_pages(ncd_text_chunk, ncd_document_page):
    pages = ncd_document_page.select(F.col("id").alias("page_id"), "source_document_id", "page_number").distinct()
    return R.interval_join(_chunk_pages(ncd_text_chunk), "page_from", "page_to", pages, "page_number", ["source_document_id"], 1, null_meets_all=True).select("id", "page_id")


@query("""with s as (select study_id, any_value(source_chunk_ids) as ids from tox_study_summary group by study_id),
 e as (select study_id, unnest(ids) as cid, generate_subscripts(ids, 1) as pos from s),
 c as (select distinct id, page_from from ncd_text_chunk)
 select study_id, list(page_from order by pos) as pages from e join c on c.id = e.cid group by study_id""")
def chunks_in_array_order(tox_study_summary, ncd_text_chunk):
    rows = tox_study_summary.select("study_id", "source_chunk_ids").dropDuplicates(["study_id"])
    out = R.attach_in_order(rows, "study_id", "source_chunk_ids", ncd_text_chunk.select("id", "page_from").distinct(), "id", ["page_from"], "chunks")
    return out.where("size(chunks) > 0").select("study_id", F.transform("chunks", lambda x: x["page_from"]).alias("pages"))


@query("""select event_id, user_id, coalesce((select max_by(m.event_id, (m.ts, m.event_id)) from events m where m.event_type = 'signup' and m.user_id = e.user_id and m.ts <= e.ts), -1) as signup from events e where event_type <> 'signup'""")
def as_of_signup(events):
    marks = R.latest(events.where("event_type = 'signup'"), ["user_id", "ts"], "ts", "event_id")
    out = S.as_of(events.where("event_type <> 'signup'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "ts", "event_id", "signup")
    return out.select("event_id", "user_id", F.coalesce("signup", F.lit(-1).cast("bigint")).alias("signup"))


@query("""with k as (select s_suppkey, (s_nationkey % 5 + 1) || '.' || (s_suppkey % 4 + 1) || '.' || (s_suppkey % 9 + 1) as sec from supplier),
 m as (select distinct (n_nationkey % 5 + 1) || case when n_nationkey % 2 = 0 then '.' || (n_nationkey % 4 + 1) else '' end as fam from nation)
 select s_suppkey, sec, fam as fam_family from k join m on sec = fam or starts_with(sec, fam || '.')""")
def section_family_join(supplier, nation):
    left = supplier.select("s_suppkey", F.concat_ws(".", F.col("s_nationkey") % 5 + 1, F.col("s_suppkey") % 4 + 1, F.col("s_suppkey") % 9 + 1).alias("sec"))
    fam = nation.select(F.concat((F.col("n_nationkey") % 5 + 1).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("."), (F.col("n_nationkey") % 4 + 1).cast("string"))).otherwise("")).alias("fam"))
    return S.family_join(left, "sec", fam, "fam")


@query("""with a as (select distinct s.study_id, lower(trim(x, ' ')) as k from (select study_id, unnest([sponsor_study_id, json_extract_string(extra_attributes, '$.sponsor_study_id')]) as x from tox_study_summary) s where trim(x, ' ') <> ''),
 b as (select distinct doc_id, lower(trim(study_number, ' ')) as k from documents where trim(study_number, ' ') <> '')
 select distinct study_id, doc_id from a join b using (k)""")
def studies_of_documents(tox_study_summary, documents):
    aliases = [F.col("sponsor_study_id"), F.get_json_object("extra_attributes", "$.sponsor_study_id")]
    return R.alias_join(tox_study_summary, "study_id", aliases, documents, "doc_id", [F.col("study_number")])


@query("""with a as (select distinct id, unnest(list_distinct(regexp_extract_all(lower(finding_term), '[a-z0-9]+'))) as w from ncd_finding),
 b as (select term_id, list_distinct(regexp_extract_all(lower(term), '[a-z0-9]+')) as ws from ref_term where field = 'finding_term'),
 c as (select term_id, len(ws) as n, unnest(ws) as w from b),
 s as (select id, term_id, count(*) / any_value(n) as score from a join c using (w) group by all having count(*) / any_value(n) >= 0.25)
 select * from s qualify row_number() over (partition by id order by score desc, term_id) = 1""")
def token_overlap_terms(ncd_finding, ref_term):
    rows = ncd_finding.select("id", "finding_term").distinct()
    return R.token_overlap(rows, "id", "finding_term", ref_term.where("field = 'finding_term'"), "term_id", "term")


@query("""with n as (select n_nationkey as k, case when n_nationkey = 0 then null else (n_nationkey - 1) // 2 end as p from nation)
 , t as (with recursive r as (select k, k as root, 0 as depth from n where p is null union all select n.k, r.root, r.depth + 1 from n join r on n.p = r.k) select * from r)
 select k, root, depth from t""")
def tree_levels(nation):
    nodes = nation.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2).cast("int")).alias("p"))
    return S.tree_paths(nodes, "k", "p").select("k", "root", "depth")


@query("""select o_orderkey, strftime(cast(o_orderdate as date) + cast(d as integer), '%Y-%m-%d') as day from (select *, unnest(generate_series(0, o_orderkey % 5)) as d from orders)""")
def interval_days(orders):
    rows = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.lit(0).alias("lo"), (F.col("o_orderkey") % 5).cast("int").alias("hi"))
    return R.expand_interval(rows, "lo", "hi", "d").select("o_orderkey", F.date_format(F.date_add("a", F.col("d")), "yyyy-MM-dd").alias("day"))


# Sets, aggregates


@query("select distinct trim(x, ' ') as id from (select study_id as x from tox_study_summary union select study_id from ncd_finding union select study_id from ncd_dose_group union select lower(study_id) from ncd_text_chunk) where trim(x, ' ') <> ''")
def all_study_ids(tox_study_summary, ncd_finding, ncd_dose_group, ncd_text_chunk):
    parts = [tox_study_summary.select("study_id"), ncd_finding.select("study_id"), ncd_dose_group.select("study_id"), ncd_text_chunk.select(F.lower("study_id"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p.toDF("study_id"))
    return every.select(F.trim("study_id").alias("id")).where("id <> ''").distinct()


@query("select organ_system, count(*) as n, count(*) filter (adverse) as n_adverse, count(*) filter (severity = 'mild') as n_mild, count(*) filter (noael_flag) as n_noael from (select distinct * from ncd_finding) group by organ_system")
def findings_by_system(ncd_finding):
    return ncd_finding.distinct().groupBy("organ_system").agg(F.count("*").alias("n"), F.count_if("adverse").alias("n_adverse"), F.count_if(F.col("severity") == "mild").alias("n_mild"), F.count_if("noael_flag").alias("n_noael"))


@query("""with p as (select distinct id, source_document_id, page_number, trim(coalesce(text, '')) as t from ncd_document_page)
 select source_document_id, count(*) as n_pages, count(*) filter (t <> '') as n_text, round_even(count(*) filter (t <> '') / count(*), 3) as coverage, coalesce(max(length(t)) filter (page_number <= 3), 0) <= 50 as needs_ocr from p group by 1""")
def page_coverage(ncd_document_page):
    return Q.page_coverage(ncd_document_page)


@query("""with d as (select distinct on (id) id, file_name, deleted_at, cast(nullif(regexp_extract(regexp_replace(lower(trim(coalesce(module, ''))), '^m *([1-5])$', 'module \\1'), '^([1-5])$|\\bmodule[\\s._-]*([1-5])(?:[^0-9]|$)', ['a', 'b']).a || regexp_extract(regexp_replace(lower(trim(coalesce(module, ''))), '^m *([1-5])$', 'module \\1'), '^([1-5])$|\\bmodule[\\s._-]*([1-5])(?:[^0-9]|$)', ['a', 'b']).b, '') as integer) as m from ncd_source_document),
 n as (select m, file_name, row_number() over (partition by m order by file_name) as r from (select distinct m, file_name from d where file_name is not null))
 select k as module, (select count(*) from d where m = k) as n_files, (select count(*) from d where m = k and deleted_at is not null) as n_deleted, coalesce((select list(file_name order by file_name) from n where m = k and r <= 5), []) as sample from (select unnest([1, 2, 3, 4, 5]) as k)""")
def module_coverage(ncd_source_document):
    return Q.module_coverage(ncd_source_document)


@query("""with t as (select * from ncd_source_document), n as (select count(*) as n from t)
 select c as "column", b as n_blank, d as n_distinct, round(d / n, 6) as unique_ratio from n, (select 'project_id' as c, count(*) filter (trim(coalesce(project_id, '')) = '') as b, count(distinct project_id) as d from t
 union all select 'ctd_section', count(*) filter (trim(coalesce(ctd_section, '')) = ''), count(distinct ctd_section) from t union all select 'sha256', count(*) filter (trim(coalesce(sha256, ''), ' ') = ''), count(distinct sha256) from t)""")
def blank_cells(ncd_source_document):
    return Q.blank_cells(ncd_source_document, ["project_id", "ctd_section", "sha256"])


@query("""with d as (select distinct on (id) id, file_name, ctd_section, uploaded_at, deleted_at, lower(trim(coalesce(module, ''))) as m from ncd_source_document)
 select id, 'warning' as severity, 'name without study number' as message from d where not regexp_matches(file_name, '[A-Za-z]{2}[0-9]{2}[-_ ]?[0-9]{7}')
 union all select id, 'warning', 'no section' from d where trim(coalesce(ctd_section, '')) = ''
 union all select id, 'warning', 'unknown module' from d where not regexp_matches(m, '^(m *)?[1-5]$|\\bmodule[\\s._-]*[1-5](?:[^0-9]|$)')
 union all select id, 'error', 'deleted before upload' from d where deleted_at < uploaded_at""")
def document_issues(ncd_source_document):
    return Q.issues(ncd_source_document)


@query("select split_part(event_type, '_', 1) as kind, count(*) as n, count(distinct user_id) as n_users, round(sum(value), 4) as total from events group by 1")
def counts_by_prefix(events):
    return events.groupBy(F.split_part("event_type", F.lit("_"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


@query("""with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_discount, 0) as a, nullif(l_tax, 0) as b, l_quantity / 50 as c from lineitem)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((coalesce(a * .5, 0) + coalesce(b * .2, 0) + coalesce(c * .3, 0)) / (case when a is null then 0 else .5 end + case when b is null then 0 else .2 end + case when c is null then 0 else .3 end), 6) as confidence from s""")
def weighted_confidence(lineitem):
    m = V.weighted_mean([(F.expr("nullif(l_discount, 0)"), 0.5), (F.expr("nullif(l_tax, 0)"), 0.2), (F.col("l_quantity") / 50, 0.3)])
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(m, 6).alias("confidence"))


@query("""with v as (select label, vec_id % 5 as w, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings where vec_id % 5 > 0)
 select label, cast(pos as integer) as pos, round(sum(cast(v as double) * w) / sum(w), 6) as mean from v group by 1, 2""")
def mean_vector_by_label(embeddings):
    return N.mean_vector(embeddings, ["label"], "embedding", F.col("vec_id") % 5).withColumn("mean", F.round("mean", 6))


@query("""with q as (select vec_id as query_id, cast(embedding as double[]) as a from embeddings where vec_id % 100 = 0), r as (select vec_id as row_id, cast(embedding as double[]) as b from embeddings),
 s as (select query_id, row_id, 1 - list_cosine_similarity(a, b) as distance from q join r on query_id <> row_id)
 select query_id, row_id, round(distance, 6) as distance from s qualify row_number() over (partition by query_id order by distance, row_id) <= 5""")
def vector_top_k(embeddings):
    return N.nearest(embeddings.where("vec_id % 100 = 0"), "vec_id", embeddings, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("""with m as (select distinct on (id) id, study_id, trim(organ, ' ') as o, trim(finding_term, ' ') as t, trim(severity, ' ') as s from ncd_finding where trim(finding_term, ' ') <> ''),
 v as (select study_id, id, case when o <> '' then o || ': ' else '' end || t || case when s <> '' then ' (' || s || ')' else '' end as v from m),
 d as (select * from v qualify row_number() over (partition by study_id, lower(v) order by id) = 1),
 r as (select *, row_number() over (partition by study_id order by id) as n from d)
 select study_id, list(v order by n) as items from r where n <= 6 group by 1""")
def finding_summary(ncd_finding):
    return P.finding_summary(ncd_finding)


@query(f"""with m as (select distinct on (id) * from ncd_exposure_metric where parameter is not null and value is not null),
 t as (select study_id, id, concat_ws(' ', nullif(trim(parameter, ' '), ''), regexp_replace(cast(cast(cast(value as varchar) as decimal(38, 10)) as varchar), '[.]?0+$', ''), nullif(trim(unit, ' '), ''), case when trim(timepoint, ' ') <> '' then '(' || trim(timepoint, ' ') || ')' end) as v from m),
 d as (select * from t qualify row_number() over (partition by study_id, lower(v) order by id) = 1), r as (select *, row_number() over (partition by study_id order by id) as n from d)
 select study_id, list(v order by n) as items from r where n <= 8 group by 1""")
def exposure_summary(ncd_exposure_metric):
    return P.exposure_summary(ncd_exposure_metric)


@query("""with g as (select distinct on (id) id, study_id, coalesce(regexp_matches(lower(name), 'vehicle|control'), false) or coalesce(dose_mg_per_kg = 0, false) as control, case when dose_mg_per_kg <> 0 then regexp_replace(cast(cast(cast(dose_mg_per_kg as varchar) as decimal(38, 10)) as varchar), '[.]?0+$', '') end as dose, trim(coalesce(sex, ''), ' ') as s, n_animals as n from ncd_dose_group),
 x as (select *, case when upper(s) in ('M', 'MALE') then 'Male' when upper(s) in ('F', 'FEMALE') then 'Female' when upper(s) in ('M/F', 'F/M', 'MALE/FEMALE', 'FEMALE/MALE') then 'Male/Female' else s end as label from g), y as (select *, case when label <> '' then label || coalesce(', n=' || n, '') end as sx from x),
 d as (select study_id, string_agg(dose, ', ' order by i) as d from (select study_id, lower(dose) as k, arg_min(dose, id) as dose, min(id) as i from y where dose is not null group by 1, 2) group by 1), e as (select study_id, string_agg(sx, '; ' order by i) as e, count(*) as n from (select study_id, lower(sx) as k, arg_min(sx, id) as sx, min(id) as i from y where sx is not null group by 1, 2) group by 1),
 b as (select study_id, bool_or(control) as c from y group by 1)
 select study_id, case when c then case when d is null then 'Vehicle control' else d || ' (plus vehicle control)' end else coalesce(d, '') end as doses, case when n = 1 then e || ' (1 group)' else coalesce(e, '') end as sexes from b left join d using (study_id) left join e using (study_id)""")
def dose_summary(ncd_dose_group):
    return P.dose_summary(ncd_dose_group)


@query("""with s as (select distinct on (study_id) study_id, sponsor_study_id, species, noael_mg_per_kg from tox_study_summary)
 select s.*, (select count(distinct id) from ncd_exposure_metric e where e.study_id = s.study_id) as n_metrics, (select count(distinct id) from ncd_finding f where f.study_id = s.study_id) as n_findings, (select count(distinct id) from ncd_dose_group g where g.study_id = s.study_id) as n_groups from s""")
def study_profiles(tox_study_summary, ncd_exposure_metric, ncd_finding, ncd_dose_group):
    return P.profiles(tox_study_summary, ncd_exposure_metric, ncd_finding, ncd_dose_group).select("study_id", "sponsor_study_id", "species", "noael_mg_per_kg", "n_metrics", "n_findings", "n_groups")


@query("""with s as (select distinct on (study_id) *, (case when trim(species, ' ') <> '' then 1 else 0 end) + (case when trim(route, ' ') <> '' then 1 else 0 end) + (case when duration_days is not null then 1 else 0 end) + (case when limiting_organ <> '' then 1 else 0 end) + (case when clinical_multiple is not null then 1 else 0 end) as score from tox_study_summary)
 select limiting_finding, study_id, score from s qualify row_number() over (partition by limiting_finding order by score desc, study_id) = 1""")
def most_complete_study(tox_study_summary):
    rows = tox_study_summary.dropDuplicates(["study_id"])
    return P.most_complete(rows, "limiting_finding", ["species", "route", "duration_days", "limiting_organ", "clinical_multiple"], [F.col("study_id")]).select("limiting_finding", "study_id", F.col("score").cast("int").alias("score"))


@query("""with f as (select distinct on (id) * from ncd_finding)
 select study_id, min_by(nullif(trim(organ, ' '), ''), id) filter (trim(organ, ' ') <> '') as organ, min_by(nullif(trim(severity, ' '), ''), id) filter (trim(severity, ' ') <> '') as severity,
 coalesce((select string_agg(v, '; ' order by i) from (select min(id) as i, trim(organ_system, ' ') as v from f g where g.study_id = f.study_id and trim(organ_system, ' ') <> '' group by 2)), '') as organ_system from f group by study_id""")
def merged_findings(ncd_finding):
    return P.merged_records(ncd_finding.dropDuplicates(["id"]), "study_id", ["organ", "severity"], ["organ_system"], "id")


@query("""select sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as class_key, min(doc_id) as first_key, count(*) as n from documents where text is not null group by 1 having count(*) > 1""")
def same_content(documents):
    return Q.same_content(documents, "doc_id", "text")


@query("""with r as (select id, study_id, organ, finding_term, severity, regexp_replace(lower(coalesce(organ, '')), '[^a-z0-9]', '', 'g') || chr(1) || regexp_replace(lower(coalesce(finding_term, '')), '[^a-z0-9]', '', 'g') || chr(1) || regexp_replace(lower(coalesce(severity, '')), '[^a-z0-9]', '', 'g') as a,
  regexp_replace(lower(coalesce(organ, '')), '[^a-z0-9]', '', 'g') as k from (select distinct * from ncd_finding)),
 s as (select *, case when replace(a, chr(1), '') = '' then 'empty' when row_number() over (partition by study_id, a order by id) > 1 then 'duplicate' else 'kept' end as st from r)
 select id, case when st = 'kept' and k <> '' and row_number() over (partition by study_id, k, st order by id) > 1 then 'key_duplicate' else st end as status from s""")
def row_cleaning(ncd_finding):
    return B.clean_rows(ncd_finding.distinct(), ["study_id"], ["organ", "finding_term", "severity"], ["organ"], [F.col("id")]).select("id", "status")


@query("""select distinct o.study_id, s.sha from (select study_id, id, sha256(coalesce(finding_term, '')) as sha from ncd_finding) o join (select sha256(term) as sha from ref_term) s using (sha)""")
def hash_identity(ncd_finding, ref_term):
    a = ncd_finding.select("study_id", F.sha2(F.coalesce("finding_term", F.lit("")), 256).alias("sha"))
    return a.join(ref_term.select(F.sha2("term", 256).alias("sha")), "sha").select("study_id", "sha").distinct()


# Grouping sets, pivots, set operations and samples as Spark has them


@query("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_lines(lineitem):
    g = lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("select study_id from ncd_finding intersect select study_id from ncd_dose_group")
def studies_with_both(ncd_finding, ncd_dose_group):
    return ncd_finding.select("study_id").intersect(ncd_dose_group.select("study_id"))


@query("select study_id from tox_study_summary except select study_id from ncd_finding")
def studies_without_findings(tox_study_summary, ncd_finding):
    return tox_study_summary.select("study_id").subtract(ncd_finding.select("study_id"))


@query("""select user_id, time_bucket(interval '1 hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_windows(events):
    return events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("hour"), "n", "total")


@query("""with f as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
 s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from f)
 select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_windows(events):
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# Mutations


@query("""with n as (select c_custkey, case when c_custkey % 3 = 0 then null else 'new-' || c_custkey end as c_name, c_acctbal + 1 as c_acctbal, case when c_custkey % 2 = 0 then 'CHANGED' end as c_mktsegment from customer where c_custkey % 4 = 0
  union all select c_custkey + 1000000, 'added-' || c_custkey, 0.0, null from customer where c_custkey % 50 = 0)
 select coalesce(c.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, c.c_name) as c_name, case when n.c_custkey is not null then n.c_acctbal else c.c_acctbal end as c_acctbal,
  case when nullif(trim(c.c_mktsegment), '') is null then coalesce(n.c_mktsegment, c.c_mktsegment) else c.c_mktsegment end as c_mktsegment from customer c full join n on c.c_custkey = n.c_custkey""")
def upsert_customers(customer):
    key = F.col("c_custkey")
    changed = customer.where(key % 4 == 0).select(key, F.when(key % 3 != 0, F.concat(F.lit("new-"), key.cast("string"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(key % 2 == 0, "CHANGED").alias("c_mktsegment"))
    added = customer.where(key % 50 == 0).select((key + 1000000).alias("c_custkey"), F.concat(F.lit("added-"), key.cast("string")).alias("c_name"), F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    current = customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return R.upsert(current, changed.unionByName(added), ["c_custkey"], overwrite=["c_acctbal"], sticky=["c_name"], fill=["c_mktsegment"])


@query("""with n as (select l_orderkey, l_partkey, -1.0 as l_quantity from lineitem where l_orderkey % 7 = 0 and l_linenumber = 1)
 select l_orderkey, l_partkey, l_quantity from lineitem where l_orderkey not in (select l_orderkey from n) union all select * from n""")
def replace_order_lines(lineitem):
    new = lineitem.where("l_orderkey % 7 = 0 and l_linenumber = 1").select("l_orderkey", "l_partkey", F.lit(-1.0).alias("l_quantity"))
    return R.replace_children(lineitem.select("l_orderkey", "l_partkey", "l_quantity"), new, "l_orderkey")


@query("""select 'group' as child, count(*) as n from ncd_dose_group where study_id not in (select study_id from tox_study_summary where deleted_at is not null)
 union all select 'finding', count(*) from ncd_finding where study_id not in (select study_id from tox_study_summary where deleted_at is not null)""")
def cascade_delete_counts(tox_study_summary, ncd_dose_group, ncd_finding):
    g, f = R.cascade_delete(tox_study_summary.where("deleted_at is not null"), "study_id", [(ncd_dose_group, "study_id"), (ncd_finding, "study_id")])
    return g.agg(F.count("*").alias("n")).select(F.lit("group").alias("child"), "n").union(f.agg(F.count("*").alias("n")).select(F.lit("finding").alias("child"), "n"))


@query("""select p_partkey, p_name from part union all select s_suppkey, s_name from supplier where s_suppkey not in (select p_partkey from part)""")
def insert_absent_rows(part, supplier):
    return R.insert_absent(part.select("p_partkey", "p_name"), supplier.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name")), ["p_partkey"])


@query("""with f as (select distinct id, severity, organ_system from ncd_finding) select id, 'severity' as field, severity as value from f where severity is not null and severity not in ('minimal', 'mild', 'moderate')
 union all select id, 'organ_system', organ_system from f where organ_system is not null and organ_system not in ('hepatic', 'renal')""")
def domain_violations(ncd_finding):
    return R.violations(ncd_finding.select("id", "severity", "organ_system").distinct(), "id", {"severity": ["minimal", "mild", "moderate"], "organ_system": ["hepatic", "renal"]})


# Text


@query("""with c as (select distinct id, section_label from ncd_text_chunk), b as (select id, regexp_replace(regexp_replace(nullif(trim(section_label, ' '), ''), '^(?:section|sec\\.?)\\s*', '', 'i'), '[.\\s]+$', '') as s from c)
 select id, nullif(case when regexp_matches(s, '^[0-9]{2,6}$') then array_to_string(string_split(s, ''), '.') else s end, '') as section from b""")
def section_labels(ncd_text_chunk):
    return ncd_text_chunk.select("id", "section_label").distinct().select("id", X.section_label("section_label").alias("section"))


@query()
def study_ids_of_all_names(ncd_source_document):
    """Identifiers of every file name in order; ``study_ids_of_names`` has them sorted, with SQL."""
    rows = ncd_source_document.select("id", "file_name").distinct()
    return rows.select("id", X.study_ids(F.replace("file_name", F.lit("_"), F.lit(" "))).alias("ids"))


@query("""with t as (select doc_id, lower(coalesce(text, '')) as t from documents)
 select doc_id, list_filter([case when contains(t, 'liver') or contains(t, 'hepat') or contains(t, 'alt') or contains(t, 'ast') or contains(t, 'bilirubin') then 'hepatotoxicity' end,
  case when contains(t, 'kidney') or contains(t, 'renal') or contains(t, 'creatinine') then 'nephrotoxicity' end, case when contains(t, 'qt') or contains(t, 'ecg') or contains(t, 'herg') then 'qt_prolongation' end,
  case when contains(t, 'lymph') or contains(t, 'cytokine') or contains(t, 'immune') then 'immunotoxicity' end, case when contains(t, 'auc') or contains(t, 'cmax') or contains(t, 'clearance') or contains(t, 't1/2') or contains(t, 'half-life') then 'pharmacokinetics' end], lambda x: x is not null) as topics from t""")
def document_topics(documents):
    return documents.select("doc_id", X.topics("text").alias("topics"))


@query(f"""select distinct id, {sql_labels('t', X.STUDY_TYPES)}[1] as study_type from (select id, lower(replace(replace(coalesce(file_name, ''), '_', ' '), '-', ' ')) as t from ncd_source_document)""")
def study_types(ncd_source_document):
    return ncd_source_document.select("id", X.study_type(F.translate("file_name", "_-", "  ")).alias("study_type")).distinct()


@query("""select doc_id, case when n_chars > 200 then rtrim(left(text, 200)) || ' ...[truncated]' else text end as clipped, greatest(1, n_chars // 4) as tokens, sha256('b:k:' || coalesce(text, '')) as hash from documents where text is not null""")
def clipped_documents(documents):
    rows = documents.where("text is not null")
    return rows.select("doc_id", X.clip("text", 200).alias("clipped"), V.approx_tokens("text").alias("tokens"), V.document_hash(F.lit("b"), F.lit("k"), F.lit(None).cast("string"), "text").alias("hash"))


@query("""select event_id, json_extract_string(props, '$.k') as k, '[' || printf('%.3f', value) || ']' as literal from events""")
def json_and_literals(events):
    return events.select("event_id", V.json_object("props")["k"].alias("k"), V.vector_literal(F.array("value"), 3).alias("literal"))


@query("""select distinct id, case when s in ('M', 'MALE') then 'Male' when s in ('F', 'FEMALE') then 'Female' else sx end as sex from (select id, trim(coalesce(sex, '')) as sx, upper(trim(coalesce(sex, ''))) as s from ncd_dose_group)""")
def sex_labels(ncd_dose_group):
    return ncd_dose_group.select("id", X.sex_label("sex").alias("sex")).distinct()


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)
 select doc_id, cast(line_no as integer) as line_no, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as integer) as "offset" from l""")
def line_offsets(documents):
    return S.lines(documents, "doc_id", "text").select("doc_id", "line_no", "offset")


_NUMBERED_LINE = r"^\s{0,6}(?:(?:Section|SECTION|Sec\.?)\s*)?(\d+(?:\.\d+){1,3}(?:-[A-Za-z0-9]+)?)(.*)$"


@query(rf"""with p as (select distinct on (id) id, text from ncd_document_page), l as (select id, length(text) as len, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from p where text is not null),
 o as (select *, coalesce(sum(length(line) + 1) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as pos, regexp_replace(line, '\r$', '') as x from l),
 m as (select *, regexp_extract(x, '{_NUMBERED_LINE}', 1) as num, regexp_extract(x, '{_NUMBERED_LINE}', 2) as tail from o where regexp_matches(x, '{_NUMBERED_LINE}') and not starts_with(ltrim(line, ' '), '#') and not starts_with(ltrim(line, ' '), '|') and not regexp_matches(line, '\.{{2,}}\s*\d+\s*$')),
 t as (select *, trim(regexp_replace(regexp_replace(tail, '^[\s\-:).]+', ''), '\s{{2,}}', ' ', 'g'), ' ') as title from m), k as (select *, case when regexp_matches(title, '\p{{L}}') then left(title, 200) end as section_title from t where regexp_matches(title, '\p{{L}}') or not regexp_matches(tail, '[\p{{L}}\d]')),
 f as (select * from k qualify row_number() over (partition by id, num order by pos) = 1)
 select id, num as section_number, section_title, cast(pos as integer) as char_start, cast(coalesce(lead(pos) over (partition by id order by pos), len) as integer) as char_end, cast(null as integer) as page_start, cast(null as integer) as page_end from f""")
def section_spans(ncd_document_page):
    return S.section_spans(ncd_document_page.select("id", "text").dropDuplicates(["id"]), "id", "text")


_OUTER = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+$"


@query(rf"""with recursive p as (select distinct on (id) id, source_document_id as d, page_number as n, text from ncd_document_page where source_document_id is not null), s as (select d, n, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) as para, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) as j from p),
 q as (select d, n, regexp_replace(para, '{_OUTER}', '', 'g') as para, row_number() over (partition by d order by n, j) as i from s where regexp_replace(para, '{_OUTER}', '', 'g') <> ''), z as (select d, max(n) as last from p group by 1), c as (select d, count(*) as c from q group by 1),
 r as (select d, cast(0 as bigint) as i, '' as buf, cast(null as integer) as start, cast(null as integer) as f, cast(null as integer) as t, cast(null as varchar) as chunk from c
  union all select q.d, q.i, case when length(buf) + length(para) > 1500 then '' else buf end || para || chr(10) || chr(10), case when length(buf) + length(para) > 1500 or buf = '' then q.n else start end, case when length(buf) + length(para) > 1500 and buf <> '' then start end, case when length(buf) + length(para) > 1500 and buf <> '' then q.n end, case when length(buf) + length(para) > 1500 and buf <> '' then buf end from r join q on q.d = r.d and q.i = r.i + 1),
 e as (select d, i, f, t, chunk from r where chunk is not null union all select r.d, r.i + 1, start, last, buf from r join c on r.d = c.d and r.i = c.c join z on z.d = r.d),
 x as (select d, f, t, chunk, row_number() over (partition by d order by i) as no, regexp_extract_all(chunk, '\b4\.[0-9](?:\.[0-9]+){{0,2}}\b') as ss, lower(chunk) as l from e),
 w as (select *, list_filter(ss, lambda v, k: list_position(ss, v) = k) as sections from x)
 select d as source_document_id, cast(no as integer) as chunk_no, f as page_from, t as page_to, chunk as raw_text, sections, sections[1] as section_label, case when sections[1] is not null then left(trim(split_part(substr(chunk, strpos(chunk, sections[1]) + length(sections[1])), chr(10), 1), ' '), 200) end as section_title,
  {sql_labels('l', [(name, '|'.join(words)) for name, words in X.TOPICS.items()])} as topics from w""")
def packed_chunks(ncd_document_page):
    return K.annotate_chunks(K.pack_pages(ncd_document_page.dropDuplicates(["id"])))


@query(rf"""with recursive d as (select doc_id, regexp_replace(text, '{_OUTER}', '', 'g') as t from documents where text is not null), b as (select doc_id, t, length(t) as n from d where t <> ''),
 w as (select doc_id, 1 as window_no, cast(0 as bigint) as a, {{0}} as z from (select doc_id, t, n, cast(0 as bigint) as a from b)
  union all select doc_id, window_no + 1, a, {{0}} from (select w.doc_id, w.window_no, w.z - 200 as a, b.t, b.n from w join b using (doc_id) where w.z < b.n))
 select doc_id, window_no, regexp_replace(substr(t, a + 1, z - a), '{_OUTER}', '', 'g') as "window" from w join b using (doc_id) where regexp_replace(substr(t, a + 1, z - a), '{_OUTER}', '', 'g') <> ''""".replace("{0}", "case when a + 2000 >= n then n when contains(substr(t, a + 1, 2000), ' ') and length(regexp_extract(substr(t, a + 1, 2000), '(?s)^(.*) [^ ]*$', 1)) > 200 then a + length(regexp_extract(substr(t, a + 1, 2000), '(?s)^(.*) [^ ]*$', 1)) else a + 2000 end"))
def char_windows(documents):
    return K.char_windows(documents, "doc_id", "text", 2000, 200)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), k as (select *, sum(case when regexp_matches(line, '^\\s*\\d+ [A-Z]') then 1 else 0 end) over (partition by doc_id order by n) as s from l where trim(line, ' ') <> ''),
 f as (select *, s - min(s) over (partition by doc_id) + 1 as no from k) select doc_id, cast(no as integer) as segment_no, string_agg(line, chr(10) order by n) as segment from f group by 1, 2""")
def heading_segments(documents):
    return K.split_at_headings(documents, "doc_id", "text", r"^\s*\d+ [A-Z]")


@query("""select n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as markdown from nation group by 1""")
def markdown_by_region(nation):
    return B.markdown_rows(nation, ["n_regionkey"], ["n_nationkey", "n_name"], [F.col("n_nationkey")])


@query("""select n_regionkey, '<table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' order by n_nationkey) || '</table>' as html from nation group by 1""")
def html_by_region(nation):
    return B.html_rows(nation, ["n_regionkey"], ["n_nationkey", "n_name"], [F.col("n_nationkey")])


@query("""with need as (select unnest(['4.2.1', '4.2.2', '4.2.3', '4.2.3.1', '4.2.3.7']) as sec), f as (select file_name || ' ' || coalesce(replace(ctd_section, '.', ''), 'x') as p from ncd_source_document where file_name is not null)
 select sec, (select count(*) from f where len(list_filter(regexp_extract_all(p, '\\d+(?:\\.\\d+)+|\\d{4,}'), lambda t: case when contains(t, '.') then t = sec or starts_with(t, sec || '.') else starts_with(t, replace(sec, '.', '')) end)) > 0) as n_paths from need""")
def sections_in_paths(ncd_source_document):
    need = ncd_source_document.sparkSession.createDataFrame([(s,) for s in ("4.2.1", "4.2.2", "4.2.3", "4.2.3.1", "4.2.3.7")], "sec string")
    path = F.concat_ws(" ", "file_name", F.coalesce(F.replace("ctd_section", F.lit("."), F.lit("")), F.lit("x")))
    return Q.section_gaps(need, "sec", {"paths": (ncd_source_document.where("file_name is not null").select(path.alias("p")), "p", True)}).select("sec", "n_paths")


@query("""with need as (select unnest(['4.2.1', '4.2.2', '4.2.3', '4.2.3.1', '4.2.3.7']) as sec), c as (select regexp_replace(regexp_replace(nullif(trim(section_label, ' '), ''), '^(?:section|sec\\.?)\\s*', '', 'i'), '[.\\s]+$', '') as s from ncd_text_chunk),
 l as (select case when regexp_matches(s, '^[0-9]{2,6}$') then array_to_string(string_split(s, ''), '.') else s end as s from c)
 select sec, (select count(*) from l where s = sec or starts_with(s, sec || '.')) as n_chunks, (select count(*) from ncd_source_document where ctd_section = sec or starts_with(ctd_section, sec || '.')) as n_files,
  (select count(*) from l where s = sec or starts_with(s, sec || '.')) + (select count(*) from ncd_source_document where ctd_section = sec or starts_with(ctd_section, sec || '.')) = 0 as missing from need""")
def section_gaps(ncd_text_chunk, ncd_source_document):
    need = ncd_text_chunk.sparkSession.createDataFrame([(s,) for s in ("4.2.1", "4.2.2", "4.2.3", "4.2.3.1", "4.2.3.7")], "sec string")
    chunks = ncd_text_chunk.select(X.section_label("section_label").alias("s"))
    return Q.section_gaps(need, "sec", {"chunks": (chunks, "s", False), "files": (ncd_source_document, "ctd_section", False)})


# Streams, run over what is available


def _stream(f, sql):
    QUERIES[f.__name__], SQL[f.__name__] = f, sql


def streamed_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    out = J.run_available(J.windowed_counts(J.read_events(spark, d)), "complete")
    return out.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


_stream(streamed_hourly_counts, "select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")


def streamed_latest_status(spark: SparkSession, d: str) -> DataFrame:
    events = J.read_events(spark, d)
    message = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("id")).alias("document"), F.col("event_type").alias("stage"), F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")))
    out = J.run_available(J.latest_stage_status(J.stage_updates(events.select(message.alias("value")))), "complete")
    return out.select("document_id", "stage", "status")


_stream(streamed_latest_status, "select cast(user_id as varchar) as document_id, event_type as stage, 's' || lpad(cast(event_id as varchar), 9, '0') as status from events qualify row_number() over (partition by user_id, event_type order by date_trunc('second', ts) desc, event_id desc) = 1")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
 r as (select user_id, cast(0 as bigint) as i, cast(null as bigint) as event_id, cast([] as double[]) as log, cast(null as integer) as retry_after from e where i = 1
  union all select user_id, i, event_id, case when len(kept) >= 3 then kept else list_append(kept, t) end, case when len(kept) >= 3 then greatest(1, cast(trunc(kept[1] + 86400.0 - t) as integer)) end from (select e.user_id, e.i, e.event_id, e.t, list_filter(r.log, lambda x: x > e.t - 86400.0) as kept from r join e on e.user_id = r.user_id and e.i = r.i + 1))
 select user_id, event_id, retry_after from r where i > 0""")
def rate_limited_events(events):
    return J.limited(events, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_id", 3, 86_400.0)
