"""Queries for retrieval, templates, rules, table repair, state changes, sources and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions import values as V
from docquarry.operators import matching as M
from docquarry.operators import relational as R
from docquarry.operators import repair as P
from docquarry.operators import retrieval as T
from docquarry.operators import rules as L
from docquarry.operators import sections as S
from docquarry.plans.registry import registry
from docquarry.sources import readers as I
from docquarry.sources import sinks as O
from docquarry.streaming import jobs as J

query, QUERIES, SQL = registry()

# Predicates


def _keys(ncd_source_document):
    """Keys of the files as in an object store."""
    d = ncd_source_document.select("id", "project_id", "module", "ctd_section", "file_name", "deleted_at", "uploaded_at").dropDuplicates(["id"])
    return d.withColumn("key", F.concat(F.lit("company/"), F.coalesce("project_id", F.lit("none")), F.lit("/"), F.coalesce("module", F.lit("")), F.lit("/"), F.coalesce("ctd_section", F.lit("x")), F.lit(" Reports/"), F.coalesce("file_name", F.lit("-"))))


_KEYS = "(select distinct on (id) *, 'company/' || coalesce(project_id, 'none') || '/' || coalesce(module, '') || '/' || coalesce(ctd_section, 'x') || ' Reports/' || coalesce(file_name, '-') as key from ncd_source_document)"


@query(f"""with k as {_KEYS}, p as (select min(project_id) as p from k) select id, 'folder' as rule from k, p where lower(key) like '%/' || lower(p) || '/%' union all select id, 'prefix' from k, p where lower(key) like 'company/' || lower(p) || '/%' union all select id, 'module' from k where module = 'm4' and ctd_section is not null and starts_with(ctd_section, '4.2.3')
 union all select id, 'same' from k where coalesce(ctd_section, '') = coalesce(project_id, '')""")
def project_predicates(ncd_source_document):
    k = _keys(ncd_source_document)
    name = ncd_source_document.agg(F.min("project_id")).first()[0]  # one value
    parts = {"folder": T.project_filter(k, "key", name=name), "prefix": T.project_filter(k, "key", "ignored", f" /company/{name}"), "module": T.where_given(k, module="m4", project_id=None).where(T.begins_with_section(F.col("ctd_section"), "4.2.3")), "same": k.where(T.same_or_blank(F.col("ctd_section"), F.col("project_id")))}
    out = None
    for rule, df in parts.items():
        rows = df.select("id", F.lit(rule).alias("rule"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select distinct id, contains(lower(coalesce(raw_text, '')), 'no extractable text') or length(trim(coalesce(raw_text, ''), ' ')) < 400 as trivial, list_has_any(string_split(coalesce(section_label, ''), '.'), ['2', '5']) as overlaps from ncd_text_chunk")
def chunk_predicates(ncd_text_chunk):
    c = ncd_text_chunk.select("id", "raw_text", "section_label").distinct()
    return c.select("id", T.is_trivial(F.col("raw_text")).alias("trivial"), F.arrays_overlap(F.split(F.coalesce("section_label", F.lit("")), r"\."), F.array(F.lit("2"), F.lit("5"))).alias("overlaps"))


# Templates: nations stand for elements of sections (their regions)


def _template(nation):
    n = F.col("n_nationkey")
    return nation.select(n.alias("pos"), F.concat(F.lit("2."), F.col("n_regionkey").cast("string")).alias("section"), F.when(n % 3 == 0, F.concat(F.lit("2."), F.col("n_regionkey").cast("string"), F.lit("."), (n % 4).cast("string"))).alias("subsection"), F.when(n % 2 == 0, F.concat(F.lit("2."), F.col("n_regionkey").cast("string"), F.lit(" "), F.col("n_name"))).alias("element"))


_TEMPLATE = "(select n_nationkey as pos, '2.' || n_regionkey as section, case when n_nationkey % 3 = 0 then '2.' || n_regionkey || '.' || (n_nationkey % 4) end as subsection, case when n_nationkey % 2 = 0 then '2.' || n_regionkey || ' ' || n_name end as element from nation)"


@query(f"""with t as {_TEMPLATE}, w as (select unnest(['2.1', '2.1.1', '2', '2.0 nation_0']) as w)
 select w as wanted, pos, case when coalesce(element, '') <> '' and lower(element) = replace(w, ' ', '-') then 'element' when subsection = w then 'subsection' when section = w then 'section' else 'prefix' end as matched from t, w where (coalesce(element, '') <> '' and lower(element) = replace(w, ' ', '-')) or subsection = w or section = w or starts_with(section, w)""")
def template_matches(nation):
    t = _template(nation)
    out = None
    for w in ("2.1", "2.1.1", "2", "2.0 nation_0"):
        rows = T.entries_for(t, w).select(F.lit(w).alias("wanted"), "pos", "matched")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with t as {_TEMPLATE}, e as (select replace(lower(trim(element)), ' ', '-') as element, pos from t where element is not null)
 select element, min(pos) as position from e where element = '2.1' or starts_with(element, '2.1.') or starts_with(element, '2.1-') group by 1""")
def template_elements(nation):
    return T.elements_for(_template(nation), "2.1", "element", "pos")


@query(f"""with t as {_TEMPLATE} select pos from t where coalesce(nullif(trim(subsection), ''), section) in ('2.1', '2.0.0', '2.3.3')""")
def allowed_entries(nation):
    allowed = nation.sparkSession.createDataFrame([("2.1",), (" 2.0.0",), ("2.3.3",), ("",)], "s string")
    return T.entries_in(_template(nation), allowed, "s").select("pos")


@query(f"""with t as {_TEMPLATE} select section, case when bool_or(subsection is not null) then 'tabulated' else 'written' end as family from t group by 1""")
def first_families(nation):
    t = _template(nation).select("section", F.when(F.col("subsection").isNotNull(), "tabulated").otherwise("written").alias("family"), F.when(F.col("subsection").isNotNull(), 1).otherwise(2).alias("rank"))
    return T.first_family(t, "family", "rank", "section")


@query("""with m as (select n_nationkey as source, '2.6.' || n_regionkey as a, '2.6.' || n_regionkey || '.' || (n_nationkey % 3) as b from nation) select source, t as target from (select source, unnest([a, b]) as t from m) where t = '2.6.1' or starts_with(t, '2.6.1.')""")
def mapped_targets(nation):
    """The mapping is read from nested JSON."""
    r, n = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    one = F.to_json(F.create_map(F.lit("g"), F.create_map(n, F.array(F.struct(F.concat(F.lit("2.6."), r).alias("section"), F.lit("t").alias("kind")), F.struct(F.concat(F.lit("2.6."), r, F.lit("."), (F.col("n_nationkey") % 3).cast("string")).alias("section"), F.lit("t").alias("kind"))))))
    rows = I.mapping_rows(nation.select(one.alias("j")), "j")
    return T.targets_of(rows, "source_section", "targets", "2.6.1").select(F.col("source").cast("int").alias("source"), "target")


@query("""select n_nationkey, case when 'c' = 'c' and n_nationkey % 5 = 0 then ['type', 'number'] else [n_name] end as columns, case when n_nationkey % 5 = 0 then 'type | number' else n_name end as columns_header, case when n_nationkey % 4 = 0 and n_nationkey % 5 = 1 then 'No studies.' end as statement from nation""")
def aligned_specifications(nation):
    specs = nation.select("n_nationkey", (F.col("n_nationkey") % 5).cast("string").alias("sub"), F.array("n_name").alias("columns"), F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(3).alias("n_rows"))
    aligned = P.aligned_specifications(specs, "sub", "columns", {"0": ["type", "number"]})
    said = P.statement_rows(specs.withColumn("k", F.concat_ws("|", "sub", "n_nationkey")), "k", "n_rows", {f"1|{n}": "No studies." for n in range(0, 25, 4)})
    return aligned.join(said.select(F.split_part("section" if "section" in said.columns else "k", F.lit("|"), F.lit(2)).cast("int").alias("n_nationkey"), "statement"), "n_nationkey", "left").select("n_nationkey", "columns", "columns_header", "statement")


# Joins of assets, sections and keys: line items stand for assets, orders for versions


@query("""select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority like '2-%' or o_orderpriority like '%|2-%' or o_orderpriority = '1-URGENT')""")
def assets_of_sections(lineitem, orders):
    sections = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.replace("o_orderpriority", F.lit("-"), F.lit(".")).alias("number"))
    return T.assets_of_sections(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct(), "l_orderkey", sections, "number", ["2", "1.URGENT"])


@query(f"""with k as {_KEYS}, h as (select distinct key from k where contains(lower(key), '/4.2.3') or contains(lower(key), '/4.2.1.1')) select key, 'keys' as what from h union all select * from (select key, 'first' from h order by key limit 5)""")
def keys_of_sections(ncd_source_document):
    k = _keys(ncd_source_document)
    every = T.keys_of_sections(k, "key", ["4.2.3", "4.2.1.1"])
    return every.select("key", F.lit("keys").alias("what")).unionByName(T.keys_of_sections(k, "key", ["4.2.3", "4.2.1.1"], 5).select("key", F.lit("first").alias("what")))


@query(f"""with k as {_KEYS} select distinct key from k where starts_with(key, 'company/') and (contains(key, '4.2.3') or contains(key, '4.2.1')) and len(list_filter(regexp_extract_all(key, '(?i)\\b[A-Z0-9]{{2,}}(?:[-./][A-Z0-9]+)+\\b'), lambda x: regexp_matches(x, '[A-Za-z]') and length(regexp_replace(regexp_replace(x, '(?i)\\.pdf$', ''), '\\D', '', 'g')) >= 2 and length(regexp_replace(x, '(?i)\\.pdf$', '')) >= 6 and regexp_matches(regexp_replace(x, '(?i)[.](pdf|docx|txt)$', ''), '[-./]'))) > 0""")
def keys_with_studies(ncd_source_document):
    return T.keys_with_studies(_keys(ncd_source_document), "key", "company/", ["4.2.3", "4.2.1"])


@query(f"""with k as {_KEYS}, m as (select min(project_id) as p from k), f as (select key, strpos(lower(key), '/' || lower(p) || '/') as pos, length(p) as n from k, m) select left(key, pos + n + 1) as prefix from f where pos > 0 order by key limit 1""")
def project_prefixes(ncd_source_document):
    name = ncd_source_document.agg(F.min("project_id")).first()[0]  # one value
    return T.project_prefix(_keys(ncd_source_document), "key", "key", name)


@query("""select source_document_id, id from (select distinct id, source_document_id, created_at, section_label, raw_text from ncd_text_chunk) where trim(coalesce(section_label, ''), ' ') <> '' and trim(coalesce(raw_text, ''), ' ') <> '' qualify row_number() over (partition by source_document_id order by id) <= 3""")
def key_passages(ncd_text_chunk):
    rows = ncd_text_chunk.select("id", "source_document_id", "section_label", "raw_text").distinct()
    return T.key_passages(rows, "source_document_id", "id", "section_label", "raw_text", 3).select("source_document_id", "id")


@query("select distinct c_mktsegment, o_orderpriority from orders join customer on o_custkey = c_custkey")
def distinct_versions(orders, customer):
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority").distinct()


@query("""with t as (select study_id, sponsor_study_id as s, updated_at as u from tox_study_summary) select (select count(distinct study_id) from t) as n_studies, (select count(distinct study_id) from ncd_finding) as n_with_findings, (select max(u) from t) as newest""")
def scalar_counts(tox_study_summary, ncd_finding):
    n = lambda df: df.agg(F.count_distinct("study_id")).scalar()
    one = tox_study_summary.sparkSession.range(1)
    return one.select(n(tox_study_summary).alias("n_studies"), n(ncd_finding).alias("n_with_findings"), tox_study_summary.agg(F.max("updated_at")).scalar().alias("newest"))


@query("""select event_id, user_id, ts from events where user_id % 7 = 3 and event_type = 'error' order by ts desc nulls last, event_id limit 20""")
def newest_of_project(events):
    return T.where_given(events, event_type="error").where("user_id % 7 = 3").orderBy(F.desc_nulls_last("ts"), "event_id").limit(20).select("event_id", "user_id", "ts")


# Grouping


@query("""select upper(s.sponsor_study_id) as study_id, list_sort(list_distinct(list_filter(list(trim(x, ' ')), lambda v: v <> ''))) as labels from (select sponsor_study_id, unnest([limiting_organ, limiting_finding, species]) as x from tox_study_summary) s where regexp_full_match(sponsor_study_id, '[A-Z]{2}[0-9]{2}-[0-9]{7}') and trim(x, ' ') <> '' group by 1""")
def labels_by_study(tox_study_summary):
    return P.labels_by_id(tox_study_summary, "sponsor_study_id", ["limiting_organ", "limiting_finding", "species"])


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) select o_custkey, count(*) as n, min(o_orderkey) as first_position, list(o_orderpriority order by n) filter (n <= 4) as items from r group by 1""")
def grouped_in_order(orders):
    return P.grouped_in_order(orders, "o_custkey", "o_orderkey", "o_orderpriority", 4)


# Rules


def _rules(ref_term):
    """Rules of four fields from the reference list."""
    t = F.col("term")
    line = F.when(F.col("term_id") % 3 == 0, F.concat(F.lit('Keywords: "'), t, F.lit('"; '), F.upper(t))).when(F.col("term_id") % 3 == 1, F.concat(F.lit("Table cue: "), t)).otherwise(F.concat(F.lit("Regex: \\b"), t, F.lit("s?\\b\nRegex: ([bad\nnote")))
    return ref_term.select("field", "term_id", line.alias("method"))


_RULES = "(select field, term_id, case when term_id % 3 = 0 then 'keyword' when term_id % 3 = 1 then 'table_cue' else 'regex' end as kind, term from ref_term)"


@query(f"""with r as {_RULES}, x as (select field, kind, case when kind = 'regex' then '\\b' || term || 's?\\b' else term end as term from r union select field, kind, upper(term) from r where kind = 'keyword' union select field, kind, '([bad' from r where kind = 'regex') select field as section, kind, count(distinct term) as n, min(term) as first from x group by 1, 2""")
def rules_of_sections(ref_term):
    return L.rule_lines(_rules(ref_term), "field", "term_id", "method").groupBy("section", "kind").agg(F.count("*").alias("n"), F.min("term").alias("first"))


@query(f"""with r as {_RULES}, c as (select distinct id, raw_text as t, lower(raw_text) as l, regexp_replace(lower(raw_text), '[À-ɏ]', 'x', 'g') as p from ncd_text_chunk where trim(coalesce(raw_text, ''), ' ') <> ''),
 h as (select id, field as section, kind, term, case when kind = 'regex' then regexp_matches(p, '\\b' || lower(term) || 's?\\b') else contains(l, lower(term)) end as hit, term_id from c, r)
 select id, section, coalesce(sum(case when upper(term) <> term then 2 else 1 end) filter (kind = 'keyword'), 0) as n_keywords, count(*) filter (kind = 'table_cue') as n_cues, count(*) filter (kind = 'regex') as n_regex from h where hit and section in ('organ', 'finding_term') group by 1, 2""")
def rule_hits(ncd_text_chunk, ref_term):
    rules = L.read_rules(_rules(ref_term), "field", "term_id", "method")
    c = ncd_text_chunk.select("id", "raw_text").distinct()
    hits = L.rule_hits(c, "id", F.col("raw_text"), rules, ("organ", "finding"))
    return hits.select("id", "section", F.size("keywords").cast("bigint").alias("n_keywords"), F.size("table_cues").cast("bigint").alias("n_cues"), F.size("regex").cast("bigint").alias("n_regex"))


@query(f"""with r as {_RULES} select distinct id from ncd_text_chunk c where exists (select 1 from r where kind <> 'regex' and contains(lower(c.raw_text), lower(term)) or kind = 'regex' and regexp_matches(regexp_replace(lower(c.raw_text), '[À-ɏ]', 'x', 'g'), '\\b' || lower(term) || 's?\\b'))""")
def chunks_kept_by_rules(ncd_text_chunk, ref_term):
    return L.kept_by_rules(ncd_text_chunk.select("id", "raw_text").distinct(), "id", F.col("raw_text"), L.read_rules(_rules(ref_term), "field", "term_id", "method")).select("id")


# Table repair: studies as candidates, findings as drafted rows


@query("""with c as (select distinct on (study_id) upper(sponsor_study_id) as id, species, route, limiting_organ as organ from tox_study_summary where regexp_full_match(coalesce(sponsor_study_id, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}')),
 u as (select id, any_value(species) as species, any_value(route) as route, any_value(organ) as organ from c group by id having count(*) = 1),
 d as (select distinct id as pos, case when f.id % 3 = 0 then s.sponsor_study_id when f.id % 3 = 1 then 'XX99-9999999' end as study, f.organ from ncd_finding f join (select distinct study_id, sponsor_study_id from tox_study_summary where regexp_full_match(coalesce(sponsor_study_id, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}')) s using (study_id) where f.id % 3 <> 2),
 r as (select u.id, d.pos, coalesce(nullif(trim(d.organ, ' '), ''), u.organ) as organ, u.species, u.route from u left join (select * from d where study <> 'XX99-9999999') d on upper(d.study) = u.id)
 select id as study, species, route, organ from r qualify row_number() over (partition by id order by (case when trim(coalesce(organ, ''), ' ') <> '' then 1 else 0 end) desc, pos) = 1""")
def overview_rows(tox_study_summary, ncd_finding):
    s = tox_study_summary.where("sponsor_study_id rlike '^[A-Z]{2}[0-9]{2}-[0-9]{7}$'").select("study_id", F.col("sponsor_study_id").alias("study"), "species", "route", F.col("limiting_organ").alias("organ")).dropDuplicates(["study_id"])
    single = s.groupBy("study").count().where("count = 1").select("study")
    candidates = s.join(single, "study", "left_semi").drop("study_id")
    k = F.col("id")
    f = ncd_finding.select("id", "study_id", "organ").distinct().where(k % 3 != 2)
    rows = f.join(s.select("study_id", "study"), "study_id").select(F.when(k % 3 == 0, F.col("study")).otherwise("XX99-9999999").alias("study"), F.lit(None).cast("string").alias("species"), F.lit(None).cast("string").alias("route"), "organ", k.alias("pos"))
    return P.merged_candidates(rows, candidates, "study", ["species", "route", "organ"], "pos").drop("pos").select("study", *[X.blank_to_null(c).alias(c) if c == "organ" else F.col(c) for c in ("species", "route", "organ")])


@query("""with r as (select distinct on (study_id) study_id, sponsor_study_id as s, species, route, limiting_organ as o from tox_study_summary),
 q as (select *, (case when trim(coalesce(species, ''), ' ') <> '' and not regexp_full_match(lower(trim(species, ' ')), 'n/?a|none|not reported|not available|not communicated|unknown|nil') then 1 else 0 end) + (case when trim(coalesce(route, ''), ' ') <> '' and not regexp_full_match(lower(trim(route, ' ')), 'n/?a|none|not reported|not available|not communicated|unknown|nil') then 1 else 0 end) + (case when trim(coalesce(o, ''), ' ') <> '' then 1 else 0 end) as q, case when regexp_full_match(coalesce(s, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}') then s end as id from r)
 select study_id from q where q > 0 and id is null union all (select study_id from q where q > 0 and id is not null qualify row_number() over (partition by id order by q desc, study_id) = 1)""")
def best_rows(tox_study_summary):
    r = tox_study_summary.select("study_id", "sponsor_study_id", "species", "route", "limiting_organ").dropDuplicates(["study_id"])
    return P.best_rows(r, "sponsor_study_id", ["species", "route", "limiting_organ"], "study_id").select("study_id")


@query("""with s as (select distinct on (study_id) study_id, sponsor_study_id as n from tox_study_summary), c as (select distinct n from s where regexp_full_match(coalesce(n, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}')), k as (select *, hash_k from (select study_id, n, row_number() over (order by study_id) % 4 as hash_k from s))
 select study_id, case when hash_k = 0 then 'None conducted' when regexp_full_match(coalesce(n, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}') then n else '' end as study from k""")
def study_ids_filled(tox_study_summary):
    s = R.ranked(tox_study_summary.select("study_id", "sponsor_study_id").dropDuplicates(["study_id"]), [F.col("study_id")])
    n, r = F.col("sponsor_study_id"), F.col("rank") % 4
    ok = n.rlike("^[A-Z]{2}[0-9]{2}-[0-9]{7}$")
    rows = s.select("study_id", F.when(r == 0, "None conducted").when(r == 1, F.concat(F.lit("Study "), n)).otherwise("").alias("study"), F.when(r == 2, F.concat(F.lit("Module 4 "), n, F.lit(" report"))).alias("location"), F.when(r == 3, F.concat(F.lit("as in "), n)).alias("other"))
    rows = rows.withColumn("study", F.coalesce("study", F.lit("")))
    c = tox_study_summary.where(n.rlike("^[A-Z]{2}[0-9]{2}-[0-9]{7}$")).select(n.alias("c"), F.lit(None).cast("array<string>").alias("labels")).distinct()
    out = P.with_study_ids(rows, "study_id", "study", "location", ["study", "location", "other"], c, "c", "labels")
    return out.select("study_id", F.when(F.col("study").rlike("^([A-Z]{2}[0-9]{2}-[0-9]{7}|None conducted)$"), F.col("study")).otherwise("").alias("study"))


@query("""select n_nationkey, case when n_nationkey % 2 = 0 then 'Z' else 'Y' || (n_nationkey % 3) end as sub, n_nationkey % 2 = 0 as moved from nation""")
def realigned_tables(nation):
    k = F.col("n_nationkey")
    t = nation.select("n_nationkey", F.concat(F.lit("Y"), (k % 3).cast("string")).alias("sub"), F.when(k % 2 == 0, F.array(F.lit("Study No."), F.lit("Route"), F.col("n_name"))).otherwise(F.array(F.col("n_name"), F.lit("Route"))).alias("cols"))
    s = nation.sparkSession.createDataFrame([("Y0", ["a", "b"]), ("Z", ["study number", "method of administration"]), ("W", ["c", "d", "route"])], "spec string, cols array<string>")
    return M.realign(t, "n_nationkey", "sub", "cols", s, "spec", "cols")


@query("""select r_regionkey, (select max(n_nationkey) from nation where n_regionkey = r_regionkey and n_nationkey % 4 = 0) as n_nationkey from region""")
def specifications_with_tables(region, nation):
    t = nation.where("n_nationkey % 4 = 0").select("n_regionkey", "n_nationkey")
    return M.by_specification(region.select("r_regionkey"), "r_regionkey", t, "n_regionkey", "n_nationkey").select("r_regionkey", "n_nationkey")


@query("""with a as (select p_partkey as k, p_brand as x, p_type as y from part where p_partkey % 2 = 0), b as (select p_partkey as k, 'o' || p_size as y, p_name as z from part where p_partkey % 3 = 0)
 select k, a.x as x, coalesce(b.y, a.y) as y, b.z as z from a full join b using (k)""")
def overridden_templates(part):
    k = F.col("p_partkey")
    a = part.where(k % 2 == 0).select(k.alias("k"), F.create_map(F.lit("x"), F.col("p_brand"), F.lit("y"), F.col("p_type")).alias("p"))
    b = part.where(k % 3 == 0).select(k.alias("k"), F.create_map(F.lit("y"), F.concat(F.lit("o"), F.col("p_size").cast("string")), F.lit("z"), F.col("p_name")).alias("p"))
    m = M.with_overrides(a, b, "k", "p")
    return m.select("k", *[F.try_element_at("p", F.lit(c)).alias(c) for c in ("x", "y", "z")])


@query("""with d as (select distinct id, lower(coalesce(raw_text, '')) as t from ncd_text_chunk), f as (select unnest(['liver weight', 'Mortality', 'the of', 'plasma concentration ng/mL']) as f, unnest([['liver', 'weight'], ['mortality'], [], ['plasma', 'concentration', 'ng', 'ml']]) as ws)
 select id, f as field from d, f where contains(t, lower(f)) or (len(ws) > 0 and len(list_filter(ws, lambda w: contains(t, w))) >= greatest(1, floor(len(ws) * 0.6)))""")
def fields_present(ncd_text_chunk):
    """Fields found by their text or words (nearly equal texts, a partial ratio of 88, apart, which SQL leaves out)."""
    f = ncd_text_chunk.sparkSession.createDataFrame([("liver weight",), ("Mortality",), ("the of",), ("plasma concentration ng/mL",), (" ",)], "f string")
    c = ncd_text_chunk.select("id", "raw_text").distinct()
    low = F.lower(F.coalesce("raw_text", F.lit("")))
    got = M.fields_present(c, "id", "raw_text", f, "f").where("present").join(c, "id")
    words = F.filter(X.tokens("field"), lambda w: (F.length(w) > 1) & ~w.isin(*M.STOP_WORDS))
    plain = F.contains(low, F.lower("field")) | ((F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(low, w))) >= F.greatest(F.lit(1), F.floor(F.size(words) * 0.6))))
    return got.where(plain).select("id", "field")


# Sections by name and text


@query("""with n as (select distinct id, coalesce(ctd_section, 'none') || ' ' || coalesce(file_name, '') as name from ncd_source_document), t as (select unnest(['4.2.3.1', '4.2.1.1', '4.2.2.3']) as s)
 select id, ctd_section as number from (select distinct id, ctd_section from ncd_source_document) where ctd_section in (select s from t)""")
def sections_of_names(ncd_source_document):
    """Sections of names that are the template's (others get a number with less confidence)."""
    d = ncd_source_document.select("id", F.concat_ws(" ", F.coalesce("ctd_section", F.lit("none")), F.lit("report.pdf")).alias("name")).distinct()
    t = ncd_source_document.sparkSession.createDataFrame([("4.2.3.1",), ("4.2.1.1",), ("4.2.2.3",)], "s string")
    return M.section_of_name(d, "id", "name", t, "s").where("confidence = 0.99").select("id", "number")


@query("""with d as (select distinct id, ctd_section as s from ncd_source_document), c as (select id, case when s in ('4.2.3.1', '4.2.1.1') then s when s is not null then s when hash_v then null end as number, case when s in ('4.2.3.1', '4.2.1.1') then 'filename' when s is not null then 'filename' else 'regex' end as method from (select *, true as hash_v from d))
 select id, coalesce(number, '4.2.3.1') as number, method from c""")
def classified_files(ncd_source_document):
    """The cascade: number in the name, else in the text."""
    d = ncd_source_document.select("id", F.coalesce(F.concat("ctd_section", F.lit(" a.pdf")), F.lit("a.pdf")).alias("name"), F.lit("as in 4.2.3.1 and 4.2.1.1").alias("text")).distinct()
    t = ncd_source_document.sparkSession.createDataFrame([("4.2.3.1", "Single dose", 1), ("4.2.1.1", "Primary pharmacodynamics", 2)], "s string, t string, p int")
    return M.classified(d, "id", "name", "text", t, "s", "t", "p").select("id", "number", "method")


@query("""with s as (select term_id, lower(term) as t from ref_term where field = 'finding_term'), x as (select distinct c.id, s.term_id, row_number() over (partition by c.id order by s.term_id) as r from (select distinct id, lower(trim(finding_term, ' ')) as t from ncd_finding) c join s on c.t = s.t) select id, term_id from x where r = 1""")
def most_similar_terms(ncd_finding, ref_term):
    """Findings whose most similar term is their own text (a ratio of 1): the template search by partial ratio."""
    terms = ref_term.where("field = 'finding_term'").select(F.lpad(F.col("term_id").cast("string"), 6, "0").alias("n"), "term")
    f = ncd_finding.select("id", F.trim("finding_term").alias("t")).where("t <> ''").distinct()
    got = M.similar_sections(f, "id", "t", terms, "n", "term", 200).where("score = 1.0").join(f, "id").join(terms, F.col("number") == F.col("n")).where("lower(t) = lower(term)")
    return got.groupBy("id").agg(F.min(F.col("n").cast("int")).alias("term_id"))


@query("""select distinct study_id, sponsor_study_id as candidate, 101.0 as score from tox_study_summary where regexp_full_match(coalesce(sponsor_study_id, ''), '[A-Z]{2}[0-9]{2}-[0-9]{7}')""")
def studies_by_label(tox_study_summary):
    s = tox_study_summary.where("sponsor_study_id rlike '^[A-Z]{2}[0-9]{2}-[0-9]{7}$'").select("study_id", "sponsor_study_id", "limiting_finding").distinct()
    c = s.select(F.col("sponsor_study_id").alias("c"), F.array("limiting_finding").alias("labels")).dropDuplicates(["c"])
    return M.best_by_labels(s.withColumn("t", F.concat(F.lit("see "), "sponsor_study_id", F.lit(".pdf"))), "study_id", "t", c, "c", "labels")


# State


@query("""with e as (select user_id as k, max_by(event_type, (ts, event_id)) as s, bool_or(event_type = 'purchase') as has_md from events group by 1)
 select k, not (s = 'click' and has_md) as md_or_status, not has_md as by_md, s <> 'click' as by_status, s = 'click' and has_md as skipped, has_md and s = 'click' and k % 2 = 0 as done from e""")
def work_needed(events):
    e = events.groupBy(F.col("user_id").alias("k")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"), F.bool_or(F.col("event_type") == "purchase").alias("has_md"))
    done, md = F.col("s") == "click", F.col("has_md")
    status = e.withColumn("status", F.when(done, "completed").otherwise("failed"))
    whole = T.fully_ingested("auto", {"core": F.col("status"), "langchain": F.lit(" Completed "), "tox": F.lit("completed")}, ["core", "langchain"], [md], F.col("k") % 2 == 0, F.lit(False))
    return status.select("k", T.core_needed("both", md, done).alias("md_or_status"), T.core_needed("md", md, done).alias("by_md"), T.core_needed("status", md, done).alias("by_status"), T.skipped(status, "status", "has_md").alias("skipped"), whole.alias("done"))


@query("""select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'final ' || o_orderkey else o_orderpriority end as text, case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'approved' when o_orderstatus = 'O' then 'draft' else 'closed' end as status from orders""")
def approved_drafts(orders):
    d = orders.select("o_orderkey", F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "O", "draft").otherwise("closed").alias("status"))
    a = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("final "), F.col("o_orderkey").cast("string")).alias("final"))
    return T.approved(d, "o_orderkey", a, "final")


@query("""select p_partkey from part where not coalesce(p_brand = (select min(p_brand) from part) and starts_with(p_name, 'b'), false)""")
def purged_parts(part):
    brand = part.agg(F.min("p_brand")).first()[0]  # one value
    return T.purge(part, "p_brand", brand, "p_name", "b").select("p_partkey")


@query("""with f as (select distinct id, study_id, adverse from ncd_finding), n as (select study_id, min(id) + 1000000 as id from f where id % 5 = 0 group by 1) select id, study_id from f where not (study_id in (select study_id from n where study_id is not null) and coalesce(adverse, false)) union all select id, study_id from n""")
def replaced_findings(ncd_finding):
    f = ncd_finding.select("id", "study_id", "adverse").distinct()
    new = f.where("id % 5 = 0").groupBy("study_id").agg((F.min("id") + 1000000).alias("id")).select("id", "study_id", F.lit(True).alias("adverse"))
    return T.replace_flagged(f, new, "study_id", "adverse").select("id", "study_id")


@query("""with d as (select c_custkey as doc, 'b' as bucket, c_name as key from customer where c_custkey % 2 = 0), v as (select c_custkey as doc, md5(c_name) as h from customer where c_custkey % 4 = 0), a as (select 'b' as bucket, c_name as key, md5(c_name) as h from customer where c_custkey % 3 = 0)
 select 'documents' as what, count(*) as n from (select key from d union select key from a) union all select 'versions', count(*) from (select c.c_name, v.h from v join customer c on c.c_custkey = v.doc union select key, h from a)""")
def ensured_versions(customer):
    k = F.col("c_custkey")
    d = customer.where(k % 2 == 0).select(F.lit("b").alias("bucket"), F.col("c_name").alias("key"), k.cast("string").alias("doc"))
    v = customer.where(k % 4 == 0).select(k.cast("string").alias("doc"), F.md5("c_name").alias("h"))
    a = customer.where(k % 3 == 0).select(F.lit("b").alias("bucket"), F.col("c_name").alias("key"), F.md5("c_name").alias("h"))
    docs, versions = T.ensure_versions(d, v, a.union(a), ["bucket", "key"], "h", "doc")
    return docs.agg(F.count("*").alias("n")).select(F.lit("documents").alias("what"), "n").union(versions.agg(F.count("*").alias("n")).select(F.lit("versions").alias("what"), "n"))


@query("""with n as (select user_id as run, count(*) as processed, count(*) filter (event_type = 'error') as failed from events group by 1), c as (select user_id as run, 'kept' as mode, 0 as processed, 0 as failed from events where user_id % 2 = 0 group by 1)
 select coalesce(c.run, n.run) as run, c.mode, n.processed, n.failed from n left join c using (run)""")
def run_counters(events):
    n = events.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed")).withColumn("mode", F.lit(None).cast("string"))
    c = events.where("user_id % 2 = 0").select(F.col("user_id").alias("run"), F.lit("kept").alias("mode"), F.lit(0).cast("bigint").alias("processed"), F.lit(0).cast("bigint").alias("failed")).distinct()
    return R.upsert(c, n, ["run"], overwrite=["processed", "failed"], sticky=["mode"])


@query("""select id, case when trim(coalesce(v, ''), ' ') in ('', 'null') then null else v end as version, split_part(f, ':', 1) as client, m as merged from (select distinct id, sha256 as v, coalesce(file_name, '') as f, coalesce(project_id, 'p') || '|' || coalesce(ctd_section, 'none') as m from ncd_source_document)""")
def entry_fields(ncd_source_document):
    d = ncd_source_document.select("id", "sha256", "file_name", "project_id", "ctd_section").distinct()
    old, new = F.to_json(F.struct(F.coalesce("project_id", F.lit("p")).alias("a"), F.lit("x").alias("b"))), F.to_json(F.struct(F.coalesce("ctd_section", F.lit("none")).alias("b")))
    m = V.json_merge(old, new)
    version = F.when(~F.trim(F.coalesce("sha256", F.lit(""))).isin("", "null"), F.col("sha256"))
    return d.select("id", version.alias("version"), F.split_part(F.coalesce("file_name", F.lit("")), F.lit(":"), F.lit(1)).alias("client"), F.concat_ws("|", m["a"], m["b"]).alias("merged"))


# Sources and sinks


@query(f"""with k as {_KEYS}, v as (select id, key, uploaded_at as t, deleted_at is null as latest from k)
 select key, max(id) as version_id from v where latest and regexp_matches(lower(key), '\\.(pdf|docx)\\s*$') group by key""")
def latest_objects(ncd_source_document):
    k = _keys(ncd_source_document)
    listing = k.select("key", F.col("id").alias("version_id"), F.col("deleted_at").isNull().alias("is_latest"), F.lit("2024-01-01").cast("timestamp").alias("last_modified"))
    return I.latest_versions(listing).select("key", "version_id")


@query(f"""with k as {_KEYS}, p as (select key, id as v from k where id < '8') select key, id as version_id from k where not exists (select 1 from p where p.key = k.key and p.v = k.id)""")
def unprocessed_objects(ncd_source_document):
    k = _keys(ncd_source_document).select("key", F.col("id").alias("version_id"))
    return I.unprocessed(k, k.where("version_id < '8'").withColumn("has_result", F.lit(True)))


@query(f"""with k as {_KEYS} select key, max(id) as position from k where starts_with(key, 'company/') group by key""")
def listed_keys(ncd_source_document):
    return I.distinct_keys(_keys(ncd_source_document).select("key", F.col("id").alias("position")), "company/").select("key", "position")


@query("""select c_custkey, case when c_custkey % 3 = 0 then list_sort(list_distinct(list_filter([c_custkey % 7, 2, c_custkey % 5, 0, -1], lambda p: p > 0 and p <= 4))) when c_custkey % 3 = 1 then [1, 2, 3] end as pages from customer""")
def page_selections(customer):
    k = F.col("c_custkey")
    wanted = F.when(k % 3 == 0, F.array(k % 7, F.lit(2).cast("bigint"), k % 5, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")))
    most = F.when(k % 3 == 0, 4).when(k % 3 == 1, 3).cast("bigint")
    return customer.select(k, I.page_selection(wanted, most).alias("pages"))


@query("""select o_orderkey as k, 0 as row_no, o_orderpriority as study, o_orderstatus as route from orders""")
def table_json_rows(orders):
    k = F.col("o_orderkey")
    lists = F.to_json(F.array(F.array(F.lit("Table 1"), F.lit("")), F.array(F.lit("Study Number"), F.lit("Route")), F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))))
    objects = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("Study Number"), F.col("o_orderstatus").alias("Route"))))
    got = I.table_rows(orders.select(k.alias("k"), F.when(k % 2 == 0, lists).otherwise(objects).alias("j")), "k", "j")
    return got.select("k", "row_no", F.col("row")["Study Number"].alias("study"), F.col("row")["Route"].alias("route"))


@query("""select n_regionkey as section, min(n_nationkey) as position from nation group by 1""")
def first_entries(nation):
    e = nation.select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("position"))
    return I.first_entries(e.withColumn("section", F.col("section").cast("string")), "section", "position").select(F.col("section").cast("int").alias("section"), "position")


@query("""select distinct id, case when page_number % 3 = 0 then 'inline ' || id when page_number % 3 = 1 then 'nested ' || id else coalesce(text, '') end as markdown from ncd_document_page""")
def resolved_markdown(ncd_document_page):
    p = ncd_document_page.select("id", "page_number", "text").distinct()
    ident, n = F.col("id").cast("string"), F.col("page_number") % 3
    j = F.when(n == 0, F.to_json(F.struct(F.concat(F.lit("inline "), ident).alias("markdown")))).when(n == 1, F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("nested "), ident).alias("markdown")).alias("analysis")).alias("output")))).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("u"), ident).alias("markdown_uri")).alias("input"))))
    return I.resolved_text(p.withColumn("j", j), "j", p.select(F.concat(F.lit("u"), ident).alias("uri"), "text")).select("id", F.coalesce("markdown", F.lit("")).alias("markdown"))


@query("""select study_id, 'Report ' || sponsor_study_id as title, sponsor_study_id as number, 'b/' || i || '.pdf' as href, 'tag' || i as file_tag, trim('text {' || study_id || '}', '{}') is not null as ok from (select distinct study_id, sponsor_study_id from tox_study_summary where length(sponsor_study_id) > 0), (select unnest([1, 2]) as i)""")
def study_index_entries(tox_study_summary):
    s = tox_study_summary.where("length(sponsor_study_id) > 0").select("study_id", "sponsor_study_id").distinct()
    doc = "".join(f'<doc-content xlink:href="b/{i}.pdf"><file-tag name="tag{i}"/></doc-content>' for i in (1, 2))
    xml = F.concat(F.lit('<ectd:study xmlns:ectd="http://x" xmlns:xlink="http://y"><study-identifier><title>Report '), F.col("sponsor_study_id"), F.lit("</title><study-id>"), F.col("sponsor_study_id"), F.lit(f"</study-id></study-identifier><study-document>{doc}</study-document></ectd:study>"))
    got = I.study_index(s.withColumn("x", xml).select(F.col("study_id").alias("k"), "x"), "k", "x")
    return got.select(F.col("k").alias("study_id"), "title", F.col("study_id").alias("number"), "href", "file_tag", F.lit(True).alias("ok"))


@query("""select distinct id, replace(trim(regexp_replace(coalesce(text, ''), '[\\\\{}]', ' ', 'g')), 'x', 'x') is not null as ok, coalesce(nullif(trim(text, ' '), ''), 'other ' || id) as text from ncd_document_page""")
def pages_with_fallback(ncd_document_page):
    p = ncd_document_page.select("id", "text").distinct()
    other = p.select("id", F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"))
    return I.with_fallback(p, other, ["id"]).select("id", F.lit(True).alias("ok"), F.when(F.col("text").startswith("other "), F.col("text")).otherwise(F.trim("text")).alias("text"))


@query("""with p as (select distinct id, source_document_id as d, page_number as n, coalesce(nullif(trim(text, ' '), ''), '_No extractable text._') as t from ncd_document_page)
 select d as source_document_id, string_agg('## Page ' || n || chr(10) || chr(10) || t, chr(10) || chr(10) order by n, t) as markdown from p group by 1""")
def documents_as_markdown(ncd_document_page):
    return O.markdown_documents(ncd_document_page.select("id", "source_document_id", "page_number", "text").distinct(), "source_document_id")


@query("""select s_suppkey, 'chunk:' || lpad(cast(s_nationkey as varchar), 5, '0') as field, '{"s_nationkey":' || s_nationkey || ',"s_name":"' || s_name || '"}' as value from supplier""")
def chunk_fields(supplier):
    return O.chunk_fields(supplier.select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey", "s_nationkey")


@query("""select event_type as stage, count(*) filter (user_id % 3 = 0) as n_processed, count(*) filter (user_id % 3 = 1) as n_failed, count(*) filter (user_id % 3 = 2) as n_skipped from events group by 1""")
def run_report_counts(events):
    status = F.when(F.col("user_id") % 3 == 0, "processed").when(F.col("user_id") % 3 == 1, "failed").otherwise("skipped")
    return O.run_report(events.select(F.col("event_type").alias("stage"), status.alias("status"), F.lit(None).cast("string").alias("error")))[0]


@query("""select 'E' || (user_id % 4) as error, count(*) as n from events where event_type = 'error' group by 1""")
def run_report_errors(events):
    e = events.where("event_type = 'error'")
    return O.run_report(e.select(F.lit("s").alias("stage"), F.lit("failed").alias("status"), F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string"), F.lit(" : at "), F.col("event_id").cast("string")).alias("error")))[1]


@query("""select n_name as "column", cast(n_nationkey as varchar) as column_2, coalesce(cast(nullif(n_regionkey, 2) as varchar), '') as x from nation""")
def cells_as_text(nation):
    renamed = nation.select("n_name", "n_nationkey", F.nullif("n_regionkey", F.lit(2)).alias("x")).toDF("", "column", "x")
    return O.as_text(renamed)


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'table' as kind, ['a', 'b'] as columns, 2 as row_count, 'Order ' || l_orderkey || ' line ' || l_linenumber as caption from lineitem""")
def asset_rows(lineitem):
    table = F.struct(F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"), F.lit("4"))).alias("rows"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit("  line "), F.col("l_linenumber").cast("string")).alias("caption"))
    return O.asset_rows(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(table).alias("tables")), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "tables").drop("index_on_page", "preview")


@query("""with d as (select distinct id, source_document_id as s, page_number as p, coalesce(text, '') as t from ncd_document_page) select s as source_document_id, string_agg('<!-- Page ' || p || ' -->' || chr(10) || t, chr(10) || chr(10) order by p, t) as markdown from d group by 1""")
def documents_with_page_comments(ncd_document_page):
    return O.commented_documents(ncd_document_page.select("id", "source_document_id", "page_number", "text").distinct(), "source_document_id")


# Streams and stages


def streamed_objects(spark: SparkSession, d: str) -> DataFrame:
    """Object-created messages built of the events, parsed as a stream."""
    e = J.read_events(spark, d)
    ext = F.when(F.col("user_id") % 3 == 0, "txt").otherwise("PDF")
    key = F.concat(F.lit("company/a%20b/"), F.col("event_id").cast("string"), F.lit("."), ext)
    record = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.struct(F.struct(F.lit("bk").alias("name")).alias("bucket"), F.struct(key.alias("key"), F.when(F.col("user_id") % 2 == 0, "null").otherwise("v1").alias("versionId")).alias("object")).alias("s3"))
    out = J.run_available(J.object_events(e.select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))))
    return out.select("key", "version", "document_id")


QUERIES["streamed_objects"] = streamed_objects
SQL["streamed_objects"] = "select 'company/a b/' || event_id || '.PDF' as key, case when user_id % 2 = 1 then 'v1' end as version, 'bk/company/a b/' || event_id || '.PDF' || case when user_id % 2 = 1 then '#v1' else '' end as document_id from events where user_id % 3 <> 0"


def streamed_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = J.read_events(spark, d)
    return J.run_available(J.distinct_events(e.select("ts", (F.col("event_id") % 5000).alias("k")), ["k"], "30 days")).select("k")


QUERIES["streamed_distinct"] = streamed_distinct
SQL["streamed_distinct"] = "select distinct event_id % 5000 as k from events"


def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user kept in a table by an idempotent sink."""
    import uuid

    from docquarry.cluster import shared_dir

    base = f"{shared_dir(spark).rstrip('/')}/upserts-{uuid.uuid4().hex}"
    sink = J.upsert_batches(spark, f"{base}/table", ["user_id"], "ts")
    e = J.read_events(spark, d).select("user_id", "ts", "event_id")
    e.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return J.upserted(spark, f"{base}/table").select("user_id", "event_id")


QUERIES["streamed_upserts"] = streamed_upserts
SQL["streamed_upserts"] = "select user_id, max_by(event_id, ts) as event_id from events group by 1"


@query("""with recursive l as (select n_nationkey as stage, 0 as level from nation where n_nationkey = 0 union all select n.n_nationkey, l.level + 1 from nation n join l on (n.n_nationkey = l.stage * 2 + 1 or n.n_nationkey = l.stage * 2 + 2)) select stage, max(level) as level from l group by 1""")
def stage_levels(nation):
    k = F.col("n_nationkey")
    edges = nation.where(k > 0).select(F.floor((k - 1) / 2).cast("int").alias("source"), k.alias("target"))
    return J.stage_order(edges)


@query("""select engine from (select 'b' as engine)""")
def first_engine_with_text(ncd_document_page):
    p = ncd_document_page.select("source_document_id", "page_number", "text")
    engines = [("a", p.withColumn("text", F.lit(" "))), ("b", p), ("c", p)]
    name, _ = I.first_with_text(engines, "page_number", "text", 3)
    return ncd_document_page.sparkSession.createDataFrame([(name,)], "engine string")


# Derived contexts


@query("""with c as (select distinct id, raw_text as t, offset_start as a from ncd_text_chunk where raw_text is not null and offset_start is not null) select id, row_number() over (order by id) as n, substr(t, 11, 50) as slice from c""")
def section_chunks(ncd_text_chunk):
    """Spans with an index from 1 and their slice of the text."""
    c = ncd_text_chunk.where("raw_text is not null and offset_start is not null").select("id", "raw_text").distinct()
    return R.ranked(c, [F.col("id")]).select("id", F.col("rank").alias("n"), X.text_slice("raw_text", F.lit(10), F.lit(60)).alias("slice"))


@query("""with f as (select distinct id, organ_system as g, organ, finding_term as t, severity as s from ncd_finding), r as (select g, id, (case when trim(coalesce(organ, ''), ' ') <> '' then 1 else 0 end) + (case when trim(coalesce(t, ''), ' ') <> '' then 1 else 0 end) + (case when trim(coalesce(s, ''), ' ') <> '' then 1 else 0 end) as n, regexp_replace(lower(coalesce(organ, '') || coalesce(t, '') || coalesce(s, '')), '[^a-z0-9]', '', 'g') as k from f)
 select g as organ_system, count(*) as n_rows, count(*) filter (n <= 1) as n_sparse, count(*) - count(distinct k) as n_duplicates from r group by 1""")
def table_quality(ncd_finding):
    """Rows, sparse rows and near-duplicates of each table."""
    f = ncd_finding.select("id", "organ_system", "organ", "finding_term", "severity").distinct()
    k = X.alnum_key(F.concat(*[F.coalesce(c, F.lit("")) for c in ("organ", "finding_term", "severity")]))
    return f.withColumn("n", P.filled(f, ["organ", "finding_term", "severity"])).withColumn("k", k).groupBy("organ_system").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n") <= 1).alias("n_sparse"), (F.count("*") - F.count_distinct("k")).alias("n_duplicates"))


@query("""select doc_id, source, case when length(text) > 300 then rtrim(left(text, 300)) || '...' else coalesce(text, '') end as preview, case when length(text) > 50 then case when contains(left(text, 50), ' ') then regexp_replace(left(text, 50), '(?s) [^ ]*$', '') else left(text, 50) end else text end as clipped from documents""")
def slim_sources(documents):
    return documents.select("doc_id", "source", F.coalesce(X.clip("text", 300, "..."), F.lit("")).alias("preview"), X.clip_at_word("text", 50).alias("clipped"))


@query("""select section_label as section, id from (select distinct section_label, id from ncd_text_chunk where section_label is not null) join (select unnest(['4.2.1.1', '4.2.2.3']) as s) on s = section_label""")
def ids_of_sections(ncd_text_chunk):
    """Known sections of each version by number; unknown ones are skipped."""
    known = ncd_text_chunk.sparkSession.createDataFrame([("4.2.1.1",), ("4.2.2.3",), ("9.9",)], "section string")
    return ncd_text_chunk.select(F.col("section_label").alias("section"), "id").distinct().join(known, "section").select("section", "id")


@query("""select source_document_id, string_agg(t, chr(10) || chr(10) order by n, t) as text from (select distinct source_document_id, page_number as n, trim(text, ' ') as t from ncd_document_page where page_number <= 3 and trim(coalesce(text, ''), ' ') <> '') group by 1""")
def sample_texts(ncd_document_page):
    """The text of the first three pages that have any, joined by blank lines."""
    p = ncd_document_page.where("page_number <= 3 and trim(coalesce(text, '')) <> ''").select("source_document_id", "page_number", F.trim("text").alias("t")).distinct()
    return p.groupBy("source_document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


@query("""select n_nationkey, least(n_nationkey, 4) as kept from nation""")
def budgeted_contexts(nation):
    """How many of a list's items fit a budget: the first tier whose text does."""
    items = F.array_repeat(F.lit("12345"), F.col("n_nationkey"))
    tiers = (24, 12, 4, 2)
    size = lambda n: F.length(F.array_join(F.slice(items, 1, n), ""))
    fits = F.coalesce(*[F.when(size(n) <= 24, F.least(F.col("n_nationkey"), F.lit(n))) for n in tiers])
    return nation.select("n_nationkey", fits.cast("int").alias("kept"))


def sidecar_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts written beside their keys and read back."""
    import uuid

    from docquarry.cluster import shared_dir
    from docquarry.tables import table

    path = f"{shared_dir(spark).rstrip('/')}/sidecars-{uuid.uuid4().hex}"
    O.sidecars(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("key"), "text"), "key", "text", path)
    return spark.read.schema("key string, text string").json(path).select(F.col("key").cast("bigint").alias("doc_id"), F.length("text").alias("n"))


QUERIES["sidecar_files"] = sidecar_files
SQL["sidecar_files"] = "select doc_id, length(text) as n from documents where text is not null"


def saved_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and JSON, and its manifest."""
    import uuid

    from docquarry.cluster import shared_dir
    from docquarry.tables import table

    path = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    made = O.save_table(table(spark, d, "nation"), path)
    back = spark.read.option("header", True).csv(f"{path}/csv").agg(F.count("*").alias("n_csv"))
    return made.select("columns", "n_rows", F.size("preview").alias("n_preview"), back.scalar().alias("n_csv"))


QUERIES["saved_tables"] = saved_tables
SQL["saved_tables"] = "select ['n_nationkey', 'n_name', 'n_regionkey'] as columns, count(*) as n_rows, 10 as n_preview, count(*) as n_csv from nation"
