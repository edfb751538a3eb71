"""Queries for what free text, title pages, names and numbers say, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import assembly as A
from docquarry.functions import fuzzy as Z
from docquarry.functions import inference as I
from docquarry.functions import text as X
from docquarry.functions import titles as P
from docquarry.functions import values as V
from docquarry.operators import matching as M
from docquarry.operators import tables as B
from docquarry.plans.registry import registry, sql_labels, sql_text

query, QUERIES, SQL = registry()

# Accented letters are letters at a word's edge; DuckDB's patterns take them for others
_LOW = "regexp_replace(lower(coalesce(text, '')), '[À-ɏ぀-ヿ一-鿿]', 'x', 'g')"
_PLAIN = "regexp_replace(coalesce(text, ''), '[À-ɏ぀-ヿ一-鿿]', 'x', 'g')"


@query(f"""with t as (select doc_id, {_LOW} as t from documents),
 f as (select doc_id, {sql_labels('t', I.ROUTES)} as r, {sql_labels('t', [(s, p) for s, _, p in I.STRAINS])} as strains, {sql_labels('t', I.SPECIES)} as sp, {sql_labels('t', [(of, p) for _, of, p in I.STRAINS])} as ofs from t)
 select doc_id, array_to_string(r, '; ') as routes, case when coalesce(sp[1], ofs[1]) is null then '' when len(strains) > 0 then coalesce(sp[1], ofs[1]) || ' (' || array_to_string(strains, ', ') || ')' else coalesce(sp[1], ofs[1]) end as species from f""")
def routes_and_species(documents):
    return documents.select("doc_id", I.administration("text").alias("routes"), I.species_strain("text").alias("species"))


_COMPACT = "regexp_replace(cast(cast(n as decimal(38, 10)) as varchar), '[.]?0+$', '')"


def _doses(pattern: str, behind: str) -> str:
    unit = "lower(regexp_extract(m, '(?i)(mg|ug|g)\\s*(?:/\\s*kg|intrathecal|it)$', 1))"
    return f"flatten(list_transform(regexp_extract_all(t, {sql_text(pattern)}), lambda m: list_transform(regexp_extract_all(m, '\\d+(?:\\.\\d+)?'), lambda n: {_COMPACT} || ' ' || {unit} || '{behind}')))"


def _first_distinct(items: str) -> str:
    """SQL: a list's distinct items in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@query(f"""with t as (select doc_id, {_PLAIN} as t, lower({_PLAIN}) as l from documents),
 d as (select doc_id, {_doses(I.DOSE_SERIES, '/kg')} || {_doses(I.DOSE_SINGLE, '/kg')} || {_doses(I.DOSE_ABSOLUTE, '')} as ds,
   {' || '.join(f"regexp_extract_all(t, {sql_text(p)}, 1)" for p in I.GROUP_SIZES)} as ns,
   case when regexp_matches(l, '\\bmale\\b') and regexp_matches(l, '\\bfemale\\b') then 'Male/Female' when regexp_matches(l, '\\bmale\\b') then 'Male' when regexp_matches(l, '\\bfemale\\b') then 'Female' else '' end as sex from t),
 e as (select *, list_transform({_first_distinct('ns')}, lambda x: 'n=' || x || '/group') as sizes from d)
 select doc_id, array_to_string({_first_distinct('ds')}, ', ') as doses,
  sex || case when sex = '' or len(sizes) = 0 then '' when len(sizes) = 1 then ', ' else '; ' end || coalesce(array_to_string(sizes[1:3], ', '), '') as group_size from e""")
def doses_and_groups(documents):
    return documents.select("doc_id", I.doses_named("text").alias("doses"), I.group_size("text").alias("group_size"))


def _tidied(x: str) -> str:
    """SQL of the tidying of extracted text (numbers in front twice, as two may follow each other)."""
    number = lambda s: f"regexp_replace({s}, '(^|[;,\\s])\\d{{1,2}}\\s*:\\s*', '\\1 ', 'g')"
    bare = f"regexp_replace(regexp_replace({x}, {sql_text(I._PATHS)}, ' ', 'g'), {sql_text(I._CUT)}, ' ', 'g')"
    return f"trim(regexp_replace({number(number(bare))}, '\\s+', ' ', 'g'), ' ;,')"


def _clauses(x: str) -> str:
    parts = f"string_split(regexp_replace(regexp_replace({_tidied(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\s*;\\s*', chr(1), 'g'), chr(1))"
    noise = "p = '' or contains(lower(p), 'pdf.tables') or contains(lower(p), '[truncated]') or starts_with(lower(p), 'xml files/')"
    return f"list_filter(list_transform({parts}, lambda p: {_tidied('p')}), lambda p: not ({noise}) and length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) >= 5)"


def _clip(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then rtrim(left({x}, {n})) || ' ...[truncated]' else {x} end"


_UNESCAPED = "replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"""with t as (select doc_id, coalesce(text, '') as t, {_UNESCAPED} as u from documents), c as (select *, list_slice({_clauses('u')}, 1, 6) as c from t where regexp_matches(t, '\\S') or t = '' or true),
 f as (select doc_id, trim(t, ' ') = '' as none, coalesce(list_filter(c, lambda x: regexp_matches(lower(x), {sql_text(I.EFFECTS)}))[1], c[1], case when trim(t, ' ') = '' then '' else t end) as f, {sql_labels('lower(t)', I.ENDPOINTS)} as e from c),
 g as (select doc_id, case when none then '' when len(e) = 0 then {sql_text(I.NO_ENDPOINT)} else array_to_string(e, '; ') end as endpoints, trim(regexp_replace(f, '\\s+', ' ', 'g'), ' ') as f from f)
 select doc_id, endpoints, {_clip('f', 320)} as finding from g""")
def endpoints_and_findings(documents):
    return documents.select("doc_id", I.endpoints("text").alias("endpoints"), I.main_finding("text").alias("finding"))


@query(f"""with t as (select doc_id, {_UNESCAPED} as u from documents) select doc_id, {_tidied('u')} as cleaned, u = '' as empty from t""")
def cleaned_texts(documents):
    return documents.select("doc_id", I.clean_extracted("text").alias("cleaned"), (F.coalesce("text", F.lit("")) == "").alias("empty"))


@query(f"""with f as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents),
 c as (select doc_id, i, generate_subscripts(list_slice({_clauses('line')}, 1, 4), 1) as j, unnest(list_slice({_clauses('line')}, 1, 4)) as s from f),
 d as (select * from c qualify row_number() over (partition by doc_id, lower(s) order by i, j) = 1),
 k as (select doc_id, list(s order by i, j) as every, list(s order by i, j) filter (regexp_matches(s, {sql_text(I.NO_CHANGE)})) as neg, list(s order by i, j) filter (not regexp_matches(s, {sql_text(I.NO_CHANGE)}) and regexp_matches(s, {sql_text(I.CHANGE)})) as pos from d group by doc_id),
 m as (select doc_id, array_to_string(case when coalesce(len(neg), 0) + coalesce(len(pos), 0) > 0 then coalesce(neg[1:1], []) || coalesce(pos[1:2], []) else every[1:2] end, '; ') as s from k)
 select doc_id, {_clip("coalesce(s, '')", 900)} as summary from documents left join m using (doc_id)""")
def safety_summaries(documents):
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    return documents.select("doc_id", I.findings_summary(lines).alias("summary"))


@query("""with l as (select doc_id, list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '[·•◦●∙]', '', 'g')) as ls from documents)
 select doc_id, array_to_string(list_filter(list_transform(list_filter(ls, lambda x: not (length(x) >= 25 and length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) < 0.25 * length(x))), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) as block from l""")
def clean_blocks(documents):
    return documents.select("doc_id", I.clean_block("text").alias("block"))


# Title pages: reports whose first pages state what the study table holds

_PAGE_SQL = """select distinct on (study_id) study_id, sponsor_study_id as num, '## Page 1' || chr(10) || 'Study Title: A study in ' || coalesce(species, 'animals') || chr(10) || case when hash(study_id) >= 0 and length(sponsor_study_id) > 0 then 'Study No.: ' || sponsor_study_id || ' ; final' || chr(10) else '' end
  || coalesce('Species/Strain | ' || species || chr(10), '') || coalesce('Route:  ' || route || chr(10), '') || 'Testing Facility: Ellmoor Laboratories Ltd' || chr(10) || '| a | b |' || chr(10) || '## Page 2' || chr(10) || 'Conducted in compliance with good laboratory practice.' || chr(10) || '## Page 4' || chr(10) || 'Route: unseen' as md,
  'Module 4/' || coalesce(limiting_organ, 'x') || '/4.2.1.' || (coalesce(duration_days, 0) % 5 + 1) || ' Reports of ' || coalesce(route, 'none') || '/' || coalesce(sponsor_study_id, 'report') || ' final report.pdf' as key from tox_study_summary"""


def _pages(tox_study_summary):
    s = tox_study_summary.dropDuplicates(["study_id"])
    c, nl = F.col, F.lit("\n")
    line = lambda *parts: F.coalesce(F.concat(*parts, nl), F.lit(""))
    number = F.when(F.length("sponsor_study_id") > 0, F.concat(F.lit("Study No.: "), c("sponsor_study_id"), F.lit(" ; final\n"))).otherwise("")
    md = F.concat(F.lit("## Page 1\nStudy Title: A study in "), F.coalesce("species", F.lit("animals")), nl, number, line(F.lit("Species/Strain | "), c("species")), line(F.lit("Route:  "), c("route")), F.lit("Testing Facility: Ellmoor Laboratories Ltd\n| a | b |\n## Page 2\nConducted in compliance with good laboratory practice.\n## Page 4\nRoute: unseen"))
    key = F.concat(F.lit("Module 4/"), F.coalesce("limiting_organ", F.lit("x")), F.lit("/4.2.1."), (F.coalesce("duration_days", F.lit(0)) % 5 + 1).cast("string"), F.lit(" Reports of "), F.coalesce("route", F.lit("none")), F.lit("/"), F.coalesce("sponsor_study_id", F.lit("report")), F.lit(" final report.pdf"))
    return s.select("study_id", c("sponsor_study_id").alias("num"), md.alias("md"), key.alias("key"))


_SPECIES_CASE = "case " + " ".join(f"when contains(lower(body), {sql_text(n)}) then {sql_text(n.title())}" for n in P.SPECIES_NAMES) + " else '' end"
_ROUTE_CASE = "case " + " ".join(f"when contains(lower(body), {sql_text(n)}) then {sql_text(n)}" for n in P.ROUTE_NAMES) + " else '' end"


@query(f"""with p as ({_PAGE_SQL}), b as (select *, replace(replace(replace(left(md, strpos(md, chr(10) || '## Page 4') - 1), '## Page 1' || chr(10), ''), '| a | b |' || chr(10), ''), '## Page 2' || chr(10), chr(10)) as body, nullif(regexp_extract(key, '4\\.2\\.1\\.[1-4]'), '') as sec from p),
 v as (select *, regexp_extract(body, '(?m)^Species/Strain \\| ([^|\\n]+)', 1) as sp, regexp_extract(body, '(?m)^Route:\\s*([^|\\n]+)', 1) as ro from b)
 select study_id, coalesce(nullif(num, ''), 'DOC-000-00000000') as study_number, 'Sponsor study #: ' || coalesce(nullif(num, ''), 'DOC-000-00000000') as display, coalesce(nullif(trim(regexp_replace(sp, '\\s+', ' ', 'g')), ''), {_SPECIES_CASE}) as test_system,
  coalesce(nullif(trim(regexp_replace(ro, '\\s+', ' ', 'g')), ''), {_ROUTE_CASE}) as method, 'Ellmoor Laboratories Ltd' as facility, 'GLP' as glp_status, 'Conducted in compliance with good laboratory practice.' as glp_compliance,
  case sec when '4.2.1.1' then 'Primary pharmacodynamics' when '4.2.1.2' then 'Secondary pharmacodynamics' when '4.2.1.3' then 'Safety pharmacology' when '4.2.1.4' then 'Pharmacodynamic drug interactions' else 'Pharmacology study' end as type_of_study,
  'Module 4, Section ' || coalesce(sec, '') || ': "' || coalesce(num, 'report') || ' final report"' as location from v""")
def title_pages(tox_study_summary):
    rows = _pages(tox_study_summary).withColumn("file_name", F.regexp_replace("key", "^.*/", ""))
    o = P.overview("key", "file_name", "md", F.lit(None).cast("string"))
    named = {"study_number": "study_number", "study_number_display": "display", "test_system": "test_system", "method_of_administration": "method", "testing_facility": "facility", "glp_status": "glp_status", "glp_compliance": "glp_compliance", "type_of_study": "type_of_study", "location_in_ctd": "location"}
    return rows.withColumn("o", o).select("study_id", *[F.col(f"o.{a}").alias(b) for a, b in named.items()])


@query(f"""with p as ({_PAGE_SQL}) select study_id, '4.2.1.' || regexp_extract(key, '4\\.2\\.1\\.(\\d)', 1) || '.' || coalesce(nullif(num, ''), case when num is null then 'report' else '' end) || '_final_report' as section_number,
 'Reports of ' || regexp_extract(key, ' Reports of ([^/]*)/', 1) as section_title from p where not contains(regexp_extract(key, ' Reports of (.*)$', 1), '//') and not regexp_matches(regexp_extract(key, ' Reports of (.*)/[^/]*$', 1), '[0-9][.][0-9]|["''|]|  |/')
 and regexp_extract(key, ' Reports of ([^/]*)/', 1) = trim(regexp_extract(key, ' Reports of ([^/]*)/', 1))""")
def sections_of_keys(tox_study_summary):
    rows = _pages(tox_study_summary).where(~F.regexp_extract("key", " Reports of (.*)/[^/]*$", 1).rlike("[0-9][.][0-9]|[\"'|]|  |/") & (F.regexp_extract("key", " Reports of ([^/]*)/", 1) == F.trim(F.regexp_extract("key", " Reports of ([^/]*)/", 1))))
    s = P.section_of_key("key")
    return rows.select("study_id", s["section_number"].alias("section_number"), s["section_title"].alias("section_title"))


def _line(patterns: list[str]) -> str:
    return "list_filter(list_transform(ls, lambda l: coalesce(" + ", ".join(f"nullif(trim(regexp_extract(l, {sql_text('(?i)' + p)}, 1)), '')" for p in patterns) + ")), lambda x: x is not null)[1]"


@query(f"""with p as ({_PAGE_SQL}), l as (select study_id, list_filter(list_transform(string_split(md, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls from p)
 select study_id, coalesce({_line(P.FIRST_LINES['title'])}, list_filter(ls, lambda x: len(string_split_regex(x, '\\s+')) >= 3)[1]) as title, {', '.join(f'{_line(P.FIRST_LINES[n])} as {n}' for n in ('study_no', 'facility', 'sponsor', 'date'))} from l""")
def first_line_metadata(tox_study_summary):
    m = P.first_line_metadata("md")
    return _pages(tox_study_summary).select("study_id", *[m[n].alias(n) for n in ("title", "study_no", "facility", "sponsor", "date")])


# Names and displays


@query("""with d as (select distinct id, file_name, regexp_replace(regexp_replace(coalesce(file_name, ''), '^.*/', ''), '(.)\\.[^.]*$', '\\1') as stem, trim(regexp_replace(coalesce(file_name, ''), '\\s+', ' ', 'g'), ' ') as s from ncd_source_document)
 select id, stem, upper(file_name) as shown, array_to_string(list_filter(string_split(s, ' '), lambda w: w <> '')[1:2], ' ') || case when len(list_filter(string_split(s, ' '), lambda w: w <> '')) > 2 then ' ...' else '' end as title, list_filter(list_transform(string_split(coalesce(file_name, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') as header, trim(regexp_replace(regexp_extract('see "' || coalesce(file_name, '') || '" and "b"', '"([^"]+)"', 1), '\\s+', ' ', 'g'), ' ') as quoted from d""")
def names_shown(ncd_source_document):
    d = ncd_source_document.select("id", "file_name").distinct()
    return d.select("id", I.file_stem("file_name").alias("stem"), F.upper("file_name").alias("shown"), I.first_words("file_name", 2).alias("title"), I.header_list(F.replace(F.coalesce("file_name", F.lit("")), F.lit("|"), F.lit("/"))).alias("header"), I.quoted_title(F.concat(F.lit('see "'), F.coalesce("file_name", F.lit("")), F.lit('" and "b"'))).alias("quoted"))


@query("""with s as (select distinct on (study_id) study_id, sponsor_study_id as s, nullif(route, '') as c from tox_study_summary)
 select study_id, case when trim(coalesce(s, ''), ' ') <> '' and trim(coalesce(c, ''), ' ') <> '' then 'Sponsor study #: ' || trim(s, ' ') || '; CRO study #: ' || regexp_replace(trim(c, ' '), '\\s*;\\s*', '; ', 'g') when trim(coalesce(s, ''), ' ') <> '' then 'Sponsor study #: ' || trim(s, ' ') when trim(coalesce(c, ''), ' ') <> '' then 'CRO study #: ' || trim(c, ' ') else study_id end as display from s""")
def study_displays(tox_study_summary):
    s = tox_study_summary.dropDuplicates(["study_id"])
    return s.select("study_id", I.study_display("study_id", F.lit(None).cast("string"), "sponsor_study_id", "route").alias("display"))


_IDS = r"""list_distinct(list_filter(list_transform(regexp_extract_all({0}, '(?i)\b[A-Z0-9]{{2,}}(?:[-./][A-Z0-9]+)+\b'), lambda x: upper(trim(regexp_replace(regexp_replace(trim(regexp_replace(x, '(?i)\.(?:pdf|xml|docx|txt|csv|json|md)$', ''), '._-'), '(?i)^(?:stf-|study-)', ''), '(?i)(?:[._-]*\.(?:pdf|xml|docx|txt|csv|json|md|extracted|quality|meta|images|tables))+$', ''), '._-'))),
  lambda x: length(x) >= 6 and regexp_matches(x, '[A-Z]') and length(regexp_replace(x, '\D', '', 'g')) >= 2 and regexp_full_match(x, '[A-Z0-9]{{2,}}(?:[-./][A-Z0-9]+)+')))"""


@query(f"""with d as (select distinct id, replace(replace(coalesce(file_name, ''), '_', ' '), '(', ' ') as n from ncd_source_document), i as (select id, list_sort({_IDS.format('n')}) as ids, n from d)
 select id, ids, case when len(list_filter(ids, lambda x: not contains(x, '/'))) = 1 then list_filter(ids, lambda x: not contains(x, '/'))[1] else '' end as single from i""")
def study_ids_of_names(ncd_source_document):
    """Identifiers of every file name (underscores parted), sorted."""
    n = F.translate(F.coalesce("file_name", F.lit("")), "_(", "  ")
    d = ncd_source_document.select("id", "file_name").distinct().select("id", n.alias("n"))
    return d.select("id", F.array_sort(X.study_ids("n")).alias("ids"), I.single_study_id("n").alias("single"))


@query("""with d as (select distinct id, upper(trim(coalesce(file_name, ''), ' ')) as r from ncd_source_document), s as (select distinct study_id, upper(trim(coalesce(sponsor_study_id, ''), ' ')) as r from tox_study_summary)
 select study_id, case when regexp_full_match(r, '[A-Z]{2}[0-9]{2}-[0-9]{7}') then r when regexp_full_match(r, '[0-9]{5,}') or regexp_full_match(r, '[0-9]{2,}([-./][0-9]{2,})+') or (length(regexp_replace(r, '[^0-9]', '', 'g')) >= 2 and length(regexp_replace(r, '[^A-Z]', '', 'g')) >= 2 and length(r) >= 6) then r else '' end as number,
  case when r = '' then false else true end as overlaps from s""")
def canonical_numbers(tox_study_summary):
    s = tox_study_summary.select("study_id", "sponsor_study_id").distinct()
    return s.select("study_id", X.canonical_study_number("sponsor_study_id").alias("number"), X.study_numbers_overlap(F.lower("sponsor_study_id"), "sponsor_study_id").alias("overlaps"))


@query("""select distinct study_id, case when regexp_matches(coalesce(sponsor_study_id, ''), '^[A-Z]{2}[0-9]{2}-[0-9]{7}$') then sponsor_study_id else 'DOC-12-ABCDEF' end as preferred from tox_study_summary where sponsor_study_id is null or regexp_matches(sponsor_study_id, '^[A-Z]{2}[0-9]{2}-[0-9]{7}$')""")
def preferred_numbers(tox_study_summary):
    s = tox_study_summary.where(r"sponsor_study_id is null or sponsor_study_id rlike '^[A-Z]{2}[0-9]{2}-[0-9]{7}$'").select("study_id", "sponsor_study_id").distinct()
    return s.select("study_id", X.preferred_study_number(F.lit("DOC-12-ABCDEF"), "sponsor_study_id").alias("preferred"))


# Words, placeholders, numbers, dates


@query("""with f as (select distinct id, finding_term as t, severity as s, organ as o from ncd_finding)
 select id, regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+') as tokens, trim(coalesce(t, ''), ' ') = '' or regexp_full_match(lower(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'), ' ')), 'n/?a|none|not reported|not available|not communicated|unknown|nil') as placeholder,
  trim(coalesce(nullif(trim(t, ' '), ''), nullif(trim(s, ' '), ''), nullif(trim(o, ' '), '')), ' ') as first,
  array_to_string(list_filter(list_transform([coalesce(t, ''), coalesce(s, '')], lambda x: trim(x, ' ')), lambda x: x <> ''), '; ') as merged from f where not contains(coalesce(t, ''), ';') and lower(trim(coalesce(t, ''), ' ')) <> lower(trim(coalesce(s, '~'), ' '))""")
def finding_words(ncd_finding):
    f = ncd_finding.where("not contains(coalesce(finding_term, ''), ';') and lower(trim(coalesce(finding_term, ''))) <> lower(trim(coalesce(severity, '~')))").select("id", "finding_term", "severity", "organ").distinct()
    return f.select("id", F.coalesce(X.tokens("finding_term"), F.array().cast("array<string>")).alias("tokens"), X.is_placeholder("finding_term").alias("placeholder"), X.first_non_blank("finding_term", "severity", "organ").alias("first"), X.merge_segments("finding_term", "severity").alias("merged"))


@query("""with v as (select distinct id, raw_text as t from ncd_text_chunk where raw_text is not null)
 select id, case when regexp_matches(lower(t), '\\b(non[\\s-]*glp|not[\\s-]*glp|noncompliant)\\b') then 'Non-GLP' when regexp_matches(lower(t), '\\bglp\\b') then 'GLP' else 'other' end as glp, case when regexp_matches(lower(t), '\\b(non[\\s-]*glp|not[\\s-]*glp|noncompliant)\\b') then 'Non-GLP' when regexp_matches(lower(t), '\\bglp\\b') then 'GLP' else '' end as inferred from v""")
def glp_statements(ncd_text_chunk):
    v = ncd_text_chunk.where("raw_text is not null").select("id", "raw_text").distinct()
    g = X.glp("raw_text")
    return v.select("id", F.when(g.isin("GLP", "Non-GLP"), g).otherwise("other").alias("glp"), I.glp_of(F.lit("x"), "raw_text").alias("inferred"))


_DAY = "date '1970-01-01' + cast(hash_id as integer)"


@query("""with d as (select o_orderkey as k, cast(o_orderdate as date) as d from orders),
 w as (select k, d, case k % 7 when 0 then strftime(d, '%m-%Y') when 1 then strftime(d, '%-m/%Y') when 2 then strftime(d, '%-m/%-d/%Y') when 3 then strftime(d, '%Y-%m-%d') when 4 then strftime(d, '%Y/%-m/%-d') when 5 then strftime(d, '%Y') else 'in ' || strftime(d, '%Y') end as t from d)
 select k, t, strftime(case k % 7 when 0 then date_trunc('month', d) when 1 then date_trunc('month', d) when 5 then date_trunc('year', d) when 6 then null else d end, '%Y-%m-%d') as day from w""")
def parsed_dates(orders):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    forms = {0: "MM-yyyy", 1: "M/yyyy", 2: "M/d/yyyy", 3: "yyyy-MM-dd", 4: "yyyy/M/d", 5: "yyyy"}
    t = F.coalesce(*[F.when(k % 7 == n, F.date_format(d, f)) for n, f in forms.items()], F.concat(F.lit("in "), F.date_format(d, "yyyy")))
    return orders.select(k.alias("k"), t.alias("t")).select("k", "t", F.date_format(V.parse_date("t"), "yyyy-MM-dd").alias("day"))


@query("""with m as (select distinct id, timepoint as t, value as v from ncd_exposure_metric)
 select id, cast(nullif(regexp_extract(lower(t), '\\d+'), '') as integer) * case when contains(lower(t), 'week') then 7 when contains(lower(t), 'month') then 30 when contains(lower(t), 'year') then 365 else 1 end as days, regexp_replace(cast(cast(cast(v as varchar) as decimal(38, 10)) as varchar), '[.]?0+$', '') as compact, case when v is not null then least(100.0, greatest(1.0, v)) end as clamped from m""")
def durations_and_numbers(ncd_exposure_metric):
    m = ncd_exposure_metric.select("id", "timepoint", "value").distinct()
    return m.select("id", V.duration_days("timepoint").alias("days"), X.compact_number("value").alias("compact"), V.clamp(F.col("value"), 1.0, 100.0).alias("clamped"))


@query("""with e as (select event_id, user_id, event_type, value, ts from events)
 select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, lower(regexp_replace(event_type, '[^a-zA-Z0-9]+', '-', 'g')) as slug, 'b' || (user_id % 3) as bucket, event_type || '/' || event_id || '.PDF' as key, 'pdf' as kind, 'b' || (user_id % 3) || '/' || event_type || '/' || event_id || '.PDF' as joined from e""")
def paths_and_times(events):
    uri = F.concat(F.lit("s3://b"), (F.col("user_id") % 3).cast("string"), F.lit("/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".PDF"))
    parts = X.uri_parts("uri")
    return events.withColumn("uri", uri).select("event_id", V.iso_utc("ts").alias("at"), X.slug("event_type").alias("slug"), parts["bucket"].alias("bucket"), parts["key"].alias("key"), X.file_type("uri").alias("kind"), X.clean_path(parts["bucket"], F.lit("/./"), parts["key"], F.lit("..")).alias("joined"))


# Fuzzy ratios: the longest common subsequence row by row in SQL

_NAMES_SQL = "select n_nationkey as i, lower(n_name) as a, r_regionkey as j, lower(r_name) as b from nation, region"
_LCS = """lcs as (with recursive step as (select i, j, k, a, b, 0 as n, list_transform(range(length(b) + 1), lambda x: 0) as r from pairs
  union all select i, j, k, a, b, n + 1, list_reduce(range(1, length(b) + 1), lambda acc, q: list_append(acc, case when substr(a, n + 1, 1) = substr(b, cast(q as integer), 1) then r[q] + 1 else greatest(acc[q], r[q + 1]) end), [0]) from step where n < length(a))
  select i, j, k, a, b, case when length(a) + length(b) = 0 then 100.0 else 200.0 * r[length(b) + 1] / (length(a) + length(b)) end as ratio from step where n = length(a))"""


@query(f"""with p as ({_NAMES_SQL}), o as (select i, j, case when length(a) <= length(b) then a else b end as s, case when length(a) <= length(b) then b else a end as l from p),
 pairs as (select i, j, w as k, s as a, substr(l, greatest(w, 1), w + length(s) - greatest(w, 1)) as b from o, unnest(range(2 - length(s), length(l) + 1)) as u(w)), {_LCS}
 select i, j, round(max(ratio), 4) as partial from lcs group by 1, 2""")
def partial_ratios(nation, region):
    """Every nation's name compared with the names of a stated list, the regions."""
    names = F.array(*[F.struct(F.lit(r[0]).alias("j"), F.lit(r[1].lower()).alias("b")) for r in region.select("r_regionkey", "r_name").collect()])  # five fixed rows
    pairs = nation.select(F.col("n_nationkey").alias("i"), F.lower("n_name").alias("a"), F.inline(names))
    return pairs.select("i", "j", F.round(Z.partial_ratio_column(F.col("a"), F.col("b")), 4).alias("partial"))


@query(f"""with t as (select term_id as i, list_sort(list_distinct(string_split(lower(term), ' '))) as x, list_sort(list_distinct(string_split('increased liver weight', ' '))) as y from ref_term),
 s as (select i, array_to_string(list_sort(list_intersect(x, y)), ' ') as c, array_to_string(list_sort(list_filter(x, lambda w: not list_contains(y, w))), ' ') as dx, array_to_string(list_sort(list_filter(y, lambda w: not list_contains(x, w))), ' ') as dy from t),
 u as (select i, c, dx, dy, trim(c || ' ' || dx) as ax, trim(c || ' ' || dy) as ay from s),
 pairs as (select i, 0 as j, 1 as k, ax as a, ay as b from u union all select i, 0, 2, c, ax from u where c <> '' union all select i, 0, 3, c, ay from u where c <> ''), {_LCS}
 select u.i as term_id, round(case when c <> '' and (dx = '' or dy = '') then 100.0 else m.r end, 4) as score from u join (select i, max(ratio) as r from lcs group by 1) m using (i)""")
def token_set_ratios(ref_term):
    return ref_term.select("term_id", F.round(Z.token_set_ratio_column(F.lower("term"), F.lit("increased liver weight")), 4).alias("score"))


# Tables


@query("""with f as (select distinct study_id, id, coalesce(organ, '') as organ, coalesce(severity, '') as severity from ncd_finding where study_id is not null), g as (select study_id, list(id order by id) as ids, list(trim(regexp_replace(organ, '\\s+', ' ', 'g')) order by id) as organs, list(trim(regexp_replace(severity, '\\s+', ' ', 'g')) order by id) as sev from f group by 1)
 select study_id, ['Group', 'Organ', 'Finding severity'] as columns, len(ids) as n_rows, organs, sev from g""")
def recovered_headers(ncd_finding):
    """Raw tables of each study's findings, behind a title row: the header is found and the rows are kept."""
    f = ncd_finding.where("study_id is not null").select("study_id", "id", F.coalesce("organ", F.lit("")).alias("organ"), F.coalesce("severity", F.lit("")).alias("severity")).distinct()
    row = F.struct("id", F.array(F.col("id").cast("string"), F.col("organ"), F.col("severity")).alias("r"))
    body = f.groupBy("study_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("b"))
    head = [["Table 2 of findings", "", ""], ["Group", "Organ", "Finding severity"]]
    raw = F.concat(F.array(*[F.array(*[F.lit(c) for c in r]) for r in head]), F.col("b"))
    got = B.recovered_tables(body.select("study_id", raw.alias("rows")))
    cell = lambda i: F.transform("table.rows", lambda r: F.get(r, F.lit(i)))
    return got.select("study_id", F.col("table.columns").alias("columns"), F.size("table.rows").cast("bigint").alias("n_rows"), cell(1).alias("organs"), cell(2).alias("sev"))


@query("""select s_suppkey, '<table><tr><th>name</th><th>balance</th></tr><tr><td>' || s_name || '</td><td>' || s_nationkey || '</td></tr></table>' as html, ['img/' || s_suppkey || '.png'] as images from supplier""")
def tables_and_images(supplier):
    md = F.concat(F.lit("text\n| name | balance |\n| --- | :---: |\n| "), F.col("s_name"), F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" |\n\n![plot](img/"), F.col("s_suppkey").cast("string"), F.lit('.png "p")\n| alone |'))
    return B.html_of_markdown(supplier.withColumn("md", md), "md").select("s_suppkey", F.get("tables", F.lit(0)).alias("html"), X.markdown_images("md").alias("images"))


@query("""select l_orderkey as k, max(l_linenumber) as n, 'Report Number' as first_key, min(l_shipdate) as d from lineitem group by 1""")
def key_value_tables(lineitem):
    """Two-column tables of each order: their pairs read back."""
    g = lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.min("l_shipdate").alias("d"))
    rows = F.array(F.array(F.lit("Report Number"), F.col("l_orderkey").cast("string")), F.array(F.concat(F.lit("Lines: "), F.col("n").cast("string"), F.lit("\nShipped: "), F.col("d").cast("string")), F.lit("Page 3")))
    got = B.with_key_values(g.select("l_orderkey", rows.alias("rows")), "rows")
    p = F.col("pairs")
    return got.select(p["Report Number"].cast("bigint").alias("k"), p["Lines"].cast("int").alias("n"), F.get(F.map_keys("pairs"), F.lit(0)).alias("first_key"), p["Shipped"].cast("timestamp_ntz").alias("d")).where(p["Page Info"] == "Page 3")


_HEADS = {name: kv for name, kv in M.HEADERS.items()}


@query("with h as (select unnest([" + ", ".join(f"{{'h': {sql_text(o.title() + ' ')}, 'o': {sql_text(n)}}}" for n, others in _HEADS.items() for o in others) + ", {'h': 'Doses (concentration)', 'o': 'doses'}, {'h': 'dose-concentration mg/ml', 'o': 'doses'}, {'h': 'Organ systems seen', 'o': 'organ systems evaluated'}, {'h': 'Species/Strain', 'o': 'species strain'}, {'h': 'Study', 'o': 'study'}]) as x) select x.h as header, x.o as token from h")
def header_tokens(region):
    heads = [(o.title() + " ",) for others in _HEADS.values() for o in others] + [("Doses (concentration)",), ("dose-concentration mg/ml",), ("Organ systems seen",), ("Species/Strain",), ("Study",)]
    return region.sparkSession.createDataFrame(heads, "header string").select("header", M.header_token(F.col("header")).alias("token"))


# Lists, assembled texts, sections


@query("""with f as (select distinct id, coalesce(finding_term, '') || ',' || coalesce(organ, '') || ', n/a ,,' || coalesce(severity, '') as t from ncd_finding), l as (select id, list_filter(list_transform(string_split(t, ','), lambda x: trim(x, ' ')), lambda x: x <> '') as l from f),
 k as (select id, l, list_filter(l, lambda x: lower(x) not in ('n/a', 'none', 'null')) as k from l), d as (select id, l, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) as k from k),
 p as (select id, l, k[1:5] as k, k[1:5] || ['nonclinical', 'module 4', 'ctd', 'data'] as e from d)
 select id, l as items, k as keywords, case when len(k) >= 4 then k else (list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i))[1:4] end as padded from p""")
def keyword_lists(ncd_finding):
    t = F.concat(F.coalesce("finding_term", F.lit("")), F.lit(","), F.coalesce("organ", F.lit("")), F.lit(", n/a ,,"), F.coalesce("severity", F.lit("")))
    f = ncd_finding.select("id", "finding_term", "organ", "severity").distinct().select("id", t.alias("t"))
    more = F.array(*[F.lit(x) for x in ("nonclinical", "module 4", "ctd", "data")])
    return f.select("id", A.listed("t").alias("items"), A.keywords(A.listed("t"), 5).alias("keywords"), A.padded_keywords(A.listed("t"), more, 4, 5).alias("padded"))


@query("""with d as (select distinct id, file_name as n, project_id as p, ctd_section as s from ncd_source_document), w as (select id, n, p, s, list_filter(list_transform(string_split_regex(replace(coalesce(n, ''), '/', ' '), '\\s+'), lambda x: trim(x, ' ,.;:()[]{}')), lambda x: length(x) >= 3 and regexp_matches(x, '\\p{L}')) as ws from d)
 select id, list_transform(ws[1:3], lambda x: lower(x)) as words, 'Document: ' || coalesce(n, '-') || coalesce(chr(10) || chr(10) || 'Project: ' || nullif(p, ''), '') || coalesce(chr(10) || chr(10) || 'Section: ' || nullif(s, ''), '') || chr(10) || chr(10) || 'Summary:' || chr(10) || 'one' || chr(10) || chr(10) || 'body' as text from w""")
def embedding_texts(ncd_source_document):
    d = ncd_source_document.select("id", "file_name", "project_id", "ctd_section").distinct()
    text = A.embedding_text(F.coalesce("file_name", F.lit("-")), [("Project", F.col("project_id")), ("Section", F.col("ctd_section")), ("Module", F.lit(" "))], F.lit("one"), F.lit(" body \n"))
    return d.select("id", A.title_words("file_name", 3).alias("words"), text.alias("text"))


@query("""select n_nationkey, '## Key Topics' || chr(10) || '- [' || n_name || '](#t1)' || chr(10) || '- [absent](#t2)' || chr(10) || chr(10) as head, length('## Key Topics' || chr(10) || '- [' || n_name || '](#t1)' || chr(10) || '- [absent](#t2)' || chr(10) || chr(10) || 'On ' || upper(n_name) || '.') + 2 * length('<a id="t1"></a>') as n, length('## Key Topics' || chr(10) || '- [') + 1 as first_at from nation""")
def anchored_topics(nation):
    topics = F.array(F.struct(F.col("n_name").alias("title"), F.lit("t1").alias("anchor")), F.struct(F.lit("absent").alias("title"), F.lit("t2").alias("anchor")))
    text = A.with_anchors(F.concat(F.lit("On "), F.upper("n_name"), F.lit(".")), topics)
    bare = F.regexp_replace(text, '<a id="t[12]"></a>', "")
    head = F.concat(F.regexp_extract(bare, r"(?s)^(.*?\n\n)", 1))
    return nation.select("n_nationkey", head.alias("head"), F.length(text).cast("bigint").alias("n"), F.instr(text, '<a id="t1">').alias("first_at"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then 'a, ' || s_name when 1 then s_name when 2 then 'v' || s_nationkey else trim(s_name) end as text, 'k' || s_nationkey as required from supplier""")
def coerced_fields(supplier):
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    j = F.when(k == 0, F.to_json(F.array(F.lit(" a"), F.lit(""), n))).when(k == 1, F.to_json(F.struct(n.alias("text")))).when(k == 2, F.to_json(F.struct(F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("value"), n.alias("text")))).otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    entry = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("x"))).alias("required_content"), F.struct(F.array(F.concat(F.lit("k"), F.col("s_nationkey").cast("string")), F.lit("12")).alias("deep_key")).alias("validation_rules")))
    got = A.with_required_fields(supplier.select("s_suppkey", A.coerced(j).alias("text"), entry.alias("e")), "e")
    return got.select("s_suppkey", "text", F.get("required", F.lit(1)).alias("required"))


@query("""with d as (select doc_id, text as t, length(text) as n from documents where text is not null), c as (select doc_id, t, n, greatest(600, cast(floor(n * 0.6) as integer)) as target from d), m as (select *, chr(10) || chr(10) || '[TRUNCATED FOR CONTEXT LIMIT: ' || (n - target) || ' trailing characters omitted.]' as note from c)
 select doc_id, case when target < n then regexp_replace(left(t, greatest(0, target - length(note))), '\\s+$', '') || note end as cut, case when n <= 4000 then nullif(trim(t, ' '), '') end as prompt from m""")
def cut_prompts(documents):
    d = documents.where("text is not null")
    return d.select("doc_id", A.cut_prompt("text", 1).alias("cut"), F.when(F.length("text") <= 4000, X.blank_to_null("text")).alias("prompt"))


@query("""with c as (select distinct id, raw_text as t, offset_start as a, offset_end as b from ncd_text_chunk where raw_text is not null), m as (select *, regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)+') as ns from c)
 select id, list_sort(list_transform(ns, lambda x: {'a': -len(string_split(x, '.')), 'b': -length(x), 'c': list_position(ns, x), 'x': x}))[1].x as specific, coalesce(b > a, false) as given, coalesce(nullif(strpos(t, 'animals'), 0), strpos(lower(t), 'animals')) - 1 as at from m""")
def most_specific_numbers(ncd_text_chunk):
    c = ncd_text_chunk.where("raw_text is not null").select("id", "raw_text", "offset_start", "offset_end").distinct()
    numbers = F.regexp_extract_all("raw_text", F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0))
    spans = A.accepted_spans(F.array(F.struct(F.col("offset_start").alias("start"), F.col("offset_end").alias("end"))), F.array().cast("array<struct<start:int,end:int>>"))
    return c.select("id", A.most_specific(numbers).alias("specific"), (F.size(spans) > 0).alias("given"), F.coalesce(X.excerpt_offset(F.col("raw_text"), F.lit("animals")), F.lit(-1)).alias("at"))


@query("""select n_nationkey, case n_nationkey % 3 when 0 then '2.6.' || n_regionkey when 1 then '2.6' else '3.' || n_regionkey end as target, '2.' || n_regionkey || '-' || lower(n_name) as element, list_sort(list_distinct(['4.2', '4.' || n_regionkey || '.1'])) as sections from nation""")
def resolved_targets(nation):
    r, k = F.col("n_regionkey").cast("string"), F.col("n_nationkey") % 3
    s = F.when(k == 0, F.concat(F.lit("2.4."), r)).when(k == 1, F.lit(" ")).otherwise(F.concat(F.lit("3."), r))
    text = F.concat(F.lit("see 4.2 and 4."), r, F.lit(".1 or 14.2"))
    return nation.select("n_nationkey", X.resolve_target(s).alias("target"), X.element_number(F.concat(F.lit(" 2."), r, F.lit("  "), F.col("n_name"))).alias("element"), F.array_sort(F.array_distinct(X.section_numbers(text))).alias("sections"))


@query("""with c as (select distinct id, lower(id) as u, raw_text as t from ncd_text_chunk) select id, u as uuid, substr(coalesce(t, ''), 11, 20) as slice, coalesce(contains(lower(t), 'dose'), false) as says from c""")
def slices_and_uuids(ncd_text_chunk):
    c = ncd_text_chunk.select("id", "raw_text").distinct()
    return c.select("id", X.uuid_or_null(F.concat(F.lit(" "), F.upper("id"), F.lit("\n"))).alias("uuid"), X.text_slice(F.coalesce("raw_text", F.lit("")), F.lit(10), F.lit(30)).alias("slice"), F.coalesce(X.excerpt_offset("raw_text", F.lit("DOSE")).isNotNull(), F.lit(False)).alias("says"))


@query("""with p as (select id, generate_subscripts(string_split(raw_text, chr(10)), 1) as i, trim(regexp_replace(unnest(string_split(raw_text, chr(10))), '\\s+', ' ', 'g'), ' ') as x from (select distinct id, regexp_replace(regexp_replace(raw_text, '[\\r\\n]', ' ', 'g'), '([.;])\\s+', '\\1' || chr(10), 'g') as raw_text from ncd_text_chunk where raw_text is not null)),
 w as (select *, case when regexp_matches(x, '(?i)\\bp\\s*[<=>]') then 4 else 0 end + case when regexp_matches(x, '[0-9]\\s*%') then 3 else 0 end + case when regexp_matches(x, '(?i)mg/kg') then 2 else 0 end + case when regexp_matches(x, '(?i)\\b(cmax|auc)') then 2 else 0 end + case when regexp_matches(x, '(?i)\\bq[0-9]+d\\b') then 1 else 0 end as w from p where x <> ''),
 d as (select * from w where w > 0 qualify row_number() over (partition by id, lower(x) order by i) = 1), r as (select *, row_number() over (partition by id order by w desc, length(x) desc, x) as r from d) select id, list(x order by r) as evidence from r where r <= 3 group by 1""")
def numeric_evidence(ncd_text_chunk):
    c = ncd_text_chunk.where("raw_text is not null").select("id", "raw_text").distinct()
    got = c.select("id", X.numeric_evidence("raw_text").alias("evidence"))
    return got.where("size(evidence) > 0")
