"""Column functions over strings: identifiers, sections, keywords, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blanks become null."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def first_non_blank(*cs: Column | str) -> Column:
    """The first of several texts that isn't null or blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def squeeze(c: Column | str) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def alnum_key(c: Column | str) -> Column:
    """Lower-case letters and digits only, for comparing identifiers."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once (an expression within a lambda is computed for every element)."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def ordered_distinct(items: Column, key=F.lower) -> Column:
    """Items whose key hasn't occurred before, in order (first spelling kept); null items dropped."""
    first = lambda kept: lambda keys: F.filter(kept, lambda x, i: F.array_position(keys, key(x)) == i + 1)
    return let(F.filter(items, lambda x: x.isNotNull()), lambda kept: let(F.transform(kept, lambda x: key(x)), first(kept)))


def tokens(c: Column | str) -> Column:
    """Runs of Latin letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), F.lit(0))


# Identifiers of studies. File endings cut from an id, and table artefacts that look like one.
STUDY_ID = r"(?i)\b(?=[A-Z0-9./-]*[A-Z])(?=[A-Z0-9./-]*\d)[A-Z0-9]{2,}(?:[-./][A-Z0-9]+)+\b"
_EXTENSIONS = r"(?i)\.(?:pdf|xml|docx|txt|csv|json|md)$"
_TRAILERS = r"(?i)(?:[._-]*\.(?:pdf|xml|docx|txt|csv|json|md|extracted|quality|meta|images|tables))+$"
_ARTEFACT = r"(?i)^(?:input\.(?:p\d+)?\.t\d+|p\d+\.t\d+)$"


def study_ids(c: Column | str) -> Column:
    """All study identifiers of a text in upper case, ordered and distinct; empty for null.

    An identifier has letters, at least two digits, a separator and six characters; file
    endings, ``stf-``/``study-`` in front and table artefacts are no part of it.
    """
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(STUDY_ID), F.lit(0))
    edges = lambda x: F.regexp_replace(x, r"^[._-]+|[._-]+$", "")
    cleaned = F.transform(found, lambda x: edges(F.regexp_replace(edges(F.regexp_replace(F.regexp_replace(x, _EXTENSIONS, ""), r"(?i)^(?:stf-|study-)", "")), _TRAILERS, "")))
    kept = F.filter(cleaned, lambda x: (F.length(x) >= 6) & ~x.rlike(_ARTEFACT) & (F.length(F.regexp_replace(x, r"\D", "")) >= 2) & x.rlike("(?i)^" + STUDY_ID[4:] + "$"))
    return F.array_distinct(F.transform(kept, F.upper))


def canonical_study_number(c: Column | str) -> Column:
    """First study id; else a plausible raw number (five digits, digit groups, or letters with digits) in upper case; else ''."""
    raw = F.upper(F.trim(F.coalesce(_c(c), F.lit(""))))
    digits, letters = F.length(F.regexp_replace(raw, r"[^0-9]", "")), F.length(F.regexp_replace(raw, r"[^A-Z]", ""))
    plausible = raw.rlike(r"^\d{5,}$") | raw.rlike(r"^\d{2,}([-./]\d{2,})+$") | ((digits >= 2) & (letters >= 2) & (F.length(raw) >= 6))
    return F.coalesce(F.get(study_ids(c), F.lit(0)), F.when(~raw.rlike(_ARTEFACT) & plausible, raw), F.lit(""))


def preferred_study_number(*cs: Column | str) -> Column:
    """The first id of several texts that isn't an internal document number (DOC-nnn-HEX), else the first, else ''."""
    every = F.flatten(F.array(*[F.concat(F.array(canonical_study_number(c)), study_ids(c)) for c in cs]))
    distinct = F.array_distinct(F.filter(every, lambda x: x != ""))
    public = F.filter(distinct, lambda x: ~x.rlike(r"(?i)^DOC-\d+-[A-F0-9]{6,}$"))
    return F.coalesce(F.get(public, F.lit(0)), F.get(distinct, F.lit(0)), F.lit(""))


def study_numbers_overlap(a: Column | str, b: Column | str) -> Column:
    """Whether two texts share a study id; without ids on either side, whether they are equal but for case."""
    x, y = study_ids(a), study_ids(b)
    ux, uy = F.upper(F.trim(F.coalesce(_c(a), F.lit("")))), F.upper(F.trim(F.coalesce(_c(b), F.lit(""))))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y)).otherwise((ux != "") & (ux == uy))


def natural_key(c: Column | str) -> Column:
    """Sort key in which numbers compare by value and stand before text."""
    runs = F.regexp_extract_all(F.upper(F.coalesce(_c(c), F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda t: F.struct(F.when(t.rlike("^[0-9]"), 0).otherwise(1).alias("kind"), F.when(t.rlike("^[0-9]"), t.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(t.rlike("^[0-9]"), "").otherwise(t).alias("text")))


# Sections


def section_matches(s: Column | str, family: Column | str) -> Column:
    """s is the section, a descendant (dotted) or a piped list with a descendant; empty operands never match."""
    a, m = F.coalesce(_c(s), F.lit("")), F.coalesce(_c(family), F.lit(""))
    return (a != "") & (m != "") & ((a == m) | F.startswith(a, F.concat(m, F.lit("."))) | F.contains(a, F.concat(F.lit("|"), m, F.lit("."))))


def section_ancestors(s: Column | str) -> Column:
    """A dotted section and all its ancestors, longest first."""
    parts = F.split(_c(s), r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def section_keys(s: Column | str) -> Column:
    """All sections whose family a label is in (:func:`section_matches`): itself, and what stands before a dot of it or of a part behind "|"."""
    strict = lambda e: F.filter(section_ancestors(e), lambda x, i: i > 0)
    return F.array_distinct(F.concat(F.array(_c(s)), F.flatten(F.transform(F.split(_c(s), r"\|"), strict))))


def path_section_keys(path: Column | str) -> Column:
    """All sections that a path mentions (:func:`path_mentions_section`): dotted ones, and those run together behind "#"."""
    found = F.regexp_extract_all(F.coalesce(_c(path), F.lit("")), F.lit(r"\d+(?:\.\d+)+|\d{4,}"), F.lit(0))
    starts = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.concat(F.lit("#"), F.substring(t, F.lit(1), n)))
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.when(F.contains(t, F.lit(".")), section_ancestors(t)).otherwise(starts(t)))))


def path_mentions_section(path: Column | str, section: Column | str) -> Column:
    """Whether a path holds the section number, dotted or run together (4.2.1.1 or 4211...), or a descendant."""
    m = _c(section)
    joined = F.replace(m, F.lit("."), F.lit(""))
    found = F.regexp_extract_all(F.coalesce(_c(path), F.lit("")), F.lit(r"\d+(?:\.\d+)+|\d{4,}"), F.lit(0))
    return F.exists(found, lambda t: F.when(F.contains(t, F.lit(".")), (t == m) | F.startswith(t, F.concat(m, F.lit(".")))).otherwise(F.startswith(t, joined)))


def section_numbers(c: Column | str) -> Column:
    """Section numbers 4.n[.n[.n]] in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"\b4\.[0-9](?:\.[0-9]+){0,2}\b"), F.lit(0)))


def section_label(c: Column | str) -> Column:
    """A section label in one form: no word in front, no closing dot, 4211 as 4.2.1.1; blanks null."""
    bare = F.regexp_replace(F.regexp_replace(blank_to_null(c), r"(?i)^(?:section|sec\.?)\s*", ""), r"[.\s]+$", "")
    return F.nullif(F.when(bare.rlike(r"^\d{2,6}$"), F.array_join(F.filter(F.split(bare, ""), lambda x: x != ""), ".")).otherwise(bare), F.lit(""))


def section_title(c: Column | str, number: Column | str) -> Column:
    """The rest of the line behind the first occurrence of a section number, at most 200 characters; null without it."""
    t, n = _c(c), _c(number)
    at = F.instr(t, n)
    return F.when((at > 0) & (n != ""), F.substring(F.trim(F.substring_index(F.substring(t, at + F.length(n), F.length(t)), "\n", 1)), 1, 200))


def resolve_target(section: Column | str) -> Column:
    """Written-summary numbers 2.4.x to the matching tabulated numbers, others as they are; blank gives 2.6."""
    s = F.coalesce(blank_to_null(section), F.lit("2.6"))
    return F.when(F.startswith(s, F.lit("2.4")), F.concat(F.lit("2.6"), F.substring(s, 4, 2**31 - 1))).otherwise(s)


def element_number(c: Column | str) -> Column:
    """``2.4.1 A`` as ``2.4.1-a``."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), r"\s+", "-")


# Keywords and rules. Topics with the parts of words that show them, study types with patterns in order.
TOPICS = {
    "hepatotoxicity": ["liver", "hepat", "alt", "ast", "bilirubin"],
    "nephrotoxicity": ["kidney", "renal", "creatinine"],
    "qt_prolongation": ["qt", "ecg", "herg"],
    "immunotoxicity": ["lymph", "cytokine", "immune"],
    "pharmacokinetics": ["auc", "cmax", "clearance", "t1/2", "half-life"],
}
STUDY_TYPES = [
    ("repeat_dose_tox", "repeated[- ]dose|28[- ]day|90[- ]day|subchronic|chronic"),
    ("single_dose_tox", "single[- ]dose|acute toxicity"),
    ("genotox_in_vitro", "ames test|bacterial reverse mutation|in vitro micronucleus"),
    ("genotox_in_vivo", "in vivo micronucleus|comet assay"),
    ("carcinogenicity", "2[- ]year|lifetime|carcinogenicity"),
    ("safety_pharmacology", "safety pharmacology|cardiovascular|cns|respiratory"),
    ("pk_tk", "pharmacokinetic|toxicokinetic|tk|pk "),
    ("reproductive_toxicity", "fertility|embryo[- ]fetal|perinatal|prenatal"),
]
ORGAN_SYSTEMS = [
    ("Cardiovascular", r"\b(cardiovascular|cardiac|hemodynamics?|blood pressure|heart rate|ecg|qtc?|qrs|pr interval|herg|telemetry)\b"),
    ("CNS", r"\b(cns|neuro(logical|behavior|behaviour)?|irwin|fob|functional observational battery|motor activity)\b|\b(central nervous|convulsion|seizure)"),
    ("Respiratory", r"\b(respiratory|pulmonary|plethysmography|tidal volume|minute volume|blood gas(es)?)\b"),
    ("Gastrointestinal", r"\b(gastrointestinal|gi tract)\b"),
    ("Renal", r"\b(renal|kidney)\b"),
]


def topics(c: Column | str, rules: dict[str, list[str]] | None = None) -> Column:
    """Topics any of whose keywords is a substring of the lower-case text, in rule order."""
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    hits = [F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in words]), F.lit(name)) for name, words in (rules or TOPICS).items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def labels_by_pattern(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Labels whose pattern is found in the lower-case text, in rule order."""
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())


def study_type(title: Column | str) -> Column:
    """The first study type whose pattern is found in the title; null if none."""
    return F.get(labels_by_pattern(title, STUDY_TYPES), F.lit(0))


def organ_systems(c: Column | str) -> Column:
    """Organ systems a text speaks of, joined by "; "."""
    return F.array_join(labels_by_pattern(c, ORGAN_SYSTEMS), "; ")


def glp(c: Column | str) -> Column:
    """``GLP``, ``Non-GLP``, '' for no statement, else the text itself."""
    raw = F.trim(F.coalesce(_c(c), F.lit("")))
    low = F.lower(raw)
    bare = F.regexp_replace(low, "[^a-z0-9]+", "")
    return F.when(low.rlike(r"\b(non[\s-]*glp|not[\s-]*glp|noncompliant)\b"), "Non-GLP").when(low.rlike(r"\bglp\b") | bare.isin("yes", "y", "true", "compliant"), "GLP").when(bare.isin("no", "n", "false", "na", "unknown"), "").otherwise(raw)


def sex_label(c: Column | str) -> Column:
    """Male, Female or Male/Female for the usual spellings, else the trimmed text."""
    up = F.upper(F.trim(F.coalesce(_c(c), F.lit(""))))
    return F.when(up.isin("M", "MALE"), "Male").when(up.isin("F", "FEMALE"), "Female").when(up.isin("M/F", "F/M", "MALE/FEMALE", "FEMALE/MALE"), "Male/Female").otherwise(F.trim(F.coalesce(_c(c), F.lit(""))))


def is_placeholder(c: Column | str) -> Column:
    """Whether a value says nothing (blank, n/a, none, not reported and the like)."""
    t = squeeze(F.coalesce(_c(c), F.lit("")))
    return (t == "") | t.rlike(r"(?i)^(n/?a|none|not reported|not available|not communicated|unknown|nil)$") | t.rlike(r"(?i)^study\s*#?:?\s*(n/?a|not reported)$")


def merge_segments(*cs: Column | str) -> Column:
    """Parts between semicolons of several texts, distinct but for case, in order, joined by "; "."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(_c(c), F.lit("")), r"\s*;\s*") for c in cs]))
    return F.array_join(ordered_distinct(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda x: x != "")), "; ")


def sentences(c: Column | str, most: int = 4) -> Column:
    """The first sentences or clauses with at least five letters."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"(?<=[.!?])\s+|\s*;\s*"), lambda x: F.regexp_replace(squeeze(x), r"^[ ;,]+|[ ;,]+$", ""))
    return F.slice(F.filter(parts, lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 5), 1, most)


def dose_summary(c: Column | str) -> Column:
    """Doses per kg of a text (series and single ones) in compact numbers, distinct, joined by ", "."""
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"(?i)((?:\d+(?:\.\d+)?(?:\s*,\s*|\s+(?:and|or)\s+))*\d+(?:\.\d+)?\s*(?:mg|ug|mcg|g)/kg)"), F.lit(1))
    each = F.flatten(F.transform(found, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.concat(compact_number(n), F.lit(" "), F.lower(F.regexp_extract(s, r"(?i)(mg|ug|mcg|g)/kg", 1)), F.lit("/kg")))))
    return F.array_join(F.array_distinct(each), ", ")


def compact_number(c: Column | str) -> Column:
    """A number without superfluous zeros; other text as it is."""
    t = F.trim(_c(c).cast("string"))
    d = t.try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.when(F.contains(d, F.lit(".")), F.regexp_replace(d, r"\.?0+$", "")).otherwise(d), t)


# Cutting, slugs, paths


def clip(c: Column | str, n: int, mark: str = " ...[truncated]") -> Column:
    """At most ``n`` characters, cut ones without outer blanks and with a mark behind."""
    t = _c(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit(mark))).otherwise(t)


def clip_at_word(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, cut at the last blank."""
    t = _c(c)
    head = F.substring(t, 1, n)
    return F.when(F.length(t) > n, F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)).otherwise(t)


def slug(c: Column | str, empty: str = "unknown") -> Column:
    """Lower-case letters and digits joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", empty).otherwise(s)


def module_number(c: Column | str) -> Column:
    """Module 1 to 5: the text itself if it is one, else the number behind the first "module" that has one; null otherwise."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    named = F.regexp_extract(t, r"(?i)\bmodule[\s._-]*([1-5])(?![0-9])", 1)
    return F.when(t.rlike("^[1-5]$"), t).otherwise(F.nullif(named, F.lit(""))).cast("int")


def short_module(c: Column | str) -> Column:
    """``m4`` written out as ``module 4``; anything else as it is."""
    return F.regexp_replace(_c(c), r"(?i)^\s*m\s*([1-5])\s*$", "module $1")


def path_context(c: Column | str) -> Column:
    """Struct company, project, module of a path company/<company>/<project>/<module>/..."""
    parts = F.split(_c(c), "/")
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("company"), at(2).alias("project"), module_number(short_module(F.coalesce(at(3), F.lit("")))).alias("module"))


def clean_path(*cs: Column | str) -> Column:
    """Path segments joined, without empty ones, ``.`` and ``..``."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(_c(c), F.lit("")), r"[/\\]") for c in cs]))
    return F.array_join(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda x: ~x.isin("", ".", "..")), "/")


def file_type(c: Column | str) -> Column:
    """Lower-case file extension, '' without one."""
    return F.lower(F.regexp_extract(_c(c), r"\.([A-Za-z0-9]+)\s*$", 1))


def uri_parts(c: Column | str) -> Column:
    """Struct bucket, key of an s3:// address; nulls for others."""
    t = _c(c)
    return F.struct(F.nullif(F.regexp_extract(t, "^s3://([^/]+)/(.*)$", 1), F.lit("")).alias("bucket"), F.nullif(F.regexp_extract(t, "^s3://([^/]+)/(.*)$", 2), F.lit("")).alias("key"))


def uuid_or_null(c: Column | str) -> Column:
    """A UUID in lower case without outer white space; null for anything else."""
    t = F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))
    return F.when(t.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), t)


def excerpt_offset(text: Column | str, excerpt: Column | str) -> Column:
    """0-based position of an excerpt, exact or else ignoring case; null if absent."""
    t, e = _c(text), _c(excerpt)
    return F.coalesce(F.nullif(F.instr(t, e), F.lit(0)), F.nullif(F.instr(F.lower(t), F.lower(e)), F.lit(0))) - 1


def label_values(text: Column | str, labels: list[str]) -> Column:
    """Values behind ``label:`` (or -, |, two blanks) at line starts, in label order."""
    t = F.coalesce(_c(text), F.lit(""))
    found = [F.regexp_extract_all(t, F.lit(r"(?im)^[ \t]*" + label + r"[ \t]*(?:[:|-]|[ \t]{2,})[ \t]*(\S[^\n]*)$"), F.lit(1)) for label in labels]
    return F.transform(F.flatten(F.array(*found)), lambda v: F.trim(v))


def markdown_images(text: Column | str) -> Column:
    """Addresses of images in markdown."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def escape_html(c: Column | str) -> Column:
    """&, <, > and quotes as entities."""
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def text_slice(c: Column | str, start: Column, end: Column) -> Column:
    """Characters start..end (0-based, end excluded), clamped to the text."""
    t = _c(c)
    a = F.greatest(F.lit(0), F.least(start, F.length(t)))
    b = F.greatest(a, F.least(end, F.length(t)))
    return F.substring(t, a + 1, b - a)


def numeric_evidence(c: Column | str, most: int = 3) -> Column:
    """The clauses with most numbers of weight: p-values 4, percentages 3, mg/kg 2, Cmax or AUC 2, dosing intervals 1."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"(?<=[.;])\s+"), squeeze), lambda x: x != "")
    worth = lambda x: F.when(x.rlike(r"(?i)\bp\s*[<=>]"), 4).otherwise(0) + F.when(x.rlike(r"\d\s*%"), 3).otherwise(0) + F.when(x.rlike(r"(?i)mg/kg"), 2).otherwise(0) + F.when(x.rlike(r"(?i)\b(cmax|auc)"), 2).otherwise(0) + F.when(x.rlike(r"(?i)\bq\d+d\b"), 1).otherwise(0)
    scored = F.transform(ordered_distinct(parts), lambda x: F.struct((-worth(x)).alias("w"), (-F.length(x)).alias("l"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["w"] < 0)), 1, most), lambda s: s["x"])
