"""Title pages and paths of study reports: numbers, identifiers, test system, route, facility, compliance, section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.inference import file_stem
from docquarry.functions.text import _c, blank_to_null, ordered_distinct, squeeze

# Labels, species and routes looked for in order, signs of facilities and of what is none, types of study by section.
NUMBER_LABELS = ("Study Number", "Study No.", "Study No", "Study ID", "Report Number", "Report No.", "Protocol Number", "Protocol No.")
SYSTEM_LABELS = ("Test System", "Species/Strain", "Species / Strain", "Species", "Strain", "Animal Model")
ROUTE_LABELS = ("Method of Administration", "Route of Administration", "Administration Route", "Route", "Dosing Route")
FACILITY_LABELS = ("Testing Facility", "Test Facility", "Facility", "Testing Laboratory", "Laboratory", "Performed At", "Conducted At", "Sponsor")
ROUTE_NAMES = ("intravenous", "intraperitoneal", "intramuscular", "subcutaneous", "intradermal", "oral", "topical", "intranasal", "inhalation", "intrathecal", "intravitreal")
SPECIES_NAMES = ("cynomolgus monkey", "rhesus monkey", "beagle dog", "sprague-dawley rat", "wistar rat", "c57bl/6 mice", "c57 bl/6 mice", "mouse", "mice", "rat", "rabbit", "dog", "monkey")
FACILITY_HINTS = r"inc|llc|ltd|corp|corporation|company|co\.|co,|laborator|labs|lab |institute|university|center|centre|biotech|pharma|contract research|cro|facility"
NO_FACILITY = r"(?i)\bmg\s*/?\s*kg\b|\bdos(?:e|ing)\b|\b(?:day|week|month)s?\b|\b(?:rats?|mice|mouse|monkeys?|dogs?|rabbits?)\b"
FACILITY_SENTENCES = (
    r"(?im)\b(?:testing|test)\s+facilit(?:y|ies)\b(?:\s*\([^)]*\))?\s*(?:was|were|is|are|:|-)\s*([^\n;]+)",
    r"(?im)\b(?:study|studies|work|experiments?)\b[^.\n]{0,80}?\b(?:conducted|performed|carried out)\s+(?:at|by)\s+([^\n;]+)",
    r"(?im)\b(?:contract\s+research\s+organization|cro)\b(?:\s*\([^)]*\))?\s*(?::|-|was|is)?\s*([^\n;]+)",
)
SECTION_TYPES = {"4.2.1.1": "Primary pharmacodynamics", "4.2.1.2": "Secondary pharmacodynamics", "4.2.1.3": "Safety pharmacology", "4.2.1.4": "Pharmacodynamic drug interactions"}
FIRST_LINES = {
    "study_no": [r"study\s*(?:no\.?|number|id)[:\-\s]+(.+)"],
    "facility": [r"(?:facility|test\s*site|laboratory)[:\-\s]+(.+)"],
    "sponsor": [r"(?:sponsor|study\s*sponsor)[:\-\s]+(.+)"],
    "date": [r"(?:date|study\s*date|report\s*date|start\s*date|final\s*report\s*date)[:\-\s]+(.+)", r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z]*\s+\d{1,2},?\s+\d{2,4})", r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"],
    "title": [r"(?:title|study\s*title|protocol\s*title)[:\-\s]+(.+)"],
}


def _escaped(label: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)


def labelled(text: Column | str, labels: tuple[str, ...]) -> Column:
    """Values behind ``label:`` (or -, |, two blanks) at line starts, in label order, then in order of the text; blanks dropped."""
    t = F.coalesce(_c(text), F.lit(""))
    found = [F.regexp_extract_all(t, F.lit(rf"(?im)^\s*{_escaped(label)}\s*(?:[:\-]\s*|\|\s*|\s{{2,}})([^|\n\r]+)"), F.lit(1)) for label in labels]
    return F.filter(F.transform(F.flatten(F.array(*found)), squeeze), lambda x: x != "")


def first_pages(markdown: Column | str, most: int = 3, otherwise: int = 30_000) -> Column:
    """Text of the pages up to ``most`` of a document with ``## Page n`` lines; without such pages its first characters."""
    t = F.coalesce(_c(markdown), F.lit(""))
    parts = F.slice(F.split(t, r"(?m)^(?=## Page\s+\d+\b)"), 1, 2**31 - 1)
    number = lambda p: F.regexp_extract(p, r"^## Page\s+(\d+)\b", 1)
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"^## Page\s+\d+\b", ""), r"^\s+|\s+$", "")
    kept = F.filter(F.transform(F.filter(parts, lambda p: (number(p) != "") & (number(p).try_cast("int") <= most)), body), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(F.substring(t, 1, otherwise))


def without_tables(text: Column | str) -> Column:
    """Lines that aren't rows of a markdown table."""
    return F.array_join(F.filter(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: ~x.rlike(r"^\s*\|.*\|\s*$")), "\n")


def study_number(c: Column) -> Column:
    """A study number without the words in front and what follows it; '' for anything that can't be one."""
    cut = lambda x: F.regexp_replace(x, r"^[ .,:;]+|[ .,:;]+$", "")
    bare = cut(F.regexp_replace(cut(squeeze(c)), r"(?i)^(?:study|report|protocol)\s*(?:number|no\.?|id|#)\s*[:\-]?\s*", ""))
    head = F.trim(F.regexp_extract(bare, r"^([^;,\t]*)", 1))
    no = head.rlike(r"(?i)^(?:input\.p\d+\.t\d+|p\d+\.t\d+)$") | head.rlike("(?i)^(u201|u00)") | ~head.rlike(r"\d")
    numeric = head.rlike(r"^\d{5,}$") | head.rlike(r"^\d{2,}(?:[-./]\d{2,})+$")
    return F.when(~no & (head.rlike("[A-Za-z]") | numeric), head).otherwise("")


def _first(values: Column) -> Column:
    return F.get(F.filter(F.transform(values, study_number), lambda x: x != ""), F.lit(0))


def synthetic_number(digest: Column | str) -> Column:
    """DOC-ddd-HHHHHHHH of a content hash, for reports without a number."""
    d = F.coalesce(F.nullif(F.upper(F.substring(F.coalesce(_c(digest), F.lit("")), 1, 8)), F.lit("")), F.lit("00000000"))
    return F.concat(F.lit("DOC-"), F.substring(F.rpad(F.regexp_replace(d, r"\D", ""), 3, "0"), 1, 3), F.lit("-"), d)


def report_number(text: Column | str, file_name: Column | str, digest: Column | str) -> Column:
    """The study number behind a label, else in the file name, else a synthetic one."""
    in_name = F.regexp_extract_all(file_stem(file_name), F.lit(r"(?i)\b(?=[A-Z0-9.-]*[A-Z])(?=[A-Z0-9.-]*\d)[A-Z0-9]{2,}(?:[-.][A-Z0-9]+)+\b"), F.lit(0))
    return F.coalesce(_first(labelled(text, NUMBER_LABELS)), _first(in_name), synthetic_number(digest))


def identifiers(text: Column | str, file_name: Column | str, digest: Column | str) -> Column:
    """Struct study_number, display, sponsor, contractor: the sponsor's number counts before the labelled one."""
    t = F.coalesce(_c(text), F.lit(""))
    of = lambda who: study_number(F.regexp_extract(t, rf"(?im){who}[^\n:;]*study(?:\s*(?:number|no\.?|id|#))?\s*[:#-]\s*([^;|\n]+)", 1))
    contractor = of("cro")
    primary = F.coalesce(F.nullif(of("sponsor"), F.lit("")), report_number(text, file_name, digest))
    other = (contractor != "") & (F.lower(contractor) != F.lower(primary))
    display = F.concat(F.lit("Sponsor study #: "), primary, F.when(other, F.concat(F.lit("; CRO study #: "), contractor)).otherwise(""))
    return F.struct(primary.alias("study_number"), display.alias("display"), primary.alias("sponsor"), contractor.alias("contractor"))


def _named_first(text: Column | str, names: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in names], F.lit(""))


def species_named(text: Column | str) -> Column:
    """The first species of the list that the text holds, each word capitalised."""
    return F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(n)), F.lit(n.title())) for n in SPECIES_NAMES], F.lit(""))


def route_named(text: Column | str) -> Column:
    return _named_first(text, ROUTE_NAMES)


def _short(values: Column, most: int = 240) -> Column:
    return F.get(F.filter(values, lambda v: F.length(v) <= most), F.lit(0))


def test_system(text: Column | str) -> Column:
    return F.coalesce(_short(labelled(text, SYSTEM_LABELS)), species_named(text))


def method_of_administration(text: Column | str) -> Column:
    return F.coalesce(_short(labelled(text, ROUTE_LABELS)), route_named(text))


def testing_facility(text: Column | str) -> Column:
    """The first plausible facility behind a label or in a sentence; those with a sign of a company or institute before others."""
    t = F.coalesce(_c(text), F.lit(""))
    raw = F.concat(labelled(text, FACILITY_LABELS), F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in FACILITY_SENTENCES])))
    edge = lambda x: F.regexp_replace(x, r"^[ ,:;()\[\]{}\"']+|[ ,:;()\[\]{}\"']+$", "")
    cleaned = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(edge(squeeze(x)), r"(?i)^(?:at|by|the|testing facility|test facility|facility|laboratory)\s+", ""), r"^[ ,:;]+|[ ,:;]+$", ""))
    likely = F.filter(cleaned, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin("na", "n/a", "none", "unknown", "not applicable") & ~x.rlike(NO_FACILITY) & x.rlike("[A-Za-z]") & (F.size(F.split(x, r"\s+")) <= 20))
    distinct = ordered_distinct(likely)
    return F.coalesce(F.get(F.filter(distinct, lambda x: F.lower(x).rlike(FACILITY_HINTS)), F.lit(0)), F.get(distinct, F.lit(0)), F.lit(""))


def glp_statement(text: Column | str) -> Column:
    """The first line that speaks of good laboratory practice, at most 300 characters."""
    lines = F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\r\n|\n|\r"), squeeze)
    return F.coalesce(F.substring(F.get(F.filter(lines, lambda x: x.rlike(r"(?i)\bgood laboratory practice\b|\bnon[- ]?glp\b|\bglp\b")), F.lit(0)), 1, 300), F.lit(""))


def glp_status(text: Column | str) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.when(low.rlike(r"\bnon[- ]?glp\b|\bnot\b[^\n]{0,60}\bglp\b"), "Non-GLP").when(low.rlike(r"\bgood laboratory practice\b|\bglp\b"), "GLP").otherwise("")


def section_of_key(key: Column | str) -> Column:
    """Struct section_number (number of the last folder that has one, with the file's name behind) and section_title."""
    k = F.coalesce(_c(key), F.lit(""))
    stem = file_stem(k)
    suffix = F.regexp_replace(F.regexp_replace(F.trim(stem), r"\s+", "_"), "[^A-Za-z0-9._-]+", "")
    suffix = F.coalesce(F.nullif(suffix, F.lit("")), F.lit("document"))
    rx = r"\d+(?:\.\d+)+(?:\|\d+(?:\.\d+)+)*"
    folder = F.try_element_at(F.filter(F.split(F.regexp_replace(k, r"[^/]*$", ""), "/"), lambda x: x.rlike(rx)), F.lit(-1))
    token = F.regexp_extract(folder, rx, 0)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(F.replace(folder, token, F.lit("")), F.lit("|"), F.lit(" ")), "[\"']", ""), r"^[\s._-]+", ""), r"\s{2,}", " "))
    return F.struct(F.when(folder.isNotNull(), F.concat(token, F.lit("."), suffix)).otherwise(suffix).alias("section_number"), F.coalesce(F.nullif(title, F.lit("")), stem).alias("section_title"))


def pharmacology_section(key: Column | str, allowed: tuple[str, ...] = tuple(SECTION_TYPES)) -> Column:
    """The first allowed section 4.2.1.1 to 4.2.1.4 of a path; null without."""
    found = F.regexp_extract_all(F.coalesce(_c(key), F.lit("")), F.lit(r"(?<!\d)(4\.2\.1\.[1-4])(?!\d)"), F.lit(1))
    return F.get(F.filter(found, lambda x: x.isin(*allowed)), F.lit(0))


def section_type(section: Column | str) -> Column:
    return F.coalesce(*[F.when(_c(section) == s, t) for s, t in SECTION_TYPES.items()], F.lit("Pharmacology study"))


def overview(key: Column | str, file_name: Column | str, markdown: Column | str, digest: Column | str) -> Column:
    """All that is taken from the first three pages of a report, its name and its path, as a struct."""
    text = without_tables(first_pages(markdown))
    ids = identifiers(text, file_name, digest)
    section = pharmacology_section(key)
    title = F.trim(F.replace(file_stem(file_name), F.lit("_"), F.lit(" ")))
    status = glp_status(text)
    return F.struct(
        ids["study_number"].alias("study_number"), ids["display"].alias("study_number_display"), ids["sponsor"].alias("sponsor_study_number"), ids["contractor"].alias("cro_study_number"),
        test_system(text).alias("test_system"), method_of_administration(text).alias("method_of_administration"), testing_facility(text).alias("testing_facility"),
        status.alias("glp_status"), F.coalesce(F.nullif(glp_statement(text), F.lit("")), status).alias("glp_compliance"), section_type(section).alias("type_of_study"),
        title.alias("study_title"), F.concat(F.lit("Module 4, Section "), F.coalesce(section, F.lit("")), F.lit(': "'), title, F.lit('"')).alias("location_in_ctd"),
    )


def first_line_metadata(text: Column | str) -> Column:
    """Struct title, study_no, facility, sponsor, date: the first line that matches one of a field's patterns; the title falls back to the first line of three words."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\r\n|\n|\r"), lambda v: F.trim(v)), lambda x: x != "")

    def first(patterns: list[str]) -> Column:
        each = F.transform(lines, lambda line: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(line, "(?i)" + p, 1)), F.lit("")) for p in patterns]))
        return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))

    worded = F.get(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 3), F.lit(0))
    return F.struct(F.coalesce(first(FIRST_LINES["title"]), worded).alias("title"), *[first(FIRST_LINES[n]).alias(n) for n in ("study_no", "facility", "sponsor", "date")])
