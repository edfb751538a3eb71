"""What free text says of a study: route, species, doses, group sizes, endpoints, findings, compliance; title pages of reports."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import _c, blank_to_null, clip, compact_number, glp, labels_by_pattern, let, merge_segments, ordered_distinct, path_mentions_section, squeeze, study_ids

# Routes, strains with their species, species, dose and group size patterns, parts of words that show endpoints and effects, and what findings say.
ROUTES = [
    ("In vitro", r"\bin vitro\b|\bcell[- ]based\b|\belisa\b"),
    ("Intravenous", r"\bintravenous\b|\biv\b"),
    ("Subcutaneous", r"\bsubcutaneous\b|\bsc\b"),
    ("Intraperitoneal", r"\bintraperitoneal\b|\bip\b"),
    ("Intrathecal", r"\bintrathecal\b|\bit\b"),
    ("Intraplantar", r"\bintraplantar\b"),
    ("Oral", r"\boral\b|\bpo\b"),
    ("Topical", r"\btopical\b"),
    ("Inhalation", r"\binhal(?:ation|ed)\b"),
]
STRAINS = [
    ("Sprague-Dawley", "Rat", r"\bsprague[- ]?dawley\b|\bsd rats?\b"),
    ("Wistar", "Rat", r"\bwistar\b"),
    ("C57BL/6", "Mouse", r"\bc57\s*bl\s*/?\s*6\b"),
    ("DBA/2", "Mouse", r"\bdba/?2\b"),
    ("CBA", "Mouse", r"\bcba\b"),
    ("NMRI", "Mouse", r"\bnmri\b"),
    ("CD-1", "Mouse", r"\bcd[- ]?1\b"),
    ("ZDF", "Rat", r"\bzdf\b|\bzucker diabetic fatty\b"),
]
SPECIES = [
    ("Cynomolgus monkey", r"\bcynomolgus\b"),
    ("Monkey", r"\bmonkeys?\b|\bnon[- ]human primates?\b"),
    ("Dog", r"\bdogs?\b|\bbeagles?\b"),
    ("Rabbit", r"\brabbits?\b"),
    ("Rat", r"\brats?\b"),
    ("Mouse", r"\bmice\b|\bmouse\b"),
    ("Human whole blood (in vitro)", r"\bhuman whole blood\b"),
]
_AMOUNT = r"\d+(?:\.\d+)?"
DOSE_SERIES = rf"(?i)\b(?:{_AMOUNT}\s*(?:,|and|or)\s*)+{_AMOUNT}\s*(?:mg|ug|g)\s*/\s*kg\b"
DOSE_SINGLE = rf"(?i)\b{_AMOUNT}\s*(?:mg|ug|g)\s*/\s*kg\b"
DOSE_ABSOLUTE = rf"(?i)\b{_AMOUNT}\s*(?:ug|mg)\b\s*(?:intrathecal|it)\b"
GROUP_SIZES = [r"(?i)\bn\s*=\s*(\d+)\b", r"(?i)\b(\d+)\s*(?:animals?|rats?|mice|monkeys?|dogs?)\s*/\s*group\b", r"(?i)\b(\d+)\s*per\s*group\b"]
ENDPOINTS = [
    ("Tumor growth/volume", "tumor|xenograft|allograft|metast"),
    ("Angiogenesis-related endpoints", "angiogenesis|vascular|matrigel"),
    ("Survival", "survival|mortality"),
    ("Body weight", "body weight"),
    ("Pain response endpoints", "pain|nocicept|analgesi"),
]
NO_ENDPOINT = "Primary pharmacodynamic efficacy endpoints"
EFFECTS = "inhibit|mitigat|reduc|suppress|prevent|attenuat|improv|increase|decrease"
NO_CHANGE = r"(?i)\b(no|not|without)\b.*\b(treatment-related|change|changes|adverse|effect|effects|toxicologically meaningful|clinically meaningful)\b"
CHANGE = r"(?i)\b(increase|increased|decrease|decreased|prolong|shorten|elevat|reduc|finding|signal|change)\b"
_PATHS = r"(?i)\b(?:https?://|s3://)\S+|\b\S+\.pdf(?:\.(?:tables|images))?(?:/\S+)?"
_CUT = r"(?i)\.\.\.\[truncated\]"


def joined_text(*cs: Column | str) -> Column:
    """Values that aren't blank, joined by blanks."""
    return F.concat_ws(" ", *[F.when(F.trim(_c(c)) != "", _c(c)) for c in cs])


# Cleaning


def unescaped(c: Column | str) -> Column:
    """Entities as the characters they stand for; only texts with an ampersand go through Python."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return F.coalesce(plain(F.when(F.contains(_c(c), F.lit("&")), _c(c))), _c(c), F.lit(""))


def lifted_summary(c: Column | str) -> Column:
    """The summary that a text in the form of an object holds (up to two levels deep), else null."""
    t = F.trim(_c(c))
    j = F.when(t.startswith("{"), t)
    inner = F.coalesce(F.get_json_object(j, "$.summary.summary"), F.get_json_object(j, "$.summary"))
    deeper = F.coalesce(F.get_json_object(F.when(F.ltrim(inner).startswith("{"), inner), "$.summary"), inner)
    written = F.regexp_extract(t, r"""(?is)['"]summary['"]\s*:\s*['"](.+?)['"]\s*(?:,|})""", 1)
    return F.when(F.contains(F.lower(t), F.lit("summary")), F.coalesce(blank_to_null(deeper), blank_to_null(written)))


def tidied(c: Column | str) -> Column:
    """Text without paths, marks of truncation and leading row numbers, in single blanks."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), _PATHS, " "), _CUT, " ")
    numbered = F.regexp_replace(bare, r"(?<![^;,\s])\d{1,2}\s*:\s*", " ")
    return F.regexp_replace(squeeze(numbered), r"^[ ;,]+|[ ;,]+$", "")


def clean_extracted(c: Column | str) -> Column:
    """Extracted text with entities resolved, a nested summary lifted, and tidied; '' for null."""
    plain = unescaped(c)
    return tidied(F.coalesce(lifted_summary(plain), plain))


def is_noise(c: Column | str) -> Column:
    """Blank fragments and those left by the extraction (paths of tables, truncation marks)."""
    low = F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    return (low == "") | F.contains(low, F.lit("pdf.tables")) | F.contains(low, F.lit("[truncated]")) | low.startswith("xml files/")


def clauses(c: Column | str, most: int = 4) -> Column:
    """The first clean sentences or clauses with at least five letters and no noise."""
    parts = F.transform(F.split(clean_extracted(c), r"(?<=[.!?])\s+|\s*;\s*"), tidied)
    return F.slice(F.filter(parts, lambda x: ~is_noise(x) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 5)), 1, most)


def clean_block(c: Column | str) -> Column:
    """Lines without bullets, blank ones and noise (25 characters or more of which under a quarter are letters or digits)."""
    line = lambda x: F.regexp_replace(x, "[·•◦●∙]", "")
    noisy = lambda x: (F.length(x) >= 25) & (F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) < 0.25 * F.length(x))
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\r\n|\n|\r"), line)
    return F.array_join(F.filter(F.transform(F.filter(lines, lambda x: ~noisy(x)), lambda v: F.trim(v)), lambda x: x != ""), "\n")


# What a text says of a study


def administration(*cs: Column | str) -> Column:
    """Routes named in the texts, in rule order, joined by "; "."""
    return F.array_join(labels_by_pattern(joined_text(*cs), ROUTES), "; ")


def species_strain(*cs: Column | str) -> Column:
    """The first species named (else that of the first strain), with the strains in parentheses."""
    text = joined_text(*cs)
    strains = labels_by_pattern(text, [(s, p) for s, _, p in STRAINS])
    species = F.coalesce(F.get(labels_by_pattern(text, SPECIES), F.lit(0)), F.get(labels_by_pattern(text, [(of, p) for _, of, p in STRAINS]), F.lit(0)))
    return F.when(species.isNull(), "").when(F.size(strains) > 0, F.concat(species, F.lit(" ("), F.array_join(strains, ", "), F.lit(")"))).otherwise(species)


def doses_named(*cs: Column | str) -> Column:
    """Doses per kg (series, then single ones), then absolute intrathecal ones, in compact numbers, distinct, joined by ", "."""
    text = joined_text(*cs)

    def of(pattern: str, behind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        unit = lambda m: F.lower(F.regexp_extract(m, r"(?i)(mg|ug|g)\s*(?:/\s*kg|intrathecal|it)$", 1))
        return F.flatten(F.transform(found, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: F.concat(compact_number(n), F.lit(" "), unit(m), F.lit(behind)))))

    return F.array_join(F.array_distinct(F.concat(of(DOSE_SERIES, "/kg"), of(DOSE_SINGLE, "/kg"), of(DOSE_ABSOLUTE, ""))), ", ")


def group_size(*cs: Column | str) -> Column:
    """Sex and animals per group as named in the texts (at most three sizes)."""
    text = joined_text(*cs)
    low = F.lower(text)
    male, female = low.rlike(r"\bmale\b"), low.rlike(r"\bfemale\b")
    sex = F.when(male & female, "Male/Female").when(male, "Male").when(female, "Female").otherwise("")
    sizes = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in GROUP_SIZES])))
    shown = F.array_join(F.transform(F.slice(sizes, 1, 3), lambda n: F.concat(F.lit("n="), n, F.lit("/group"))), ", ")
    both = (sex != "") & (F.size(sizes) > 0)
    return F.when(both & (F.size(sizes) == 1), F.concat(sex, F.lit(", "), shown)).when(both, F.concat(sex, F.lit("; "), shown)).otherwise(F.concat(sex, shown))


def endpoints(*cs: Column | str) -> Column:
    """Labels of the endpoints a text speaks of, a general one without any; '' for no text."""
    text = joined_text(*cs)
    found = labels_by_pattern(text, ENDPOINTS)
    return F.when(text == "", "").when(F.size(found) == 0, NO_ENDPOINT).otherwise(F.array_join(found, "; "))


def main_finding(*cs: Column | str) -> Column:
    """The first of six clauses that names an effect, else the first clause, else the text; at most 320 characters."""
    text = joined_text(*cs)
    parts = clauses(text, 6)
    effect = F.get(F.filter(parts, lambda x: F.lower(x).rlike(EFFECTS)), F.lit(0))
    return clip(squeeze(F.coalesce(effect, F.get(parts, F.lit(0)), text)), 320)


def findings_summary(fragments: Column) -> Column:
    """Of the distinct clauses of several fragments the first that denies a change and the first two that state one, else the first two others; at most 900 characters."""
    parts = ordered_distinct(F.flatten(F.transform(fragments, lambda f: F.coalesce(_plain_clauses(f), F.array().cast("array<string>")))))
    none = lambda x: x.rlike(NO_CHANGE)
    some = lambda x: ~x.rlike(NO_CHANGE) & x.rlike(CHANGE)
    chosen = lambda ps: F.concat(F.slice(F.filter(ps, none), 1, 1), F.slice(F.filter(ps, some), 1, 2))
    text = let(parts, lambda ps: let(chosen(ps), lambda c: F.array_join(F.when(F.size(c) > 0, c).otherwise(F.slice(ps, 1, 2)), "; ")))
    return clip(text, 900)


def _plain_clauses(x: Column, most: int = 4) -> Column:
    """As :func:`clauses` for text without entities or nested summaries (a lambda's variable can't go through Python)."""
    parts = F.transform(F.split(tidied(x), r"(?<=[.!?])\s+|\s*;\s*"), tidied)
    return F.slice(F.filter(parts, lambda p: ~is_noise(p) & (F.length(F.regexp_replace(p, r"[^\p{L}]", "")) >= 5)), 1, most)


def glp_of(*cs: Column | str) -> Column:
    """The first strict GLP or Non-GLP among several values, else ''."""
    return F.coalesce(*[F.when(glp(c).isin("GLP", "Non-GLP"), glp(c)) for c in cs], F.lit(""))


def mentions_topic(section: str, phrases: list[str], *cs: Column | str) -> Column:
    """Whether the parts describing an asset mention a section (dotted or run together) or one of the phrases."""
    blob = joined_text(*cs)
    return path_mentions_section(blob, F.lit(section)) | reduce(lambda a, b: a | b, [F.contains(F.lower(blob), F.lit(p)) for p in phrases])


def is_safety_asset(*cs: Column | str) -> Column:
    return mentions_topic("4.2.1.3", ["safety pharmacology"], *cs)


def is_primary_asset(*cs: Column | str) -> Column:
    return mentions_topic("4.2.1.1", ["primary pharmacodynamics", "primary pharmacology"], *cs)


def single_study_id(*cs: Column | str) -> Column:
    """The only study id that the parts of an asset name; '' for none or several."""
    ids = F.filter(study_ids(joined_text(*cs)), lambda x: ~F.contains(x, F.lit("/")))
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).otherwise("")


def quoted_title(c: Column | str) -> Column:
    """The first text between double quotes, in single blanks; '' without."""
    return squeeze(F.regexp_extract(F.coalesce(_c(c), F.lit("")), '"([^"]+)"', 1))


def file_stem(c: Column | str) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def study_display(number: Column | str, display: Column | str, sponsor: Column | str, contractor: Column | str) -> Column:
    """How a study number is shown: as given, else by sponsor's and contractor's numbers, else the number with the contractor's."""
    s, k, n = (blank_to_null(c) for c in (sponsor, contractor, number))
    named = merge_segments(F.coalesce(F.concat(F.lit("Sponsor study #: "), s), F.lit("")), F.coalesce(F.concat(F.lit("CRO study #: "), k), F.lit("")))
    return F.coalesce(blank_to_null(display), F.nullif(named, F.lit("")), n, F.lit(""))


def first_words(c: Column | str, most: int = 12) -> Column:
    """A title of the first words, with " ..." where more follow."""
    words = F.filter(F.split(squeeze(F.coalesce(_c(c), F.lit(""))), " "), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, " ...").otherwise(""))


def header_list(c: Column | str) -> Column:
    """Column names of a header text: parted by ";", or by "|" where it has none; blanks dropped."""
    t = F.coalesce(_c(c), F.lit(""))
    parts = F.when(F.contains(t, F.lit(";")) | ~F.contains(t, F.lit("|")), F.split(t, ";")).otherwise(F.split(t, r"\|"))
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda x: x != "")


def meaningful_cells(cells: dict[str, Column], token: dict[str, str]) -> Column:
    """How many cells besides the study number say something ("not reported" compliance and placeholders don't)."""
    from docquarry.functions.text import is_placeholder

    says = lambda name, c: (~is_placeholder(c)) & ~((F.lit(token.get(name, name)) == "glp compliance") & (F.lower(F.trim(c)) == "not reported"))
    return sum((F.when(says(n, c), 1).otherwise(0) for n, c in cells.items() if token.get(n, n) != "study number"), F.lit(0))
