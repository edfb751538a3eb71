"""Retrieval of sections, assets and keys of a project; template entries; work still to be done; state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import blank_to_null, element_number, section_matches, study_ids
from docquarry.operators.relational import top_per_key

# Predicates


def like_escaped(text: str) -> str:
    """Text for a LIKE pattern, its wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def in_project(key: Column, project: str) -> Column:
    """Whether a path holds a folder of that name, ignoring case."""
    return key.ilike(f"%/{like_escaped(project)}/%")


def clean_prefix(prefix: str | None) -> str:
    """A folder prefix without outer blanks and leading slashes, with one at its end; '' for none."""
    bare = (prefix or "").strip().lstrip("/")
    return bare and bare.rstrip("/") + "/"


def project_filter(df: DataFrame, key: str, name: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows of a project: by prefix if there is one, else by folder name, else all."""
    start = clean_prefix(prefix)
    return df.where(F.col(key).ilike(like_escaped(start) + "%")) if start else df.where(in_project(F.col(key), name)) if name else df


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in all columns whose value is given (None: not asked for)."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def same_or_blank(a: Column, b: Column) -> Column:
    """Equality for which null and '' are one value."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def begins_with_section(c: Column, section: str) -> Column:
    """The section, or anything that begins with its text (2.4 meets 2.40 too)."""
    return F.coalesce((c == section) | c.startswith(section), F.lit(False))


def is_trivial(text: Column, least: int = 400) -> Column:
    """Empty, said to be without text, or short."""
    t = F.coalesce(text, F.lit(""))
    return F.contains(F.lower(t), F.lit("no extractable text")) | (F.length(F.trim(t)) < least)


# Templates


def entries_for(entries: DataFrame, target: str, section: str = "section", subsection: str = "subsection", element: str = "element") -> DataFrame:
    """Entries that match a target, with ``matched``: by element, else subsection, else section, else a section that begins with it."""
    low = target.strip().lower()
    if not low:
        return entries.limit(0).withColumn("matched", F.lit(None).cast("string"))
    s, sub, e = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (section, subsection, element))
    wanted = "-".join(low.split())
    matched = F.when((e != "") & (e == wanted), "element").when((sub != "") & (sub == low), "subsection").when(s == low, "section").when(s.startswith(low), "prefix")
    return entries.withColumn("matched", matched).where("matched is not null")


def elements_for(entries: DataFrame, target: str, element: str, position: str) -> DataFrame:
    """element, position: the elements that are the target or lie below it (behind a dot or hyphen), each where first seen."""
    wanted = "-".join(target.strip().lower().split())
    name = element_number(element)
    rows = entries.select(name.alias("element"), F.col(position).alias("position")).where((F.col("element") == wanted) | F.col("element").startswith(wanted + ".") | F.col("element").startswith(wanted + "-"))
    return rows.groupBy("element").agg(F.min("position").alias("position"))


def entries_in(entries: DataFrame, allowed: DataFrame, value: str, section: str = "section", subsection: str = "subsection") -> DataFrame:
    """Entries whose subsection (section, where that is blank) is allowed; nothing is if none is given."""
    own = F.coalesce(blank_to_null(subsection), blank_to_null(section))
    return entries.withColumn("__s", own).join(allowed.select(F.trim(value).alias("__s")).where("__s <> ''"), "__s", "left_semi").drop("__s")


def first_family(families: DataFrame, family: str, rank: str, section: str) -> DataFrame:
    """section, family: the first family, by rank, that has the section."""
    return top_per_key(families.select(section, family, rank).distinct(), [section], [F.col(rank), F.col(family)]).select(section, family)


def targets_of(mapping: DataFrame, section: str, targets: str, wanted: str) -> DataFrame:
    """source, target: mapped targets (array of structs section, kind) that are the wanted section or lie below it."""
    rows = mapping.select(F.col(section).alias("source"), F.explode(targets).alias("t")).select("source", F.col("t.section").alias("target"))
    return rows.where((F.col("target") == wanted) | F.col("target").startswith(wanted + ".")).distinct()


# Joins


def assets_of_sections(assets: DataFrame, version: str, sections: DataFrame, number: str, wanted: list[str]) -> DataFrame:
    """Assets of versions that have a section of one of the families; sections only decide, they don't multiply rows."""
    hit = reduce(lambda a, b: a | b, [section_matches(number, F.lit(w)) for w in wanted], F.lit(False))
    return assets.join(sections.where(hit).select(version), version, "left_semi")


def keys_of_sections(documents: DataFrame, key: str, wanted: list[str], limit: int | None = None) -> DataFrame:
    """Distinct keys with a folder or file that begins with one of the sections (no end boundary), in order."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(key)), F.lit("/" + w.lower())) for w in wanted], F.lit(False))
    keys = documents.where(hit).select(key).distinct().orderBy(key)
    return keys.limit(limit) if limit is not None else keys


def keys_with_studies(listing: DataFrame, key: str, prefix: str, wanted: list[str]) -> DataFrame:
    """Keys under a prefix that hold one of the section tokens and a study id, each once."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.col(key), F.lit(w)) for w in wanted], F.lit(False))
    return listing.where(F.col(key).startswith(prefix) & hit & (F.size(study_ids(key)) > 0)).select(key).distinct()


def project_prefix(df: DataFrame, key: str, position: str, project: str) -> DataFrame:
    """prefix: the first key that has the project's folder (ignoring case), up to and with it."""
    at = F.instr(F.lower(F.col(key)), F.lit(f"/{project.lower()}/"))
    rows = df.where(at > 0).select(F.substring(F.col(key), F.lit(1), at + len(project) + 1).alias("prefix"), F.col(position).alias("__p"))
    return rows.orderBy("__p", "prefix").limit(1).select("prefix")


def key_passages(passages: DataFrame, document: str, position: str, topic: str, text: str, per_document: int | None = None) -> DataFrame:
    """The first passages of each document; those without topic or text are left out."""
    rows = passages.where((F.trim(F.coalesce(topic, F.lit(""))) != "") & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return top_per_key(rows, [document], [F.col(position)], per_document) if per_document is not None else rows


# Work to be done, and state


def core_needed(check: str, has_text: Column, completed: Column, force: bool = False) -> Column:
    """Whether a document's core stage has to run, by the existence of its text, its status, or both."""
    by = {"md": ~has_text, "status": ~completed, "both": ~has_text | ~completed}
    return F.lit(True) if force else by.get(check, F.lit(False))


def fully_ingested(mode: str, stages: dict[str, Column], enabled: list[str], sidecars: list[Column], tox_data: Column, pk_data: Column, forced: tuple[str, ...] = ()) -> Column:
    """Whether nothing is left to do: sidecars and enabled stages of the core, and the facts of the mode.

    ``stages``: status by stage name ("tox" among them). ``forced`` stages count as not
    done: those of the core undo the core, "tox" and "pk" their own part. Mode ``auto``
    needs core and tox, but not pk.
    """
    done = lambda s: F.coalesce(F.lower(F.trim(stages[s])) == "completed", F.lit(False))
    core = reduce(lambda a, b: a & b, [*sidecars, *[done(s) for s in enabled]], F.lit(not set(forced) & {"core", *enabled}))
    tox, pk = done("tox") & tox_data & F.lit("tox" not in forced), done("tox") & pk_data & F.lit("pk" not in forced)
    return {"core": core, "tox": tox, "pk": pk}.get(mode, core & tox)


def skipped(df: DataFrame, status: str, has_text: str, run_core: bool = True, force: bool = False) -> Column:
    """Whether the core stage is skipped: completed before, and its text still there."""
    return F.lit(False) if force or not run_core else F.coalesce(F.col(status) == "completed", F.lit(False)) & F.coalesce(F.col(has_text), F.lit(False))


def approved(df: DataFrame, key: str, approvals: DataFrame, final: str, text: str = "text", status: str = "status") -> DataFrame:
    """Drafts that have an approval become ``approved`` with its final text; anything else stays."""
    a = approvals.select(key, F.col(final).alias("__f"), F.lit(True).alias("__a")).dropDuplicates([key])
    turns = F.col("__a").isNotNull() & (F.col(status) == "draft")
    joined = df.join(a, key, "left").withColumn("__t", turns)
    return joined.withColumn(text, F.when(F.col("__t"), F.col("__f")).otherwise(F.col(text))).withColumn(status, F.when(F.col("__t"), "approved").otherwise(F.col(status))).select(*df.columns)


def purge(df: DataFrame, kind: str, value: str, key: str, prefix: str) -> DataFrame:
    """Rows without those of a kind whose key begins with a prefix."""
    return df.where(~F.coalesce((F.col(kind) == value) & F.col(key).startswith(prefix), F.lit(False)))


def replace_flagged(current: DataFrame, rows: DataFrame, parent: str, flag: str) -> DataFrame:
    """Flagged rows of the parents that come again are replaced; others (false or null) stay."""
    touched = rows.select(parent).distinct().withColumn("__d", F.lit(True))
    kept = current.join(touched, parent, "left").where(F.col("__d").isNull() | ~F.coalesce(F.col(flag), F.lit(False))).drop("__d")
    return kept.unionByName(rows)


def ensure_versions(documents: DataFrame, versions: DataFrame, arrivals: DataFrame, identity: list[str], digest: str, document: str) -> tuple[DataFrame, DataFrame]:
    """Documents and versions after arrivals: a document is found by its identity, else added; a version by document and digest, else added.

    New documents get ``document`` from a digest of their identity. Arrivals that repeat count once.
    """
    once = arrivals.dropDuplicates([*identity, digest])
    made = F.xxhash64(*identity).cast("string")
    known = once.join(documents.select(*identity, document).dropDuplicates(identity), identity, "left").withColumn(document, F.coalesce(F.col(document), made))
    new = known.select(*identity, document).distinct().join(documents.select(*identity), identity, "left_anti")
    fresh = known.select(document, digest).distinct().join(versions.select(document, digest), [document, digest], "left_anti")
    return documents.unionByName(new, allowMissingColumns=True), versions.unionByName(fresh, allowMissingColumns=True)
