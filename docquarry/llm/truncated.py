"""Texts cut off by field limits or in transfer.

Lengths are recomputed under other encodings, entity and JSON escaping and newline
conversion; grouped by source and encoding they expose hidden storage limits as spikes.
Then the endings are inspected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored

#: Encodings under which a field may have been measured, in the order of ``lengths``.
ENCODINGS = ("chars", "utf8", "utf16", "crlf", "crlf_utf8", "entities", "entities_quotes", "numeric_entities", "json", "json_ascii")

_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def lengths(text: str) -> list[int]:
    """Length of ``text`` under each of :data:`ENCODINGS`."""
    n, utf8 = len(text), len(text.encode("utf-8", "surrogatepass"))
    breaks = text.count("\n") - text.count("\r\n")
    wide = len(text.encode("utf-16-le", "surrogatepass")) // 2
    amp, angle, quote, single = text.count("&"), text.count("<") + text.count(">"), text.count('"'), text.count("'")
    entities = n + 4 * amp + 3 * angle
    other = _NON_ASCII.findall(text) if utf8 > n else []
    numeric = entities + sum(len(str(ord(c))) + 2 for c in other)
    control = sum(text.count(c) for c in "\n\r\t\b\f")
    escaped = n + control + quote + text.count("\\")
    return [n, utf8, wide, n + breaks, utf8 + breaks, entities, entities + 5 * quote + 5 * single, numeric, escaped, escaped + sum(11 if ord(c) > 0xFFFF else 5 for c in other)]


#: What software puts behind a cut.
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|\[\s*(?:…|\.{3}|truncated|cut|more|continued|cont\.?)\s*\]|\(\s*(?:…|\.{3}|truncated|cut|more|continued|cont\.?)\s*\)|<\s*(?:truncated|cut|more)\s*>|\.{3}\s*\(?(?:more|truncated)\)?))+\s*$", re.I)
#: A character, entity or escape of which only the first part arrived.
_RESIDUE = re.compile("(?:�|\\\\u[0-9a-fA-F]{0,3}|\\\\x[0-9a-fA-F]?|&#?[a-zA-Z0-9]{0,6}|%[0-9A-Fa-f]?|<br?|</?[a-z]{0,6})$")
_ENDED = re.compile(r"[.!?。！？][)\]\"'”’»）」』]*$|[:;]$")
#: Closing lines that stand behind a text, cut or not.
_CLOSING = re.compile(r"^(?:[—–*=~-]{1,3}\s*\S.*\S\s*[—–*=~-]{1,3}|\[\s*(?:end|fin|ende)\b.*\]|.*[✓✔]|(?:approved|signed|reviewed|released) by\b.*\d{4}|page \d+(?: of \d+)?|\d+\s*/\s*\d+)$", re.I)
_WELL_FORMED = re.compile(r"^\|.*\|$|^\d+[.)]\s.*\b\d{4}$|^\(.*\)$|^\[.*\]$|^[“\"«„].*[”\"»“]$")
_LIST = re.compile(r"^(?:[-•*·–]|\(?[a-z0-9]{1,3}[.)])\s+\S")
_ROW = re.compile(r"^\|")


def ending(text: str | None) -> str:
    """How a text ends: ``residue`` (half a character or escape), ``open`` (inside a word or sentence),
    ``unclear`` (a list item or a short line, which may be whole), ``closed``, or ``empty``."""
    body = (text or "").rstrip()
    if not body.strip():
        return "empty"
    if _RESIDUE.search(body[-12:]):
        return "residue"
    lines = [x.strip() for x in body.splitlines()]
    marked = False
    while lines:
        if not lines[-1] or (len(lines) > 1 and _CLOSING.match(lines[-1]) and not _ROW.match(lines[-1])):
            lines.pop()
            continue
        bare = _MARK.sub("", lines[-1])
        if bare == lines[-1]:
            break
        marked = True
        lines[-1] = bare.strip()
    if not lines:
        return "closed"
    last = lines[-1]
    if _RESIDUE.search(last[-12:]):
        return "residue"
    if _ENDED.search(last) or (_WELL_FORMED.match(last) and not marked) or _CLOSING.match(last):
        return "closed"
    if marked or _ROW.match(last):
        return "open"
    if _LIST.match(last):
        return "unclear"
    words = last.split()
    wide = sum(ord(c) > 0x2E80 for c in last)
    title = len(words) <= 3 or (len(words) <= 6 and all(w[:1].isupper() or len(w) <= 3 for w in words))
    if wide <= 12 and title and len(last) < 60 and last[:1].isalnum() and not last[:1].islower():
        return "unclear"
    return "open"


def inspect(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, ending and lengths of every text, in one pass without shuffle.

    Null texts have the ending ``empty`` and no lengths; a null source is a source of its own.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for value in batch.column(2):
                t = value.as_py()
                ends.append(ending(t))
                sizes.append(None if t is None else lengths(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.string()), pa.array(sizes, pa.list_(pa.int64()))], names=[key, "source", "ending", "lengths"])

    return df.select(F.col(key), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, source string, ending string, lengths array<bigint>")


def limits(inspected: DataFrame, least: int = 8, deviations: float = 6.0, around: int = 60, key: str = "doc_id") -> DataFrame:
    """source, encoding, limit, n_at, n_over, n_texts, best: lengths that far too many texts of a source share.

    A spike exceeds what the lengths within ``around`` of it (but not next to it) hold on
    average by ``least`` texts and ``deviations`` standard deviations. The same limit may
    show under several encodings: a text speaks for that under which most texts share its
    length, and a spike is ``best`` if most of its texts speak for it. So a source may have
    several limits, each under an encoding of its own.
    """
    texts = inspected.where("lengths is not null and ending <> 'empty'").select(F.col(key).alias("__key"), F.coalesce("source", F.lit(_NO_SOURCE)).alias("source"), F.posexplode("lengths").alias("e", "length"))
    sized = texts.groupBy("source", "e", "length").agg(F.count("*").alias("n"))
    w = W.partitionBy("source", "e").orderBy("length")
    near = sized.withColumn("wide", F.sum("n").over(w.rangeBetween(-around, around))).withColumn("close", F.sum("n").over(w.rangeBetween(-4, 4))).withColumn("all", F.sum("n").over(W.partitionBy("source", "e")))
    # what lies over a length is the rest of a running sum: a frame to the end would be summed anew for every row
    near = near.withColumn("over", F.col("all") - F.sum("n").over(w.rangeBetween(W.unboundedPreceding, 0)))
    usual = (F.col("wide") - F.col("close")) / (2 * around - 8)
    spikes = stored(near.where(F.col("n") >= usual + least + deviations * F.sqrt(usual)), "spikes")
    # each text at spikes speaks for one of them
    voices = texts.join(spikes.select("source", "e", "length", "n"), ["source", "e", "length"]).groupBy("source", "__key").agg(F.min(F.struct((-F.col("n")).alias("n"), "e", "length")).alias("v"))
    own = voices.groupBy("source", F.col("v.e").alias("e"), F.col("v.length").alias("length")).agg(F.count("*").alias("own"))
    names = F.array(*[F.lit(x) for x in ENCODINGS])
    joined = spikes.join(own, ["source", "e", "length"], "left")
    return joined.select(F.nullif("source", F.lit(_NO_SOURCE)).alias("source"), F.element_at(names, F.col("e") + 1).alias("encoding"), F.col("length").alias("limit"), F.col("n").alias("n_at"), F.coalesce("over", F.lit(0)).alias("n_over"), F.col("all").alias("n_texts"), (2 * F.coalesce("own", F.lit(0)) >= F.col("n")).alias("best"))


#: Stands for a null source.
_NO_SOURCE = "\0"


def truncated(inspected: DataFrame, found: DataFrame, key: str = "doc_id", slack: int = 3) -> DataFrame:
    """key, source, ending, at_limit, encoding, limit of the texts that were cut off.

    The hidden limits of the source come first: a text lies at one if its length under the
    limit's encoding is up to ``slack`` below it (a cut may drop half a character and outer
    blanks) or above it (a mark put behind), the nearest counting. There, any ending that
    isn't closed is a cut, a short line or list item too; elsewhere (limits that too few
    texts show, transfers that broke) only one within a word or sentence, with null encoding and limit.
    """
    caps = found.where("best").groupBy(F.coalesce("source", F.lit(_NO_SOURCE)).alias("__s")).agg(F.collect_set(F.struct("encoding", "limit")).alias("caps"))
    names = F.array(*[F.lit(x) for x in ENCODINGS])
    joined = inspected.withColumn("__s", F.coalesce("source", F.lit(_NO_SOURCE))).join(caps, "__s", "left")
    off = lambda c: F.abs(F.element_at(F.col("lengths"), F.array_position(names, c["encoding"]).cast("int")) - c["limit"])
    nearest = F.get(F.array_sort(F.filter(F.transform("caps", lambda c: F.struct(off(c).alias("off"), c["encoding"].alias("encoding"), c["limit"].alias("limit"))), lambda x: x["off"] <= slack)), F.lit(0))
    rows = joined.withColumn("cap", nearest).select(key, "source", "ending", F.col("cap").isNotNull().alias("at_limit"), F.col("cap.encoding").alias("encoding"), F.col("cap.limit").alias("limit"))
    return rows.where("(at_limit and ending in ('open', 'residue', 'unclear')) or (not at_limit and ending in ('open', 'residue'))")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The inspected texts (kept in the shared folder) and those cut off, once per key."""
    seen = stored(inspect(df, key, text, source), "endings")
    return seen, truncated(seen, limits(seen, key=key), key).dropDuplicates([key])


def shares(seen: DataFrame, cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """source, n_texts (not empty), n_truncated, n_at_limit, share_truncated per source."""
    every = seen.where("ending <> 'empty'").groupBy("source").agg(F.countDistinct(key).alias("n_texts"))
    bad = cut.groupBy("source").agg(F.count("*").alias("n_truncated"), F.count_if("at_limit").alias("n_at_limit"))
    joined = every.alias("e").join(bad.alias("b"), F.col("e.source").eqNullSafe(F.col("b.source")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select(F.col("e.source").alias("source"), "n_texts", n.alias("n_truncated"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), F.round(n / F.col("n_texts"), 6).alias("share_truncated"))
