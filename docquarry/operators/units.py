"""Quantities recorded in different units, brought to common units.

A stated unit (of the unit column, or of the text the value came from) is parsed into a
factor and dimensions. Values without a stated unit get the unit that fits best to
physical identities with other recorded values: the unit combination with the least log
residual, flagged where it isn't the only one that fits.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.cluster import stored
from docquarry.functions.edit import nearest_name, plain_words

#: Prefixes and units by dimension (mass g, amount mol, volume L, time h, area m2).
_PREFIX = {"": 1.0, "p": 1e-12, "n": 1e-9, "u": 1e-6, "μ": 1e-6, "mc": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "k": 1e3}
_SCALED = {"g": ("mass", 1.0), "mol": ("amount", 1.0), "mole": ("amount", 1.0), "moles": ("amount", 1.0), "l": ("volume", 1.0), "liter": ("volume", 1.0), "litre": ("volume", 1.0)}
_TIMES = {"s": 1 / 3600, "sec": 1 / 3600, "secs": 1 / 3600, "second": 1 / 3600, "seconds": 1 / 3600, "min": 1 / 60, "mins": 1 / 60, "minute": 1 / 60, "minutes": 1 / 60, "h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "d": 24.0, "day": 24.0, "days": 24.0}
_DIMENSIONS = ("mass", "amount", "volume", "time", "area")
#: Entries of a unit column that state nothing.
NO_UNIT = {"", "-", "--", "see text", "n/a", "na", "none", "unknown", "?", "."}

_TOKEN = re.compile(r"([a-zA-Zμ]+)\s*(?:\^?\s*([-−+]?\d+))?")
_POWER = re.compile(r"^[x×*]?\s*10\s*\^?\s*([-−+]?\d+)\s*[x×*·]?\s*")
_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?")

Parsed = tuple[float, tuple[int, ...]]


def _symbol(token: str) -> tuple[float, dict[str, int]] | None:
    if re.fullmatch(r"(p|n|u|μ|mc|m)?M", token):
        return _PREFIX[token[:-1]], {"amount": 1, "volume": -1}
    low = token.lower()
    if low in _TIMES:
        return _TIMES[low], {"time": 1}
    for symbol, (dimension, size) in _SCALED.items():
        if low.endswith(symbol) and low[: len(low) - len(symbol)] in _PREFIX:
            return _PREFIX[low[: len(low) - len(symbol)]] * size, {dimension: 1}
    if re.fullmatch(r"(p|n|u|μ)m", low):
        return _PREFIX[low[:-1]], {"amount": 1, "volume": -1}
    return None


@lru_cache(maxsize=100_000)
def parse_unit(text: str, per_day_is_rate: bool = True) -> Parsed | None:
    """Factor and dimensions of a unit in g, mol, L, h and m2, or none if it isn't understood.

    ``per_day_is_rate`` false: times in a dose ("mg/kg/day") say how it was given, not what.
    """
    plain = unicodedata.normalize("NFKC", text).replace("µ", "μ").strip().strip("[](){} ").strip()
    factor = 1.0
    if m := _POWER.match(plain):
        factor, plain = 10.0 ** int(m[1].replace("−", "-")), plain[m.end() :]
    if not plain:
        return None
    powers = dict.fromkeys(_DIMENSIONS, 0)
    at, sign = 0, 1
    while at < len(plain):
        m = re.compile(r"\s*([/*·.×⋅∙]|per\b)?\s*").match(plain, at)
        at, sign = m.end(), -1 if m[1] in ("/", "per") else 1
        m = _TOKEN.match(plain, at)
        if not m:
            return None
        at, power = m.end(), sign * int((m[2] or "1").replace("−", "-"))
        if m[1] == "m" and abs(power) == 2:
            powers["area"] += power // 2
            continue
        known = _symbol(m[1])
        if known is None:
            return None
        size, dims = known
        if "time" in dims and not per_day_is_rate:
            continue
        factor *= size**power
        for dimension, n in dims.items():
            powers[dimension] += n * power
    return factor, tuple(powers[d] for d in _DIMENSIONS)


def conversion(unit: str, common: str, dose: bool = False) -> tuple[float, str] | None:
    """Factor from ``unit`` to ``common`` and what else it needs: nothing, ``mol_weight`` (times) or ``km`` (divided by)."""
    a, b = parse_unit(unit, not dose), parse_unit(common, not dose)
    if a is None or b is None:
        return None
    if a[1] == b[1]:
        return a[0] / b[0], ""
    diff = tuple(x - y for x, y in zip(a[1], b[1], strict=True))
    if diff == (-1, 1, 0, 0, 0):
        return a[0] / b[0], "mol_weight"
    if dose and diff == (1, 0, 0, 0, -1):  # mg/m2 = mg/kg x km
        return a[0] / 1e-3, "km"
    return None


def unit_in_text(text: str, value: float, common: str, dose: bool = False) -> str | None:
    """The unit that ``text`` states for ``value``: after that number, or as "(units: ...)"."""
    if (m := re.search(r"\(\s*units?\s*[:=]\s*([^)]*)\)", text)) and conversion(m[1], common, dose):
        return m[1].strip()
    for m in _NUMBER.finditer(text):
        try:
            number = float(m[0].replace(",", ""))
        except ValueError:
            continue
        if not math.isclose(number, value, rel_tol=1e-6):
            continue
        words = re.split(r"\s+", re.split(r"[,;]\s|\(|\)", text[m.end() :].strip())[0].strip())
        for n in range(min(4, len(words)), 0, -1):
            if conversion(" ".join(words[:n]).rstrip(".,;"), common, dose):
                return " ".join(words[:n]).rstrip(".,;")
    return None


@lru_cache(maxsize=200_000)
def _unit_of(parameter: str, common: str, value: float | None, unit: str | None, note: str | None, fallback: str | None) -> tuple[str | None, float | None, str | None, str]:
    """Unit, factor, what else it needs, and status of one value."""
    dose, found, status = parameter == "dose", None, "unknown"
    if unit is not None and unit.strip().lower() not in NO_UNIT and conversion(unit, common, dose):
        found, status = unit.strip(), "stated"
    elif note and value is not None and math.isfinite(value) and (u := unit_in_text(note, value, common, dose)):
        found, status = u, "text"
    elif fallback and conversion(fallback, common, dose):
        found, status = fallback, "column"
    return found, *(conversion(found, common, dose) if found else (None, None)), status


def _stated(rows: DataFrame, common: dict[str, str], numbers: tuple[tuple[str, str], ...] = (("value", "fallback"),)) -> DataFrame:
    """``rows``: parameter, unit, note and other columns, which are kept -> the stated unit of each value, in one pass.

    ``numbers``: pairs of a value's column and that of its fallback (the unit of the
    column's name). Adds for each value ``<value>_unit``, ``_factor``, ``_needs`` and
    ``_status``: ``stated`` (unit column), ``text`` (note), ``column`` (fallback),
    ``unknown``; null values keep a stated unit and have no other.
    """
    kinds = (("unit", T.StringType(), pa.string()), ("factor", T.DoubleType(), pa.float64()), ("needs", T.StringType(), pa.string()), ("status", T.StringType(), pa.string()))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"{value}_{name}", kind) for value, _ in numbers for name, kind, _ in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            parameter, unit, note = (batch.column(c).to_pylist() for c in ("parameter", "unit", "note"))
            for value, fallback in numbers:
                own = zip(parameter, batch.column(value).to_pylist(), unit, note, batch.column(fallback).to_pylist(), strict=True)
                # without a note the number doesn't matter, so few distinct cases are looked at
                found = [_unit_of(p, common[p], v if n else None, u, n, f) if p in common else (None, None, None, "unknown") for p, v, u, n, f in own]
                columns += [pa.array([x[k] for x in found], kind) for k, (_, _, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def study_facts(studies: DataFrame, terms: DataFrame) -> DataFrame:
    """study_id, mol_weight, km (of the species entry, null where it denotes none), once per study."""
    names: dict[str, float] = {}
    rows = terms.where("field = 'species' and km is not null").select("term", "alt_names", "km").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many species")
    for r in rows:
        for name in [r["term"], *(r["alt_names"] or [])]:
            names.setdefault("".join(plain_words(name)), float(r["km"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float | None] = {}
        for batch in batches:
            for v in set(batch.column(1).to_pylist()) - {None} - known.keys():
                near = nearest_name(v, names)
                known[v] = names[near] if near else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.get(v) for v in batch.column(1).to_pylist()], pa.float64()), batch.column(2)], names=["study_id", "km", "mol_weight"])

    weight = F.get_json_object("extra_attributes", "$.mol_weight_g_mol").try_cast("double")
    rows = studies.select("study_id", F.col("species").cast("string"), F.when(weight > 0, weight).alias("mol_weight")).where("study_id is not null").dropDuplicates(["study_id"])
    return rows.mapInArrow(run, "study_id string, km double, mol_weight double")


def _common(ref_unit: DataFrame) -> dict[str, str]:
    """Parameters and common units; a reference table (at most 100,000 entries are accepted)."""
    rows = ref_unit.where("parameter is not null and common_unit is not null").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many parameters")
    return {r["parameter"]: r["common_unit"] for r in rows}


def _in_common(value: str) -> Column:
    """The value in the common unit: null where unit, molecular weight or km is missing, and for values that aren't finite."""
    v, factor, needs = F.col(value), F.col(f"{value}_factor"), F.col(f"{value}_needs")
    out = F.when(needs == "", v * factor).when(needs == "mol_weight", v * factor * F.col("mol_weight")).when(needs == "km", v * factor / F.col("km"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), out)


def exposure_values(metrics: DataFrame, studies: DataFrame, terms: DataFrame, ref_unit: DataFrame) -> DataFrame:
    """Every metric once per id: id, study_id, dose_group_id, parameter, timepoint, value, unit, unit_status, common_unit, common_value.

    Parameters without a common unit are ``unknown``. Molar units need the study's molecular weight.
    """
    common = _common(ref_unit)
    once = metrics.select("id", "study_id", "dose_group_id", "parameter", "timepoint", F.col("value").cast("double").alias("value"), "unit", F.get_json_object("extra_attributes", "$.source_text").alias("note"), F.lit(None).cast("string").alias("fallback")).where("id is not null").dropDuplicates(["id"])
    stated = _stated(once, common).join(study_facts(studies, terms), "study_id", "left")
    units = F.create_map(*[F.lit(x) for kv in common.items() for x in kv]) if common else F.create_map(F.lit(""), F.lit(""))
    return stated.select("id", "study_id", "dose_group_id", "parameter", "timepoint", "value", F.col("value_unit").alias("unit"), F.col("value_status").alias("unit_status"), units[F.col("parameter")].alias("common_unit"), _in_common("value").alias("common_value"))


def dose_values(groups: DataFrame, studies: DataFrame, terms: DataFrame, ref_unit: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Every dose group once per id: id, study_id, group_no, sex, value, unit, unit_status, common_value, identity.

    The dose is that of dose_mg_per_kg, else of dose_mg_per_m2. A column is in the unit that
    dose_text or the name tells for its number, else in that of its name. Where both are
    given, all combinations of units of the columns (those told are fixed) are held against
    mg/m2 = mg/kg x km: of those within ``tolerance`` that with fewest units other than the
    named ones counts, and ``identity`` is ``holds``, or ``other_unit`` if one is another;
    if as few would give the dose another value, unit_status is ``ambiguous``. ``broken``:
    none fits, and units are as told or named; null where it can't be checked.
    """
    common = _common(ref_unit).get("dose", "mg/kg")
    text = F.coalesce(F.nullif(F.trim(F.get_json_object("extra_attributes", "$.dose_text")), F.lit("")), F.nullif(F.regexp_extract("name", r"\(([^()]*)\)[^()]*$", 1), F.lit("")))
    none = F.lit(None).cast("string")
    once = groups.select("id", "study_id", "group_no", "sex", F.lit("dose").alias("parameter"), none.alias("unit"), text.alias("note"), F.col("dose_mg_per_kg").cast("double").alias("kg"), F.col("dose_mg_per_m2").cast("double").alias("m2"), F.lit("mg/kg").alias("kg_name"), F.lit("mg/m2").alias("m2_name")).where("id is not null").dropDuplicates(["id"])
    # each column with what the text tells, and with its own name's unit
    told = _stated(once, {"dose": common}, (("kg", "kg_name"), ("m2", "m2_name"))).join(study_facts(studies, terms), "study_id", "left")
    def options(c: str) -> Column:
        read = F.struct(F.lit(0).alias("changed"), _in_common(c).alias("v"), F.col(f"{c}_unit").alias("unit"), F.col(f"{c}_status").alias("status"))
        other = [(f"{prefix}/{c}", conversion(f"{prefix}/{c}", common, True)) for prefix in ("g", "ug", "ng")]
        scaled = [F.struct(F.lit(1).alias("changed"), (F.col(c) * F.lit(k[0]) / (F.col("km") if k[1] == "km" else F.lit(1.0))).alias("v"), F.lit(u).alias("unit"), F.lit("column").alias("status")) for u, k in other if k]
        return F.when(F.col(f"{c}_status") == "column", F.array(read, *scaled)).otherwise(F.array(read))

    apart = lambda a, b: F.abs(F.log(a["v"]) - F.log(b["v"]))
    checked = F.col("kg").isNotNull() & F.col("m2").isNotNull() & (_in_common("kg") > 0) & (_in_common("m2") > 0)
    both = F.flatten(F.transform(options("kg"), lambda a: F.transform(options("m2"), lambda b: F.struct((a["changed"] + b["changed"]).alias("changed"), F.bround(apart(a, b), 9).alias("r"), a.alias("kg"), b.alias("m2")))))
    tried = told.withColumn("fits", F.when(checked, F.array_sort(F.filter(both, lambda x: x["r"] <= tolerance))))
    best = F.get("fits", F.lit(0))
    doubt = F.exists("fits", lambda x: (x["changed"] == best["changed"]) & (F.abs(F.log(x["kg"]["v"]) - F.log(best["kg"]["v"])) > tolerance))
    plain = lambda c: F.struct(_in_common(c).alias("v"), F.col(f"{c}_unit").alias("unit"), F.col(f"{c}_status").alias("status"))
    solved = F.struct(best["kg"]["v"].alias("v"), best["kg"]["unit"].alias("unit"), best["kg"]["status"].alias("status"))
    chosen = F.when(best.isNotNull(), solved).when(F.col("kg").isNotNull(), plain("kg")).otherwise(plain("m2"))
    identity = F.when(checked, F.when(best.isNull(), "broken").when(best["changed"] == 0, "holds").otherwise("other_unit"))
    return tried.select("id", "study_id", "group_no", "sex", F.coalesce("kg", "m2").alias("value"), chosen["unit"].alias("unit"), F.when(F.coalesce(doubt, F.lit(False)), "ambiguous").otherwise(chosen["status"]).alias("unit_status"), chosen["v"].alias("common_value"), identity.alias("identity"))


#: Units that are tried for values without one, by the common unit of their parameter.
MENU = {"ng/mL": ["ng/mL", "pg/mL", "ug/mL", "mg/mL", "ng/dL"], "ng*h/mL": ["ng*h/mL", "pg*h/mL", "ug*h/mL", "ng*min/mL", "ug*min/mL", "ng*day/mL"], "h": ["h", "min", "s", "day"], "mL/min/kg": ["mL/min/kg", "L/h/kg", "mL/h/kg", "L/day/kg"], "L/kg": ["L/kg", "mL/kg", "dL/kg"]}
#: mg/kg over ng*h/mL in mL/min/kg; and times in hours with volumes in L: what the identities add in logarithms.
_PER_HOUR, _HALF = math.log(1e6 / 60), math.log(math.log(2) * 1000 / 60)
_RELATED = ["CL", "AUCinf", "Vss", "t_half"]


def _menu(ref_unit: DataFrame) -> list[tuple[str, str, float]]:
    """Parameter, unit and factor of all units tried."""
    return [(p, u, conversion(u, c)[0]) for p, c in _common(ref_unit).items() for u in MENU.get(c, [c]) if conversion(u, c)]


def solved_units(values: DataFrame, ref_unit: DataFrame, doses: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Units of values that state none, by combination: id, unit, residual, n_fitting, unit_status, common_value.

    ``values`` as of :func:`exposure_values`, ``doses`` as of :func:`dose_values` (``id`` the
    dose group). In each study and dose group the values of a parameter without a unit share
    one; every combination of units of all such parameters (at most some hundreds) is held
    against the identities CL = dose / AUCinf and t_half = ln 2 x Vss / CL together with the
    parameters that are known. The combination with the least sum of squared log residuals
    counts if each identity is met within ``tolerance``: ``inferred``, or ``ambiguous`` if
    more than one is. Groups that no identity closes are not in the result.
    """
    group = ["study_id", "dose_group_id"]
    open_ = values.where(F.col("parameter").isin(_RELATED) & (F.col("unit_status") == "unknown") & (F.col("value") > 0)).dropna(subset=group)
    # known values meet only where something is open
    levels = values.where(F.col("parameter").isin(_RELATED) & (F.col("common_value") > 0)).join(open_.select(*group).distinct(), group, "left_semi")
    known = levels.groupBy(*group).pivot("parameter", _RELATED).agg(F.avg(F.log("common_value")))
    wanting = open_.groupBy(*group).pivot("parameter", _RELATED).agg(F.avg(F.log("value")))
    named = lambda df, mark: df.select(*group, *[F.col(p).alias(f"{mark}_{p}") for p in _RELATED])
    both = named(wanting, "open").join(named(known, "known"), group, "left").join(doses.where("common_value > 0").select(F.col("id").alias("dose_group_id"), F.log("common_value").alias("dose")), "dose_group_id", "left")
    has = {p: F.coalesce(f"open_{p}", f"known_{p}").isNotNull() for p in _RELATED}
    first = has["CL"] & has["AUCinf"] & F.col("dose").isNotNull()
    second = has["CL"] & has["Vss"] & has["t_half"]
    closed = {"CL": first | second, "AUCinf": first, "Vss": second, "t_half": second}
    tried = both.where(first & F.coalesce("open_CL", "open_AUCinf").isNotNull() | second & F.coalesce("open_CL", "open_Vss", "open_t_half").isNotNull())
    single = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("unit"), x.alias("x")))
    for p in _RELATED:
        units = [F.struct(F.lit(u).alias("unit"), (F.col(f"open_{p}") + math.log(f)).alias("x")) for q, u, f in _menu(ref_unit) if q == p]
        options = F.when(closed[p] & F.col(f"open_{p}").isNotNull(), F.array(*units)).otherwise(single(F.col(f"known_{p}"))) if units else single(F.col(f"known_{p}"))
        tried = tried.withColumn(p, F.explode(options))
    a = F.when(first, F.col("CL.x") + F.col("AUCinf.x") - F.col("dose") - _PER_HOUR)
    b = F.when(second, F.col("t_half.x") + F.col("CL.x") - F.col("Vss.x") - _HALF)
    fits = tried.withColumn("residual", F.sqrt(F.coalesce(a * a, F.lit(0.0)) + F.coalesce(b * b, F.lit(0.0)))).where((F.coalesce(F.abs(a), F.lit(0.0)) <= tolerance) & (F.coalesce(F.abs(b), F.lit(0.0)) <= tolerance))
    units = F.struct(*[F.col(f"{p}.unit").alias(p) for p in _RELATED])
    best = fits.groupBy(*group).agg(F.count("*").cast("int").alias("n_fitting"), F.min(F.struct(F.col("residual").alias("r"), units.alias("u"))).alias("best"))
    chosen = F.coalesce(*[F.when(F.col("parameter") == p, F.col(f"best.u.{p}")) for p in _RELATED])
    rows = open_.join(best, group).select("id", "parameter", "value", chosen.alias("unit"), F.col("best.r").alias("residual"), "n_fitting").where("unit is not null")
    factor = F.coalesce(*[F.when((F.col("parameter") == p) & (F.col("unit") == u), F.lit(f)) for p, u, f in _menu(ref_unit)], F.lit(None).cast("double"))
    return rows.select("id", "unit", "residual", "n_fitting", F.when(F.col("n_fitting") == 1, "inferred").otherwise("ambiguous").alias("unit_status"), (F.col("value") * factor).alias("common_value"))


def inferred_units(values: DataFrame, ref_unit: DataFrame, doses: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """Units for the values that state none: id, unit, residual, n_fitting, unit_status, common_value.

    ``values`` as of :func:`exposure_values`. Where the same quantity (study, dose group,
    parameter and timepoint) is recorded again with a unit, the unit with the least log
    residual to it is chosen if it is within ``tolerance``; else that of the group's
    combination (:func:`solved_units`, with ``doses``). ``inferred``, or ``ambiguous`` if
    several fit. Values that no identity reaches are not in the result.
    """
    key = ["study_id", "dose_group_id", "parameter", "timepoint"]
    open_ = values.where("unit_status = 'unknown' and value > 0")
    same = values.where("common_value > 0").groupBy(*key).agg(F.avg(F.log("common_value")).alias("expected"))
    candidates = values.sparkSession.createDataFrame(_menu(ref_unit), "parameter string, candidate string, factor double")
    # the menu has some units for each parameter
    tried = open_.join(same, key).join(F.broadcast(candidates), "parameter").withColumn("residual", F.abs(F.log(F.col("value") * F.col("factor")) - F.col("expected")))
    best = tried.where(F.col("residual") <= tolerance).groupBy("id").agg(F.count("*").cast("int").alias("n_fitting"), F.min(F.struct("residual", "candidate", (F.col("value") * F.col("factor")).alias("v"))).alias("b"))
    again = best.select("id", F.col("b.candidate").alias("unit"), F.col("b.residual").alias("residual"), "n_fitting", F.when(F.col("n_fitting") == 1, "inferred").otherwise("ambiguous").alias("unit_status"), F.col("b.v").alias("common_value"))
    return again if doses is None else again.unionByName(solved_units(values, ref_unit, doses, tolerance).join(again.select("id"), "id", "left_anti"))


#: Width of the bands of log values; a little more than the tolerance, so that equals lie in the same or the next band.
_BAND = 0.011


def equal_pairs(values: DataFrame, key: list[str], tolerance: float = 0.01) -> DataFrame:
    """id_a < id_b with equal ``key`` (no nulls) whose common_value differ by at most ``tolerance`` of the smaller.

    A band join on the logarithm: rows meet only those of their band and the next, so
    different values of a large key are not compared with each other.
    """
    band = F.when(F.col("common_value") == 0, F.lit(-(2**40))).otherwise(F.floor(F.log(F.abs("common_value")) / (_BAND * tolerance / 0.01)))
    rows = stored(values.where("common_value is not null").dropna(subset=key).select("id", *key, F.col("common_value").alias("v"), F.signum("common_value").alias("side"), band.alias("band")), "bands")
    small = rows.select(F.col("id").alias("i"), F.abs("v").alias("a"), *key, "side", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    large = rows.select(F.col("id").alias("j"), F.abs("v").alias("b"), *key, "side", "band")
    met = small.join(large, [*key, "side", "band"]).where(((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("i") < F.col("j")))) & (F.col("b") - F.col("a") <= tolerance * F.col("a") * (1 + 1e-9)))
    return met.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).where("id_a <> id_b")


def same_quantity(metrics: DataFrame, groups: DataFrame, studies: DataFrame, terms: DataFrame, ref_unit: DataFrame) -> DataFrame:
    """table_name, id_a, id_b: records that state the same quantity within 1 %.

    Units come from what is stated and, where nothing is, from the combination that the
    identities of the group single out (:func:`solved_units`); doses from that of their two
    columns. Values whose unit stays unknown or ambiguous are in no pair. That the quantity
    is recorded again proves no unit here, as it would prove the pair by assuming it.
    """
    exposure = stored(exposure_values(metrics, studies, terms, ref_unit), "exposures")
    dose = stored(dose_values(groups, studies, terms, ref_unit), "doses")
    solved = solved_units(exposure, ref_unit, dose).where("unit_status = 'inferred'").select("id", F.col("common_value").alias("solved"))
    key = ["study_id", "dose_group_id", "parameter", "timepoint"]
    known = exposure.where("unit_status <> 'unknown'").select("id", *key, "common_value")
    found = exposure.where("unit_status = 'unknown'").join(solved, "id").select("id", *key, F.col("solved").alias("common_value"))
    a = equal_pairs(known.unionByName(found), key).select(F.lit("ncd_exposure_metric").alias("table_name"), "id_a", "id_b")
    b = equal_pairs(dose.where("unit_status not in ('unknown', 'ambiguous')"), ["study_id", "group_no", "sex"]).select(F.lit("ncd_dose_group").alias("table_name"), "id_a", "id_b")
    return a.unionByName(b)
