from datetime import date

from pyspark.sql import functions as F

from docquarry.functions import fuzzy as Z
from docquarry.functions import text as X
from docquarry.functions import values as V
from docquarry.operators import chunking as K
from docquarry.operators import sections as S
from docquarry.sources import readers as D
from docquarry.streaming.jobs import limit_log


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


def test_study_ids(spark):
    f = lambda v: one(spark, X.study_ids("v"), v=v)
    assert f("see QX77-TOX-204-B.pdf and study-AB12-345.extracted.md") == ["QX77-TOX-204-B", "AB12-345"]
    assert f("input.p1.t2 and A-1") == [] and f(None) == [] and f("") == []
    c = lambda v: one(spark, X.canonical_study_number("v"), v=v)
    assert c("600210") == "600210" and c("1006-2525") == "1006-2525" and c("wkp00013 page 2") == "WKP00013 PAGE 2" and c("n/a") == "" and c(None) == ""
    assert one(spark, X.preferred_study_number("a", "b"), a="DOC-123-ABCDEF01", b="XY99-0001") == "XY99-0001"


def test_sections(spark):
    m = lambda s, f: one(spark, X.section_matches("s", "f"), s=s, f=f)
    assert m("4.2.1", "4.2") and m("4.2", "4.2") and m("3|4.2.1", "4.2") and not m("4.20", "4.2") and not m("", "4.2") and not m(None, "4.2")
    p = lambda k, s: one(spark, X.path_mentions_section("k", "s"), k=k, s=s)
    assert p("m4/4.2.1.1/a.pdf", "4.2.1.1") and p("m4/4211-x/a.pdf", "4.2.1.1") and not p("m4/4.2.2.1/a.pdf", "4.2.1.1")
    assert one(spark, X.section_ancestors(F.col("s")), s="4.2.1") == ["4.2.1", "4.2", "4"]
    assert one(spark, X.section_label("s"), s="Section 4.2.3.2.") == "4.2.3.2" and one(spark, X.section_label("s"), s="4211") == "4.2.1.1" and one(spark, X.section_label("s"), s=" ") is None
    assert one(spark, X.section_title("t", F.lit("4.2")), t="x\n4.2 Tox studies\nmore") == "Tox studies"


def test_modules_and_labels(spark):
    f = lambda v: one(spark, X.module_number("v"), v=v)
    assert [f(x) for x in ("Module 1. Intro", "module4_tox", "5", "m3", "no-module", None, "45")] == [1, 4, 5, None, None, None, None]
    assert [f(x) for x in ("CTD Module 4", "4 weeks", "2.6.3", "submodule 2", "module 45")] == [4, None, None, None, None]
    assert one(spark, X.module_number(X.short_module("v")), v="m3") == 3 and one(spark, X.short_module("v"), v="m3 data") == "m3 data"
    assert one(spark, X.glp("v"), v="not GLP") == "Non-GLP" and one(spark, X.glp("v"), v="yes") == "GLP" and one(spark, X.glp("v"), v=None) == ""
    assert one(spark, X.merge_segments("a", "b"), a="x; Y", b="y;z") == "x; Y; z"
    assert one(spark, X.study_type("v"), v="28-day repeated-dose study") == "repeat_dose_tox" and one(spark, X.study_type("v"), v="none") is None
    assert one(spark, X.organ_systems("v"), v="ECG and respiratory rate") == "Cardiovascular; Respiratory"
    assert one(spark, X.label_values("v", ["Sponsor", "Species"]), v="Species: rat\nSponsor - ACME Ltd") == ["ACME Ltd", "rat"]
    assert one(spark, X.dose_summary("v"), v="doses of 10, 30.0 and 100 mg/kg, later 30 mg/kg") == "10 mg/kg, 30 mg/kg, 100 mg/kg"
    assert one(spark, X.clip_at_word("v", 9), v="alpha beta gamma") == "alpha"
    assert one(spark, X.excerpt_offset("v", F.lit("BETA")), v="alpha beta") == 6 and one(spark, X.excerpt_offset("v", F.lit("q")), v="alpha") is None
    assert one(spark, X.text_slice("v", F.lit(-3), F.lit(99)), v="abc") == "abc"


def test_natural_order(spark):
    df = spark.createDataFrame([("A10",), ("A2",), ("a2-1",), (None,), ("",)], "v string")
    assert [r["v"] for r in df.orderBy(X.natural_key("v"), "v").collect()] == [None, "", "A2", "a2-1", "A10"]


def test_values(spark):
    d = lambda v: one(spark, V.parse_date("v"), v=v)
    assert d("3-2024") == date(2024, 3, 1) and d("03/31/2024") == date(2024, 3, 31) and d("2024-1-31") == date(2024, 1, 31) and d("2024") == date(2024, 1, 1) and d("") is None and d("x") is None
    n = lambda v: one(spark, V.duration_days("v"), v=v)
    assert n("4 weeks") == 28 and n("28 days") == 28 and n("2 years") == 730 and n("long") is None
    c = lambda v: one(spark, X.compact_number("v"), v=v)
    assert [c(x) for x in ("10.0", "100", "0.05", "0", "abc")] == ["10", "100", "0.05", "0", "abc"]
    assert spark.range(1).select(V.vector_literal(F.array(F.lit(1.0), F.lit(2.5))).alias("v")).first()["v"] == "[1.00000000,2.50000000]"
    assert one(spark, V.json_merge("a", "b"), a='{"x": 1, "y": 2}', b='{"y": 3}') == {"x": "1", "y": "3"} and one(spark, V.json_merge("a", "b"), a="bad", b=None) == {}
    m = spark.createDataFrame([(0.8, None, 0.5)], "a double, b double, c double").select(V.weighted_mean([("a", 0.5), ("b", 0.2), ("c", 0.3)]).alias("m")).first()["m"]
    assert abs(m - (0.4 + 0.15) / 0.8) < 1e-12


def test_fuzzy():
    assert Z.partial_ratio("abc", "xxabcxx") == 100 and Z.partial_ratio("", "") == 100 and Z.partial_ratio("", "a") == 0
    assert Z.token_set_ratio("fuzzy was a bear", "bear fuzzy was a") == 100 and Z.token_set_ratio("", "a") == 0
    assert Z.common_subsequence("kitten", "sitting") == 4
    assert 60 < Z.partial_ratio("heart rate", "hart rates were higher") < 100


def test_section_spans(spark):
    text = "# Doc\n\n## Page 1 <ref1>\n\nTable of Contents\n1.2 Overview .......... 3\n1.2 Overview\nSome text.\n\n2.1.4 Methods\nMore text.\n\n## Page 2 <ref2>\n\n3.1.2.4 Results\nMore.\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = S.section_spans(df, "id", "text").orderBy("char_start").collect()
    assert [(r["section_number"], r["page_start"], r["page_end"]) for r in got] == [("1.2", 1, 1), ("2.1.4", 1, 2), ("3.1.2.4", 2, 2)]
    assert all(text[r["char_start"] :].startswith(r["section_number"]) for r in got) and got[-1]["char_end"] == len(text)


def test_packing_and_windows(spark):
    assert list(K.pack([(1, "a" * 6 + "\n\n" + "b" * 6), (2, None), (3, "c")], 12)) == [(1, 1, "a" * 6 + "\n\n"), (1, 3, "b" * 6 + "\n\nc\n\n")]
    assert [x[2] for x in K.pack([(1, "x" * 50)], 10, True)] == ["", "x" * 50 + "\n\n"] and list(K.pack([], 10)) == []
    assert all(len(w) <= 6000 for w in K.windows("a" * 13050)) and len(K.windows("a" * 13050)) >= 3 and K.windows("a" * 2500) == ["a" * 2500] and K.windows(None) == []
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), (None, 1, "x"), ("e", 1, None)], "source_document_id string, page_number int, text string")
    assert [(r["source_document_id"], r["page_from"], r["page_to"], r["raw_text"]) for r in K.pack_pages(pages).collect()] == [("d", 1, 2, "one\n\ntwo\n\n")]


def test_limit_and_pages(spark):
    assert limit_log([100.0, 120.0, 130.0, 161.0], 2, 60) == [None, None, 30, None]
    df = spark.createDataFrame([([1, 3, 2, 0], None), ([1, 5], 3), (None, 2), (None, None)], "p array<int>, m int")
    assert [r["x"] for r in df.select(D.page_selection(F.col("p"), F.col("m")).alias("x")).collect()] == [[1, 2, 3], [1], [1, 2], None]
    fields = D.required_fields({"required_content": ["Study ID", "AUC", "auc"], "validation_rules": {"hERG_required": True, "n": 3}, "extraction_focus": {"x": ["single dose"]}})
    assert fields == ["Study ID", "AUC", "hERG required", "n", "x", "single dose"]


def brute_study_ids(text):
    """The rules of the identifiers, with Python's own regular expressions."""
    import re

    form = re.compile(r"\b(?=[A-Z0-9./-]*[A-Z])(?=[A-Z0-9./-]*\d)[A-Z0-9]{2,}(?:[-./][A-Z0-9]+)+\b", re.I | re.A)
    endings, found = {"pdf", "xml", "docx", "txt", "csv", "json", "md"}, []
    for x in form.findall(text or ""):
        x = re.sub(r"\.(?:" + "|".join(endings) + ")$", "", x, flags=re.I)
        x = re.sub(r"^(?:stf-|study-)", "", x, flags=re.I).strip("._-")
        while "." in x and x.split(".")[-1].lower() in endings | {"extracted", "quality", "meta", "images", "tables"}:
            x = x.rpartition(".")[0].strip("._-")
        if form.fullmatch(x) and len(x) >= 6 and sum(c.isdigit() for c in x) >= 2 and not re.match(r"(?i)^(?:input\.(?:p\d+)?\.t\d+|p\d+\.t\d+)$", x):
            found.append(x.upper())
    return list(dict.fromkeys(found))


def test_study_ids_of_all_names(spark, tmp_path):
    from docquarry.plans.reference import QUERIES

    names = ["AB12-0000001_Draft_Report_v1.pdf", "ab12-0000001 final report.PDF", "AB12-0000001-final-report-v2.pdf", "C:\\transfer\\AB12-0000001%20Report%20v1.0 .pdf", "uploads/inbox/gv19-0002216 Report.pdf", "1690518752_Draft Report aq12 0000005 rev 1 - Copy.docx", "stf-AB12-0000009.xml.meta", "AB12-0000002 and AB12-0000003.pdf", "Rpt-JX18_0002358-v1.0.pdf", "scan.pdf", "input.p1.t2", "", None]
    spark.createDataFrame([(str(i), n) for i, n in enumerate([*names, names[0]])], "id string, file_name string").write.parquet(f"{tmp_path}/ncd_source_document.parquet")
    got = {r["id"]: r["ids"] for r in QUERIES["study_ids_of_all_names"](spark, str(tmp_path)).collect()}
    assert got == {str(i): brute_study_ids((n or "").replace("_", " ")) for i, n in enumerate([*names, names[0]])}
    assert got["1"] == got["0"] == ["AB12-0000001"] and got["7"] == ["AB12-0000002", "AB12-0000003"] and got["12"] == []
