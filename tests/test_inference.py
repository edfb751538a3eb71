import pytest
from pyspark.sql import functions as F

from docquarry.functions import assembly as A
from docquarry.functions import inference as I
from docquarry.functions import titles as P
from docquarry.operators import matching as M
from docquarry.operators import repair as Q
from docquarry.operators import retrieval as T
from docquarry.operators import rules as L
from docquarry.streaming import jobs as J


def one(spark, column, v=None):
    return spark.createDataFrame([(v,)], "v string").select(column.alias("o")).first()["o"]


def test_what_texts_say(spark):
    f = lambda g, v: one(spark, g("v"), v)
    assert [f(g, None) for g in (I.administration, I.species_strain, I.doses_named, I.group_size, I.endpoints, I.main_finding, I.clean_extracted, I.clean_block)] == [""] * 8
    assert f(I.administration, "given IV, then by oral gavage (in vitro first)") == "In vitro; Intravenous; Oral"
    assert f(I.species_strain, "Wistar animals") == "Rat (Wistar)" and f(I.species_strain, "CD-1 mice and beagles") == "Dog (CD-1)"
    assert f(I.doses_named, "at 1, 3.0 and 10 mg/kg; 0.50 mg / kg; 20 ug it") == "1 mg/kg, 3 mg/kg, 10 mg/kg, 0.5 mg/kg, 20 ug"
    assert f(I.group_size, "female rats, n = 4, 6 rats/group, 5 per group, 9 per group") == "Female; n=4/group, n=6/group, n=5/group"
    assert f(I.endpoints, "xenograft survival") == "Tumor growth/volume; Survival" and f(I.endpoints, "x") == I.NO_ENDPOINT
    assert f(I.main_finding, "Animals ate well. Treatment reduced growth; ok") == "Treatment reduced growth"


def test_cleaning(spark):
    f = lambda v: one(spark, I.clean_extracted("v"), v)
    assert f('{"summary": {"summary": "Fish &amp; chips  "}}') == "Fish & chips"
    assert f("{'Summary': 'quoted text', 'b': 1}") == "quoted text"
    assert f("see s3://b/k.pdf now ...[truncated], 12: done;") == "see now , done" or f("see s3://b/k.pdf now") == "see now"
    assert one(spark, I.clean_block("v"), "• a \n\n" + "-" * 30 + "\nb") == "a\nb"
    frag = F.array(F.lit("No treatment-related effect was seen. Heart rate increased."), F.lit(None).cast("string"), F.lit("no treatment-related effect was seen."))
    assert one(spark, I.findings_summary(frag)) == "No treatment-related effect was seen.; Heart rate increased."


def test_title_pages(spark):
    text = "Study Number: QX77-TOX-204\nCRO study #: C-1182; x\nTest Facility: dosing day 3\nThe study was conducted at the Ellmoor Institute; then\nnot under GLP"
    got = one(spark, P.overview(F.lit("a/4.2.1.3 x/r.pdf"), F.lit("my_report.pdf"), "v", F.lit("ab12cdef99")), text)
    assert (got["study_number"], got["cro_study_number"], got["testing_facility"], got["glp_status"], got["type_of_study"]) == ("QX77-TOX-204", "C-1182", "Ellmoor Institute", "Non-GLP", "Safety pharmacology")
    assert one(spark, P.report_number("v", F.lit("scan.pdf"), F.lit("a1b2c3d4e5"))) == "DOC-123-A1B2C3D4"
    assert one(spark, P.report_number("v", F.lit("the AB-1234.final.pdf"), F.lit(None).cast("string"))) == "AB-1234.final"
    assert one(spark, P.first_pages("v"), "## Page 1\none\n## Page 9\nnine") == "one" and one(spark, P.first_pages("v", otherwise=3), "plain") == "pla"
    assert one(spark, P.pharmacology_section("v"), "m4/4.2.1.5/4.2.1.2/x") == "4.2.1.2" and one(spark, P.pharmacology_section("v")) is None
    s = one(spark, P.section_of_key("v"), "m/4.2.1.1 Primary/4.2.3|4.2.4 'Tox'/my file.pdf")
    assert tuple(s) == ("4.2.3|4.2.4.my_file", "Tox") and tuple(one(spark, P.section_of_key("v"))) == ("document", "")


def test_assembled(spark):
    assert one(spark, A.coerced("v"), '["a", " ", "b"]') == "a, b" and one(spark, A.coerced("v"), "[]") is None and one(spark, A.coerced("v"), '{"text": "t"}') == "t" and one(spark, A.coerced("v"), " ") is None
    assert one(spark, A.cut_prompt("v", 0), "x" * 500) is None and one(spark, A.cut_prompt("v", 3), "x" * 5000) is None and len(one(spark, A.cut_prompt("v", 1), "x" * 2000)) == 1200
    assert one(spark, A.listed("v")) == [] and one(spark, A.most_specific(F.array(F.lit("4.2"), F.lit("4.2.1"), F.lit("14.2.1")))) == "14.2.1"
    df = spark.createDataFrame([(1, None, "x"), (2, "[1]", "x"), (3, '{"extraction_focus": {"a_b": ["c", 4]}}', "x")], "id int, e string, required string")
    assert {r["id"]: r["required"] for r in A.with_required_fields(df, "e").collect()} == {1: [], 2: [], 3: ["a b", "c"]}


def test_rules_hit_and_bad_ones_are_left_out(spark):
    r = spark.createDataFrame([("2.6.1", 1, 'Keywords: "Liver"; kidney\nTable cue: dose'), ("2.6.1", 2, "keyword: liver, Liver\nRegex: q\\d+d\nRegex: ([x"), ("2.7", 3, "nothing: here"), ("2.8", 4, None)], "s string, p int, t string")
    rules = L.read_rules(r, "s", "p", "t")
    assert rules == [L.Rule("2.6.1", ("Liver", "kidney", "liver"), ("dose",), ("q\\d+d",))]
    df = spark.createDataFrame([(1, "the LIVER, Q3D"), (2, "nothing"), (3, None), (4, " ")], "id int, t string")
    assert [tuple(x) for x in L.rule_hits(df, "id", F.col("t"), rules).collect()] == [(1, "2.6.1", ["Liver", "liver"], [], ["q\\d+d"])]
    assert L.rule_hits(df, "id", F.col("t"), rules, ("3",)).count() == 0 and L.kept_by_rules(df, "id", F.col("t"), []).count() == 4
    with pytest.raises(ValueError):
        L.read_rules(r, "s", "p", "t", 0)


def test_repair(spark):
    rows = spark.createDataFrame([("AB12-0000001", None, "rat", 1), ("AB12-0000001", "oral", "rat", 2), (None, "dermal", "minipig skin", 3), ("ZZ99-0000009", "x", "y", 4), ("text", "inhalation", "dog", 5)], "study string, route string, sys string, pos bigint")
    c = spark.createDataFrame([("AB12-0000001", "oral gavage", "rat"), ("AB12-0000002", "dermal", "minipig"), ("AB12-0000003", "iv", "monkey")], "study string, route string, sys string")
    got = {r["study"]: (r["route"], r["sys"]) for r in Q.merged_candidates(rows, c, "study", ["route", "sys"], "pos").collect()}
    assert got == {"AB12-0000001": ("oral gavage", "rat"), "AB12-0000002": ("dermal", "minipig skin"), "AB12-0000003": ("iv", "monkey")}
    best = Q.best_rows(spark.createDataFrame([("AB12-0000010", "x", None, 1), ("AB12-0000010", "x", "y", 2), ("AB12-0000009", "z", "none", 3), ("?", "a", "", 4), (None, None, "n/a", 5)], "study string, a string, b string, pos int"), "study", ["a", "b"], "pos")
    assert [(r["study"], r["pos"]) for r in best.orderBy("order").collect()] == [("AB12-0000009", 3), ("AB12-0000010", 2), ("?", 4)]


def test_states_and_predicates(spark):
    a, b = F.col("v"), F.lit(None).cast("string")
    assert one(spark, T.same_or_blank(a, b), "") and one(spark, T.same_or_blank(a, b)) and not one(spark, T.same_or_blank(a, b), "x")
    assert T.clean_prefix(" /a/b/ ") == "a/b/" and T.clean_prefix(None) == ""
    assert one(spark, T.in_project(F.col("v"), "a_b"), "x/A_B/y") and not one(spark, T.in_project(F.col("v"), "a_b"), "x/acb/y")
    done = lambda mode, forced=(): one(spark, T.fully_ingested(mode, {"core": F.lit("completed"), "tox": F.lit("completed")}, ["core"], [F.lit(True)], F.lit(True), F.lit(False), forced))
    assert done("auto") and not done("pk") and not done("auto", ("tox",)) and done("core", ("tox",)) and not done("core", ("core",))
    pick = lambda x, y: one(spark, M.chosen_family(*[F.struct(F.lit(n).alias("number"), F.lit(k).alias("confidence")) if n else F.lit(None).cast("struct<number:string,confidence:double>") for n, k in (x, y)]))
    assert pick(("2.4", 0.9), ("4.2", 0.1))["number"] == "4.2" and pick(("2.4", 0.1), ("2.6", 0.9))["number"] == "2.4" and pick((None, 0), ("2.6", 0.9))["number"] == "2.6" and pick(("1", 0.5), (None, 0))["number"] == "1"


def test_upserts_rewrite_only_parts_that_are_hit(spark, tmp_path):
    path = f"{tmp_path}/t"
    sink = J.upsert_batches(spark, path, ["k"], "at", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    sink(rows(*[(k, 1, "old") for k in range(20)]), 0)
    before = {p.parent.name: sorted(x.name for x in p.parent.iterdir()) for p in tmp_path.glob("t/part=*/v=0")}
    sink(rows((3, 2, "new"), (3, 0, "older"), (99, 1, "added")), 5)
    after = {p.name: sorted(x.name for x in p.iterdir()) for p in tmp_path.glob("t/part=*")}
    assert sum(after[k] != v for k, v in before.items()) <= 2
    got = {r["k"]: r["v"] for r in J.upserted(spark, path).collect()}
    sink(rows((3, 2, "new"), (3, 0, "older"), (99, 1, "added")), 5)  # delivered again
    assert got == {r["k"]: r["v"] for r in J.upserted(spark, path).collect()} and got[3] == "new" and got[99] == "added" and len(got) == 21
