from pyspark.sql import functions as F

from docquarry.operators import quality as Q
from docquarry.operators import relational as R
from docquarry.operators import sections as S
from docquarry.operators import studies as P
from docquarry.operators import vectors as N
from docquarry.sources import readers as D
from docquarry.sources import sinks as K
from docquarry.streaming import jobs as J


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rules(spark):
    now = spark.createDataFrame([("a", "x", "1", " "), ("b", "y", None, "f"), (None, "n", "2", None)], "k string, o string, s string, f string")
    new = spark.createDataFrame([("a", None, None, "new"), ("c", "z", "3", "g"), (None, "m", "4", None)], "k string, o string, s string, f string")
    got = {(r["k"], r["o"]): (r["s"], r["f"]) for r in R.upsert(now, new, ["k"], ["o"], ["s"], ["f"]).collect()}
    assert got == {("a", None): ("1", "new"), ("b", "y"): (None, "f"), ("c", "z"): ("3", "g"), (None, "n"): ("2", None), (None, "m"): ("4", None)}


def test_replace_insert_cascade(spark):
    now = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "p int, v string")
    new = spark.createDataFrame([(1, "z")], "p int, v string")
    gone = spark.createDataFrame([(3,)], "p int")
    assert rows(R.replace_children(now, new, "p", gone)) == [(1, "z"), (2, "c")]
    assert rows(R.insert_absent(now, spark.createDataFrame([(2, "q"), (9, "q")], "p int, v string"), ["p"])) == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (9, "q")]
    assert rows(R.cascade_delete(gone, "p", [(now, "p")])[0]) == [(1, "a"), (1, "b"), (2, "c")]


def test_intervals_and_order(spark):
    a = spark.createDataFrame([("x", 1, 2), ("y", 3, None), ("z", None, 1)], "id string, s int, e int")
    pages = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    assert rows(R.interval_join(a, "s", "e", pages, "n", []).select("id", "n")) == [("x", 1), ("x", 2)]
    assert rows(R.interval_join(a, "s", "e", pages, "n", [], 1).select("id", "n")) == [("x", 1), ("x", 2), ("y", 2), ("y", 4)]
    c = spark.createDataFrame([("a", 1, 2, 2), ("b", 1, None, 5), ("c", 2, 1, None)], "id string, k int, s int, e int")
    p = spark.createDataFrame([("p", 1, 3), ("q", 1, None), ("r", 1, 9), ("t", 2, 1)], "p string, k int, n int")
    assert rows(R.interval_join(c, "s", "e", p, "n", ["k"], 1, null_meets_all=True).select("id", "p")) == [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q"), ("b", "r"), ("c", "t")]
    left = spark.createDataFrame([(1, ["b", "q", "a", "b"]), (2, None), (3, [])], "k int, ids array<string>")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "id string, v int")
    got = {r["k"]: [x["v"] for x in r["out"]] for r in R.attach_in_order(left, "k", "ids", right, "id", ["v"], "out").collect()}
    assert got == {1: [20, 10, 20], 2: [], 3: []}


def test_tree_family_overlap(spark):
    t = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("loop", "loop")], "k string, p string")
    assert rows(S.tree_paths(t, "k", "p").select("k", "depth")) == [("a", 1), ("b", 2), ("r", 0)]
    left = spark.createDataFrame([("4.2.1",), ("4.20",), (None,)], "s string")
    fam = spark.createDataFrame([("4.2",), ("4",)], "f string")
    assert rows(S.family_join(left, "s", fam, "f")) == [("4.2.1", "4"), ("4.2.1", "4.2"), ("4.20", "4")]
    a = spark.createDataFrame([(1, "mild liver necrosis"), (2, None)], "id int, t string")
    b = spark.createDataFrame([(7, "liver necrosis"), (8, "liver cell hypertrophy zonal")], "tid int, u string")
    assert [tuple(r) for r in R.token_overlap(a, "id", "t", b, "tid", "u").collect()] == [(1, 7, 1.0)]


def test_profiles(spark):
    g = spark.createDataFrame([(1, "s", "vehicle", 0.0, "M", 4), (2, "s", "low", 10.0, "male", 4), (3, "s", "mid", 30.0, "M", 4), (4, "s", "high", 100.0, "M", 4), (4, "s", "high", 100.0, "M", 4)], "id long, study_id string, name string, dose_mg_per_kg double, sex string, n_animals int")
    assert rows(P.dose_summary(g)) == [("s", "10, 30, 100 (plus vehicle control)", "Male, n=4 (1 group)")]
    e = spark.createDataFrame([(1, "s", "Cmax", 1200.0, "ng/mL", None), (2, "s", "cmax", 1200.0, "NG/ML", None)], "id long, study_id string, parameter string, value double, unit string, timepoint string")
    assert P.exposure_summary(e).first()["items"] == ["Cmax 1200 ng/mL"]


def test_quality_and_gaps(spark):
    need = spark.createDataFrame([("4.2",), ("4.3",)], "sec string")
    chunks = spark.createDataFrame([("4.2.1",), (None,)], "s string")
    paths = spark.createDataFrame([("x/4311-a/b.pdf",)], "p string")
    assert rows(Q.section_gaps(need, "sec", {"chunks": (chunks, "s", False), "paths": (paths, "p", True)})) == [("4.2", 1, 0, False), ("4.3", 0, 1, False)]
    assert rows(Q.blank_cells(spark.createDataFrame([(None, "x"), ("", "x")], "a string, b string"), ["a", "b"])) == [("a", 2, 1, 0.5), ("b", 0, 1, 0.5)]


def test_nearest_and_mean(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    assert [r["row_id"] for r in N.nearest(v.where("id = 1"), "id", v, "id", "v", 2).orderBy("distance").collect()] == [2, 3]
    assert rows(N.wrong_dimension(v, "id", "v", 2)) == [(5, None)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")

    def parser(content, path):
        if content == b"broken":
            raise ValueError("broken")
        yield from enumerate(content.decode().split("|"), 1)

    got = D.paged_text(D.objects(spark, str(tmp_path / "in")), parser).orderBy("path", "page_number").collect()
    assert [(r["page_number"], r["text"], r["ok"]) for r in got] == [(1, "one", True), (2, "two", True), (None, None, False)]
    listing = spark.createDataFrame([("company/c/p/module4/x.pdf", "1", True, 1), ("company/c/p/module4/x.pdf", "2", True, 2), ("company/c/p/y.docx", "1", True, 1), ("company/c/p/module4/z.txt", "1", True, 1), ("q.pdf", "1", True, 1)], "key string, version_id string, is_latest boolean, last_modified int")
    assert [(r["key"][-5:], r["version_id"]) for r in D.latest_versions(listing, module=4).orderBy("key").collect()] == [("x.pdf", "2"), ("y.docx"[-5:], "1")]
    t = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, '[["title"], ["Study Number", "Dose"], ["S1", "5"]]'), (3, "{}"), (4, None)], "id int, j string")
    assert [(r["id"], r["row"]) for r in D.table_rows(t, "id", "j").orderBy("id", "row_no").collect()] == [(1, {"a": "1"}), (1, {"a": "2"}), (2, {"Study Number": "S1", "Dose": "5"})]
    saved = K.save_table(spark.createDataFrame([(1, None)], "x int, y string"), str(tmp_path / "out")).first()
    assert saved["n_rows"] == 1 and saved["columns"] == ["x", "y"] and saved["preview"] == ['{"x":"1","y":""}']
    md = K.markdown_documents(spark.createDataFrame([("d", 2, None), ("d", 1, "hi")], "k string, page_number int, text string"), "k").first()["markdown"]
    assert md == "## Page 1\n\nhi\n\n## Page 2\n\n_No extractable text._"
    xml = '<ectd:study xmlns:ectd="x" xmlns:xlink="l"><study-identifier><title>T</title><study-id>S1</study-id></study-identifier><study-document><doc-content xlink:href="a.pdf"><file-tag name="pre-clinical-study-report"/></doc-content></study-document></ectd:study>'
    assert rows(D.study_index(spark.createDataFrame([(1, xml)], "id int, x string"), "id", "x")) == [(1, "T", "S1", "a.pdf", "pre-clinical-study-report")]
    assert D.docx_pages(["a" * 10, "", "b" * 10], 20) == ["a" * 10, "b" * 10] and D.docx_pages([]) == [""]


def test_messages_and_limits(spark):
    m = spark.createDataFrame([('{"Records": [{"eventTime": "2024-01-01T00:00:00Z", "s3": {"bucket": {"name": "b"}, "object": {"key": "x%20y.pdf", "versionId": "7"}}}]}',), ("no json",), ('{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "x.exe"}}}]}',)], "value string")
    assert [r["document_id"] for r in J.object_events(m).collect()] == ["b/x y.pdf#7"]
    u = spark.createDataFrame([('{"document": {"id": "d"}, "stage": "s", "status": "a", "at": "2024-01-01 00:00:00"}',), ('{"document_id": "d", "stage": "s", "status": "b", "at": "2024-01-02 00:00:00"}',)], "value string")
    assert [tuple(r)[:3] for r in J.latest_stage_status(J.stage_updates(u)).collect()] == [("d", "s", "b")]
    r = spark.createDataFrame([("c", i, float(t)) for i, t in enumerate([100, 120, 130, 161])] + [("d", 9, 100.0)], "k string, i int, t double")
    assert rows(J.limited(r, ["k"], F.col("t"), "i", 2, 60)) == [("c", 0, None), ("c", 1, None), ("c", 2, 30), ("c", 3, None), ("d", 9, None)]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    assert rows(J.stage_order(e)) == [("a", 0), ("b", 1), ("c", 2)]


def test_counted_chunks_stream(spark, tmp_path):
    spark.createDataFrame([("d", i) for i in range(1, 6)], "k string, page_number int").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("k string, page_number int").parquet(str(tmp_path / "p"))
    # a stream with timeouts never runs out of batches, so it is stopped from here
    q = J.counted_chunks(stream, "k", 2).writeStream.format("memory").queryName("counted").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):
        if spark.table("counted").count() >= 2:
            break
        q.awaitTermination(1)
    q.stop()
    got = spark.table("counted").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["n"], r["first_page"], r["last_page"]) for r in got] == [(1, 2, 1, 2), (2, 2, 3, 4)]


def test_natural_order_ranks_every_row(spark, tmp_path):
    from docquarry.plans.reference import QUERIES

    numbers = [(7 * i) % 331 for i in range(331)]
    df = spark.createDataFrame([(n, f"Customer#{n:0{1 + n % 5}d}") for n in numbers], "c_custkey long, c_name string")
    df.repartition(7).write.parquet(f"{tmp_path}/customer.parquet")
    got = rows(QUERIES["natural_order"](spark, str(tmp_path)))
    assert got == [(n, f"Customer#{n:0{1 + n % 5}d}", n + 1) for n in range(331)]
