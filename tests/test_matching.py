import random
import time

from pyspark.sql import functions as F

from docquarry.functions import fuzzy as Z
from docquarry.operators import matching as M
from docquarry.operators import repair as P


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_headers(spark):
    df = spark.createDataFrame([("Dose (mg/kg)",), ("Study No.",), ("Sex",), ("Organ System",), ("Species/Strain",), ("Dose concentration",)], "h string")
    assert [r["o"] for r in df.select(M.header_token(F.col("h")).alias("o")).collect()] == ["doses", "study number", "gender", "organ systems evaluated", "species strain", "dose concentration"]


def test_best_by_labels(spark):
    df = spark.createDataFrame([(1, "report QX77-TOX-204-B on dogs"), (2, "cardiac safety of the drug in dogs"), (3, "see AB12-345 only"), (4, None)], "id int, t string")
    c = spark.createDataFrame([("QX77-TOX-204-B", ["other"]), ("XX99-0001", ["cardiac safety dogs"])], "c string, labels array<string>")
    assert [(r["id"], r["candidate"]) for r in M.best_by_labels(df, "id", "t", c, "c", "labels").orderBy("id").collect()] == [(1, "QX77-TOX-204-B"), (2, "XX99-0001"), (3, "AB12-345")]


def test_sections_of_texts(spark):
    s = spark.createDataFrame([("2.6.1", "Introduction", 1), ("2.6.2", "Pharmacology", 2)], "n string, t string, p int")
    df = spark.createDataFrame([(1, "as said in 2.6.2 and 2.6.1"), (2, "pharmacology written summary")], "id int, x string")
    assert rows(M.section_in_text(df, "id", "x", s, "n", "p")) == [(1, "2.6.1", 0.98)]
    best = {r["id"]: r["number"] for r in M.similar_sections(df, "id", "x", s, "n", "t", 1).collect()}
    assert best[2] == "2.6.2"


def test_realign_and_specifications(spark):
    t = spark.createDataFrame([("a", "X", ["Study No", "Route", "Sex"]), ("b", "Y", ["other"])], "k string, sub string, cols array<string>")
    s = spark.createDataFrame([("X", ["foo", "bar"]), ("Z", ["study number", "method of administration"])], "spec string, cols array<string>")
    assert rows(M.realign(t, "k", "sub", "cols", s, "spec", "cols")) == [("a", "Z", True), ("b", "Y", False)]
    tables = spark.createDataFrame([("X", 1, "old"), ("X", 2, "new")], "sub string, pos int, v string")
    assert rows(M.by_specification(s.select("spec"), "spec", tables, "sub", "pos").select("spec", F.coalesce("v", F.lit("-")))) == [("X", "new"), ("Z", "-")]


def test_overrides_fields_and_trees(spark):
    a = spark.createDataFrame([("1", {"x": "a", "y": "b"}), ("2", {"x": "c"})], "k string, p map<string,string>")
    b = spark.createDataFrame([("1", {"y": "z"}), ("3", {"q": "r"})], "k string, p map<string,string>")
    assert {r["k"]: r["p"] for r in M.with_overrides(a, b, "k", "p").collect()} == {"1": {"x": "a", "y": "z"}, "2": {"x": "c"}, "3": {"q": "r"}}
    df = spark.createDataFrame([(1, "The study id and the AUC values of dogs"), (2, None)], "id int, c string")
    f = spark.createDataFrame([("Study ID",), ("AUC values",), ("genotoxicity battery",)], "f string")
    assert rows(M.fields_present(df, "id", "c", f, "f")) == [(1, "AUC values", True), (1, "Study ID", True), (1, "genotoxicity battery", False), (2, "AUC values", False), (2, "Study ID", False), (2, "genotoxicity battery", False)]
    assert M.folder_keys("m4", {"42": {"421": {}}, "43": None}) == ["m4/42/", "m4/42/421/", "m4/43/"]
    assert M.within_budget([(3,), (2,), (1,)], lambda n: "x" * 10 * n, 25) == "x" * 20
    got = spark.createDataFrame([("2.4.1",), ("2.5",)], "s string").select(M.round_trip_sections(F.col("s"), {"2.4": "2.6", "2.4.1": "2.6.2"}).alias("o")).collect()
    assert [r["o"] for r in got] == ["2.6.2", None]


def test_partial_ratios_of_all_titles():
    some = random.Random(7)
    text = lambda letters, most: "".join(some.choice(letters) for _ in range(some.randint(0, most)))
    for letters in ("ab", "abc ", "abcdefgh é\U0001f600"):
        for _ in range(40):
            titles, x = [text(letters, some.choice([3, 10, 70, 130])) for _ in range(some.randint(0, 6))], text(letters + "z", some.choice([3, 10, 66, 140, 300]))
            for kind in (Z.Titles, type("Parted", (Z.Titles,), {"LANES": 100}), type("Single", (Z.Titles,), {"LONG": 10})):
                assert kind(titles).partial_ratios(x) == [Z.partial_ratio(t, x) for t in titles]


def test_similar_sections_of_repeated_texts(spark):
    some = random.Random(1)
    words = ["".join(some.choice("abcdefghilmnoprstu") for _ in range(9)) for _ in range(40)]
    s = spark.createDataFrame([(f"{i:06d}", f"{some.choice(words)} {some.choice(words)}") for i in range(64)], "n string, t string")
    texts = sorted({f"{some.choice(words)} {some.choice(words)}" for _ in range(2_000)})[:600]
    df = spark.createDataFrame([(i, texts[i % 600]) for i in range(12_000)] + [(-1, None), (-2, " ")], "id int, x string")
    began = time.time()
    got = M.similar_sections(df, "id", "x", s, "n", "t", 100).cache()
    assert got.count() == 12_000 * 64 and got.where("id < 0").count() == 0
    assert time.time() - began < 60  # 12,000 texts one by one take minutes
    few = [(r["n"], r["t"]) for r in s.collect()]
    for i in (0, 599, 1_777):
        want = sorted((-max(Z.partial_ratio(t, texts[i % 600]), Z.partial_ratio(f"{n} {t}", texts[i % 600])), n) for n, t in few)
        assert [(r["rank"], r["number"], r["score"]) for r in got.where(F.col("id") == i).orderBy("rank").collect()] == [(k, n, round(-v / 100, 3)) for k, (v, n) in enumerate(want, 1)]
    got.unpersist()


def _best_one_by_one(pairs, text, least=70.0):
    found = [(-s, c) for c, label in pairs if (s := Z.token_set_ratio(text.lower(), label.lower())) >= least]
    return (min(found)[1], -min(found)[0]) if found else None


def test_best_label_as_one_by_one():
    some = random.Random(3)
    for _ in range(400):
        letters = some.choice(["ab", "abcdeé\U0001f600", "ABc", "0123-Q"])
        words = ["".join(some.choice(letters) for _ in range(some.randint(1, some.choice([2, 6, 30])))) for _ in range(some.randint(1, 8))]
        phrase = lambda: " ".join(some.choice(words) for _ in range(some.randint(0, some.choice([1, 3, 6]))))  # noqa: B023, E731
        pairs = [(some.choice("pqrst"), phrase()) for _ in range(some.randint(0, 12))]
        for least in (0.0, 30.0, 70.0, 100.0):
            text = phrase() + some.choice(["", letters[0]])
            assert Z.Labels(pairs).best(text, least) == _best_one_by_one(pairs, text, least)


def test_best_by_labels_of_many_candidates(spark):
    some = random.Random(5)
    words = ["".join(some.choice("abcdefghilmnoprstu") for _ in range(8)) for _ in range(60)]
    phrase = lambda n: " ".join(some.choice(words) for _ in range(n))
    listed = [(f"AB{i % 90:02d}-{i:07d}", [phrase(some.randint(1, 3)), None] if i % 3 else None) for i in range(6_000)]
    c = spark.createDataFrame(listed, "c string, labels array<string>")
    texts = [f"see {listed[i][0]}.pdf" for i in range(0, 6_000, 60)] + [phrase(some.randint(1, 5)) for _ in range(60)] + ["AB01-9000001", "on AB01-9000001 and others", "zzzz", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    pairs = [(i, label) for i, labels in listed for label in (i, *(x for x in labels or [] if x is not None))]
    want = {}
    for i, t in enumerate(texts):
        if i < 100:
            want[i] = (listed[i * 60][0], 101.0)
        elif t is not None and (best := _best_one_by_one(pairs, t)):
            want[i] = best
    want.setdefault(161, ("AB01-9000001", -1.0))
    assert len(want) > 150 and want[160][1] > 70  # an unknown id has a near label
    for shard in (None, 700):  # more labels than one list had; in one shard and in many
        assert {r["id"]: (r["candidate"], r["score"]) for r in M.best_by_labels(df, "id", "t", c, "c", "labels", shard=shard).collect()} == want
    exact = df.where("id < 100")
    assert M.best_by_labels(exact, "id", "t", c, "c", "labels", shard=700).where("score = 101.0").count() == 100  # no text is left


def test_study_ids_among_many_candidates(spark):
    listed = [(f"AB{i % 90:02d}-{i:07d}", ["arthritis of rabbits"] if i == 7 else None) for i in range(6_000)]
    c = spark.createDataFrame(listed, "c string, labels array<string>")
    rows = [
        (1, "Study AB05-0000005", None, None, "AB05-0000005"),
        (2, "None conducted", "AB05-0000005", "AB05-0000005", "None conducted"),
        (3, "", "Module 4 AB06-0000006 report", "AB05-0000005", "AB06-0000006"),
        (4, "?", None, "as in AB09-0000009", "AB09-0000009"),
        (5, "QX77-TOX-204", None, None, "QX77-TOX-204"),
        (6, " ", "arthritis of rabbit", None, "AB07-0000007"),
        (7, None, " ", None, None),
        (8, "-", "nothing here", "AB10-0000010", "AB10-0000010"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id int, study string, location string, other string")
    got = P.with_study_ids(df, "id", "study", "location", ["study", "location", "other"], c, "c", "labels")
    assert {r["id"]: r["study"] for r in got.collect()} == {r[0]: r[4] for r in rows}
    assert str(got._jdf.queryExecution().optimizedPlan()).count("Join") <= 12  # more with all sources in one plan
