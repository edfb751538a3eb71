import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import incremental as I
from docquarry.llm import nearest as N
from docquarry.llm import pages as P

# p1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.text("abc", max_size=6), st.integers(0, 2))
def test_trie_meets_every_candidate(words, word, radius):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    met = P.Trie(words).near(list({word, word[::-1]}), radius)  # no two of these letters look alike
    assert sorted((cost / P.EDIT, w) for cost, of, w in met if of == word) == sorted((distance(word, w), w) for w in set(words) if distance(word, w) <= radius)


def test_looks():
    same = lambda a, b: set(P.looks_of(a)) & set(P.looks_of(b))
    for a, b in (("assignecl", "assigned"), ("veh1cle", "vehicle"), ("gr0up", "group"), ("dosirig", "dosing"), ("riitrogen", "nitrogen"), ("sahvation", "salivation"), ("specitlc", "specific"), ("rnarked", "marked")):
        assert same(a, b)
    assert not same("rat", "dog")


def vocabulary(words, pairs=None):
    trie, asked = P.Trie(iter(words)), {*words, "teor"}
    near = {w: P.possible(w, words.get(w, 0), ((cost, m, words[m]) for cost, _, m in trie.near([w], P.edits_of(w)))) for w in asked}
    return P.Vocabulary(words, pairs or {}, {}, {}, max(words.values()), near)


def test_recurring_misreadings_are_looked_up():
    for times in (1, 10):
        v = vocabulary({"moderately": 1300 * times, "moderatcly": 5 * times, "channel": 1460 * times, "channcl": 3 * times, "deviation": 2900 * times, "deviations": 30 * times})
        assert v.meant("moderatcly") == "moderately" and v.meant("channcl") == "channel"
        assert v.meant("deviations") is None and v.meant("moderately") is None


def test_candidates_of_short_and_rare_words():
    v = vocabulary({"below": 60, "bclow": 1, "l1ver": 1, "liver": 50, "lever": 20, "dose": 90, "nose": 2, "colon": 90, "cation": 1})
    assert v.meant("bclow") == "below" and v.meant("l1ver") == "liver"
    assert v.meant("nose") is None and v.meant("cation") is None


def test_candidates_are_ranked_by_neighbours():
    words = {"tear": 400, "fear": 300, "the": 900, "gland": 500}
    assert vocabulary(words).meant("teor") == "tear"
    assert vocabulary(words, {"of fear": 60}).meant("teor", before="of") == "fear"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("clidrnmu1", min_size=1, max_size=5), min_size=1, max_size=20), st.text("clidrnmu1", min_size=1, max_size=5))
def test_automaton_meets_look_alikes(words, word):
    simple = [x for x in words if len(P.looks_of(x)) == 1]
    near = {m for cost, _, m in P.Trie(simple).near([word], 0) if cost < P.EDIT}
    plain = lambda x: x.translate(P._AS_LETTER).translate(P._LIKE)
    assert near >= {x for x in simple if plain(x) == plain(word)}


BODY = "The animals of the control group were given the vehicle once daily and the dosing was without effect on food consumption of the animals in the study group"


def scan(page, rng, lines=12):
    words = [w for _ in range(8) for w in BODY.split()]
    out, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > 60:
            cut = rng.randint(3, len(w) - 2) if len(w) > 6 and rng.random() < 0.5 else 0
            out.append(f"{line} {w[:cut]}-" if cut else line)
            line = w[cut:] if cut else w
        else:
            line = f"{line} {w}".strip()
    return ["Corvane Research Station", "Study AB12-0000001", "", *out[:lines], f"- {page} -"]


def corpus():
    rng = random.Random(4)
    rows = []
    for d in range(12):
        for p in range(1, 6):
            rows.append((d * 10 + p, f"d{d}", p, "\n".join(scan(p, rng))))
    return rows


def test_line_kinds(spark):
    rows = corpus()
    lines = rows[0][3].split("\n")
    lines[4] = lines[4].replace("group", "gr0up").replace("the ", "tbe ", 1)
    lines.insert(6, "COPY")
    lines.insert(8, "~ . '")
    rows[0] = (*rows[0][:3], "\n".join(lines))
    rows += [(900, "d0", 9, None), (901, "d0", 10, ""), rows[0], (902, "dig", 1, BODY + ".\n\n" + BODY + "."), (903, None, None, "x")]
    df = spark.createDataFrame(rows, "id long, source_document_id string, page_number int, text string").selectExpr("*", "'k' as kind", "1 as page_id", "2 as doc")
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in P.line_kinds(df).collect()}
    first = {(n, k) for i, n, k in got if i == rows[0][0]}
    assert {(1, "furniture"), (2, "furniture"), (7, "furniture"), (9, "furniture"), (len(lines), "furniture")} <= first
    assert {n for n, k in first if k == "garble"} == {5}
    for page_id, _, _, text in rows[1:60]:
        mine = {(n, k) for i, n, k in got if i == page_id}
        for n, line in enumerate(text.split("\n"), 1):
            assert ((n, "break") in mine) == (line.endswith("-") and not line.startswith("- ")), line
            assert ((n, "furniture") in mine) == (n <= 2 or line.startswith("- "))
            assert (n, "garble") not in mine
    assert not {i for i, _, _ in got} & {900, 901, 902, 903}
    assert P.line_kinds(df.where("false")).count() == 0


def test_counts_have_no_floor(spark, monkeypatch):
    """Rare words keep their counts in a corpus of any size, and parts of the vocabulary add up to the whole."""
    rows = corpus() + [(900 + i, f"n{i}", 1, BODY.replace("vehicle", "moricept") + "\n\n" + BODY) for i in range(2)]
    df = spark.createDataFrame([(i, d, p, t) for i, d, p, t in rows], "page_id long, doc string, page int, text string")
    counts = P.gather(df)[0].where("kind = 'w'").select("key", "n")
    assert {r["key"]: r["n"] for r in counts.collect()}["moricept"] == 2
    wanted = spark.createDataFrame([("moricept",), ("rnoricept",), ("gr0up",), ("absent",)], "key string")
    for size in (50_000, 5):
        monkeypatch.setattr(P, "TRIE_WORDS", size)
        got = {r["key"]: (r["n"], sorted(m["word"] for m in r["mates"] or [])) for r in P.with_candidates(wanted, counts).collect()}
        assert got == {"moricept": (2, []), "rnoricept": (0, ["moricept"]), "gr0up": (0, ["group"]), "absent": (0, [])}


def test_sieve_loses_no_word(spark):
    words = [f"wört{i}" for i in range(3000)]
    sieve = P.Sieve.of(spark.createDataFrame([(w,) for w in words], "key string"))
    assert all(w in sieve for w in words) and sum(f"other{i}" in sieve for i in range(3000)) < 30
    assert "x" not in P.Sieve.of(spark.createDataFrame([], "key string"))


def test_plain_lines_are_those_without_findings():
    v = vocabulary({"below": 60, "bclow": 1, "dose": 90, "nose": 40, "close": 50, "the": 500})
    for line in ("the below dose", "the bclow 12", "l2 the", "x O the", "the AB1Z-0000001", "clo5e the", "the clo", ""):
        found = P.read_page(line, False, [], v)
        whole = P.Vocabulary(v.words, v.pairs, {}, {}, v.pages, v.near)
        whole.any_open, whole.kind = lambda tokens: True, lambda token: 2  # every token is looked at
        assert [(x.garbled, x.fixes) for x in found] == [(x.garbled, x.fixes) for x in P.read_page(line, False, [], whole)]


def test_paragraphs(spark):
    df = spark.createDataFrame(corpus(), "id long, source_document_id string, page_number int, text string")
    got = P.paragraphs(df).collect()
    assert {r["source_document_id"] for r in got} == {f"d{d}" for d in range(12)}
    assert not any("Corvane" in r["text"] or "- 1 -" in r["text"] for r in got)
    # pages of this corpus end anywhere, so the first part of a word may stand at a page's end
    odd = {w for r in got for w in r["text"].split()} - set(BODY.split())
    assert all(any(b.startswith(w) for b in BODY.split()) for w in odd) and len(odd) < 12


# p3


def vectors(spark, x, ids=None):
    rows = [(ids[i] if ids else f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>")


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    monkeypatch.setattr(N, "LIST", 60)
    monkeypatch.setattr(N, "PART", 40 * 64)  # bytes of 40 vectors
    monkeypatch.setattr(N, "QUERIES", 70 * 64)
    got = {(r["chunk"], r["neighbour"]) for r in N.neighbours(vectors(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u.astype(np.float64) @ u.T
    np.fill_diagonal(sims, -9)
    wanted = {(f"c{i:05d}", f"c{j:05d}") for i, row in enumerate(np.argsort(-sims, axis=1)[:, :10]) for j in row}
    assert len(got) == 15_000 and len(got & wanted) >= 0.95 * len(wanted)


def test_equal_null_and_zero_vectors(spark):
    df = vectors(spark, [[1, 0]] * 30 + [[0, 1], [0.1, 1], [0, 0]], [f"{i:02d}" for i in range(33)]).unionByName(spark.createDataFrame([("n", None), ("e", []), ("x", [float("nan"), 1.0]), ("y", [1.0]), ("00", [1.0, 0.0])], "chunk_id string, embedding array<float>"))
    rows = N.neighbours(df.selectExpr("*", "1 as vid", "2 as cosine"), min_cos=0.9).collect()
    of = lambda k: [r["neighbour"] for r in sorted((r for r in rows if r["chunk"] == k), key=lambda r: r["rank"])]
    assert of("00") == [f"{i:02d}" for i in range(1, 11)] and of("29") == [f"{i:02d}" for i in range(10)]
    assert of("30") == ["31"] and {r["chunk"] for r in rows} == {f"{i:02d}" for i in range(32)}
    pairs = {(r["chunk_a"], r["chunk_b"]) for r in N.mutual_pairs(N.neighbours(df, min_cos=0.9)).collect()}
    assert pairs == {(f"{i:02d}", f"{j:02d}") for i in range(11) for j in range(i + 1, 11)} | {("30", "31")}
    assert N.neighbours(df.where("false")).count() == 0


def test_vectors_of_several_lengths(spark):
    df = vectors(spark, [[1.0, 0.0], [0.9, 0.1], [1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.1]])
    got = {(r["chunk"], r["neighbour"]) for r in N.neighbours(df, k=5).collect()}
    assert got == {("c00000", "c00001"), ("c00001", "c00000")} | {(f"c0000{i}", f"c0000{j}") for i in (2, 3, 4) for j in (2, 3, 4) if i != j}


def test_vectors_that_share_a_digest_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    digest, salts = F.xxhash64, []

    def bad(*cs):
        if len(cs) == 2 and cs[0] == "raw":
            salts.append(1)
            return F.lit(7).cast("bigint") if len(salts) == 1 else digest(*cs)
        return digest(*cs)

    monkeypatch.setattr(N.F, "xxhash64", bad)
    got = {(r["chunk"], r["neighbour"]) for r in N.neighbours(vectors(spark, [[1.0, 0.0], [0.0, 1.0]])).collect()}
    assert got == {("c00000", "c00001"), ("c00001", "c00000")} and len(salts) == 2


# p7

H = "ab" * 32


@pytest.mark.parametrize(("a", "b", "same"), [("scan_AQ12_0000005 draft rport V1.0 (2).pdf.pdf", "AQ12-0000005-Draft-Report-v1.pdf", True), ("C:\\x\\Prot. Amdt. 2. AQ120000005. ver1.PDF", "AQ12-0000005 Protocol Amendment 2 v1.pdf", True), ("AQ12-0000005_Draft_Report_v2.pdf", "AQ12-0000005_Draft_Report_v1.pdf", False), ("AQ12-0000005_Final_Report_v1.pdf", "AQ12-0000005_Draft_Report_v1.pdf", False), ("AQ12-0000005%20Protocol%20Amendment%201%20v1.pdf", "AQ12-0000005_Protocol_Amendment_2_v1.pdf", False), ("AQ12-0000006_Draft_Report_v1.pdf", "AQ12-0000005_Draft_Report_v1.pdf", False), ("1690518752_Draft Report aq12 0000005 rev 1 - Copy.pdf", "AQ12-0000005_Draft_Report_v1.pdf", True)])
def test_names(spark, a, b, same):
    titles = I.Titles({"draft report": 50, "final report": 40, "protocol amendment 1": 30, "protocol amendment 2": 30})
    df = spark.createDataFrame([("1", a, None, 1), ("2", b, None, 1)], "id string, file_name string, sha256 string, batch_no int")
    x, y = I.described(df).orderBy("id").collect()
    assert ((x["study"], titles.resolve(x["raw_title"]), x["version"]) == (y["study"], titles.resolve(y["raw_title"]), y["version"])) == same


def files():
    rows, n = [], 0
    for s in range(30):
        for title in ("Draft_Report", "Final_Report", "Study_Protocol"):
            n += 1
            rows.append((f"{n:04d}", f"AB12-{s:07d}_{title}_v1.pdf", f"{n:064x}", n % 5 + 1))
    rows += [("c1", "scan.pdf", "SHA256:" + f"{7:064x}".upper(), 5), ("c2", "AB12 0000002 draft report V1.0 (1).pdf", "pending", 5), ("c3", "x.pdf", "0" * 64, 4), ("c4", "y.pdf", "0" * 64, 4), ("c5", None, None, None), ("c6", "scan.pdf", " 0x" + f"{7:064x}", 2), rows[0], ("c7", "AB12-0000003_Study_Protocol_v2.pdf", f"{7:064x}", 3), ("c8", "AB12_0000003-study-protocol-v2.pdf", "n/a", 5)]
    return rows


def brute(spark, df):
    records = [r.asDict() for r in I.keyed(I.described(df), I.learn_titles(I.described(df))).collect()]
    root = {r["id"]: r["id"] for r in records}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in records:
        for b in records:
            name = a["study"] and (a["study"], a["title"], a["version"]) == (b["study"], b["title"], b["version"])
            if name or (a["hash"] and a["hash"] == b["hash"]):
                x, y = sorted((find(a["id"]), find(b["id"])))
                root[y] = x
    return {(a, b) for a in root for b in root if a < b and find(a) == find(b)}


def test_classes_are_those_of_brute_force(spark):
    df = spark.createDataFrame(files(), "id string, file_name string, sha256 string, batch_no int").selectExpr("*", "'k' as key", "1 as rep")
    wanted = brute(spark, df)
    assert ("c1", "c6") in wanted and ("c7", "c8") in wanted and ("0007", "c2") in wanted and ("c3", "c4") not in wanted
    for single in (1, 3):
        assert {(r["id_a"], r["id_b"]) for r in I.same_file_pairs(I.classes(I.load(df, single))).collect()} == wanted
    assert I.same_file_pairs(I.classes(I.load(df.where("false")))).count() == 0


def test_batches_are_judged_as_they_come(spark):
    rows = [("b1", "AB12-0000001_Draft_Report_v1.pdf", f"{1:064x}", 1), ("a2", "AB12-0000002_Draft_Report_v1.pdf", f"{2:064x}", 2), ("a3", "AB12-0000001_Draft_Report_v1.pdf", f"{2:064x}", 3)]
    held = I.classes(I.load(spark.createDataFrame(rows, "id string, file_name string, sha256 string, batch_no int"), 2))
    # the last record ties the files of the batches before, which were apart when they came
    assert {r["class_id"] for r in held.collect()} == {"a2"}
    assert {r["batch_no"]: (r["n_records"], r["n_held"]) for r in I.batch_report(held).collect()} == {1: (1, 0), 2: (1, 0), 3: (1, 1)}


def test_titles_are_learned_from_the_backlog(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(I, "learn_titles", lambda df, f=I.learn_titles: seen.append({r[0] for r in df.select("batch_no").collect()}) or f(df))
    I.load(spark.createDataFrame(files(), "id string, file_name string, sha256 string, batch_no int"), 2)
    assert seen == [{1, 2, 3, None}]


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"k{j}") for i in range(40) for j in (i, i + 1)] + [("z", "alone")], "node string, key string")
    got = {r["node"]: r["root"] for r in I.components(edges).collect()}
    assert {v for k, v in got.items() if k != "z"} == {"n000"} and got["z"] == "z"


def test_a_new_session_reads_only_what_a_batch_hits(spark, tmp_path):
    rows = [(f"r{i:05d}", f"AB12-{i:07d}_Draft_Report_v1.pdf", f"{i + 1:064x}", 1) for i in range(2000)]
    schema = "id string, file_name string, sha256 string, batch_no int"
    backlog = I.described(spark.createDataFrame(rows, schema))
    path = f"{tmp_path}/history"
    I.add_batch(I.start(backlog, path, parts=200), backlog)
    state = I.open_state(spark, path)
    assert state.generations == (1,) and state.titles == {"draft report": 2000}
    new = [("n1", "copy of AB12-0000007 draft report v1.pdf", None, 2), ("n2", "scan.pdf", f"{9:064x}", 2), ("r00003", "x.pdf", None, 2), ("n3", "AB12-0000007_Draft_Report_v1.pdf", f"{9:064x}", 2)]
    batch = I.described(spark.createDataFrame(new, schema))
    asked = []
    table = I.State.table
    I.State.table = lambda self, name, only=None: asked.append((name, only)) or table(self, name, only)
    try:
        after = I.add_batch(state, batch)
    finally:
        I.State.table = table
    assert all(only is not None for _, only in asked) and {n for n, _ in asked} == {"members", "keys", "mapping", "classes"}
    read = sum(table(state, name, only).count() for name, only in asked)
    assert read < 200  # of 2,000 members and 4,000 keys
    held = I.open_state(spark, path)
    assert held.generations == (1, 2) == after.generations
    got = {r["id"]: (r["class_id"], r["held"]) for r in I.classes(held).where("id in ('r00007', 'r00008', 'n1', 'n2', 'n3', 'r00003')").collect()}
    root = got["n1"][0]
    assert {got[x][0] for x in ("r00007", "r00008", "n1", "n2", "n3")} == {root} and got["r00003"][0] == "r00003"
    assert got["n1"][1] and got["n2"][1] and not got["r00007"][1]
    whole = I.compacted(held)
    assert whole.generations == (3,) and sorted(map(tuple, I.classes(whole).collect())) == sorted(map(tuple, I.classes(held_again(spark, path)).collect()))
    sizes = {r["id"]: r["n_links"] for r in I.class_sizes(I.classes(whole)).where("id in ('n1', 'r00003')").collect()}
    assert sizes == {"n1": 4, "r00003": 0}


def held_again(spark, path):
    state = I.open_state(spark, path)
    assert state.generations == (3,)
    return state


def test_rounds_over_executors_give_the_same_classes(spark, monkeypatch):
    df = spark.createDataFrame(files(), "id string, file_name string, sha256 string, batch_no int")
    wanted = {(r["id"], r["class_id"]) for r in I.classes(I.load(df, 2)).collect()}
    monkeypatch.setattr(I, "LOCAL_LINKS", 0)
    monkeypatch.setattr(I, "GENERATIONS", 2)
    assert {(r["id"], r["class_id"]) for r in I.classes(I.load(df, 2)).collect()} == wanted
