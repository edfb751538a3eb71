from docquarry.operators import tables as B


def built(*rows):
    found = B.recover([[list(r) for r in rows]])[0]
    return found and {"columns": found[0], "rows": found[1]}


def test_unnamed_columns_and_ragged_rows():
    assert built(["Organ", "", "Weight"], ["liver", "x"], ["heart", "y", "2.5", "late"]) == {"columns": ["Organ", "col_2", "Weight", "col_4"], "rows": [["liver", "x", "", ""], ["heart", "y", "2.5", "late"]]}


def test_header_behind_title_and_metadata():
    body = ["low", "12", "oral"]
    want = {"columns": ["Group", "Animals", "Route"], "rows": [body]}
    assert built(["Figure 7 and what it shows"], ["Group", "Animals", "Route"], body) == want
    assert built(["Protocol: QX-77", "Version 3"], ["Group", "Animals", "Route"], body) == want


def test_numbers_under_labels():
    got = built(["Treatment", "", "WEEK", "", ""], ["", "", "1", "4", "13"], ["vehicle", "m", "8.1", "8.4", "9.9"])
    assert got == {"columns": ["Treatment", "col_2", "WEEK 1", "WEEK 4", "WEEK 13"], "rows": [["vehicle", "m", "8.1", "8.4", "9.9"]]}


def test_units_join_the_header():
    assert built(["Parameter", "Dose", "Time"], ["", "(mg/kg)", "(h)"], ["Cmax", "3", "0.5"])["columns"] == ["Parameter", "Dose (mg/kg)", "Time (h)"]


def test_first_line_of_a_two_line_header():
    assert built(["Mean organ", "Relative organ", "Body"], ["weight finding", "weight finding", "weight finding"], ["1", "2", "3"])["rows"] == [["1", "2", "3"]]


def test_what_is_no_table():
    words = ["the animals were kept", "in rooms, at constant", "humidity and warmth, and"]
    assert built(words, words[::-1], words) is None
    assert built(["Appr", "oved", "for", "use", "by"], ["the", "qual", "ity", "unit", "of"], ["our", "comp", "any", "in", "May"]) is None
    assert built(["Contents", "........", "........", "......."], ["Scope", "........", "........", "......."]) is None
    assert built(["Sponsor: Ellmoor", "Report 12"], ["Prepared by", "Approved by"]) is None
    assert B.recover([None, [], [["alone"]], [[], []]]) == [None] * 4


def test_tables_of_a_batch_do_not_touch_each_other():
    a = [["Organ", "Finding"], ["liver", "cyst"]]
    b = [["Species", "Route"], ["rat", None]]
    assert B.recover([a, None, b]) == [B.recover([a])[0], None, B.recover([b])[0]]


def test_key_values():
    assert B.key_values([["Report Number", "123"], ["Pages", "2"]]) == {"Report Number": "123", "Pages": "2"}
    assert B.key_values([["Sponsor: X\nY", "Page 3"]]) == {"Sponsor": "X Y", "Page Info": "Page 3"}
    assert B.key_values([["a", "b", "c"]]) == {} and B.key_values([]) == {}


def test_unique_names_and_markdown_tables():
    assert B.unique_names(["x", "x", "", " ", "x"]) == ["x", "x_2", "column", "column_2", "x_3"]
    html = B.markdown_tables("t\n| a | b |\n| --- | --- |\n| 1 | <2> |\nend\n| alone |")
    assert html == ["<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>"]
    assert B.markdown_tables(None) == []


def test_recovered_tables_column(spark):
    df = spark.createDataFrame([(1, [["Organ", ""], ["liver", None]], "old"), (2, None, "old"), (3, [], "old")], "id int, rows array<array<string>>, table string")
    got = {r["id"]: r["table"] for r in B.recovered_tables(df).collect()}
    assert got[1]["columns"] == ["Organ", "col_2"] and got[1]["rows"] == [["liver", ""]] and got[2] is None and got[3] is None
