import html
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import canonical as C
from docquarry.llm import encode as E
from docquarry.llm import mixture as M
from docquarry.llm import split as S
from docquarry.llm import truncated as T

# p4


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_range_maximum_is_the_rightmost(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    window = values[low : high + 1]
    best = max(window)
    assert S.RangeMaximum(np.array(values)).query(low, high) == (low + max(i for i, v in enumerate(window) if v == best), best)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_pieces_cover_the_text(text):
    parts = S.pieces(text, 50, 10)
    if not text:
        assert parts == []
        return
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(0 < b - a <= 50 for a, b, _ in parts)
    assert all(q[0] == p[1] - 10 for p, q in zip(parts, parts[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b ", "c; ", "d. ", "\n", "\n\n", " \n \n", "-"]), st.integers(1, 45)), min_size=1, max_size=12))
def test_cuts_decide_as_the_definition(parts):
    text = "".join(x * n for x, n in parts)
    if len(text) > 40:
        if any(len(r) > 40 for r in re.findall(r"[^\W_]+", text)):
            wanted = "hard"
        else:
            ends = [0, *(i for i, s in enumerate(S.strengths(text)) if s == S.PARAGRAPH), len(text)]
            wanted = "paragraph" if all(len(text[a:b].strip()) <= 40 for a, b in zip(ends, ends[1:], strict=False)) else "within"
        assert S.cut_level(text, 40, 8) == wanted


def test_cut_levels_come_from_the_pieces(monkeypatch):
    seen = []
    monkeypatch.setattr(S, "pieces", lambda *a, f=S.pieces: seen.append(a) or f(*a))
    assert S.cut_level("a b " * 300 + "\n\n" + "c d " * 300) == "paragraph" and len(seen) == 1


def test_cut_levels():
    assert S.cut_level("a" * 1501) == "hard" and S.cut_level("x-" * 900) == "within"
    assert S.cut_level("a b " * 300 + "\n \t\n" + "c d " * 300) == "paragraph"
    assert S.cut_level("a b " * 300 + "\r\n\r\n" + "c d " * 300) == "paragraph"
    assert S.cut_level("a b " * 300 + "\n" + "c d " * 300) == "within"
    long = "word " * 150_000
    assert all(b - a <= 1500 for a, b, _ in S.pieces(long))


def test_split_rows(spark):
    rows = [("a", 5, "S", "w " * 1000), ("a", 5, "S", "w " * 1000), ("b", None, None, "z" * 2000), ("c", 0, "S", "short"), ("d", 0, "S", None), (None, 0, "S", "y" * 1600)]
    df = spark.createDataFrame(rows, "id string, offset_start int, section_label string, raw_text string").selectExpr("*", "1 as piece", "2 as start")
    got = S.split(df).collect()
    assert {r["chunk_id"] for r in got} == {"a", "b", None}
    for r in got:
        text = next(t for i, o, _, t in rows if i == r["chunk_id"])
        assert text[r["start"] : r["end"]] == r["piece"] and r["offset_known"] == (r["chunk_id"] != "b")
        assert r["offset_start"] == r["start"] + (5 if r["chunk_id"] == "a" else 0)
    assert sorted((r["chunk_id"] or "", r["cut_level"]) for r in S.cut_levels(df).collect()) == [("", "hard"), ("a", "within"), ("b", "hard")]
    assert S.split(df.where("false")).count() == 0 == S.cut_levels(df.where("false")).count()


# p5

ENTRIES = [(1, "rat", ["rattus norvegicus"]), (2, "guinea pig", None), (3, "marmoset", []), (4, "mouse", ["mice"]), (5, "cynomolgus monkey", ["cyno"])]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_distance_is_a_metric(a, b, c):
    d = C.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.text("abc", max_size=6), st.integers(0, 3))
def test_bk_tree_returns_every_entry(entries, value, radius):
    assert sorted(C.BKTree(entries).within(value, radius)) == sorted((C.distance(value, e), e) for e in set(entries) if C.distance(value, e) <= radius)


@pytest.mark.parametrize(("value", "term"), [("RAT", 1), ("male rat (n=20)", 1), ("Rattus norvegicus.", 1), ("guineaig", 2), ("pig, guinea", 2), ("Guinea apig", 2), ("maromset", 3), ("m0use", 4), ("mousé", 4), ("mice", 4), ("bat", 0), ("hare", 0), ("unknown", 0), ("", 0), ("???", 0), ("cynomolgus monkey\xa0", 5), ("x" * 5000, 0)])
def test_values_denote_terms(value, term):
    assert C.Terms(ENTRIES).look_up(value) == term


def test_denoted(spark):
    terms = spark.createDataFrame([("species", *e) for e in ENTRIES], "field string, term_id int, term string, alt_names array<string>")
    df = spark.createDataFrame([("1", "rat"), ("2", "Rat"), ("2", "Rat"), ("3", None), ("4", " \t"), ("5", "ferret")], "study_id string, species string").selectExpr("*", "'a' as field", "9 as term_id", "'v' as value")
    values = C.entries(df, "species", "study_id")
    assert sorted(tuple(r) for r in C.denoted(values, terms).collect()) == [("species", "2", 1), ("species", "5", 0)]
    assert [tuple(r) for r in C.unmatched(values, terms).collect()] == [("species", "ferret", 1)]
    assert C.denoted(values.where("false"), terms).count() == 0
    assert {r["term_id"] for r in C.denoted(values, terms.where("false")).collect()} == {0}


def test_shards_give_what_one_list_gives(spark):
    terms = spark.createDataFrame([("species", *e) for e in ENTRIES] + [("organ", 1, "liver", None), ("organ", 2, "adrenal gland", None)], "field string, term_id int, term string, alt_names array<string>")
    forms = ["RAT", "male rat (n=20)", "Rattus norvegicus.", "guineaig", "pig, guinea", "maromset", "m0use", "mice", "bat", "hare", "???", "liver", "lever", "gland, adrenal", "adrenals"]
    values = spark.createDataFrame([(f, v) for f in ("species", "organ", "none") for v in forms], "field string, value string")
    one = sorted(map(tuple, C.map_values(values, terms).collect()))
    for shard in (1, 3):
        assert sorted(map(tuple, C.map_values(values, terms, shard).collect())) == one
    assert C.map_values(values.where("false"), terms, 1).count() == 0


# p8


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_other_library(text):
    assert E.encode_text(text) == reference_.encode(text, add_special_tokens=False).ids
    assert E.decode_ids(E.encode_text(text)).decode("utf-8") == text


reference_ = reference()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "  ", "1", "\n", ".", "é", "\t", "日本"]), max_size=80), st.integers(1, 9))
def test_safe_boundaries_change_nothing(parts, size):
    text = "".join(parts)
    whole = E.encoding().encode_ordinary(text)
    assert [i for p in E.segments(text, size) for i in E.encoding().encode_ordinary(p)] == whole and "".join(E.segments(text, size)) == text


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello <|endoftext|>"), (4, "a b " * 60_000), (3, "hello <|endoftext|>")], "doc_id long, text string").selectExpr("*", "'x' as ids", "0 as n_tokens")
    got = {r["doc_id"]: r["ids"] for r in E.encode(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[3] and got[4] == E.encoding().encode_ordinary("a b " * 60_000)
    assert {r["doc_id"]: r["n_tokens"] for r in E.encode(df, "doc_id", "text", count_only=True).collect()} == {k: len(v) for k, v in got.items()}
    assert E.encode(df.where("false"), "doc_id", "text").count() == 0
    back = E.decode(E.encode(df, "doc_id", "text"), "doc_id", "ids").where("doc_id = 3").first()
    assert bytes(back["bytes"]).decode() == "hello <|endoftext|>"


# p9


def test_mix(spark):
    docs = [(i, f"text number {i} of the big source", "big") for i in range(400)] + [(1000 + i, f"small text {i} here", "small") for i in range(20)] + [(5000, "text number 1 of the big source", "big"), (5001, "small text 3 here", "big"), (5002, None, "big"), (5003, " ", "small"), (5004, "other", "unlisted"), (5005, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as rate", "2 as digest", "3 as copies")
    target = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeat int")
    mixed, report = M.mix(df, target)
    rows = mixed.collect()
    texts = dict((d, t) for d, t, _ in docs)
    uses: dict[str, int] = {}
    for r in rows:
        uses[texts[r["doc_id"]]] = uses.get(texts[r["doc_id"]], 0) + 1
    assert max(uses.values()) <= 3 and {r["source"] for r in rows} == {"big", "small"}
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["rate"] == 3.0 and got["small"]["n_emitted"] == 60 and abs(got["big"]["actual_share"] - 0.5) < 0.1 and got["none"]["n_emitted"] == 0
    assert sorted(tuple(r) for r in M.mix(df, target)[0].collect()) == sorted(tuple(r) for r in rows)
    # a larger total: the small source ends at its bound and its shortfall is told
    more = {r["source"]: r for r in M.mix(df, target, total=2_000)[1].collect()}
    assert more["small"]["rate"] == 3.0 and more["small"]["shortfall"] == 1000 - more["small"]["tokens_emitted"] > 0 and more["big"]["tokens_emitted"] > got["big"]["tokens_emitted"]
    assert M.mix(df.where("false"), target)[0].count() == 0 and M.mix(df, target.where("false"))[0].count() == 0


# p10


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cc"], include_characters="\n\t\r"), max_size=40))
def test_lengths_are_those_of_the_encodings(text):
    got = dict(zip(T.ENCODINGS, T.lengths(text), strict=True))
    crlf = text.replace("\r\n", "\n").replace("\n", "\r\n")
    assert got["chars"] == len(text) and got["utf8"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-le")) // 2
    assert got["crlf"] == len(crlf) and got["crlf_utf8"] == len(crlf.encode())
    assert got["entities"] == len(html.escape(text, quote=False)) and got["entities_quotes"] == len(html.escape(text))
    assert got["numeric_entities"] == len(html.escape(text, quote=False).encode("ascii", "xmlcharrefreplace"))
    if all(c.isascii() or c.isprintable() for c in text):
        plain = text.replace("\x7f", "")
        assert dict(zip(T.ENCODINGS, T.lengths(plain), strict=True))["json"] == len(json.dumps(plain, ensure_ascii=False)) - 2


@pytest.mark.parametrize(("text", "end"), [("It is done.", "closed"), ("It was don", "unclear"), ("It was all done by the stud", "open"), ("A sentence that stops in the mid…", "open"), ("Whole sentence here. …", "closed"), ("the text goes on [...]", "open"), ("mid sentence of the report was\n\n— End of Report —", "open"), ("Done here.\n\n— End of Report —", "closed"), ("x y.\n| a | b |\n| 1 | 2 |", "closed"), ("x y.\n- mild necrosis, liver", "unclear"), ("x y.\n1) Report AB12-0000001, Lab, 2019", "closed"), ("value 20\\u00", "residue"), ("at 300 mg/k&am", "residue"), ("complian�", "residue"), ("x y.\n\nReviewed ✓", "closed"), ("これは文です。", "closed"), ("これらの変化は休薬期間後に部分的な回復", "open"), ("", "empty"), (None, "empty"), (" \n ", "empty"), ("a b c d e f g. Approved by the unit, Lab, 3 May 2020", "open")])
def test_endings(text, end):
    assert T.ending(text) == end


def test_hidden_limit_is_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    whole = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    docs = [(i, whole(rng.randint(20, 90)), "s") for i in range(150)] + [(1000 + i, whole(120)[:400].rstrip(), "s") for i in range(40)] + [(2000, None, "s"), (2001, "", "s"), (1000, None, "s"), (3000, "Whole text.", None)]
    df = spark.createDataFrame(docs[:-2] + docs[-1:], "doc_id long, text string, source string").selectExpr("*", "1 as ending", "2 as lengths", "3 as caps")
    seen, cut = T.find(df)
    assert {r["limit"] for r in T.limits(seen).where("best").collect()} <= {399, 400} and T.limits(seen).where("best").count() >= 1
    got = {r["doc_id"] for r in cut.collect()}
    wanted = {1000 + i for i in range(40) if not docs[150 + i][1].endswith(".")}
    assert got == wanted
    share = {r["source"]: r["n_texts"] for r in T.shares(seen, cut).collect()}
    assert share == {"s": 190, None: 1}
    assert T.find(df.where("false"))[1].count() == 0


def test_limits_of_several_encodings(spark):
    """One source cut at 400 characters and, on another way, at 300 bytes; every cut row tells its limit."""
    rng = random.Random(2)
    word = lambda abc: "".join(rng.choice(abc) for _ in range(rng.randint(2, 8)))
    line = lambda n, abc: " ".join(word(abc) for _ in range(n)).capitalize()
    docs = [(i, line(rng.randint(20, 90), "abcdefgh") + ".", "s") for i in range(150)]
    docs += [(1000 + i, line(150, "abcdefgh")[:400], "s") for i in range(40)]
    docs += [(2000 + i, line(150, "abcdéü").encode()[:300].decode(errors="ignore"), "s") for i in range(40)]
    docs += [(3000, "The text stopped within a long sentence of wor", None)]
    seen, cut = T.find(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    found = {(r["encoding"], r["limit"]) for r in T.limits(seen).where("best").collect()}
    assert ("chars", 400) in found and any(e == "utf8" and 298 <= n <= 300 for e, n in found)
    rows = {r["doc_id"]: (r["encoding"], r["limit"]) for r in cut.collect()}
    assert rows[1003] == ("chars", 400) and rows[2003][0] == "utf8" and rows[3000] == (None, None)
