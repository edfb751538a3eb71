"""Repairing text of scanned pages: page furniture, words divided at line ends, misread characters.

Counts of all words are gathered from all pages and stay a table. Distinct words are looked
up in tries of the vocabulary, intersected with a Levenshtein automaton so that every
candidate within the distance is met. Each block of pages is joined with the counts and
candidates of its own words; candidates are ranked by typical confusions of recognition and
by the neighbouring words. Furniture is
known by what stands at page edges all over the corpus, or again and again in the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.cluster import stored
from docquarry.functions.edit import distance

#: Pages on which a word must stand to be called in use.
LEAST_PAGES = 3
#: Pages of a block, which is read with the counts of its own words; words of one trie.
BLOCK, TRIE_WORDS = 1_000, 50_000
#: A word is taken for a misreading of a look-alike that is at least so many times as frequent (the longer the word, the surer).
RATIO = 40
#: The same for a misreading that is no look-alike.
EDIT_RATIO = 5 * RATIO


def ratio(word: str) -> int:
    return RATIO if len(word) <= 3 else RATIO // 2 if len(word) <= 6 else RATIO // 8


#: Lines looked at on either edge of a page (blank ones apart), and the longest line of a page with layout.
EDGE, WIDEST = 3, 130
#: Pages whose words are counted at once.
AT_ONCE = 1_000
#: States of automata that step through the trie at once.
FRONT = 8_192
#: Words of a running header or footer at most (spaced letters apart).
HEADER_WORDS = 7

_WORD = re.compile(r"[^\W_]+(?:\|[^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:[|'’][^\W_]+)*(?:-[^\W_]+)*")
#: Dividing marks at a line end: those that may belong to a word, and those that never do.
_HARD, _SOFT = "-‐‑–", "¬\xad"
_MARKS = frozenset(_HARD + _SOFT)
_END = re.compile(rf"([^\W\d_]+)([{_HARD}{_SOFT}])\s*$")
_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")


def divided_end(line: str) -> re.Match | None:
    """The match of a dividing mark at the end of a line."""
    bare = line.rstrip()
    return _END.search(line, max(0, len(bare) - 60)) if bare[-1:] in _MARKS else None


_CODE = re.compile(r"\b[A-Z0-9]{2}[0-9OoIlSsZzBbg]{2}-[0-9OoIlSsZzBbg]{7}\b|\b[A-Z]{1,4}-[0-9OoIlSsZzBbg]{2,5}\b")
#: Letters that recognition puts for digits.
_AS_DIGIT = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9", "q": "9"})
_MIXED = re.compile(r"^(?=.*\d)(?=.*[A-Za-z|])[\dOolIZzSsBbGgq|]+$")
_LETTERS = frozenset("OlIZSB")
#: Digits that stand in words for letters.
_AS_LETTER = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "8": "b", "6": "b", "|": "l"})
#: Groups of letters that look like one letter, and letters that look alike.
_GROUPS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h"))
_LIKE = str.maketrans({"l": "i", "j": "i", "a": "o", "e": "c", "t": "f", "b": "h", "q": "g", "y": "v"})
#: Looks of the groups of letters, and the letters that may begin one.
_GROUP_LOOKS = {group: letter.translate(_LIKE) for group, letter in _GROUPS}
_OPENING = frozenset(group[0] for group, _ in _GROUPS)
#: Cost of an edit, in confusions: a candidate's cost is EDIT x edits + confusions.
EDIT = 64


@lru_cache(maxsize=200_000)
def looks_of(word: str) -> tuple[str, ...]:
    """The looks of a word, equal for words that recognition confuses; two where groups of letters overlap."""
    w = word.lower().translate(_AS_LETTER)
    out = []
    for groups in (_GROUPS, _GROUPS[::-1]):
        x = w
        for group, letter in groups:
            x = x.replace(group, letter)
        out.append(x.translate(_LIKE))
    return tuple(dict.fromkeys(out))


def look(word: str) -> str:
    return looks_of(word)[0]


def skeleton(line: str) -> str:
    """A line's looks, with codes and numbers made alike."""
    s = _CODE.sub(" § ", line.strip())
    out = []
    for t in re.findall(r"§|[^\W_]+|[^\w\s]", s):
        plain = t.translate(_AS_DIGIT)
        out.append("#" if plain.isdigit() and (any(c.isdigit() for c in t) or len(t) == 1 and t in "lO") else t if t == "§" or not t[0].isalnum() else look(t))
    return " ".join(out)


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def has_layout(lines: list[str]) -> bool:
    """Whether the lines were broken by page layout (running text of digital documents isn't)."""
    full = [len(x.rstrip()) for x in lines if x.strip()]
    return len(full) >= 4 and max(full) <= WIDEST and sum(n > 30 for n in full) >= 2


def edges(lines: list[str]) -> list[tuple[int, bool]]:
    """Index and whether at the top of the first and last lines that aren't blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    top = full[:EDGE]
    return [(i, True) for i in top] + [(i, False) for i in full[-EDGE:] if i not in top]


def running_words(lines: list[str]) -> Iterator[list[str]]:
    """Words of each line without those divided at line ends or cut by the page, as they stand."""
    skip_first = True
    full = [x for x in lines if x.strip()]
    for i, line in enumerate(full):
        words = _WORD.findall(line)
        divided = divided_end(line) is not None
        yield words[1 if skip_first else 0 : len(words) - 1 if divided or i == len(full) - 1 else len(words)]
        skip_first = divided


#: Stands between lines, so that no pair of words reaches over them.
_BREAK = "\n"


class Coded:
    """Words as numbers: ``ids`` of a flat list of words in the order given, and the distinct words in lower case ("#" for numbers)."""

    def __init__(self, flat: list[str]):
        coded = pa.array(flat, pa.string()).dictionary_encode()
        low = pa.array(["#" if w.isdigit() else w.lower() for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
        self.words = low.dictionary
        self.ids = low.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)

    def pairs(self) -> tuple[pa.Array, np.ndarray]:
        """Pairs of words next to each other in a line, and their counts."""
        n, a, b = len(self.words), self.ids[:-1], self.ids[1:]
        stop = pc.index(self.words, _BREAK).as_py()
        inside = (a != stop) & (b != stop)
        keys, counts = np.unique(a[inside] * n + b[inside], return_counts=True)
        return pc.binary_join_element_wise(self.words.take(pa.array(keys // n)), self.words.take(pa.array(keys % n)), " "), counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (by page), compounds, pairs of words, and looks of lines at edges and elsewhere, for some pages at a time."""
    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        flat, sizes, rest = [], [], Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            lines, before = lines_of(text), len(flat)
            for words in running_words(lines):
                flat += words
                flat.append(_BREAK)
            sizes.append(len(flat) - before)
            for line in filter(lambda x: "-" in x, lines):
                for m in _COMPOUND.findall(line):
                    parts = m.lower().split("-")
                    for a, b in zip(parts, parts[1:], strict=False):
                        rest["h", f"{a}-{b}"] += 1
                        rest["p", a] += 1
            if has_layout(lines):
                at = {i for i, _ in edges(lines)}
                for i, line in enumerate(lines):
                    if line.strip() and len(line) <= 80 and len(line.split()) <= HEADER_WORDS:
                        s = skeleton(line)
                        for form in {s, "* " + s.partition(" ")[2]}:
                            rest["e" if i in at else "y", form] += 1
        if not flat:
            continue
        coded = Coded(flat)
        n = len(coded.words)
        by_page = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.ids) % n
        pages = np.bincount(by_page, minlength=n)
        held = np.flatnonzero((pages > 0) & pc.and_(pc.less_equal(pc.utf8_length(coded.words), 40), pc.not_equal(coded.words, _BREAK)).to_numpy(zero_copy_only=False))
        pairs, counts = coded.pairs()
        kinds = pa.array(["w"] * len(held) + ["b"] * len(pairs) + [k[0] for k in rest], pa.string())
        keys = pa.concat_arrays([coded.words.take(pa.array(held)), pairs, pa.array([k[1] for k in rest], pa.string())])
        numbers = pa.array(np.concatenate([pages[held], counts, np.fromiter(rest.values(), np.int64, len(rest))]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([kinds, keys, numbers], names=["kind", "key", "n"])


def _alike(c: str) -> int:
    """Code of what a character looks like."""
    return ord(c.translate(_AS_LETTER).translate(_LIKE))


class Trie:
    """Words in a trie, held as arrays; ``near`` intersects it with the Levenshtein automata of many words at once.

    The automaton knows confusions: its state is the row of costs with that before it, as a
    group of two letters may stand for one on either side. Words of one length step through
    the trie together, level by level; a branch is left where its row can't come back
    within the bound, so every entry within it is met.
    """

    def __init__(self, words: Iterator[str]):
        self.words = sorted(set(words))
        chars, parents, entry, path, before = [""], [0], [-1], [0], ""
        for n, w in enumerate(self.words):
            common = next((i for i, (a, b) in enumerate(zip(w, before, strict=False)) if a != b), min(len(w), len(before)))
            del path[common + 1 :]
            for c in w[common:]:
                chars.append(c), parents.append(path[-1]), entry.append(-1)
                path.append(len(chars) - 1)
            entry[path[-1]], before = n, w
        parent = np.array(parents[1:], np.int64)
        order = np.argsort(parent, kind="stable")  # children of a node side by side
        self.child = order + 1
        self.first = np.searchsorted(parent[order], np.arange(len(chars)))
        self.count = np.bincount(parent, minlength=len(chars)) if len(parent) else np.zeros(len(chars), np.int64)
        self.entry = np.array(entry, np.int64)
        self.code = np.array([ord(c) if c else 0 for c in chars], np.int32)
        self.like = np.array([_alike(c) if c else 0 for c in chars], np.int32)
        self.opens = np.array([c in _OPENING for c in chars], bool)
        self.group = np.array([-1] + [ord(g) if parents[i] and (g := _GROUP_LOOKS.get(chars[parents[i]] + chars[i])) else -1 for i in range(1, len(chars))], np.int32)

    def near(self, words: list[str], edits: int, at_once: int = 512) -> Iterator[tuple[int, str, str]]:
        """Cost, word and entry within ``edits`` edits and any confusions of recognition (fewer than EDIT) of each word."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            for at in range(0, len(own), at_once):
                yield from self._step(own[at : at + at_once], length, edits)

    def _step(self, words: list[str], length: int, edits: int) -> Iterator[tuple[int, str, str]]:
        most, far = EDIT * edits + EDIT - 1, np.int16(16_000)
        plain = [w.translate(_AS_LETTER) for w in words]
        code = np.array([[ord(c) for c in w] for w in words], np.int32).T
        like = np.array([[ord(c) for c in w.translate(_LIKE)] for w in plain], np.int32).T
        group = np.array([[-1, -1, *(ord(_GROUP_LOOKS[w[j - 2 : j]]) if w[j - 2 : j] in _GROUP_LOOKS else -1 for j in range(2, length + 1))] for w in plain], np.int32).T
        q, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        row = np.repeat((EDIT * np.arange(length + 1, dtype=np.int16))[:, None], len(words), axis=1)
        waiting = [(q, node, row, np.full_like(row, far))]
        while waiting:
            q, node, row, last = waiting.pop()
            times = self.count[node]
            rep = np.repeat(np.arange(len(q)), times)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
            child = self.child[self.first[node][rep] + step] if len(rep) else np.zeros(0, np.int64)
            q, old, older = q[rep], row[:, rep], last[:, rep]
            c, alike, own_group = self.code[child], self.like[child], self.group[child]
            new = np.empty_like(old)
            new[0] = old[0] + EDIT
            for j in range(1, length + 1):
                looks = like[j - 1][q]
                cost = old[j - 1] + np.where(code[j - 1][q] == c, 0, np.where(looks == alike, 1, EDIT)).astype(np.int16)
                cost = np.minimum(np.minimum(cost, old[j] + EDIT), new[j - 1] + EDIT)
                if j > 1:
                    cost = np.where(group[j][q] == alike, np.minimum(cost, old[j - 2] + 1), cost)
                new[j] = np.where(own_group == looks, np.minimum(cost, older[j - 1] + 1), cost)
            ends = np.flatnonzero((self.entry[child] >= 0) & (new[length] <= most))
            for cost, i, e in zip(new[length][ends].tolist(), q[ends].tolist(), self.entry[child[ends]].tolist(), strict=True):
                yield cost, words[i], self.words[e]
            keep = np.flatnonzero((new.min(axis=0) <= most) | (self.opens[child] & (old.min(axis=0) < most)))
            # a wide front is taken in pieces, so that memory stays small
            waiting += [(q[k], child[k], new[:, k], old[:, k]) for k in np.array_split(keep, -(-len(keep) // FRONT))] if len(keep) else []


@dataclass
class Furniture:
    """Looks of lines that stand only at page edges; bounded, as each is on a share of all pages."""

    furniture: frozenset[str]
    by_parts: dict[int, list[str]] = field(default_factory=dict)
    cache: dict[str, bool] = field(default_factory=dict)

    def prepare(self) -> Furniture:
        if not self.by_parts:
            for f in sorted(self.furniture):
                self.by_parts.setdefault(f.count(" "), []).append(f)
        return self

    def near_furniture(self, *forms: str) -> bool:
        """Whether a line's looks are within a tenth of its length of lines known as furniture (misread beyond look-alikes)."""
        for f in forms:
            if f not in self.cache:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                most, parts = min(4, len(f) // 8), f.count(" ")
                near = (x for x in self.by_parts.get(parts, ()) if abs(len(f) - len(x)) <= most and (x[:1] == f[:1] or x[-3:] == f[-3:]) and (x[:1] == "*") == (f[:1] == "*"))
                self.cache[f] = any(distance(f, x) <= most for x in near)
            if self.cache[f]:
                return True
        return False


@dataclass
class Vocabulary:
    """What a block of pages needs of the corpus' counts: words by pages with their candidates, pairs, compounds."""

    words: dict[str, int]
    pairs: dict[str, int]
    compounds: dict[str, int]
    first_parts: dict[str, int]
    pages: int
    near: dict[str, list[tuple[int, str, int]]]
    plain: set[str] = field(default_factory=set)
    kinds: dict[str, int] = field(default_factory=dict)
    triples: dict[tuple, bool] = field(default_factory=dict)

    def count(self, word: str) -> int:
        return self.words.get(word, 0)

    def candidates(self, w: str) -> list[tuple[int, str, int]]:
        """Cost, word and pages of all that ``w`` may stand for: look-alikes, and for longer words those an edit apart that are frequent enough."""
        return self.near.get(w, [])

    def fits(self, before: str | None, word: str, after: str | None) -> int:
        """How often a word stands behind or before its neighbours."""
        return (self.pairs.get(f"{before} {word}", 0) if before else 0) + (self.pairs.get(f"{word} {after}", 0) if after else 0)

    def meant(self, word: str, part: bool = False, before: str | None = None, after: str | None = None) -> str | None:
        """The word that a misread one stands for, or none if nothing is near and frequent enough.

        Candidates are ranked by confusions and edits, pages and the neighbouring words.
        ``part``: it may be a part of a word, for which only look-alikes are considered.
        """
        w = word.lower()
        likely = [(cost, m, n) for cost, m, n in likely_mates(w, self.count(w), self.candidates(w)) if not (part and cost >= EDIT)]
        if not likely or not any(c.isalpha() for c in w):
            return None
        score = lambda cost, m, n: math.log2(n) + math.log2(1 + self.fits(before, m, after)) - 2 * (cost % EDIT) - 8 * (cost // EDIT)
        return max((score(cost, m, n), m) for cost, m, n in likely)[1]

    def by_context(self, before: str | None, word: str, after: str | None) -> str | None:
        """A look-alike in use of a word in use, which fits between its neighbours where the word itself never stands."""
        w = word.lower()
        mates = mates_in_use(self.count(w), self.candidates(w))
        if not mates:
            return None
        own, (best, mate) = self.fits(before, w, after), max((self.fits(before, m, after), m) for m in mates)
        return mate if best >= 20 and best >= RATIO * max(own, 0.5) else None

    def kind(self, token: str) -> int:
        """What can be found of a token (codes apart): 0 nothing, 1 a look-alike by its neighbours, 2 something else."""
        known = self.kinds.get(token)
        if known is None:
            w = token.lower()
            own, near = self.count(w), self.candidates(w)
            alone = not token.isdigit() and (_MIXED.match(token) or (len(token) == 1 and token in _LETTERS) or likely_mates(w, own, near) or _digit_inside(token, self))
            known = self.kinds[token] = 2 if alone else 1 if not token.isdigit() and mates_in_use(own, near) else 0
            if not known:
                self.plain.add(token)
        return known

    def any_open(self, tokens: list[str]) -> bool:
        """Whether anything may be found in a line of tokens: false for most lines, so these need no closer look."""
        if self.plain.issuperset(tokens):
            return False
        for n, token in enumerate(tokens):
            if token in self.plain or not (kind := self.kind(token)):
                continue
            if kind == 2:
                return True
            before, after = (_lower(tokens[n - 1]) if n else None), (_lower(tokens[n + 1]) if n + 1 < len(tokens) else None)
            triple = (before, token, after)
            if triple not in self.triples:
                # marks between the words may part it from a neighbour
                self.triples[triple] = any(self.by_context(x, token, y) is not None for x, y in ((before, after), (before, None), (None, after)))
            if self.triples[triple]:
                return True
        return False


def likely_mates(w: str, own: int, near: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The candidates so frequent that ``w`` is taken for a misreading (``own``: its pages)."""
    least = ratio(w) * max(own - 1, 0.5)  # its count elsewhere
    return [(cost, m, n) for cost, m, n in near if n >= least]


def mates_in_use(own: int, near: list[tuple[int, str, int]]) -> list[str]:
    """Look-alikes that are no misreadings of the word themselves."""
    return [m for cost, m, n in near if cost < EDIT and own < ratio(m) * max(n - 1, 0.5)]


def wants_context(w: str, own: int, near: list[tuple[int, str, int]]) -> bool:
    """Whether the neighbours decide what ``w`` stands for."""
    return len(likely_mates(w, own, near)) > 1 or bool(mates_in_use(own, near))


def edits_of(w: str) -> int:
    """Edits besides confusions: short words are an edit from other words."""
    return 1 if len(w) >= 6 and any(c.isalpha() for c in w) else 0


def possible(w: str, own: int, near: Iterator[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Of the words ``near`` to ``w`` the look-alikes, and those an edit apart that are EDIT_RATIO times as frequent.

    A prefix is an inflection or the part of a word.
    """
    return [(cost, m, n) for cost, m, n in near if m != w and (cost < EDIT or (n >= EDIT_RATIO * max(own - 1, 0.5) and len(m) >= 6 and not (m.startswith(w) or w.startswith(m))))]


#: Fixed value: lower-case Roman numerals of page numbers.
_ROMAN = re.compile(r"^(?=[ivxl])(x{0,3}|xl|l)(ix|iv|v?i{0,3})$")
_PAGED = re.compile(r"^(?:[-–—]\s*#\s*[-–—]|(?:page|p\s*\.?|pg\s*\.?)\s*#(?:\s*(?:of|/)\s*#)?|#\s*/\s*#|#\s*of\s*#|§\s*\.\s*#)$".replace("page", look("page")).replace("of", look("of")))


def _roman(s: str) -> int | None:
    if not s or not _ROMAN.match(s):
        return None
    values = {"i": 1, "v": 5, "x": 10, "l": 50}
    n = [values[c] for c in s]
    return sum(-a if b > a else a for a, b in zip(n, [*n[1:], 0], strict=True))


def bare_number(line: str) -> tuple[str, int] | None:
    """Style and value of a line that is a number alone."""
    s = line.strip()
    if re.fullmatch(r"[\dOolISZB]{1,4}", s) and any(c.isdigit() for c in s):
        plain = s.translate(_AS_DIGIT)
        return ("#", int(plain)) if plain.isdigit() else None
    r = _roman(s.replace("1", "i").replace("l", "i") if s.islower() or s == "1" else s)
    return ("i", r) if r else None


#: Form that marks a document broken into lines by page layout.
LAYOUT = "~"


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, page, form of each edge line: its skeleton, or style and offset of a bare number."""
    for batch in batches:
        docs, numbers, forms = [], [], []
        for doc, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = lines_of(text or "")
            if not has_layout(lines):
                continue
            docs.append(doc), numbers.append(page), forms.append(LAYOUT)
            for i, _ in edges(lines):
                number = bare_number(lines[i])
                if number:
                    form = f"{number[0]}{number[1] - (page or 0)}"
                else:
                    form = skeleton(lines[i])
                    if len(lines[i]) > 90 or not any(c.isalpha() for c in form):
                        continue
                docs.append(doc), numbers.append(page), forms.append(form)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(numbers, pa.int32()), pa.array(forms, pa.string())], names=["doc", "page", "form"])


def document_forms(pages: DataFrame) -> DataFrame:
    """doc and forms: what stands at the edges of at least a fifth, and at least two, of a document's pages.

    At most (2 x EDGE + 1) / 0.2 forms for each document.
    """
    rows = pages.select("doc", "page", "text").mapInArrow(_edge_rows, "doc string, page int, form string")
    n = pages.where("text is not null").groupBy("doc").agg(F.count("*").alias("n"))
    forms = rows.groupBy("doc", "form").agg(F.count("*").alias("held")).where("held >= 2").join(n, "doc").where(F.col("held") >= 0.2 * F.col("n"))
    return forms.groupBy("doc").agg(F.collect_set("form").alias("forms"))


def gather(pages: DataFrame) -> tuple[DataFrame, Furniture, int]:
    """Counts of all pages as a table (kind, key, n), furniture and the number of pages."""
    counts = stored(_spread(pages.select("text")).mapInArrow(_counted, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    n_pages = pages.where("text is not null").count()
    lines = counts.where("kind in ('e', 'y')").groupBy("key").agg(F.sum(F.when(F.col("kind") == "e", F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("kind") == "y", F.col("n")).otherwise(0)).alias("y"))
    often = max(LEAST_PAGES, 0.002 * n_pages)  # at most 2 x EDGE x 2 / 0.002 lines
    furniture = {r["key"] for r in lines.where((F.col("e") >= often) & (F.col("y") <= 0.05 * F.col("e"))).select("key").collect()}
    return counts, Furniture(frozenset(f for f in furniture if any(c.isalpha() or c == "§" for c in f))), n_pages


_MATES = "array<struct<cost:int,word:string,n:bigint>>"


def with_candidates(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """key, n, mates, contextual: the words ``wanted`` (key) with their true counts, candidates in ``vocabulary`` (key, n), and whether neighbours decide between these.

    Slices of the words meet parts of the vocabulary, so no task holds more than about
    TRIE_WORDS words, whatever the corpus.
    """
    slices = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 + vocabulary.count() // TRIE_WORDS
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = wanted.join(vocabulary, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    left = own.withColumn("slice", F.pmod(F.hash("key"), F.lit(slices))).withColumn("part", copies(parts))
    right = vocabulary.where("not key rlike '^[0-9]+$'").withColumn("part", F.pmod(F.hash("key"), F.lit(parts))).withColumn("slice", copies(slices))

    def look_up(words: pa.Table, entries: pa.Table) -> pa.Table:
        counts = dict(zip(entries["key"].to_pylist(), entries["n"].to_pylist(), strict=True))
        own = {w: n for w, n in zip(words["key"].to_pylist(), words["n"].to_pylist(), strict=True) if len(w) > 1}
        trie, rows = Trie(iter(counts)), []
        for edits in (0, 1):
            for cost, w, m in trie.near([w for w in own if edits_of(w) == edits], edits):
                rows += [(w, *mate) for mate in possible(w, own[w], [(cost, m, counts[m])])]
        types = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["key", "cost", "word", "k"])

    met = left.groupBy("slice", "part").cogroup(right.groupBy("slice", "part")).applyInArrow(look_up, "key string, cost int, word string, k bigint")
    mates = met.groupBy("key").agg(F.collect_list(F.struct("cost", "word", F.col("k").alias("n"))).alias("mates"))
    least = lambda w, n: F.when(F.length(w) <= 3, RATIO).when(F.length(w) <= 6, RATIO // 2).otherwise(RATIO // 8) * F.greatest(n - 1, F.lit(0.5))
    likely = F.size(F.filter("mates", lambda m: m["n"] >= least(F.col("key"), F.col("n")))) > 1
    in_use = F.exists("mates", lambda m: (m["cost"] < EDIT) & (F.col("n") < least(m["word"], m["n"])))
    return own.join(mates, "key", "left").withColumn("contextual", F.coalesce(likely | in_use, F.lit(False)))


@dataclass
class Line:
    """What was found of one line; ``words`` are its corrected words by place."""

    text: str
    furniture: bool = False
    divided: bool = False
    joins: bool = False
    garbled: bool = False
    fixes: list[tuple[int, int, str]] = field(default_factory=list)


def _stamp(line: str) -> bool:
    """Specks (no letters or digits) and stamps (a few capitals, perhaps spaced out, alone on a line)."""
    s = line.strip()
    if len(s) > 60:
        return False
    if len(s) >= 9 and s[1] == " " and all(len(t) == 1 for t in s.split()):
        s = "".join(s.split())
    if not any(c.isalnum() for c in s):
        return len(s) <= 20
    if s[-1] in ".:;,)%" or len(s.split()) > 5:  # most lines end here
        return False
    letters = [c for c in s if c.isalpha()]
    return len(letters) >= 4 and sum(c.isupper() or c == "l" for c in letters) >= 0.9 * len(letters) and not re.search(r"\d{2}", s)


def is_furniture(line: str, at_edge: bool, last: bool, alone: bool, page: int | None, forms: frozenset[str], v: Furniture) -> bool:
    """``alone``: the line before isn't a number too, as in a column of a table."""
    if _stamp(line):
        return True
    if not at_edge or len(line) > 90:
        return False
    number = bare_number(line)
    if number:
        if f"{number[0]}{number[1] - (page or 0)}" in forms:
            return True
        # documents of one page show no sequence
        return last and alone and (number[0] == "i" or number[1] < 1000) and not any(f[:1] in "#i" and f[1:].lstrip("-").isdigit() for f in forms)
    s = skeleton(line)
    short = len(line.split()) <= HEADER_WORDS and not re.search(r"[.;,-]\s*$", line)
    if _PAGED.match(s) or s in v.furniture or (s in forms and short):
        return True
    starred = "* " + s.partition(" ")[2]
    if starred in v.furniture and len(line.split()) >= 2:
        return True
    return short and len(line.split()) >= 2 and v.near_furniture(s, starred)


def _is_divided(head: str, mark: str, tail: str | None, v: Vocabulary) -> bool:
    """Whether the mark behind ``head`` only divides a word whose rest is ``tail`` (none if it isn't on the page)."""
    if mark in _SOFT:
        return True
    a, b = head.lower(), (tail or "").lower()
    if b and b[0].isalpha():
        joined, compound = v.count(a + b), v.compounds.get(f"{a}-{b}", 0)
        if joined or compound:
            return joined >= compound
        if any(cost < EDIT and n >= LEAST_PAGES for cost, _, n in v.candidates(a + b)):
            return True
        if v.meant(a + b):
            return True
    elif b:
        return False  # a number follows
    if v.first_parts.get(a, 0) >= LEAST_PAGES:
        return False
    if b:
        return not (v.count(a) >= 10 * LEAST_PAGES and v.count(b) >= 10 * LEAST_PAGES)
    return True


def _misread_number(token: str, before: str | None, v: Vocabulary) -> str | None:
    if _MIXED.match(token):
        if v.count(token.lower()) * RATIO > v.pages:
            return None
        return token.translate(_AS_DIGIT)
    if len(token) == 1 and token in _LETTERS and before:
        number, own = v.pairs.get(f"{before} #", 0), v.pairs.get(f"{before} {token.lower()}", 0)
        if number >= 20 and number >= RATIO * max(own, 0.5):
            return token.translate(_AS_DIGIT)
    return None


def _digit_inside(token: str, v: Vocabulary) -> str | None:
    """A word with a digit for a letter whose right form isn't in use (a name)."""
    if re.fullmatch(r"[A-Za-z]{2,}[01569]+[a-z]{2,}|[A-Za-z]{4,}[01569]", token) and v.count(token.lower()) < LEAST_PAGES:
        return token.lower().translate(_AS_LETTER)
    return None


def _case(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def furniture_of(text: str | None, page: int | None, forms: frozenset[str], v: Furniture) -> tuple[bool, list[int]]:
    """Whether a page has layout, and the indexes of its lines that are furniture."""
    lines = lines_of(text) if text else []
    if not (LAYOUT in forms or has_layout(lines)):
        return False, []
    at = {i for i, _ in edges(lines)}
    full = [i for i, x in enumerate(lines) if x.strip()]
    alone = lambda n: n == 0 or not re.fullmatch(r"[\d\s.,]+", lines[full[n - 1]])
    return True, [i for n, i in enumerate(full) if is_furniture(lines[i], i in at, i == full[-1], alone(n), page, forms, v)]


def _body(lines: list[str], furniture: list[int]) -> list[int]:
    hidden = set(furniture)
    return [i for i, x in enumerate(lines) if x.strip() and i not in hidden]


def _tail(after: str | None) -> str | None:
    """The word with which the line behind a divided word begins."""
    following = _WORD.search(after) if after else None
    return following[0] if following and not after[: following.start()].strip() else None


def needed(text: str | None, layout: bool, furniture: list[int]) -> tuple[set[str], set[str]]:
    """Words in lower case, and the other keys behind the letter of their kind, that :func:`read_page` may ask for, but for pairs."""
    lines = lines_of(text) if text else []
    body, words, keys = _body(lines, furniture), set(), set()
    for k, i in enumerate(body):
        own = _WORD.findall(lines[i])
        words.update(own)
        if layout and (m := divided_end(lines[i])):
            a, after = m[1].lower(), lines[body[k + 1]] if k + 1 < len(body) else None
            words.add(a), keys.add(f"p{a}")
            if tail := _tail(after):
                b = tail.lower()
                words |= {b, a + b}
                keys.add(f"h{a}-{b}")
            if own and after and (first := _WORD.search(after)):
                words.add(own[-1] + first[0])
    return {w.lower() for w in words if not w.isdigit()}, keys


class Sieve:
    """A Bloom filter of fixed size over words: it may let others through, but loses none."""

    BITS = 1 << 24

    def __init__(self, cells: dict[int, int]):
        self.cells = np.zeros(self.BITS // 32, np.int64)
        if cells:
            self.cells[np.fromiter(cells, np.int64, len(cells))] = np.fromiter(cells.values(), np.int64, len(cells))
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, words: DataFrame) -> Sieve:
        """The filter of the column ``key``; it is made of at most BITS / 32 cells, however many words there are."""
        h = F.xxhash64("key")
        places = F.explode(F.array(F.pmod(h, F.lit(cls.BITS)), F.pmod(F.shiftright(h, 30), F.lit(cls.BITS))))
        cells = words.select(places.alias("p")).groupBy(F.shiftright("p", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(p, 32)))")).alias("bits")).toArrow()
        return cls(dict(zip(cells["cell"].to_pylist(), cells["bits"].to_pylist(), strict=True)))

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        h -= (h >> 63) << 64  # as the engine's signed hash
        return all(self.cells[p >> 5] >> (p & 31) & 1 for p in (h % self.BITS, (h >> 30) % self.BITS))

    def kind(self, token: str) -> int:
        """Of a token as it stands: 0 if neighbours don't matter, 1 if they may, 2 for a letter that may be a digit."""
        found = self.known.get(token)
        if found is None:
            found = self.known[token] = 2 if token in _LETTERS else int(not token.isdigit() and token.lower() in self)
        return found


def needed_pairs(text: str | None, furniture: list[int], contextual: Sieve) -> set[str]:
    """The pairs of words beside each other that :func:`read_page` may ask for: those of words for which neighbours matter."""
    lines, keys, known = lines_of(text) if text else [], set(), contextual.known
    for i in _body(lines, furniture):
        words = _WORD.findall(lines[i])
        for n, token in enumerate(words):
            kind = known.get(token)
            if not (contextual.kind(token) if kind is None else kind):
                continue
            w = token.lower()
            if n:
                keys.add(f"{_lower(words[n - 1])} {w}")
                if contextual.kind(token) == 2:
                    keys.add(f"{_lower(words[n - 1])} #")
            if n + 1 < len(words):
                keys.add(f"{w} {_lower(words[n + 1])}")
    return keys


def read_page(text: str | None, layout: bool, furniture: list[int], v: Vocabulary) -> list[Line]:
    """The lines of one page with what was found of each. Null and empty texts have none; blank lines nothing."""
    if text is None or text == "":
        return []
    out = [Line(x) for x in lines_of(text)]
    for i in furniture:
        out[i].furniture = True
    body = _body([x.text for x in out], furniture)
    carried: tuple[int, str] | None = None  # line and first part of a divided word
    for k, i in enumerate(body):
        line = out[i]
        after = out[body[k + 1]].text if k + 1 < len(body) else None
        tokens = _WORD.findall(line.text)
        coded = "-" in line.text and _CODE.search(line.text) is not None
        if layout and (m := divided_end(line.text)):
            line.divided = _is_divided(m[1], m[2], _tail(after), v)
        first = 0
        if carried is not None:
            j, head = carried
            if tokens:
                word = head + tokens[0]
                if fix := v.meant(word):
                    # the line where the parts differ from the word meant
                    if not _same_start(fix, head):
                        out[j].garbled = True
                        out[j].fixes.append((-1, -1, fix))
                    if not _same_end(fix, tokens[0]):
                        line.garbled = True
                    if out[j].garbled or line.garbled:
                        out[j].fixes.append((-1, -1, fix))
                first = 1
            carried = None
        if line.divided and tokens:
            carried = (i, tokens[-1])
        if not coded and not v.any_open(tokens):
            continue
        spans = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(line.text)]
        inner = spans[first : len(spans) - 1 if line.divided else len(spans)]
        codes = [m.span() for m in _CODE.finditer(line.text)] if coded else []
        for n, (a, b, token) in enumerate(inner):
            if token.isdigit():
                continue
            inside = next((c for c in codes if c[0] <= a and b <= c[1]), None) if codes else None
            if not inside and not v.kind(token):
                continue
            if inside:  # of a code only the digits can be judged
                fix = token.translate(_AS_DIGIT) if a > inside[0] and any(c.isdigit() for c in token) else None
            else:
                before = _lower(inner[n - 1][2]) if n and line.text[inner[n - 1][1] : a].strip() in ("", "(") else None
                behind = _lower(inner[n + 1][2]) if n + 1 < len(inner) and not line.text[b : inner[n + 1][0]].strip() else None
                # a page may begin or end inside a word, which then isn't looked up among near words
                outer = (k == 0 and n == 0) or (k == len(body) - 1 and n == len(inner) - 1)
                fix = _misread_number(token, before, v) or v.meant(token, outer, before, behind) or v.by_context(before, token, behind) or _digit_inside(token, v)
            if fix is not None and fix != token.lower():
                line.garbled = True
                line.fixes.append((a, b, _case(token, fix)))
    return out


def _lower(token: str) -> str:
    return "#" if token.isdigit() else token.lower()


def _same_start(word: str, head: str) -> bool:
    return word.startswith(head.lower())


def _same_end(word: str, tail: str) -> bool:
    return word.endswith(tail.lower())


def _pages(df: DataFrame, doc: str, page: str, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("page_id"), F.col(doc).cast("string").alias("doc"), F.col(page).cast("int").alias("page"), F.col(text).cast("string").alias("text"))


def _spread(df: DataFrame) -> DataFrame:
    """Rows in even partitions, as many as a shuffle has: files and joins may leave the work to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _read(pages: DataFrame, schema: str, emit) -> DataFrame:
    """Run ``emit`` over the lines of every page, in blocks joined with the counts that their pages need."""
    counts, furniture, n_pages = gather(pages)
    sent = pages.sparkSession.sparkContext.broadcast(furniture)  # bounded, see gather
    joined = _spread(pages.join(document_forms(pages), "doc", "left").select("page_id", "doc", "page", "text", "forms"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value.prepare()
        for batch in batches:
            found = [furniture_of(t, n, frozenset(f or ()), v) for n, t, f in zip(*(batch.column(c).to_pylist() for c in ("page", "text", "forms")), strict=True)]
            asked = [needed(t, *x) for t, x in zip(batch.column("text").to_pylist(), found, strict=True)]
            lists = [pa.array([sorted(x[i]) for x in asked], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.list_(pa.int32())), *lists], names=["page_id", "doc", "page", "text", "layout", "furniture", "words", "keys"])

    noted = joined.mapInArrow(mark, "page_id bigint, doc string, page int, text string, layout boolean, furniture array<int>, words array<string>, keys array<string>")
    blocks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pages // BLOCK)
    noted = stored(noted.withColumn("block", F.pmod(F.xxhash64("page_id", "doc", "page"), F.lit(blocks)).cast("int")), "marked")
    marked = noted.drop("words", "keys")
    distinct = lambda column: noted.select("block", F.explode(column).alias("key")).distinct()
    other = distinct("keys").select("block", F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 2)").alias("key"))
    asked = stored(distinct("words").select("block", F.lit("w").alias("kind"), "key").unionByName(other), "asked")
    words = stored(with_candidates(asked.where("kind = 'w'").select("key").distinct(), counts.where("kind = 'w'").select("key", "n")), "words")
    # pairs are asked for where neighbours decide: those of the words, and of the candidates in their place
    contextual = pages.sparkSession.sparkContext.broadcast(Sieve.of(words.where("contextual").select("key")))  # of fixed size

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = contextual.value
        for batch in batches:
            keys = {(block, key) for block, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for key in needed_pairs(t, f, sieve)}
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string()))], names=["block", "key"])

    asked_pairs = stored(marked.select("block", "text", "furniture").mapInArrow(ask_pairs, "block int, key string").distinct(), "pairs")
    pairs = asked_pairs.select("block", F.substring_index("key", " ", 1).alias("a"), F.substring_index("key", " ", -1).alias("b"))
    mates = words.where("contextual").select("key", F.explode("mates.word").alias("mate"))
    behind = pairs.join(mates, F.col("b") == F.col("key")).select("block", F.concat_ws(" ", "a", "mate").alias("key"))
    before = pairs.join(mates, F.col("a") == F.col("key")).select("block", F.concat_ws(" ", "mate", "b").alias("key"))
    every = asked.where("kind <> 'w'").unionByName(asked_pairs.unionByName(behind).unionByName(before).select("block", F.lit("b").alias("kind"), "key")).distinct()
    facts = every.join(counts, ["kind", "key"]).select("block", "kind", "key", "n", F.lit(None).cast(_MATES).alias("mates"))
    facts = facts.unionByName(asked.where("kind = 'w'").join(words, "key").select("block", "kind", "key", "n", "mates"))

    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        by: dict = {k: {} for k in "wbhp"}
        near = {}
        for kind, key, n, mates in zip(*(facts[c].to_pylist() for c in ("kind", "key", "n", "mates")), strict=True):
            by[kind][key] = n
            if mates:
                near[key] = [(m["cost"], m["word"], m["n"]) for m in mates]
        v = Vocabulary(by["w"], by["b"], by["h"], by["p"], n_pages, near)
        columns = zip(*(rows[c].to_pylist() for c in ("page_id", "doc", "page", "text", "layout", "furniture")), strict=True)
        return pa.Table.from_batches([emit((p, d, n, read_page(t, y, f, v)) for p, d, n, t, y, f in columns)])

    return marked.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(run, schema)


def line_kinds(df: DataFrame, doc: str = "source_document_id", page: str = "page_number", key: str = "id", text: str = "text") -> DataFrame:
    """page_id, line_no, kind of the lines that are ``furniture``, or hold a ``break`` or a ``garble``; once per page.

    Lines are those between "\\n", counted from 1. Pages without layout (digital ones) have
    no furniture and no breaks. Null and empty texts have no rows.
    """

    def emit(pages) -> pa.RecordBatch:
        ids, numbers, kinds = [], [], []
        for page_id, _, _, lines in pages:
            for n, line in enumerate(lines, 1):
                for kind, is_so in (("furniture", line.furniture), ("break", line.divided and not line.furniture), ("garble", line.garbled and not line.furniture)):
                    if is_so:
                        ids.append(page_id), numbers.append(n), kinds.append(kind)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["page_id", "line_no", "kind"])

    return _read(_pages(df, doc, page, key, text), "page_id bigint, line_no int, kind string", emit).distinct()


def flow(lines: list[Line]) -> list[tuple[str, bool, bool]]:
    """Paragraphs of one page: text, whether it seems to continue the one before, and whether its last word is divided."""
    paragraphs: list[str] = []
    gap, divided = True, False
    for line in lines:
        if line.furniture:
            continue
        text = line.text
        if not text.strip():
            gap = True
            continue
        for a, b, word in sorted((f for f in line.fixes if f[0] >= 0), reverse=True):
            text = text[:a] + word + text[b:]
        text = text.rstrip()
        new = (gap or text[:3] == "   ") and not divided
        text = text.strip()
        if line.divided:
            text = text[:-1]
        if new or not paragraphs:
            paragraphs.append(text)
        else:
            paragraphs[-1] += ("" if divided else " ") + text
        gap, divided = False, line.divided
    return [(p, i == 0 and not re.match(r"[A-Z0-9(\"“•|-]", p), i == len(paragraphs) - 1 and divided) for i, p in enumerate(paragraphs)]


def paragraphs(df: DataFrame, doc: str = "source_document_id", page: str = "page_number", key: str = "id", text: str = "text") -> DataFrame:
    """source_document_id, paragraph_no, first_page, last_page, text: the repaired running text of each document.

    A paragraph that a page break divides is put together again: where the page before ends
    inside a word or a sentence, or the next begins in lower case.
    """

    def emit(pages) -> pa.RecordBatch:
        rows = [(p, d, n, i, t, c, e) for p, d, n, lines in pages for i, (t, c, e) in enumerate(flow(lines))]
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        names = ["page_id", "doc", "page", "at", "text", "continues", "divided"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    parts = _read(_pages(df, doc, page, key, text), "page_id bigint, doc string, page int, at int, text string, continues boolean, divided boolean", emit)
    parts = stored(parts.dropDuplicates(["page_id", "at"]), "paragraphs")
    w = W.partitionBy("doc").orderBy("page", "page_id", "at")
    open_ = ~F.coalesce(F.lag(F.col("text")).over(w), F.lit(".")).rlike(r"[.!?:。)\]|]\s*$")
    narrow = parts.select("page_id", "doc", "page", "at", "continues", (F.coalesce(F.lag("divided").over(w), F.lit(False)) & F.col("continues")).alias("after"), open_.alias("open"))
    starts = narrow.withColumn("number", F.sum(F.when(((F.col("at") == 0) & (F.col("continues") | F.col("after") | F.col("open"))), 0).otherwise(1)).over(w))
    ordered = parts.join(starts.select("page_id", "at", "number", "after"), ["page_id", "at"])
    piece = F.struct("page", "page_id", "at", F.when(F.col("after"), F.lit("")).otherwise(F.lit(" ")).alias("gap"), "text")
    pieces = ordered.groupBy("doc", "number").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return pieces.select(F.col("doc").alias("source_document_id"), F.greatest(F.col("number"), F.lit(1)).cast("int").alias("paragraph_no"), "first_page", "last_page", F.trim(F.array_join(F.transform("p", lambda x: F.concat(x["gap"], x["text"])), "")).alias("text"))
