"""Edit distance and word forms shared by operators that compare names."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")

#: Digits that stand for letters in misread words.
DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "6": "b", "9": "g"})


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions (a metric)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    last_row: dict[str, int] = {}
    big = len(a) + len(b)
    table = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last_col, before = [big, i] + [0] * len(b), 0, table[i]
        for j, y in enumerate(b, 1):
            k = last_row.get(y, 0)
            same = x == y
            cost = min(before[j] + (not same), row[j] + 1, before[j + 1] + 1, table[k][last_col] + (i - k - 1) + 1 + (j - last_col - 1))
            if same:
                last_col = j
            row[j + 1] = cost
        table.append(row)
        last_row[x] = i
    return table[-1][-1]


def plain_words(value: str) -> list[str]:
    """Lower-case words without accents; digits inside words as the letters they stand for."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    plain = re.sub(r"(?<=[a-z])\.(?=[a-z]\b)\.?", "", plain)  # i.v. -> iv
    return [w.translate(DIGITS) if len(w) > 2 and any(c.isalpha() for c in w) and any(c.isdigit() for c in w) else w for w in _WORD.findall(plain)]


def nearest_name(value: str, names: dict[str, float]) -> str | None:
    """The name that ``value`` is or contains, else the nearest within one edit (two for names over five letters).

    ``names`` maps joined words to anything; names of up to three letters are only met exactly.
    """
    words = plain_words(value)
    joined = "".join(words)
    spans = sorted(((i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)), key=lambda s: -(s[1] - s[0]))
    for i, j in spans:
        for form in ("".join(words[i:j]), "".join(words[i:j]).removesuffix("s"), "".join(words[i:j][::-1])):
            if form in names:
                return form
    best: tuple[int, str] | None = None
    for form in {joined, *("".join(words[i:j]) for i, j in spans), "".join(words[::-1])}:
        for name in names:
            most = 0 if len(name) <= 3 else 1 if len(name) <= 5 else 2
            if most and abs(len(form) - len(name)) <= most and len(form) > 3 and (d := distance(form, name)) <= most:
                best = min(best or (d, name), (d, name))
    return best[1] if best else None
