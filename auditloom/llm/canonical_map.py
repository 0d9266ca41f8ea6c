"""Mapping free-entered values to a canonical list: a multi-pattern automaton, then token-set similarity.

The automaton holds the folded names and their aliases (vowel-less and shortened forms, made by rule from the name's
words). All mentions embedded in a value are found in one pass; the longest mentions that do not overlap count, and the
entry of the longest wins. What has no mention goes to a similarity of word sets in which words compare by edit distance
(insertions, deletions, replacements and swaps of neighbours). Work is done once for each distinct value.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import column, is_null_cell

_SPLIT = re.compile(r"[\W_]+")

# Usual short forms of words in names of places and in statuses.
SHORT_FORMS = {
    "saint": ("st",), "mount": ("mt", "mnt"), "port": ("pt", "prt"), "fort": ("ft", "frt"), "north": ("n", "nth"),
    "south": ("s", "sth"), "east": ("e",), "west": ("w",), "upper": ("u", "upr", "uppr"), "lower": ("l", "lwr", "lwer"),
    "heights": ("hts", "hgts", "hghts"), "central": ("ctrl", "cntrl", "cent"), "park": ("pk", "prk"),
    "gardens": ("gdns", "gdn", "gard"), "bridge": ("br", "brg", "brdg"), "green": ("grn", "gn"), "hill": ("hl",),
    "cross": ("x", "crs"), "gate": ("gt",), "quay": ("qy",), "row": ("rw",), "vale": ("vl",), "end": ("nd",),
    "documents": ("docs", "doc", "docts"), "awaiting": ("awtg", "await", "aw"), "review": ("rvw", "rev"),
    "under": ("undr", "u"), "transferred": ("trans", "transf", "transfd", "xferred", "xfer", "xferd", "tfr", "trfd"),
    "registered": ("regd", "reg", "regist", "rgd"), "withdrawn": ("wdrawn", "wdrn", "wdn", "withd"),
    "suspended": ("susp", "suspd", "sus"), "reinstated": ("reinst", "reinstd", "rein"), "lapsed": ("lpsd", "laps"),
    "out": ("o",), "harbour": ("hbr", "hrbr"),
}


def folded(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isalnum())


def words_of(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text.lower().replace("'", "").replace("’", "")) if w]


def skeleton(word: str) -> str:
    """The word's first letter and then its consonants."""
    return word[:1] + "".join(ch for ch in word[1:] if ch not in "aeiou")


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < cost:
                cost = before[j - 2] + 1
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def letters(word: str) -> int:
    """The letters of a word as bits. A letter of one word that the other lacks takes an edit."""
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) & 63)
    return bits


class CanonicalList:
    """The entries of one field, ready to match values; holds one automaton."""

    #: Share of an entry's letters that may be wrong, and the least similarity of word sets.
    WRONG, LEAST = 0.25, 0.8
    #: Shortest folded alias looked for inside other text; shorter ones count only as the whole value.
    EMBEDDED = 6

    def __init__(self, entries: list[tuple[str, str]]):
        self.names: dict[str, str] = {}
        for code, name in entries:
            self.names.setdefault(code, name)
        self.entries = [(code, folded(name), words_of(name)) for code, name in self.names.items()]
        whole: dict[str, set[str]] = defaultdict(set)
        for code, name, words in self.entries:
            whole[name].add(code)
            for variant in self._aliases(words):
                whole[variant].add(code)
        for code, *_ in self.entries:
            whole[folded(code)] = {code}
        for code, name, _ in self.entries:
            whole[name] = {code}
        self.whole = {alias: next(iter(codes)) for alias, codes in whole.items() if len(codes) == 1 and alias}
        self.automaton = ahocorasick.Automaton()
        for alias, code in self.whole.items():
            if len(alias) >= self.EMBEDDED:
                self.automaton.add_word(alias, (len(alias), code))
        self.searchable = len(self.automaton) > 0
        if self.searchable:
            self.automaton.make_automaton()
        #: (name, its letters, wrong letters allowed of the whole and of a run of words) of each entry.
        self.shapes = [(name, letters(name), self._wrong(name), 1 if len(name) < 9 else 2) for _, name, _ in self.entries]
        self.own_words = sorted({w for _, _, own in self.entries if len(own) > 1 for w in own})
        self.word_shapes = [(w, letters(w), self._wrong(w), skeleton(w), SHORT_FORMS.get(w, ())) for w in self.own_words]
        self.near_words: dict[str, dict[str, float]] = {}

    @staticmethod
    def _aliases(words: list[str]) -> set[str]:
        """Every combination of the words and their short forms. Those of longer names would be too many; such names are
        matched word by word, where short forms count just as well."""
        if not words or len(words) > 5:
            return set()
        forms = [{w, skeleton(w), *SHORT_FORMS.get(w, ())} for w in words]
        return {"".join(p) for p in product(*forms)} - {""}

    @classmethod
    def _wrong(cls, name: str) -> int:
        return max(1, round(cls.WRONG * len(name)))

    def _mention(self, text: str) -> str | None:
        """The entry of the longest of the non-overlapping mentions; none if two entries tie for it."""
        if not self.searchable:
            return None
        found = sorted(((length, end - length + 1, code) for end, (length, code) in self.automaton.iter(text)), key=lambda m: (-m[0], m[1]))
        taken: list[tuple[int, int, str]] = []
        for length, start, code in found:
            if all(start >= s + n or start + length <= s for n, s, _ in taken):
                taken.append((length, start, code))
        best = {code for length, _, code in taken if length == taken[0][0]}
        return best.pop() if len(best) == 1 else None

    def _shortened(self, text: str) -> str | None:
        """The only entry that begins with the text, for texts of four letters and more."""
        if len(text) < 4:
            return None
        hits = [code for code, name, _ in self.entries if name.startswith(text)]
        return hits[0] if len(hits) == 1 else None

    def _similar(self, value: str, text: str) -> str | None:
        """The entry most similar to the value, of all entries; none if two tie or the best is not similar enough."""
        words = words_of(value)
        runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + 4, len(words)) + 1)}
        shapes = [(r, letters(r)) for r in runs]
        near: dict[str, float] = {}
        for v in set(words):
            for w, right in self._near_words(v).items():
                near[w] = max(near.get(w, 0.0), right)
        bits = letters(text)
        best, second, code = 0.0, 0.0, None
        for (name, mine, most, least), (own_code, _, own) in zip(self.shapes, self.entries, strict=True):
            score = max(
                self._share(text, bits, name, mine, most),
                max((self._share(r, rb, name, mine, least) for r, rb in shapes if abs(len(r) - len(name)) <= least), default=0.0),
                self._word_set(near, own),
                self._anchored(text, bits, name, mine),
            )
            if score > best:
                best, second, code = score, best, own_code
            elif score > second:
                second = score
        return None if best < 1 - self.WRONG - 0.09 or second == best else code

    @staticmethod
    def _share(text: str, bits: int, name: str, mine: int, most: int) -> float:
        """Share of the name's letters that are right, or 0 if more than ``most`` edits part the two."""
        if abs(len(text) - len(name)) > most or (bits & ~mine).bit_count() > most or (mine & ~bits).bit_count() > most:
            return 0.0
        d = edits(text, name, most)
        return 1 - d / len(name) if d <= most else 0.0

    def _near_words(self, v: str) -> dict[str, float]:
        """The words of entries that a word of a value may stand for, with the number of letters that are right; kept for
        the values that follow, as values share their words."""
        found = self.near_words.get(v)
        if found is None:
            bits, found = letters(v), {}
            for w, mine, most, bare, shorts in self.word_shapes:
                if v in shorts or (len(v) >= 3 and (v == bare or w.startswith(v))):
                    found[w] = 0.9 * len(w)
                elif right := self._share(v, bits, w, mine, most):
                    found[w] = right * len(w)
            if len(self.near_words) < 200_000:
                self.near_words[v] = found
        return found

    def _word_set(self, near: dict[str, float], own: list[str]) -> float:
        """Share of the entry's letters found in the value's words, for entries of several words."""
        if len(own) < 2:
            return 0.0
        share = sum(near.get(w, 0.0) for w in own) / sum(map(len, own))
        return share if share >= self.LEAST else 0.0

    @staticmethod
    def _anchored(text: str, bits: int, name: str, mine: int) -> float:
        """Similarity with what the text begins or ends with, for values without usable breaks between words."""
        if len(text) <= len(name) or len(name) < 8:
            return 0.0
        most = 1 if len(name) < 10 else 2
        if (mine & ~bits).bit_count() > most:
            return 0.0
        d = min(edits(part, name, most) for n in range(len(name) - 1, len(name) + 2) for part in (text[:n], text[-n:]))
        return 1 - d / len(name) if d <= most else 0.0

    def holds(self, value: str) -> bool:
        """Whether a value plainly is one of the entries: named, mentioned, shortened or mistyped, without word sets."""
        text = folded(value)
        if text in self.whole or self._mention(text) or self._shortened(text):
            return True
        bits = letters(text)
        return any(self._share(text, bits, name, mine, most) for name, mine, most, _ in self.shapes)

    def match(self, value: str) -> str | None:
        """Code of the entry that a value means, or None."""
        text = folded(value)
        if not text:
            return None
        return self.whole.get(text) or self._mention(text) or self._shortened(text) or self._similar(value, text)


def canonical_codes(df: DataFrame, row: str, fields: dict[str, list[tuple[str, str]]], unmatched: str = "none") -> DataFrame:
    """(row_id, field, code) of every cell that is no null cell and not exactly a name of its field's list.

    ``fields`` maps a column to its (code, name) entries, a list small enough to be part of the plan. Distinct values
    are counted out first, so each is matched once however often it is typed; the codes are joined back to the rows by
    value. Values that mean no entry, or two equally, get ``unmatched``. Rows of an empty table give none; an empty list
    leaves every value unmatched; very long values are matched whole.
    """
    cells = None
    for name, entries in fields.items():
        exact = sorted({n for _, n in entries})
        value = column(name)
        part = df.filter(~is_null_cell(value) & (~value.isin(*exact) if exact else F.lit(True)))
        part = part.select(column(row).alias("row_id"), F.lit(name).alias("field"), value.alias("value"))
        cells = part if cells is None else cells.unionByName(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = {name: CanonicalList(entries) for name, entries in fields.items()}
        for batch in batches:
            batch["code"] = [lists[f].match(v) or unmatched for f, v in zip(batch["field"], batch["value"], strict=True)]
            yield batch

    meanings = cells.select("field", "value").distinct().mapInPandas(run, "field string, value string, code string")
    return cells.join(meanings, ["field", "value"]).select("row_id", "field", "code")
