"""Free-entered values mapped to the entries of a reference list.

Each distinct token of a value is joined to the list's vocabulary by edit distance, over an index of deletion
neighbourhoods; the repaired tokens are then combined by soft TF-IDF, which ranks complete entries. An entry
counts only if its number is among the value's numbers and its name is covered. Values are resolved where
they stand, in Arrow batches with a table of those met before, so a text that fills a third of all rows is
no hot key and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.session import bounded_rows, small_side

#: Entries of the list at most (a bound of the task closure, by contract), and of the names broadcast for the exact test.
MAX_ENTRIES = 200_000
#: Least share of an entry's weight that the repaired tokens must cover, and shortest abbreviation.
LEAST_COVER, LEAST_PREFIX = 0.6, 4
#: Length up to which words are found by their deletions; longer ones are compared with the words of nearly their length.
LONG = 40
UNMATCHED = "unmatched"

#: Cyrillic letters in Latin writing; letters that look alike in both scripts. Fixed values.
_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True))
_ALIKE = str.maketrans("аеосрхіуквмнтјѕԁһ", "aeocpxiykbmhtjsdh")
_TOKEN = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"[^\W\d_]+|\d+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def plain(text: str) -> str:
    """Lower case without accents; words in Cyrillic are transliterated, single look-alike letters replaced."""
    low = "".join(c for c in unicodedata.normalize("NFKD", text.replace("й", "и").replace("Й", "И")).lower() if not unicodedata.combining(c))

    def word(m: re.Match) -> str:
        own = m.group()
        if not _CYRILLIC.search(own):
            return own
        letters = [c for c in own if c.isalpha()]
        if all(_CYRILLIC.match(c) for c in letters) and not all(c in "аеосрхіукт" for c in letters):
            return "".join(_LATIN.get(c, c) for c in own.replace("кс", "x"))
        return own.translate(_ALIKE)

    return _TOKEN.sub(word, low)


def tokens(text: str) -> list[str]:
    """Tokens of the plain form. A run that starts with three or more letters is parted from the digits after it."""
    out = []
    for run in _TOKEN.findall(plain(text)):
        parts = _SPLIT.findall(run)
        out += parts if len(parts) == 1 or len(parts) == 2 and (len(parts[0]) > 1 or parts[0].isdigit()) else [run]
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, or ``most`` + 1 as soon as it is exceeded."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def allowed(size: int) -> int:
    """Edits allowed in a word of a length: none in codes, three in long names."""
    return 0 if size < 5 else 1 if size < 6 else 2 if size < 8 else 3


def _deletions(word: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(word) if i not in drop) for k in range(most + 1) for drop in map(set, combinations(range(len(word)), k))}


class Matcher:
    """The reference list, indexed for repair and ranking."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        """``entries`` are (name or alias, canonical_id)."""
        self.entries: list[tuple[str, tuple[str, ...]]] = sorted({(cid, tuple(dict.fromkeys(tokens(name)))) for name, cid in entries if name and cid})
        self.exact: dict[str, str] = {}
        for name, cid in sorted(entries, key=lambda e: (str(e[0]), str(e[1]))):
            if name and cid:
                self.exact.setdefault(name, cid)
        n = len(self.entries)
        frequency: dict[str, int] = {}
        for _, own in self.entries:
            for t in own:
                frequency[t] = frequency.get(t, 0) + 1
        self.weight = {t: math.log(1 + n / f) for t, f in frequency.items()}
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, own) in enumerate(self.entries):
            for t in own:
                for number in [t for t in own if any(map(str.isdigit, t))] or [""]:
                    self.holders.setdefault((t, number), []).append(i)
        self.words = sorted(t for t in frequency if not any(map(str.isdigit, t)))
        self.near: dict[str, list[str]] = {}
        self.long: dict[int, list[str]] = {}  # by length: too many deletions to index, compared one by one
        for w in self.words:
            if len(w) > LONG:
                self.long.setdefault(len(w), []).append(w)
            elif allowed(len(w)):
                for d in _deletions(w, allowed(len(w))):
                    self.near.setdefault(d, []).append(w)
        self._repairs: dict[str, list[tuple[str, float]]] = {}

    def repairs(self, token: str) -> list[tuple[str, float]]:
        """Vocabulary words for a token with their similarity: itself, or those close by edits or begun by it."""
        if token in self.weight:
            return [(token, 1.0)]
        if any(map(str.isdigit, token)):
            return []
        found = self._repairs.get(token)
        if found is None:
            found = self._repair(token)
            if len(self._repairs) > 300_000:
                self._repairs.clear()
            self._repairs[token] = found
        return found

    def _repair(self, token: str) -> list[tuple[str, float]]:
        best: dict[str, float] = {}
        if len(token) > 4:
            # no word of the index is longer than LONG, and no token with more than three letters over that is near one
            near = [w for d in _deletions(token, min(3, allowed(len(token) + 1))) for w in self.near.get(d, ())] if len(token) <= LONG + 3 else []
            for w in chain(near, *(self.long.get(len(token) + k, ()) for k in range(-3, 4))):
                if w not in best:
                    most = min(allowed(len(w)), allowed(len(token) + 1))
                    e = edits(token, w, most)
                    best[w] = 1 - e / max(len(w), len(token)) if e <= most else 0.0
        if len(token) >= LEAST_PREFIX:
            i = bisect_left(self.words, token)
            while i < len(self.words) and self.words[i].startswith(token):
                best[self.words[i]] = max(best.get(self.words[i], 0.0), 0.75)
                i += 1
        return sorted(((w, s) for w, s in best.items() if s > 0), key=lambda x: (-x[1], x[0]))

    def match(self, text: str | None) -> tuple[str, float]:
        """(canonical_id, score) of the entry meant, or (``unmatched``, 0). Ties fall to the smaller canonical_id."""
        if not text or not text.strip():
            return UNMATCHED, 0.0
        if text in self.exact:
            return self.exact[text], 1.0
        own = list(dict.fromkeys(tokens(text)))
        numbers = [t for t in own if any(map(str.isdigit, t))] or [""]
        sims: dict[int, dict[str, float]] = {}
        known = 0.0
        for t in own:
            options = self.repairs(t)
            if options:
                known += max(self.weight[w] for w, _ in options) ** 2
            for w, s in options:
                for number in numbers:
                    for i in self.holders.get((w, number), ()):
                        row = sims.setdefault(i, {})
                        row[w] = max(row.get(w, 0.0), s)
        best = (0.0, "", UNMATCHED)
        for i, row in sims.items():
            cid, parts = self.entries[i]
            whole = sum(self.weight[t] for t in parts)
            names = [t for t in parts if not any(map(str.isdigit, t))]
            if not any(row.get(t) for t in names) or any(t not in row for t in parts if any(map(str.isdigit, t))):
                continue
            cover = sum(self.weight[t] * s for t, s in row.items()) / whole
            score = sum(self.weight[t] ** 2 * s for t, s in row.items()) / math.sqrt(sum(self.weight[t] ** 2 for t in parts) * known)
            if cover >= LEAST_COVER and all(row.get(t) or self.weight[t] < 0.5 * max(self.weight[x] for x in names) for t in names):
                if (score, cid) > (best[0], "") and (score > best[0] + 1e-12 or abs(score - best[0]) <= 1e-12 and cid < best[2]):
                    best = (score, "", cid)
        return best[2], best[0]


def list_names(entries: DataFrame, section: str) -> DataFrame:
    """(name, canonical_id): names and aliases of a section, null ones left out."""
    both = entries.filter(F.col("section") == section).select("canonical_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return both.filter("name is not null and canonical_id is not null").select("name", "canonical_id").distinct()


def mapped(values: DataFrame, names: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """(origin, row_id, text, canonical_id, score) of ``values`` (origin, row_id, text).

    Null and empty texts are left out; blank ones are unmatched. Rows keep their number: no text is resolved
    twice in a task, and none is cut.
    """
    matcher = Matcher([tuple(r) for r in bounded_rows(names, limit, "the reference list")])
    out = pa.schema([("origin", pa.string()), ("row_id", pa.int64()), ("text", pa.string()), ("canonical_id", pa.string()), ("score", pa.float64())])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, tuple[str, float]] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = []
            for t in texts:
                if (r := met.get(t)) is None:
                    r = met[t] = matcher.match(t)
                got.append(r)
            if len(met) > 300_000:
                met.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=out.names)

    return values.filter("text is not null and text <> ''").select("origin", "row_id", "text").mapInArrow(resolve, "origin string, row_id bigint, text string, canonical_id string, score double")


def not_listed(values: DataFrame, names: DataFrame) -> DataFrame:
    """Values that are not exactly a name or alias; an anti-join, broadcast where the list is small enough."""
    return values.join(small_side(names.select(F.col("name").alias("text")).distinct(), MAX_ENTRIES), "text", "left_anti").select("origin", "row_id", "text")


def material_texts(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """(origin, row_id, text): the material texts of both tables."""
    return rows.select(F.lit("experiment_rows").alias("origin"), "row_id", F.col("material").alias("text")).unionByName(
        experiments.select(F.lit("experiments").alias("origin"), F.col("exp_row").alias("row_id"), F.col("material_name").alias("text"))
    )
