"""Text quality statistics of each document, and its form: prose, list, table or junk.

Statistics are computed in one Arrow pass over whole texts. Gradient-boosted trees are trained on documents
that plain rules label with confidence (weak labels), none of which is hand-checked; their scores are calibrated
to probabilities on two thirds of the hand-checked labels, and the most probable form is given. The last third of the
labels is used by nothing but ``holdout``, which measures the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.gbt import BoostedTrees, Calibration
from lodeworks.session import bounded_rows, small_side

FORMS = ("prose", "list", "table", "junk")
#: Bounds of the samples that the classifier is fitted on: documents for weak labels, hand-checked labels,
#: and common words. Statistics and forms are computed for all documents whatever these are.
MAX_WEAK, MAX_LABELS, MAX_WORDS = 8_000, 6_000, 200_000

STATS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
FEATURES = (
    *STATS, "digit_ratio", "space_ratio", "lines", "mean_line_words", "bullet_share", "short_share", "very_short_share", "item_share", "cell_share",
    "steady_cell_share", "gap_share", "junk_line_share", "repeat_line_share", "distinct_words", "top_word_share", "vowel_word_share",
    "odd_char_ratio", "latin1_ratio", "long_word_share", "mixed_word_share", "short_common", "long_share", "sentence_share", "stop_ratio",
    "capital_line_share", "first_word_share", "repeat_sentence_share", "compressed_share",
)

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_BULLET = re.compile(r"\s*(?:[-–—•*·▪◦+]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zа-я]{1,2}\))\s+", re.IGNORECASE)
_GAP2, _GAP3 = re.compile(r"\S {2,}(?=\S)"), re.compile(r"(?:^| {2}) {2,}(?=\S)|\S {3,}(?=\S)")
_VOWEL = re.compile(r"[aeiouyäöüéèàâêîôûœаеёиоуыэюя]", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…]+\s+|\n+")
_STOP = re.compile(r"[.!?…]+(?:\s+|$)")
_DIGITS, _RUN = re.compile(r"\d+"), re.compile(r"(\S)\1{7,}")
_ODD = re.compile(r"[\u0100-\u03ef\u0500-\u200f\u2028-\u20ab\u20ad-\u2102\u2104-\u2121\u2123-\u218f\u2194-\u2263\u2266-\U0010ffff]+")
_LATIN1 = re.compile(r"[\x80-\x9f¡-¦¨-ª¬-¯´-¶¸-º¼-¿ÐÑÃÂ]+")


def _size(found: list[str]) -> int:
    return sum(map(len, found))


def _cells(line: str) -> int:
    """Number of cell separators of a line, by its most frequent kind; 0 for running text."""
    bars, tabs, semis, commas = line.count("|"), line.count("\t"), line.count(";"), line.count(",")
    if commas and line.count(", ") * 2 >= commas:
        commas = 0
    gaps = len(_GAP3.findall(line)) if "   " in line.strip() else 0
    return max(bars if bars > 1 else 0, tabs, semis if semis > 1 else 0, commas if commas > 1 else 0, gaps)


def _unreadable(line: str, own: list[str], cells: int, runs: bool) -> bool:
    """A line that is no writing: one character over and over, mostly signs, or words no one could say."""
    size = len(line)
    if size < 8:
        return False
    letters, inked = _size(own), size - line.count(" ")
    if letters < 0.15 * inked or letters < 0.45 * inked and not cells:
        return True
    if own and max(map(len, own)) > 40:
        return True
    return runs and _size([m.group() for m in _RUN.finditer(line)]) * 2 > size


def _compressed(text: str) -> float:
    """Size after fast compression as a share of the size in UTF-8."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(zlib.compress(raw, 1)) / len(raw)


#: What is known of a word: lower case, length, and what its occurrences add to the sums of digits, alphabetic
#: words, words with a vowel, characters of words over 24 long, and characters of words with letters and digits.
_MET: dict[str, tuple[str, int, int, int, int, int, int]] = {}


def _known(word: str) -> tuple[str, int, int, int, int, int, int]:
    low, size = word.lower(), len(word)
    if len(_MET) > 300_000:
        _MET.clear()
    digits, alpha = _size(_DIGITS.findall(word)), low.isalpha()
    mixed = size if digits and any(map(str.isalpha, word)) else 0
    found = _MET[word] = (low, size, digits, int(alpha), int(alpha and _VOWEL.search(low) is not None), size if size > 24 else 0, mixed)
    return found


def statistics(text: str | None, common: dict[str, frozenset[str]]) -> list[float]:
    """FEATURES of one text; all zero for null, empty and blank texts. Words of the best-fitting language count as common."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    n = len(text)
    lines = [x for x in text.splitlines() if x.strip()] or [text]
    chars = _size(lines)
    per_line = list(map(_WORD.findall, lines))
    counts = Counter(chain.from_iterable(per_line))
    low: dict[str, int] = {}
    letters = digits = alpha = voiced = long_words = mixed = 0
    met = _MET.get
    for w, k in counts.items():
        lower, size, d, al, vo, lo, mi = met(w) or _known(w)
        low[lower] = low.get(lower, 0) + k
        letters += size * k
        if al:
            alpha += k
            voiced += vo * k
        elif d:
            digits += d * k
            mixed += mi * k
        long_words += lo * k
    n_words = sum(counts.values())
    n_common, best = 0, frozenset()
    for ws in common.values():
        own_common = sum([low[w] for w in low.keys() & ws])
        if own_common > n_common:
            n_common, best = own_common, ws
    shown = best | {w.capitalize() for w in best} | {w.upper() for w in best} if n_common else best
    runs = _RUN.search(text) is not None
    bullet = short = tiny = item = cell = steady = gap = junk = repeat = long = short_common = short_words = punct = capital = 0
    seen: set[str] = set()
    first: dict[str, int] = {}
    perhaps: list[tuple[str, int]] = []  # lines that are items if others begin as they do
    before = -1
    for line, own in zip(lines, per_line, strict=True):
        size, plain, k = len(line), line.strip(), len(own)
        cells = _cells(line)
        last = plain[-1]
        mark = _BULLET.match(line) is not None or (k < 12 and not plain[0].isalnum() and plain[0] not in "|\"'“«#(")
        if mark:
            bullet += size
        if k <= 7:
            short += size
            short_words += k
            said = len([1 for w in own if w in shown])
            short_common += said
            if k <= 3:
                tiny += size
            if mark or last not in ".!?…" and said * 4 <= k:
                item += size
            elif last not in ".!?…" and said * 2 < k:
                perhaps.append((own[0], size))
        elif k >= 9:
            long += size
        if cells:
            cell += size
            if cells == before:
                steady += size
        if "  " in plain and len(_GAP2.findall(plain)) < k - 1:
            gap += size
        if _unreadable(plain, own, cells, runs):
            junk += size
        punct += last in ".!?…:;”»"
        capital += plain[0].isupper()
        if plain in seen:
            repeat += size
        seen.add(plain)
        if k:
            head = own[0] if not mark or k < 2 or len(own[0]) > 2 else own[1]
            first[head] = first.get(head, 0) + 1
        before = cells
    item += sum(size for word, size in perhaps if first.get(word, 0) > 2)
    parts = [s.strip() for s in _SENTENCE.split(text) if s and not s.isspace()]
    part_chars = _size(parts) or 1
    repeated = part_chars - _size(list(set(parts)))
    sentences = _STOP.split(text)
    flowing = _size([s for s in sentences if 5 <= s.count(" ") + s.count("\n") <= 60])
    spaces = n - len("".join(text.split()))
    odd, latin1 = (0, 0) if text.isascii() else (_size(_ODD.findall(text)), _size(_LATIN1.findall(text)))
    n_lines, n_words1 = len(lines), max(n_words, 1)
    return [
        n_words, letters / n_words1, (n - letters - spaces) / n, punct / n_lines, n_common / n_words1,
        digits / n, spaces / n, n_lines, n_words / n_lines, bullet / chars, short / chars, tiny / chars, item / chars, cell / chars,
        steady / chars, gap / chars, junk / chars, repeat / chars, len(low) / n_words1, max(low.values(), default=0) / n_words1,
        voiced / max(alpha, 1), odd / n, latin1 / n,
        long_words / n, mixed / n, short_common / max(short_words, 1), long / chars,
        flowing / n, (len(sentences) - 1) / n_words1, capital / n_lines, max(first.values(), default=0) / n_lines, repeated / part_chars,
        _compressed(text),
    ]


_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_form(x: list[float]) -> str | None:
    """The form that plain rules are sure of, or None; null and blank texts are none."""
    f = {k: x[i] for k, i in _AT.items()}
    if not f["lines"]:
        return None
    unreadable = f["odd_char_ratio"] > 0.15 or f["latin1_ratio"] > 0.08 or f["vowel_word_share"] < 0.4 or f["mixed_word_share"] > 0.45
    if (unreadable and f["cell_share"] < 0.5 and f["common_word_share"] < 0.12) or f["junk_line_share"] > 0.55:
        return "junk"
    if max(f["repeat_line_share"], f["repeat_sentence_share"]) > 0.6 or f["top_word_share"] > 0.5 and f["n_words"] > 8:
        return "junk"
    if f["lines"] > 2 and (f["steady_cell_share"] > 0.6 or f["cell_share"] > 0.55) and f["common_word_share"] < 0.15:
        return "table"
    if f["lines"] > 2 and f["item_share"] > 0.6 and f["cell_share"] < 0.2 and (f["short_common"] < 0.12 or f["first_word_share"] > 0.3 and f["stop_ratio"] < 0.05):
        return "list"
    if f["item_share"] < 0.4 or f["short_common"] > 0.2 and f["first_word_share"] < 0.2:
        if f["common_word_share"] > 0.2 and max(f["cell_share"], f["bullet_share"]) < 0.3 and max(f["repeat_sentence_share"], f["junk_line_share"]) < 0.3:
            return "prose"
    return None


@dataclass
class FormModel:
    """Trees over FEATURES with calibrated probabilities of FORMS."""

    trees: BoostedTrees
    calibration: Calibration

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.probabilities(self.trees.scores(x))


def common_words(words: DataFrame) -> dict[str, frozenset[str]]:
    """Frequent words by language; a fixed, bounded list."""
    out: dict[str, set[str]] = {}
    for r in bounded_rows(words.select("lang", "word").filter("word is not null"), MAX_WORDS, "the list of common words"):
        out.setdefault(r.lang or "", set()).add(r.word.lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


def _features(documents: DataFrame, common: dict[str, frozenset[str]], keep: str) -> DataFrame:
    names = ", ".join(f"{c} double" for c in FEATURES)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t, common) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, j]) for j in range(len(FEATURES))]], names=[keep, *FEATURES])

    return documents.select(keep, "text").mapInArrow(compute, f"{keep} {documents.schema[keep].dataType.simpleString()}, {names}")


def held_out(doc_id: str) -> Column:
    """True for the third of the labels that neither trees nor calibration see."""
    return F.pmod(F.xxhash64(doc_id, F.lit("held out")), F.lit(3)) == 0


def train(documents: DataFrame, labels: DataFrame, words: dict[str, frozenset[str]], max_weak: int = MAX_WEAK, max_labels: int = MAX_LABELS) -> FormModel:
    """Fit the trees on weak labels and calibrate them on hand-checked ones.

    Both samples are bounded, chosen by a hash of doc_id, and reduced to statistics on the executors. No document
    with a label is among the weakly labelled ones, and labels that are held out calibrate nothing. Labels with an
    unknown form or without a document are ignored; without any label the scores stay as they are.
    """
    known = labels.filter("doc_id is not null").select("doc_id").distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = min(1_000_000, int(max_weak * 1_000_000 / max(documents.count(), 1)) + 1)
    unknown = documents.filter(place < share).join(small_side(known, MAX_WEAK), "doc_id", "left_anti").select("doc_id", "text")
    weak_rows = _features(unknown, words, "doc_id").orderBy(F.xxhash64("doc_id")).limit(max_weak).collect()
    weak = [(list(r)[1:], form) for r in weak_rows if (form := weak_form(list(r)[1:]))]
    checked = labels.filter(F.col("form").isin(*FORMS) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("form").alias("form")).orderBy(F.xxhash64("doc_id")).limit(max_labels)
    sample = documents.join(F.broadcast(checked), "doc_id").filter("text is not null and text <> ''").select(F.concat_ws(":", "doc_id", "form").alias("key"), "text")
    hand = [(list(r)[1:], r.key.split(":")[1]) for r in _features(sample, words, "key").collect()]
    return fit_model(weak, hand)


def fit_model(weak: list[tuple[list[float], str]], hand: list[tuple[list[float], str]]) -> FormModel:
    """The model from (features, form) pairs; rare forms get more weight, so that none is drowned."""
    x = np.array([w[0] for w in weak], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([FORMS.index(w[1]) for w in weak], dtype=int)
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.zeros(1, dtype=int)
    counts = np.bincount(y, minlength=len(FORMS))
    trees = BoostedTrees(len(FORMS)).fit(x, y, np.sqrt(len(y) / np.maximum(counts[y], 1)))
    held = np.array([h[0] for h in hand], dtype=float).reshape(-1, len(FEATURES))
    return FormModel(trees, Calibration.fit(trees.scores(held), np.array([FORMS.index(h[1]) for h in hand], dtype=int)))


def text_quality(documents: DataFrame, labels: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, STATS, form and probability of every document.

    Null, empty and blank texts have zero statistics and a null form. Texts of any length count whole.
    """
    common = common_words(words)
    model = train(documents.select("doc_id", "text"), labels, common)
    schema = ", ".join(["doc_id bigint", *[f"{s} double" for s in STATS], "form string", "probability double"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t, common) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            p = model.probabilities(x)
            best = p.argmax(1) if len(p) else np.zeros(0, dtype=int)
            blank = x[:, _AT["lines"]] == 0
            forms = [None if b else FORMS[k] for k, b in zip(best, blank, strict=True)]
            top = [None if b else float(v[k]) for v, k, b in zip(p, best, blank, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x[:, _AT[s]]) for s in STATS], pa.array(forms, pa.string()), pa.array(top, pa.float64())],
                names=["doc_id", *STATS, "form", "probability"],
            )

    return documents.select("doc_id", "text").mapInArrow(judge, schema)


def holdout(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(form, n, hits, mean_probability) of the held-out labels, one row for each hand-checked form.

    ``hits`` are those that ``judged`` (``text_quality``) gives that form, ``mean_probability`` is the calibrated
    probability of the form given. Labels without a document, with an unknown form or of a blank text count nowhere.
    """
    checked = labels.filter(F.col("form").isin(*FORMS) & held_out("doc_id")).groupBy("doc_id").agg(F.min("form").alias("form"))
    given = judged.filter("form is not null").select("doc_id", F.col("form").alias("given"), "probability")
    joined = given.join(small_side(checked, MAX_LABELS), "doc_id")
    return joined.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.col("given") == F.col("form")).alias("hits"), F.round(F.avg("probability"), 6).alias("mean_probability"))
