"""A grammar for unit expressions: scale, offset and a vector of dimension exponents.

    unit     <- number? term (op term)*          op <- "/", "per", "·", "*", ".", "-", "x" or a blank
    term     <- prefix? symbol exponent?         exponent <- ^-2, **-2, -2, ⁻², ², or "sq"/"cu" before the symbol
    number   <- digits, 10^3 or 0.001

A reading gives the SI scale, the offset of an affine scale (degC, degF), the exponents of kg, m, s, K and A,
one pseudo dimension for scales that are no SI quantity (hardness numbers), and the set of its base symbols.
Two codes of one scale and one dimension (MPa and N/mm2) are told apart by these symbols.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

_G0, _LB, _IN = 9.80665, 0.45359237, 0.0254
_MASS, _LENGTH, _TIME, _TEMP = (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0)
_FORCE, _STRESS, _ENERGY = (1, 1, -2, 0, 0, 0), (1, -1, -2, 0, 0, 0), (1, 2, -2, 0, 0, 0)
_SIEMENS, _CONDUCTANCE, _HARD, _ONE = (-1, -2, 3, 0, 2, 0), (-1, -3, 3, 0, 2, 0), (0, 0, 0, 0, 0, 1), (0,) * 6

#: Symbol -> (base symbol, scale, offset, dimension, takes prefixes). Fixed values of the units themselves.
SYMBOLS: dict[str, tuple[str, float, float, tuple[int, ...], bool]] = {}


def _symbol(names: str, base: str, scale: float, dim: tuple[int, ...], prefixes: bool = False, offset: float = 0.0) -> None:
    for name in names.split("|"):
        SYMBOLS[name] = (base, scale, offset, dim, prefixes)


_symbol("Pa|pascal|pascals|Па", "Pa", 1, _STRESS, True)
_symbol("psi|p.s.i.", "lbf", _LB * _G0 / _IN**2, _STRESS, True)
_symbol("N|newton|newtons|Н", "N", 1, _FORCE, True)
_symbol("kgf|kilogram-force|kp|кгс", "kgf", _G0, _FORCE)
_symbol("lbf|pound-force", "lbf", _LB * _G0, _FORCE)
_symbol("kip|kips", "lbf", 1000 * _LB * _G0, _FORCE)
_symbol("g|gram|grams|gramme|г", "g", 1e-3, _MASS, True)
_symbol("кг", "g", 1, _MASS)
_symbol("lb|lbs|pound|pounds", "lb", _LB, _MASS)
_symbol("m|metre|metres|meter|meters|м", "m", 1, _LENGTH, True)
_symbol("in|inch|inches", "in", _IN, _LENGTH)
_symbol("ft|foot|feet", "ft", 12 * _IN, _LENGTH)
_symbol("mil|mils|thou|thousandth", "mil", _IN / 1000, _LENGTH)
_symbol("micron|microns|мкм", "m", 1e-6, _LENGTH)
_symbol("мм", "m", 1e-3, _LENGTH)
_symbol("нм", "m", 1e-9, _LENGTH)
_symbol("см", "m", 1e-2, _LENGTH)
_symbol("cc|ccm", "m", 1e-6, (0, 3, 0, 0, 0, 0))
_symbol("pci", "lb", _LB / _IN**3, (1, -3, 0, 0, 0, 0))
_symbol("J|joule|joules|Дж", "J", 1, _ENERGY, True)
_symbol("s|sec|secs|second|seconds|с", "s", 1, _TIME)
_symbol("min|mins|minute|minutes|мин", "min", 60, _TIME)
_symbol("h|hr|hrs|hour|hours|ч", "h", 3600, _TIME)
_symbol("d|day|days|day(s)|сут", "d", 86400, _TIME)
_symbol("K|kelvin|kelvins|degK|°K", "K", 1, _TEMP)
_symbol("degC|°C|℃|C|celsius|centigrade", "degC", 1, _TEMP, False, 273.15)
_symbol("degF|°F|℉|F|fahrenheit", "degF", 5 / 9, _TEMP, False, 459.67 * 5 / 9)
_symbol("S|siemens|См", "S", 1, _SIEMENS, True)
_symbol("%IACS|IACS%", "%IACS", 0.58e6, _CONDUCTANCE)
_symbol("HV|vickers|HVN", "HV", 1, _HARD)
_symbol("%|percent|pct", "%", 0.01, _ONE)
_symbol("frac|fraction", "frac", 1, _ONE)
_symbol("ppm|p.p.m.", "ppm", 1e-6, _ONE)

#: Prefixes and their powers of ten. Fixed values.
PREFIXES = {"G": 9, "giga": 9, "M": 6, "mega": 6, "k": 3, "kilo": 3, "c": -2, "centi": -2, "m": -3, "milli": -3, "u": -6, "µ": -6, "μ": -6, "micro": -6, "n": -9, "nano": -9}
#: Spellings that are one symbol, put into their plain form before the grammar. Fixed values.
_PLAIN = (
    (r"per\s+cent", "percent"), (r"parts?\s+per\s+million", "ppm"), (r"parts?\s+of\s+(?:1|one)", "frac"),
    (r"(?:%|percent|pct)\s*iacs|iacs\s*(?:%|percent|pct)", "%IACS"), (r"hv\s*\d+", "HV"), (r"deg(?:rees?)?\.?\s*([cfk])\b", r"deg\1"),
    (r"degrees?\s+(celsius|fahrenheit|kelvin)", r"\1"), (r"m\.\s*m\.", "mm"), (r"p\.\s*p\.\s*m\.?", "ppm"), (r"p\.\s*s\.\s*i\.?", "psi"),
    (r"\b(?:square|sq\.?)\s*(?=[a-zа-я])", "sq_"), (r"\b(?:cubic|cu\.?)\s*(?=[a-zа-я])", "cu_"),
    (r"\b(micro|u|µ|μ)-(?=in)", r"\1"), (r"\bkpsi\b", "ksi"), (r"\bpounds?-force\b", "lbf"),
    (r"\bkgm\b", "kgf m"), (r"\bgcm\b", "g cm"),
)
_PLAIN_RX = [(re.compile(a, re.IGNORECASE), b) for a, b in _PLAIN]
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_NUMBER = re.compile(r"(?:10\s*\^\s*(\d+)|(\d+(?:\.\d+)?))\s*")
_TERM = re.compile(r"(sq_|cu_)?(%IACS|%|℃|℉|°[CFK]|[^\W\d_]+(?:\(s\))?)(?:\s*(?:\^|\*\*)\s*(-?\d+)|(-?\d+))?")
_OP = re.compile(r"\s*(/|\bper\b|·|⋅|\*|×|\.(?=\w)|-(?=[^\W\d_])|\s(?=\S))\s*")


@dataclass(frozen=True)
class Reading:
    """One reading of a unit expression."""

    scale: float
    offset: float
    dim: tuple[int, ...]
    symbols: frozenset[str]


def _symbol_readings(text: str, exact: bool) -> list[tuple[str, float, float, tuple[int, ...]]]:
    table = SYMBOLS if exact else _lowered()
    key = text if exact else text.lower()
    out = []
    if key in table:
        for base, scale, offset, dim, _ in [table[key]] if exact else table[key]:
            out.append((base, scale, offset, dim))
    for prefix, power in PREFIXES.items():
        head = key.startswith(prefix if exact else prefix.lower())
        rest = key[len(prefix) :]
        if not head or not rest or rest not in table:
            continue
        for base, scale, offset, dim, takes in [table[rest]] if exact else table[rest]:
            if takes or (base == "in" and power == -6) or (base == "lbf" and rest == "psi"):
                out.append((base, scale * 10.0**power, offset, dim))
    if key == "ksi":
        out.append(("lbf", 1000 * _LB * _G0 / _IN**2, 0.0, _STRESS))
    return out


@lru_cache(None)
def _lowered() -> dict[str, list]:
    out: dict[str, list] = {}
    for k, v in SYMBOLS.items():
        out.setdefault(k.lower(), []).append(v)
    return out


def _combine(parts: list[tuple[list, int]], factor: float) -> list[Reading]:
    """All distinct readings of a product. Equal intermediate ones are one, so they do not multiply with its length."""
    found = {(factor, 0.0, (0,) * 6, frozenset()): None}
    for options, power in parts:
        found = {
            (float(f"{s * scale**power:.12g}"), off + (o if len(parts) == 1 and power == 1 else 0.0), tuple(a + b * power for a, b in zip(d, dim, strict=True)), names | {base}): None
            for s, off, d, names in found
            for base, scale, o, dim in options
        }
    return [Reading(*f) for f in found]


def _parse(text: str, exact: bool) -> list[Reading]:
    factor, at, sign, parts = 1.0, 0, 1, []
    if number := _NUMBER.match(text):
        factor, at = 10.0 ** int(number[1]) if number[1] else float(number[2]), number.end()
    while True:
        term = _TERM.match(text, at)
        if not term or not (options := _symbol_readings(term[2], exact)):
            return []
        power = int(term[3] or term[4] or {"sq_": 2, "cu_": 3}.get(term[1] or "", 1))
        parts.append((options, sign * power))
        at = term.end()
        if at == len(text):
            return _combine(parts, factor)
        op = _OP.match(text, at)
        if not op:
            return []
        sign = -1 if op[1] in ("/", "per") else 1  # a quotient binds to the next term
        at = op.end()


def _weight(parts: Reading) -> Reading | None:
    """The reading with a mass taken as its weight: kg/mm2 for kgf/mm2, ft lb for ft-lbf."""
    twin = {"g": "kgf", "lb": "lbf"}
    names = parts.symbols & twin.keys()
    if parts.dim[0] != 1 or len(names) != 1:
        return None
    dim = (parts.dim[0], parts.dim[1] + 1, parts.dim[2] - 2, *parts.dim[3:])
    return Reading(parts.scale * _G0, parts.offset, dim, parts.symbols - names | {twin[next(iter(names))]})


@lru_cache(100_000)
def readings(text: str) -> tuple[Reading, ...]:
    """All readings of an expression, those that keep its letter case first."""
    plain = text.strip().translate(_SUPER)
    while len(plain) > 1 and plain[0] + plain[-1] in ("[]", "()", "{}"):
        plain = plain[1:-1].strip()
    for rx, to in _PLAIN_RX:
        plain = rx.sub(to, plain)
    plain = plain.strip()
    forms = dict.fromkeys([plain, plain.rstrip(".").rstrip(), re.sub(r"^(\w)\s+(?=\w+$)", r"\1", plain)])
    out: list[Reading] = []
    for exact in (True, False):
        for form in forms:
            if form:
                own = _parse(form, exact)
                out += own + [w for r in own if (w := _weight(r))]
    return tuple(dict.fromkeys(out))


class UnitList:
    """The codes of a unit list (unit_code, quantity, factor, shift), each with its reading."""

    def __init__(self, rows: Iterable[tuple[str, str, float, float]]):
        self.codes = {c: (q, float(f), float(s)) for c, q, f, s in rows if c and q and f is not None and s is not None}
        self.read: list[tuple[str, str, Reading]] = []
        for code, (quantity, _, _) in self.codes.items():
            own = [r for r in readings(code)]
            if own:
                weighed = {"kgf", "lbf"} & {s for r in own for s in r.symbols}
                self.read.append((code, quantity, next((r for r in own if weighed & r.symbols), own[0])))
        self._cache: dict[str, str | None] = {}

    def code_of(self, text: str | None) -> str | None:
        """The code that an expression names, or None."""
        if text is None:
            return None
        if text not in self._cache:
            if len(self._cache) > 200_000:
                self._cache.clear()
            self._cache[text] = self._find(text)
        return self._cache[text]

    def _find(self, text: str) -> str | None:
        if text.strip() in self.codes:
            return text.strip()
        for reading in readings(text):
            same = [
                (code, r)
                for code, _, r in self.read
                if r.dim == reading.dim and math.isclose(r.scale, reading.scale, rel_tol=2e-4) and math.isclose(r.offset, reading.offset, rel_tol=1e-3, abs_tol=1e-6)
            ]
            if same:
                return next((code for code, r in same if r.symbols == reading.symbols), same[0][0])
        return None

    def named_in(self, text: str | None, quantity: str | None) -> str | None:
        """The one code of a quantity that running text names; None for none and for two different ones."""
        if not text or not quantity:
            return None
        found = {code for code in self.mentions(text) if self.codes[code][0] == quantity}
        return found.pop() if len(found) == 1 else None

    def mentions(self, text: str) -> list[str]:
        """Codes named in running text, left to right, the longest expression first."""
        spans = [m.span() for m in _WORD.finditer(text)]
        out, i = [], 0
        while i < len(spans):
            if not _may_start(text[slice(*spans[i])]):
                i += 1
                continue
            last = i + 1  # the run of words that can belong to one expression
            while last < len(spans) and _may_follow(text[slice(*spans[last])], text[slice(*spans[last - 1])]) and not _BREAK.search(text, spans[i][0], spans[last][1]):
                last += 1
            for j in range(last, i, -1):
                span = text[spans[i][0] : spans[j - 1][1]]
                code = None if _NUMBER.fullmatch(span) or _BREAK.search(span) else self.code_of(span.rstrip(",;:"))
                if code:
                    out.append(code)
                    i = j
                    break
            else:
                i += 1
        return out

    def convert(self, value: float, source: str, target: str) -> float | None:
        """A value in another code of the same quantity; None where the quantities differ."""
        (q1, f1, s1), (q2, f2, s2) = self.codes[source], self.codes[target]
        return (value * f1 + s1 - s2) / f2 if q1 == q2 else None


@lru_cache(100_000)
def _may_start(word: str) -> bool:
    """False for words with which no unit expression begins; the bare "in" of a sentence is one of them."""
    if word.lower() == "in":
        return False
    plain = word.strip("[]()").translate(_SUPER)
    if _NUMBER.match(plain) or _OPENERS.match(plain):
        return True
    term = _TERM.match(plain)
    return bool(term) and bool(_symbol_readings(term[2], True) or _symbol_readings(term[2], False) or len(term[2]) == 1)


@lru_cache(100_000)
def _may_follow(word: str, before: str) -> bool:
    """False for words that cannot stand within a unit expression after ``before``. A number stands only after a few words."""
    plain = word.strip("[]().,;:").translate(_SUPER)
    if not plain or plain[0] in "/·⋅*×.-^":
        return True
    if _NUMBER.fullmatch(plain):
        return before.lower().rstrip("*^") in ("", "hv", "of")
    if _FILLERS.fullmatch(plain) or _OPENERS.match(plain):
        return True
    term = _TERM.match(plain)
    return bool(term) and bool(_symbol_readings(term[2], True) or _symbol_readings(term[2], False) or len(term[2]) == 1)


_FILLERS = re.compile(r"cent|million|of|one|celsius|fahrenheit|kelvin|force", re.IGNORECASE)
_OPENERS = re.compile(r"(?:per|parts?|deg|degrees?|hv|iacs|square|sq|cubic|cu|micro|[mp]\.|kgm|gcm|kpsi|pounds?)", re.IGNORECASE)
_WORD = re.compile(r"[+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?(?:\s*\^\s*\d+)?|\[[^\]\s]{1,12}\]|%|[^\s\d,;%\[\]][^\s,;%\[\]]*")
_BREAK = re.compile(r"[,;:]\s|\.\s")
