"""Numbers as they stand in text cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sign, digits, optional fraction after a point or comma, optional exponent; outer blanks are ignored.
NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?"
_WHOLE = re.compile(rf"\s*({NUMBER})\s*", re.ASCII)
_BLANK = r"^[\s ]*$"


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space cells."""
    return c.isNull() | c.rlike(_BLANK)


def is_number(c: Column) -> Column:
    """True where the whole cell is one number; null for null."""
    return c.rlike(rf"^\s*{NUMBER}\s*$")


def to_number(c: Column) -> Column:
    """DOUBLE of a number cell with point or comma; null for everything else."""
    return F.when(is_number(c), F.translate(F.trim(F.regexp_replace(c, r"\s+", "")), ",", ".").try_cast("double"))


def parse_number(text: str | None) -> float | None:
    """The same rule in Python, for Arrow batches."""
    found = _WHOLE.fullmatch(text) if text else None
    return float(found[1].replace(",", ".")) if found else None
