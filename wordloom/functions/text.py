"""Tokenizer and word predicates as native Spark column expressions.

No Python runs per row: lower-casing and separator mapping are one
``translate`` pass, splitting is ``split`` on a single literal character (the
JVM's fast path, no regex engine), and empty tokens are removed with
``array_remove``. Measured warm at sf0.1 (10,000 documents, local[8]):
2.7-2.9 s, against 3.2 s for ``lower`` plus a separate separator pass (which
would also lower non-ASCII capitals) and 4.0 s for an ASCII-only fast path
switched per document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three separator sets of the reference tokenizers, in the
# order written there. Carriage return and no-break space are not separators.
SEPARATORS = {
    "A": " \t\n.,()'\":;!?<>",
    "B": " \t\n.,()'\":;!?<>[]-",
    "C": " \t\n.,()'\":;!?<>[]-=|",
}

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase

# An integer token: optional sign, then one or more ASCII digits, nothing else
# (``$`` would also match before a final carriage return, which a token may hold).
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def separators(preset: str) -> str:
    try:
        return SEPARATORS[preset]
    except KeyError:
        raise ValueError(f"unknown separator preset {preset!r}; use one of {sorted(SEPARATORS)}")


def tokenize(c, preset: str = "A") -> Column:
    """``array<string>`` of lower-cased tokens split on the preset's separators.

    Null text is treated as empty and gives an empty array. Every separator
    is first mapped to a space (itself a separator), so one literal split
    suffices; runs of separators leave empty strings, which are removed.
    """
    seps = separators(preset)
    others = seps.replace(" ", "")
    mapped = F.translate(F.coalesce(_col(c), F.lit("")), UPPER + others, LOWER + " " * len(others))
    return F.array_remove(F.split(mapped, " "), "")


def is_integer(c) -> Column:
    """True when the token is an optionally signed run of digits."""
    return _col(c).rlike(INTEGER_PATTERN)


def is_long_integer(c, max_len: int = 7) -> Column:
    """Integer tokens whose byte length (sign included) exceeds ``max_len``."""
    return is_integer(c) & (F.octet_length(_col(c)) > F.lit(max_len))
