"""Text expressions that run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Java's ``\s`` leaves out: separators beyond ASCII and zero-width marks.
BLANK = r"[\s\p{Z}\u0085\u200b\ufeff]"

#: Words that stand for "not known" when they are a whole field.
UNKNOWN_WORDS = (
    "unknown", "n/a", "na", "none", "null", "nil", "not known", "not given", "none given",
    "not available", "not specified", "unspecified", "undefined", "missing", "tbd", "tba", "nan",
)

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "ԛ": "q", "ԝ": "w", "ё": "e",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}


def strip(col: Column) -> Column:
    """``col`` without outer blanks of any kind."""
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(col: Column) -> Column:
    """True for null, empty and all-blank text."""
    return col.isNull() | (F.length(strip(col)) == 0)


def is_given(col: Column, plain: bool = False) -> Column:
    """True unless ``col`` is blank or only a sign or word for "not known"; ``plain`` if it is stripped and lower already."""
    value = col if plain else F.lower(strip(col))
    return F.coalesce(value.rlike(r"[\p{L}\p{N}]") & ~value.isin(*UNKNOWN_WORDS), F.lit(False))


def _folding() -> tuple[str, str]:
    """The letters with a plain Latin base, and these bases, by rule from Unicode."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    for letter, base in LOOKALIKES.items():
        source += [letter, letter.upper()]
        target += [base, base.upper()]
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folding()


def fold(col: Column) -> Column:
    """Lower case without accents, combining marks and letters that only look Latin."""
    return F.lower(F.regexp_replace(F.translate(col, FOLD_FROM, FOLD_TO), r"\p{M}+", ""))
