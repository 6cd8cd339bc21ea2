"""Ordered replacements between a legacy font's coding and text, both ways.

A table of (text, code) pairs is applied pair by pair, in one expression in the JVM:
longest first, so that no pair cuts into a longer one, or in the order given where the
table relies on that. Two signs are also moved: a legacy coding writes the short i before
the consonants that it follows in text, and the r above a syllable behind the syllable
that it leads. The table and the codes of these two are the caller's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small table of codes for accented letters; codes use private characters.
PAIRS: tuple[tuple[str, str], ...] = tuple((c, chr(0xE000 + i)) for i, c in enumerate("äöüßéèêçñáíóú"))
#: The short i, the joining sign, the r that leads a syllable; the code of the i's legacy form.
SHORT_I, JOIN, LEADING_R, PREFIX_CODE = "ि", "्", "र्", chr(0xE100)
#: Signs that belong to the syllable before them.
SYLLABLE_SIGNS = "ािीुूृेैोौं:ँॅ"


def _ordered(text: Column, pairs: Sequence[tuple[str, str]], longest_first: bool) -> Column:
    for old, new in sorted(pairs, key=lambda p: -len(p[0])) if longest_first else pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def encode(text: Column, pairs: Sequence[tuple[str, str]] = PAIRS, prefix: str = PREFIX_CODE, reph: str | None = None, longest_first: bool = True) -> Column:
    """Text in the legacy coding. ``prefix`` and ``reph``: the codes of the i and the r that are moved."""
    moved = F.regexp_replace(text, f"(?s)((?:.{JOIN})*.){SHORT_I}", f"{prefix}$1")
    if reph:
        moved = F.regexp_replace(moved, f"(?s){LEADING_R}(.[{SYLLABLE_SIGNS}]*)", f"$1{reph}")
    return _ordered(moved, pairs, longest_first)


def decode(coded: Column, pairs: Sequence[tuple[str, str]] = PAIRS, prefix: str = PREFIX_CODE, reph: str | None = None, longest_first: bool = True, ligatures: Sequence[tuple[str, str]] = ()) -> Column:
    """Text of the legacy coding; ``ligatures`` (code, codes) are taken apart before signs are moved.

    The i goes behind the character that follows it, and on behind whatever is joined to that.
    """
    plain = _ordered(coded, [(code, text) for text, code in pairs], longest_first)
    plain = _ordered(plain, ligatures, False)
    plain = F.regexp_replace(plain, f"(?s){prefix}(.(?:{JOIN}.)*)", f"$1{SHORT_I}")
    if reph:
        plain = F.regexp_replace(plain, f"(?s)((?:[^{SYLLABLE_SIGNS}{reph}]|^)[{SYLLABLE_SIGNS}]*){reph}", f"{LEADING_R}$1")
    return plain
