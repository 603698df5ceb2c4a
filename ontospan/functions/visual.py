"""The consistent form of text: strings that look the same become the same characters.

The form keeps everything a reader can see (letters, accents, letter case, digits, raised digits, signs, word gaps) and
removes what cannot be seen: width variants, decomposed or reordered accents, default-ignorable characters, kinds of
white space, and letters of other scripts whose glyphs equal Latin ones.

Null stays null; a string without visible characters becomes the empty string.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose glyph equals a Latin one, and the hyphens and signs with more than one code.
LOOKALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜ", "ABESIJKMHOPCTYXYGQW")),
    **dict(zip("аеѕіјорсухһԁԛԝ", "aesijopcyxhdqw")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("ονϳ", "ovj")),
    **dict(zip("ɡɑÐƉ", "gaĐĐ")),
    **dict(zip("‐‑−﹣", "----")),
    "μ": "µ",
}
# Default-ignorable code points outside general category Cf.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
# Decompositions that change what is seen (a raised digit is not the digit).
SEEN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>")
# Vietnamese and other precomposed Latin letters, ASCII and four signs: text of these with single inner spaces is in form already.
CLEAN = r" \x21-\x7eÀ-ÏÑ-ÿĀ-ıĴ-ľŁ-ňŊ-žƀ-ƈƊ-ǃḀ-ẙẜ-ỹµ²³¹αβγ"
DIRTY = rf"[^{CLEAN}]|  |^ | $"
FOLDED_APART = "µßẞ"  # characters in form whose full case folding isn't their lower case


def ignorable(ch: str) -> bool:
    """Whether a character takes no part in what is displayed."""
    return ord(ch) in IGNORABLE or unicodedata.category(ch) == "Cf" or 0xE0100 <= ord(ch) <= 0xE01EF


class _Units(dict):
    """Per character, its decomposed visible form; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ignorable(ch):
            out = ""
        elif ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
            out = " "
        else:
            out = ch if unicodedata.decomposition(ch).startswith(SEEN) else unicodedata.normalize("NFKD", ch)
            out = "".join(LOOKALIKES.get(x, x) for x in out)
        self[code] = out
        return out


_UNITS = _Units()


def consistent(text: str, fold_case: bool = False) -> str:
    """The consistent form of one string; with fold_case also full case folding."""
    out = unicodedata.normalize("NFC", text.translate(_UNITS))
    out = " ".join("".join(LOOKALIKES.get(x, x) for x in out).split())
    return unicodedata.normalize("NFC", out.casefold()) if fold_case else out


def _each(texts: pd.Series, fold_case: bool) -> pd.Series:
    codes, values = pd.factorize(texts)  # each distinct value of a batch is worked out once
    forms = [*(consistent(x, fold_case) for x in values), None]
    return pd.Series([forms[c] for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return _each(texts, False)


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return _each(texts, True)


def consistent_form(text: Column, fold_case: bool = False) -> Column:
    """consistent() of a column. Values that are in form already never leave the JVM: Python is handed nulls for them."""
    if fold_case:
        return F.coalesce(_folded(F.when(text.rlike(rf"{DIRTY}|[{FOLDED_APART}]"), text)), F.lower(text))
    return F.coalesce(_consistent(F.when(text.rlike(DIRTY), text)), text)
