"""Text without case, accents, widths and look-alikes, as one JVM expression."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontospan.functions.visual import LOOKALIKES, ignorable


def _folding() -> tuple[str, str]:
    """Arguments of translate() that give lower-case letters without accents; built from the character database."""
    pairs: dict[str, str] = {}
    gone = []
    for code in (*range(0x80, 0x590), *range(0x1E00, 0x2070), *range(0x2100, 0x2190), *range(0x2212, 0x2213), *range(0x3000, 0x3001), *range(0xFE00, 0xFE10), *range(0xFEFF, 0xFF5F)):
        ch = chr(code)
        if ignorable(ch) or unicodedata.category(ch) == "Mn":
            gone.append(ch)
            continue
        if ch.isspace() or unicodedata.category(ch) == "Zs":
            pairs[ch] = " "
            continue
        whole = LOOKALIKES.get(ch, ch)
        base = [LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", whole) if unicodedata.category(x) != "Mn"]
        one = "".join(base).lower().replace("đ", "d").replace("ø", "o").replace("ł", "l").replace("ı", "i")
        if len(one) == 1 and one != ch:
            pairs[ch] = one
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def folded(text: Column) -> Column:
    """Lower case without accents, widths, look-alikes and invisible characters, in one JVM expression.

    Several characters may become one, so offsets don't survive; sharp s becomes ss, the ellipsis three full stops.
    """
    return F.lower(F.translate(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("…"), F.lit("...")), FOLD_FROM, FOLD_TO))
