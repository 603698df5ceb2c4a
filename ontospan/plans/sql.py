"""SQL fragments that the check queries share."""

from __future__ import annotations

import re

from ontospan.functions.rx import REWRITES
from ontospan.functions.visual import LOOKALIKES

def key(c: str) -> str:
    """The comparison key of functions.text.normalize_key."""
    folded = f"replace(lower(replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')), 'ß', 'ss')"
    return f"trim(regexp_replace(replace(replace({folded}, '–', '-'), '—', '-'), '[^\\p{{L}}\\p{{N}}_.%/+:\\-]+', ' ', 'g'))"


def chain(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        c = f"regexp_replace({c}, '{pattern}', '{re.sub(chr(92) + '$([0-9])', chr(92) * 2 + chr(92) + '1', replacement)}', 'g')"
    return c


def rx(c: str) -> str:
    """The prescription normal form of functions.rx.normalize_rx."""
    return f"trim(regexp_replace({chain(key(c), REWRITES)}, '\\s+', ' ', 'g'))"


def tokens(k: str) -> str:
    return f"list_filter(string_split({k}, ' '), lambda x: x <> '')"


_FLAT = {**LOOKALIKES, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " ")}


def form(c: str) -> str:
    """The consistent form of functions.visual for the characters of these tables: removals, one-to-one changes, then composition."""
    bare = f"regexp_replace({c}, '[\\x{{00AD}}\\x{{034F}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    flat = f"translate(replace(replace({bare}, '…', '...'), 'Ⅱ', 'II'), '{''.join(_FLAT)}', '{''.join(_FLAT.values()).replace(chr(39), chr(39) * 2)}')"
    flat = flat.replace("'" + "".join(_FLAT) + "'", "'" + "".join(_FLAT).replace("'", "''") + "'")
    return f"trim(regexp_replace(nfc_normalize({flat}), '\\s+', ' ', 'g'))"
