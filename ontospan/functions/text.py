"""Scalar text functions as Column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospan.config import LONG_LINE

# Words that carry no meaning in the name of a condition.
CONDITION_STOPS = (
    "benh chan doan mac duoc co hoi chung khac theo doi nghi ngo cua do va voi tai o the "
    "of and or in on to due with without other specified unspecified disease disorder syndrome"
).split()


def _accents() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the character database."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), _FROM, _TO)


def normalize_key(c: Column) -> Column:
    """The comparison key: no accents or case, dashes as hyphens, single blanks for what is neither word nor . % / + : -"""
    low = F.replace(F.lower(strip_accents(c)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(low, "–—", "--"), r"[^\p{L}\p{N}_.%/+:\-]+", " "))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(normalize_key(c), "[^a-z0-9]+", "")


def tokens(key: Column) -> Column:
    """Nonempty blank-separated parts of a key."""
    return F.filter(F.split(key, " "), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(normalize_key(c)))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def key_similarity(a: Column, b: Column) -> Column:
    """Of two keys: 1 if equal, 0 if one is empty, else the matching-block ratio. Python sees only the pairs in between."""
    plain = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    return F.coalesce(plain, _ratio(F.when(plain.isNull(), a), F.when(plain.isNull(), b)))


def trim_span(text: Column, start: Column) -> Column:
    """struct(start, end, text) of a stretch without blanks around it and without trailing . , ; :"""
    left = F.regexp_replace(text, r"^\s+", "")
    kept = F.regexp_replace(F.regexp_replace(left, r"\s+$", ""), "[.,;:]+$", "")
    first = start + F.length(text) - F.length(left)
    return F.struct(first.alias("start"), (first + F.length(kept)).alias("end"), kept.alias("text"))


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Text around [start, end) by so many characters to either side."""
    first = F.greatest(F.lit(0), start - before)
    return F.substring(text, first + 1, end + after - first)


def snippet(text: Column, start: Column, end: Column, around: int = 120) -> Column:
    return F.translate(window(text, start, end, around, around), "\n", " ")


def line_before(text: Column, start: Column) -> Column:
    """The part of the line before an offset."""
    return F.substring_index(F.left(text, start), "\n", -1)


def line_after(text: Column, end: Column) -> Column:
    return F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)


def line_length(text: Column, start: Column, end: Column) -> Column:
    return F.length(line_before(text, start)) + (end - start) + F.length(line_after(text, end))


def line_profile(length: Column) -> Column:
    """short_line below 300 characters and where there is no source."""
    return F.when(length >= LONG_LINE, "long_line").otherwise("short_line")


def clause_before(text: Column, start: Column) -> Column:
    """The line before an offset, from its last . ; or : on."""
    return F.regexp_extract(line_before(text, start), "[^.;:]*$", 0)


def char_ngrams(key: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a key's letters and digits."""
    compact = F.regexp_replace(key, r"[^\p{L}\p{N}]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(compact) - (n - 1)), lambda i: F.substring(compact, i, F.lit(n)))
    return F.when(F.length(compact) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def condition_tokens(key: Column) -> Column:
    """Tokens of two characters or more that aren't stop words."""
    return F.filter(F.split(key, " "), lambda x: (F.length(x) >= 2) & ~x.isin(CONDITION_STOPS))


@F.pandas_udf(T.IntegerType())
def _edits_of_many(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> int | None:
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, t in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (s != t))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


LETTERS = 35_000  # code points from 0x4E00 on, below the surrogates


def token_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays, each distinct token mapped to one character; arrays with more distinct tokens than
    there are such characters are compared in Python."""
    known = F.array_distinct(F.concat(a, b))
    many = F.size(known) > LETTERS
    letter = lambda t: F.decode(F.unhex(F.hex(F.lit(0x4E00) + F.array_position(known, t).cast("int"))), "UTF-16BE")
    coded = lambda x: F.array_join(F.transform(F.when(~many, x), letter), "")
    return F.coalesce(F.levenshtein(coded(a), coded(b)), _edits_of_many(F.when(many, a), F.when(many, b)))


def token_score(gold: Column, other: Column) -> Column:
    """max(0, 1 - edits / gold tokens); 1 if both are empty, 0 if one is."""
    return F.when((F.size(gold) == 0) & (F.size(other) == 0), 1.0).when((F.size(gold) == 0) | (F.size(other) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - token_edits(gold, other) / F.size(gold)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap by hull length; 0 for disjoint and empty spans, null if a bound is."""
    overlap = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(~known, None).when(overlap == 0, 0.0).otherwise(overlap / (F.greatest(e1, e2) - F.least(s1, s2)))


def confidence(c: Column, default: float = 0.75) -> Column:
    """A number in [0, 1] from text; the default where there is none."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def natural_order(name: Column) -> list[Column]:
    """Sort columns: the first number in a name, then the name; names without a number come last."""
    return [F.coalesce(F.regexp_extract(name, r"\d+", 0).try_cast("bigint"), F.lit(1_000_000_000)), name]
