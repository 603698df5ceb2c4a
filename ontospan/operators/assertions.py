"""Context flags of spans: negated, family, historical. All of it is Column expressions over the text around a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospan.config import ASSERTED, DIAGNOSIS, DRUG, LONG_LINE, SYMPTOM
from ontospan.functions.text import normalize_key

# Cue phrases in folded form.
NEGATION = r"\b(?:khong|chua|phu nhan|khong thay|no|denies|without|negative for)\b"
NOT_NEGATED = r"^(?:khong dien hinh|khong dac hieu|khong the|khong ro|khong co cai thien|khong lien quan)"
CONTRAST = r"\b(?:nhung|tuy nhien|song|however|but)\b"
FAMILY = (
    r"(?:\btien su gia dinh\s*(?::|la|co|ghi nhan)?\s*$|\bfamily history\s*(?::|of)?\s*$|"
    r"\b(?:bo|cha|me|ong|ba|anh trai|chi gai|em trai|em gai|father|mother)(?:\s+benh nhan)?\s+(?:bi|mac|co|tien su|duoc chan doan|da tung)\s*$)"
)
HISTORY = r"\b(?:tien su|da tung|tung bi|truoc day|previously|history of|past medical history|pmh|keo dai tu lau|trong vai nam|man tinh|cu)\b"
PAST_DRUG = r"\b(?:thuoc truoc khi nhap vien|thuoc truoc nhap vien|home meds?|prior to admission|da dung|tung dung|su dung|da ngung|ngung su dung|o nha)\b"
CURRENT_DRUG = r"\b(?:duoc chi dinh dieu tri|tai khoa cap cuu|den khoa cap cuu|danh gia tai benh vien|dieu tri tai benh vien|dang dieu tri)\b"
PAST_PART = (
    r"\b(?:cac benh ly (?:noi khoa )?man tinh|benh ly man tinh|thuoc truoc khi nhap vien|thuoc truoc nhap vien|cac tap kinh lam sang truoc day|"
    r"tien su phau thuat|cac su kien truoc khi nhap vien|cac dien bien truoc khi nhap vien)\b"
)
PRESENT = r"\b(?:tien su benh hien tai|benh su hien tai|lich su benh hien tai|trieu chung hien tai|ly do nhap vien)\b"
RECENT = 700
PAST_ROLES = ("medical_history", "personal_history", "family_history", "epidemiology_history")


def negated(clause_key: Column, mention_key: Column) -> Column:
    """Whether the last negation cue before or in the mention holds: no exception at it and no contrast after it."""
    context = F.trim(F.concat_ws(" ", clause_key, mention_key))
    scope = F.regexp_extract(context, rf"^.*({NEGATION}.*)$", 1)
    return (scope != "") & ~scope.rlike(NOT_NEGATED) & ~scope.rlike(CONTRAST)


def family(role: Column, line_key: Column, recent_key: Column) -> Column:
    tail = lambda k: F.right(k, F.lit(180)).rlike(FAMILY)
    return F.coalesce(role == "family_history", F.lit(False)) | tail(line_key) | tail(recent_key)


def historical(kind: Column, section: Column, role: Column, clause_key: Column, line_key: Column, recent_key: Column) -> Column:
    local = F.concat_ws(" ", line_key, clause_key)
    recent = lambda n: F.right(recent_key, F.lit(n))
    pre, explicit = section == "pre_admission", local.rlike(HISTORY)
    drug = (
        F.when(local.rlike(CURRENT_DRUG) | recent(180).rlike(CURRENT_DRUG), False)
        .when(local.rlike(PAST_DRUG), True)
        .when(pre, recent_key.rlike(PAST_DRUG) | recent(240).contains("thuoc"))
        .otherwise(recent(450).rlike(PAST_PART))
    )
    present = recent(500).rlike(PRESENT) & (section == "present_illness")
    other = (
        F.when(present & (kind == SYMPTOM), explicit)
        .when(explicit, True)
        .when(present, False)
        .when(pre & (kind == DIAGNOSIS), True)
        .when(pre & (kind == SYMPTOM), recent(350).rlike(HISTORY) | recent(350).rlike(r"\b(?:tap kinh|cac con).*(?:truoc day|vai nam)\b"))
        .otherwise((kind == DIAGNOSIS) & recent(450).rlike(PAST_PART))
    )
    return F.when(role.isin(*PAST_ROLES), True).when(kind == DRUG, drug).otherwise(other)


def windows(text: Column, start: Column, end: Column, first: Column | int = 0) -> Column:
    """struct(before, mention, after): all that the flags of a span depend on, short whatever the length of the note. `first` is
    where the span's case starts: the window doesn't reach beyond it."""
    first = F.lit(first) if isinstance(first, int) else first
    low = F.greatest(first, start - RECENT)
    return F.struct(F.substring(text, low + 1, start - low).alias("before"), F.substring(text, start + 1, end - start).alias("mention"), F.substring(text, end + 1, F.lit(LONG_LINE)).alias("after"))


def flags_of(spans: DataFrame, role: Column | None = None, section: Column | None = None) -> DataFrame:
    """spans (type, window) with negated, family and historical; all false for types without flags and on long lines. A line that
    fills the window to either side is a long one."""
    role, section = role if role is not None else F.lit("document"), section if section is not None else F.lit("document")
    before, mention = F.col("window.before"), F.col("window.mention")
    line = F.substring_index(before, "\n", -1)
    line_chars = F.length(line) + F.length(mention) + F.length(F.substring_index("window.after", "\n", 1))
    flagged = F.col("type").isin(*ASSERTED) & (line_chars < LONG_LINE)
    keys = spans.withColumn("_flagged", F.coalesce(flagged, F.lit(False)))
    key = lambda c: F.when(F.col("_flagged"), normalize_key(c))
    keys = keys.withColumns({"_clause": key(F.regexp_extract(line, "[^.;:]*$", 0)), "_line": key(line), "_mention": key(mention), "_recent": key(before)})
    on = lambda flag: F.coalesce(F.col("_flagged") & flag, F.lit(False))
    flags = {
        "negated": on(negated(F.col("_clause"), F.col("_mention"))),
        "family": on(family(role, F.col("_line"), F.col("_recent"))),
        "historical": on(historical(F.col("type"), section, role, F.col("_clause"), F.col("_line"), F.col("_recent"))),
    }
    return keys.withColumns(flags).drop("_clause", "_line", "_mention", "_recent", "_flagged")


def with_flags(spans: DataFrame, text: str = "text", role: Column | None = None, section: Column | None = None, case_start: Column | None = None) -> DataFrame:
    """flags_of spans (start, end, type, the note's text)."""
    rows = spans.withColumn("window", windows(F.col(text), F.col("start"), F.col("end"), case_start if case_start is not None else 0))
    return flags_of(rows, role, section).drop("window")
