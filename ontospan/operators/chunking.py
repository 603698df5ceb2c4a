"""Chunks for the second proposer: parts of a note of one role, within a size and a load, with offsets that round-trip.

Blocks, cases and sections come from notes as arrays per document. The packing depends on its own earlier choices, so it runs
per note in an Arrow batch function.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.functions.visual import consistent
from ontospan.operators import notes
from ontospan.operators.notes import ADMINISTRATIVE, CASE_NOUNS, ORDINALS

BULLET = ("-", "*", "•")
WORDS = re.compile(r"[^\W\d_]+")
DENSE = 360  # characters under which a group is never cut for its load
# Bullets that begin so are details, not headings.
DETAILS = (
    "vi tri", "muc do", "thoi gian", "tan suat", "chieu xa", "lan toa", "yeu to", "cac yeu to", "trieu chung lien quan", "cac trieu chung", "khong", "cam thay", "duoc", "da", "bat dau",
    "keo dai", "xuat hien",
)
CUES = re.compile(r"[,;:\n]|\b(?:va|hoac|khong|phu nhan)\b")
BREAKS = ("\n\n", "\n", ". ", "; ")


def _key(text: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", consistent(text, fold_case=True)) if not unicodedata.combining(c))
    return re.sub(r"[^\w.%/+:-]+", " ", bare.replace("đ", "d")).strip()


def load(text: str) -> int:
    """How much there is to extract: clause cues and further lines, or the length if that is more."""
    key = _key(text)
    return max(1, len(CUES.findall(key)) + max(0, sum(bool(x.strip()) for x in text.split("\n")) - 1), len(key) // 220)


def segments(text: str, start: int, end: int, least: int = 20) -> list[tuple[int, int]]:
    """A stretch without runs of one word: a segment ends where a run of `least` or more begins and the next begins on the next line."""
    out, at, open_ = [], start, start
    for line in text[start:end].splitlines(keepends=True):
        words = [(m.start(), k) for m in WORDS.finditer(line) if (k := _key(m[0]))]
        runs = (list(g) for _, g in itertools.groupby(words, key=lambda w: w[1]))
        if (run := next((r for r in runs if len(r) >= least), None)) is not None:
            out.append((open_, at + run[0][0]))
            open_ = at + len(line)
        at += len(line)
    out = [(s, e) for s, e in [*out, (open_, end)] if s < e]
    return out or [(start, end)]


def _is_heading(bare: str) -> bool:
    """Whether a bullet is the heading of what follows it."""
    name = bare.lstrip("-*• ").strip()
    key = _key(name.strip("*: "))
    return bool(key) and len(key) <= 90 and not key.startswith(DETAILS) and (name.startswith("**") or name.endswith(":"))


def groups(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Lines that belong together: bullets stay with the line before them, until a line after bullets, a bullet that is a heading,
    or more than `most` characters. Blank lines belong to what is before them."""
    out: list[list[int]] = []
    at, bulleted = start, False
    for line in text[start:end].splitlines(keepends=True):
        stop, bare = at + len(line), line.strip()
        bullet = bare.startswith(BULLET)
        if not bare:
            if out:
                out[-1][1] = stop
        elif not out or (bulleted and not bullet) or (bullet and _is_heading(bare)) or stop - out[-1][0] > most:
            out.append([at, stop])
            bulleted = bullet
        else:
            out[-1][1] = stop
            bulleted = bulleted or bullet
        at = stop
    return [(s, e) for s, e in out] or [(start, end)]


def halves(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A stretch cut after the last break beyond the middle (and beyond 240 characters) of each piece, else at the limit."""
    while start < end:
        stop = min(start + most, end)
        if stop < end:
            window = text[start:stop]
            least = max(240, len(window) // 2)
            stop = max([start + i + len(b) for b in BREAKS if (i := window.rfind(b)) >= least], default=stop)
        yield start, stop
        start = stop
        while start < end and text[start].isspace():
            start += 1


def packed_spans(text: str, start: int, end: int, most: int, most_load: int) -> Iterator[tuple[int, int]]:
    """Groups of lines packed one after the other while they fit in size and load; dense and long groups are cut."""
    if end - start <= most:
        yield start, end
        return
    now: tuple[int, int] | None = None
    for s, e in groups(text, start, end, most):
        n = load(text[s:e])
        too_much = e - s > most or (n > most_load and e - s > DENSE)
        if now and (too_much or e - now[0] > most or load(text[now[0] : e]) > most_load):
            yield now
            now = None
        if too_much:
            yield from halves(text, s, e, min(most, max(DENSE, most * most_load // n)))
        else:
            now = (now[0] if now else s, e)
    if now:
        yield now


def _administrative(text: str) -> bool:
    lines = ((line.strip(), _key(line)) for line in text.splitlines())
    return all(key.startswith(ADMINISTRATIVE) or is_boundary(line, key) for line, key in lines if key.strip("._- "))


def is_boundary(line: str, key: str) -> bool:
    """Whether a line begins another case."""
    numbered = bool(re.match(r"\d+\.\d+\.?\s+", line)) and any(n in key for n in CASE_NOUNS)
    return key.startswith("ma so ho so") or numbered or any(f"{n} thu {o}" in key for n in CASE_NOUNS for o in ORDINALS)


def chunks_of(text: str, blocks: list[dict] | None = None, most: int = 650, most_load: int = 22) -> list[tuple[int, int, str, int, str]]:
    """(start, end, role, case, scope) of the chunks of a note, in order, disjoint, trimmed, and within one case, block and segment.
    Chunks of nothing but administrative lines are left out. A note with no chunk of its own is one chunk; a blank one has none."""
    blocks = blocks or [{"start": 0, "end": len(text), "role": "document", "case_no": 1}]
    out, case, number = [], None, 0
    for b in sorted(blocks, key=lambda b: b["start"]):
        number = number + 1 if b["case_no"] == case else 1
        case = b["case_no"]
        for i, (ss, se) in enumerate(segments(text, b["start"], b["end"]), 1):
            for s, e in packed_spans(text, ss, se, most, most_load):
                s += len(text[s:e]) - len(text[s:e].lstrip())
                e = s + len(text[s:e].rstrip())
                if s < e and not _administrative(text[s:e]):
                    out.append((s, e, b["role"], case, f"case_{case}:block_{number}:segment_{i}"))
    return out or ([(0, len(text), "document", 1, "case_1:block_1:segment_1")] if text.strip() else [])


def units_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of the nonblank lines of a chunk, without blanks around them."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        s, e = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        if s < e:
            out.append((s, e))
        at += len(line)
    return out


def split_chunks(documents: DataFrame, most: int = 650, most_load: int = 22, blocks: DataFrame | None = None, context: int = 240) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, section, start_pos, end_pos, text, structure_role, context_scope, context_before, context_after).

    Chunks are numbered c1, c2, ... in their document. Contexts are the end of the chunk before and the beginning of the one after,
    where these have the same scope. Null and empty texts have no chunks. blocks: notes.structural_blocks, if they are at hand.
    """
    blocks = blocks if blocks is not None else notes.structural_blocks(documents)
    gathered = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "role", "case_no")).alias("blocks"))
    names = notes.sections(documents).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "name")).alias("sections"))
    rows = documents.where(F.length("text") > 0).select("doc_id", "text").join(gathered, "doc_id", "left").join(names, "doc_id", "left")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, chunk_no int, chunk_id string, section string, start_pos int, end_pos int, text string, structure_role string, context_scope string, context_before string, context_after string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def of(d, text: str, bs, sections) -> Iterator[tuple]:
        listed = lambda x: [] if x is None else list(x)
        found = chunks_of(text, listed(bs), most, most_load)
        for i, (s, e, role, case, scope) in enumerate(found):
            name = next((x["name"] for x in listed(sections) if x["start"] <= s < x["end"]), "document")
            before = text[max(found[i - 1][0], found[i - 1][1] - context) : found[i - 1][1]] if i and found[i - 1][4] == scope else ""
            after = text[found[i + 1][0] : min(found[i + 1][1], found[i + 1][0] + context)] if i + 1 < len(found) and found[i + 1][4] == scope else ""
            yield d, i + 1, f"c{i + 1}", f"case_{case}:{name}", s, e, text[s:e], role, scope, before, after

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for row in zip(b.doc_id, b.text, b.blocks, b.sections) for x in of(*row)], columns=columns)

    return rows.mapInPandas(each, schema)


def units(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, unit_no, start, end, text): the nonblank lines of chunks, with offsets in the document."""
    parts = F.split("text", "\n")
    starts = F.transform(parts, lambda x, i: F.length(F.array_join(F.slice(parts, 1, i), "\n")) + (i > 0).cast("int"))
    rows = chunks.where(F.col("text").isNotNull()).select("doc_id", "chunk_id", "start_pos", F.inline(F.arrays_zip(parts.alias("line"), starts.alias("at"))))
    lead = F.length("line") - F.length(F.ltrim("line"))
    rows = rows.where(F.trim("line") != "").select("doc_id", "chunk_id", (F.col("start_pos") + F.col("at") + lead).alias("start"), F.trim("line").alias("text"))
    return rows.select("doc_id", "chunk_id", F.row_number().over(W.partitionBy("doc_id", "chunk_id").orderBy("start")).alias("unit_no"), "start", (F.col("start") + F.length("text")).alias("end"), "text")
