"""Problem 5: oversized texts cut at natural boundaries.

Method: a recursive separator hierarchy (paragraph, line, sentence, clause, word, character). A text is cut at its
coarsest separators, parts that are still too long at the next finer ones, and the parts are packed greedily up to the
limit; each piece after the first begins with the last characters of the one before. Only oversized texts reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, OVERLAP = 650, 60
# Where a unit of each level ends, coarsest first. The separator stays with the unit before it.
ENDS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n\s*", r"[.!?…。]+[\"'”’)\]]*\s+", r"[,;:，；]\s+", r"\s+")]


def _joined(text: str, at: int) -> bool:
    """Whether a cut before position at would part a character from its marks or joiner."""
    return unicodedata.combining(text[at]) != 0 or text[at] in "‍️" or text[at - 1] == "‍"


def _units(text: str, start: int, end: int, room: int, level: int) -> Iterator[int]:
    """Ends of consecutive units of at most `room` characters that cover text[start:end]."""
    if end - start <= room:
        yield end
    elif level == len(ENDS):
        while end - start > room:
            at = start + room
            while at > start + 1 and _joined(text, at):
                at -= 1
            start = at if at > start + 1 or room == 1 else start + room  # a run of marks longer than the room is cut anyway
            yield start
        yield end
    else:
        for at in [*(m.end() for m in ENDS[level].finditer(text, start, end) if m.end() < end), end]:
            yield from _units(text, start, at, room, level + 1)
            start = at


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a text. A text within the limit is one piece; an empty one has none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    pieces, start, done = [], 0, 0
    for end in _units(text, 0, len(text), limit - overlap, 0):
        if end - start > limit:
            pieces.append((start, done))
            start = max(0, done - overlap)
        done = end
    return [*pieces, (start, done)] if text else []


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, piece_no, n_pieces, start_pos, end_pos, text) of all chunks with text.

    Positions are in the document; a null start_pos gives null positions. Repeated rows count once. Null and empty texts have
    no pieces. Texts within the limit are passed through in the JVM.
    """
    rows = chunks.select("chunk_id", "doc_id", F.col("start_pos").cast("long").alias("start_pos"), "text").where(F.length("text") > 0).distinct()
    schema = "chunk_id long, doc_id long, piece_no int, n_pieces int, start_pos long, end_pos long, text string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, doc, first, text in zip(batch.chunk_id, batch.doc_id, batch.start_pos, batch.text):
                spans = cut(text, limit, overlap)
                out += [(chunk, doc, i, len(spans), first + s, first + e, text[s:e]) for i, (s, e) in enumerate(spans)]
            frame = pd.DataFrame(out, columns=["chunk_id", "doc_id", "piece_no", "n_pieces", "start_pos", "end_pos", "text"])
            yield frame.astype({c: "Int64" for c in ("chunk_id", "doc_id", "start_pos", "end_pos")})

    whole = rows.where(F.length("text") <= limit).select("chunk_id", "doc_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "start_pos", (F.col("start_pos") + F.length("text")).alias("end_pos"), "text")
    return whole.unionByName(rows.where(F.length("text") > limit).mapInPandas(each, schema))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf}/chunks.parquet"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("chunk_id").distinct()
