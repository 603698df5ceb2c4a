"""Curation of labelled concepts: edits by position, code replacements, and transfer to another version of a note."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospan.operators.spans import greedy

KEY = ["doc_id", "start", "end"]


def edited(concepts: DataFrame, edits: DataFrame) -> DataFrame:
    """concepts (doc_id, start, end, type, candidates) after edits (doc_id, start, end, action, type, candidates, edit_no).

    The last edit of a place counts: `remove` drops its concepts, `update` changes those there, `add` adds one where nothing
    overlaps, neither a concept nor an earlier `add`. Edits of places that don't exist, and other actions, change nothing.
    """
    last = edits.where(F.col("action").isin("remove", "update", "add")).groupBy(*KEY).agg(F.max_by(F.struct("action", F.col("type").alias("new_type"), F.col("candidates").alias("new_candidates"), "edit_no"), "edit_no").alias("e"))
    there = concepts.join(last, KEY, "left").where("e IS NULL OR e.action <> 'remove'")
    changed = F.col("e.action") == "update"
    kept = there.select(*KEY, F.when(changed, F.coalesce("e.new_type", "type")).otherwise(F.col("type")).alias("type"), F.when(changed, F.coalesce("e.new_candidates", "candidates")).otherwise(F.col("candidates")).alias("candidates"))
    k, a = kept.select(F.col("doc_id").alias("kd"), F.col("start").alias("ks"), F.col("end").alias("ke")), last.where("e.action = 'add'")
    added = a.join(k, (F.col("doc_id") == F.col("kd")) & (F.col("ks") < F.col("end")) & (F.col("start") < F.col("ke")), "left_anti")
    added = greedy(added, "doc_id", [F.col("e.edit_no"), F.col("start"), F.col("end")], ["start", "end", "e"])
    return kept.unionByName(added.select(*KEY, F.col("e.new_type").alias("type"), F.col("e.new_candidates").alias("candidates")))


def replaced_codes(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """candidates with old codes replaced by new ones (old_code, new_code), in place and without repeats."""
    rows = concepts.select("concept_id", F.posexplode("candidates").alias("i", "old_code")).join(mapping.groupBy("old_code").agg(F.min("new_code").alias("new_code")), "old_code", "left")
    listed = rows.groupBy("concept_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new_code", "old_code").alias("code")))), lambda x: x["code"])).alias("new_candidates"))
    return concepts.join(listed, "concept_id", "left").withColumn("candidates", F.coalesce("new_candidates", "candidates")).drop("new_candidates")


def moved(old: str, new: str, spans: list[tuple[int, int]], least: int = 3) -> list[tuple[int, int] | None]:
    """Where spans of an old text are in a new one: within blocks of at least `least` equal words; None where they aren't."""
    parts = [[(m.start(), m.end()) for m in re.finditer(r"\w+", t)] for t in (old, new)]
    words = [[t[s:e].casefold() for s, e in p] for t, p in zip((old, new), parts)]
    blocks = [b for b in SequenceMatcher(None, *words, autojunk=False).get_matching_blocks() if b.size >= least]
    out: list[tuple[int, int] | None] = []
    for s, e in spans:
        inside = [i for i, (ws, we) in enumerate(parts[0]) if ws < e and s < we]
        block = next((b for b in blocks if inside and b.a <= inside[0] and inside[-1] < b.a + b.size), None)
        if block is None:
            out.append(None)
            continue
        shift = block.b - block.a
        first, last = parts[1][inside[0] + shift], parts[1][inside[-1] + shift]
        out.append((first[0] + s - parts[0][inside[0]][0], last[1] + e - parts[0][inside[-1]][1]))
    return out


def transferred(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, old_start, old_end, start, end) of the spans (array of struct start, end) of pairs of old and new texts that are found again."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, old, new, spans in zip(batch.doc_id, batch.old_text, batch.new_text, batch.spans):
                if old is None or new is None or spans is None:
                    continue
                given = [(x["start"], x["end"]) for x in spans]
                rows += [(d, *a, *b) for a, b in zip(given, moved(old, new, given, least)) if b is not None]
            yield pd.DataFrame(rows, columns=["doc_id", "old_start", "old_end", "start", "end"])

    return pairs.select("doc_id", "old_text", "new_text", "spans").mapInPandas(each, "doc_id long, old_start int, old_end int, start int, end int")
