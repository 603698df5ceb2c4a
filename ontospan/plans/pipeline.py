"""The end-to-end plan: notes to validated concepts, keyed by document.

Notes are cut into structural blocks and chunks; rule and model proposals are gated, merged, flagged, coded, passed through
rule tables and the emission policy, repaired, deduplicated and validated. Tables of rules and curated codes are inputs:
the plan has no rules of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.config import CODED, FLAGS, Settings
from ontospan.functions.text import line_length, line_profile, normalize_key
from ontospan.operators import assertions, chunking, notes, policy, proposals, proposer, retrieval, spans
from ontospan.session import cut

# Roles in which rule spans need the second proposer.
UNCONFIRMED = ["question", "answer", "medical_article"]


@dataclass
class Tables:
    """Optional inputs. drops: rules by which a concept is noise; called_for: rules by which the words around a condition call for
    a code; both see policy.around, `historical` and `family` (as `true` or empty). policy, profiles, curated, overrides, rejected: see policy.applied
    and retrieval. allowed (alias_norm): conditions that may be coded on long lines. patient_cues: without one, plain documents
    and articles aren't sent to the second proposer."""

    drops: Sequence[policy.Rule] = ()
    called_for: Sequence[policy.Rule] = ()
    policy: DataFrame | None = None
    profiles: DataFrame | None = None
    curated: DataFrame | None = None
    overrides: DataFrame | None = None
    rejected: DataFrame | None = None
    allowed: DataFrame | None = None
    patient_cues: Sequence[str] = ()


def proposals_of(documents: DataFrame, lexicon: DataFrame, ask: proposer.Proposer, settings: Settings, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(proposals (doc_id, start, end, type, score, source), blocks): rule spans that pass the gate, and aligned model spans. An error if
    the proposer left a chunk unanswered."""
    cols = ["doc_id", "start", "end", "type", "score"]
    blocks = cut(notes.structural_blocks(documents))
    placed = blocks.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.col("role").alias("structure_role"))
    chunks = chunking.split_chunks(documents, settings.chunk_chars, settings.chunk_load, blocks).drop("chunk_id").withColumnRenamed("chunk_no", "chunk_id")
    if tables.patient_cues:
        chunks = chunks.where(~notes.needs_patient(F.col("structure_role"), F.col("text"), list(tables.patient_cues)))
    said = proposer.proposed(chunks, ask).where((F.col("reason") == "ok") | proposer.unanswered(F.col("reason")))
    said = said.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", F.col("confidence").alias("score"), "reason")
    said = proposer.answered(cut(proposer.best_mentions(said, "reason")))  # read by the gate and the merge
    resolved = spans.resolve_overlaps(proposals.all_rules(documents, lexicon))
    gated = spans.gate(resolved, placed, said, UNCONFIRMED)
    return gated.select(*cols, F.lit("rule").alias("source")).unionByName(said.select(*cols, F.lit("llm").alias("source"))), blocks


def annotated(documents: DataFrame, lexicon: DataFrame, kb: DataFrame, ask: proposer.Proposer | None = None, settings: Settings | None = None, tables: Tables | None = None) -> DataFrame:
    """(doc_id, start, end, text, type, assertions, candidates, problems) of all concepts of all notes.

    ask: the second proposer, by default the one that the settings name. Steps that need no more than the spans run on narrow
    rows; the note's text is joined back once, per document, and short windows are cut from it. problems is empty for a
    valid concept. Null and empty texts give nothing. If the proposer fails, so does the plan: without an answer, concepts that
    the proposer alone finds or confirms would be missing unseen.
    """
    settings, tables = settings or Settings(), tables or Tables()
    if ask is None:
        if settings.proposer != "lexicon":
            raise ValueError(f"give ask: no proposer is built in by the name {settings.proposer}")
        ask = proposer.lexicon_proposer(proposer.lexicon_terms(lexicon))
    found, blocks = proposals_of(documents, lexicon, ask, settings, tables)
    merged = cut(notes.with_parts(spans.drop_nested(spans.merge_proposals(found)), documents, blocks))
    per_doc = merged.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "role", "section", "case_start")).alias("xs"))
    note = F.col("note")
    needed = {"mention"} | policy.looked_at(tables.drops, tables.called_for)  # keys of long windows take long, and most have no rule
    seen = lambda x: F.struct(
        *(x[c].alias(c) for c in ("start", "end", "type", "role", "section")), assertions.windows(note, x["start"], x["end"], x["case_start"]).alias("window"),
        line_length(note, x["start"], x["end"]).alias("line_chars"), F.length(note).alias("n_chars"), *(c.alias(f"near_{n}") for n, c in policy.around(note, x["start"], x["end"]).items() if n in needed),
    )
    placed = documents.select("doc_id", F.col("text").alias("note")).join(per_doc, "doc_id").select("doc_id", F.inline(F.transform("xs", seen)))
    flagged = assertions.flags_of(placed, F.col("role"), F.col("section"))
    listed = F.filter(F.array(*(F.when(F.col(c), F.lit(f)) for c, f in zip(("negated", "family", "historical"), FLAGS))), lambda x: x.isNotNull())
    fields = {n: F.col(f"near_{n}") for n in ("mention", "before", "after", "prefix", "line", "wide") if n in needed} | {n: F.when(F.col(n), "true") for n in ("historical", "family")}
    rows = flagged.where(policy.first_result(tables.drops, F.col("type"), fields).isNull())
    rows = rows.select(
        "doc_id", "start", "end", F.col("window.mention").alias("text"), "type", policy.repaired_flags(F.col("type"), listed).alias("assertions"), F.col("near_mention").alias("alias_norm"),
        line_profile(F.col("line_chars")).alias("profile"), "line_chars", "n_chars", policy.first_result(tables.called_for, F.col("type"), fields).alias("called_for"),
    )
    rows = cut(rows)  # narrow: the note's text is gone by now
    if tables.allowed is not None:
        rows = rows.join(tables.allowed.select("alias_norm", F.lit(True).alias("allowed")).distinct(), "alias_norm", "left")
    rows = rows.withColumn("eligible", retrieval.eligible(F.col("type"), F.col("alias_norm"), F.col("line_chars"), F.coalesce("allowed", F.lit(False)) if tables.allowed is not None else None))
    mentions = rows.where(F.col("type").isin(*CODED)).select(F.col("type").alias("concept_type"), "text").distinct()
    codes = cut(retrieval.select_codes(retrieval.lookup(mentions, kb, settings.lookup_limit, tables.curated), kb, tables.overrides, tables.rejected, mentions).withColumnRenamed("concept_type", "type"))
    out = rows.join(codes, ["type", "text"], "left")
    out = out.withColumn("candidates", F.when(F.col("type").isin(*CODED), F.filter(F.array(F.when(F.col("eligible"), F.col("code"))), lambda x: x.isNotNull()))).drop("code")
    out = out.withColumnRenamed("type", "concept_type")
    if tables.policy is not None:
        out = policy.applied(out, tables.policy, tables.profiles)
    elif tables.profiles is not None:
        out = retrieval.profile_codes(out, tables.profiles).withColumn("emitted", F.coalesce("profile_codes", "candidates")).drop("profile_codes")
    else:
        out = out.withColumn("emitted", F.col("candidates"))
    # nothing emitted stays nothing, whatever the words around it
    out = out.withColumnRenamed("concept_type", "type").withColumn("candidates", F.when((F.size("emitted") > 0) & F.col("called_for").isNotNull(), F.array("called_for")).otherwise(F.col("emitted")))
    if settings.repair_empty_candidates:
        out = policy.repaired(out, codes.join(out.where("eligible").select("type", "text").distinct(), ["type", "text"], "left_semi"))
    out = spans.dedupe_best(out.withColumn("row_id", F.xxhash64("doc_id", "start", "end", "type")), keep=["text", "assertions", "n_chars"])
    wrong = policy.problems(F.col("type"), F.col("text"), F.col("start"), F.col("end"), F.col("text"), F.col("n_chars"), F.col("assertions"), F.col("candidates"))
    return out.select("doc_id", "start", "end", "text", "type", "assertions", "candidates", wrong.alias("problems"))


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    out = annotated(read("documents"), read("lexicon"), read("kb_records"))
    return out.select("doc_id", "start", "end", "text", "type", F.array_join("assertions", "|").alias("assertions"), F.array_join("candidates", "|").alias("codes"), F.array_join("problems", "|").alias("problems"))


QUERIES = {"annotated_concepts": concepts}
SQL: dict[str, str] = {}
