"""Evaluation of predictions against gold: bag counts, set scores, matching, corpus score, outcomes of mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.functions.text import jaccard, normalize_key, span_iou, token_score, tokens


def bag_counts(gold: DataFrame, predicted: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """Per group the multiset counts tp, fp, fn of items, as in bag intersection and difference."""
    side = lambda df, g, p: df.select(*group, *item, F.lit(g).alias("g"), F.lit(p).alias("p"))
    counts = side(gold, 1, 0).unionByName(side(predicted, 0, 1)).groupBy(*group, *item).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return counts.groupBy(*group).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("p") - F.col("g"))).alias("fp"), F.sum(F.greatest(F.lit(0), F.col("g") - F.col("p"))).alias("fn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of counts; 0 where the denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 6))


def set_scores(pairs: DataFrame, gold: str, predicted: str, group: list[str] | None = None) -> DataFrame:
    """Of pairs of sets: exact rate, mean Jaccard, Jaccard weighted by gold size + 1, and the share with any prediction."""
    g, p = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (gold, predicted))
    rows = pairs.select(*(group or []), jaccard(g, p).alias("j"), (F.size(g) + 1).alias("w"), (F.size(p) > 0).cast("int").alias("some"), (F.size(F.array_union(g, p)) == F.size(F.array_intersect(g, p))).cast("int").alias("same"))
    out = [F.count("*").alias("n"), F.round(F.avg("same"), 6).alias("exact"), F.round(F.avg("j"), 6).alias("mean_jaccard"), F.round(F.sum(F.col("j") * F.col("w")) / F.sum("w"), 6).alias("weighted_jaccard"), F.round(F.avg("some"), 6).alias("nonempty")]
    return rows.groupBy(*group).agg(*out) if group else rows.agg(*out)


def scored_pairs(gold: DataFrame, predicted: DataFrame, least: float = 0.25) -> DataFrame:
    """(doc_id, gold_index, pred_index, score) of pairs of one document and type: 0.7 overlap + 0.3 likeness of text.

    Tables have doc_id, idx, type, start, end, text. To reach a least score of 0.25, or any above 0, spans must overlap or texts
    share a word; so pairs meet by stretches of 64 characters and by words, and not all with all.
    """
    words = lambda c: tokens(normalize_key(F.coalesce(c, F.lit(""))))
    stretches = F.transform(F.sequence(F.floor(F.col("start") / 64), F.floor(F.greatest("start", F.col("end") - 1) / 64)), lambda b: F.concat(F.lit("#"), b.cast("string")))

    def met(df: DataFrame, side: str) -> DataFrame:
        rows = df.select("doc_id", "type", F.struct("idx", "start", "end", words(F.col("text")).alias("words")).alias(side), stretches.alias("s"))
        return rows.select("doc_id", "type", side, F.explode(F.array_distinct(F.concat(F.coalesce("s", F.array().cast("array<string>")), f"{side}.words"))).alias("meet"))

    pairs = met(gold, "g").join(met(predicted, "p"), ["doc_id", "type", "meet"]).drop("meet").distinct()
    overlap = F.coalesce(span_iou(F.col("g.start"), F.col("g.end"), F.col("p.start"), F.col("p.end")), F.lit(0.0))  # a null place overlaps nothing
    score = 0.7 * overlap + 0.3 * token_score(F.col("g.words"), F.col("p.words"))
    return pairs.select("doc_id", F.col("g.idx").alias("gold_index"), F.col("p.idx").alias("pred_index"), F.round(score, 9).alias("score")).where(F.col("score") >= least)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One use of each index: pairs are taken by score, then gold and predicted index. Pairs
    that are the best of both their indexes are taken at once; what then remains open, usually little, is folded by document."""
    item = F.struct((-F.col("score")).alias("o"), "gold_index", "pred_index", "score")
    per_doc = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = per_doc.select("doc_id", F.posexplode("items").alias("n", "x")).select("doc_id", "n", "x.*")
    # a pair that is the first of both its indexes is taken whatever comes before; the fold sees only the others' documents
    first = lambda c: F.min("n").over(W.partitionBy("doc_id", c))
    marked = rows.withColumn("g", first("gold_index")).withColumn("p", first("pred_index")).withColumn("sure", (F.col("n") == F.col("g")) & (F.col("n") == F.col("p")))
    taken_by = lambda c: F.min(F.when(F.col("sure"), F.col("n"))).over(W.partitionBy("doc_id", c))
    open_ = marked.withColumn("gs", taken_by("gold_index")).withColumn("ps", taken_by("pred_index"))
    out = ["doc_id", "gold_index", "pred_index", "score"]
    sure = open_.where("sure").select(*out)
    left = open_.where("NOT sure AND gs IS NULL AND ps IS NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["gold_index"] == x["gold_index"]) | (y["pred_index"] == x["pred_index"]))
    taken = F.aggregate("items", F.filter("items", lambda x: F.lit(False)), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return sure.unionByName(left.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.gold_index", "x.pred_index", "x.score"))


def document_scores(gold: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: matched, missing, extra, text, assertion and candidate scores; a missing or extra concept scores 0."""
    cols = ["doc_id", "idx", "text", "assertions", "candidates"]
    g, p = gold.select(*cols).alias("g"), predicted.select(*cols).alias("p")
    both = g.join(matches.alias("m"), (F.col("g.doc_id") == F.col("m.doc_id")) & (F.col("g.idx") == F.col("m.gold_index")), "left").select(F.struct("g.*").alias("g"), F.col("g.doc_id").alias("gd"), F.col("m.pred_index").alias("pi"))
    full = both.join(p, (F.col("gd") == F.col("p.doc_id")) & (F.col("pi") == F.col("p.idx")), "full")
    has_g, has_p = F.col("gd").isNotNull(), F.col("p.doc_id").isNotNull()
    words = lambda c: tokens(normalize_key(F.coalesce(c, F.lit(""))))
    codes = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    both_sides = lambda x: F.when(has_g & has_p, x).otherwise(0.0)
    weight = F.when(has_g, F.size(codes(F.col("g.candidates")))).otherwise(F.size(codes(F.col("p.candidates")))) + 1
    rows = full.select(
        F.coalesce("gd", "p.doc_id").alias("doc_id"), has_g.alias("has_g"), has_p.alias("has_p"), weight.alias("w"),
        both_sides(token_score(words(F.col("g.text")), words(F.col("p.text")))).alias("text"),
        both_sides(jaccard(codes(F.col("g.assertions")), codes(F.col("p.assertions")))).alias("assertion"),
        both_sides(jaccard(codes(F.col("g.candidates")), codes(F.col("p.candidates")))).alias("candidate"),
    )
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("has_g") & F.col("has_p")).alias("matched"), F.count_if(~F.col("has_p")).alias("missing"), F.count_if(~F.col("has_g")).alias("extra"),
        F.avg("text").alias("text_score"), F.avg("assertion").alias("assertion_score"), F.sum(F.col("candidate") * F.col("w")).alias("candidate_numerator"), F.sum("w").alias("candidate_denominator"),
    )


def corpus_score(documents: DataFrame) -> DataFrame:
    """30 % text, 30 % assertion, 40 % candidates, out of 100; the mean of nothing is 1."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    text, flags, codes = one(F.avg("text_score")), one(F.avg("assertion_score")), one(F.sum("candidate_numerator") / F.sum("candidate_denominator"))
    return documents.agg(F.count("*").alias("n_documents"), F.round(100 * text, 4).alias("text_score"), F.round(100 * flags, 4).alias("assertion_score"), F.round(100 * codes, 4).alias("candidate_score"), F.round(100 * (0.3 * text + 0.3 * flags + 0.4 * codes), 4).alias("final_score"))


def mapping_outcome(expected: Column, predicted: Column, known: Column, retrieved: Column, gated: Column | None = None) -> Column:
    """What became of a mention: expected and predicted codes, whether any expected code is in the terminology, retrieved codes,
    and whether the context forbade a code."""
    none = lambda a: F.size(a) == 0
    same = F.size(F.array_except(expected, predicted)) + F.size(F.array_except(predicted, expected)) == 0
    return (
        F.when(none(expected), F.when(none(predicted), "correct_abstain").otherwise("false_positive"))
        .when(same, "exact")
        .when(F.arrays_overlap(expected, predicted), "partial")
        .when(~known, "kb_missing")
        .when(~F.arrays_overlap(expected, retrieved), F.when(none(retrieved), "retrieval_miss").otherwise("retrieval_wrong"))
        .when(none(predicted) & (F.coalesce(gated, F.lit(False)) if gated is not None else F.lit(False)), "context_gate_abstain")
        .when(none(predicted), "selector_abstain")
        .otherwise("selector_wrong")
    )


def run_summary(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Count, mean, median and interpolated 95th percentile."""
    out = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95")]
    return rows.groupBy(*group).agg(*out) if group else rows.agg(*out)


def layered_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(layer, type, tp, fp, fn, precision, recall, f1): concepts by place, by place and type, and by text and type, of each type and
    of all (null). Tables have doc_id, type, start, end, text."""
    layers = {"boundary": ["start", "end"], "exact": ["start", "end", "type"], "text": ["type", "text"]}
    parts = []
    for name, item in layers.items():
        rows = lambda t: t.select("doc_id", *item).withColumn("_kind", F.col("type") if "type" in item else F.lit(None).cast("string"))  # noqa: B023, E731
        counts = bag_counts(rows(gold), rows(predicted), ["_kind"], ["doc_id", *item]).select(F.col("_kind").alias("type"), "tp", "fp", "fn")
        totals = counts.groupingSets([["type"], []], "type").agg(F.grouping("type").alias("all"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        parts.append(precision_recall(totals.where("all = 1 OR type IS NOT NULL").drop("all")).withColumn("layer", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_rows(gold: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, gold_index, pred_index, error): a row per kind of error of each concept: text, assertions, candidates, missing, extra."""
    g, p = (t.select(F.struct("doc_id", "idx", "text", "assertions", "candidates").alias(n)) for t, n in ((gold, "g"), (predicted, "p")))
    m = matches.select("doc_id", "gold_index", "pred_index")
    found = m.join(g, (F.col("g.doc_id") == m.doc_id) & (F.col("g.idx") == m.gold_index)).join(p, (F.col("p.doc_id") == m.doc_id) & (F.col("p.idx") == m.pred_index))
    same = lambda c: F.array_sort(F.array_distinct(F.coalesce(f"g.{c}", F.array().cast("array<string>")))) == F.array_sort(F.array_distinct(F.coalesce(f"p.{c}", F.array().cast("array<string>"))))
    kinds = F.array(F.when(~F.col("g.text").eqNullSafe(F.col("p.text")), F.lit("text")), *(F.when(~same(c), F.lit(c)) for c in ("assertions", "candidates")))
    wrong = found.select(m.doc_id, "gold_index", "pred_index", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("error"))
    alone = lambda t, mine, other, name: t.select("doc_id", F.col("idx").alias(mine)).join(m, ["doc_id", mine], "left_anti").select("doc_id", mine, F.lit(None).cast("int").alias(other), F.lit(name).alias("error"))
    return wrong.unionByName(alone(gold, "gold_index", "pred_index", "missing")).unionByName(alone(predicted, "pred_index", "gold_index", "extra"))


def gold_draft(predicted: DataFrame) -> DataFrame:
    """predicted as a queue for review: numbered in order of place within a document, each row open, with the fields to decide on."""
    order = W.partitionBy("doc_id").orderBy("start", "end", "type", "idx")
    return predicted.select("doc_id", (F.row_number().over(order) - 1).alias("queue_no"), "text", "type", "start", "end", F.lit("open").alias("status"), F.col("candidates").isNotNull().alias("needs_code"))


def mapping_stats(rows: DataFrame, group: list[str], ks: tuple[int, ...] = (1, 5, 30)) -> DataFrame:
    """Per set of the columns in `group`, from the finest to all rows: hit@k, coverage, weighted Jaccard, that of giving no code at
    all, and the lift over it. rows: the group's columns, expected and predicted code sets, hits (codes found, best first), known
    (whether the terminology has an expected code). hit@k and coverage are of rows with an expected code."""
    empty = F.array().cast("array<string>")
    e, p = F.array_distinct(F.coalesce("expected", empty)), F.array_distinct(F.coalesce("predicted", empty))
    some, w = F.size(e) > 0, F.size(e) + 1
    at = {f"hit_{k}": F.when(some, F.arrays_overlap(e, F.slice(F.coalesce("hits", empty), 1, k)).cast("int")) for k in ks}
    flat = rows.select(*group, *(c.alias(n) for n, c in at.items()), F.when(some, F.col("known").cast("int")).alias("known"), w.alias("w"), jaccard(e, p).alias("j"), (F.size(e) == 0).cast("int").alias("none"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    score, baseline = F.sum(F.col("w") * F.col("j")) / F.sum("w"), F.sum(F.col("w") * F.col("none")) / F.sum("w")
    sets = [group[:i] for i in range(len(group), -1, -1)]
    return flat.groupingSets(sets, *group).agg(F.count("*").alias("n"), *(mean(n).alias(n) for n in at), mean("known").alias("coverage"), F.round(score, 6).alias("weighted_jaccard"), F.round(baseline, 6).alias("baseline"), F.round(score - baseline, 6).alias("lift"))


def top_errors(rows: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent pairs of text and outcome that aren't right, as a report; ties by text and outcome."""
    wrong = rows.where(~F.col("outcome").isin("exact", "correct_abstain")).groupBy("text", "outcome").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.col("n").desc(), "text", "outcome").limit(most)


def worst_files(rows: DataFrame, most: int = 20) -> DataFrame:
    """The files with the lowest weighted Jaccard, as a report; ties by file. Files without a row with codes on either side don't count."""
    empty = F.array().cast("array<string>")
    e, p = F.array_distinct(F.coalesce("expected", empty)), F.array_distinct(F.coalesce("predicted", empty))
    per = rows.where((F.size(e) > 0) | (F.size(p) > 0)).select("file", jaccard(e, p).alias("j"), (F.size(e) + 1).alias("w"))
    return per.groupBy("file").agg(F.round(F.sum(F.col("j") * F.col("w")) / F.sum("w"), 6).alias("weighted_jaccard"), F.count("*").alias("n")).orderBy("weighted_jaccard", "file").limit(most)


def bad_positions(rows: DataFrame, may_be_empty: bool = True) -> DataFrame:
    """(concept_id) of rows whose char_position isn't a pair of numbers in order; evaluators allow equal ones, a validator doesn't."""
    a, b = F.get("char_position", F.lit(0)), F.get("char_position", F.lit(1))
    good = (F.size("char_position") == 2) & (a >= 0) & ((a <= b) if may_be_empty else (a < b))
    return rows.where(~F.coalesce(good, F.lit(False))).select("concept_id").distinct()
