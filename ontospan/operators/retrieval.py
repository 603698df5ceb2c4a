"""Codes for mentions: query variants, equality joins to the alias index, lexical search, selection and gates.

Every distinct mention is looked up once and joined back to its occurrences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG, LONG_LINE
from ontospan.functions import rx
from ontospan.functions.text import char_ngrams, condition_tokens, key_similarity, normalize_key
from ontospan.operators import terminology
from ontospan.session import cut, is_small

SMALL_DOCS = 20_000  # aliases that are broadcast with their tokens and grams

# Rewrites of the names of conditions, the penalties of sources, the least scores of selection.
PREFIXES = r"^(?:chan doan mac benh|chan doan|duoc chan doan mac benh|duoc chan doan|mac benh|benh|theo doi|nghi ngo) "
SUFFIXES = r" (?:khong xac dinh|khong dac hieu|unspecified|nos)$"
LEAST = {"diagnosis": 0.82, "diagnosis_lexical": 0.78, "medication_lexical": 0.82, "drug": 0.70}
MARGIN = 0.04
SPELLING = [
    ("sung huyet", "xung huyet"), ("tieu duong", "dai thao duong"), ("da day thuc quan", "da day - thuc quan"), ("khong dac hieu", "khong xac dinh"), ("tuyp", "type"),
    (r"\bdtd\b", "dai thao duong"), (r"\bgut\b", "gout"), (r"\bvkdt\b", "viem khop dang thap"), (r"\btang\s+ha\b", "tang huyet ap"),
    (r"\btang\s+huyet+t\s+ap\b", "tang huyet ap"), (r"\btyp\s*ii\b", "type 2"), (r"\b(man|cap)\b(?! tinh\b)", "$1 tinh"),
]
MEASURES = [(r"\b\d+(?:[.,-]\d+)?\s*%(?!\w)", " "), (r"\b(?:m?rs|abcd2|balthazar)\s*\w*\b", " "), (r"\b\d+\s*(?:d|diem)\b", " ")]
SETTING = [(r"^(?:theo doi|nghi ngo|tien su|co tien su)\s+", ""), (r"\s+(?:gio thu|cach day)\s+\d+\b.*$", "")]
HISTORY_PREFIX = r"^(?:tien su|co tien su|duoc phat hien|phat hien|dang dieu tri|da dieu tri) "
QUALIFIER = {"stage": (0.16, -0.25, -0.45), "acuity": (0.08, -0.16, -0.30), "side": (0.10, -0.18, -0.35), "kind": (0.10, -0.20, -0.35)}  # equal, missing, other
VAGUE = (0.08, -0.10, -0.08)  # both vague, only the mention, only the name where the mention has a qualifier
STAGES = {"cuoi": "5", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}
PENALTY = {
    "exact": 0.0, "drug_unit": 0.005, "drug_no_count": 0.015, "drug_core": 0.03, "drug_no_release_token": 0.04, "drug_ingredient": 0.12, "drug_context_core": 0.035,
    "drug_context_ingredient": 0.10, "diagnosis_core": 0.02, "diagnosis_canonical": -0.03, "diagnosis_unspecified": 0.03, "diagnosis_spelling": 0.04, "diagnosis_chronic_shorthand": 0.045,
    "diagnosis_with_benh_prefix": 0.05,
}


def core(key: Column) -> Column:
    return F.regexp_replace(key, PREFIXES, "")


def spelled(key: Column) -> Column:
    return rx.rewritten(key, SPELLING)


def unspecific(key: Column) -> Column:
    return F.regexp_replace(key, SUFFIXES, "")


def without_measures(key: Column) -> Column:
    """A condition's key without shares, named scores and points."""
    return rx.squeezed(rx.rewritten(key, MEASURES))


def without_setting(key: Column) -> Column:
    """A condition's key without what says how it is known or when it was."""
    return rx.squeezed(rx.rewritten(key, SETTING))


def search_key(key: Column) -> Column:
    return rx.squeezed(F.regexp_replace(unspecific(core(spelled(key))), HISTORY_PREFIX, ""))


def search_keys(text: Column) -> Column:
    """The distinct keys under which a condition is searched for by likeness."""
    key = normalize_key(text)
    forms = [key, core(key), spelled(key), unspecific(key), without_measures(key), without_setting(key)]
    return F.array_distinct(F.filter(F.array(*(search_key(k) for k in forms)), lambda k: k != ""))


def variants(text: Column, kind: Column, canonical: Column | None = None) -> Column:
    """Array of struct(rank, source, key): the distinct keys under which a mention is looked up, the first source of each. canonical: the
    name that a table of canonical names has for a condition; it comes first."""
    key = normalize_key(text)
    drug = rx.normalize_rx(text)
    drug_core, context = rx.without_route(drug), rx.without_context(drug)
    of_drug = [
        ("drug_unit", drug), ("drug_no_count", rx.without_count(drug)), ("drug_core", drug_core), ("drug_no_release_token", rx.without_release(drug_core)),
        ("drug_ingredient", rx.without_modifiers(drug)), ("drug_context_core", context), ("drug_context_ingredient", rx.without_modifiers(context)),
    ]
    of_condition = [
        ("diagnosis_core", core(key)), ("diagnosis_spelling", spelled(key)), ("diagnosis_unspecified", unspecific(key)),
        ("diagnosis_chronic_shorthand", F.regexp_replace(key, SPELLING[-1][0], SPELLING[-1][1])), ("diagnosis_with_benh_prefix", F.concat(F.lit("benh "), key)),
    ]
    first = [("diagnosis_canonical", F.coalesce(canonical, F.lit("")))] if canonical is not None else []
    listed = lambda pairs: F.array(*(F.struct(F.lit(s).alias("source"), k.alias("key")) for s, k in pairs))
    every = F.when(kind == DRUG, listed([("exact", key), *of_drug])).when(kind == DIAGNOSIS, listed([*first, ("exact", key), *of_condition]))
    # bound to a variable by the outer transform, as it would be worked out for every element otherwise
    firsts = lambda all_: F.filter(all_, lambda x, i: (x["key"] != "") & (F.array_position(F.transform(all_, lambda y: y["key"]), x["key"]) == i + 1))
    return F.get(F.transform(F.array(every), firsts), 0)


def with_adjustment(rows: DataFrame, query: str, candidate: str, into: str) -> DataFrame:
    """rows with the reward of matching stage, acuity, side and type of two names, and the penalty of missing and conflicting ones.

    Every qualifier is a column of its own for a while, so that long expressions aren't repeated in the generated code.
    """
    stage = lambda k: F.regexp_extract(k, r"\bgiai doan\s+(cuoi|[1-5]|i{1,3}|iv|v)\b", 1)
    arabic = lambda s: reduce(lambda c, kv: F.when(s == kv[0], kv[1]).otherwise(c), STAGES.items(), s)
    acuity = lambda k: F.when(k.rlike(r"\bcap(?: tinh)?\b"), "acute").when(k.rlike(r"\bman(?: tinh)?\b"), "chronic").otherwise("")
    side = lambda k: F.when(k.rlike(r"\b(?:hai ben|bilateral)\b"), "both").when(k.rlike(r"\b(?:trai|left)\b"), "left").when(k.rlike(r"\b(?:phai|right)\b"), "right").otherwise("")
    kind = lambda k: F.regexp_extract(k, r"\b(?:type|tip)\s*([12])\b", 1)
    vague = lambda k: k.rlike(r"\b(?:khong xac dinh|khong dac hieu|unspecified|nos)\b")
    out = rows.withColumns({"_q0": spelled(normalize_key(F.col(query))), "_c0": spelled(normalize_key(F.col(candidate)))})
    parts = {"stage": stage, "acuity": acuity, "side": side, "kind": kind, "vague": vague}
    out = out.withColumns({f"_{x}_{n}": f(F.col(f"_{x}0")) for x in "qc" for n, f in parts.items()})
    out = out.withColumns({f"_{x}_stage": arabic(F.col(f"_{x}_stage")) for x in "qc"})
    total, stated = F.lit(0.0), F.lit(False)
    for n, (match, missing, conflict) in QUALIFIER.items():
        q, c = F.col(f"_q_{n}"), F.col(f"_c_{n}")
        total += F.when(q == "", 0.0).when(c == "", missing).when(q == c, match).otherwise(conflict)
        stated = stated | (q != "")
    total += F.when(F.col("_q_vague"), F.when(F.col("_c_vague"), VAGUE[0]).otherwise(VAGUE[1])).when(F.col("_c_vague") & stated, VAGUE[2]).otherwise(0.0)
    return out.withColumn(into, total).drop("_q0", "_c0", *(f"_{x}_{n}" for x in "qc" for n in parts))


def hit_score(source: Column, rank: Column, priority: Column) -> Column:
    penalty = reduce(lambda c, kv: F.when(source == kv[0], kv[1]).otherwise(c), PENALTY.items(), F.lit(0.08))
    return 1.0 - penalty - F.least(rank, F.lit(20)) * 0.01 - F.least(priority, F.lit(100)) * 0.001


def alias_hits(mentions: DataFrame, kb: DataFrame, canonical: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(concept_type, text, code, source, score, priority): codes by equality of a variant with an alias; per code the first variant.
    canonical (alias_norm, canonical): the names to look conditions up by, whose keys without prefix and respelled are alias_norm;
    index: that of knowledge(), if not of kb."""
    index = index if index is not None else terminology.alias_index(kb)
    records = kb.groupBy("concept_type", "code").agg(F.min_by("record_name", F.struct("priority", "record_id")).alias("record_name"), F.min("priority").alias("record_priority"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("ttys", F.array().cast("array<string>"))))).alias("ttys"))
    asked = mentions.select("concept_type", "text").distinct()
    if canonical is not None:
        names = canonical.groupBy(F.col("alias_norm").alias("_key")).agg(F.min("canonical").alias("_canonical"))
        asked = asked.withColumn("_key", spelled(core(normalize_key(F.col("text"))))).join(names, "_key", "left")
    asked = asked.select("concept_type", "text", F.posexplode(variants(F.col("text"), F.col("concept_type"), F.col("_canonical") if canonical is not None else None)).alias("variant", "x")).select("concept_type", "text", "variant", F.col("x.source").alias("source"), F.col("x.key").alias("alias_norm"))
    found = asked.join(index, ["concept_type", "alias_norm"]).join(records, ["concept_type", "code"])
    first = found.groupBy("concept_type", "text", "code").agg(F.min_by(F.struct("source", "rank", "record_priority", "record_name", "ttys"), F.struct("variant", "rank")).alias("x")).select("concept_type", "text", "code", "x.*")
    is_drug = F.col("concept_type") == DRUG
    base = hit_score(F.col("source"), F.col("rank"), F.col("record_priority"))
    drugs = first.where(is_drug).withColumns({"_q": rx.normalize_rx(F.col("text")), "_c": rx.normalize_rx(F.col("record_name"))})
    drugs = drugs.withColumn("extra", rx.match_score(F.col("_q"), F.col("_c"), F.col("record_name")) + rx.tty_score(F.col("_q"), F.col("ttys"))).drop("_q", "_c")
    scored = drugs.unionByName(with_adjustment(first.where(~is_drug), "text", "record_name", "extra"))
    return scored.select("concept_type", "text", "code", "source", (base + F.col("extra")).alias("score"), F.col("record_priority").alias("priority"), "record_name", "ttys")


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The best hits of every mention by score, priority and code, with their rank from 1."""
    order = W.partitionBy("concept_type", "text").orderBy(F.col("score").desc(), "priority", "code")
    return hits.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= limit)


def preliminary(queries: DataFrame, docs: DataFrame, most: int = 240, token_docs: int = 1600, gram_docs: int = 2200) -> DataFrame:
    """(query, q_tokens, q_grams, alias, votes, vote_rank): per query key the aliases with most weight of rare tokens and character
    3-grams in common.

    The keys are spread over a given number of tasks, where a small terminology is joined to them, counted and ranked without another
    shuffle: their bytes are few, but their votes are many."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select("query").distinct().where("query <> ''").withColumn("query_id", terminology.text_id(F.col("query")))
    asked = asked.select("query_id", "query", F.array_distinct(condition_tokens(F.col("query"))).alias("q_tokens"), char_ngrams(F.col("query")).alias("q_grams")).repartition(tasks, "query_id")
    micro = lambda c: F.round(c * 1_000_000).cast("bigint")  # votes are whole numbers, so that sums don't depend on their order
    weighed = lambda p, kind, times: p.select(F.lit(kind).alias("kind"), "item", terminology.text_id(F.col("alias")).alias("alias_id"), (micro(F.col("idf")) * times).alias("vote"))
    posted = weighed(terminology.postings(docs, "tokens", token_docs), "t", 3).unionByName(weighed(terminology.postings(docs, "grams", gram_docs), "g", 1))
    small = is_small(docs, SMALL_DOCS)
    near = F.broadcast if small else lambda df: df
    named = lambda items, kind: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    items = asked.select("query_id", F.inline(F.concat(named(F.col("q_tokens"), "t"), named(F.col("q_grams"), "g"))))
    # votes are counted under 60-bit ids; the strings are joined back to the few that are kept
    votes = items.join(near(posted), ["kind", "item"]).groupBy("query_id", "alias_id").agg(F.sum("vote").alias("votes"))
    kept = votes.withColumn("vote_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("votes").desc(), "alias_id"))).where(F.col("vote_rank") <= most)
    aliases = docs.select(terminology.text_id(F.col("alias")).alias("alias_id"), "alias")
    return kept.join(asked, "query_id").join(near(aliases), "alias_id").select("query", "q_tokens", "q_grams", "alias", "votes", "vote_rank")


def lexical_scores(candidates: DataFrame, docs: DataFrame, with_sequence: bool = True) -> DataFrame:
    """(query, alias, codes, similarity, threshold): the exact score of preliminary pairs; pairs with too little in common get 0. With the
    matching-block ratio, those that stay below their threshold in any case are left out."""
    small = is_small(docs, SMALL_DOCS)
    if with_sequence and not small:  # spread over a given number of tasks: few bytes, but the ratio takes long
        candidates = candidates.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query", "alias")
    known = docs.select("alias", "tokens", "grams", "codes")
    pairs = candidates.join(F.broadcast(known) if small else known, "alias")
    q, g = F.col("q_tokens"), F.col("q_grams")
    shared, shared_grams = F.size(F.array_intersect(q, F.col("tokens"))), F.size(F.array_intersect(g, F.col("grams")))
    over = lambda n, d: n / F.greatest(F.lit(1), d)
    recall = over(shared, F.size(q))
    inside = F.col("alias").contains(F.col("query")) | F.col("query").contains(F.col("alias"))
    ratio = F.least(F.length("query"), F.length("alias")) / F.greatest(F.length("query"), F.length("alias"))
    base = 0.34 * recall + 0.18 * over(shared, F.size("tokens")) + 0.16 * over(shared, F.size(F.array_union(q, F.col("tokens")))) + 0.18 * over(shared_grams, F.size(F.array_union(g, F.col("grams")))) + F.when(inside, 0.10).otherwise(0.0)
    base = base - F.greatest(F.lit(0.0), 0.55 - ratio) * 0.12
    little = ((shared == 0) & (shared_grams < 3)) | (~inside & (recall < 0.55))
    threshold = F.when(F.size(q) <= 2, 0.58).when(F.size(q) <= 4, 0.50).otherwise(0.46)
    scored = pairs.select("query", "alias", "codes", F.when(~little, base).alias("base"), threshold.alias("threshold"))
    if not with_sequence:
        return scored.select("query", "alias", "codes", F.coalesce("base", F.lit(0.0)).alias("similarity"), "threshold")
    # a ratio is at most 1 - edits / both lengths
    most = 1 - F.levenshtein("query", "alias") / (F.length("query") + F.length("alias"))
    reach = (F.col("base") + 0.14 >= F.col("threshold")) & F.when(F.col("base") + 0.14 >= F.col("threshold"), F.col("base") + 0.14 * most + 1e-9 >= F.col("threshold"))
    return scored.where(reach).select("query", "alias", "codes", (F.col("base") + 0.14 * key_similarity(F.col("query"), F.col("alias"))).alias("similarity"), "threshold")


def lexical_hits(mentions: DataFrame, kb: DataFrame, limit: int = 20) -> DataFrame:
    """(concept_type, text, code, source, score, priority) of conditions that resemble a mention enough."""
    docs = cut(terminology.condition_documents(kb, DIAGNOSIS))  # read by the postings, the ids and the scores
    asked = mentions.where(F.col("concept_type") == DIAGNOSIS).select("text").distinct().select("text", F.explode(search_keys(F.col("text"))).alias("query"))
    scored = lexical_scores(preliminary(asked, docs), docs).where(F.col("similarity") >= F.col("threshold"))
    best = asked.join(scored, "query").select("text", F.explode("codes").alias("code"), "similarity").groupBy("text", "code").agg(F.max("similarity").alias("similarity"))
    records = kb.where(F.col("concept_type") == DIAGNOSIS).groupBy("code").agg(F.min_by("record_name", F.struct("priority", "record_id")).alias("record_name"), F.min("priority").alias("priority"))
    hits = with_adjustment(best.join(records, "code"), "text", "record_name", "adjust").select(F.lit(DIAGNOSIS).alias("concept_type"), "text", "code", F.lit("diagnosis_lexical").alias("source"), (0.45 + 0.4 * F.least("similarity", F.lit(1.0)) + F.col("adjust") - F.least("priority", F.lit(100)) * 0.0005).alias("score"), "priority")
    return top_hits(hits, limit).drop("hit_rank")


def drug_hits(mentions: DataFrame, kb: DataFrame, limit: int = 30) -> DataFrame:
    """The same of drugs, by ingredient and brand keys."""
    drugs = kb.where(F.col("concept_type") == DRUG)
    support = terminology.alias_support(terminology.alias_index(drugs), DRUG)
    records = drugs.groupBy("code").agg(F.min_by(F.struct("record_name", "ttys"), F.struct("priority", "record_id")).alias("r"), F.min("priority").alias("priority")).join(support, "code", "left")
    asked = terminology.mention_keys(mentions.where(F.col("concept_type") == DRUG).select("text").distinct())
    pairs = asked.join(terminology.drug_postings(kb, DRUG), "lookup_key").select("text", "code").distinct().join(records, "code")
    pairs = pairs.withColumns({"_q": rx.normalize_rx(F.col("text")), "_c": rx.normalize_rx(F.col("r.record_name"))})
    query = F.col("_q")
    score = 0.70 + rx.match_score(query, F.col("_c"), F.col("r.record_name")) + rx.tty_score(query, F.col("r.ttys")) + F.least(F.coalesce("n_aliases", F.lit(0)), F.lit(10)) * 0.002 - F.least("priority", F.lit(100)) * 0.001
    hits = pairs.select(F.lit(DRUG).alias("concept_type"), "text", "code", F.lit("medication_lexical").alias("source"), score.alias("score"), "priority")
    return top_hits(hits, limit).drop("hit_rank")


def curated_hits(mentions: DataFrame, curated: DataFrame) -> DataFrame:
    """Hits of mentions whose key is in a curated table (concept_type, alias_norm, rank from 0, code): they come before all others."""
    asked = mentions.select("concept_type", "text").distinct().withColumn("alias_norm", normalize_key(F.col("text")))
    return asked.join(curated, ["concept_type", "alias_norm"]).groupBy("concept_type", "text", "code").agg(F.min("rank").alias("rank")).select("concept_type", "text", "code", F.lit("curated").alias("source"), (1.65 - 0.025 * F.col("rank")).alias("score"), F.lit(0).alias("priority"))


def lookup(mentions: DataFrame, kb: DataFrame, limit: int = 5, curated: DataFrame | None = None, canonical: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """All hits of every distinct mention, best first: curated codes, aliases, then what lexical search adds (for conditions only
    where these gave fewer than limit); of a code found in several ways the first counts. Distinct mentions and the first hits
    are written once, as several branches read them."""
    mentions = cut(mentions.select("concept_type", "text").distinct())
    exact = alias_hits(mentions, kb, canonical, index).select("concept_type", "text", "code", "source", "score", "priority")
    key = ["concept_type", "text", "code"]
    if curated is not None:
        first = curated_hits(mentions, curated)
        exact = first.unionByName(exact.join(first, key, "left_anti"))
    exact = cut(exact)
    enough = exact.groupBy("concept_type", "text").agg(F.count("*").alias("n")).where(F.col("n") >= limit).where(F.col("concept_type") == DIAGNOSIS)
    searched = mentions.join(enough, ["concept_type", "text"], "left_anti")
    lexical = lexical_hits(searched, kb, max(limit * 4, 20)).unionByName(drug_hits(mentions, kb, max(limit * 4, 30)))
    return top_hits(exact.unionByName(lexical.join(exact.select(*key), key, "left_anti")), limit)


def profile_codes(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """mentions (concept_type, text, profile) with the curated codes of exactly this key and kind of line (concept_type, alias_norm,
    profile, codes); null where there are none, which is not an empty array."""
    asked = mentions.withColumn("alias_norm", normalize_key(F.col("text")))
    return asked.join(profiles.select("concept_type", "alias_norm", "profile", F.col("codes").alias("profile_codes")), ["concept_type", "alias_norm", "profile"], "left").drop("alias_norm")


def knowledge(kb: DataFrame, alias_rows: DataFrame | None = None, lexicon: DataFrame | None = None, least_files: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, curated, profiles) to look codes up in.

    index (concept_type, alias_norm, rank, code, priority): the aliases of the records; where alias_rows (the same columns) has a
    key, its rows take their place. curated and profiles come from a training lexicon (concept_type, alias_norm, profile or null,
    code, file_support): codes found in at least least_files files, by file support and code; profile rows are those of a kind of line.
    """
    index = terminology.alias_index(kb)
    if alias_rows is not None:
        given = alias_rows.select(*index.columns)
        index = given.unionByName(index.join(given.select("concept_type", "alias_norm").distinct(), ["concept_type", "alias_norm"], "left_anti"))
    schema = "concept_type string, alias_norm string, profile string, code string, file_support long"
    rows = (lexicon if lexicon is not None else kb.sparkSession.createDataFrame([], schema)).where(F.col("file_support") >= least_files)
    order = W.partitionBy("concept_type", "alias_norm").orderBy(F.col("file_support").desc(), "code")
    curated = rows.where("profile IS NULL").withColumn("rank", F.row_number().over(order) - 1).select("concept_type", "alias_norm", "rank", "code")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("file_support")).alias("n"), "code")))
    profiles = rows.where("profile IS NOT NULL").groupBy("concept_type", "alias_norm", "profile").agg(F.transform(F.filter(ranked, lambda x: x["code"].isNotNull()), lambda x: x["code"]).alias("codes"))
    return index, curated, profiles


def candidate_rows(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """hits with the names of their codes, for people to look at."""
    names = kb.groupBy("concept_type", "code").agg(F.min_by("record_name", F.struct("priority", "record_id")).alias("record_name"))
    return hits.join(names, ["concept_type", "code"], "left").select("concept_type", "text", "hit_rank", "code", "record_name", "source", "score", "priority")


def select_codes(hits: DataFrame, kb: DataFrame, overrides: DataFrame | None = None, rejected: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(concept_type, text, code) of the mentions for which one hit is good enough.

    Conditions: the top hit above its threshold and, if lexical, with a margin to the next. Drugs: the top hit whose strength
    matches the mention's, if that has one, above its threshold and not by ingredient alone. A curated hit needs no threshold.
    overrides (concept_type, alias_norm, code) give their code to all mentions (if given, else those with hits) with that key; those with a key in rejected
    (concept_type, alias_norm) get none otherwise. Of equal keys with several overrides the smallest code counts.
    """
    names = kb.groupBy("concept_type", "code").agg(F.min_by(F.struct("record_name", "ttys"), F.struct("priority", "record_id")).alias("r"))
    order = W.partitionBy("concept_type", "text").orderBy("hit_rank")
    rows = hits.join(names, ["concept_type", "code"])
    query, candidate = rx.strengths(rx.normalize_rx(F.col("text"))), rx.strengths(rx.normalize_rx(F.col("r.record_name")))
    only_ingredient = (F.size("r.ttys") > 0) & F.forall("r.ttys", lambda t: F.upper(t).isin("IN", "PIN", "MIN", "BN"))
    curated, lexical = F.col("source") == "curated", F.col("source") == "diagnosis_lexical"
    usable = (F.col("concept_type") != DRUG) | curated | (F.size(query) == 0) | (F.arrays_overlap(query, candidate) & ~F.coalesce(only_ingredient, F.lit(False)))
    rows = rows.where(F.coalesce(usable, F.lit(False))).withColumn("next_score", F.lead("score").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1")
    good_condition = (F.col("score") >= F.when(lexical, LEAST["diagnosis_lexical"]).otherwise(LEAST["diagnosis"])) & ~(lexical & F.coalesce(F.col("score") - F.col("next_score") < MARGIN, F.lit(False)))
    good_drug = (F.col("source") != "drug_ingredient") & (F.col("score") >= F.when(F.col("source") == "medication_lexical", LEAST["medication_lexical"]).otherwise(LEAST["drug"]))
    chosen = rows.where(curated | F.when(F.col("concept_type") == DRUG, good_drug).otherwise(good_condition)).select("concept_type", "text", "code")
    keyed = lambda t: t.withColumn("alias_norm", normalize_key(F.col("text")))
    if rejected is not None:
        chosen = keyed(chosen).join(rejected.select("concept_type", "alias_norm").distinct(), ["concept_type", "alias_norm"], "left_anti").select("concept_type", "text", "code")
    if overrides is not None:
        fixed = keyed((mentions if mentions is not None else hits).select("concept_type", "text").distinct()).join(overrides.groupBy("concept_type", "alias_norm").agg(F.min("code").alias("code")), ["concept_type", "alias_norm"]).select("concept_type", "text", "code")
        chosen = fixed.unionByName(chosen.join(fixed, ["concept_type", "text"], "left_anti"))
    return chosen


def eligible(kind: Column, mention_key: Column, line_chars: Column, allowed: Column | None = None) -> Column:
    """Whether a code may be given here: not to long condition names or on long lines, unless the mention is allowed anyway."""
    short = (F.length(mention_key) <= 160) & (F.size(F.split(mention_key, " ")) <= 18) & (line_chars < LONG_LINE)
    return (kind != DIAGNOSIS) | (allowed if allowed is not None else F.lit(False)) | (mention_key == "") | short
