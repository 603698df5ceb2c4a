"""Queries of terminology builds, retrieval of codes, and the emission policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospan.config import DIAGNOSIS, DRUG
from ontospan.functions.text import normalize_key
from ontospan.operators import policy, retrieval, terminology
from ontospan.plans import rx_sql, sql
from ontospan.plans.text_queries import INGREDIENT, STOPS, table


def _kb(spark, sf) -> DataFrame:
    return table(spark, sf, "kb_records")


def _mentions(spark, sf) -> DataFrame:
    return table(spark, sf, "concepts").where(F.col("concept_type").isin(DIAGNOSIS, DRUG) & F.col("text").isNotNull()).select("concept_type", "text").distinct()


def alias_index(spark, sf):
    return terminology.alias_index(_kb(spark, sf))


def inverted_aliases(spark, sf):
    return terminology.inverted_aliases(_kb(spark, sf)).select("concept_type", "alias_norm", F.array_join("codes", "|").alias("codes"))


def grouped_records(spark, sf):
    rows = _kb(spark, sf).select("code", F.explode(F.array_distinct(F.filter(F.concat(F.array("record_name", "name_vi", "name_en"), "aliases"), lambda x: x.isNotNull()))).alias("name"), F.get("ttys", F.lit(0)).alias("tty"), (~F.col("archived")).alias("preferred"), "priority", "archived")
    out = terminology.grouped_records(rows)
    return out.select("code", "record_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("ttys", "|").alias("ttys"), "priority", "archived")


def capped_aliases(spark, sf):
    return _kb(spark, sf).where(F.size("aliases") > 0).select("record_id", F.array_join(terminology.capped_aliases(F.col("aliases"), 2), "|").alias("aliases"))


def alias_support(spark, sf):
    return terminology.alias_support(terminology.alias_index(_kb(spark, sf)), DRUG)


def united_records(spark, sf):
    lexicon = table(spark, sf, "lexicon").select("concept_type", F.col("term").alias("code"), F.col("term").alias("record_name"), F.col("frequency").alias("priority"), F.array().cast("array<string>").alias("aliases"))
    records = _kb(spark, sf).select("concept_type", F.lower("record_name").alias("code"), "record_name", "priority", "aliases")
    return terminology.united([records, lexicon]).select("concept_type", "code", "record_name", "priority", F.array_join("aliases", "|").alias("aliases"))


def token_postings(spark, sf):
    return terminology.postings(terminology.condition_documents(_kb(spark, sf), DIAGNOSIS), "tokens", 1600).select("item", "alias", F.round("idf", 6).alias("idf"))


def drug_postings(spark, sf):
    return terminology.drug_postings(_kb(spark, sf), DRUG)


def exact_lookup(spark, sf):
    """Codes of mentions by equality of keys, with their rank."""
    asked = _mentions(spark, sf).withColumn("alias_norm", normalize_key(F.col("text")))
    return asked.join(terminology.alias_index(_kb(spark, sf)), ["concept_type", "alias_norm"]).select("concept_type", "text", "code", "rank")


def variant_hits(spark, sf):
    hits = retrieval.alias_hits(_mentions(spark, sf), _kb(spark, sf))
    return hits.select("concept_type", "text", "code", "source", F.round("score", 4).alias("score"))


def _queries(spark, sf) -> DataFrame:
    """The search keys of all mentions of conditions."""
    mentions = _mentions(spark, sf).where(F.col("concept_type") == DIAGNOSIS)
    return mentions.select(F.explode(retrieval.search_keys(F.col("text"))).alias("query")).distinct()


def lexical_candidates(spark, sf):
    """Per search key the aliases with most weight in common."""
    return retrieval.preliminary(_queries(spark, sf), terminology.condition_documents(_kb(spark, sf), DIAGNOSIS)).select("query", "alias", "votes", "vote_rank")


def lexical_likeness(spark, sf):
    """The part of lexical scores without the matching-block ratio, which SQL has not; lexical_hits has all of them."""
    docs = terminology.condition_documents(_kb(spark, sf), DIAGNOSIS)
    return retrieval.lexical_scores(retrieval.preliminary(_queries(spark, sf), docs), docs, with_sequence=False).select("query", "alias", F.round("similarity", 6).alias("similarity"))


def _ontology(spark, sf) -> DataFrame:
    """Entries from two lists, of which the later replaces codes of the earlier: live records after archived ones."""
    entries = _kb(spark, sf).select(F.col("code_system").alias("system"), "code", "concept_type", F.col("record_name").alias("name"), "aliases", "priority", "archived")
    return terminology.ontology_index([entries.where("archived"), entries.where("NOT archived")])


def ontology_entries(spark, sf):
    return _ontology(spark, sf).select("system", "code", "concept_type", "name", "priority", F.array_join("aliases", "|").alias("aliases"))


def ontology_hits(spark, sf):
    """Mentions in the ontology by stages, the likeness of names the last."""
    return terminology.ontology_lookup(_mentions(spark, sf), _ontology(spark, sf), DRUG)


def ontology_equal(spark, sf):
    """The stages of equal keys alone."""
    return terminology.ontology_lookup(_mentions(spark, sf), _ontology(spark, sf), DRUG, least=None)


def compact_records(spark, sf):
    out = terminology.compact_records(_kb(spark, sf), DRUG)
    return out.groupBy("concept_type").agg(F.count("*").alias("n"), F.sum(F.size("aliases")).alias("n_aliases"))


def aliases_by_type(spark, sf):
    return terminology.aliases_by_type(_kb(spark, sf))


def alias_seed(spark, sf):
    """The first concept of each surface form, in any letter case, and type."""
    rows = table(spark, sf, "concepts").select(F.col("text").alias("alias"), "concept_type", F.col("concept_id").alias("row_no")).distinct()
    return terminology.alias_seed(rows)


def lexicon_aliases(spark, sf):
    return terminology.lexicon_aliases(table(spark, sf, "lexicon"))


def index_counts(spark, sf):
    return terminology.index_counts(_kb(spark, sf))


def _trained(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What labels teach: codes by file support, for all lines and for notes of each kind, which stand in for kinds of lines."""
    kinds = table(spark, sf, "documents").select("doc_id", F.coalesce("note_kind", F.lit("?")).alias("profile"), F.coalesce("case_id", F.lit("?")).alias("file"))
    rows = table(spark, sf, "concepts").where(F.size("candidates") > 0).select("concept_id", "doc_id", "concept_type", normalize_key(F.col("text")).alias("alias_norm"), F.explode("candidates").alias("code")).distinct().join(kinds, "doc_id")
    both = rows.withColumn("profile", F.explode(F.array(F.lit(None).cast("string"), F.col("profile"))))
    lexicon = both.where("alias_norm <> ''").groupBy("concept_type", "alias_norm", "profile", "code").agg(F.count_distinct("file").alias("file_support"))
    return retrieval.knowledge(_kb(spark, sf), lexicon=lexicon, least_files=2)


def curated_codes(spark, sf):
    return _trained(spark, sf)[1]


def profile_codes(spark, sf):
    """Curated codes of mentions in notes of each kind."""
    kinds = table(spark, sf, "documents").select("doc_id", F.coalesce("note_kind", F.lit("?")).alias("profile"))
    asked = table(spark, sf, "concepts").where(F.col("concept_type").isin(DIAGNOSIS, DRUG) & F.col("text").isNotNull()).join(kinds, "doc_id").select("concept_type", "text", "profile").distinct()
    return retrieval.profile_codes(asked, _trained(spark, sf)[2]).select("concept_type", "text", "profile", F.array_join("profile_codes", "|").alias("codes"))


def curated_hits(spark, sf):
    return retrieval.curated_hits(_mentions(spark, sf), _trained(spark, sf)[1]).select("concept_type", "text", "code", F.round("score", 4).alias("score"))


def candidate_rows(spark, sf):
    """The best hits of the terms of the lexicon, with names."""
    terms = table(spark, sf, "lexicon").where(F.col("concept_type").isin(DIAGNOSIS, DRUG)).select("concept_type", F.col("term").alias("text"))
    return retrieval.candidate_rows(retrieval.lookup(terms, _kb(spark, sf)), _kb(spark, sf)).withColumn("score", F.round("score", 4))


def lexical_hits(spark, sf):
    hits = retrieval.lexical_hits(_mentions(spark, sf), _kb(spark, sf))
    return hits.select("text", "code", F.round("score", 4).alias("score"))


def drug_hits(spark, sf):
    return retrieval.drug_hits(_mentions(spark, sf), _kb(spark, sf)).select("text", "code", F.round("score", 4).alias("score"))


def selected_codes(spark, sf):
    hits = retrieval.lookup(_mentions(spark, sf), _kb(spark, sf))
    return retrieval.select_codes(hits, _kb(spark, sf))


def emitted_codes(spark, sf):
    """A policy that abstains for mentions coded only in the mirror, and has one wildcard and one exact rule, applied to concepts."""
    rules = table(spark, sf, "lexicon").where(F.col("concept_type").isin(DIAGNOSIS, DRUG)).select(
        "concept_type", F.col("term").alias("alias_norm"), F.lit("short_line").alias("profile"),
        F.when(F.col("term_id") % 2 == 0, F.array(F.lit("isHistorical"))).alias("assertions"),
        F.when(F.col("term_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("T"), F.col("term_id").cast("string")))).alias("candidates"), F.col("term_id").alias("rule_no"),
    )
    rows = table(spark, sf, "concepts").where(F.col("concept_type").isin(DIAGNOSIS, DRUG)).select("concept_id", "concept_type", normalize_key(F.col("text")).alias("alias_norm"), F.lit("short_line").alias("profile"), "assertions", "candidates").distinct()
    out = policy.applied(rows, policy.rules(rules))
    return out.select("concept_id", F.array_join("emitted", "|").alias("emitted"))


_K = sql.key
_EVERY = f"(SELECT concept_type, code, priority, unnest(list_filter(list_concat([record_name, name_vi, name_en], coalesce(aliases, []), coalesce(alias_norms, [])), lambda x: x IS NOT NULL)) AS alias FROM kb_records)"
_INDEX = f"(SELECT concept_type, alias_norm, code, priority, row_number() OVER (PARTITION BY concept_type, alias_norm ORDER BY priority, length(code), code) - 1 AS rank FROM (SELECT concept_type, {_K('alias')} AS alias_norm, code, min(priority) AS priority FROM {_EVERY} GROUP BY ALL) WHERE alias_norm <> '' QUALIFY rank < 20)"
_TTY = "coalesce(nullif(list_position([" + ", ".join(f"'{t}'" for t in terminology.TTY_ORDER) + "], upper(ttys[1])), 0), 99)"
_MENTIONS = f"(SELECT DISTINCT concept_type, text FROM concepts WHERE concept_type IN ('{DIAGNOSIS}', '{DRUG}') AND text IS NOT NULL)"
_WORDS = lambda k: f"list_distinct(list_filter(string_split({k}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({STOPS})))"
_DOCS = f"(SELECT DISTINCT alias_norm AS alias, {_WORDS('alias_norm')} AS tokens FROM {_INDEX} WHERE concept_type = '{DIAGNOSIS}')"
_ID = lambda c: f"('0x' || substr(md5({c}), 1, 15))::BIGINT"
_sub = lambda c, rules: reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}', 'g')", rules, c)
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_CORE = lambda c: f"regexp_replace({c}, '^(?:chan doan mac benh|chan doan|duoc chan doan mac benh|duoc chan doan|mac benh|benh|theo doi|nghi ngo) ', '')"
_PLAIN = lambda c: f"regexp_replace({c}, ' (?:khong xac dinh|khong dac hieu|unspecified|nos)$', '')"
_SPELL = lambda c: _sub(f"replace(replace(replace(replace(replace({c}, 'sung huyet', 'xung huyet'), 'tieu duong', 'dai thao duong'), 'da day thuc quan', 'da day - thuc quan'), 'khong dac hieu', 'khong xac dinh'), 'tuyp', 'type')", [(r"\bdtd\b", "dai thao duong"), (r"\bgut\b", "gout"), (r"\bvkdt\b", "viem khop dang thap"), (r"\btang\s+ha\b", "tang huyet ap"), (r"\btang\s+huyet+t\s+ap\b", "tang huyet ap"), (r"\btyp\s*ii\b", "type 2"), (r"\b(man|cap)\b", r"\1 tinh"), (r"\b(man|cap) tinh tinh\b", r"\1 tinh")])
_MEASURED = lambda c: _SQUEEZE(_sub(c, [(r"\b\d+(?:[.,-]\d+)?\s*%", " "), (r"\b(?:m?rs|abcd2|balthazar)\s*\w*\b", " "), (r"\b\d+\s*(?:d|diem)\b", " ")]))
_SET = lambda c: _SQUEEZE(_sub(c, [(r"^(?:theo doi|nghi ngo|tien su|co tien su)\s+", ""), (r"\s+(?:gio thu|cach day)\s+\d+\b.*$", "")]))
_SEARCH = lambda c: _SQUEEZE(f"regexp_replace({_PLAIN(_CORE(_SPELL(c)))}, '^(?:tien su|co tien su|duoc phat hien|phat hien|dang dieu tri|da dieu tri) ', '')")
_QUERIES = f"(SELECT DISTINCT q AS query FROM (SELECT unnest([{', '.join(_SEARCH(x) for x in ('k', _CORE('k'), _SPELL('k'), _PLAIN('k'), _MEASURED('k'), _SET('k')))}]) AS q FROM (SELECT {_K('text')} AS k FROM {_MENTIONS} WHERE concept_type = '{DIAGNOSIS}')) WHERE q <> '')"
_GRAMS = lambda c: f"CASE WHEN length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) < 3 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) - 1), lambda i: regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')[i:i + 2])) END"
_VOTES = f"""d AS (SELECT alias_norm AS alias, {_ID('alias_norm')} AS id, {_WORDS('alias_norm')} AS tokens, {_GRAMS('alias_norm')} AS grams FROM (SELECT DISTINCT alias_norm FROM {_INDEX} WHERE concept_type = '{DIAGNOSIS}')),
  q AS (SELECT query, {_WORDS('query')} AS tokens, {_GRAMS('query')} AS grams FROM {_QUERIES}),
  dt AS (SELECT id, unnest(tokens) AS item FROM d), dg AS (SELECT id, unnest(grams) AS item FROM d),
  w AS (SELECT 't' AS kind, item, 3 * round(ln(1 + 1 / count(*)) * 1000000)::BIGINT AS v FROM dt GROUP BY item HAVING count(*) <= 1600 UNION ALL SELECT 'g', item, round(ln(1 + 1 / count(*)) * 1000000)::BIGINT FROM dg GROUP BY item HAVING count(*) <= 2200),
  p AS (SELECT 't' AS kind, id, item FROM dt UNION ALL SELECT 'g', id, item FROM dg), a AS (SELECT query, 't' AS kind, unnest(tokens) AS item FROM q UNION ALL SELECT query, 'g', unnest(grams) FROM q),
  v AS (SELECT query, id, sum(v)::BIGINT AS votes FROM a JOIN w USING (kind, item) JOIN p USING (kind, item) GROUP BY ALL),
  k AS (SELECT query, alias, d.tokens AS dt, d.grams AS dg, votes, row_number() OVER (PARTITION BY query ORDER BY votes DESC, id) AS vote_rank FROM v JOIN d USING (id) QUALIFY vote_rank <= 240)"""
_inter = lambda a, b: f"len(list_intersect({a}, {b}))"
_union = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
_ONTOLOGY = "(SELECT code_system AS system, code, arg_max(struct_pack(concept_type, record_name, aliases, priority), (CASE WHEN archived THEN 0 ELSE 1 END, record_name)) AS x FROM kb_records WHERE coalesce(code, '') <> '' GROUP BY 1, 2)"
_plain = lambda k, stops: f"coalesce(nullif(array_to_string(string_split({k}, ' ')[1:coalesce(list_position(list_transform(string_split({k}, ' '), lambda t: {stops}), true), len(string_split({k}, ' ')) + 1) - 1], ' '), ''), {k})"
_ROUTES = "'po', 'iv', 'im', 'sc', 'bid', 'tid', 'qid', 'qam', 'qhs', 'daily', 'prn'"
_TRAINED = f"(SELECT concept_type, alias_norm, profile, code, count(DISTINCT file) AS n FROM (SELECT concept_type, alias_norm, unnest([NULL, profile]) AS profile, code, file FROM (SELECT DISTINCT concept_id, doc_id, concept_type, {_K('text')} AS alias_norm, unnest(candidates) AS code FROM concepts) JOIN (SELECT doc_id, coalesce(note_kind, '?') AS profile, coalesce(case_id, '?') AS file FROM documents) USING (doc_id)) WHERE alias_norm <> '' GROUP BY ALL HAVING count(DISTINCT file) >= 2)"
_CURATED = f"(SELECT concept_type, alias_norm, code, row_number() OVER (PARTITION BY concept_type, alias_norm ORDER BY n DESC, code) - 1 AS rank FROM {_TRAINED} WHERE profile IS NULL)"
_PEN = "CASE source WHEN 'exact' THEN 0.0 WHEN 'drug_unit' THEN 0.005 WHEN 'drug_no_count' THEN 0.015 WHEN 'drug_core' THEN 0.03 WHEN 'drug_no_release_token' THEN 0.04 WHEN 'drug_ingredient' THEN 0.12 WHEN 'drug_context_core' THEN 0.035 WHEN 'drug_context_ingredient' THEN 0.10 WHEN 'diagnosis_core' THEN 0.02 WHEN 'diagnosis_unspecified' THEN 0.03 WHEN 'diagnosis_spelling' THEN 0.04 WHEN 'diagnosis_chronic_shorthand' THEN 0.045 WHEN 'diagnosis_with_benh_prefix' THEN 0.05 ELSE 0.08 END"
_LONG = lambda c: _sub(c, [(r"\b(man|cap)\b", r"\1 tinh"), (r"\b(man|cap) tinh tinh\b", r"\1 tinh")])
_UPTO = lambda x: rx_sql._first(x, f"string_split(t, ':')[1] IN ({rx_sql._in(rx_sql.ROUTES + ' ' + rx_sql.FREQUENCIES)}) OR t IN ({rx_sql._in(rx_sql.COUNTS)}) OR regexp_full_match(t, 'q[0-9]+h:?prn?')")
_VARIANTS = f"""(SELECT concept_type, text, unnest(list_filter(list_transform(vs, lambda v, i: struct_pack(i := i, source := v.source, key := v.key, first := list_position(list_transform(vs, lambda u: u.key), v.key))), lambda v: v.key <> '' AND v.first = v.i)) AS v FROM (
  SELECT concept_type, text, CASE WHEN concept_type = '{DRUG}' THEN list_transform(list_zip(['exact', 'drug_unit', 'drug_no_count', 'drug_core', 'drug_no_release_token', 'drug_ingredient', 'drug_context_core', 'drug_context_ingredient'], [k, r, nc, core, array_to_string(list_filter(string_split(core, ' '), lambda t: t NOT IN ('xl', 'xr', 'er', 'sr', 'cr', 'extended', 'release')), ' '), {rx_sql._NAME('r')}, ctx, {rx_sql._NAME('ctx')}]), lambda z: struct_pack(source := z[1], key := z[2]))
    ELSE list_transform(list_zip(['exact', 'diagnosis_core', 'diagnosis_spelling', 'diagnosis_unspecified', 'diagnosis_chronic_shorthand', 'diagnosis_with_benh_prefix'], [k, {_CORE('k')}, {_SPELL('k')}, {_PLAIN('k')}, {_LONG('k')}, 'benh ' || k]), lambda z: struct_pack(source := z[1], key := z[2])) END AS vs
  FROM (SELECT *, array_to_string({rx_sql._w('r')}[1:{_UPTO('r')} - 1], ' ') AS core, {rx_sql._SETTING('r')} AS ctx, trim(regexp_replace(regexp_replace(r, '\\s+x\\s*\\d+(?:\\s+(?:ngay|day|days))?\\b.*$', '', 'g'), '\\s+', ' ', 'g')) AS nc FROM (SELECT concept_type, text, {_K('text')} AS k, {sql.rx('text')} AS r FROM {_MENTIONS}))))"""
_stage = lambda k: f"CASE regexp_extract({k}, '\\bgiai doan\\s+(cuoi|[1-5]|i{{1,3}}|iv|v)\\b', 1) WHEN 'cuoi' THEN '5' WHEN 'i' THEN '1' WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'iv' THEN '4' WHEN 'v' THEN '5' ELSE regexp_extract({k}, '\\bgiai doan\\s+(cuoi|[1-5]|i{{1,3}}|iv|v)\\b', 1) END"
_acuity = lambda k: f"CASE WHEN regexp_matches({k}, '\\bcap(?: tinh)?\\b') THEN 'acute' WHEN regexp_matches({k}, '\\bman(?: tinh)?\\b') THEN 'chronic' ELSE '' END"
_side = lambda k: f"CASE WHEN regexp_matches({k}, '\\b(?:hai ben|bilateral)\\b') THEN 'both' WHEN regexp_matches({k}, '\\b(?:trai|left)\\b') THEN 'left' WHEN regexp_matches({k}, '\\b(?:phai|right)\\b') THEN 'right' ELSE '' END"
_kind = lambda k: f"regexp_extract({k}, '\\b(?:type|tip)\\s*([12])\\b', 1)"
_vague = lambda k: f"regexp_matches({k}, '\\b(?:khong xac dinh|khong dac hieu|unspecified|nos)\\b')"
_term = lambda f, same, missing, other: f"CASE WHEN {f('q0')} = '' THEN 0 WHEN {f('c0')} = '' THEN {missing} WHEN {f('q0')} = {f('c0')} THEN {same} ELSE {other} END"
_ADJUST = f"({_term(_stage, 0.16, -0.25, -0.45)} + {_term(_acuity, 0.08, -0.16, -0.30)} + {_term(_side, 0.10, -0.18, -0.35)} + {_term(_kind, 0.10, -0.20, -0.35)} + CASE WHEN {_vague('q0')} THEN CASE WHEN {_vague('c0')} THEN 0.08 ELSE -0.10 END WHEN {_vague('c0')} AND ({_stage('q0')} <> '' OR {_acuity('q0')} <> '' OR {_side('q0')} <> '' OR {_kind('q0')} <> '') THEN -0.08 ELSE 0 END)"
_VARIANT_HITS = f"""WITH r AS (SELECT concept_type, code, arg_min(record_name, (priority, record_id)) AS n, min(priority) AS p, list_distinct(flatten(list(coalesce(ttys, [])))) AS ttys FROM kb_records GROUP BY 1, 2),
  f AS (SELECT concept_type, text, code, arg_min(struct_pack(source := v.source, rank := rank), (v.i, rank)) AS x FROM (SELECT concept_type, text, v, v.key AS alias_norm FROM {_VARIANTS}) JOIN {_INDEX} USING (concept_type, alias_norm) GROUP BY 1, 2, 3),
  h AS (SELECT f.concept_type, text, code, x.source AS source, x.rank AS rank, n, p, ttys FROM f JOIN r USING (concept_type, code)),
  d AS (SELECT *, {sql.rx('text')} AS q, {sql.rx('n')} AS c FROM h WHERE concept_type = '{DRUG}'), s AS (SELECT concept_type, text, code, source, rank, p, {rx_sql._MATCH} + {rx_sql._TTY} AS extra FROM {rx_sql._SCORED('d')}),
  g AS (SELECT *, {_SPELL(_K('text'))} AS q0, {_SPELL(_K('n'))} AS c0 FROM h WHERE concept_type <> '{DRUG}'), a AS (SELECT * FROM s UNION ALL SELECT concept_type, text, code, source, rank, p, {_ADJUST} FROM g)
  SELECT concept_type, text, code, source, round(1 - {_PEN} - least(rank, 20) * 0.01 - least(p, 100) * 0.001 + extra, 4) AS score FROM a"""
QUERIES = {f.__name__: f for f in (alias_index, inverted_aliases, grouped_records, capped_aliases, alias_support, united_records, token_postings, drug_postings, exact_lookup, variant_hits, lexical_candidates, lexical_likeness, lexical_hits, drug_hits, selected_codes, emitted_codes, ontology_entries, ontology_hits, ontology_equal, compact_records, aliases_by_type, alias_seed, lexicon_aliases, index_counts, curated_codes, profile_codes, curated_hits, candidate_rows)}
SQL = {
    "alias_index": f"SELECT concept_type, alias_norm, code, priority, rank FROM {_INDEX}",
    "inverted_aliases": f"SELECT concept_type, alias_norm, string_agg(code, '|' ORDER BY rank) AS codes FROM {_INDEX} GROUP BY 1, 2",
    "grouped_records": f"SELECT code, arg_min(name, (r, p, length(name), lower(name), name)) AS record_name, array_to_string(list_sort(list_distinct(list(name))), '|') AS aliases, coalesce(array_to_string(list_sort(list_distinct(list(tty) FILTER (tty IS NOT NULL))), '|'), '') AS ttys, min(priority) AS priority, bool_or(archived) AS archived FROM (SELECT code, unnest(list_filter(list_concat([record_name, name_vi, name_en], aliases), lambda x: x IS NOT NULL)) AS name, ttys[1] AS tty, {_TTY} AS r, CASE WHEN archived THEN 1 ELSE 0 END AS p, priority, archived FROM kb_records) GROUP BY code",
    "capped_aliases": f"SELECT record_id, string_agg(a, '|' ORDER BY k, a) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY k, a) AS r FROM (SELECT DISTINCT record_id, a, {_K('a')} AS k FROM (SELECT record_id, unnest(aliases) AS a FROM kb_records))) WHERE r <= 2 GROUP BY record_id",
    "alias_support": f"SELECT code, count(*) AS n_aliases FROM {_INDEX} WHERE concept_type = '{DRUG}' GROUP BY code",
    "united_records": "WITH e AS (SELECT 0 AS n, concept_type, lower(record_name) AS code, record_name, priority, aliases FROM kb_records UNION ALL SELECT 1, concept_type, term, term, frequency, [] FROM lexicon) SELECT concept_type, code, arg_min(record_name, (n, record_name, priority)) AS record_name, arg_min(priority, (n, record_name, priority)) AS priority, array_to_string(list_sort(list_distinct(flatten(list(coalesce(aliases, []))))), '|') AS aliases FROM e GROUP BY 1, 2",
    "token_postings": f"WITH r AS (SELECT alias, unnest(tokens) AS item FROM {_DOCS}) SELECT item, alias, round(ln(1 + 1 / df), 6) AS idf FROM r JOIN (SELECT item, count(*) AS df FROM r GROUP BY 1) USING (item) WHERE df <= 1600",
    "drug_postings": f"SELECT DISTINCT code, lookup_key FROM (SELECT code, unnest(list_concat([{INGREDIENT}], list_transform(regexp_extract_all(record_name, '\\[([^\\]]+)\\]', 1), lambda t: {_K('t')}))) AS lookup_key FROM (SELECT code, record_name, {sql.tokens(sql.rx('record_name'))} AS w FROM kb_records WHERE concept_type = '{DRUG}')) WHERE length(lookup_key) >= 3",
    "exact_lookup": f"SELECT m.concept_type, text, code, rank FROM (SELECT *, {_K('text')} AS alias_norm FROM {_MENTIONS}) m JOIN {_INDEX} USING (concept_type, alias_norm)",
    "emitted_codes": f"""WITH rules AS (SELECT concept_type, {_K('term')} AS alias_norm, CASE WHEN term_id % 2 = 0 THEN ['isHistorical'] END AS flags, arg_max(CASE WHEN term_id % 3 = 0 THEN []::VARCHAR[] ELSE ['T' || term_id] END, term_id) AS codes FROM lexicon WHERE concept_type IN ('{DIAGNOSIS}', '{DRUG}') GROUP BY ALL),
      c AS (SELECT DISTINCT concept_id, concept_type, {_K('text')} AS alias_norm, list_sort(list_distinct(coalesce(assertions, []))) AS flags, candidates FROM concepts WHERE concept_type IN ('{DIAGNOSIS}', '{DRUG}'))
      SELECT concept_id, array_to_string(coalesce(x.codes, w.codes, candidates), '|') AS emitted FROM c LEFT JOIN (SELECT * FROM rules WHERE flags IS NOT NULL) x ON x.concept_type = c.concept_type AND x.alias_norm = c.alias_norm AND x.flags = c.flags LEFT JOIN (SELECT * FROM rules WHERE flags IS NULL) w ON w.concept_type = c.concept_type AND w.alias_norm = c.alias_norm""",
    "lexical_candidates": f"WITH {_VOTES} SELECT query, alias, votes, vote_rank FROM k",
    "lexical_likeness": f"""WITH {_VOTES}, s AS (SELECT query, alias, q.tokens AS qt, q.grams AS qg, dt, dg, contains(alias, query) OR contains(query, alias) AS inside, least(length(query), length(alias))::DOUBLE / greatest(length(query), length(alias)) AS ratio FROM k JOIN q USING (query)),
      r AS (SELECT *, {_inter('qt', 'dt')} AS n, {_inter('qg', 'dg')} AS g, {_inter('qt', 'dt')}::DOUBLE / greatest(1, len(qt)) AS recall FROM s)
      SELECT query, alias, round(CASE WHEN n = 0 AND g < 3 OR NOT inside AND recall < 0.55 THEN 0 ELSE 0.34 * recall + 0.18 * n / greatest(1, len(dt)) + 0.16 * n / greatest(1, {_union('qt', 'dt')}) + 0.18 * g / greatest(1, {_union('qg', 'dg')}) + CASE WHEN inside THEN 0.10 ELSE 0 END - greatest(0, 0.55 - ratio) * 0.12 END, 6) AS similarity FROM r""",
    "ontology_entries": f"SELECT system, code, x.concept_type AS concept_type, x.record_name AS name, x.priority AS priority, array_to_string(x.aliases, '|') AS aliases FROM {_ONTOLOGY}",
    "ontology_equal": f"""WITH o AS (SELECT DISTINCT concept_type, system, code, priority, {_K('n')} AS key FROM (SELECT x.concept_type AS concept_type, system, code, x.priority AS priority, unnest(list_concat([x.record_name], coalesce(x.aliases, []))) AS n FROM {_ONTOLOGY})),
      m AS (SELECT concept_type, text, {_K('text')} AS k FROM {_MENTIONS}),
      t AS (SELECT concept_type, text, 0 AS stage_no, 'exact' AS stage, k AS key FROM m UNION ALL SELECT concept_type, text, 1, 'without_dose', {_plain('k', f"t IN ({_ROUTES}, 'x')")} FROM m WHERE concept_type = '{DRUG}' UNION ALL SELECT concept_type, text, 2, 'without_form', {_plain('k', f"t IN ({_ROUTES}, 'mg', 'mcg', 'g', 'ml', 'iu') OR regexp_matches(t, '[0-9]')")} FROM m WHERE concept_type = '{DRUG}'),
      h AS (SELECT concept_type, text, stage_no, stage, system, code, min(priority) AS priority FROM t JOIN o USING (concept_type, key) WHERE key <> '' GROUP BY ALL)
      SELECT concept_type, text, stage, row_number() OVER (PARTITION BY concept_type, text ORDER BY priority, system, code) AS rank, system, code FROM (SELECT *, min(stage_no) OVER (PARTITION BY concept_type, text) AS first FROM h) WHERE stage_no = first QUALIFY rank <= 5""",
    "compact_records": f"SELECT concept_type, count(*) AS n, sum(CASE WHEN concept_type = '{DRUG}' THEN 0 ELSE len(aliases) END) AS n_aliases FROM kb_records GROUP BY 1",
    "aliases_by_type": "SELECT DISTINCT concept_type, trim(a) AS alias, code FROM (SELECT concept_type, code, unnest(list_concat([record_name, name_vi, name_en], coalesce(aliases, []), coalesce(alias_norms, []))) AS a FROM kb_records) WHERE trim(a) <> ''",
    "alias_seed": "SELECT text AS alias, concept_type, concept_id AS row_no FROM (SELECT DISTINCT text, concept_type, concept_id FROM concepts WHERE trim(text) <> '') QUALIFY row_number() OVER (PARTITION BY lower(trim(text)), concept_type ORDER BY concept_id) = 1",
    "lexicon_aliases": "SELECT trim(term) AS alias, concept_type, row_number() OVER (PARTITION BY concept_type ORDER BY term) AS row_no FROM lexicon WHERE trim(term) <> ''",
    "index_counts": f"SELECT concept_type, n_records, count(DISTINCT code) AS n_codes, count(DISTINCT alias) AS n_aliases, count(DISTINCT nullif({_K('alias')}, '')) AS n_keys FROM {_EVERY} JOIN (SELECT concept_type, count(*) AS n_records FROM kb_records GROUP BY 1) USING (concept_type) GROUP BY 1, 2",
    "curated_codes": f"SELECT concept_type, alias_norm, rank, code FROM {_CURATED}",
    "curated_hits": f"SELECT m.concept_type, text, code, round(1.65 - 0.025 * min(rank), 4) AS score FROM {_MENTIONS} m JOIN {_CURATED} c ON m.concept_type = c.concept_type AND {_K('text')} = alias_norm GROUP BY 1, 2, 3",
    "profile_codes": f"SELECT concept_type, text, profile, array_to_string(codes, '|') AS codes FROM (SELECT DISTINCT concept_type, c.text, coalesce(note_kind, '?') AS profile, {_K('c.text')} AS alias_norm FROM concepts c JOIN documents d USING (doc_id) WHERE concept_type IN ('{DIAGNOSIS}', '{DRUG}') AND c.text IS NOT NULL) LEFT JOIN (SELECT concept_type, alias_norm, profile, list(code ORDER BY n DESC, code) AS codes FROM {_TRAINED} WHERE profile IS NOT NULL GROUP BY ALL) USING (concept_type, alias_norm, profile)",
    "variant_hits": _VARIANT_HITS,
    "drug_hits": rx_sql.DRUG_HITS(f"SELECT code, count(*) AS n_aliases FROM {_INDEX} WHERE concept_type = '{DRUG}' GROUP BY code"),
    **rx_sql.SQL,
}
