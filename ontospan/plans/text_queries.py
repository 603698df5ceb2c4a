"""Queries of the scalar text and medication functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.config import DRUG
from ontospan.functions import rx
from ontospan.functions import text as T
from ontospan.operators import evaluate, notes
from ontospan.plans import sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def norm_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_key(F.col("text")).alias("key"))


def compact_key_counts(spark, sf):
    return table(spark, sf, "concepts").groupBy(T.compact_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


def line_profiles(spark, sf):
    rows = notes.lines(table(spark, sf, "documents")).select("doc_id", T.line_profile(F.col("end") - F.col("start")).alias("profile"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("profile") == "short_line").alias("n_short"), F.count_if(F.col("profile") == "long_line").alias("n_long"))


def line_offsets(spark, sf):
    return notes.lines(table(spark, sf, "documents")).select("doc_id", "line_no", "start", "end")


def in_context(spark, sf, **made) -> DataFrame:
    """Concepts (concept_id, start, end, type) with what `made` works out of their note's text (text, start, end). Spans are
    gathered per document and worked on as an array, so that a text is shuffled once and never copied per concept."""
    spans = table(spark, sf, "concepts").where(F.size("char_position") == 2).select("doc_id", F.struct("concept_id", F.col("char_position")[0].alias("start"), F.col("char_position")[1].alias("end"), F.col("concept_type").alias("type")).alias("x"))
    per_doc = spans.groupBy("doc_id").agg(F.collect_set("x").alias("xs"))
    joined = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", "text").join(per_doc, "doc_id")
    each = lambda x: F.struct(*(x[c].alias(c) for c in ("concept_id", "start", "end", "type")), *(f(F.col("text"), x["start"], x["end"]).alias(n) for n, f in made.items()))
    return joined.select("doc_id", F.inline(F.transform("xs", each)))


def clause_tails(spark, sf):
    rows = in_context(spark, sf, clause=lambda t, s, e: T.clause_before(t, s), snippet=lambda t, s, e: T.snippet(t, s, e, 35))
    return rows.select("concept_id", "clause", "snippet")


def span_lines(spark, sf):
    return in_context(spark, sf, line_chars=T.line_length).select("concept_id", "line_chars")


def trimmed_spans(spark, sf):
    rows = table(spark, sf, "chunks").select("chunk_id", T.trim_span(F.col("text"), F.col("start_pos")).alias("x")).distinct()
    return rows.select("chunk_id", F.col("x.start").alias("first"), F.col("x.end").alias("last"), F.length("x.text").alias("n"))


def char_trigrams(spark, sf):
    rows = table(spark, sf, "kb_records").select("record_id", F.explode(T.char_ngrams(T.normalize_key(F.col("record_name")))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


def jaccard_names(spark, sf):
    words = lambda c: F.array_distinct(T.condition_tokens(T.normalize_key(F.col(c))))
    return table(spark, sf, "kb_records").where("name_vi IS NOT NULL").select("record_id", F.round(T.jaccard(words("record_name"), words("name_vi")), 6).alias("jaccard"))


def token_likeness(spark, sf):
    words = lambda c: T.tokens(T.normalize_key(F.col(c)))
    return table(spark, sf, "kb_records").where("name_vi IS NOT NULL").select("record_id", F.round(T.token_score(words("record_name"), words("name_vi")), 6).alias("score"))


def confidences(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(T.confidence(F.col("value") / 100), 6).alias("confidence"))


def natural_names(spark, sf):
    order = T.natural_order(F.col("case_id"))
    return table(spark, sf, "documents").where("case_id IS NOT NULL").select("case_id").distinct().select("case_id", order[0].alias("number"))


def drugs(spark, sf):
    return table(spark, sf, "concepts").where((F.col("concept_type") == DRUG) & F.col("text").isNotNull()).select("text").distinct()


def rx_forms(spark, sf):
    n = rx.normalize_rx(F.col("text"))
    return drugs(spark, sf).select("text", n.alias("rx"), rx.without_count(n).alias("no_count"))


def rx_strengths(spark, sf):
    return drugs(spark, sf).select("text", F.array_join(F.array_sort(rx.strengths(rx.normalize_rx(F.col("text")))), "|").alias("strengths"))


def rx_prefixes(spark, sf):
    n = rx.normalize_rx(F.col("text"))
    return drugs(spark, sf).select("text", rx.without_route(n).alias("core"), rx.without_modifiers(n).alias("ingredient"), rx.without_leading_dose(n).alias("rest"))


def rx_lookup_keys(spark, sf):
    return drugs(spark, sf).select("text", F.array_join(rx.lookup_keys(F.col("text")), "|").alias("keys"))


def rx_match_scores(spark, sf):
    """Drug records against each other by ingredient: the score of every record for the first record of its ingredient."""
    kb = table(spark, sf, "kb_records").where(F.col("concept_type") == DRUG).withColumn("rx", rx.normalize_rx(F.col("record_name"))).withColumn("ingredient", rx.without_modifiers(F.col("rx")))
    first = kb.groupBy("ingredient").agg(F.min_by("rx", "record_id").alias("query"))
    score = rx.match_score(F.col("query"), F.col("rx"), F.col("record_name")) + rx.tty_score(F.col("query"), F.col("ttys"))
    return kb.join(first, "ingredient").select("record_id", F.round(score, 4).alias("score"), rx.strength_relation(rx.strengths(F.col("query")), rx.strengths(F.col("rx"))).alias("relation"))


def rx_extents(spark, sf):
    rows = in_context(spark, sf, after=lambda t, s, e: F.substring(t, e + 1, F.lit(rx.AHEAD))).where(F.col("type") == DRUG)
    return rows.select("concept_id", (F.col("end") + rx.extended_end(F.col("after"), F.lit(0))).alias("new_end"))


def event_values(spark, sf):
    return evaluate.run_summary(table(spark, sf, "events"), "value", ["event_type"])


def event_props(spark, sf):
    """Key and value pairs of the JSON properties, with the number of events."""
    pairs = table(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return pairs.groupBy("name", "value").agg(F.count("*").alias("n"))


K = sql.key
QUERIES = {f.__name__: f for f in (norm_key, compact_key_counts, token_counts, line_profiles, line_offsets, clause_tails, span_lines, trimmed_spans, char_trigrams, jaccard_names, token_likeness, confidences, natural_names, rx_forms, rx_strengths, rx_prefixes, rx_lookup_keys, rx_match_scores, rx_extents, event_values, event_props)}
DRUGS = f"(SELECT DISTINCT text FROM concepts WHERE concept_type = '{DRUG}' AND text IS NOT NULL)"
STOPS = ", ".join(f"'{w}'" for w in T.CONDITION_STOPS)
NOTE = "(SELECT DISTINCT concept_id, char_position[1] AS s, char_position[2] AS e, concept_type AS type, d.text FROM concepts c JOIN documents d USING (doc_id) WHERE len(char_position) = 2 AND d.text IS NOT NULL)"
LINES = "(SELECT doc_id, i - 1 AS line_no, parts[i] AS line, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS r(i))"
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_until = lambda stop: f"array_to_string(w[1:coalesce(list_position(list_transform(w, lambda t: {stop}), true), len(w) + 1) - 1], ' ')"
INGREDIENT = _until(f"t IN ({_in(rx.FORMS + rx.ROUTES + rx.FREQUENCIES + rx.COUNTS)}) OR regexp_matches(t, '[0-9]')")
_UNIT = "(mg|g|mcg|ml|iu|unit|units|%)"
_CANONICAL = f"CASE WHEN regexp_full_match(t, '[0-9]+([.][0-9]+)?{_UNIT}') THEN regexp_replace(regexp_replace(CAST(CAST(CAST(regexp_extract(t, '^[0-9.]+') AS DECIMAL(24, 6)) * CASE WHEN regexp_extract(t, '[a-z%]+$') = 'g' THEN 1000 ELSE 1 END AS DECIMAL(30, 6)) AS VARCHAR), '0+$', ''), '[.]$', '') || CASE WHEN regexp_extract(t, '[a-z%]+$') = 'g' THEN 'mg' ELSE regexp_extract(t, '[a-z%]+$') END ELSE t END"
SQL = {
    "norm_key": f"SELECT doc_id, {K('text')} AS key FROM documents",
    "compact_key_counts": f"SELECT regexp_replace({K('text')}, '[^a-z0-9]+', '', 'g') AS key, count(*) AS n FROM concepts GROUP BY 1",
    "token_counts": f"SELECT doc_id, len({sql.tokens(K('text'))}) AS n FROM documents",
    "line_profiles": f"SELECT doc_id, count(*) FILTER (length(line) < 300) AS n_short, count(*) FILTER (length(line) >= 300) AS n_long FROM {LINES} GROUP BY doc_id",
    "line_offsets": f"SELECT doc_id, line_no, s AS start, s + length(line) AS \"end\" FROM {LINES}",
    "clause_tails": f"SELECT concept_id, regexp_extract(string_split(text[1:s], chr(10))[-1], '[^.;:]*$') AS clause, replace(text[greatest(0, s - 35) + 1:e + 35], chr(10), ' ') AS snippet FROM {NOTE}",
    "span_lines": f"SELECT concept_id, length(string_split(text[1:s], chr(10))[-1]) + e - s + length(string_split(text[e + 1:], chr(10))[1]) AS line_chars FROM {NOTE}",
    "trimmed_spans": "SELECT DISTINCT chunk_id, start_pos + length(text) - length(l) AS first, start_pos + length(text) - length(l) + length(t) AS last, length(t) AS n FROM (SELECT chunk_id, start_pos, text, l, regexp_replace(regexp_replace(l, '[ \\t\\n\\x0B\\f\\r]+$', ''), '[.,;:]+$', '') AS t FROM (SELECT *, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+', '') AS l FROM chunks))",
    "char_trigrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, length(c) - 1), lambda i: c[i:i + 2]))) AS gram FROM (SELECT regexp_replace({K('record_name')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS c FROM kb_records) WHERE length(c) >= 3) GROUP BY gram",
    "jaccard_names": f"SELECT record_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT record_id, list_distinct(list_filter(string_split({K('record_name')}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({STOPS}))) AS a, list_distinct(list_filter(string_split({K('name_vi')}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({STOPS}))) AS b FROM kb_records WHERE name_vi IS NOT NULL)",
    "token_likeness": f"SELECT record_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE greatest(0.0, 1 - levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(40 + list_position(k, x) AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(40 + list_position(k, x) AS INT))), '')) / len(a)) END, 6) AS score FROM (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS k FROM (SELECT record_id, {sql.tokens(K('record_name'))} AS a, {sql.tokens(K('name_vi'))} AS b FROM kb_records WHERE name_vi IS NOT NULL))",
    "confidences": "SELECT event_id, round(CASE WHEN value IS NULL OR isnan(value) THEN 0.75 ELSE greatest(0.0, least(1.0, value / 100)) END, 6) AS confidence FROM events",
    "natural_names": "SELECT DISTINCT case_id, coalesce(try_cast(regexp_extract(case_id, '[0-9]+') AS BIGINT), 1000000000) AS number FROM documents WHERE case_id IS NOT NULL",
    "rx_forms": f"SELECT text, rx, trim(regexp_replace(regexp_replace(rx, '\\s+x\\s*\\d+(?:\\s+(?:ngay|day|days))?\\b.*$', '', 'g'), '\\s+', ' ', 'g')) AS no_count FROM (SELECT text, {sql.rx('text')} AS rx FROM {DRUGS})",
    "rx_prefixes": f"SELECT text, {_until(f'string_split(t, chr(58))[1] IN ({_in(rx.ROUTES + rx.FREQUENCIES)}) OR t IN ({_in(rx.COUNTS)}) OR regexp_full_match(t, chr(113) || chr(92) || chr(100) || chr(43) || chr(104) || chr(58) || chr(63) || chr(112) || chr(114) || chr(110) || chr(63))')} AS core, {_until(f'''t IN ({_in(rx.FORMS + rx.ROUTES + rx.FREQUENCIES + rx.COUNTS)}) OR regexp_matches(t, '[0-9]')''')} AS ingredient, array_to_string(w[coalesce(list_position(list_transform(w, lambda t: NOT (regexp_matches(t, '[0-9]') OR t IN ({_in(rx.UNITS + rx.ROUTES + rx.COUNTS)}) OR string_split(t, ':')[1] IN ({_in(rx.FREQUENCIES)}))), true), len(w) + 1):], ' ') AS rest FROM (SELECT text, {sql.tokens(sql.rx('text'))} AS w FROM {DRUGS})",
    "rx_strengths": f"SELECT text, array_to_string(list_sort(list_distinct(list_transform(list_transform(regexp_extract_all({sql.rx('text')}, '{rx.STRENGTH}'), lambda t: replace(replace(t, ',', '.'), ' ', '')), lambda t: {_CANONICAL}))), '|') AS strengths FROM {DRUGS}",
    "event_values": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "event_props": "SELECT name, json_extract_string(props, '$.' || name) AS value, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS name FROM events) GROUP BY 1, 2",
}
