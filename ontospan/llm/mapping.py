"""Problem 4: freely typed values mapped to the entries of a canonical list.

Method, with SQL functions alone: a partition-based pigeonhole join. A reference string of length L within k edits is cut
into k + 1 segments; a typed string within k edits holds one of them unchanged and near its place, so typed substrings are
joined to segments by equality and only those pairs are verified with the built-in levenshtein. Strings are compared
without case, accents, word gaps and punctuation, in the order typed, with words sorted (reordered parts) and as Telex
keystrokes. Every distinct typed value is worked out once. Values that no entry fits come out through an anti join.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.functions.visual import LOOKALIKES
from ontospan.llm.folding import folded
from ontospan.llm.wording import VIETNAMESE, Wording
from ontospan.session import cut

LIMITS = ((2, 1), (6, 2), (8, 3), (10, 4))  # from which length of a reference string on how many edits are allowed
NUMERAL = "^([ivx]+|[0-9]+)$"
SHAPES = {"â": "aa", "ă": "aw", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}
VOWELS = "aăâeêioôơuưy"


def spaced(text: Column) -> Column:
    """Folded words with single blanks between them."""
    return F.trim(F.regexp_replace(folded(text), r"[^a-z0-9]+", " "))


def condition(text: Column, wording: Wording = VIETNAMESE) -> Column:
    """The words of a condition without what is said around it."""
    out = spaced(text)
    if wording.before:
        out = F.regexp_replace(out, rf"^((?:{'|'.join(wording.before)})\s+)+", "")
    if wording.after:
        out = F.regexp_replace(out, rf"(\s+(?:{'|'.join(wording.after)}))+$", "")
    return F.trim(out)


def _flat() -> tuple[str, str]:
    """Arguments of translate() for widths, look-alikes and kinds of blanks; invisible characters at the end are removed."""
    pairs = {**LOOKALIKES, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " ")}
    gone = [chr(c) for c in (0xAD, 0x34F, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)]
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


FLAT = _flat()


def telex(text: Column) -> Column:
    """The keystrokes of the Telex input method for Vietnamese text, composed or not, without word gaps."""
    marks = {"s": "\u0301\u0341", "f": "\u0300\u0340", "r": "\u0309", "x": "\u0303", "j": "\u0323"}
    with_tone = {t: [unicodedata.normalize("NFC", v + m[0]) for v in VOWELS] for t, m in marks.items()}
    shapes = {**SHAPES, **{unicodedata.normalize("NFD", k): v for k, v in SHAPES.items() if k != "đ"}}

    def word(w: Column) -> Column:
        toneless = F.translate(w, "".join("".join(x) for x in with_tone.values()) + "".join(marks.values()), VOWELS * len(marks))
        keys = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), shapes.items(), toneless)
        tone = reduce(lambda c, t: F.when(w.rlike(f"[{''.join(with_tone[t])}{marks[t]}]"), t).otherwise(c), marks, F.lit(""))
        return F.concat(keys, tone)

    return F.regexp_replace(F.array_join(F.transform(F.split(F.lower(F.translate(text, *FLAT)), r"\s+"), word), ""), r"[^a-z0-9]+", "")


def _amount(wording: Wording) -> str:
    units = "|".join(sorted(wording.units, key=lambda u: (-len(u), u)))
    return rf"([0-9]+(?:[.,][0-9]+)?)\s*({units or '(?!)'})(?![a-z0-9])"


def strength(text: Column, wording: Wording = VIETNAMESE) -> Column:
    """The first amount of a drug in the smallest unit; null where there is none."""
    f, amount = folded(text), _amount(wording)
    value = F.regexp_replace(F.regexp_extract(f, amount, 1), ",", ".").try_cast("decimal(18,6)")
    factor = reduce(lambda c, kv: F.when(F.regexp_extract(f, amount, 2) == kv[0], kv[1]).otherwise(c), wording.units.items(), F.lit(None).cast("int"))
    return F.round(value * factor).cast("bigint")


def drug_name(text: Column, wording: Wording = VIETNAMESE) -> Column:
    """What is left of a drug's words without amounts, forms, routes and instructions."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(folded(text), _amount(wording), " "), r"[^a-z]+", " ")), " ")
    return F.array_join(F.array_except(words, F.array(*(F.lit(w) for w in [*wording.around_drug, ""]))), "")


Limits = tuple[tuple[int, int], ...]


def edits(length: Column, limits: Limits = LIMITS) -> Column:
    """How many edits a reference string of this length allows."""
    return reduce(lambda c, x: F.when(length >= x[0], x[1]).otherwise(c), sorted(limits), F.lit(0))


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of k + 1; the later ones take the remainder."""
    base, rest = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    short = k + 1 - rest
    return (i * base + F.greatest(F.lit(0), i - short) + 1).cast("int"), (base + (i >= short).cast("int")).cast("int")


def _shortened(key: Column, k: Column) -> Column:
    """A string and, where k is 1, the strings with one character less: two strings an edit apart have one of these in common."""
    cut_ = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key), F.when(k == 1, cut_).otherwise(F.array().cast("array<string>"))))


def pigeonhole(typed: DataFrame, reference: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(kind, typed, reference, distance) of all pairs of strings of one kind within edits(length of the reference).

    typed and reference have the columns kind and key, each pair once. Null and empty keys match nothing. Both sides may be of
    any size: the join is an equality on kind, length, segment number and segment. Segments of references with one edit would
    be a letter or two, which many strings have; these meet by the whole string with a character left out instead. The pairs
    are spread over all tasks before they are verified. limits: (least length, edits) in rising order.
    """
    most = max([k for _, k in limits], default=0)
    length = F.length("key")
    tasks = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as few bytes take long here
    typed = typed.repartition(tasks, "kind", "key")
    sized = reference.where(length > 0).select("kind", F.col("key").alias("reference"), length.alias("n"), edits(length, limits).alias("k"))
    longest = min([n for n, k in limits if k > 1], default=1 << 30)  # typed strings beyond it by more than one can't be near a short one
    short = sized.where("k <= 1").select("kind", "reference", F.explode(_shortened(F.col("reference"), F.col("k"))).alias("part"))
    near = typed.where((length > 0) & (length <= longest)).select("kind", F.col("key").alias("typed"), F.explode(_shortened(F.col("key"), F.lit(1))).alias("part"))
    pairs = near.join(short, ["kind", "part"]).select("kind", "typed", "reference")
    refs = sized.where("k > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    refs = refs.select("kind", "reference", "n", "i", F.substring("reference", start, size).alias("segment"))
    probes = typed.where(length > 0).select("kind", F.col("key").alias("typed"), length.alias("m"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("longer"))
    probes = probes.withColumn("n", F.col("m") - F.col("longer")).where("n > 0").withColumn("k", edits(F.col("n"), limits)).where((F.abs("longer") <= F.col("k")) & (F.col("k") > 1))
    probes = probes.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    # if the first i segments hold i edits or more there is an unchanged one among the others: shifts are bounded from both ends
    low, high = F.greatest(-F.col("i"), F.col("longer") - (F.col("k") - F.col("i"))), F.least(F.col("i"), F.col("longer") + (F.col("k") - F.col("i")))
    probes = probes.withColumn("low", low).withColumn("high", high).where("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("shift"))
    start, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    probes = probes.withColumn("at", start + F.col("shift")).withColumn("size", size).where((F.col("at") >= 1) & (F.col("at") + F.col("size") <= F.col("m") + 1) & (F.col("size") > 0))
    probes = probes.select("kind", "typed", "n", "i", F.substring("typed", F.col("at"), F.col("size")).alias("segment"))
    pairs = pairs.unionByName(probes.join(refs, ["kind", "n", "i", "segment"]).select("kind", "typed", "reference"))
    pairs = pairs.repartition(tasks, "kind", "typed", "reference").distinct()
    return pairs.withColumn("distance", F.levenshtein("typed", "reference")).where(F.col("distance") <= edits(F.length("reference"), limits))


def entry_names(kb: DataFrame) -> DataFrame:
    """(concept_type, code, name) of every way an entry is named."""
    names = F.explode(F.array_distinct(F.concat(F.array("record_name", "name_vi", "name_en"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return kb.where(F.col("code").isNotNull()).select("concept_type", "code", names.alias("name")).where(F.col("name").isNotNull()).distinct()


def _sorted(words: Column) -> Column:
    return F.array_join(F.array_sort(F.split(words, " ")), "")


def prepared(values: DataFrame, column: str, wording: Wording) -> DataFrame:
    """values with what they are compared by: the words of conditions; name, amount and forms of drugs. Written once, as several
    branches read it, and so that the long expressions stand in one short plan."""
    text, is_drug = F.col(column), F.col("concept_type") == wording.drug
    forms = F.transform(F.split(spaced(text), " "), lambda w: reduce(lambda c, kv: F.when(w == kv[0], kv[1]).otherwise(c), wording.forms.items(), F.lit(None).cast("string")))
    parts = {"words": F.when(~is_drug, condition(text, wording)), "keystrokes_of": F.when(~is_drug, telex(text)), "drug": F.when(is_drug, drug_name(text, wording)), "amount": F.when(is_drug, strength(text, wording)), "forms": F.when(is_drug, F.array_distinct(F.filter(forms, lambda x: x.isNotNull())))}
    return cut(values.select(*values.columns, *(c.alias(n) for n, c in parts.items())))


def conditions_mapped(values: DataFrame, names: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(concept_type, text, code) of conditions. An entry fits if all words that are known from entries are among its own, and
    what is left of both, if anything, differs by no more than half and is nearly of one length."""
    typed, refs = values.where(F.length("words") > 0), names.where(F.length("words") > 0)
    squashed = F.replace(F.col("words"), F.lit(" "), F.lit(""))
    kinds = lambda *forms: F.explode(F.array(*(F.struct(F.concat_ws("/", F.lit(k), "concept_type").alias("kind"), c.alias("key"), F.lit(typed_so).alias("keystrokes")) for k, c, typed_so in forms))).alias("f")
    own = [("plain", squashed, False), ("sorted", _sorted(F.col("words")), False)]
    typed_keys = typed.select("concept_type", "words", kinds(*own)).select("concept_type", "words", "f.kind", "f.key").distinct()
    ref_keys = refs.select("code", F.col("words").alias("ref_words"), "concept_type", kinds(*own, ("plain", F.col("keystrokes_of"), True))).select("code", "ref_words", "f.*").distinct()
    pairs = pigeonhole(typed_keys.select("kind", "key").distinct(), ref_keys.select("kind", "key").distinct(), limits)
    candidates = pairs.join(typed_keys.withColumnRenamed("key", "typed"), ["kind", "typed"]).join(ref_keys.withColumnRenamed("key", "reference"), ["kind", "reference"])
    candidates = candidates.groupBy("concept_type", "words", "code", "ref_words", "keystrokes").agg(F.min("distance").alias("distance"))
    known = refs.select("concept_type", F.explode(F.split("words", " ")).alias("word")).distinct()
    in_words = typed.select("concept_type", "words").distinct().select("concept_type", "words", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    known_words = in_words.join(known.withColumn("known", F.lit(True)), ["concept_type", "word"], "left").where(F.col("known") | F.col("word").rlike(NUMERAL))
    known_words = known_words.groupBy("concept_type", "words").agg(F.collect_set("word").alias("known_words"))
    candidates = candidates.join(known_words, ["concept_type", "words"], "left")
    mine, its = F.split("words", " "), F.split("ref_words", " ")
    strange = F.array_except(F.coalesce("known_words", F.array().cast("array<string>")), its)
    extra, missing = F.array_join(F.array_except(mine, its), ""), F.array_join(F.array_except(its, mine), "")
    # a slip may give another known word, if that is a letter away from the word it stands for and little else is wrong
    slip = (F.size(strange) == 1) & ~F.element_at(strange, 1).rlike(NUMERAL) & (F.col("distance") <= 2) & F.exists(F.array_except(its, mine), lambda w: F.levenshtein(w, F.element_at(strange, 1)) <= 1)
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (F.levenshtein(extra, missing) <= 2) & (letters(extra) == letters(missing))
    # words can't be compared with what was typed as keystrokes
    near = F.col("keystrokes") | (F.col("distance") == 0) | swapped | ((F.abs(F.length(extra) - F.length(missing)) <= 2) & (F.levenshtein(extra, missing) * 2 <= F.length(missing)))
    fits = candidates.where(((F.size(strange) == 0) | F.when(F.size(strange) == 1, slip).otherwise(False)) & near)
    best = fits.groupBy("concept_type", "words").agg(F.min(F.struct("distance", "code")).alias("best"))
    return typed.select("concept_type", "text", "words").join(best, ["concept_type", "words"]).select("concept_type", "text", F.col("best.code").alias("code"))


def drugs_mapped(values: DataFrame, names: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(concept_type, text, code) of drugs: the nearest names are found without the amount, then the amount must be equal; of
    several entries one in the form that is typed comes first."""
    typed = values.where("length(drug) > 0 AND amount IS NOT NULL").select("concept_type", "text", F.col("drug").alias("typed"), "amount", F.col("forms").alias("typed_forms"))
    refs = names.where("length(drug) > 0").select("concept_type", "code", F.col("drug").alias("reference"), "amount", F.col("forms").alias("ref_forms")).distinct()
    pairs = pigeonhole(typed.select(F.col("concept_type").alias("kind"), F.col("typed").alias("key")).distinct(), refs.select(F.col("concept_type").alias("kind"), F.col("reference").alias("key")).distinct(), limits)
    nearest = pairs.groupBy("kind", "typed").agg(F.min("distance").alias("distance")).join(pairs, ["kind", "typed", "distance"]).withColumnRenamed("kind", "concept_type")
    hits = typed.join(nearest, ["concept_type", "typed"]).join(refs, ["concept_type", "reference", "amount"])
    other_form = (F.size(F.array_except("typed_forms", "ref_forms")) > 0).cast("int")
    return hits.groupBy("concept_type", "text").agg(F.min(F.struct(other_form.alias("other_form"), "code")).alias("best")).select("concept_type", "text", F.col("best.code").alias("code"))


def mapped(values: DataFrame, kb: DataFrame, wording: Wording = VIETNAMESE, limits: Limits = LIMITS) -> DataFrame:
    """(concept_type, text, code) of the distinct typed values that mean an entry of their type; the others give no row.

    Null types and texts mean nothing. Of several fitting entries the nearest, then the smallest code, is taken.
    wording: what may be typed around names, and the type that has amounts; limits: edits by length.
    """
    known = F.col("concept_type").isNotNull()
    distinct = prepared(values.select("concept_type", "text").where(F.col("text").isNotNull() & known).distinct(), "text", wording)
    names = prepared(entry_names(kb).where(known), "name", wording)
    is_drug = F.col("concept_type") == wording.drug
    return conditions_mapped(distinct.where(~is_drug), names.where(~is_drug), limits).unionByName(drugs_mapped(distinct.where(is_drug), names.where(is_drug), limits))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    concepts = spark.read.parquet(f"{sf}/concepts.parquet")
    typed = concepts.where(F.size("candidates") == 0).select("concept_id", "concept_type", "text").distinct()
    codes = cut(mapped(typed, spark.read.parquet(f"{sf}/kb_records.parquet")))
    found = typed.join(codes, ["concept_type", "text"]).select("concept_id", "code")
    unmatched = typed.join(codes, ["concept_type", "text"], "left_anti").select("concept_id", F.lit("NONE").alias("code"))
    return found.unionByName(unmatched).distinct()


def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct typed values that no entry fits, with the number of annotations."""
    concepts = spark.read.parquet(f"{sf}/concepts.parquet")
    typed = concepts.where(F.size("candidates") == 0).select("concept_id", "concept_type", "text").distinct()
    codes = mapped(typed, spark.read.parquet(f"{sf}/kb_records.parquet"))
    return typed.join(codes, ["concept_type", "text"], "left_anti").groupBy("concept_type", "text").agg(F.count("*").alias("n"))
