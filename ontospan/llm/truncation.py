"""Problem 9: texts cut off by field limits or in transfer.

Method, with SQL functions alone: word trigrams are counted inside texts and at their ends. The final trigram of every text is
joined to the counts: how often it goes on elsewhere (with more words, a full stop or more letters of its last word) and how
often a line or text is finished by it (ends of list items count for list items alone). A text is truncated if its final trigram goes on at least `least` times and finishes
in at most `most_final` of its occurrences. Where the trigram was seen fewer than `least` times, the last two words take its
place; where these too are too rare nothing is known, and the verdict is null.

Words are compared without case, accents and digits; an ellipsis at the end counts as nothing, since some sources put one
where they cut. Copies of one text count once, so that they don't vouch for each other. Texts are read twice, once for their
last lines and once for the counts; neither pass shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospan.llm.folding import FOLD_FROM, FOLD_TO
from ontospan.session import cut, is_small

LEAST = 2
MOST_FINAL = 0.2
SMALL = 500_000  # rows of 8 bytes that are broadcast; beyond, the same rows are joined in a shuffle


def _alphabet() -> tuple[str, str]:
    """Arguments of translate(): the folding, ends of sentences as full stops, pauses as commas, other signs as blanks."""
    folds, gone = dict(zip(FOLD_FROM, FOLD_TO)), {*FOLD_FROM[len(FOLD_TO) :], "�"}
    signs = {**dict.fromkeys("!?", "."), **dict.fromkeys(";:", ","), **dict.fromkeys("\r\n", "\n")}

    def shown(ch: str) -> str:
        return signs.get(ch, ch if ch.isalnum() or ch in ".,%¶" else " ")

    pairs = {k: shown(v) for k, v in folds.items()} | {chr(c): shown(chr(c)) for c in range(1, 128)} | dict.fromkeys("–—“”‘’•·°«»", " ")
    pairs = {k: v for k, v in pairs.items() if k != v and k not in gone}
    return "".join(pairs) + "".join(sorted(gone)), "".join(pairs.values())


ALPHABET = _alphabet()
# patterns and what they become, one after the other; the end of a list item is marked before
LIST_ITEM = r"(?m)^[ \t]*[-+*•][ \t]+([^\r\n]*)"
STEPS = [(r"[0-9]+([.,][0-9]+)*", "0"), (r" *\n[ \n]*", " \n "), (r"([.,])[.,]*( |$)", " $1 ")]
LAST_LINE = r"(?m)^(?=[^\r\n]*[\p{L}\p{N}])([^\r\n]*+)(?:[\r\n]+[^\p{L}\p{N}]*+)*+\z"


def tokens(text: Column) -> Column:
    """Array of words, full stops, commas, ends of list items (¶) and line ends."""
    out = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("¶"), F.lit(" ")), LIST_ITEM, "$1 ¶"), r"[.]{3,}|…", " ")
    out = F.replace(out, F.lit("ß"), F.lit("ss"))
    out = F.lower(F.translate(out, *ALPHABET))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.split(F.trim(out), " +")


def _context(x: Column, y: Column) -> list[Column]:
    """Numbers for the two tokens before a word, on its own line, and for the one before it."""
    return [F.xxhash64(F.when(y == "\n", "\n").otherwise(x), y).alias("ctx"), F.xxhash64(y).alias("prev")]


def final_trigrams(documents: DataFrame) -> DataFrame:
    """(doc_id, source, copy, in_list, stopped, ctx, prev, word) of the last line with a word of every text; copy numbers the text."""
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "source", F.xxhash64("text", F.length("text")).alias("copy"), F.regexp_extract("text", LAST_LINE, 1).alias("line")).where("line <> ''")
    rows = rows.select("doc_id", "source", "copy", tokens(F.col("line")).alias("a"))
    without_last = F.slice("a", 1, F.greatest(F.lit(0), F.size("a") - 1))
    back = lambda a, k: F.coalesce(F.get(a, F.size(a) - k), F.lit("\n"))
    rows = rows.withColumn("in_list", back("a", 1) == "¶").withColumn("a", F.when(F.col("in_list"), without_last).otherwise(F.col("a")))
    stopped, pauses = back("a", 1) == ".", back("a", 1) == ","
    rows = rows.withColumn("stopped", stopped).withColumn("a", F.when(stopped | (pauses & F.col("in_list")), without_last).otherwise(F.col("a")))
    return rows.select("doc_id", "source", "copy", "in_list", "stopped", *_context(back("a", 3), back("a", 2)), back("a", 1).alias("word"))


def trigram_counts(texts: DataFrame, prevs: DataFrame) -> DataFrame:
    """(ctx, prev, word, goes_on, stops, finishes, items): by what follows, how often a trigram occurs; only after the words in prevs."""
    gap, a = F.lit("\n"), F.col("a")
    shifted = F.arrays_zip(F.concat(F.array(gap, gap), a).alias("x"), F.concat(F.array(gap), a).alias("y"), a.alias("word"), F.slice(a, 2, F.size(a)).alias("z"))
    rows = texts.select(tokens(F.col("text")).alias("a")).select(F.inline(shifted)).where("word NOT IN ('.', '¶', '\\n', '')")
    rows = rows.select(*_context(F.col("x"), F.col("y")), "word", "z")
    small = is_small(prevs, SMALL)
    if small:
        rows = rows.join(F.broadcast(prevs), "prev", "left_semi")
    final = F.col("z").isNull() | (F.col("z") == "\n")
    counts = rows.groupBy("ctx", "prev", "word").agg(F.count_if(~final & ~F.col("z").isin(".", "¶")).alias("goes_on"), F.count_if(F.col("z") == ".").alias("stops"), F.count_if(final).alias("finishes"), F.count_if(F.col("z") == "¶").alias("items"))
    return counts if small else counts.join(prevs, "prev", "left_semi")


# how often the words after a context begin with a final word and go on; only for lengths that final words have there
BEGINNINGS = """
SELECT {key}, beginning AS word, sum(n) AS longer
FROM (SELECT {key}, n, explode(transform(filter(lengths, l -> l < length(word)), l -> left(word, l))) AS beginning
      FROM (SELECT {key}, word, sum(goes_on + stops + finishes + items) AS n FROM {counts} GROUP BY {key}, word)
      JOIN (SELECT {key}, collect_set(length(word)) AS lengths FROM {endings} GROUP BY {key}) USING ({key}))
GROUP BY {key}, beginning
"""

# an occurrence that is followed by something counts as going on, but for list items, which are whole if their last word is
VERDICTS = """
SELECT ctx, word, in_list, CASE WHEN on3 + end3 >= {least} THEN on3 >= {least} AND end3 <= {most_final} * (on3 + end3)
                                WHEN on2 + end2 >= {least} THEN on2 >= {least} AND end2 <= {most_final} * (on2 + end2) END AS truncated
FROM (SELECT e.ctx, e.word, e.in_list,
             coalesce(b3.longer, 0) + if(in_list, 0, coalesce(t.goes_on + t.stops, 0)) AS on3, greatest(coalesce(if(in_list, t.goes_on + t.stops + t.finishes + t.items, t.finishes), 1) - 1, 0) AS end3,
             coalesce(b2.longer, 0) + if(in_list, 0, coalesce(w.goes_on + w.stops, 0)) AS on2, greatest(coalesce(if(in_list, w.goes_on + w.stops + w.finishes + w.items, w.finishes), 1) - 1, 0) AS end2
      FROM {endings} e
      LEFT JOIN {counts} t ON t.ctx = e.ctx AND t.word = e.word
      LEFT JOIN (SELECT prev, word, sum(goes_on) AS goes_on, sum(stops) AS stops, sum(finishes) AS finishes, sum(items) AS items FROM {counts} GROUP BY prev, word) w ON w.prev = e.prev AND w.word = e.word
      LEFT JOIN {longer3} b3 ON b3.ctx = e.ctx AND b3.word = e.word
      LEFT JOIN {longer2} b2 ON b2.prev = e.prev AND b2.word = e.word)
"""


def ends(documents: DataFrame, least: int = LEAST, most_final: float = MOST_FINAL) -> DataFrame:
    """(doc_id, source, truncated) of every document with a word in its text; truncated is null where the ending is too rare to tell.

    Null and empty texts have no end and give no row. A text that ends with a full stop, question or exclamation mark is
    whole. An empty table gives no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    finals = cut(final_trigrams(documents))
    endings = cut(finals.where("NOT stopped").select("ctx", "prev", "word", "in_list").distinct())
    first = finals.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = finals.join(first, "copy").where("doc_id > first").select("doc_id").distinct()
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    texts = texts.join(F.broadcast(again) if is_small(again, SMALL) else again, "doc_id", "left_anti")
    counts = cut(trigram_counts(texts, endings.select("prev").distinct()))
    longer3, longer2 = (spark.sql(BEGINNINGS.replace("{key}", k), counts=c, endings=endings) for k, c in (("ctx", counts.join(endings.select("ctx").distinct(), "ctx", "left_semi")), ("prev", counts)))
    verdicts = spark.sql(VERDICTS.replace("{least}", str(int(least))).replace("{most_final}", repr(float(most_final))), counts=counts, endings=endings, longer3=longer3, longer2=longer2)
    verdicts = F.broadcast(verdicts) if is_small(endings, SMALL) else verdicts  # one ending may be that of a third of all texts
    told = finals.join(verdicts, ["ctx", "word", "in_list"], "left")
    return told.select("doc_id", "source", F.when(F.col("stopped"), False).otherwise(F.col("truncated")).alias("truncated"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return ends(spark.read.parquet(f"{sf}/documents.parquet")).where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, as it is spelled apart from case and separators: documents, how many are truncated and how many can't be told."""
    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-_]+", "_")
    found = ends(spark.read.parquet(f"{sf}/documents.parquet"))
    rate = F.coalesce(F.avg(F.col("truncated").cast("double")), F.lit(0.0))  # of those that can be told
    return found.groupBy(source.alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("truncated").isNull()).alias("n_unknown"), F.round(rate, 6).alias("rate"))
