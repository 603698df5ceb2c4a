"""Readers of notes, terminologies and labels. Schemas are given, never inferred; bad rows are skipped, not fatal."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospan.functions.text import natural_order

KB_SCHEMA = "code string, system string, type string, name string, name_vi string, name_en string, priority int, archive boolean, ttys array<string>, aliases array<string>, alias_norms array<string>"
CONCEPT_SCHEMA = "text string, type string, position array<int>, assertions array<string>, candidates array<string>"
# Fields of a classification's JSON lines that name a condition.
ICD_FIELDS = ("disease_name_vi", "disease_name_en", "three_char_name_vi", "three_char_name_en", "guidance", "disease_name_vi_norm", "disease_name_en_norm")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "latin-1")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without a mark in the JVM, else Vietnamese Windows or Latin-1 in Python."""

    @F.pandas_udf(T.StringType())
    def other(values: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            for encoding in ENCODINGS if raw is not None else ():
                try:
                    return bytes(raw).decode(encoding)
                except UnicodeDecodeError:
                    continue
            return None

        return values.map(one)

    plain = F.is_valid_utf8(content.cast("string"))
    return F.when(plain, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(other(F.when(~plain, content)))


def read_notes(spark: SparkSession, folder: str, recursive: bool = True, limit: int | None = None, whole_numbers: bool = False) -> DataFrame:
    """(name, text) of the .txt files of a folder; with a limit the first in natural order of their names. whole_numbers: only names
    that are numbers throughout are ordered by them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    rows = files.select(stem.alias("name"), decoded(F.col("content")).alias("text"))
    if whole_numbers:
        order = [F.coalesce(F.col("name").try_cast("bigint"), F.lit(1_000_000_000)), F.col("name")]
    else:
        order = natural_order(F.col("name"))
    if limit is not None:  # the feature: the first notes in order
        return rows.orderBy(*order).limit(max(0, limit))
    return rows


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; byte-order marks, blank and broken lines are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("v")).where("v <> ''")
    rows = lines.select(F.from_json("v", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")
    return rows.where(F.coalesce(*(F.col(c).cast("string") for c in rows.columns)).isNotNull())


def read_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, idx, text, type, position, assertions, candidates) of JSON files with a list of concepts, or an object with one."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.json$", "")
    item = f"struct<{CONCEPT_SCHEMA.replace(' ', ':').replace(',:', ',')}>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"concepts array<{item}>")["concepts"])
    rows = files.select(stem.alias("name"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return rows.select("name", F.posexplode(listed).alias("idx", "c")).select("name", "idx", "c.*")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Terminology records without those that have no code."""
    return read_jsonl(spark, path, KB_SCHEMA).where("code IS NOT NULL AND code <> ''")


def _pipes(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    parts = F.split("value", r"\|")
    return spark.read.text(path).where(F.size(parts) > max(columns)).select(*(F.get(parts, i).alias(n) for i, n in sorted(columns.items())))


def read_rrf(spark: SparkSession, path: str, ttys: list[str] | None = None) -> DataFrame:
    """(code, name, tty, preferred, priority, archived) of a pipe-delimited main file: English rows of the source, not suppressed."""
    rows = _pipes(spark, path, {0: "code", 1: "lang", 6: "pref", 11: "source", 12: "tty", 14: "name", 16: "suppress"})
    rows = rows.where("lang = 'ENG' AND source = 'RXNORM' AND suppress NOT IN ('O', 'Y') AND name <> '' AND code <> ''")
    rows = rows.where(F.col("tty").isin(ttys)) if ttys else rows
    return rows.select("code", "name", "tty", (F.col("pref") == "Y").alias("preferred"), F.lit(5).alias("priority"), F.lit(False).alias("archived"))


def read_rrf_archive(spark: SparkSession, path: str) -> DataFrame:
    rows = _pipes(spark, path, {2: "name", 6: "code", 8: "lang", 13: "source", 14: "tty"}).where("lang = 'ENG' AND source = 'RXNORM' AND name <> '' AND code <> ''")
    return rows.select("code", "name", "tty", F.lit(False).alias("preferred"), F.lit(50).alias("priority"), F.lit(True).alias("archived"))


def read_icd(spark: SparkSession, path: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(code, name, aliases) of JSON lines with a code and names in several fields."""
    fields = list(fields or ICD_FIELDS)
    rows = read_jsonl(spark, path, "disease_code string, disease_code_nodot string, " + ", ".join(f"{f} string" for f in fields)).where("disease_code <> ''")
    aliases = F.array_distinct(F.filter(F.array(*(F.trim(F.col(f)) for f in fields)), lambda x: x.isNotNull() & (x != "")))
    return rows.select(F.col("disease_code").alias("code"), F.coalesce("disease_name_vi", "disease_name_en").alias("name"), aliases.alias("aliases"))


def read_ontology_csv(spark: SparkSession, path: str, system: str) -> DataFrame:
    """(system, code, name, aliases) of a CSV whose headings may be spelled in several ways; aliases are split at ; and |."""
    raw = spark.read.option("header", True).csv(path)
    of = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*(F.trim(F.col(f"`{of[n]}`")) for n in names if n in of), F.lit(None).cast("string"))
    aliases = F.filter(F.transform(F.split(F.coalesce(pick("aliases", "synonyms"), F.lit("")), r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.lit(system).alias("system"), pick("code", "rxcui", "id").alias("code"), pick("description", "name", "term").alias("name"), aliases.alias("aliases")).where("code <> ''")


def read_ontology_txt(spark: SparkSession, path: str, system: str) -> DataFrame:
    """The same of lines with a code, blanks and a name."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)\s+(.*\S)", 1).alias("code"), F.regexp_extract("value", r"^\s*(\S+)\s+(.*\S)", 2).alias("name"))
    return rows.where("code <> ''").select(F.lit(system).alias("system"), "code", "name", F.array().cast("array<string>").alias("aliases"))


def read_ontology_json(spark: SparkSession, path: str, system: str) -> DataFrame:
    """The same of a JSON list, or an object with `entries`."""
    entry = "struct<code:string,rxcui:string,id:string,name:string,description:string,term:string,aliases:array<string>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{entry}>")).otherwise(F.from_json("value", f"entries array<{entry}>")["entries"])
    rows = raw.select(F.explode(listed).alias("e"))
    return rows.select(F.lit(system).alias("system"), F.coalesce("e.code", "e.rxcui", "e.id").alias("code"), F.coalesce("e.description", "e.name", "e.term").alias("name"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases")).where("code <> ''")


def read_drug_groups(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, tty, aliases) of stored answers with drugGroup.conceptGroup[].conceptProperties[]; aliases are merged per code."""
    schema = "drugGroup struct<name:string,conceptGroup:array<struct<tty:string,conceptProperties:array<struct<rxcui:string,name:string,synonym:string>>>>>"
    groups = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("drugGroup.conceptGroup").alias("g"))
    rows = groups.select("g.tty", F.explode("g.conceptProperties").alias("p")).where("p.rxcui <> ''")
    return rows.groupBy(F.col("p.rxcui").alias("code")).agg(F.min("p.name").alias("name"), F.min("tty").alias("tty"), F.array_sort(F.collect_set(F.nullif("p.synonym", F.lit("")))).alias("aliases"))


def read_lexicon(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """(term, concept_type) of a CSV with term and type; unknown types are ignored."""
    rows = spark.read.schema("term string, type string, source string, frequency int").option("header", True).csv(path)
    return rows.where(F.col("type").isin(types) & (F.trim("term") != "")).select(F.trim("term").alias("term"), F.col("type").alias("concept_type")).distinct()


def read_ontology_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(system, code, name, aliases) of all .csv, .txt and .json files right in a folder: those with `rx` in their name are of drugs,
    those with `icd` of conditions; others are left out. A folder that isn't there gives no rows."""
    readers_ = {".csv": read_ontology_csv, ".txt": read_ontology_txt, ".json": read_ontology_json}
    out = spark.createDataFrame([], "system string, code string, name string, aliases array<string>")
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        stem, suffix = os.path.splitext(name.lower())
        system = "RxNorm" if "rx" in stem else "ICD10" if "icd" in stem else None
        if system and suffix in readers_:
            out = out.unionByName(readers_[suffix](spark, os.path.join(folder, name), system))
    return out


def ontology_or(spark: SparkSession, index: str, otherwise: DataFrame) -> DataFrame:
    """The entries of an index in Parquet if it is there and not empty, else the given ones."""
    try:
        found = spark.read.parquet(index)
        return found if found.limit(1).count() else otherwise
    except AnalysisException:
        return otherwise


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of the first .txt file in each zip archive; archives that can't be read give none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch.content:
                if not zipfile.is_zipfile(io.BytesIO(raw)):
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".txt")]
                    if names:
                        yield pd.DataFrame({"value": z.read(names[0]).decode("utf-8", errors="replace").splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, "value string")


def checksum(path: str) -> str:
    """SHA-256 of a local file, for manifests."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
