"""Writers. The output committer makes each write atomic; one file per note is written by the tasks themselves."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ontospan.config import CODED
from ontospan.sources.readers import checksum


def concept_rows(concepts: DataFrame) -> DataFrame:
    """(doc_id, concepts): per note its concepts in order, codes only for types that have them."""
    codes = F.when(F.col("type").isin(*CODED), F.coalesce("candidates", F.array().cast("array<string>")))
    item = F.struct("start", "end", "text", "type", F.array("start", "end").alias("position"), F.coalesce("assertions", F.array().cast("array<string>")).alias("assertions"), codes.alias("candidates"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["position"].alias("position"), x["assertions"].alias("assertions"), x["candidates"].alias("candidates")))
    return concepts.groupBy("doc_id").agg(listed.alias("concepts"))


def write_json(concepts: DataFrame, path: str) -> None:
    concept_rows(concepts).write.mode("overwrite").json(path)


def write_files(concepts: DataFrame, folder: str) -> None:
    """One pretty JSON file per note in a folder that all executors share; each file appears whole or not at all."""

    def each(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            items = [{k: v for k, v in c.asDict(recursive=True).items() if v is not None} for c in r.concepts]
            temporary = os.path.join(folder, f".{r.doc_id}.{os.getpid()}.tmp")
            with open(temporary, "w", encoding="utf-8") as f:
                json.dump(items, f, ensure_ascii=False, indent=2)
            os.replace(temporary, os.path.join(folder, f"{r.doc_id}.json"))

    concept_rows(concepts).foreachPartition(each)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_manifest(path: str, files: dict[str, str], counts: dict[str, int]) -> None:
    """A JSON manifest of local files with their checksums, and of row counts; it appears whole or not at all."""
    listed = {name: {"path": file, "sha256": checksum(file)} for name, file in sorted(files.items())}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"files": listed, "counts": counts}, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def status_report(tables: dict[str, DataFrame]) -> str:
    """The inventory as a Markdown table."""
    return "\n".join(["| Table | Rows |", "| --- | --- |", *(f"| {name} | {n} |" for name, n in inventory(tables))])


def inventory(tables: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Names and row counts, for status reports."""
    return [(name, df.count()) for name, df in tables.items()]
