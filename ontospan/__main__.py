"""Command line: python -m ontospan annotate|build-kb|run-query ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ontospan")
    commands = parser.add_subparsers(dest="command", required=True)
    annotate = commands.add_parser("annotate", help="notes in a folder to concepts, one JSON file each")
    for name in ("notes", "lexicon", "kb", "out"):
        annotate.add_argument(name)
    build = commands.add_parser("build-kb", help="a pipe-delimited terminology file to grouped records")
    for name in ("rrf", "out"):
        build.add_argument(name)
    query = commands.add_parser("run-query", help="a registered query over a folder of tables, to a folder")
    for name in ("name", "tables", "out"):
        query.add_argument(name)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("ontospan").getOrCreate()
    from ontospan.operators import terminology
    from ontospan.plans import catalogue, pipeline
    from ontospan.sources import readers, writers

    if given.command == "annotate":
        documents = readers.read_notes(spark, given.notes).selectExpr("name AS doc_id", "text")
        writers.write_files(pipeline.annotated(documents, spark.read.parquet(given.lexicon), spark.read.parquet(given.kb)), given.out)
    elif given.command == "build-kb":
        writers.write_table(terminology.grouped_records(readers.read_rrf(spark, given.rrf)), given.out)
    else:
        catalogue.queries()[given.name](spark, given.tables).write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
