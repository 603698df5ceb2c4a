"""ontospan: concept spans, terminology coding and annotation data jobs on Spark DataFrames."""

__version__ = "0.1.0"
