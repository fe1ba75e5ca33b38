"""Names of datasets and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_name(path: Column) -> Column:
    """The file name up to its first dot; a path with a folder but no dot in its file name stays whole."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(path.contains("/") & ~file.contains("."), path).otherwise(F.regexp_extract(file, r"^([^.]*)", 1))


def header_token(header: Column) -> Column:
    """A FASTA header up to its first blank, without the mark."""
    return F.regexp_replace(F.split_part(header, F.lit(" "), F.lit(1)), "^[>@]", "")


def result_name(header: Column) -> Column:
    """The name that result rows carry: at most 50 characters."""
    return F.substring(header_token(header), 1, 50)
