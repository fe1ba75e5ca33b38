"""Result sinks: TSV, Parquet, and where results go."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.operators.lookup import wide

HEADER = "query"


def run_tag() -> str:
    """Date and a random number, the suffix of default folders."""
    return f"{time.strftime('%Y%m%d_%H%M%S')}_{random.randrange(10**6):06d}"


def query_base(path: str) -> str:
    """A query file's name up to its first dot, at most 50 characters."""
    return os.path.basename(path).split(".")[0][:50]


def writable(folder: str) -> bool:
    return os.path.isdir(folder) and os.access(folder, os.W_OK)


def output_path(output: str | None, query: str, threshold: int, counter: int = 0) -> str:
    """A file as named, or a generated name in the folder named, or in ./query_results; the folder is made.

    A folder that can't be written to raises a PermissionError."""
    name = f"out_query_abundex_P{threshold}_{query_base(query)}_{counter}.out"
    if output is None:
        output = "./query_results"
    elif os.path.splitext(output)[1]:
        folder, name, output = os.path.dirname(output) or ".", os.path.basename(output), None
    else:
        folder = None
    if output is not None:
        folder = output if output == "./query_results" else os.path.join(output, "query_results")
    parent = folder
    while parent and not os.path.isdir(parent):
        parent = os.path.dirname(parent) or "."
    if not writable(parent):
        raise PermissionError(22, "the output folder isn't writable", folder)
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, name)


def tsv_lines(result: DataFrame, datasets: DataFrame) -> DataFrame:
    """(query_ord, value): one line a query, its name and a cell for every dataset."""
    table = wide(result, datasets)
    cells = [c for c in table.columns if c not in ("query_ord", "query")]
    return table.select("query_ord", F.concat_ws("\t", "query", *cells).alias("value"))


def header_line(datasets: DataFrame) -> str:
    return "\t".join([HEADER, *(r["name"] for r in datasets.select("name").orderBy("dataset_id").collect())])


def write_tsv(result: DataFrame, datasets: DataFrame, path: str) -> int:
    """One file with a header, in query order; lines stream through the driver. Returns the number of rows."""
    n = 0
    with open(path, "w") as f:
        f.write(header_line(datasets) + "\n")
        for r in tsv_lines(result, datasets).orderBy("query_ord").toLocalIterator(prefetchPartitions=True):
            f.write(r["value"] + "\n")
            n += 1
    return n


def write_parquet(result: DataFrame, path: str) -> None:
    """The long form, for results too large for one file."""
    result.write.parquet(path)
