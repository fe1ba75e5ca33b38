"""Sequence sources: files of files, unitig FASTA, query FASTA, reads, and text columns of tables.

Readers split files at record marks with the text source's lineSep, so Spark reads plain files in splits and gzip files
whole. Order of queries comes from the record's place in the file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions.abundance import count_sum, mean_abundance
from abundex.functions.kmers import acgt_only
from abundex.functions.names import dataset_name


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_fof(spark: SparkSession, path: str, paired: bool = False) -> DataFrame:
    """datasets(dataset_id, name, path, mate): the existing files of a file of files, in order.

    Blank and missing lines are passed over; without any file a ValueError is raised. paired: two lines make a dataset,
    named by both; an odd number of files is an error."""
    lines = [r["value"].strip() for r in spark.read.text(path, wholetext=False).collect()]
    files = [x for x in lines if x and _exists(spark, x)]
    if not files:
        raise ValueError(f"{path}: no file of it exists")
    if paired and len(files) % 2:
        raise ValueError(f"{path}: paired files must be even in number")
    rows = [(i // 2, files[i], files[i + 1]) for i in range(0, len(files), 2)] if paired else [(i, f, None) for i, f in enumerate(files)]
    out = spark.createDataFrame(rows, "dataset_id int, path string, mate string")
    name = dataset_name(F.col("path"))
    return out.select("dataset_id", F.when(F.col("mate").isNotNull(), F.concat_ws("_", name, dataset_name(F.col("mate")))).otherwise(name).alias("name"), "path", "mate")


def missing_files(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file of files that name no file."""
    return [x for r in spark.read.text(path).collect() if (x := r["value"].strip()) and not _exists(spark, x)]


def _plain(spark: SparkSession, path: str) -> str:
    """A path as _plain_column() shows the files read from it: qualified, without scheme and escapes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^[A-Za-z0-9]+:/*", "/", full)


def _plain_column(file):
    return F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^[A-Za-z0-9]+:/*", "/")


def _records(spark: SparkSession, path, mark: str) -> DataFrame:
    """header (without the mark) and body (the lines after it) of every record."""
    raw = spark.read.text(path, lineSep=f"\n{mark}")
    text = F.regexp_replace(F.regexp_replace("value", f"^{mark}", ""), "\r", "")
    return raw.select(F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), text.alias("t")).where(F.length(F.trim("t")) > 0).select("at", "file", F.substring_index("t", "\n", 1).alias("header"), F.when(F.instr("t", "\n") > 0, F.expr("substring(t, instr(t, '\n') + 1)")).otherwise("").alias("body"))


def read_unitigs(spark: SparkSession, datasets: DataFrame, k: int) -> DataFrame:
    """unitigs(dataset_id, unitig_id, ln, kc, km, links, seq) of all datasets; sequences shorter than k are dropped."""
    listed = [(r["dataset_id"], r["path"], _plain(spark, r["path"])) for r in datasets.select("dataset_id", "path").collect()]
    known = spark.createDataFrame([(i, p) for i, _, p in listed], "dataset_id int, _file string")
    # one scan of all files: a plan with a branch for each of thousands of datasets would be slow to make
    rows = _records(spark, sorted({p for _, p, _ in listed}), ">").withColumn("_file", _plain_column(F.col("file"))).join(F.broadcast(known), "_file")
    h = F.col("header")
    seq = F.upper(F.regexp_replace("body", r"\s", ""))
    return rows.select(
        "dataset_id",
        F.split_part(h, F.lit(" "), F.lit(1)).alias("unitig_id"),
        F.regexp_extract(h, r"LN:i:([0-9]+)", 1).try_cast("int").alias("ln"),
        count_sum(h).alias("kc"),
        mean_abundance(h).alias("km"),
        F.regexp_extract_all(h, F.lit(r"(L:\S+)"), F.lit(1)).alias("links"),
        seq.alias("seq"),
    ).where(F.length("seq") >= k)


def parse_queries(spark: SparkSession, path: str, k: int) -> DataFrame:
    """query_ord, header, seq and reason (null if accepted) of every record of a FASTA file."""
    rows = _records(spark, path, ">")
    seq = F.upper(F.regexp_replace("body", r"\s", ""))
    reason = F.when(F.length("seq") == 0, "empty").when(~F.col("seq").rlike("^[ACGT]+$"), "other characters").when(F.length("seq") < k, "shorter than k")
    return rows.select(F.col("at").alias("query_ord"), F.split_part("header", F.lit(" "), F.lit(1)).alias("header"), seq.alias("seq")).withColumn("reason", reason)


def read_queries(spark: SparkSession, path: str, k: int) -> DataFrame:
    """queries(query_ord, header, seq): records of at least k bases, all of them A, C, G or T after upper-casing."""
    return parse_queries(spark, path, k).where(F.col("reason").isNull()).drop("reason")


def rejected_queries(spark: SparkSession, path: str, k: int) -> DataFrame:
    return parse_queries(spark, path, k).where(F.col("reason").isNotNull())


def read_reads(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    """reads(dataset_id, seq) of FASTA or FASTQ files (by name), mates included; other characters cut reads later."""
    listed = [(r["dataset_id"], f, any(x in f.lower() for x in (".fastq", ".fq"))) for r in datasets.select("dataset_id", "path", "mate").collect() for f in (r["path"], r["mate"]) if f]
    out = None
    # one scan of all files of a kind, as in read_unitigs()
    for fastq in sorted({q for *_, q in listed}):
        own = [(i, _plain(spark, f)) for i, f, q in listed if q == fastq]
        known = spark.createDataFrame(own, "dataset_id int, _file string")
        rows = _records(spark, sorted({f for _, f in own}), "@" if fastq else ">").withColumn("_file", _plain_column(F.col("file"))).join(F.broadcast(known), "_file")
        if fastq:
            # a quality line may begin with the mark too; then its record ends in the plus line, and the rest has none
            lines = F.split("body", "\n")
            one = rows.where(F.size(lines) >= 2).where(lines[1].startswith("+")).select("dataset_id", F.upper(F.trim(lines[0])).alias("seq"))
        else:
            one = rows.select("dataset_id", F.upper(F.regexp_replace("body", r"\s", "")).alias("seq"))
        out = one if out is None else out.unionByName(one)
    return out


def interleave_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mates (at, header, seq) of two files, record by record, as FASTA text lines."""
    one = lambda df, side: df.select("at", F.lit(side).alias("side"), F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.upper("seq")).alias("value"))
    return one(left, 0).unionByName(one(right, 1)).orderBy("at", "side").select("value")


def read_kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """kmer_counts(kmer, count) of a white-space separated dump."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("kmer"), parts[1].cast("bigint").alias("count"))


def read_samples(spark: SparkSession, path: str, label: str) -> DataFrame:
    """cohort(sample, label) of a list with one accession a line."""
    return spark.read.text(path).select(F.trim("value").alias("sample"), F.lit(label).alias("label")).where(F.length("sample") > 0)


def unitig_reads(lines: DataFrame) -> DataFrame:
    """(unitig, reads) of path lines `read;+1;-7;...`: for each unitig number, the reads that pass it."""
    parts = F.filter(F.split("value", ";"), lambda x: F.length(x) > 0)
    flat = lines.select(F.col("read"), F.explode(parts).alias("u"))
    return flat.select(F.abs(F.col("u").cast("int")).alias("unitig"), "read").distinct().groupBy("unitig").agg(F.array_sort(F.collect_list("read")).alias("reads"))


def table_sequences(table: DataFrame, text: str, dataset: str, abundance) -> DataFrame:
    """sequences(dataset, seq, count): a text column reduced to A, C, G and T."""
    return table.select(F.col(dataset).alias("dataset"), acgt_only(F.coalesce(F.col(text), F.lit(""))).alias("seq"), abundance.cast("int").alias("count"))
