"""Queries against the matrix: k-mer lookup, coverage and result formats.

A query of n k-mers (n + k - 1 bases) has a cell for every dataset. hits(query_ord, dataset_id, pos, count) are the
found k-mers; cells without hits follow from the list of datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.names import result_name
from abundex.operators.matrix import positions

FORMATS = ("raw", "sum", "average", "normalize")


def check_format(name: str) -> str:
    name = {"s": "sum", "a": "average", "n": "normalize", "r": "raw"}.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(FORMATS)}")
    return name


def query_kmers(queries: DataFrame, k: int, code: bool = True) -> DataFrame:
    """(query_ord, pos, kmer) of queries(query_ord, seq)."""
    return positions(queries, k, ["query_ord"], code)


def hits(kmers: DataFrame, matrix: DataFrame) -> DataFrame:
    """Found k-mers of the queries. The distinct query k-mers prune the matrix before positions are joined."""
    wanted = kmers.select("kmer").distinct()
    found = matrix.join(wanted, "kmer", "left_semi")
    return kmers.join(found, "kmer").select("query_ord", "dataset_id", "pos", "count")


def bucket(kmer: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kmer), F.lit(buckets)).cast("int").alias("bucket")


def index_hits(kmers: DataFrame, kmer_class: DataFrame, classes: DataFrame, buckets: int | None = None) -> DataFrame:
    """The same from an index: k-mer -> class -> counts, classes read once for each class that is wanted.

    buckets: kmer_class is partitioned by that many, and only those of the query's k-mers are read; their numbers (at most
    `buckets` of them) are gathered for that."""
    wanted = kmers.select("kmer").distinct()
    if buckets and buckets > 1:
        some = [r["bucket"] for r in wanted.select(bucket("kmer", buckets)).distinct().collect()]
        if len(some) < buckets:
            kmer_class = kmer_class.where(F.col("bucket").isin(some))
    ranked = kmer_class.join(wanted, "kmer", "left_semi")
    vectors = classes.join(ranked.select("class_id").distinct(), "class_id", "left_semi")
    return kmers.join(ranked, "kmer").join(vectors, "class_id").select("query_ord", "pos", F.explode("counts").alias("x")).select("query_ord", F.col("x.d").alias("dataset_id"), "pos", F.col("x.c").alias("count"))


def with_missing(kmers: DataFrame, found: DataFrame) -> DataFrame:
    """Every k-mer of the queries, with dataset_id and count of its hits; 0 and null where it has none."""
    return kmers.join(found, ["query_ord", "pos"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def cells(queries: DataFrame, k: int, datasets: DataFrame) -> DataFrame:
    """(query_ord, header, n, dataset_id, name, total_kmers) for every query and dataset.

    The list of datasets is the engine's catalog, so it is gathered into one row and exploded beside each query."""
    listed = [(r["dataset_id"], r["name"], r["total_kmers"]) for r in datasets.select("dataset_id", "name", "total_kmers").orderBy("dataset_id").collect()]
    spark = queries.sparkSession
    one = spark.createDataFrame([(listed,)], "d array<struct<dataset_id:int,name:string,total_kmers:bigint>>")
    n = (F.length("seq") - (k - 1)).alias("n")
    return queries.select("query_ord", "header", n).join(F.broadcast(one)).select("query_ord", "header", "n", F.explode("d").alias("d")).select("query_ord", "header", "n", "d.*")


def coverage(n: Column, zeros: Column, k: int) -> Column:
    """Percentage of bases, as n + k - 1 less the absent k-mers, over n + k - 1, rounded down."""
    return F.floor((n + (k - 1) - zeros) * 100 / (n + (k - 1))).cast("int")


def kmer_fraction(n: Column, zeros: Column) -> Column:
    """Percentage of k-mers found, rounded down."""
    return F.floor((n - zeros) * 100 / n).cast("int")


def float_mean(total: Column, n: Column) -> Column:
    """total / n in single precision."""
    return (total.cast("float") / n.cast("float")).cast("float")


def average_text(total: Column, n: Column) -> Column:
    """The mean in single precision, six decimals, of which the last four characters are cut."""
    text = F.format_string("%.6f", float_mean(total, n).cast("double"))
    return F.substr(text, F.lit(1), F.length(text) - 4)


def normalized(total: Column, n: Column, kmers: Column) -> Column:
    """ceil(total / (n * kmers) * 1e9), each step in single precision; null for a dataset without k-mers."""
    share = (total.cast("float") / F.nullif((n * kmers).cast("float"), F.lit(0.0).cast("float"))).cast("float")
    return F.ceil(share * F.lit(1e9).cast("float")).cast("bigint")


def aggregate(every: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Cells with n_found, total (sum of counts) and pct."""
    per = found.groupBy("query_ord", "dataset_id").agg(F.count("*").alias("n_found"), F.sum("count").cast("bigint").alias("total"))
    out = every.join(per, ["query_ord", "dataset_id"], "left")
    out = out.withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    return out.withColumn("pct", coverage(F.col("n"), F.col("n") - F.col("n_found"), k))


def runs(every: DataFrame, found: DataFrame) -> DataFrame:
    """(query_ord, dataset_id, start, end, count) of the profile's runs of equal counts, absent ones (0) included.

    Found runs are gaps and islands over the hits; absent runs are what lies between them."""
    cell = Window.partitionBy("query_ord", "dataset_id").orderBy("pos")
    same = (F.lag("pos").over(cell) == F.col("pos") - 1) & (F.lag("count").over(cell) == F.col("count"))
    island = F.sum(F.when(same, 0).otherwise(1)).over(cell)
    held = found.withColumn("island", island).groupBy("query_ord", "dataset_id", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.first("count").alias("count")).drop("island")
    order = Window.partitionBy("query_ord", "dataset_id").orderBy("start")
    after = held.select("query_ord", "dataset_id", (F.col("end") + 1).alias("start"), (F.coalesce(F.lead("start").over(order), F.lit(1 << 30)) - 1).alias("end"), F.lit(0).alias("count"))
    first = every.select("query_ord", "dataset_id", "n").join(held.groupBy("query_ord", "dataset_id").agg(F.min("start").alias("lead")), ["query_ord", "dataset_id"], "left")
    before = first.select("query_ord", "dataset_id", F.lit(0).alias("start"), (F.coalesce("lead", "n") - 1).alias("end"), F.lit(0).alias("count"))
    gaps = after.unionByName(before).join(every.select("query_ord", "dataset_id", "n"), ["query_ord", "dataset_id"])
    gaps = gaps.withColumn("end", F.least(F.col("end"), F.col("n") - 1)).where(F.col("start") <= F.col("end")).drop("n")
    return held.unionByName(gaps)


def runs_text(all_runs: DataFrame) -> DataFrame:
    """(query_ord, dataset_id, value): `start-end:count` in order, joined by commas; `*` for absent."""
    one = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), F.when(F.col("count") == 0, "*").otherwise(F.col("count").cast("string")))
    listed = all_runs.groupBy("query_ord", "dataset_id").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("t")))).alias("l"))
    return listed.select("query_ord", "dataset_id", F.array_join(F.col("l.t"), ",").alias("value"))


def results(queries: DataFrame, datasets: DataFrame, found: DataFrame, k: int, format: str = "raw", threshold: int = 40, mode: str = "exact") -> DataFrame:
    """One row for each query and dataset: query_ord, query, dataset_id, name, n, n_found, pct, value (text).

    Cells below the coverage threshold are masked with `*`, never dropped; presence indexes show the coverage."""
    format = check_format(format)
    every = cells(queries, k, datasets)
    out = aggregate(every, found, k)
    if mode == "presence":
        value = F.col("pct").cast("string")
    elif format == "sum":
        value = F.col("total").cast("string")
    elif format == "average":
        value = average_text(F.col("total"), F.col("n"))
    elif format == "normalize":
        value = F.coalesce(normalized(F.col("total"), F.col("n"), F.col("total_kmers")), F.lit(0)).cast("string")
    else:
        out = out.join(runs_text(runs(every, found)), ["query_ord", "dataset_id"], "left")
        value = F.col("value")
    return out.select("query_ord", result_name(F.col("header")).alias("query"), "dataset_id", "name", "n", "n_found", "pct", F.when(F.col("pct") >= threshold, value).otherwise("*").alias("value"))


def wide(result: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row a query and one column a dataset, in the order of dataset ids (columns d0, d1, ...)."""
    ids = [r["dataset_id"] for r in datasets.select("dataset_id").orderBy("dataset_id").collect()]
    table = result.groupBy("query_ord", "query").agg(F.map_from_entries(F.collect_list(F.struct("dataset_id", "value"))).alias("m"))
    return table.select("query_ord", "query", *[F.col("m")[i].alias(f"d{i}") for i in ids])
