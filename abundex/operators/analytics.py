"""Beyond lookup: set operations, cohorts, correlations, minimizers, statistics of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundex.functions.kmers import canonical, reverse_complement


def sharing(matrix: DataFrame, by: str = "dataset") -> DataFrame:
    """(n_datasets, n_kmers): how many k-mers occur in exactly so many datasets."""
    return matrix.groupBy("kmer").agg(F.count("*").alias("n_datasets")).groupBy("n_datasets").agg(F.count("*").alias("n_kmers"))


def private_kmers(matrix: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, n_private): k-mers that no other dataset has."""
    alone = matrix.groupBy("kmer").agg(F.count("*").alias("n"), F.min(by).alias(by)).where("n = 1")
    return alone.groupBy(by).agg(F.count("*").alias("n_private"))


def union_kmers(matrix: DataFrame) -> DataFrame:
    return matrix.select("kmer").distinct()


def intersect_kmers(matrix: DataFrame, a, b, by: str = "dataset") -> DataFrame:
    """k-mers of both datasets."""
    return matrix.where(F.col(by) == F.lit(a)).select("kmer").join(matrix.where(F.col(by) == F.lit(b)).select("kmer"), "kmer", "left_semi")


def except_kmers(matrix: DataFrame, a, b, by: str = "dataset") -> DataFrame:
    """k-mers of a that b lacks."""
    return matrix.where(F.col(by) == F.lit(a)).select("kmer").join(matrix.where(F.col(by) == F.lit(b)).select("kmer"), "kmer", "left_anti")


def harmonic_mean(count: Column) -> Column:
    """All values over the sum of inverses of the positive ones, cut to a whole number; 0 without positive ones.

    The sum of inverses depends on their order in the last bits, so a whole number just missed counts as reached."""
    inverse = F.sum(F.when(count > 0, F.lit(1.0) / count))
    return F.coalesce(F.floor(F.count(F.lit(1)) / inverse + 1e-9), F.lit(0)).cast("bigint")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of column: ranks come from counts of distinct values, so no task sorts all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    # the one task of the running sum reads a row for each distinct count, not for each k-mer
    lower = F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(F.col(column).alias("_v"), (F.coalesce(lower, F.lit(0)) + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return pearson(average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry"), "_rx", "_ry")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows chosen by a hash of key: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def cohort_values(values: DataFrame, cohort: DataFrame) -> DataFrame:
    """(gene, label, n, mean, median, largest) of values(gene, sample, value): the largest value over a gene's fragments
    in each sample, compared between cohorts(sample, label)."""
    top = values.groupBy("gene", "sample").agg(F.max("value").alias("value"))
    return top.join(cohort, "sample").groupBy("gene", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.max("value").alias("largest"))


def minimizer(kmer: Column, k: int, m: int) -> Column:
    """The least canonical m-mer of a k-mer."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: canonical(F.substr(kmer, i, F.lit(m)))))


def with_minimizer(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """kmers(..., kmer as a string) with its minimizer."""
    return kmers.withColumn("minimizer", minimizer(F.col("kmer"), k, m))


def super_kmers(kmers: DataFrame, k: int, m: int, by: list[str]) -> DataFrame:
    """(by, start, end, minimizer) of runs of k-mers at successive positions with one minimizer."""
    marked = with_minimizer(kmers, k, m)
    order = Window.partitionBy(*by).orderBy("pos")
    same = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("minimizer").over(order) == F.col("minimizer"))
    run = F.sum(F.when(same, 0).otherwise(1)).over(order)
    return marked.withColumn("run", run).groupBy(*by, "run", "minimizer").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).select(*by, "start", "end", "minimizer")


def minimizer_stats(supers: DataFrame, k: int) -> DataFrame:
    """(minimizer, n_super, n_kmers, n_bases) of super-k-mers."""
    n = F.col("end") - F.col("start") + 1
    return supers.groupBy("minimizer").agg(F.count("*").alias("n_super"), F.sum(n).cast("bigint").alias("n_kmers"), F.sum(n + (k - 1)).cast("bigint").alias("n_bases"))


def overlaps(kmers: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(a, b, by) of k-mers, in either direction, where b begins with the last k - 1 bases of a and both agree in by.

    kmers has canonical k-mers as strings; the steps of a path of equal count vectors are those with by = ["counts"]."""
    both = kmers.select("kmer", *by).unionByName(kmers.select(reverse_complement("kmer").alias("kmer"), *by)).distinct()
    left = both.select(F.col("kmer").alias("a"), F.substr("kmer", F.lit(2)).alias("_o"), *by)
    right = both.select(F.col("kmer").alias("b"), F.substring("kmer", 1, k - 1).alias("_o"), *by)
    return left.join(right, ["_o", *by]).select("a", "b", *by)


def rle(values: Column, longest: int = 254, most: int | None = None) -> Column:
    """Runs (n, v) of an array, none longer than `longest`; values are capped at `most`."""
    kind = "array<struct<n:int,v:int>>"

    def runs(a: Column) -> Column:
        """From the places where the value changes, so that the work is linear."""
        capped = (lambda i: F.least(a[i], F.lit(most))) if most else (lambda i: a[i])
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~capped(i).eqNullSafe(capped(i - 1)))
        whole = F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(a)), F.array(F.size(a))), lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")))
        cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((r["n"] - 1) / longest).cast("int")), lambda j: F.struct(F.least(F.lit(longest), r["n"] - j * longest).cast("int").alias("n"), capped(r["s"]).cast("int").alias("v")))
        return F.flatten(F.transform(whole, cut))

    # the array is bound to a variable, so that it is made once
    once = F.transform(F.array(values), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(F.array().cast(kind)))
    return F.when(values.isNotNull(), once[0])


def unrle(pairs: Column) -> Column:
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["v"], p["n"])))


def equal_where_present(a: Column, b: Column) -> Column:
    """Vectors agree wherever both are positive."""
    return F.forall(F.zip_with(a, b, lambda x, y: (x == 0) | (y == 0) | (x == y)), lambda t: t)


def similar_counts(a: Column, b: Column, most: float) -> Column:
    """Everywhere both are absent, or both present with a ratio of at most `most`."""
    return F.forall(F.zip_with(a, b, lambda x, y: ((x == 0) & (y == 0)) | ((x > 0) & (y > 0) & (F.greatest(x, y) <= most * F.least(x, y)))), lambda t: t)


def header_counts(header: Column) -> Column:
    """The numbers of a `:`-separated header after its first field."""
    return F.transform(F.slice(F.split(header, ":"), 2, 1_000_000), lambda x: x.try_cast("int"))


def stress_patterns(spark, datasets: int) -> DataFrame:
    """Every non-empty membership pattern: (dataset, seq, count) with one k-mer of A and G for each (k = datasets)."""
    bits = spark.range(1, 1 << datasets)
    seq = F.translate(F.lpad(F.bin("id"), datasets, "0"), "01", "AG")
    return bits.select(seq.alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(datasets - 1))).alias("dataset"), "id").where(F.expr("shiftright(id, dataset) & 1") == 1).select("dataset", "seq", F.lit(1).alias("count"))
