"""The index: build, save, load and query.

An index folder holds Parquet tables: kmer_class(kmer, class_id), partitioned by bucket, a hash of the k-mer, and sorted
by k-mer, classes(class_id, counts), datasets(dataset_id, name, path, total_kmers) and info (one row). A lookup reads the
buckets of the query's k-mers only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions.kmers import MAX_CODE_K, acgt_only, decode
from abundex.operators import lookup
from abundex.operators import matrix as m
from abundex.sources import fasta


#: K-mers of a bucket, and the most buckets.
BUCKET_KMERS, MAX_BUCKETS = 250_000, 4096
#: Names of datasets that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


@dataclass
class Index:
    """An opened index; buckets: those of kmer_class, where it is a saved one."""

    kmer_class: DataFrame
    classes: DataFrame
    datasets: DataFrame
    k: int
    mode: str
    vectors: DataFrame | None = None
    buckets: int | None = None

    def info(self) -> DataFrame:
        """k, mode, n_kmers, n_classes, n_datasets."""
        n = lambda df, name: df.agg(F.count("*").alias(name))
        one = n(self.kmer_class, "n_kmers").join(n(self.classes, "n_classes")).join(n(self.datasets, "n_datasets"))
        return one.select(F.lit(self.k).alias("k"), F.lit(self.mode).alias("mode"), "n_kmers", "n_classes", "n_datasets")

    def matrix(self) -> DataFrame:
        """(kmer, dataset_id, count), from the classes."""
        return self.kmer_class.join(self.classes, "class_id").select("kmer", F.explode("counts").alias("x")).select("kmer", F.col("x.d").alias("dataset_id"), F.col("x.c").alias("count"))

    def cache(self) -> Index:
        """The layout for many queries against one session: tables are held by the executors."""
        self.kmer_class.cache()
        self.classes.cache()
        return self

    def query(self, queries: DataFrame, format: str = "raw", threshold: int = 40) -> DataFrame:
        """The results of queries(query_ord, header, seq); see lookup.results()."""
        queries = queries.where(F.length("seq") >= self.k)
        kmers = lookup.query_kmers(queries, self.k, code=self.k <= 31)
        found = lookup.index_hits(kmers, self.kmer_class, self.classes, self.buckets)
        return lookup.results(queries, self.datasets, found, self.k, format, threshold, self.mode)

    def query_file(self, path: str, format: str = "raw", threshold: int = 40) -> DataFrame:
        return self.query(fasta.read_queries(self.kmer_class.sparkSession, path, self.k), format, threshold)

    def save(self, path: str) -> Index:
        """Write the tables and open them. The matrix is computed once, into a staging table of vectors; classes and
        kmer_class are read off it.

        Should two classes share an id, another seed is taken."""
        spark = self.kmer_class.sparkSession
        staging = f"{path}/_vectors"
        source = self.vectors if self.vectors is not None else self.kmer_class.join(self.classes, "class_id").select("kmer", "counts")
        source.write.mode("errorifexists").parquet(staging)
        vectors = spark.read.parquet(staging)
        for seed in range(8):
            m.classes(vectors, seed).select("class_id", "counts").write.mode("overwrite").parquet(f"{path}/classes")
            if not m.collide(spark.read.parquet(f"{path}/classes")):
                break
        buckets = min(MAX_BUCKETS, vectors.count() // BUCKET_KMERS + 1)
        ranked = m.with_class(vectors, seed).select("kmer", "class_id", lookup.bucket("kmer", buckets))
        ranked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kmer").write.partitionBy("bucket").parquet(f"{path}/kmer_class")
        self.datasets.write.parquet(f"{path}/datasets")
        out = load_tables(spark, path, self.k, self.mode, buckets)
        out.info().withColumn("n_buckets", F.lit(buckets)).write.parquet(f"{path}/info")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return out

    def export_monotigs(self) -> DataFrame:
        """Lines `k-mer, empty field, counts` of every k-mer; count modes only."""
        if self.mode == "presence":
            raise ValueError("a presence index has no counts to export")
        n = self.datasets.count()
        rows = self.kmer_class.join(self.classes, "class_id")
        seq = decode("kmer", self.k) if self.k <= 31 else F.col("kmer")
        return rows.select(seq.alias("seq"), "counts").select(m.dense_tsv("seq", "counts", n).alias("value"))


def load_tables(spark: SparkSession, path: str, k: int, mode: str, buckets: int | None = None) -> Index:
    kind = "bigint" if k <= MAX_CODE_K else "string"
    ranked = spark.read.schema(f"kmer {kind}, class_id bigint, bucket int").parquet(f"{path}/kmer_class") if buckets else spark.read.parquet(f"{path}/kmer_class")
    return Index(ranked, spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/datasets"), k, mode, buckets=buckets)


def load_index(spark: SparkSession, path: str) -> Index:
    """Open a saved index; k and mode come from it."""
    info = spark.read.parquet(f"{path}/info").first()
    return load_tables(spark, path, info["k"], info["mode"], info.asDict().get("n_buckets"))


def from_matrix(cells: DataFrame, datasets: DataFrame, k: int, mode: str) -> Index:
    """An index of cells(kmer, dataset_id, count) and datasets(dataset_id, name, path, total_kmers)."""
    vectors = m.count_vectors(cells, "dataset_id")
    return Index(m.with_class(vectors).select("kmer", "class_id"), m.classes(vectors).select("class_id", "counts"), datasets, k, mode, vectors)


def build_from_sequences(sequences: DataFrame, datasets: DataFrame, k: int = 31, mode: str = "exact", saturate: int | None = None) -> Index:
    """sequences(dataset_id, seq, count); datasets(dataset_id, name, path)."""
    totals = m.dataset_totals(sequences, k, "dataset_id")
    known = datasets.join(totals, "dataset_id", "left").withColumn("total_kmers", F.coalesce("total_kmers", F.lit(0)))
    return from_matrix(m.kmer_matrix(sequences, k, mode, "dataset_id", saturate), known.select("dataset_id", "name", "path", "total_kmers"), k, mode)


def build_index(spark: SparkSession, fof: str, k: int = 31, mode: str = "exact", from_reads: bool = False, paired: bool = False, min_abundance: int = 2, saturate: int | None = None) -> Index:
    """Index the unitig files of a file of files, or raw reads (paired: two lines a dataset)."""
    datasets = fasta.read_fof(spark, fof, paired and from_reads)
    if from_reads:
        reads = fasta.read_reads(spark, datasets)
        counted = m.read_matrix(reads, k, min_abundance, "dataset_id")
        totals = counted.groupBy("dataset_id").agg(F.sum("count").alias("total_kmers"))
        recorded = counted.select("kmer", "dataset_id", m.record(F.col("count"), mode, saturate).alias("count")).where("count > 0")
        known = datasets.join(totals, "dataset_id", "left").withColumn("total_kmers", F.coalesce("total_kmers", F.lit(0)))
        return from_matrix(recorded, known.select("dataset_id", "name", "path", "total_kmers"), k, mode)
    unitigs = fasta.read_unitigs(spark, datasets, k).select("dataset_id", "seq", F.col("km").cast("int").alias("count"))
    return build_from_sequences(unitigs, datasets.select("dataset_id", "name", "path"), k, mode, saturate)


def build_from_table(table: DataFrame, text: str, dataset: str, abundance, k: int, mode: str = "exact") -> Index:
    """Index a text column, reduced to A, C, G and T, with the values of another column as datasets."""
    rows = table.select(F.coalesce(F.col(dataset), F.lit("")).alias("name"), acgt_only(F.coalesce(F.col(text), F.lit(""))).alias("seq"), abundance.cast("int").alias("count"))
    # names and totals in one scan
    totals = sorted((r["name"], r["total_kmers"] or 0) for r in m.dataset_totals(rows, k, "name").collect())
    datasets = table.sparkSession.createDataFrame([(i, n, n, t) for i, (n, t) in enumerate(totals)], "dataset_id int, name string, path string, total_kmers bigint")
    ids = datasets.select("dataset_id", "name")
    # a shuffle of the sequences by name would put a large dataset into one task
    known = rows.join(F.broadcast(ids) if len(totals) <= MAX_BROADCAST else ids, "name")
    return from_matrix(m.kmer_matrix(known.select("dataset_id", "seq", "count"), k, mode, "dataset_id"), datasets, k, mode)


def rebuild_catalog(spark: SparkSession, fof: str, k: int) -> DataFrame:
    """datasets with totals counted anew from the unitig files."""
    datasets = fasta.read_fof(spark, fof)
    unitigs = fasta.read_unitigs(spark, datasets, k).select("dataset_id", "seq", F.col("km").cast("int").alias("count"))
    totals = m.dataset_totals(unitigs, k, "dataset_id")
    return datasets.join(totals, "dataset_id", "left").select("dataset_id", "name", "path", F.coalesce("total_kmers", F.lit(0)).alias("total_kmers"))
