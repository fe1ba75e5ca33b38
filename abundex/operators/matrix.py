"""From sequences to the abundance matrix, its vectors and equivalence classes.

matrix(kmer, dataset, count) holds the largest count of each canonical k-mer in each dataset; absent cells have no row.
The roller sums up each Arrow batch before anything is shuffled, so a shuffle moves distinct cells, not occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundex.functions.abundance import record
from abundex.functions.kmers import MAX_CODE_K, canonical, encode, kmer_strings, roll

#: Bases that the roller takes at once.
BLOCK = 1 << 21


def positions(sequences: DataFrame, k: int, keep: list[str], code: bool = True) -> DataFrame:
    """One row for each k-mer: the columns in keep, pos (from 0) and kmer (canonical; a code, or a string)."""
    found = sequences.select(*keep, F.posexplode(kmer_strings("seq", k)).alias("pos", "x"))
    kmer = canonical("x")
    return found.select(*keep, "pos", (encode(kmer) if code else kmer).alias("kmer"))


def _chunks(table: pa.RecordBatch, k: int):
    """Lists of (row, sequence) of about BLOCK bases; longer sequences are cut with k - 1 bases of overlap."""
    rows, seqs, size = [], [], 0
    for i, s in enumerate(table["seq"].to_pylist()):
        if s is None or len(s) < k:
            continue
        b = s.encode("ascii", "replace")
        for lo in range(0, len(b) - k + 1, BLOCK):
            rows.append(i)
            seqs.append(b[lo : lo + BLOCK + k - 1])
            size += len(seqs[-1])
            if size >= BLOCK:
                yield rows, seqs
                rows, seqs, size = [], [], 0
    if rows:
        yield rows, seqs


def _rolled(sequences: DataFrame, k: int, by: str, value: str | None, combine: str) -> DataFrame:
    """(kmer, by, value) with equal (kmer, by) of a block combined: 'max' of value, or 'count'."""
    kind = sequences.schema[by].dataType
    schema = T.StructType([T.StructField("kmer", T.LongType()), T.StructField(by, kind), T.StructField("n", T.LongType())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            names = b[by].dictionary_encode()
            group = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            amount = np.array(b[value].fill_null(0).to_numpy(zero_copy_only=False), np.int64) if value else None
            for rows, seqs in _chunks(b, k):
                codes, owner, _ = roll(seqs, k)
                if not len(codes):
                    continue
                row = np.array(rows)[owner]
                g = group[row]
                order = _grouped(codes, g, k)
                codes, g = codes[order], g[order]
                first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (g[1:] != g[:-1]))))
                n = np.maximum.reduceat(amount[row][order], first) if combine == "max" else np.diff(np.append(first, len(codes)))
                own = pa.array(g[first], mask=g[first] == len(names.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array(codes[first]), names.dictionary.take(own), pa.array(n, pa.int64())], names=["kmer", by, "n"])

    columns = [by, "seq", *([value] if value else [])]
    return sequences.select(*columns).mapInArrow(run, schema)


def _grouped(codes: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """An order that brings equal (code, group) together; both fit one number but for long k-mers in many groups."""
    bits = int(g.max()).bit_length()
    if 2 * k + bits <= 63:
        return np.argsort((codes << bits) | g)
    return np.lexsort((codes, g))


def kmer_matrix(sequences: DataFrame, k: int, mode: str = "exact", by: str = "dataset", saturate: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """matrix(kmer, by, count) of sequences(by, seq, count): the largest recorded count of each cell.

    Cells whose recorded count is 0 are absent. For k > 31 k-mers are strings. only: a table of k-mers outside of which
    nothing is wanted; it prunes before the shuffle.

    The roller leaves a k-mer once a block and dataset, so cells go straight to their k-mer's partition, which
    count_vectors() and joins on the k-mer find in place; strings, not summed up before, are by partial aggregates."""
    recorded = record(F.col("n"), mode, saturate)
    if k <= MAX_CODE_K:
        cells = _rolled(sequences, k, by, "count", "max")
    else:
        cells = positions(sequences.select(by, "seq", F.col("count").cast("long").alias("n")), k, [by, "n"], code=False)
    if only is not None:
        cells = cells.join(only, "kmer", "left_semi")
    if k <= MAX_CODE_K:
        cells = cells.repartition("kmer")
    # the recorded value grows with the count, so the largest count has the largest record
    return cells.groupBy("kmer", by).agg(F.max("n").alias("n")).select("kmer", by, recorded.alias("count")).where("count > 0")


def read_matrix(reads: DataFrame, k: int, min_abundance: int = 2, by: str = "dataset") -> DataFrame:
    """matrix of raw reads: how often each canonical k-mer occurs, where that is at least min_abundance."""
    if k <= MAX_CODE_K:
        cells = _rolled(reads, k, by, None, "count")
    else:
        cells = positions(reads, k, [by], code=False).withColumn("n", F.lit(1))
    return cells.groupBy("kmer", by).agg(F.sum("n").alias("count")).where(F.col("count") >= min_abundance).select("kmer", by, F.col("count").cast("int").alias("count"))


def dataset_totals(sequences: DataFrame, k: int, by: str = "dataset") -> DataFrame:
    """(by, total_kmers): k-mers times counts over the sequences of at least k bases; 0 for datasets with none."""
    n = F.when(F.length("seq") >= k, (F.length("seq") - (k - 1)).cast("bigint") * F.col("count")).otherwise(F.lit(0))
    return sequences.groupBy(by).agg(F.sum(n).cast("bigint").alias("total_kmers"))


def count_vectors(matrix: DataFrame, by: str = "dataset") -> DataFrame:
    """(kmer, counts): the sparse vector of each k-mer, sorted by dataset."""
    return matrix.groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("d"), F.col("count").alias("c")))).alias("counts"))


def dense(counts: str, datasets: int):
    """The dense array of a sparse vector over dataset ids 0 .. datasets - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(datasets - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(counts), i), F.lit(0)))


def with_class(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """vectors with class_id, a hash of counts."""
    return vectors.withColumn("class_id", F.xxhash64(F.lit(seed), "counts"))


def classes(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """classes(class_id, counts, n_kmers), one row for each distinct vector."""
    return with_class(vectors, seed).groupBy("class_id", "counts").agg(F.count("*").alias("n_kmers"))


def collide(found: DataFrame) -> bool:
    """Whether two classes share an id."""
    return not found.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def vector_text(counts: str = "counts"):
    """A sparse vector as text, `dataset:count` joined by commas."""
    return F.array_join(F.transform(counts, lambda x: F.concat_ws(":", x["d"].cast("string"), x["c"].cast("string"))), ",")


def dense_tsv(seq: str, counts: str, datasets: int):
    """A line of the monotig export: sequence, an empty field, then one count a dataset."""
    return F.concat_ws("\t", F.col(seq), F.lit(""), F.array_join(dense(counts, datasets), "\t"))
