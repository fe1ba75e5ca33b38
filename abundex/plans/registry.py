"""Registered queries over the driver's tables, and the SQL that gives the same rows.

`documents` reduced to A, C, G and T are the sequences, `source` is the dataset, 1 + doc_id % 50 a record's abundance;
`benchmark` holds the query sequences and `labels` the cohorts. k is 11 here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.functions import abundance as ab
from abundex.functions import names
from abundex.functions.kmers import acgt_only, canonical, decode, encode, is_acgt, kmer_strings, reverse_complement
from abundex.operators import analytics as an
from abundex.operators import lookup
from abundex.operators import matrix as mx
from abundex.plans import index
from abundex.sources.tables import read_table

K, M = 11, 7


class Tables:
    """The engine's inputs, from a folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, by: str = "source"):
        self.spark, self.docs = spark, read_table(spark, f"{sf_dir}/documents.parquet")
        self.items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        self.sf_dir, self.by = sf_dir, by

    def abundance(self):
        return F.lit(1) + F.col("doc_id") % 50

    def sequences(self) -> DataFrame:
        return self.docs.select("doc_id", F.col(self.by).alias("dataset"), acgt_only(F.coalesce("text", F.lit(""))).alias("seq"), self.abundance().cast("int").alias("count"))

    def matrix(self, mode: str = "exact") -> DataFrame:
        return mx.kmer_matrix(self.sequences(), K, mode)

    def queries(self) -> DataFrame:
        q = self.items.select(F.col("item_id").alias("query_ord"), F.col("item_id").cast("string").alias("header"), acgt_only(F.coalesce("text", F.lit(""))).alias("seq"))
        return q.where(F.length("seq") >= K)

    def datasets(self, totals: bool = False) -> DataFrame:
        """One row a dataset: the catalog, gathered on the driver as the engine's API does; totals cost a scan."""
        known = mx.dataset_totals(self.sequences(), K) if totals else self.docs.select(F.col(self.by).alias("dataset"), F.lit(0).alias("total_kmers")).distinct()
        rows = sorted((r["dataset"], r["total_kmers"]) for r in known.collect())
        return self.spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "dataset_id int, name string, total_kmers bigint")

    def found(self, datasets: DataFrame | None = None) -> DataFrame:
        datasets = datasets if datasets is not None else self.datasets()
        kmers = self.items_kmers()
        cells = mx.kmer_matrix(self.sequences(), K, only=kmers.select("kmer").distinct())
        cells = cells.join(datasets.select(F.col("name").alias("dataset"), "dataset_id"), "dataset").select("kmer", "dataset_id", "count")
        return kmers.join(cells, "kmer").select("query_ord", "dataset_id", "pos", "count")

    def results(self, format: str, threshold: int = 40, mode: str = "exact") -> DataFrame:
        d = self.datasets(format == "normalize")
        out = lookup.results(self.queries(), d, self.found(d), K, format, threshold, mode)
        return out.select(F.col("query_ord").alias("item_id"), F.col("name").alias("source"), "n", "n_found", "pct", "value")

    def items_kmers(self) -> DataFrame:
        return lookup.query_kmers(self.queries(), K)


def kmer_extract(spark, d):
    t = Tables(spark, d)
    return t.sequences().select("doc_id", F.posexplode(kmer_strings("seq", K)).alias("pos", "kmer"))


def kmer_codes(spark, d):
    """Distinct k-mers of the queries with reverse complement, canonical form and code."""
    x = Tables(spark, d).queries().select(F.explode(kmer_strings("seq", K)).alias("kmer")).distinct()
    return x.select("kmer", reverse_complement("kmer").alias("rc"), canonical("kmer").alias("canon"), encode(canonical("kmer")).alias("code"), decode(encode("kmer"), K).alias("decoded"))


def kmer_canonical_count(spark, d):
    return mx.read_matrix(Tables(spark, d).sequences(), K, 1).groupBy("kmer").agg(F.sum("count").cast("bigint").alias("n")).select(decode("kmer", K).alias("kmer"), "n")


def matrix_max(spark, d):
    return Tables(spark, d).matrix().select(decode("kmer", K).alias("kmer"), F.col("dataset").alias("source"), "count")


def matrix_by_lang(spark, d):
    return Tables(spark, d, "lang").matrix().select(decode("kmer", K).alias("kmer"), F.col("dataset").alias("lang"), "count")


def matrix_presence(spark, d):
    return Tables(spark, d).matrix("presence").groupBy("dataset").agg(F.count("*").alias("n_kmers"), F.sum("count").cast("bigint").alias("total")).withColumnRenamed("dataset", "source")


def dataset_totals(spark, d):
    return mx.dataset_totals(Tables(spark, d).sequences(), K).select(F.col("dataset").alias("source"), "total_kmers")


def read_kmer_total(spark, d):
    s = Tables(spark, d).sequences().where(F.length("seq") >= K)
    return s.agg(F.sum(F.length("seq") - (K - 1)).cast("bigint").alias("n_kmers"), F.count("*").alias("n_sequences"))


def eq_class_sizes(spark, d):
    found = mx.classes(mx.count_vectors(Tables(spark, d).matrix()))
    return found.select(mx.vector_text().alias("counts"), "n_kmers")


def _index(spark, d) -> index.Index:
    t = Tables(spark, d)
    return index.build_from_table(t.docs, "text", "source", t.abundance(), K)


def index_info(spark, d):
    return _index(spark, d).info().select("n_kmers", "n_classes", "n_datasets")


def index_query_sum(spark, d):
    """The same as query_sum, through the classes of an index."""
    out = _index(spark, d).query(Tables(spark, d).queries(), "sum", 40)
    return out.select(F.col("query_ord").alias("item_id"), F.col("name").alias("source"), "n", "n_found", "pct", "value")


def saved_index_query_sum(spark, d):
    """The same through an index that is saved, opened again and read by buckets."""
    t = Tables(spark, d)
    folder = f"{scratch(spark)}/abundex-index-{uuid.uuid4().hex}"
    _index(spark, d).save(folder)
    out = index.load_index(spark, folder).query(t.queries(), "sum", 40)
    return out.select(F.col("query_ord").alias("item_id"), F.col("name").alias("source"), "n", "n_found", "pct", "value")


def scratch(spark) -> str:
    """The folder that driver and executors share; only a local master may leave spark.checkpoint.dir unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp()).rstrip("/")


def dense_vectors(spark, d):
    """Monotig export lines of the queries' k-mers: the k-mer, an empty field, a count for every dataset."""
    t = Tables(spark, d)
    ds = t.datasets()
    cells = t.matrix().join(t.items_kmers().select("kmer").distinct(), "kmer", "left_semi").join(ds.select(F.col("name").alias("dataset"), "dataset_id"), "dataset")
    v = mx.count_vectors(cells, "dataset_id")
    return v.select(decode("kmer", K).alias("seq"), "counts").select(mx.dense_tsv("seq", "counts", ds.count()).alias("line"))


def quantized_hist(spark, d):
    """k-mers by bin of 1000 times their count (so that all ranges occur)."""
    return Tables(spark, d).matrix().select(ab.quantize(F.col("count") * 1000).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).select("bin", ab.bin_value(F.col("bin")).alias("middle"), "n")


def log_hist(spark, d):
    return Tables(spark, d).matrix("log").groupBy(F.col("count").alias("bin")).agg(F.count("*").alias("n"))


def seq_filter_short(spark, d):
    return Tables(spark, d).sequences().where(F.length("seq") >= K).select("doc_id", F.length("seq").alias("bases"))


def seq_filter_rejected(spark, d):
    """Why a document's first word, as a query, is refused: other characters, or shorter than 4."""
    first = F.upper(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)))
    reason = F.when(F.length(first) == 0, "empty").when(~is_acgt(first), "other characters").when(F.length(first) < 4, "short").otherwise("accepted")
    return Tables(spark, d).docs.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def header_trim(spark, d):
    docs = Tables(spark, d).docs
    h = F.concat(F.lit(">"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("_")), F.lit("\n"), F.lit(" ")))
    return docs.select("doc_id", names.result_name(h).alias("query"))


def query_hits_left(spark, d):
    t = Tables(spark, d)
    ds = t.datasets()
    every = lookup.with_missing(t.items_kmers(), t.found(ds)).join(ds.select("dataset_id", "name"), "dataset_id", "left")
    return every.select(F.col("query_ord").alias("item_id"), "pos", decode("kmer", K).alias("kmer"), F.col("name").alias("source"), "count")


def query_semi(spark, d):
    t = Tables(spark, d)
    return t.items_kmers().join(t.matrix().select("kmer").distinct(), "kmer", "left_semi").select(F.col("query_ord").alias("item_id"), "pos", decode("kmer", K).alias("kmer"))


def query_anti(spark, d):
    t = Tables(spark, d)
    return t.items_kmers().join(t.matrix().select("kmer").distinct(), "kmer", "left_anti").select(F.col("query_ord").alias("item_id"), "pos", decode("kmer", K).alias("kmer"))


def query_sum(spark, d):
    return Tables(spark, d).results("sum")


def query_average(spark, d):
    return Tables(spark, d).results("average")


def query_normalize(spark, d):
    return Tables(spark, d).results("normalize")


def query_presence(spark, d):
    return Tables(spark, d).results("sum", mode="presence")


def query_raw_string(spark, d):
    return Tables(spark, d).results("raw")


def query_threshold_78(spark, d):
    return Tables(spark, d).results("sum", 78)


def query_coverage(spark, d):
    t = Tables(spark, d)
    ds = t.datasets()
    out = lookup.aggregate(lookup.cells(t.queries(), K, ds), t.found(ds), K)
    return out.select(F.col("query_ord").alias("item_id"), F.col("name").alias("source"), "n", "pct", lookup.kmer_fraction(F.col("n"), F.col("n") - F.col("n_found")).alias("fraction"))


def query_raw_runs(spark, d):
    t = Tables(spark, d)
    ds = t.datasets()
    found = lookup.runs(lookup.cells(t.queries(), K, ds), t.found(ds)).join(ds.select("dataset_id", "name"), "dataset_id")
    return found.select(F.col("query_ord").alias("item_id"), F.col("name").alias("source"), "start", "end", F.col("count").cast("int").alias("count"))


def query_wide(spark, d):
    t = Tables(spark, d)
    ds = t.datasets()
    table = lookup.wide(lookup.results(t.queries(), ds, t.found(ds), K, "sum"), ds)
    return table.select(F.col("query_ord").alias("item_id"), F.concat_ws("\t", "query", *[c for c in table.columns if c.startswith("d")]).alias("line"))


def _values(spark, d):
    """(gene, sample, value): mean counts of the items in each document's dataset, by item."""
    out = Tables(spark, d).results("sum", 0)
    return out.select(F.floor(F.col("item_id") / 4).alias("gene"), F.col("source").alias("sample"), F.col("value").cast("bigint").alias("value"))


def cohort_max(spark, d):
    """The largest sum over a group of four items in each source, compared between sources by their documents' labels."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = Tables(spark, d).docs
    rate = docs.join(labels, "doc_id").groupBy("source").agg(F.avg("quality").alias("q"))
    cohort = rate.select(F.col("source").alias("sample"), F.when(F.col("q") >= 0.85, "good").otherwise("poor").alias("label"))
    out = an.cohort_values(_values(spark, d), cohort)
    return out.select("gene", "label", "n", F.round("mean", 6).alias("mean"), "median", "largest")


def harmonic_mean(spark, d):
    t = Tables(spark, d)
    ds = t.datasets()
    return lookup.with_missing(t.items_kmers(), t.found(ds)).groupBy(F.col("query_ord").alias("item_id")).agg(an.harmonic_mean(F.col("count")).alias("hm"))


def _pairs(spark, d):
    """Unitig mean against the k-mer's own count: a document's abundance and the number of its k-mer's occurrences."""
    t = Tables(spark, d)
    counted = mx.read_matrix(t.sequences().withColumn("dataset", F.lit(0)), K, 1).select("kmer", F.col("count").alias("y"))
    return t.matrix().groupBy("kmer").agg(F.max("count").alias("x")).join(counted, "kmer").select("kmer", "x", "y")


def corr_pearson(spark, d):
    return an.pearson(_pairs(spark, d), "x", "y").select(F.round("r", 9).alias("r"))


def corr_spearman(spark, d):
    return an.spearman(_pairs(spark, d), "x", "y").select(F.round("r", 9).alias("r"))


def _item_kmers(spark, d):
    return Tables(spark, d).queries().select("query_ord", F.posexplode(kmer_strings("seq", K)).alias("pos", "kmer"))


def superkmers(spark, d):
    return an.super_kmers(_item_kmers(spark, d), K, M, ["query_ord"]).withColumnRenamed("query_ord", "item_id")


def minimizer_stats(spark, d):
    return an.minimizer_stats(an.super_kmers(_item_kmers(spark, d), K, M, ["query_ord"]), K)


def shared_private_kmers(spark, d):
    return an.sharing(Tables(spark, d).matrix())


def private_kmers(spark, d):
    return an.private_kmers(Tables(spark, d).matrix()).withColumnRenamed("dataset", "source")


def kmer_set_ops(spark, d):
    m = Tables(spark, d).matrix()
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("op"), "n")
    return n(an.union_kmers(m), "union").unionByName(n(an.intersect_kmers(m, "src0", "src1"), "intersect")).unionByName(n(an.except_kmers(m, "src0", "src1"), "except"))


def reads_min2(spark, d):
    return mx.read_matrix(Tables(spark, d).sequences(), K, 2).select(decode("kmer", K).alias("kmer"), F.col("dataset").alias("source"), "count")


def kmer_overlaps(spark, d):
    """Steps between overlapping k-mers with equal count vectors, by the number of datasets in the vector."""
    v = mx.count_vectors(Tables(spark, d).matrix()).select(decode("kmer", K).alias("kmer"), "counts")
    return an.overlaps(v, K, ["counts"]).groupBy(F.size("counts").alias("n_datasets")).agg(F.count("*").alias("n_steps"), F.countDistinct("a").alias("n_from"))


def dataset_name_parse(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", names.dataset_name(F.coalesce("url", F.lit(""))).alias("name"))


def _headers(spark, d):
    docs = Tables(spark, d).docs
    tag = F.when(F.col("doc_id") % 3 == 0, F.format_string(" km:f:%d.%d", F.col("doc_id") % 70, F.col("doc_id") % 10)).when(F.col("doc_id") % 3 == 1, F.format_string(" KM:f:%d.25", F.col("doc_id") % 90)).otherwise("")
    return docs.select("doc_id", F.concat(F.format_string(">%d LN:i:%d KC:i:%d", F.col("doc_id"), F.col("n_chars"), F.col("n_chars") * 2), tag).alias("h"))


def km_header_parse(spark, d):
    x = _headers(spark, d)
    return x.select("doc_id", ab.mean_abundance(F.col("h")).cast("int").alias("count"), ab.count_sum(F.col("h")).alias("kc"))


def rle_vectors(spark, d):
    """Run-length pairs of each query's dense counts in the first dataset, and whether they give the counts back."""
    t = Tables(spark, d)
    ds = t.datasets()
    found = t.found(ds).where("dataset_id = 0").select("query_ord", "pos", "count")
    every = t.items_kmers().join(found, ["query_ord", "pos"], "left").groupBy("query_ord").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("count", F.lit(0)).alias("c")))).alias("l")).select("query_ord", F.col("l.c").alias("c"))
    pairs = an.rle(F.col("c"), 3)
    text = F.array_join(F.transform("p", lambda x: F.concat_ws("x", x["n"].cast("string"), x["v"].cast("string"))), ",")
    return every.withColumn("p", pairs).select(F.col("query_ord").alias("item_id"), text.alias("runs"), (an.unrle(F.col("p")) == F.col("c")).alias("lossless"))


_QUERIES = [
    kmer_extract, kmer_codes, kmer_canonical_count, matrix_max, matrix_by_lang, matrix_presence, dataset_totals, read_kmer_total, eq_class_sizes, index_info, index_query_sum, saved_index_query_sum,
    dense_vectors, quantized_hist, log_hist, seq_filter_short, seq_filter_rejected, header_trim, query_hits_left, query_semi, query_anti, query_sum, query_average, query_normalize,
    query_presence, query_raw_string, query_threshold_78, query_coverage, query_raw_runs, query_wide, cohort_max, harmonic_mean, corr_pearson, corr_spearman, superkmers,
    minimizer_stats, shared_private_kmers, private_kmers, kmer_set_ops, reads_min2, kmer_overlaps, dataset_name_parse, km_header_parse, rle_vectors,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def _canon(x: str) -> str:
    return f"least({x}, reverse(translate({x}, 'ACGT', 'TGCA')))"


_SEQ = "seqs as (select doc_id, source, lang, 1 + doc_id % 50 ab, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') s from documents)"
_OCC = f"{_SEQ}, occ as (select doc_id, source, lang, ab, i - 1 pos, substr(s, i, {K}) x from (select *, unnest(generate_series(1, length(s) - {K - 1})) i from seqs where length(s) >= {K}))"
_KM = f"{_OCC}, km as (select *, {_canon('x')} kmer from occ)"
_MAT = f"{_KM}, mat as (select kmer, source, max(ab) c from km group by kmer, source)"
_Q = f"q as (select item_id, s, length(s) - {K - 1} n from (select item_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') s from benchmark) where length(s) >= {K}), qk as (select item_id, n, i - 1 pos, x raw, {_canon('x')} kmer from (select item_id, n, i, substr(s, i, {K}) x from (select *, unnest(generate_series(1, n)) i from q)))"
_DS = f"ds as (select source, row_number() over (order by source) - 1 dataset_id, coalesce(sum(case when length(s) >= {K} then (length(s) - {K - 1}) * ab end), 0)::bigint total_kmers from seqs group by source)"
_ALL = f"{_MAT}, {_Q}, {_DS}, grid as (select qk.item_id, qk.n, qk.pos, qk.kmer, ds.source, ds.dataset_id, ds.total_kmers, coalesce(mat.c, 0) c from qk cross join ds left join mat on mat.kmer = qk.kmer and mat.source = ds.source)"
_CELL = f"{_ALL}, cell as (select item_id, source, dataset_id, any_value(n) n, any_value(total_kmers) total_kmers, count(*) filter (c > 0) n_found, sum(c)::bigint total, ((any_value(n) + {K - 1} - count(*) filter (c = 0)) * 100) // (any_value(n) + {K - 1}) pct from grid group by item_id, source, dataset_id)"
_RUNS = f"{_CELL}, isl as (select *, pos - row_number() over (partition by item_id, source, c order by pos) g from grid), runs as (select item_id, source, c, min(pos) s, max(pos) e from isl group by item_id, source, c, g)"


def _result(value: str, threshold: int = 40, base: str = _CELL, join: str = "") -> str:
    return f"with {base} select cell.item_id, cell.source, n::int n, n_found::bigint n_found, pct::int pct, case when pct >= {threshold} then {value} else '*' end value from cell {join}"


_QUANT = "case " + " ".join(f"when v >= {low} then least(255, (v - {low}) // {step} + {first})" for low, step, first in reversed(ab.RANGES)) + " end"
_MIDDLE = "case " + " ".join(f"when bin >= {first} then {low} + (bin - {first}) * {step} + {step // 2}" for low, step, first in reversed(ab.RANGES)) + " end"
_MINI = f"mini as (select item_id, pos, raw, list_min(list_transform(generate_series(1, {K - M + 1}), lambda i: {_canon(f'substr(raw, i, {M})')})) minimizer from qk)"
_SUPER = f"{_Q}, {_MINI}, mark as (select *, case when lag(minimizer) over w = minimizer then 0 else 1 end new_run from mini window w as (partition by item_id order by pos)), grp as (select *, sum(new_run) over (partition by item_id order by pos) g from mark), sup as (select item_id, minimizer, min(pos) s, max(pos) e from grp group by item_id, g, minimizer)"
_XY = f"{_KM}, xy as (select kmer, max(ab) x, count(*) y from km group by kmer)"
_AVERAGE = "printf('%.6f', (total::float / n::float)::double)"


def oracle_sql() -> dict:
    return {
        "kmer_extract": f"with {_OCC} select doc_id, pos::int pos, x kmer from occ",
        "kmer_codes": f"with {_Q} select distinct raw kmer, reverse(translate(raw, 'ACGT', 'TGCA')) rc, kmer canon, list_reduce(list_transform(generate_series(1, {K}), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1)::bigint), lambda a, b: a * 4 + b) code, raw decoded from qk",
        "kmer_canonical_count": f"with {_KM} select kmer, count(*)::bigint n from km group by kmer",
        "matrix_max": f"with {_MAT} select kmer, source, c::int count from mat",
        "matrix_by_lang": f"with {_KM} select kmer, lang, max(ab)::int count from km group by kmer, lang",
        "matrix_presence": f"with {_MAT} select source, count(*)::bigint n_kmers, count(*)::bigint total from mat group by source",
        "dataset_totals": f"with {_SEQ}, {_DS} select source, total_kmers from ds",
        "read_kmer_total": f"with {_SEQ} select sum(length(s) - {K - 1})::bigint n_kmers, count(*) n_sequences from seqs where length(s) >= {K}",
        "eq_class_sizes": f"with {_MAT}, v as (select kmer, string_agg(source || ':' || c, ',' order by source) counts from mat group by kmer) select counts, count(*) n_kmers from v group by counts",
        "index_info": f"with {_MAT}, v as (select kmer, string_agg(source || ':' || c, ',' order by source) counts from mat group by kmer) select count(*) n_kmers, count(distinct counts) n_classes, (select count(distinct source) from documents) n_datasets from v",
        "index_query_sum": _result("total::varchar"),
        "saved_index_query_sum": _result("total::varchar"),
        "dense_vectors": f"with {_ALL}, g as (select distinct kmer, dataset_id, c from grid where kmer in (select kmer from mat)) select kmer || chr(9) || chr(9) || string_agg(c::varchar, chr(9) order by dataset_id) line from g group by kmer",
        "quantized_hist": f"with {_MAT}, b as (select {_QUANT} bin from (select c * 1000 v from mat)) select bin::int bin, ({_MIDDLE})::int middle, count(*) n from b group by bin",
        "log_hist": f"with {_MAT} select length(bin(c::bigint))::int bin, count(*) n from (select c from mat) group by 1",
        "seq_filter_short": f"with {_SEQ} select doc_id, length(s)::int bases from seqs where length(s) >= {K}",
        "seq_filter_rejected": "with w as (select upper(split_part(coalesce(text, ''), ' ', 1)) x from documents) select case when length(x) = 0 then 'empty' when not regexp_full_match(x, '[ACGT]+') then 'other characters' when length(x) < 4 then 'short' else 'accepted' end reason, count(*) n from w group by 1",
        "header_trim": "select doc_id, substr(split_part(replace(replace(coalesce(text, ''), ' ', '_'), chr(10), ' '), ' ', 1), 1, 50) query from documents",
        "query_hits_left": f"with {_MAT}, {_Q} select item_id, pos::int pos, qk.kmer, source, coalesce(c, 0)::int count from qk left join mat on mat.kmer = qk.kmer",
        "query_semi": f"with {_MAT}, {_Q} select item_id, pos::int pos, kmer from qk where kmer in (select kmer from mat)",
        "query_anti": f"with {_MAT}, {_Q} select item_id, pos::int pos, kmer from qk where kmer not in (select kmer from mat)",
        "query_sum": _result("total::varchar"),
        "query_average": _result(f"substr({_AVERAGE}, 1, length({_AVERAGE}) - 4)"),
        "query_normalize": _result("coalesce(ceil(((total::float / nullif((n * total_kmers)::float, 0))::float * 1e9::float)::float)::bigint, 0)::varchar"),
        "query_presence": _result("pct::varchar"),
        "query_raw_string": _result("value", 40, f"{_RUNS}, txt as (select item_id, source, string_agg(s || '-' || e || ':' || case when c = 0 then '*' else c::varchar end, ',' order by s) value from runs group by item_id, source)", "join txt on txt.item_id = cell.item_id and txt.source = cell.source"),
        "query_threshold_78": _result("total::varchar", 78),
        "query_coverage": f"with {_CELL} select item_id, source, n::int n, pct::int pct, (n_found * 100 // n)::int fraction from cell",
        "query_raw_runs": f'with {_RUNS} select item_id, source, s::int "start", e::int "end", c::int count from runs',
        "query_wide": f"with {_CELL} select item_id, item_id || chr(9) || string_agg(case when pct >= 40 then total::varchar else '*' end, chr(9) order by dataset_id) line from cell group by item_id",
        "cohort_max": f"with {_CELL}, v as (select item_id // 4 gene, source, max(total) v from cell group by 1, 2), co as (select source, case when avg(quality) >= 0.85 then 'good' else 'poor' end label from documents join labels using (doc_id) group by source) select gene, label, count(*) n, round(avg(v), 6) mean, median(v)::double median, max(v) largest from v join co using (source) group by gene, label",
        "harmonic_mean": f"with {_MAT}, {_Q} select item_id, coalesce(floor(count(*) / sum(case when c > 0 then 1.0::double / c end) + 1e-9), 0)::bigint hm from qk left join mat on mat.kmer = qk.kmer group by item_id",
        "corr_pearson": f"with {_XY} select round(corr(x::double, y::double), 9) r from xy",
        "corr_spearman": f"with {_XY}, rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from xy) select round(corr(rx::double, ry::double), 9) r from rk",
        "superkmers": f'with {_SUPER} select item_id, s::int "start", e::int "end", minimizer from sup',
        "minimizer_stats": f"with {_SUPER} select minimizer, count(*) n_super, sum(e - s + 1)::bigint n_kmers, sum(e - s + {K})::bigint n_bases from sup group by minimizer",
        "shared_private_kmers": f"with {_MAT} select n_datasets, count(*) n_kmers from (select kmer, count(*) n_datasets from mat group by kmer) group by n_datasets",
        "private_kmers": f"with {_MAT} select source, count(*) n_private from (select kmer, min(source) source from mat group by kmer having count(*) = 1) group by source",
        "kmer_set_ops": f"with {_MAT}, a as (select kmer from mat where source = 'src0'), b as (select kmer from mat where source = 'src1') select 'union' op, count(distinct kmer) n from mat union all select 'intersect', count(*) from a where kmer in (select kmer from b) union all select 'except', count(*) from a where kmer not in (select kmer from b)",
        "reads_min2": f"with {_KM} select kmer, source, count(*)::int count from km group by kmer, source having count(*) >= 2",
        "kmer_overlaps": f"with {_MAT}, v as (select kmer, string_agg(source || ':' || c, ',' order by source) counts, count(*) n from mat group by kmer), b as (select kmer, counts, n from v union select reverse(translate(kmer, 'ACGT', 'TGCA')), counts, n from v) select x.n::int n_datasets, count(*) n_steps, count(distinct x.kmer) n_from from b x join b y on substr(x.kmer, 2) = substr(y.kmer, 1, {K - 1}) and x.counts = y.counts group by x.n",
        "dataset_name_parse": "select page_id, case when contains(coalesce(url, ''), '/') and not contains(regexp_extract(url, '([^/]*)$', 1), '.') then url else regexp_extract(regexp_extract(coalesce(url, ''), '([^/]*)$', 1), '^([^.]*)', 1) end as name from pages",
        "km_header_parse": "select doc_id, (case doc_id % 3 when 0 then doc_id % 70 when 1 then doc_id % 90 else 1 end)::int count, n_chars * 2 kc from documents",
        "rle_vectors": f"with {_RUNS}, r as (select item_id, s, c, e - s + 1 len from runs where source = (select min(source) from documents)), parts as (select item_id, s + 3 * p s, least(3, len - 3 * p) len, c from (select *, unnest(generate_series(0, (len - 1) // 3)) p from r)) select item_id, string_agg(len || 'x' || c, ',' order by s) runs, true lossless from parts group by item_id",
    }
