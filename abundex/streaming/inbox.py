"""A streaming front end: query files that arrive in a folder are answered against an open index.

Every micro-batch is a stateless join with the index's static tables, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.functions.kmers import is_acgt
from abundex.plans.index import Index


def queries_from_text(text: DataFrame, k: int) -> DataFrame:
    """queries(query_ord, header, seq, file) of FASTA texts (value, file); query_ord counts within a file."""
    parts = text.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\n>")).alias("query_ord", "t")).where("query_ord > 0")
    seq = F.upper(F.regexp_replace(F.expr("case when instr(t, '\n') > 0 then substring(t, instr(t, '\n') + 1) else '' end"), r"\s", ""))
    rows = parts.select("file", (F.col("query_ord") - 1).cast("bigint").alias("query_ord"), F.split_part(F.substring_index("t", "\n", 1), F.lit(" "), F.lit(1)).alias("header"), seq.alias("seq"))
    return rows.where((F.length("seq") >= k) & is_acgt("seq"))


def answer_inbox(index: Index, inbox: str, out: str, checkpoint: str, format: str = "raw", threshold: int = 40, once: bool = True):
    """Start a stream that answers each FASTA file of the inbox into Parquet under out, one folder a batch.

    once: answer what is there and stop; else go on. Returns the streaming query."""
    spark = index.kmer_class.sparkSession
    files = spark.readStream.option("wholetext", "true").format("text").load(inbox).select("value", F.col("_metadata.file_path").alias("file"))

    def answer(batch: DataFrame, epoch: int) -> None:
        rows = queries_from_text(batch, index.k)
        # a query's order is unique within a file; the batch's key is both
        keyed = rows.withColumn("query_ord", F.xxhash64("file", "query_ord")).select("query_ord", "header", "seq", "file")
        result = index.query(keyed.select("query_ord", "header", "seq"), format, threshold)
        result.join(keyed.select("query_ord", "file"), "query_ord").drop("query_ord").write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = files.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
