"""Line dedup: Bloom filters for once-seen and twice-seen line hashes, exact confirmation of the suspects.

Three scans of the text; what is shuffled are packed slots and the suspects:

1. every task hashes its eligible lines to slots of two Bloom arrays (two hash functions, one array each) and sends,
   per 64 Ki-slot slice, the 16-bit slots that it saw once and those that it saw twice; the slices are merged with
   carry: a slot that two tasks saw becomes twice-seen;
2. the twice-seen filter (bounded by max_log2_bits) is broadcast; lines whose slots are both twice-seen are suspects
   and are shuffled as (line, doc_id) for exact counts of distinct documents; false positives of the filter fall out
   here, and the filter has no false negatives;
3. texts are rewritten in place by the confirmed lines and their holders, which are broadcast while their size, which is
   checked, allows (max_broadcast bytes); beyond it each document gets the lines that it loses by a join.

A full filter at extreme sizes only lets more lines through to the exact step. Counts of a hot line are pre-aggregated
per (line, doc_id), so no task gathers one line's documents.

Defined cases: null or empty text is one empty line; a null doc_id neither counts nor loses lines; rows that repeat a
doc_id count as one document and all keep the line if that doc_id is the one that keeps it; extra columns pass
through, and columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import keep, rename_clashes, small_batches

STRIP = " \t\n\x0b\x0c\r"
UPPER = re.compile("[A-Z]+")
SLICE_BITS = 16


def line_key(line: str) -> str:
    """Stripped of ASCII white space at both ends, with A-Z lower-cased."""
    line = line.strip(STRIP)
    return line.lower() if line.isascii() else UPPER.sub(lambda m: m[0].lower(), line)


def _keys(text: str | None, min_chars: int) -> set[str]:
    if not text or len(text) < min_chars:
        return set()
    return {k for x in text.split("\n") if len(x) >= min_chars and len(k := line_key(x)) >= min_chars}


def _slots(keys: list[str], log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))
    return h >> np.uint64(64 - log2_bits), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log2_bits)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16)


def repeat_filter(docs: DataFrame, min_chars: int, log2_bits: int) -> list[dict[int, np.ndarray]]:
    """The twice-seen bit slices of the two arrays, from all lines of all documents."""
    n = 1 << SLICE_BITS

    def scan(batches):
        for b in batches:
            keys: list[str] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                if doc is not None:
                    keys += _keys(text, min_chars)
            if not keys:
                continue
            out: dict[str, list] = {"slice": [], "once": [], "twice": []}
            for a, slots in enumerate(_slots(keys, log2_bits)):
                slots, counts = np.unique(slots, return_counts=True)
                part = (slots >> np.uint64(SLICE_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.diff(part)) + 1
                for lo, hi in zip([0, *cut], [*cut, len(part)]):
                    low = (slots[lo:hi] & np.uint64(n - 1)).astype(np.uint16)
                    out["slice"].append(int(part[lo]) * 2 + a)
                    out["once"].append(low.tobytes())
                    out["twice"].append(low[counts[lo:hi] > 1].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("slice", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, once, twice in zip(*(b[c].to_pylist() for c in ("slice", "once", "twice"))):
                if s not in state:
                    state[s] = np.zeros(n, bool), np.zeros(n, bool)
                seen, again = state[s]
                low = _unpack(once)
                again[low[seen[low]]] = True
                seen[low] = True
                again[_unpack(twice)] = True
        bits = {s: zlib.compress(np.packbits(again).tobytes(), 1) for s, (_, again) in state.items() if again.any()}
        yield pa.RecordBatch.from_pydict({"slice": list(bits), "bits": list(bits.values())}, schema=pa.schema([("slice", pa.int64()), ("bits", pa.binary())]))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").mapInArrow(scan, "slice long, once binary, twice binary").repartition(parts, "slice").mapInArrow(merge, "slice long, bits binary")
    found: list[dict[int, np.ndarray]] = [{}, {}]
    for r in rows.collect():  # at most 2 * 2**log2_bits bits in all, compressed
        found[r["slice"] % 2][r["slice"] // 2] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return found


def _bitmap(slices: dict[int, np.ndarray], log2_bits: int) -> np.ndarray:
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    step = 1 << (SLICE_BITS - 3)
    for s, b in slices.items():
        bits[s * step : (s + 1) * step] = b
    return bits


def suspects(docs: DataFrame, min_chars: int, log2_bits: int) -> DataFrame:
    """(key, doc_id) of every line that the filter takes for a repeat; a line once for each row."""
    maps = [_bitmap(s, log2_bits) for s in repeat_filter(docs, min_chars, log2_bits)]
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def scan(batches):
        filters = shared.value
        for b in batches:
            keys: list[str] = []
            ids: list[int] = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                if doc is not None:
                    own = _keys(text, min_chars)
                    keys += own
                    ids += [doc] * len(own)
            if not keys:
                continue
            hit = np.ones(len(keys), bool)
            for f, s in zip(filters, _slots(keys, log2_bits)):
                hit &= (f[(s >> np.uint64(3)).astype(np.int64)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_pydict({"key": [keys[i] for i in at], "doc_id": [ids[i] for i in at]}, schema=pa.schema([("key", pa.string()), ("doc_id", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "key string, doc_id long")


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, max_log2_bits: int) -> tuple[DataFrame, DataFrame]:
    """Suspects (key, doc_id), and the confirmed lines among them (key, holder), exact on the lines themselves."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    log2_bits = max(SLICE_BITS, min(max_log2_bits, int(8 * chars / 100).bit_length()))
    found = keep(suspects(docs, min_chars, log2_bits).groupBy("key", "doc_id").agg(F.lit(1).alias("one")).drop("one"), "suspects")
    confirmed = found.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs).select("key", "holder")
    return found, keep(confirmed, "repeats")  # so that both sides of a join come straight from storage and a hot line can be split


def _rewrite_by(holders) -> Callable:
    """Text and lines lost, from the broadcast lines and their holders."""

    def rewrite(text: pd.Series, doc_id: pd.Series) -> pd.DataFrame:
        known, texts, dropped = holders.value, [], []
        for t, i in zip(text, doc_id):
            lines = t.split("\n") if t else []
            left = [x for x in lines if known.get(line_key(x), i) == i] if i is not None else lines
            texts.append(None if len(left) == len(lines) else "\n".join(left))
            dropped.append(len(lines) - len(left))
        return pd.DataFrame({"text": texts, "n_dropped": np.array(dropped, np.int64)})

    return rewrite


def _rewrite(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
    texts, dropped = [], []
    for t, d in zip(text, drop):
        if t is None or d is None:
            texts.append(None)
            dropped.append(0)
            continue
        gone, lines = set(d), t.split("\n")
        left = [x for x in lines if line_key(x) not in gone]
        texts.append("\n".join(left))
        dropped.append(len(lines) - len(left))
    return pd.DataFrame({"text": texts, "n_dropped": np.array(dropped, np.int64)})


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, max_log2_bits: int = 28, max_broadcast: int = 32 << 20) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines (before) and n_dropped (both long) added.

    Lines of at least min_chars code points that at least min_docs documents hold stay only in the largest doc_id.
    max_log2_bits bounds each Bloom array (2**28 bits: 32 MB), max_broadcast the bytes of the broadcast lines."""
    docs = small_batches(rename_clashes(docs, ["n_lines", "n_dropped", "drop", "_new"]))
    found, confirmed = repeated_lines(docs, min_chars, min_docs, max_log2_bits)
    text = F.coalesce(F.col("text"), F.lit(""))
    new = "struct<text:string,n_dropped:long>"
    if (confirmed.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) <= max_broadcast:
        rows = confirmed.toArrow()
        holders = docs.sparkSession.sparkContext.broadcast(dict(zip(rows["key"].to_pylist(), map(str, rows["holder"].to_pylist()))))
        long_enough = F.when(F.length("text") >= min_chars, F.col("text"))
        joined = docs.withColumn("_new", F.pandas_udf(_rewrite_by(holders), new)(long_enough, F.col("doc_id").cast("string")))
    else:
        lost = found.join(confirmed, "key").where(F.col("doc_id") != F.col("holder"))
        drops = lost.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("drop"))
        joined = docs.join(drops, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        joined = joined.withColumn("_new", F.pandas_udf(_rewrite, new)(F.when(F.col("drop").isNotNull(), F.col("text")), F.col("drop")))
    columns = [F.coalesce(F.col("_new.text"), text).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce("_new.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


#: The contract's digest in DuckDB: white space [\x20\x09-\x0D] stripped, A-Z lower-cased by translate.
ORACLE = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) pos, unnest(l) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
rep as (select k, max(doc_id) holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select keyed.*, rep.k is not null and doc_id <> holder gone from keyed left join rep on keyed.k = rep.k)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from marked group by doc_id
"""


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
