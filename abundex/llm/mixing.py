"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash, form blocks. The target is the fluid schedule that serves all sources with
blocks left at once, in proportion to their exact weights; when a source runs out, the others go on with theirs
renormalised. A block is released at the floor of the time its fluid service starts and due at the ceiling of the time it
ends, and the released block that is due first gets each slot. So after any number of slots every source is less than
one block away from its share, however many there are. In virtual time, at which a source of weight w gets w blocks a
unit, block k starts at k / w whatever else runs, so sources that run out cost nothing: the whole schedule takes a step a
block on the driver, in pieces, and goes to a mapped file with 8 bytes a block.

Ranks within a source come from counts of hash ranges of about range_rows rows, so no task holds a whole source. Every
row gets a slot: sources without a positive weight follow after all others, in proportion to their sizes.

Defined cases: a null source is a source of its own, named by weights[None]; equal hashes are ordered by doc_id, and
rows that repeat get slots of their own; an empty table gives an empty table; extra columns pass through, and columns
named like the added ones are replaced. Any number of sources is scheduled; only a caller that sets max_sources gets a
ValueError beyond it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundex.llm.common import Arrays, rename_clashes

ADDED = ["source_block", "mix_block", "mix_index"]
#: A time this near to a whole number is that number.
NEAR = 1e-6


class _Fluid:
    """Time as a function of virtual time: the sum of min(blocks, weight * v) over the sources."""

    def __init__(self, blocks: np.ndarray, weights: np.ndarray):
        ends = blocks / weights
        order = np.argsort(ends, kind="stable")
        self.v = np.concatenate(([0.0], ends[order]))
        rate = np.cumsum(weights[order][::-1])[::-1]
        self.t = np.concatenate(([0.0], np.cumsum(np.diff(self.v) * rate)))
        self.t *= blocks.sum() / self.t[-1]

    def time(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, self.v, self.t)

    def virtual(self, t: float) -> float:
        return float(np.interp(t, self.t, self.v))


def _schedule(blocks: np.ndarray, weights: np.ndarray, out: np.ndarray, start: np.ndarray, base: int, step: int) -> None:
    """Write the slot of block k of source i to out[start[i] + k]; step: slots whose windows are held at once."""
    fluid, total = _Fluid(blocks, weights), int(blocks.sum())
    done = np.zeros(len(blocks), np.int64)
    due: list[tuple[int, float, int]] = []
    t = 0
    for lo in range(0, total, step):
        hi = total if lo + step >= total else lo + step
        upto = blocks if hi == total else np.minimum(blocks, np.ceil(fluid.virtual(hi - NEAR) * weights).astype(np.int64))
        n = np.maximum(upto - done, 0)
        i = np.repeat(np.arange(len(blocks)), n)
        k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + done[i]
        done += n
        release = np.floor(fluid.time(k / weights[i]) + NEAR).astype(np.int64)
        finish = fluid.time((k + 1) / weights[i])
        deadline = np.ceil(finish - NEAR).astype(np.int64)
        order = np.lexsort((i, deadline, release))
        jobs = zip(release[order].tolist(), deadline[order].tolist(), finish[order].tolist(), (start[i] + k)[order].tolist())
        job = next(jobs, None)
        while job or (due and (t < hi or hi == total)):
            while job and (job[0] <= t or not due):
                heapq.heappush(due, job[1:])
                job = next(jobs, None)
            out[heapq.heappop(due)[2]] = base + t
            t += 1


def fill_slots(blocks: np.ndarray, weights: np.ndarray, out: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Fill out with the slots of all blocks, source by source; returns where each source starts."""
    start = np.cumsum(blocks) - blocks
    base = 0
    for own, w in (((blocks > 0) & (weights > 0), weights), ((blocks > 0) & ~(weights > 0), blocks.astype(float))):
        at = np.flatnonzero(own)
        if len(at):
            _schedule(blocks[at], w[at], out, start[at], base, step)
            base += int(blocks[at].sum())
    return start


def plan(blocks: list[int], weights: list[float], step: int = 1 << 19) -> list[np.ndarray]:
    """For each source the slots of its blocks."""
    b = np.asarray(blocks, np.int64)
    out = np.zeros(int(b.sum()), np.int64)
    start = fill_slots(b, np.asarray(weights, float), out, step)
    return [out[s : s + n] for s, n in zip(start, b)]


def slots_of(slots: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Slots of a source's blocks k."""
    return slots[k]


def mix_sources(docs: DataFrame, weights: dict | None = None, block_rows: int = 256, range_rows: int = 2000, seed: int = 11, max_sources: int | None = None) -> DataFrame:
    """docs with source_block, mix_block (its slot in the mixture) and mix_index (the row within the block).

    weights: source -> target weight; by default the square root of the source's rows."""
    docs = rename_clashes(docs, [*ADDED, "_h", "_r", "_n", "_k", "_before", "_s", "_q", "_src", "_ranges", "_start"])
    spark = docs.sparkSession
    table = docs.groupBy("source").agg(F.count("*").alias("n")).toArrow()
    if max_sources is not None and table.num_rows > max_sources:
        raise ValueError(f"more than {max_sources} sources; group the rare ones first")
    table = table.sort_by([("source", "ascending")])
    counts = table["n"].to_numpy().astype(np.int64)
    w = np.sqrt(counts) if weights is None else np.array([float(weights.get(s) or 0.0) for s in table["source"].to_pylist()])
    blocks = -(-counts // block_rows)
    arrays = Arrays(spark, "mixture")
    slots = arrays.create_raw("slots", np.int64, int(blocks.sum()))
    start = fill_slots(blocks, w, slots)
    if hasattr(slots, "flush"):
        slots.flush()
    arrays.publish()
    ranges = np.clip(counts // range_rows, 1, 1 << 20)
    sources = spark.createDataFrame(pa.table({"_src": table["source"], "_ranges": pa.array(ranges), "_start": pa.array(start)}))

    # rank of the hash among 2**20 equal steps, then a range of about range_rows rows
    def ranged(df: DataFrame) -> DataFrame:
        own = df.join(sources, F.col("source").eqNullSafe(F.col("_src")))
        return own.withColumn("_r", F.shiftright(F.shiftrightunsigned("_h", 44) * F.col("_ranges"), 20)).drop("_src", "_ranges")

    h = F.xxhash64(F.lit(seed), "doc_id", "source")
    marked = ranged(docs.withColumn("_h", h))
    order = Window.partitionBy("_s").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged(docs.select("source", h.alias("_h"))).groupBy(F.col("source").alias("_s"), F.col("_r").alias("_q")).agg(F.count("*").alias("_n")).select("_s", "_q", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    ranked = marked.withColumn("_k", F.row_number().over(Window.partitionBy("source", "_r").orderBy("_h", "doc_id")) - 1)
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_q")))
    k = F.col("_before") + F.col("_k")

    def slot(place: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(arrays.get_raw("slots", np.int64)[place.to_numpy(np.int64)]))

    numbered = ranked.withColumn("source_block", F.floor(k / block_rows).cast("long")).withColumn("mix_index", F.pmod(k, F.lit(block_rows)).cast("long"))
    return numbered.withColumn("mix_block", F.pandas_udf(slot, "long")(F.col("_start") + F.col("source_block"))).select(*docs.columns, *ADDED)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
