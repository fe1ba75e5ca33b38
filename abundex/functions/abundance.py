"""What a k-mer's abundance is recorded as: presence, exact, quantized or log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("presence", "exact", "quantized", "log")

#: (first count, step, first bin) of the quantization's ranges (fixed values); counts of 50 000 and more are bin 255.
RANGES = [(0, 1, 0), (70, 2, 70), (100, 10, 85), (500, 20, 125), (1000, 100, 150), (5000, 200, 190), (10000, 1000, 215)]
LAST_BIN = 255


def quantize(count: Column) -> Column:
    """The bin of a count: bins are one wide up to 70 and wider from range to range."""
    out = F.lit(None).cast("int")
    for low, step, bin_ in RANGES:
        out = F.when(count >= low, F.least(F.lit(LAST_BIN), F.floor((count - low) / step) + bin_).cast("int")).otherwise(out)
    return out


def bin_value(bin_: Column) -> Column:
    """The middle of a bin's counts, rounded down."""
    out = F.lit(None).cast("int")
    for low, step, first in RANGES:
        out = F.when(bin_ >= first, (low + (bin_ - first) * step + (step // 2)).cast("int")).otherwise(out)
    return out


def log_bin(count: Column) -> Column:
    """1 + floor(log2(count)), so that a count of 1 isn't taken for absence."""
    # the number of binary digits, exact where floating logs aren't
    return F.when(count > 0, F.length(F.bin(count.cast("bigint")))).otherwise(F.lit(0)).cast("int")


def record(count: Column, mode: str, saturate: int | None = None) -> Column:
    """count as the mode stores it; saturate caps exact counts (65535 for 16 bits)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    count = count.cast("int")
    if mode == "presence":
        return F.when(count > 0, 1).otherwise(0).cast("int")
    if mode == "quantized":
        return quantize(count)
    if mode == "log":
        return log_bin(count)
    return F.least(count, F.lit(saturate)) if saturate else count


def mean_abundance(header: Column) -> Column:
    """The km:f: tag (either case) of a unitig header; 1 without one."""
    return F.coalesce(F.regexp_extract(header, r"(?i)km:f:([0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)", 1).try_cast("float"), F.lit(1.0).cast("float"))


def count_sum(header: Column) -> Column:
    """The KC:i: tag of a unitig header; null without one."""
    return F.regexp_extract(header, r"KC:i:([0-9]+)", 1).try_cast("bigint")
