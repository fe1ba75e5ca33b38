import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundex.functions import abundance as ab
from abundex.functions import kmers as km
from abundex.functions import names

RC = str.maketrans("ACGT", "TGCA")


def canon(x):
    return min(x, x.translate(RC)[::-1])


def code(x):
    return int(x.translate(str.maketrans("ACGT", "0123")), 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=60), min_size=1, max_size=4), st.integers(1, 31))
def test_roll(seqs, k):
    got = [tuple(map(int, x)) for x in zip(*km.roll([s.encode() for s in seqs], k))]
    want = [(code(canon(s[i : i + k])), j, i) for j, s in enumerate(seqs) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    assert got == want


def test_expressions(spark):
    df = spark.createDataFrame([("ACGTT",), ("AAAA",), ("TTTTA",)], "s string")
    out = [tuple(r) for r in df.select(km.reverse_complement("s"), km.canonical("s"), km.encode("s"), km.decode(km.encode("s"), 5)).collect()]
    assert out[0] == ("AACGT", "AACGT", code("ACGTT"), "ACGTT")
    assert out[2][:2] == ("TAAAA", "TAAAA")
    x = spark.createDataFrame([("ACGNACG",), ("AC",), ("",)], "s string").select(km.kmer_strings("s", 3).alias("k")).collect()
    assert [r["k"] for r in x] == [["ACG", "ACG"], [], []]
    big = "ACGTACGTACGTACGTACGTACGTACGTACG"
    assert spark.createDataFrame([(big,)], "s string").select(km.decode(km.encode("s"), 31)).first()[0] == big


def test_palindrome_of_even_k():
    assert list(km.roll([b"ACGT"], 4)[0]) == [code("ACGT")]


def _breaks():
    out, edges = [], [0, 70, 100, 500, 1000, 5000, 10000, 50000]
    for lo, hi, step in zip(edges, edges[1:], (1, 2, 10, 20, 100, 200, 1000)):
        out += range(lo, hi, step)
    return [*out, 50000]


def test_quantize(spark):
    b = _breaks()
    counts = [0, 1, 69, 70, 71, 72, 99, 100, 255, 256, 499, 500, 999, 1000, 5000, 9999, 10000, 49999, 50000, 65535, 65536, 10**6]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in counts], "c int").select(ab.quantize(F.col("c"))).collect()]
    assert got == [min(255, int(np.searchsorted(b, c, "right")) - 1) for c in counts]


def test_log_keeps_presence(spark):
    got = [r[0] for r in spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, 1023, 1024)], "c int").select(ab.log_bin(F.col("c"))).collect()]
    assert got == [0, 1, 2, 2, 3, 10, 11]


def test_headers(spark):
    hs = [">1 LN:i:31 KC:i:6130 km:f:175.2 L:+:3:-", ">2 KM:f:3.0", ">3 no tag", ">4 km:f:1e2"]
    df = spark.createDataFrame([(h,) for h in hs], "h string")
    assert [r[0] for r in df.select(ab.mean_abundance(F.col("h")).cast("int")).collect()] == [175, 3, 1, 100]
    assert [r[0] for r in df.select(ab.count_sum(F.col("h"))).collect()] == [6130, None, None, None]


def test_record_modes(spark):
    df = spark.createDataFrame([(70000,)], "c int")
    assert df.select(ab.record(F.col("c"), "exact"), ab.record(F.col("c"), "exact", 65535), ab.record(F.col("c"), "presence"), ab.record(F.col("c"), "quantized")).first()[:] == (70000, 65535, 1, 255)
    with pytest.raises(ValueError):
        ab.record(F.col("c"), "other")


def test_names(spark):
    paths = ["a/b/x.unitigs.fa", "x.fa.gz", "x", "dir.d/plain", "/r/.hidden"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(names.dataset_name(F.col("p"))).collect()] == ["x", "x", "x", "dir.d/plain", ""]
    df = spark.createDataFrame([(">abc def",), ("y" * 60,)], "h string")
    assert [r[0] for r in df.select(names.result_name(F.col("h"))).collect()] == ["abc", "y" * 50]
