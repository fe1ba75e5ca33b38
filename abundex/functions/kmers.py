"""K-mer expressions (built-in functions only) and the vectorised roller behind the index build.

A k-mer of k <= 31 is a BIGINT of 2-bit codes, A 0, C 1, G 2, T 3, so numbers order as the strings do; the canonical
form is the smaller of a k-mer and its reverse complement.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CODE_K = 31


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(x: Column | str) -> Column:
    return F.reverse(F.translate(col(x), "ACGT", "TGCA"))


def canonical(x: Column | str) -> Column:
    return F.least(col(x), reverse_complement(x))


def is_acgt(x: Column | str) -> Column:
    return col(x).rlike("^[ACGT]+$")


def acgt_only(x: Column | str) -> Column:
    """Upper-cased, without any other character."""
    return F.regexp_replace(F.upper(col(x)), "[^ACGT]+", "")


def kmer_strings(seq: Column | str, k: int) -> Column:
    """All k-mers in order, in time linear in the sequence; windows with other characters are left out."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def encode(x: Column | str) -> Column:
    """2-bit code of a k-mer of at most 31 bases."""
    return F.conv(F.translate(col(x), "ACGT", "0123"), 4, 10).cast("bigint")


def decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


_CODE = np.full(256, 4, np.uint8)
for _b, _c in zip(b"ACGTacgt", (0, 1, 2, 3) * 2):
    _CODE[_b] = _c


def roll(sequences: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical codes of all k-mers without other characters, with the sequence and the position of each.

    Windows of 1, 2, 4, ... bases are joined to windows of k, so the work is a few array operations for each bit of k."""
    joined = b"\n".join(sequences) + b"\n"
    c = _CODE[np.frombuffer(joined, np.uint8)]
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.concatenate(([0], np.cumsum(c == 4, dtype=np.int64)))
    ok = np.flatnonzero(bad[k:] == bad[:-k])
    f = (c & 3).astype(np.uint64)
    r = f ^ np.uint64(3)
    size, have = 1, 0
    fwd = rev = None
    rest = k
    while True:
        if rest & 1:
            if have == 0:
                fwd, rev, have = f, r, size
            else:
                m = len(c) - have - size + 1
                fwd, rev = (fwd[:m] << np.uint64(2 * size)) | f[have : have + m], (r[have : have + m] << np.uint64(2 * have)) | rev[:m]
                have += size
        rest >>= 1
        if not rest:
            break
        m = len(f) - size
        f, r = (f[:m] << np.uint64(2 * size)) | f[size:], (r[size:] << np.uint64(2 * size)) | r[:m]
        size *= 2
    codes = np.minimum(fwd[ok], rev[ok]).view(np.int64)
    starts = np.cumsum([0] + [len(s) + 1 for s in sequences[:-1]])
    owner = np.searchsorted(starts, ok, "right") - 1
    return codes, owner, ok - starts[owner]
