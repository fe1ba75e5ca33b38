"""Per-document text statistics, whole texts, one Arrow pass and no shuffle.

Null and empty texts have zeros everywhere (and one line).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundex.llm.common import rename_clashes, small_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punct", "n_pipes", "n_other", "max_word"]

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PUNCT = b".,;:!?"
_BLANK = b" \t\n\x0b\x0c\r"
_OTHER = bytes(b for b in range(128) if b not in _SYMBOLS + _DIGITS + _PUNCT + _BLANK and not 65 <= b <= 90 and not 97 <= b <= 122)


def _count(b: bytes, kind: bytes) -> int:
    return len(b) - len(b.translate(None, kind))


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words that lie in a window of `width` consecutive words which occurs twice or more."""
    if len(ids) <= width:
        return 0
    code = ids[: len(ids) - width + 1].astype(np.int64)
    size = distinct
    for i in range(1, width):
        if size > (1 << 62) // max(1, distinct):
            code = np.unique(code, return_inverse=True)[1]
            size = len(code)
        code = code * distinct + ids[i : len(ids) - width + 1 + i]
        size *= distinct
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for i in range(width):
        inside[i : i + len(code)] |= again
    return int(inside.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; words are runs without [\\x20\\x09-\\x0D]."""
    text = text or ""
    b = text.encode("utf-8", "surrogatepass")
    w = b.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(x, len(index)) for x in w), np.int64, len(w))
    lines = text.split("\n")
    dups = 0
    if len(lines) > 1:
        seen = set()
        for x in lines:
            if x in seen:
                dups += bool(x.strip(" \t\x0b\x0c\r"))
            else:
                seen.add(x)
    return (
        len(w), len(text) - _count(b, _BLANK), _count(b, _SYMBOLS), dups, repeated_words(ids, len(index)), len(lines), len(index),
        _count(b, _UPPER), _count(b, _DIGITS), _count(b, _PUNCT), b.count(b"|"), _count(b, _OTHER), max(map(len, w), default=0),
    )


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep (without text, as a rule), and COUNTS as longs."""
    keep = [c for c in keep if c not in COUNTS]
    docs = small_batches(rename_clashes(docs, COUNTS))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = np.array([text_counts(t) for t in b["text"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Transformed statistics: logs of sizes, square roots of rates.
VECTOR = {
    "log_words": lambda: F.log1p("n_words"),
    "log_word_len": lambda: F.log1p(ratio("word_chars", "n_words")),
    "symbols": lambda: F.sqrt(ratio("n_symbols", "n_words")),
    "dup_lines": lambda: F.sqrt(ratio("n_dup_lines", "n_lines")),
    "repeats": lambda: F.sqrt(ratio("n_repeat_words", "n_words")),
    "upper": lambda: F.sqrt(ratio("n_upper", "word_chars")),
    "digits": lambda: F.sqrt(ratio("n_digits", "word_chars")),
    "punct": lambda: F.sqrt(ratio("n_punct", "n_words")),
    "other": lambda: F.sqrt(ratio("n_other", "n_words")),
    "distinct": lambda: F.log1p("n_distinct") / F.greatest(F.log1p("n_words"), F.lit(0.5)),
    "log_line_words": lambda: F.log1p(ratio("n_words", "n_lines")),
    "log_max_word": lambda: F.log1p("max_word"),
}
