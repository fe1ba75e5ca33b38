"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words (bytes.translate and split, so a scan costs little more than a copy). The
automaton holds every window of `window` consecutive item words (an item of fewer words is one window), each word as two
characters of the benchmark's vocabulary, and reads each text once: words that no item has are a pair that no window
holds. Matches are spans of words; for documents with hits the spans are mapped back to character offsets of the original
text.

The benchmark's words are held on the driver and broadcast; each worker process builds the automaton once, with about
1 KB a window. More than max_windows windows are a ValueError, so its size is bounded. Nothing is shuffled.

Defined cases: null text has no words; items with a null id are left out; an item_id that occurs more than once counts
once, with the windows of all its rows; benchmark rows without words match nothing; extra columns pass through, and
columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from abundex.llm.common import rename_clashes, small_batches

#: Bytes that stand inside words after lower-casing: digits, letters, and everything beyond ASCII.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(c if (c := b + 32 if 0x41 <= b <= 0x5A else b) in _KEEP else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

ADDED = ["n_words", "n_hit", "item_ids", "hit_spans"]


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Patterns:
    """The windows of all items: what is broadcast, and the automaton that a worker builds from it once."""

    def __init__(self, rows: list[tuple[object, list[bytes]]], window: int, max_windows: int):
        self.window, self.key = window, uuid.uuid4().hex
        self.ids = sorted({i for i, _ in rows})
        number = {x: n for n, x in enumerate(self.ids)}
        self.items = [(number[i], w) for i, w in rows if w]
        self.code: dict[bytes, str] = {}
        for _, w in self.items:
            for x in w:
                n = len(self.code)
                self.code.setdefault(x, chr(0x110 + n // 255) + chr(1 + n % 255))
        if sum(max(1, len(w) - window + 1) for _, w in self.items) > max_windows:
            raise ValueError(f"more than {max_windows} windows; give max_windows the memory of a worker, or split the benchmark")

    def automaton(self) -> ahocorasick.Automaton:
        """Each value: the numbers of the items with the window, and its words."""
        if _BUILT.get("key") != self.key:
            held: dict[str, set[int]] = {}
            for n, w in self.items:
                code = [self.code[x] for x in w]
                for i in range(max(1, len(w) - self.window + 1)):
                    held.setdefault("".join(code[i : i + self.window]), set()).add(n)
            a = ahocorasick.Automaton()
            for x, n in held.items():
                a.add_word(x, (tuple(n), len(x) // 2))
            if held:
                a.make_automaton()
            _BUILT.update(key=self.key, automaton=a if held else None)
        return _BUILT["automaton"]


#: The automaton of this process.
_BUILT: dict = {}


def join_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted disjoint (first, last + 1) spans; those that overlap or touch become one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def scan_words(w: list[bytes], a, code: dict[bytes, str]) -> tuple[set[int], list[tuple[int, int]]]:
    """The numbers of the items whose windows occur, and the word spans of all occurrences."""
    items: set[int] = set()
    spans = []
    if w and a is not None:
        for end, (found, n) in a.iter("".join([code.get(x, "\0\0") for x in w])):
            items.update(found)
            spans.append((end // 2 + 1 - n, end // 2 + 1))
    return items, spans


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """docs with n_words and n_hit (long), item_ids (array) and hit_spans (array of start, end offsets in text)."""
    docs = small_batches(rename_clashes(docs, ADDED))
    ids = T.ArrayType(benchmark.schema["item_id"].dataType)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    done = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", ids), T.StructField("hit_spans", T.ArrayType(span))])
    known = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    patterns = Patterns([(r["item_id"], words(r["text"])) for r in known.toLocalIterator()], window, max_windows)
    return docs.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(patterns), to_arrow_type(ids)), done)


def _scanner(shared, kind: pa.DataType):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        known = shared.value
        a = known.automaton()
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for text in b["text"].to_pylist():
                w = words(text)
                items, spans = scan_words(w, a, known.code)
                joined = join_spans(spans)
                at = [m.span() for m in WORD.finditer(text)] if joined else ()
                rows.append((len(w), sum(hi - lo for lo, hi in joined), [known.ids[n] for n in sorted(items)], [{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in joined]))
            new = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), kind, pa.list_(span)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *ADDED])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return find_benchmark(docs, benchmark, window).where(F.col("n_hit") == 0).select(*[c for c in docs.columns if c not in ADDED])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find_benchmark(docs.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: One row a window; a document's words are numbered and its windows joined with the items'.
ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bw as (
  select distinct item_id, len(w) n, array_to_string(w, ' ') g from b where len(w) between 1 and 9
  union select distinct item_id, 10 n, array_to_string(w[i:i+9], ' ') g from (select item_id, w, unnest(generate_series(1, len(w) - 9)) i from b where len(w) >= 10)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') g from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from w, sizes where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
hit_words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from (select distinct doc_id, i, n from hits)) group by doc_id),
hit_items as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, item_id::varchar id from hits) group by doc_id)
select w.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
