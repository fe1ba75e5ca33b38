"""Interpolated modified Kneser-Ney word model (bigrams), counted in Spark and memory-mapped by the workers.

Counting moves packed arrays, not rows: a task sums what it read into sorted arrays, cuts them by key range and sends
each range as one row; a range's task merges them. First the words (64-bit hashes and counts) make a sorted vocabulary;
then bigrams, as pairs of vocabulary ranks, make a sorted key array, and from it the classes of continuations of every
context and the left contexts of every word. Ranges are cut by token counts, so a frequent word's bigrams are spread
over several ranges. Each range's task writes its place in the files of the model: sorted arrays of hashes or
keys beside probabilities and back-off weights, which workers map and search by bisection; the driver sees sizes and sums
only. (Where the shared folder isn't a mounted path, the driver writes the files, range by range, and sends them out.) All training tokens are counted, no
n-gram is pruned, and the model grows with the corpus; it must fit a worker's disk, not its memory.

Defined cases: null text is empty, a text of one end token; a null doc_id isn't held out; without any training document
every token is unknown with probability 1; rows that repeat count each time; extra columns pass through score(), and
columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundex.llm.common import Arrays, crc_mod, forget, keep, rename_clashes, small_batches

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"  # no word holds white space
FLUSH = 1 << 21
ADDED = ["n_tokens", "n_known", "base_score", "score"]


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and one end, and the number of tokens of each text."""
    every: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else []
        w.append(END)
        sizes[i] = len(w)
        every += w
    return np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every)), sizes


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an unsigned array: high planes of small numbers are runs of zeros, which codecs shrink."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if counts is None:
        s = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
        return s[first], np.diff(np.append(first, len(s))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    return s[first], np.add.reduceat(counts[order], first).astype(np.uint64) if len(s) else np.empty(0, np.uint64)


_PART = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART_DDL = "part long, keys binary, counts binary"


def _ranges(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """One row for each range of sorted keys; cuts are the first keys of the ranges after the first."""
    at = [0, *np.searchsorted(keys, cuts, "left").tolist(), len(keys)]
    rows = [(i, pack_sorted(keys[lo:hi]), pack(counts[lo:hi])) for i, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _PART)], schema=_PART)


def _summed(docs: DataFrame, keys_of, cuts: np.ndarray) -> DataFrame:
    """Packed sums of keys_of(texts) over all rows, by range (several rows a range)."""

    def run(batches):
        waiting, n = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(keys_of(b["text"].to_pylist()))
                n += len(waiting[-1])
            if n >= FLUSH:
                yield _ranges(*tally(np.concatenate(waiting)), cuts)
                waiting, n = [], 0
        if n:
            yield _ranges(*tally(np.concatenate(waiting)), cuts)

    return docs.select("text").mapInArrow(run, _PART_DDL)


def _gather(batches):
    """part -> merged (keys, counts), of the rows of one partition."""
    state: dict[int, list] = {}

    def merged(rows):
        return tally(np.concatenate([k for k, _ in rows]), np.concatenate([c for _, c in rows]))

    for b in batches:
        for part, k, c in zip(*(b[x].to_pylist() for x in ("part", "keys", "counts"))):
            rows = state.setdefault(part, [])
            rows.append((unpack_sorted(k), unpack(c, np.uint64)))
            if sum(len(x) for x, _ in rows[1:]) > max(FLUSH, len(rows[0][0])):
                state[part] = [merged(rows)]
    for part in list(state):
        yield part, *merged(state.pop(part))


def _count_words(docs: DataFrame, parts: int, shuffle: int) -> DataFrame:
    cuts = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def merge(batches):
        for part, k, c in _gather(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(k)]), pa.array([int(c.sum())]), pa.array([pack_sorted(k)], pa.binary()), pa.array([pack(c)], pa.binary())], names=["part", "size", "total", "keys", "counts"])

    rows = _summed(docs, lambda texts: token_hashes(texts)[0], cuts).repartition(shuffle, "part")
    return keep(rows.mapInArrow(merge, "part long, size long, total long, keys binary, counts binary"), "words")


def _fill(table: DataFrame, arrays: Arrays, columns: dict) -> dict[int, int]:
    """Write the ranges of a table (part, size, ...) into raw files; columns: name -> (dtype, row -> array)."""
    sizes = {r["part"]: r["size"] for r in table.select("part", "size").collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p] = at
        at += sizes[p]
    if arrays.mounted:
        for n, (d, _) in columns.items():
            arrays.reserve(n, d, at)

        def write(batches):
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b[c][i].as_py() for c in b.schema.names}
                    for n, (d, f) in columns.items():
                        arrays.write(n, start[r["part"]], f(r).astype(d, copy=False))
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64())], names=["part"])

        table.mapInArrow(write, "part long").agg(F.count("part")).first()
        return start
    files = {n: arrays.create_raw(n, d, at) for n, (d, _) in columns.items()}
    for r in table.toLocalIterator():
        for n, (_, f) in columns.items():
            files[n][start[r["part"]] : start[r["part"]] + r["size"]] = f(r)
    for f in files.values():
        if hasattr(f, "flush"):
            f.flush()
    return start


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.0, 0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d)]


class Model:
    """Where the arrays are, and totals; small enough for closures."""

    def __init__(self, arrays: Arrays | None, tokens: int, vocabulary: int, unknown: float):
        self.arrays, self.tokens, self.vocabulary, self.unknown = arrays, tokens, vocabulary, unknown

    def array(self, name: str, dtype) -> np.ndarray:
        return self.arrays.get_raw(name, dtype)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and whether they are there. Each distinct key is searched once, in order,
    so that the search walks through the mapped pages instead of jumping."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, bool)
    distinct = s[new]
    at = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
    hit = table[at] == distinct
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return at[which], hit[which]


def _ranks(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Vocabulary ranks of hashes, -1 for unknown ones."""
    at, hit = _find(words, h)
    return np.where(hit, at, -1)


def _before(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The rank before each token; begin before the first of each text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = begin
    return out


def _pair_cuts(counts: np.ndarray, first_rank: int, run: float, targets: np.ndarray, base: int) -> np.ndarray:
    """The pairs at which the targets lie that fall into one range of contexts; run: tokens after earlier contexts. A
    frequent context is cut by the rank of the next word."""
    cum = run + np.cumsum(counts)
    own = targets[(targets >= run) & (targets < cum[-1])]
    first = np.searchsorted(cum, own, "right")
    before = np.where(first > 0, cum[first - 1], run)
    share = (own - before) / np.maximum(cum[first] - before, 1)
    return (first + first_rank).astype(np.uint64) * np.uint64(base) + (share * (base - 1)).astype(np.uint64)


def _cuts(vocab: DataFrame, start: dict[int, int], end: int, texts: int, parts: int, base: int) -> np.ndarray:
    """First pairs of all ranges but the first, so that each range has about as many tokens after its contexts. The end
    is no context; the begin is one, after the words."""
    sizes = {r["part"]: (r["size"], r["total"]) for r in vocab.select("part", "size", "total").collect()}
    last, run, at = max(sizes), {}, 0.0
    for p in sorted(sizes):
        run[p] = at
        at += sizes[p][1] - (texts if start[p] <= end < start[p] + sizes[p][0] else 0)
    targets = np.arange(1, parts) * ((at + texts) / parts)

    def cuts(batches):
        for b in batches:
            for part, raw in zip(b["part"].to_pylist(), b["counts"].to_pylist()):
                c = unpack(raw, np.uint64).astype(np.float64)
                if start[part] <= end < start[part] + len(c):
                    c[end - start[part]] = 0
                if part == last:
                    c = np.append(c, texts)
                yield pa.RecordBatch.from_arrays([pa.array(_pair_cuts(c, start[part], run[part], targets, base).view(np.int64))], names=["cut"])

    found = vocab.select("part", "counts").mapInArrow(cuts, "cut long").toArrow()["cut"].to_numpy()  # at most a cut a range
    return np.unique(found.astype(np.int64).view(np.uint64))


def fit(docs: DataFrame, parts: int | None = None) -> Model:
    """The model of all texts of docs."""
    spark = docs.sparkSession
    docs = small_batches(docs.select("text"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocab = _count_words(docs, parts or max(64, 2 * shuffle), shuffle)
    n_words, tokens = (int(x or 0) for x in vocab.agg(F.sum("size"), F.sum("total")).first())
    if not n_words:
        return Model(None, 0, 0, 1.0)
    if n_words >= 1 << 32:
        raise ValueError("ranks of over 2**32 words don't pack into 64-bit pairs")
    arrays = Arrays(spark, "wordlm")
    start = _fill(vocab, arrays, {"words": (np.uint64, lambda r: unpack_sorted(r["keys"])), "counts": (np.uint64, lambda r: unpack(r["counts"], np.uint64))})
    arrays.publish(["words", "counts"])
    end = int(_ranks(arrays.get_raw("words", np.uint64), np.array([xxhash.xxh3_64_intdigest(END)], np.uint64))[0])
    texts = int(arrays.get_raw("counts", np.uint64)[end])
    base = n_words + 1
    parts = parts or max(64, 2 * shuffle, tokens >> 21)
    shuffle = max(shuffle, parts // 2)
    cuts = _cuts(vocab, start, end, texts, parts, base)
    forget(vocab)

    def pairs(texts):
        h, sizes = token_hashes(texts)
        ids = _ranks(arrays.get_raw("words", np.uint64), h)
        return _before(ids, sizes, n_words).astype(np.uint64) * np.uint64(base) + ids.astype(np.uint64)

    id_cuts = (np.arange(1, parts) * (base / parts)).astype(np.uint64)

    def merge(batches):
        for part, k, c in _gather(batches):
            kind = np.minimum(c, 3)
            of = [int((c == i).sum()) for i in (1, 2, 3, 4)]
            yield _row(0, part, pack_sorted(k), pack(c.astype(np.uint32)), len(k), of)
            left, right = k // np.uint64(base), k % np.uint64(base)
            blobs = [(1, tally(right))]
            first = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            for i in (1, 2, 3):
                n = np.add.reduceat((kind == i).astype(np.uint64), first)
                blobs.append((i + 1, (left[first][n > 0], n[n > 0])))
            for what, (ids, n) in blobs:
                b = _ranges(ids, n, id_cuts)
                for p, x, y in zip(*(b[j].to_pylist() for j in range(3))):
                    yield _row(what, p, x, y, 0, [0] * 4)

    counted = keep(_summed(docs, pairs, cuts).repartition(shuffle, "part").mapInArrow(merge, _ROW_DDL), "bigrams")

    def dense(batches):
        state: dict[int, dict[int, list]] = {}
        for b in batches:
            for what, part, k, c in zip(*(b[x].to_pylist() for x in ("kind", "part", "keys", "counts"))):
                lo, hi = (int(id_cuts[part - 1]) if part else 0), (int(id_cuts[part]) if part < len(id_cuts) else base)
                own = state.setdefault(part, {i: np.zeros(hi - lo, np.uint64) for i in (1, 2, 3, 4)})
                own[what][(unpack_sorted(k) - np.uint64(lo)).astype(np.int64)] += unpack(c, np.uint64)
        for part, own in state.items():
            of = [int((own[1] == i).sum()) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(own[1])]), pa.array([int(own[1].sum())]), pa.array([of]), *(pa.array([pack(own[i].astype(np.uint32))], pa.binary()) for i in (1, 2, 3, 4))], names=["part", "size", "total", "of", "c1", "c2", "c3", "c4"])

    by_word = keep(counted.where("kind > 0").select("kind", "part", "keys", "counts").repartition(shuffle, "part").mapInArrow(dense, "part long, size long, total long, of array<long>, c1 binary, c2 binary, c3 binary, c4 binary"), "contexts")
    big = counted.where("kind = 0")
    d2 = discounts([int(x or 0) for x in big.agg(*[F.sum(F.col("of")[i]) for i in range(4)]).first()])
    *of, types = (int(x or 0) for x in by_word.agg(*[F.sum(F.col("of")[i]) for i in range(4)], F.sum("total")).first())
    d1 = discounts(of)
    edges = [0, *(int(x) for x in id_cuts), base]

    def context(part: int) -> np.ndarray:
        """Occurrences of each context of a range; the begin comes after the words."""
        own = np.asarray(arrays.get_raw("counts", np.uint64)[edges[part] : min(edges[part + 1], n_words)], np.float64)
        return np.append(own, texts) if edges[part + 1] == base else own

    def back_off(r):
        lost = sum(d2[i] * unpack(r[f"c{i + 1}"], np.uint32) for i in (1, 2, 3))
        return lost / np.maximum(context(r["part"]), 1)

    d1, d2 = np.array(d1), np.array(d2)
    # every word has a left context; the share that the discounts leave goes to all words alike
    uniform = float(d1[1] * of[0] + d1[2] * of[1] + d1[3] * (n_words - of[0] - of[1])) / types / (n_words + 1)

    def left(r):
        c = unpack(r["c1"], np.uint32)
        return (c - d1[np.minimum(c, 3)]) / types + uniform

    _fill(by_word, arrays, {"back": (np.float32, back_off), "unigram": (np.float64, left)})

    def probability(r):
        k, c = unpack_sorted(r["keys"]), unpack(r["counts"], np.uint32)
        at = (k // np.uint64(base)).astype(np.int64)
        total = np.where(at == n_words, texts, arrays.get_raw("counts", np.uint64)[np.minimum(at, n_words - 1)]).astype(np.float64)
        return (c - d2[np.minimum(c, 3)]) / total

    _fill(big, arrays, {"pairs": (np.uint64, lambda r: unpack_sorted(r["keys"])), "pair_p": (np.float32, probability)})
    forget(counted, by_word)
    return Model(arrays.publish(["back", "unigram", "pairs", "pair_p"]), tokens, n_words, uniform)


_ROW_DDL = "kind long, part long, keys binary, counts binary, size long, of array<long>"


def _row(kind, part, keys, counts, size, of):
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part]), pa.array([keys], pa.binary()), pa.array([counts], pa.binary()), pa.array([size]), pa.array([of], pa.list_(pa.int64()))], names=["kind", "part", "keys", "counts", "size", "of"])


def log_probs(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known, base_score and score (log10) of each text."""
    h, sizes = token_hashes(texts)
    start = np.cumsum(sizes) - sizes
    if not model.vocabulary:
        return sizes, np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
    n, base = model.vocabulary, model.vocabulary + 1
    ids = _ranks(model.array("words", np.uint64), h)
    known = ids >= 0
    at = np.maximum(ids, 0)
    c = np.where(known, model.array("counts", np.uint64)[at], 0)
    base_log = np.log10((c + 1.0) / (model.tokens + base))
    p = np.where(known, model.array("unigram", np.float64)[at], model.unknown)
    before = _before(ids, sizes, n)
    context = before >= 0
    p = np.where(context, model.array("back", np.float32)[np.maximum(before, 0)], 1.0) * p
    both = np.flatnonzero(known & context)
    keys = before[both].astype(np.uint64) * np.uint64(base) + ids[both].astype(np.uint64)
    where, hit = _find(model.array("pairs", np.uint64), keys)
    p[both[hit]] += model.array("pair_p", np.float32)[where[hit]]
    return sizes, np.add.reduceat(known.astype(np.int64), start), np.add.reduceat(base_log, start), np.add.reduceat(np.log10(p), start)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, base_score and score; perplexity is 10 ** (-score / n_tokens)."""
    docs = small_batches(rename_clashes(docs, ADDED))
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds))])

    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 1 << 21 or i == len(texts) - 1:
                    own = b.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, log_probs(model, texts[lo : i + 1]))], names=[*b.schema.names, *ADDED])
                    lo, size = i + 1, 0

    return docs.mapInArrow(run, schema)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    model = fit(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
