"""Language ID with interpolated Kneser-Ney character models.

Texts become lower-case letters with single blanks between words. Spark counts the top-order character grams of each
language over all training texts (per-partition sums, then a shuffle by gram), and continuation counts, discounts and
contexts from them; no gram is dropped. The driver streams them by ranges of the hash into mapped files: per order, one
sorted hash array of the grams of all languages beside a matrix of their interpolated log probabilities. Workers map
those arrays and find every position's longest known gram by binary search. The language with the lowest cross-entropy per character wins.

Rejection is calibrated on all distinct training texts of each language: a document is rejected if its cross-entropy
lies further above its language's than that of nearly all of them, given its length. Medians and quantiles are exact;
Spark narrows down their ranges by counts, so that no list of texts or scores reaches the driver. Languages predicted
for fewer than 30 texts share one calibration (that of all languages if they have fewer than 30 together); only without
30 distinct texts in all is there no limit. calibrate_rows is for callers who want fewer: about so many texts of each
language, chosen by a hash of the text. No query sets it.

Defined cases: null text, and text without letters, is `und`, score 0, rejected; without any training text every
document is `und`; rows with null language or text aren't learned from; a null id counts as not held out; equal
cross-entropies go to the first language in order; rows that repeat count each time; extra columns pass through, and
columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundex.llm.common import Arrays, crc_mod, forget, keep, rename_clashes, small_batches

ORDER = 4
_P = np.uint64(0x9E3779B97F4A7C15)
BLANK = 32
BLOCK = 1 << 20
BINS = 1024
ADDED = ["lang_pred", "score", "cross_entropy", "rejected"]


class _Letters:
    table: np.ndarray | None = None


def _letters() -> np.ndarray:
    if _Letters.table is None:
        t = np.zeros(0x110000, bool)
        t[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
        _Letters.table = t
    return _Letters.table


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 blanks that aren't scored, and the text's index (-1: not scored)."""
    pad = "\x00" * (ORDER - 1)
    joined = pad + pad.join(t.lower().replace("\x00", " ") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    end = raw == 0
    keep_ = letter | end
    keep_[1:] |= letter[:-1]
    doc = np.cumsum(end, dtype=np.int64) // (ORDER - 1) - 1
    doc[end] = -1
    codes = np.where(letter, raw, np.uint32(BLANK))
    return codes[keep_].astype(np.uint64), doc[keep_]


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Of the gram that ends at each position (valid from position order - 1 on)."""
    h = codes.copy()
    for i in range(1, order):
        h[i:] += codes[: len(codes) - i] * (_P ** np.uint64(i) if i < 2 else np.uint64(pow(int(_P), i, 1 << 64)))
    return h


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """Of rows of code points."""
    g = grams.astype(np.uint64)
    h = np.zeros(len(g), np.uint64)
    for i in range(g.shape[1]):
        h += g[:, g.shape[1] - 1 - i] * np.uint64(pow(int(_P), i, 1 << 64))
    return h


def _chunks(texts, size: int = BLOCK):
    """Index lists of texts with about size characters."""
    at, total = [], 0
    for i, t in enumerate(texts):
        at.append(i)
        total += len(t)
        if total >= size:
            yield at
            at, total = [], 0
    if at:
        yield at


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram (a string of ORDER characters), n over all rows of (lang, text)."""

    def run(batches):
        seen: dict[str, list] = {}

        def squeeze(lang):
            h = np.concatenate([x[0] for x in seen[lang]])
            g = np.concatenate([x[1] for x in seen[lang]])
            n = np.concatenate([x[2] for x in seen[lang]])
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            seen[lang] = [(h[first], g[first], np.bincount(back, n).astype(np.int64))]

        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            texts = b["text"].to_pylist()
            for lang in dict.fromkeys(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for at in _chunks(own):
                    codes, doc = encode([own[i] for i in at])
                    h = hashes(codes, ORDER)
                    pos = np.flatnonzero(doc >= 0)
                    if not len(pos):
                        continue
                    order = np.argsort(h[pos], kind="stable")
                    s = h[pos][order]
                    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    n = np.diff(np.concatenate((first, [len(s)])))
                    where = pos[order[first]]
                    seen.setdefault(lang, []).append((s[first], np.stack([codes[where - i] for i in range(ORDER - 1, -1, -1)], 1).astype(np.uint32), n))
                    if len(seen[lang]) > 16:
                        squeeze(lang)
        for lang in seen:
            squeeze(lang)
            _, g, n = seen[lang][0]
            text = g.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages, the arrays' place, and what rejection needs; small enough for closures."""

    def __init__(self, langs: list[str], arrays: Arrays | None, calibration: dict | None = None):
        self.langs, self.arrays, self.calibration = langs, arrays, calibration or {}

    def tables(self):
        if not hasattr(self, "_t"):
            t = {"unknown": np.asarray(self.arrays.get("unknown"))}
            for m in range(1, ORDER + 1):
                for h, v in ((f"h{m}", f"p{m}"), (f"ch{m}", f"cb{m}"))[: 2 if m > 1 else 1]:
                    t[h], t[v] = np.asarray(self.arrays.get_raw(h, np.uint64)), np.asarray(self.arrays.get_raw(v, np.float32)).reshape(-1, len(self.langs))
            self._t = t
        return self._t

    def __getstate__(self):
        return {"langs": self.langs, "arrays": self.arrays, "calibration": self.calibration}


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
    return at, (table[at] == h if len(table) else np.zeros(len(h), bool))


def kneser_ney(langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays, from each language's top-order grams (rows of code points) and counts."""
    counts: dict[tuple, tuple] = {}
    for lang in langs:
        g, n = grams[lang]
        for m in range(ORDER, 0, -1):
            h = gram_hashes(g)
            order = np.argsort(h)
            counts[lang, m] = (h[order], g[order], n[order])
            if m > 1:
                s = g[:, 1:]
                _, first, back = np.unique(gram_hashes(s), return_index=True, return_inverse=True)
                g, n = s[first], np.bincount(back).astype(np.int64)
    out: dict[str, np.ndarray] = {}
    alphabet = len({*np.concatenate([counts[x, 1][0] for x in langs]).tolist()}) + 1
    below = None
    for m in range(1, ORDER + 1):
        every = np.concatenate([counts[x, m][1] for x in langs])
        h, first = np.unique(np.concatenate([counts[x, m][0] for x in langs]), return_index=True)
        g = every[first]
        suffix = _find(out[f"h{m - 1}"], gram_hashes(g[:, 1:]))[0] if m > 1 else None
        contexts = np.unique(gram_hashes(g[:, :-1])) if m > 1 else np.zeros(1, np.uint64)
        own = gram_hashes(g[:, :-1]) if m > 1 else np.zeros(len(g), np.uint64)
        p, back = np.zeros((len(h), len(langs))), np.ones((len(contexts), len(langs)))
        for i, lang in enumerate(langs):
            hh, gg, n = counts[lang, m]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1), 0.9)
            at = np.searchsorted(contexts, gram_hashes(gg[:, :-1])) if m > 1 else np.zeros(len(gg), np.int64)
            total, types = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            known = total > 0
            back[known, i] = d * types[known] / total[known]
            c = np.zeros(len(h))
            c[np.searchsorted(h, hh)] = np.maximum(n - d, 0)
            ctx = np.searchsorted(contexts, own)
            lower = below[suffix, i] if m > 1 else 1 / alphabet
            p[:, i] = c / np.maximum(total[ctx], 1) + back[ctx, i] * lower
        out[f"h{m}"], out[f"p{m}"] = h, np.log(p).astype(np.float32)
        if m > 1:
            out[f"ch{m}"], out[f"cb{m}"] = contexts, np.log(back).astype(np.float32)
        else:
            out["unknown"] = np.log(back[0] / alphabet).astype(np.float32)
        below = p
    return out


_PACKED = "part long, size long, h binary, g binary, lang binary, n binary, types binary"


def _packed(rows: DataFrame, langs: list[str], m: int, shuffle: int) -> DataFrame:
    """Rows (lang, gram of m characters, n, types) packed by range of the gram's hash, in its order."""
    rows = keep(rows, "grams")
    parts = max(shuffle, rows.count() * len(langs) // 4_000_000 + 1)
    cuts = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
    number = {x: i for i, x in enumerate(langs)}

    def points(grams):
        return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, m)

    def mark(batches):
        for b in batches:
            if b.num_rows:
                part = np.searchsorted(cuts, gram_hashes(points(b["gram"].to_pylist())), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part), *(b[x] for x in ("lang", "gram", "n", "types"))], names=["part", "lang", "gram", "n", "types"])

    def pack(batches):
        seen = []
        for b in batches:
            if b.num_rows:
                g = points(b["gram"].to_pylist())
                seen.append((b["part"].to_numpy(), gram_hashes(g), g, np.array([number[x] for x in b["lang"].to_pylist()], np.int32), b["n"].to_numpy(), b["types"].to_numpy()))
        if not seen:
            return
        part, h, g, lang, n, types = (np.concatenate(x) for x in zip(*seen))
        for i in np.unique(part):
            at = np.flatnonzero(part == i)
            at = at[np.argsort(h[at], kind="stable")]
            size = len(np.unique(h[at]))
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([size]), *(pa.array([x[at].tobytes()], pa.binary()) for x in (h, g, lang, n, types))], names=["part", "size", "h", "g", "lang", "n", "types"])

    marked = rows.select("lang", "gram", "n", "types").mapInArrow(mark, "part long, lang string, gram string, n long, types long")
    out = keep(marked.repartition(parts, "part").mapInArrow(pack, _PACKED), "packed")
    forget(rows)
    return out


def _stream(packed: DataFrame, m: int):
    """By range: the place of its first gram, distinct hashes, their grams, and each row's index among them, language, n, types."""
    sizes = {r["part"]: r["size"] for r in packed.select("part", "size").collect()}
    start, at = {}, 0
    for i in sorted(sizes):
        start[i] = at
        at += sizes[i]

    def ranges():
        for r in packed.toLocalIterator():
            h, first, back = np.unique(np.frombuffer(r["h"], np.uint64), return_index=True, return_inverse=True)
            yield start[r["part"]], h, np.frombuffer(r["g"], np.uint32).reshape(-1, m)[first], back, np.frombuffer(r["lang"], np.int32), np.frombuffer(r["n"], np.int64), np.frombuffer(r["types"], np.int64)

    return at, ranges()


def build(counts: DataFrame, langs: list[str]) -> Arrays:
    """The arrays of kneser_ney(), from a kept table (lang, gram, n), without gathering it."""
    spark, k = counts.sparkSession, len(langs)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrays, tables = Arrays(spark, "charlm"), {ORDER: counts}
    for m in range(ORDER, 1, -1):
        tables[m - 1] = keep(tables[m].groupBy("lang", F.substring("gram", 2, m - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    below, scratch = None, []
    for m in range(1, ORDER + 1):
        ones = {r["lang"]: r for r in tables[m].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.sum("n").alias("total"), F.count("*").alias("types")).collect()}
        n1, n2, total, types = (np.array([ones[x][c] for x in langs], float) for c in ("n1", "n2", "total", "types"))
        d = np.clip(np.where(n1 + n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5), 0.1, 0.9)
        if m > 1:
            packed = _packed(tables[m].groupBy("lang", F.substring("gram", 1, m - 1).alias("gram")).agg(F.sum("n").alias("n"), F.count("*").alias("types")), langs, m - 1, shuffle)
            size, ranges = _stream(packed, m - 1)
            contexts, logs = arrays.create_raw(f"ch{m}", np.uint64, size), arrays.create_raw(f"cb{m}", np.float32, size * k).reshape(-1, k)
            totals, backs = (arrays.create_raw(f"{x}{m}", np.float64, size * k).reshape(-1, k) for x in "tb")
            scratch += [f"t{m}", f"b{m}"]
            for at, h, _, row, lang, n, t in ranges:
                own, back = np.zeros((len(h), k)), np.ones((len(h), k))
                own[row, lang], back[row, lang] = n, d[lang] * t / n
                to = slice(at, at + len(h))
                contexts[to], totals[to], backs[to], logs[to] = h, own, back, np.log(back)
            forget(packed)
        packed = _packed(tables[m].withColumn("types", F.lit(0).cast("long")), langs, m, shuffle)
        size, ranges = _stream(packed, m)
        found, logs = arrays.create_raw(f"h{m}", np.uint64, size), arrays.create_raw(f"p{m}", np.float32, size * k).reshape(-1, k)
        probabilities = arrays.create_raw(f"q{m}", np.float64, size * k).reshape(-1, k)
        scratch.append(f"q{m}")
        if m == 1:
            first = d * types / total / (size + 1)
            arrays.put("unknown", np.log(first).astype(np.float32))
        for at, h, g, row, lang, n, _ in ranges:
            p = np.zeros((len(h), k))
            p[row, lang] = np.maximum(n - d[lang], 0)
            if m == 1:
                p = p / total + first
            else:
                c = np.searchsorted(contexts, gram_hashes(g[:, :-1]))
                p = p / np.maximum(totals[c], 1) + backs[c] * below[1][np.searchsorted(below[0], gram_hashes(g[:, 1:]))]
            to = slice(at, at + len(h))
            found[to], probabilities[to], logs[to] = h, p, np.log(p)
        below = found, probabilities
        forget(packed, tables[m])
        for x in (found, logs, *((contexts, logs) if m > 1 else ())):
            getattr(x, "flush", lambda: None)()
    arrays.discard(scratch)
    return arrays.publish()


def log_probs(tables: dict[str, np.ndarray], codes: np.ndarray, doc: np.ndarray, texts: int, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities (texts x langs) and scored positions of each text."""
    total, n = np.zeros((texts, langs)), np.bincount(doc[doc >= 0], minlength=texts)
    grams = {m: hashes(codes, m) for m in range(1, ORDER + 1)}
    for lo in range(0, len(codes), BLOCK):
        pos = np.arange(lo, min(lo + BLOCK, len(codes)))
        pos = pos[doc[pos] >= 0]
        if not len(pos):
            continue
        score = np.zeros((len(pos), langs), np.float32)
        left = np.arange(len(pos))
        for m in range(ORDER, 0, -1):
            at, hit = _find(tables[f"h{m}"], grams[m][pos[left]])
            score[left[hit]] += tables[f"p{m}"][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if m > 1:
                at, known = _find(tables[f"ch{m}"], grams[m - 1][pos[left] - 1])
                score[left[known]] += tables[f"cb{m}"][at[known]]
            else:
                score[left] += tables["unknown"]
        owner = doc[pos]
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        total[owner[cut]] += np.add.reduceat(score, cut, axis=0, dtype=np.float64)
    return total, n


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    total, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for at in _chunks(texts):
        codes, doc = encode([texts[i] for i in at])
        total[at], n[at] = log_probs(model.tables(), codes, doc, len(at), len(model.langs))
    return -total / np.maximum(n, 1)[:, None], n


def _has_letters(n: np.ndarray) -> np.ndarray:
    return n > 0  # a blank is scored only after a letter


def fit(docs: DataFrame, calibrate_rows: int | None = None) -> Model:
    """From rows of (text, lang); rows where either is null are passed over. Rejection: from all of them, or about calibrate_rows a language."""
    train = small_batches(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text"))
    counts = keep(count_grams(train), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], None)
    model = Model(langs, build(counts, langs))
    model.calibration = _calibrate(train if calibrate_rows is None else _some(train, calibrate_rows), model)
    return model


def _some(train: DataFrame, rows: int) -> DataFrame:
    """About rows distinct texts of each language, by a hash of the text; all copies of a text or none."""
    part = F.lit(1).cast("long")
    for r in train.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect():
        if r["n"] >= 2 * rows:
            part = F.when(F.col("lang") == r["lang"], F.lit(r["n"] // rows).cast("long")).otherwise(part)
    return train.where(F.pmod(F.xxhash64("text"), part) == 0)


def _beside(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """rows joined with a few values by the first column of the schema."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(values, schema)), schema.split()[0])


def quantiles(rows: DataFrame, q: float) -> dict[int, float]:
    """Of all x (finite) in each group g: the exact quantile, between neighbours as numpy's.

    Counts of equal ranges between the least and the largest value tell in which one the wanted rank lies; that one is
    cut again until it holds a single value."""
    first = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    rank = {r["g"]: (r["n"] - 1) * q for r in first}
    below, range_ = {r["g"]: 0 for r in first}, {r["g"]: (r["lo"], r["hi"]) for r in first}
    while wide := [(g, lo, hi) for g, (lo, hi) in range_.items() if lo < hi]:
        cut = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("cut")
        inside = _beside(rows, wide, "g long, lo double, hi double").where("x between lo and hi")
        bins = inside.groupBy("g", cut).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        found = set()
        for r in sorted(bins, key=lambda r: (r["g"], r["cut"])):
            g = r["g"]
            if g in found:
                continue
            if below[g] + r["n"] > int(rank[g]):
                range_[g] = r["lo"], r["hi"]
                found.add(g)
            else:
                below[g] += r["n"]
    if not range_:
        return {}
    out, at = {}, _beside(rows, [(g, lo) for g, (lo, _) in range_.items()], "g long, v double")
    for r in at.groupBy("g", "v").agg(F.sum((F.col("x") <= F.col("v")).cast("long")).alias("upto"), F.min(F.when(F.col("x") > F.col("v"), F.col("x"))).alias("after")).collect():
        k = int(rank[r["g"]])
        after = r["v"] if k + 1 < r["upto"] or r["after"] is None else r["after"]
        out[r["g"]] = r["v"] + (rank[r["g"]] - k) * (after - r["v"])
    return out


def _calibrate(train: DataFrame, model: Model) -> dict:
    """Per language: mean cross-entropy, its variance between and within documents, and the largest usual deviation."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ce, size = cross_entropies(model, b["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["label"], b["digest"], pa.array(ce.argmin(1)), pa.array(ce.min(1)), pa.array(size)], names=["label", "digest", "lang", "ce", "n"])

    texts = train.select(F.col("lang").alias("label"), "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    scored = texts.mapInArrow(run, "label string, digest binary, lang long, ce double, n long").where("n > 0").dropDuplicates(["label", "digest"])
    scored = keep(scored.select("lang", "ce", "n"), "calibration")
    count = {r["lang"]: r["n"] for r in scored.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out = {}
    if sum(count.values()) >= 30:
        every = range(len(model.langs))
        own = [i for i in every if count.get(i, 0) >= 30]
        rest = [i for i in every if i not in set(own)]
        if sum(count.get(i, 0) for i in rest) < 30:
            pooled = list(every) if rest else []
        else:
            pooled = rest
        rows = _beside(scored, [*((i, i) for i in own), *((i, -1) for i in pooled)], "lang long, g long")
        mean = {r["g"]: r["mean"] for r in rows.groupBy("g").agg((F.sum(F.col("ce") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
        rows = _beside(rows, list(mean.items()), "g long, mean double").select("g", "n", (F.col("ce") - F.col("mean")).alias("r"))
        median = quantiles(rows.selectExpr("inline(array(struct(2 * g as g, abs(r) as x), struct(2 * g + 1 as g, r * r * n as x)))"), 0.5)
        spread = {g: (float(median[2 * g] * 1.4826) ** 2, median[2 * g + 1] / 0.455) for g in mean}
        z = _beside(rows, [(g, *s) for g, s in spread.items()], "g long, between double, within double")
        most = quantiles(z.selectExpr("g", "r / sqrt(greatest(between + within / n, 1e-9D)) as x"), 0.999)
        for i in every:
            g = i if i in mean else -1
            out[i] = (mean[g], *spread[g], max(8.0, 1.5 * most[g]))
    forget(scored)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected."""
    docs = small_batches(rename_clashes(docs, ADDED))
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts = [t or "" for t in b["text"].to_pylist()]
            if not model.langs:
                none = len(texts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["und"] * none), pa.array([0.0] * none), pa.array([None] * none, pa.float64()), pa.array([True] * none)], names=[*b.schema.names, *ADDED])
                continue
            ce, n = cross_entropies(model, texts)
            best, known = ce.argmin(1), _has_letters(n)
            low = ce.min(1)
            gap = np.exp(-(ce - low[:, None]) * np.minimum(n, 50)[:, None])
            score = np.where(known, 1 / gap.sum(1), 0.0)
            mean, between, within, most = np.array([model.calibration.get(i, (0.0, 0.0, 0.0, np.inf)) for i in range(len(model.langs))]).T
            far = np.zeros(len(n), bool)
            some = known & np.isfinite(most[best])
            k = best[some]
            far[some] = (low[some] - mean[k]) > most[k] * np.sqrt(np.maximum(between[k] + within[k] / n[some], 1e-9))
            pred = [model.langs[i] if ok else "und" for i, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score), pa.array(np.where(known, low, np.nan), mask=~known), pa.array(far | ~known)], names=[*b.schema.names, *ADDED])

    return docs.mapInArrow(run, schema)


def held_out(m: int, rest: int) -> Column:
    return F.coalesce(crc_mod("doc_id", m) == rest, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """All rows of docs after learning from those that aren't held out (crc32 of the id mod 4 isn't 2)."""
    return identify(docs, fit(docs.where(~held_out(4, 2))))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
