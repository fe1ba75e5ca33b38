"""License scan, quality rules, decontamination, line dedup, chat formatting."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundex.llm import chat, decontam, licenses, linededup, outliers, registry, stats
from tests.conftest import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    same(registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


# licenses


def _contained(text, name, g, containment=0.8):
    w = licenses.words_of(text or "")
    t = licenses.words_of(licenses.TEMPLATES[name])
    grams = lambda x: [tuple(x[i : i + g.size]) for i in range(len(x) - g.size + 1)]
    want, have = set(grams(t)), grams(w)
    best = max((len(want & set(have[a : a + g.window])) / len(want) for a in range(0, len(have), g.step)), default=0)
    return best if best >= containment else None


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "license", "work", "reserved", "software", "of", "permission"]) for _ in range(n))
    texts = [None, "", "license", filler(300)]
    for t in licenses.TEMPLATES.values():
        w = t.split()
        texts += [t, f"{filler(31)} {t} {filler(17)}", f"{filler(3)} {t.upper()}", filler(8) + "\n" + " ".join(w[:-1] + ["else"]), f"{t} {t}", " ".join(w[: len(w) // 2])]
    groups = licenses.classes(spark, licenses.TEMPLATES, 0.8, 1e-7, 100)
    want = {(i, name, round(c, 9)) for i, t in enumerate(texts) for g in groups for name, _ in g.members if (c := _contained(t, name, g))}
    got = licenses.scan_licenses(docs_of(spark, texts).withColumn("w", F.lit(1)).withColumn("license_id", F.lit("x")))
    assert {(r["doc_id"], r["license_id"], round(r["containment"], 9)) for r in got.collect()} == want
    assert len(want) > len(licenses.TEMPLATES) * 3


def test_licenses_edges(spark):
    assert licenses.scan_licenses(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert licenses.scan_licenses(docs_of(spark, ["All rights reserved."]), {}).count() == 0
    assert licenses.scan_licenses(docs_of(spark, ["All rights reserved."]), {"none": "...", "b": "all rights reserved", "a": "All Rights Reserved!"}).first()["license_id"] == "a"
    twice = licenses.scan_licenses(docs_of(spark, ["All rights reserved."] * 2, [7, 7]))
    assert [(r["doc_id"], r["first_word"]) for r in twice.collect()] == [(7, 0)]
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs_of(spark, ["x"]), max_templates=1)
    long = "word " * 30000 + "Released under the MIT License. " + "word " * 30000
    assert [r["license_id"] for r in licenses.scan_licenses(docs_of(spark, [long])).collect()] == ["mit"]


def test_license_plan_is_native(spark, sf):
    plan = registry.queries()["op1_license_scan"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# quality rules


def _counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += bool(line in seen and WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "Éa", "#x", "\n", " ", "\t", " ", "\x1c", "x|y", "\x0b", "\x85"]), max_size=40))
def test_counts(parts):
    text = " ".join(parts)
    assert stats.text_counts(text)[:5] == _counts(text)


def test_repeated_words_with_many_distinct():
    ids = np.array([*range(3_000_000), 0, 1, 2], np.int64)
    assert stats.repeated_words(ids, 3_000_000) == 6


def test_quality_rules(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        n = int(rng.integers(60, 400))
        words = ["w" * int(rng.integers(2, 9)) + str(rng.integers(0, 9)) for _ in range(n)]
        text = ". ".join(" ".join(words[j : j + 10]) for j in range(0, n, 10))
        if i % 31 == 0:
            text = " ".join(x + "$$$" for x in words)
        rows.append((i, text, None if i % 3 == 0 else "en", f"s{i % 2}" if i % 5 else None, 1))
    rows += [(1000, None, "en", "s0", 1), (1001, "", None, None, 1), (1002, "few words", "en", "s1", 1), (1003, "a b c " * 60, "en", "s1", 1), (1, rows[1][1], "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("g", F.lit(2))
    got = outliers.quality_rules(df).toPandas()
    assert len(got) == len(rows)
    bad = got[got.doc_id.isin(range(0, 900, 31))]
    assert not bad.kept.any()
    clean = got[(got.doc_id < 900) & (got.doc_id % 31 != 0)]
    assert clean.kept.mean() > 0.98
    edge = got[got.doc_id >= 1000].set_index("doc_id")
    assert edge.base_failed.all() and not edge.kept.any() and edge.distance.isna().all()
    want = {r[0]: _counts(r[1]) for r in rows}
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]


def test_quality_rules_empty(spark):
    assert outliers.quality_rules(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert [r["kept"] for r in outliers.quality_rules(docs_of(spark, ["x " * 100 + str(i) for i in range(2)])).collect()] == [False, False]


def test_mcd_finds_the_bulk(spark):
    rng = np.random.default_rng(5)
    p = outliers.P
    bulk = rng.normal(0, 2, (800, p)) + np.arange(p)
    far = rng.normal(60, 1, (180, p))
    data = [("a", *map(float, x)) for x in np.concatenate((bulk, far))] + [("b", *([1.0] * p))] * 50
    df = spark.createDataFrame(data, ["g", *(f"v{i}" for i in range(p))])
    params = {r["g"]: r for r in outliers.fit_mcd(df).collect()}
    assert np.abs(np.array(params["a"]["center"]) - np.arange(p)).max() < 0.6
    assert np.allclose(params["b"]["center"], 1.0)
    d = outliers._with_distance(df, outliers.fit_mcd(df)).where("g = 'a'").select("d2", "scale", "v0").toPandas()
    cut = outliers.chi2_quantile(0.9999, p)
    out = d.d2 / d.scale > cut
    assert out[d.v0 > 30].all() and out[d.v0 <= 30].mean() < 0.02


def plain_mcd(x, share=0.75, starts=20, seed=1):
    """Fast-MCD in numpy: concentration from random subsets, the least determinant, one reweighting; scaled distances."""
    rng, p = np.random.default_rng(seed), x.shape[1]
    floor = np.array([outliers.FLOOR.get(c, outliers.RATE_FLOOR) for c in outliers.VECTOR]) ** 2

    def estimate(rows):
        cov = np.cov(rows.T, bias=True)
        return rows.mean(0), cov + np.diag(np.maximum(floor - np.diag(cov), 0))

    def distances(m, c):
        return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)

    best = None
    for _ in range(starts):
        m, c = estimate(x[rng.choice(len(x), p + 30, replace=False)])
        for _ in range(12):
            d = distances(m, c)
            m, c = estimate(x[d <= np.quantile(d, share)])
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    d = distances(*best[1:])
    m, c = estimate(x[d <= np.median(d) * outliers.chi2_quantile(0.975, p) / outliers.chi2_quantile(0.5, p)])
    d = distances(m, c)
    return m, d * outliers.chi2_quantile(0.5, p) / np.median(d)


def test_verdicts_equal_plain_mcd(spark):
    """A group with a fifth of contamination, and a few rows of a second group that follow the language's estimate."""
    rng = np.random.default_rng(8)
    p = outliers.P
    mix = rng.normal(0, 1, (p, p)) * 0.5 + np.eye(p)
    x = np.concatenate((rng.normal(0, 1, (1600, p)) @ mix, rng.normal(9, 1, (400, p)) @ mix))
    few = np.stack((np.zeros(p), 30 * np.ones(p)))
    names = [f"v{i}" for i in range(p)]
    rows = [("a", "en", *map(float, r)) for r in x] + [("b", "en", *map(float, r)) for r in few]
    df = spark.createDataFrame(rows, ["g", "l", *names])
    params = outliers.fit_mcd(df, outliers.fit_mcd(df.withColumn("g", F.col("l"))))
    got = outliers._with_distance(df, params).select("g", *names, (F.col("d2") / F.col("scale")).alias("d")).toPandas()
    a = got[got.g == "a"]
    center, want = plain_mcd(a[names].to_numpy())
    cut = outliers.chi2_quantile(0.999, p)
    assert ((a.d > cut).to_numpy() == (want > cut)).mean() > 0.995 and (want[-1] > cut) == (a.d.iloc[-1] > cut)
    assert np.corrcoef(np.log(a.d), np.log(want))[0, 1] > 0.99
    found = np.array({r["g"]: r["center"] for r in params.collect()}["a"])
    assert np.abs(found - center).max() < 0.15
    b = got[got.g == "b"].sort_values("v0")
    assert b.d.tolist()[0] < cut < b.d.tolist()[1]


# decontamination


def _brute(text, items, size=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    w = norm(text)
    hit, ids = set(), set()
    for item, t in items:
        v = norm(t)
        for x in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} if v and item is not None else ():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    ids.add(item)
    return len(w), sorted(hit), sorted(ids)


def test_decontamination(spark):
    rng = random.Random(6)
    vocab = ["Ünder", "a", "b", "c1", "the"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(1, "A b! c1 the Ünder a b c1 the a b a"), (2, "short item the"), (2, "a a a a"), (3, None), (4, "..."), (None, "b b"), (5, text(14))]
    texts = [None, "", "...", text(50), "x " + items[0][1] + " y " + items[6][1].upper(), "SHORT item, the? short item the short ITEM the", text(400), "a, a; A a a", "b b"]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, texts).withColumn("n_hit", F.lit("clash")).withColumn("_items", F.lit("clash"))
    got = decontam.find_benchmark(df, b, max_windows=10).orderBy("doc_id").collect()  # the windows that there are
    for r, t in zip(got, texts):
        n, hit, ids = _brute(t, items)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, len(hit), ids)
        places = [m.span() for m in decontam.WORD.finditer(t or "")]
        assert sorted(i for i, (s, e) in enumerate(places) if any(x["start"] <= s and e <= x["end"] for x in r["hit_spans"])) == hit
    with pytest.raises(ValueError):
        decontam.find_benchmark(df, b, max_windows=9)
    kept = {r["doc_id"] for r in decontam.remove_contaminated(docs_of(spark, texts), b).collect()}
    assert kept == {i for i, t in enumerate(texts) if not _brute(t, items)[1]}


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontam.find_benchmark(docs_of(spark, ["a b"]), none).collect()] == [0]
    assert decontam.find_benchmark(docs_of(spark, ["a"]).limit(0), none).count() == 0
    twice = decontam.find_benchmark(docs_of(spark, ["q w", "q w"], [3, 3]), spark.createDataFrame([("x", "Q W")], "item_id string, text string"))
    assert [r["item_ids"] for r in twice.collect()] == [["x"], ["x"]]


# line dedup


def _dedup(rows, min_chars, min_docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(ASCII_LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    rep = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or key(x) not in rep or rep[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = ["Line %d with ÄÖ words" % i for i in range(30)] + ["", " ", "short"]
    rows = [(i, "\n".join(rng.choice([x, " " + x.upper() + "\t", x]) for x in rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(60)]
    rows += [(None, pool[0]), (None, pool[0]), (7, pool[1]), (99, None), (100, ""), (59, "\n".join(pool)), (59, "\n".join(pool))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("clash")).withColumn("drop", F.lit(1)).withColumn("source", F.lit("s"))
    for min_chars, min_docs, bits in ((10, 5, 28), (10, 2, 18), (20, 3, 18)):
        for most in (0, 32 << 20):  # by a join, and by broadcast lines
            got = linededup.dedup_lines(df, min_chars, min_docs, bits, most)
            assert "source" in got.columns
            assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == _dedup(rows, min_chars, min_docs)


def test_line_dedup_empty_and_long(spark):
    assert linededup.dedup_lines(docs_of(spark, ["x"]).limit(0)).count() == 0
    long = "y" * 300_000
    got = linededup.dedup_lines(docs_of(spark, [long] * 6)).orderBy("doc_id").collect()
    assert [len(r["text"]) for r in got] == [0] * 5 + [300_000]


def test_full_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SLICE_BITS", 4)
    rows = [(i, "\n".join(f"the line {j} of a kind that is long" for j in range(i, i + 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.dedup_lines(df, 10, 3, max_log2_bits=4)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == _dedup(rows, 10, 3)


# chat formatting

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", " ", "é", "日本", "text", "\n", "</", "😀"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "</s>"]), TEXT), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [(r, chat.unescape(formatted[a:b])) for r, a, b in spans] == turns


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b </s> [/INST]"), (1, 0, "user", "a"), (1, 2, "assistant", ""), (1, 3, "tool", "t\\[INST]"), (1, 4, "assistant", "日本語 😀 é"),
        (2, 0, None, None), (2, 0, None, None), (2, None, "user", "first"), (None, 0, "user", "x"), (3, 5, "assistant", "only\\"), (4, 0, "user", "w " * 50_000), (4, 1, "assistant", "z" * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_conversations(df)
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    full = {r["conv_id"]: r for r in out.collect()}
    digests = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert set(full) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        assert chat.parse(full[c]["formatted"]) == turns
        learned = "".join(x for r, x in turns if r == "assistant")
        d = digests[c]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (d["n_turns"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"], d["formatted_chars"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learned), sha(learned), len(full[c]["formatted"]))
        row = full[c]
        spans = [(s["start"], s["end"]) for s in row["turn_spans"] if s["role"] == "assistant"]
        mask = [any(max(a, s) < min(b, e) for a, b in spans) for s, e in zip(row["token_starts"], row["token_ends"])]
        assert mask == row["loss_mask"] and len(row["token_ids"]) == len(mask)
    assert chat.format_conversations(df.limit(0)).count() == 0
