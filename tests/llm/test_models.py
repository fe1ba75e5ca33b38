"""Language ID, word model, rule ensemble, mixing, near-dedup, components, shared arrays."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abundex.llm import common, components, langid, mixing, neardup, rules, wordlm
from abundex.llm.stats import COUNTS, VECTOR, text_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


# shared arrays


@pytest.mark.parametrize("ship", [False, True])
def test_arrays_reach_workers(spark, ship):
    a = common.Arrays(spark, "test", add_file=ship)
    a.put("x", np.arange(5))
    f = a.create_raw("y", np.float32, 3)
    f[:] = [1, 2, 3]
    f.flush()
    a.publish()
    got = spark.range(4, numPartitions=2).mapInPandas(lambda it: (pd.DataFrame({"s": [float(a.get("x").sum() + a.get_raw("y", np.float32).sum())] * len(b)}) for b in it), "s double").collect()
    assert [r["s"] for r in got] == [16.0] * 4


# language ID


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(0)
    grams = {}
    for lang in "ab":
        g = np.unique(rng.integers(97, 103, (200, langid.ORDER)), axis=0).astype(np.uint32)
        grams[lang] = (g, rng.integers(1, 5, len(g)))
    t = langid.kneser_ney(["a", "b"], grams)
    alphabet = sorted({*grams["a"][0].ravel().tolist(), *grams["b"][0].ravel().tolist()})
    last = {c for x in grams.values() for c in x[0][:, -1].tolist()}
    for context in ([97, 98, 99], [102, 102, 102], [97, 97, 97]):
        total = np.zeros(2)
        for c in [*alphabet, 50]:
            codes = np.array([*context, c], np.uint64)
            doc = np.array([-1, -1, -1, 0], np.int32)
            total += np.exp(langid.log_probs(t, codes, doc, 1, 2)[0][0])
        assert np.allclose(total, 1, atol=1e-4), (total, last)


def test_scores_dont_depend_on_neighbours():
    texts = ["Hello wörld", "", "a", "12 34", "x" * 50, "The End."]
    grams = {}
    codes, doc = langid.encode(["hello world the end", "wörld"])
    h = langid.hashes(codes, langid.ORDER)
    pos = np.flatnonzero(doc >= 0)
    g = np.stack([codes[pos - i] for i in range(langid.ORDER - 1, -1, -1)], 1).astype(np.uint32)
    assert (langid.gram_hashes(g) == h[pos]).all()
    u, n = np.unique(g, axis=0, return_counts=True)
    t = langid.kneser_ney(["x"], {"x": (u, n)})
    alone = []
    for x in texts:
        codes, doc = langid.encode([x])
        alone.append(langid.log_probs(t, codes, doc, 1, 1))
    codes, doc = langid.encode(texts)
    total, size = langid.log_probs(t, codes, doc, len(texts), 1)
    assert np.allclose(total[:, 0], [a[0][0, 0] for a in alone]) and size.tolist() == [int(a[1][0]) for a in alone]
    assert size.tolist()[1] == 0 and size.tolist()[3] == 0


def test_language_id_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.op5_language_id(spark, sf).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(out) == docs.count()
    assert (out.held_out == [held(i, 4, 2) for i in out.doc_id]).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all() and out.rejected.mean() < 0.05


def test_language_id_edges(spark):
    rows = [(i, "the cat and the dog went home " * 3, "en", "s", 1) for i in range(40)] + [(i, "der hund und die katze gehen heim " * 3, "de", "s", 1) for i in range(40, 80)]
    rows += [(90, None, "en", "s", 1), (91, "", None, None, 1), (92, "123 !?", "en", "s", 1), (93, "die katze", None, "s", 1), (None, "the dog", "en", "s", 1), (94, "the " * 100_000, "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("gram", F.lit(1))
    out = langid.predict(df).toPandas()
    assert len(out) == len(rows)
    by = out.set_index("doc_id").lang_pred
    assert (by[90], by[91], by[92], by[93], by[94]) == ("und", "und", "und", "de", "en")
    assert (out[out.lang_pred == "und"].score == 0).all() and out[out.lang_pred == "und"].rejected.all()
    assert set(langid.predict(df.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
    assert langid.predict(df.limit(0)).count() == 0


def test_all_grams_are_kept(spark):
    rng = np.random.default_rng(5)
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    df = spark.createDataFrame([("zh", han(3000)) for _ in range(180)] + [("en", "the cat went home and the dog ran"), ("de", "der hund ging heim")], "lang string, text string")
    rows = langid.count_grams(df).toArrow().to_pydict()
    which, n = np.array(rows["lang"], object), np.array(rows["n"])
    g = np.array([[ord(c) for c in x] for x in rows["gram"]], np.uint32)
    langs = ["de", "en", "zh"]
    assert (which == "zh").sum() > 500_000
    want = langid.kneser_ney(langs, {x: (g[which == x], n[which == x]) for x in langs})
    got = langid.fit(df).tables()
    assert set(got) == set(want)
    for name, a in want.items():
        assert np.allclose(got[name], a, atol=1e-5) if a.dtype == np.float32 else (got[name] == a).all(), name


def test_rare_languages_can_reject(spark):
    rng = random.Random(6)
    say = lambda words, n: [" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)]
    en, de = "the cat dog went home and ran away from house".split(), "der hund und katze ging heim weg vom haus".split()
    rows = [("en", t) for t in say(en, 2000)] + [("en", "the cat " * 5)] * 3000 + [("de", t) for t in say(de, 40)] + [("fi", "kissa meni kotiin")] * 3
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), calibrate_rows=100)
    assert sorted(model.calibration) == [0, 1, 2]
    out = langid.identify(spark.createDataFrame([(1, " ".join(de)), (2, "qzx jkv wqp zzk xqj " * 20)], "doc_id long, text string"), model).toPandas().set_index("doc_id")
    assert not out.rejected[1] and out.rejected[2]


def test_quantiles_equal_numpys(spark):
    rng = np.random.default_rng(7)
    groups = {0: rng.normal(size=5000), 1: np.repeat([3.0, 1.0, 1e300], [700, 299, 1]), 2: np.array([-2.5]), 3: rng.exponential(size=1001) ** 9, 4: np.zeros(40), 5: np.array([1.0, np.nextafter(1, 2)])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g long, x double")
    for q in (0.0, 0.5, 0.999, 1.0):
        got = langid.quantiles(df, q)
        assert sorted(got) == sorted(groups)
        for g, v in groups.items():
            assert got[g] == pytest.approx(np.quantile(v, q), rel=1e-12), (g, q)
    assert langid.quantiles(df.limit(0), 0.5) == {}


def many_texts(spark, n=18_000):
    """(en, text) of n distinct texts, and 40 odd ones that a sample of every other text by its hash passes over."""
    rng = random.Random(8)
    words = "the cat dog went home and ran away from house".split()
    texts = [f"{' '.join(rng.choice(words) for _ in range(7))} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n)]
    odd = spark.createDataFrame([("".join(rng.choice("qzxjkvwp") for _ in range(60)),) for _ in range(200)], "text string")
    return texts, [r["text"] for r in odd.where(F.pmod(F.xxhash64("text"), F.lit(2)) == 1).limit(40).collect()]


def plain_calibration(ce, n):
    """Mean, variance between and within, and limit of one language."""
    mean = np.average(ce, weights=n)
    r = ce - mean
    between, within = (np.median(np.abs(r)) * 1.4826) ** 2, np.median(r * r * n) / 0.455
    return mean, between, within, max(8.0, 1.5 * np.quantile(r / np.sqrt(np.maximum(between + within / n, 1e-9)), 0.999))


def test_rejection_is_calibrated_on_all_texts(spark):
    """Distinct texts of each label beyond any sample, copies once; languages of few texts share a calibration."""
    texts, odd = many_texts(spark)
    rows = [("en", t) for t in [*texts, *odd, *texts[:500]]] + [("de", "der hund ging heim " + "weg " * i) for i in range(20)] + [("fi", "kissa meni kotiin " + "pois " * i) for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(8))
    ce, n = langid.cross_entropies(model, [t for _, t in dict.fromkeys(rows)])
    best, ce = ce.argmin(1), ce.min(1)
    few = best != model.langs.index("en")
    assert few.sum() == 40
    for i, lang in enumerate(model.langs):
        own = ~few if lang == "en" else few
        assert model.calibration[i] == pytest.approx(plain_calibration(ce[own], n[own]), rel=1e-6)
    out = langid.identify(spark.createDataFrame([(t,) for t in odd], "text string"), model)
    assert out.where("rejected").count() == 0


def plain_characters(text):
    """Lower-case letters, and one blank for what follows a letter and is none."""
    out, after = [], False
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif after:
            out.append(" ")
        after = c.isalpha()
    return "".join(out)


def plain_char_model(texts):
    """p(context, character) of one language; alphabet is set later."""
    n = langid.ORDER
    counts = {n: Counter()}
    for t in texts:
        t = " " * (n - 1) + plain_characters(t)
        counts[n].update(t[i - n + 1 : i + 1] for i in range(n - 1, len(t)))
    for m in range(n - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    d, total, types = {}, {}, {}
    for m, c in counts.items():
        n1, n2 = (sum(x == i for x in c.values()) for i in (1, 2))
        d[m] = min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1), 0.9)
        total[m], types[m] = Counter(), Counter()
        for g, x in c.items():
            total[m][g[:-1]] += x
            types[m][g[:-1]] += 1

    def p(gram, alphabet):
        if not gram:
            return 1 / alphabet
        m, low = len(gram), p(gram[1:], alphabet)
        c = gram[:-1]
        if not total[m][c]:
            return low
        return max(counts[m][gram] - d[m], 0) / total[m][c] + d[m] * types[m][c] / total[m][c] * low

    return p, {g for g in counts[1]}


def test_language_id_equals_plain_kneser_ney(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).toPandas()
    docs["text"] = docs.text.str[:400]
    docs.loc[3, "text"], docs.loc[5, "lang"] = None, None
    df = spark.createDataFrame(docs[["doc_id", "text", "lang"]].astype(object).where(docs[["doc_id", "text", "lang"]].notna(), None))
    train = docs[[not held(i, 4, 2) for i in docs.doc_id]].dropna(subset=["text", "lang"])
    models = {x: plain_char_model(train[train.lang == x].text) for x in sorted(train.lang.unique())}
    alphabet = len(set().union(*(a for _, a in models.values()))) + 1
    out = langid.predict(df).toPandas().set_index("doc_id")
    n = langid.ORDER
    for i, text in zip(docs.doc_id, docs.text):
        t = plain_characters(text or "")
        if not t:
            assert out.lang_pred[i] == "und"
            continue
        padded = " " * (n - 1) + t
        ce = {x: -sum(math.log(p(padded[j : j + n], alphabet)) for j in range(len(t))) / len(t) for x, (p, _) in models.items()}
        best = min(ce, key=ce.get)
        assert out.cross_entropy[i] == pytest.approx(ce[best], rel=1e-4)
        assert out.lang_pred[i] == best


# word model


def plain_model(texts):
    c, big, ctx = Counter(), Counter(), Counter()
    tok = [wordlm_tokens(t) for t in texts]
    for t in tok:
        c.update(t)
        p = None
        for w in t:
            big[p, w] += 1
            ctx[p] += 1
            p = w
    number = lambda v: [Counter(v)[i] for i in (1, 2, 3, 4)]
    cont = Counter(w for _, w in big)
    d2, d1 = wordlm.discounts(number(big.values())), wordlm.discounts(number(cont.values()))
    g0 = sum(d1[min(x, 3)] for x in cont.values()) / len(big) / (len(c) + 1)
    lost = defaultdict(float)
    for (p, _), n in big.items():
        lost[p] += d2[min(n, 3)]
    uni = lambda w: ((cont[w] - d1[min(cont[w], 3)]) / len(big) if w in cont else 0) + g0

    def p(prev, w):
        if prev not in ctx:
            return uni(w)
        n = big.get((prev, w), 0)
        return (n - d2[min(n, 3)]) / ctx[prev] + lost[prev] / ctx[prev] * uni(w)

    return c, p


def wordlm_tokens(t):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)), "\n"]


def test_word_model_equals_plain_one(spark, sf):
    out = wordlm.op6_lm_scoring(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    c, p = plain_model([t for i, t in zip(docs.doc_id, docs.text) if not held(i, 7, 2)])
    n, v = sum(c.values()), len(c)
    for i, t in zip(docs.doc_id, docs.text):
        tok, r = wordlm_tokens(t), out.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(tok), sum(w in c for w in tok), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *tok], tok)), rel=1e-5)
    h = out[out.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_word_model_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a b A b"), (None, "a c"), (4, "new words"), (5, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("keys", F.lit(1))
    model = wordlm.fit(df.where("doc_id <> 4 or doc_id is null"), parts=3)
    monkeypatch.setattr(common.Arrays, "mounted", False)  # the driver writes the files
    again = wordlm.score(df, wordlm.fit(df.where("doc_id <> 4 or doc_id is null"))).select("score").collect()
    assert sorted(r["score"] for r in again) == sorted(r["score"] for r in wordlm.score(df, model).select("score").collect())
    out = {r["doc_id"]: r for r in wordlm.score(df, model).collect()}
    c, p = plain_model([None, "", "a b A b", "a c", "x " * 100_000])
    for i, t in rows:
        tok = wordlm_tokens(t)
        assert out[i]["n_tokens"] == len(tok)
        assert out[i]["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None, *tok], tok)), rel=1e-3)  # probabilities are stored in single precision
    empty = wordlm.fit(df.limit(0))
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in wordlm.score(df.where("doc_id = 3"), empty).collect()] == [(5, 0, 0.0)]
    assert wordlm.score(df.limit(0), model).count() == 0


def test_pair_cuts_are_even():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 50, 300).astype(np.uint64)
    counts[17], end = 5000, 40
    texts, base = int(counts[end]), 301
    context = np.append(counts, texts).astype(float)
    context[end] = 0
    targets = np.arange(1, 8) * (context.sum() / 8)
    cuts = [np.concatenate([wordlm._pair_cuts(context[lo : lo + step], lo, context[:lo].sum(), targets, base) for lo in range(0, 301, step)]) for step in (7, 100, 301)]
    assert all((c == cuts[0]).all() for c in cuts) and len(cuts[0]) == 7
    keys = np.arange(301 * 301)
    load = np.bincount(np.searchsorted(cuts[0], keys, "right"), context[keys // 301] / 301)
    assert load.max() < 1.05 * load.mean()


def test_packing():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (wordlm.unpack_sorted(wordlm.pack_sorted(a)) == a).all()
    assert len(wordlm.unpack(wordlm.pack(np.empty(0, np.uint64)), np.uint64)) == 0


# rule ensemble


def test_rules_learn_a_conjunction(spark):
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(VECTOR)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    b, found = rules.fit_rules(x[:3000], y[:3000])
    z = b + rules.rule_matrix(x, [r for r, _ in found]).astype(float) @ np.array([w for _, w in found])
    p = 1 / (1 + np.exp(-z))
    assert (((p > 0.5) == y)[3000:]).mean() > 0.97
    names = [f"v{i}" for i in range(len(VECTOR))]
    df = spark.createDataFrame(pd.DataFrame(x[:200], columns=names))
    got = [r[0] for r in df.select(rules.compile_rules(b, found, [F.col(n) for n in names])).collect()]
    assert np.allclose(got, p[:200])


def test_classifier_held_out(spark, sf):
    out = rules.op8_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (out.held_out == [held(i, 5, 0) for i in out.doc_id]).all() and (out.predicted == (out.score >= 0.3)).all()
    d = out.merge(labels, on="doc_id")
    assert (d.predicted == d.quality).mean() > 0.9


def test_scores_equal_plain_rules(spark, sf, monkeypatch):
    """The compiled expression against the rules, one by one, over statistics in plain Python."""
    learned = []
    plain = rules.fit_rules
    monkeypatch.setattr(rules, "fit_rules", lambda x, y: learned.append(plain(x, y)) or learned[-1])
    out = rules.op8_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    (b, found), = learned
    assert found
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        c = dict(zip(COUNTS, text_counts(r["text"])))
        rate = lambda a, b: c[a] / max(c[b], 1)
        v = [math.log1p(c["n_words"]), math.log1p(rate("word_chars", "n_words")), *(math.sqrt(rate(a, b)) for a, b in (("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_digits", "word_chars"), ("n_punct", "n_words"), ("n_other", "n_words"))), math.log1p(c["n_distinct"]) / max(math.log1p(c["n_words"]), 0.5), math.log1p(rate("n_words", "n_lines")), math.log1p(c["max_word"])]
        z = b + sum(w for rule, w in found if all((v[f] > cut) == greater for f, greater, cut in rule))
        assert out.score[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, "w " * 100_000), (3, "again")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("v0", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 1), (3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in rules.score_quality(df, none).collect()} == {0.5}
    assert rules.score_quality(df, one).count() == 5
    assert all(0 < r["score"] < 1 for r in rules.score_quality(df, one).collect())
    assert rules.score_quality(df.limit(0), one).count() == 0


# mixing


def test_every_block_has_a_slot():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m = int(rng.integers(1, 9))
        w = list(rng.random(m) + 0.01)
        b = [int(x) for x in rng.integers(0, 300, m)]
        slots = mixing.plan(b, w, 64)
        assert sorted(np.concatenate([mixing.slots_of(p, np.arange(n)) if n else [] for p, n in zip(slots, b)])) == list(range(sum(b)))
        assert all((np.diff(s) > 0).all() for s in slots)


@pytest.mark.parametrize("w", [[1, 1, 1], [1, 2, 5], [1, 10**0.5, 10], [1, 1, 1000], [3, 7, 11, 13]])
def test_schedule_is_earliest_deadline_first(w):
    """Slot by slot: the block there is released, and no other released block is due before it."""
    blocks, total = [1500] * len(w), sum(w)
    every = np.empty(sum(blocks), int)
    for i, s in enumerate(mixing.plan(blocks, w, 97)):
        every[s] = i
    release = lambda i: math.floor(taken[i] * total / w[i] + 1e-6)
    due = lambda i: math.ceil((taken[i] + 1) * total / w[i] - 1e-6)
    taken = [0] * len(w)
    for t in range(int(min(n * total / x for n, x in zip(blocks, w)))):  # until a source runs out
        i = every[t]
        assert release(i) <= t < due(i) and due(i) == min(due(j) for j in range(len(w)) if release(j) <= t)
        taken[i] += 1


@pytest.mark.parametrize("w", [[0.5, 0.3, 0.2], [(i + 1) ** 0.5 for i in range(20)], [0.0001, 0.6, 0.3999], [1, 1, 1], [1, 10**0.5, 10], [1, 1, 1000]])
def test_weights_are_met_over_many_blocks(w):
    share = np.array(w) / sum(w)
    blocks = [60_000 if len(w) == 3 else 24_000] * len(w)
    slots = mixing.plan(blocks, w)
    first = min(n / x for n, x in zip(blocks, share))  # when the first source runs out
    t = np.arange(1, int(first))
    for s, x in zip(slots, share):
        got = np.searchsorted(s, t, "left")
        assert np.abs(got - x * t).max() < 1 + 1e-6
    assert all((a == b).all() for a, b in zip(slots, mixing.plan(blocks, w, 1000)))


def test_any_number_of_sources(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 2500).alias("source"))
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == 6000 and sorted(got.mix_block.unique()) == list(range(2500))
    assert got.groupby("mix_block").source.nunique().max() == 1


def test_mixing_rows(spark):
    rows = [(i, f"t{i}", None if i % 10 == 0 else ["a", "b", "c"][i % 3], i) for i in range(1000)] + [(5, "t5", "c", 5)] * 3 + [(None, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_block long").withColumn("_k", F.lit(1)).withColumn("q", F.lit("x"))
    got = mixing.mix_sources(df, {"a": 3.0, "b": 1.0, None: 1.0}, block_rows=7, range_rows=20).toPandas()
    assert sorted(map(str, got.doc_id)) == sorted(map(str, pd.DataFrame(rows)[0]))
    assert not got.duplicated(["mix_block", "mix_index"]).any()
    assert got.groupby("mix_block").source.nunique(dropna=False).max() == 1
    n = got.groupby("mix_block").size()
    assert sorted(n.index) == list(range(len(n))) and (n <= 7).all()
    got["source"] = got.source.fillna("-")
    order = got.drop_duplicates("mix_block").sort_values("mix_block").source.tolist()
    assert order.index("c") > max(i for i, s in enumerate(order) if s != "c")  # no weight: after all others
    cut = 0
    for t, s in enumerate(order[:60], 1):
        cut += s == "a"
        assert abs(cut - 0.6 * t) < 1.05
    again = mixing.mix_sources(df.repartition(5), {"a": 3.0, "b": 1.0, None: 1.0}, block_rows=7, range_rows=20).toPandas()
    key = lambda x: sorted(zip(x.doc_id.fillna(-1), x.mix_block, x.mix_index))
    assert key(got) == key(again)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, max_sources=2)


# near-dedup


def near(rows, size, per_cent=80):
    sets, n = {}, {}
    grams = {}
    for i, (doc, t) in enumerate(rows):
        w = wordlm_tokens(t)[:-1]
        grams[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
        n[i] = len(grams[i])
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    del sets
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not grams[i] or not grams[j]:
                continue
            if 100 * len(grams[i] & grams[j]) >= per_cent * len(grams[i] | grams[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, n[i], find(d) if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(None, "w1 w2 w3 w4 w5 w6"), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, "two words!"), (1, "same id other text a b c"), (1, "quite another text d e f")]
    i = 2
    for base in range(6):
        text = [rng.choice(vocab) for _ in range(120)]
        for _ in range(30 if base == 0 else 6):
            t = list(text)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
        rows += [(i, " ".join(text)), (i + 1, " ".join(text).upper())]
        i += 2
    shared = " ".join(rng.choice(vocab) for _ in range(30))
    rows += [(i + j, shared + " " + " ".join(rng.choice(vocab) for _ in range(60))) for j in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,limit,dense", [(64, 4096, 8), (4, 20, 8), (3, 1000, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, limit, dense):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LIMIT", limit)
    monkeypatch.setattr(neardup, "DENSE_LIMIT", 2 * limit)
    monkeypatch.setattr(neardup, "DENSE", dense)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4).collect()), key=str)
    assert got == near(rows, 4)


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MAX_BROADCAST", 0)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in neardup.dedup_documents(df, 5).collect()), key=str)
    assert kept == sorted((d for d, _, c in near(rows, 5) if d == c), key=str)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a " * 200_000), (2, "a " * 199_999), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.dedup_documents(df.limit(0)).count() == 0


def test_recall_sets_the_trees():
    assert neardup.trees_for(0.99999, 0.8) > neardup.trees_for(0.99, 0.8) > neardup.trees_for(0.99, 0.95)


def test_deep_nodes_get_further_trees(spark, monkeypatch):
    assert [neardup.trees_at(0.99999, 0.8, d) for d in (3, 9, 25)] == [12, 24, 55]
    rng = random.Random(3)
    shared = [f"h{i}" for i in range(60)]  # pairwise similarity of about 0.5, unlinked
    rows = [(i, " ".join(shared + [f"r{rng.randrange(10**9)}" for _ in range(30)])) for i in range(60)]
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LIMIT", 8)
    monkeypatch.setattr(neardup, "DENSE_LIMIT", 8)
    ran = []
    plain = neardup._further
    monkeypatch.setattr(neardup, "_further", lambda reps, first, last: ran.append((first, last)) or plain(reps, first, last))
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(d, c) for d, _, c in near(rows, 2)}
    assert ran and ran[0][0] == neardup.trees_for(0.99999, 0.8) and all(a[1] == b[0] for a, b in zip(ran, ran[1:]))


def near_by_matrix(texts, size, per_cent=80):
    """Least index linked with each text, from all pairs of an incidence matrix of shingles."""
    index = {}
    sets = []
    for t in texts:
        w = wordlm_tokens(t)[:-1]
        sets.append(sorted({index.setdefault(tuple(w[j : j + size]), len(index)) for j in range(len(w) - size + 1)}))
    often = Counter(x for s in sets for x in s)
    column = {x: i for i, x in enumerate(x for x, c in often.items() if c > 1)}
    m = np.zeros((len(texts), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[x] for x in s if x in column]] = 1
    n = np.array([len(s) for s in sets])
    label = np.arange(len(texts))
    links = []
    for lo in range(0, len(texts), 500):
        same = (m[lo : lo + 500] @ m.T).astype(int)
        i, j = np.nonzero((same > 0) & (100 * same >= per_cent * (n[lo : lo + 500, None] + n - same)))
        links.append(np.stack((i + lo, j), 1)[j > i + lo])
    links = np.concatenate(links)
    while True:
        new = label.copy()
        np.minimum.at(new, links[:, 0], label[links[:, 1]])
        np.minimum.at(new, links[:, 1], label[links[:, 0]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label, len(links)
        label = new


def copies(rng, n, words, edits, step=1):
    """n copies of one text, each with some of the words at multiples of step replaced by words of its own."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for k in rng.sample(range(0, words, step), edits(i)):
            t[k] = f"x{i}.{k}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words,edits,step,linked", [(200, 3, 1, True), (100, 4, 30, False)])
def test_a_dense_group_of_thousands(spark, words, edits, step, linked):
    rng = random.Random(11)
    texts = copies(rng, 5000, words, (lambda i: 4 if i % 5 else 3) if linked else (lambda i: edits), step)
    label, n = near_by_matrix(texts, 4)
    assert (n > 0) == linked
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = neardup.near_duplicates(df, 4).toPandas().sort_values("doc_id")
    assert (got.component_id.to_numpy() == label).all()


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes minutes; set SLOW_TESTS=1")
def test_pairs_meet_below_level_three(spark, monkeypatch):
    """All linked pairs of a group whose nodes branch many times: the trees follow the depth."""
    rng = random.Random(12)
    texts = copies(rng, 200, 100, lambda i: 2 + i % 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LIMIT", 60)
    monkeypatch.setattr(neardup, "DENSE_LIMIT", 60)
    depths = []
    plain = neardup.trees_at
    monkeypatch.setattr(neardup, "trees_at", lambda recall, threshold, levels: depths.append(levels) or plain(recall, threshold, levels))
    label, _ = near_by_matrix(texts, 4)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).toPandas().sort_values("doc_id")
    assert (got.component_id.to_numpy() == label).all() and max(depths) > 3


def test_intersections():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300))).astype(np.uint64) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]
    for width in (7, 2048):
        assert (neardup.intersections(sets[:15], sets[15:], width) == want).all()


def test_an_id_with_several_texts_unites_them(spark):
    a, b = "one two three four five six", "red green blue white black grey"
    df = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b), (9, "no copy of any other text")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(2, 2), (5, 2), (5, 2), (7, 2), (9, 9)]
    assert sorted(r["doc_id"] for r in neardup.dedup_documents(df).collect()) == [2, 9]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5000, 5000)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
