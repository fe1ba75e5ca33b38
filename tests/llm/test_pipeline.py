"""Each stage against a plain version, on what its predecessor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from abundex.llm import langid
from abundex.llm.common import keep
from tests.llm.test_models import many_texts, near, plain_calibration
from tests.llm.test_text_operators import _brute, _dedup


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(keep(f(spark, out[-1], sf), name))
    return out


def test_columns(stages):
    for d in stages[1:-1]:
        assert d.dtypes == stages[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages[0].toPandas(), stages[1].toPandas()
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > 0.97 * len(before)
    assert (after.merge(before, on="doc_id", suffixes=("", "_")).eval("text == text_")).all()


def test_language_stage_learns_its_limits_from_all_documents(spark):
    texts, odd = many_texts(spark)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *odd])] + [(-1, "#" + "ğħœ" * 40, None, "s", 121)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(len(texts) + len(odd)))


def test_language_stage_has_the_limits_of_all_texts(spark, monkeypatch):
    """Two languages of more texts than the sample had, with copies and rows without language or text: the stage's limits
    are those of a plain calculation over all distinct texts."""
    texts, odd = many_texts(spark)
    german = [t.translate(str.maketrans("aeot", "äöüß")) for t in texts[:17_000]]
    rows = [("en", t) for t in [*texts, *odd, *texts[:300]]] + [("de", t) for t in [*german, *german[:300]]]
    other = [(None, "qzxjkvwp " * 9), ("en", None), ("de", "123")]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (x, t) in enumerate(rows + other)], "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    models = []
    monkeypatch.setattr(langid, "identify", lambda d, model, run=langid.identify: models.append(model) or run(d, model))
    corpus_pipeline.language_id(spark, docs, "")
    ce, n = langid.cross_entropies(models[0], [t for _, t in dict.fromkeys(rows)])
    best, ce = ce.argmin(1), ce.min(1)
    assert models[0].langs == ["de", "en"] and np.bincount(best).tolist() == [17_000, 18_040]
    for i in range(2):
        assert models[0].calibration[i] == pytest.approx(plain_calibration(ce[best == i], n[best == i]), rel=1e-6)


def test_line_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].select("doc_id", "text").collect()]
    want = sorted((i, t) for i, t, _, _ in _dedup(rows, 40, 5))
    assert sorted((r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()) == want
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in stages[3].select("doc_id").collect()) == sorted(d for d, _, c in near(rows, 5) if d == c)


def test_decontamination_stage(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    import re

    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [lower(t)] for i in range(len(w) - 9)}
    short = [(i, t) for i, t in items if 0 < len(lower(t)) < 10]
    clean = []
    for r in stages[3].select("doc_id", "text").collect():
        w = lower(r["text"])
        if not any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9)) and not (short and _brute(r["text"], short)[1]):
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[4].select("doc_id").collect()) == sorted(clean)


def test_mix_stage(stages):
    last = stages[5].toPandas()
    assert sorted(last.doc_id) == sorted(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert not last.duplicated(["mix_block", "mix_index"]).any()


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in stages[5].select("doc_id").collect())


def test_edges(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated rows, a clashing column; then an empty table."""
    words = "the cat went home and the dog ran away from this old house again".split()
    rows = [(i, " ".join(words[(i * j) % 13] for j in range(1, 40)), "en" if i % 7 else None, None if i % 5 == 0 else "s", 1) for i in range(1, 60)]
    rows += [(100, None, "en", "s", 1), (101, "", None, None, None), (102, "123", "en", "s", 1), (None, rows[0][1], "en", "s", 1), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).withColumn("mix_block", F.lit("clash")).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "no such words anywhere in it"), (None, "the cat"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.schema["mix_block"].dataType.typeName() == "long"
        ids = [r["doc_id"] for r in got.collect()]
        assert not {100, 101, 102} & set(ids) and len(ids) <= len(some)
        assert bool(ids) == bool(some) and (not some or (None in ids and 1 in ids))
