import gzip
import random
import threading

import pytest
from pyspark.sql import functions as F

from abundex.operators import analytics as an
from abundex.operators import lookup
from abundex.operators import matrix as mx
from abundex.plans import index as ix
from abundex.plans import sinks
from abundex.sources import catalog, fasta
from abundex.streaming import inbox, server

K = 5
U1 = ">0 LN:i:9 KC:i:20 km:f:33.7 L:+:1:-\nACGTACCTG\n>1 LN:i:4 km:f:9.0\nACGT\n>2 km:f:2.0\nGGGTTAAC\n"
U2 = ">0 KM:f:2.0\nTACCTGAA\n>1\nccgta\n>2 km:f:7.0\nTACCTG\n"
QUERY = ">q1 first query length=9\nACGTA\ncctg\n>q1 again\nCAGGTACGT\n>short\nACG\n>bad\nACGTAC\nNNN\n>" + "n" * 60 + "\nTTTTTTT\n\n>exact\nACCTG\n"
RC = str.maketrans("ACGT", "TGCA")


def canon(x):
    return min(x, x.translate(RC)[::-1])


def model(*texts):
    """kmer -> counts, and totals, in plain Python."""
    out, totals = {}, []
    for d, t in enumerate(texts):
        total = 0
        for rec in t.split(">")[1:]:
            head, *body = rec.split("\n")
            seq = "".join(body).upper()
            low = head.lower()
            c = int(float(low.split("km:f:")[1].split()[0])) if "km:f:" in low else 1
            if len(seq) >= K:
                total += c * (len(seq) - K + 1)
            for i in range(len(seq) - K + 1):
                v = out.setdefault(canon(seq[i : i + K]), [0] * len(texts))
                v[d] = max(v[d], c)
        totals.append(total)
    return out, totals


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("fa") / "with + and space"
    d.mkdir()
    (d / "one.unitigs.fa").write_text(U1)
    with gzip.open(d / "two.unitigs.fa.gz", "wt") as f:
        f.write(U2)
    (d / "fof.txt").write_text(f"{d}/one.unitigs.fa\n\n{d}/missing.fa\n{d}/two.unitigs.fa.gz\n")
    (d / "q.fa").write_text(QUERY)
    return d


@pytest.fixture(scope="module")
def index(spark, files):
    built = ix.build_index(spark, str(files / "fof.txt"), K)
    built.save(str(files / "index"))
    return ix.load_index(spark, str(files / "index"))


def test_fof(spark, files):
    d = fasta.read_fof(spark, str(files / "fof.txt"))
    assert [(r["dataset_id"], r["name"]) for r in d.collect()] == [(0, "one"), (1, "two")]
    assert fasta.missing_files(spark, str(files / "fof.txt")) == [f"{files}/missing.fa"]
    (files / "none.txt").write_text("nowhere\n")
    with pytest.raises(ValueError):
        fasta.read_fof(spark, str(files / "none.txt"))
    with pytest.raises(ValueError):
        fasta.read_fof(spark, str(files / "q.fa"), paired=True)


def test_index_equals_model(spark, index):
    want, totals = model(U1, U2)
    got = {}
    from abundex.functions.kmers import decode

    for r in index.matrix().select(decode("kmer", K).alias("k"), "dataset_id", "count").collect():
        got.setdefault(r["k"], [0, 0])[r["dataset_id"]] = r["count"]
    assert got == want
    assert [r["total_kmers"] for r in index.datasets.orderBy("dataset_id").collect()] == totals
    info = index.info().first()
    assert (info["n_kmers"], info["n_classes"]) == (len(want), len({tuple(v) for v in want.values()}))
    lines = {r["value"].split("\t\t")[0]: r["value"].split("\t\t")[1] for r in index.export_monotigs().collect()}
    assert lines == {k: "\t".join(map(str, v)) for k, v in want.items()}


def expected(fmt, threshold=40):
    want, totals = model(U1, U2)
    import numpy as np

    out = []
    for name, seq in (("q1", "ACGTACCTG"), ("q1", "CAGGTACGT"), ("n" * 50, "TTTTTTT"), ("exact", "ACCTG")):
        row = [name]
        prof = [want.get(canon(seq[i : i + K]), [0, 0]) for i in range(len(seq) - K + 1)]
        for d in range(2):
            p = [v[d] for v in prof]
            pct = (len(seq) - p.count(0)) * 100 // len(seq)
            if fmt == "sum":
                v = str(sum(p))
            elif fmt == "average":
                v = f"{np.float32(sum(p)) / np.float32(len(p)):.6f}"[:-4]
            elif fmt == "normalize":
                v = str(int(np.ceil(np.float32(np.float32(sum(p)) / np.float32(len(p) * totals[d])) * np.float32(1e9))))
            else:
                runs, s = [], 0
                for i in range(1, len(p) + 1):
                    if i == len(p) or p[i] != p[s]:
                        runs.append(f"{s}-{i - 1}:{p[s] or '*'}")
                        s = i
                v = ",".join(runs)
            row.append(v if pct >= threshold else "*")
        out.append("\t".join(row))
    return out


@pytest.mark.parametrize("fmt,threshold", [("raw", 0), ("raw", 40), ("sum", 0), ("sum", 78), ("average", 0), ("normalize", 0)])
def test_formats(spark, files, index, tmp_path, fmt, threshold):
    path = str(tmp_path / "o.tsv")
    assert sinks.write_tsv(index.query_file(str(files / "q.fa"), fmt, threshold), index.datasets, path) == 4
    head, *rows = open(path).read().splitlines()
    assert head == "query\tone\ttwo"
    assert rows == expected(fmt, threshold)


def test_rejects(spark, files):
    got = {(r["header"][:5], r["reason"]) for r in fasta.rejected_queries(spark, str(files / "q.fa"), K).collect()}
    assert got == {("short", "shorter than k"), ("bad", "other characters")}


def test_index_path_equals_direct_path(spark, files, index):
    q = fasta.read_queries(spark, str(files / "q.fa"), K)
    kmers = lookup.query_kmers(q, K)
    direct = lookup.hits(kmers, index.matrix())
    via = lookup.index_hits(kmers, index.kmer_class, index.classes).select(direct.columns)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, via.collect()))


def test_presence_shows_coverage(spark, files):
    built = ix.build_index(spark, str(files / "fof.txt"), K, "presence")
    r = built.query_file(str(files / "q.fa"), "sum", 0).where("query_ord = 0 and dataset_id = 0").first()
    assert r["value"] == str(r["pct"]) == "100"
    with pytest.raises(ValueError):
        built.export_monotigs()


def test_string_kmers_beyond_31(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(50))
    df = spark.createDataFrame([(0, s, 3), (0, s.translate(RC)[::-1], 4), (1, s[:40], 1)], "dataset int, seq string, count int")
    got = {(r["kmer"], r["dataset"]): r["count"] for r in mx.kmer_matrix(df, 35).collect()}
    assert got == {(canon(s[i : i + 35]), 0): 4 for i in range(16)} | {(canon(s[i : i + 35]), 1): 1 for i in range(6)}


def test_roller_equals_native(spark):
    rng = random.Random(2)
    rows = [(i % 3, "".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(rng.randrange(0, 200))), i + 1) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, "ACGTACGTAC", 5), (1, None, 2)], "dataset int, seq string, count int")
    native = mx.positions(df, 7, ["dataset", "count"]).groupBy("kmer", "dataset").agg(F.max("count").alias("count"))
    assert sorted(map(str, mx.kmer_matrix(df, 7).collect())) == sorted(map(str, native.collect()))
    n = mx.positions(df, 7, ["dataset"]).groupBy("kmer", "dataset").agg(F.count("*").cast("int").alias("count")).where("count > 1")
    assert sorted(map(str, mx.read_matrix(df, 7, 2).collect())) == sorted(map(str, n.collect()))


def test_long_sequence_is_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK", 64)
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(1000))
    rows = next(iter([[(r, q) for r, q in mx._chunks(__import__("pyarrow").RecordBatch.from_pydict({"seq": [s]}), 9)]]))
    from abundex.functions.kmers import roll

    codes = [c for _, q in rows for c in roll(q, 9)[0]]
    assert codes == list(roll([s.encode()], 9)[0])


def test_stress_patterns(spark):
    l = 8
    cells = mx.kmer_matrix(an.stress_patterns(spark, l), l)
    found = mx.classes(mx.count_vectors(cells))
    assert not mx.collide(found)
    assert (cells.select("kmer").distinct().count(), found.count()) == (2**l - 1, 2**l - 1)
    assert {r["n"] for r in cells.groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {2 ** (l - 1)}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "dataset int, seq string, count int")
    assert mx.kmer_matrix(empty, 5).count() == 0
    d = spark.createDataFrame([(0, "a", "a", 0)], "dataset_id int, name string, path string, total_kmers bigint")
    built = ix.from_matrix(spark.createDataFrame([], "kmer bigint, dataset_id int, count int"), d, 5, "exact")
    q = spark.createDataFrame([(0, "x", "ACGTACG"), (1, "y", "AC")], "query_ord bigint, header string, seq string")
    for f, want in (("raw", "0-2:*"), ("sum", "0"), ("average", "0.00"), ("normalize", "0")):
        assert [(r["query"], r["value"], r["pct"]) for r in built.query(q, f).collect()] == [("x", want, 57)]


def test_unknown_format(index):
    with pytest.raises(ValueError):
        lookup.check_format("mean")
    assert lookup.check_format("a") == "average"


def test_reads(spark, tmp_path):
    (tmp_path / "r_1.fastq").write_text("@a\nACGTAC\n+\n@IIIII\n@b\nacgtan\n+b\nIIIIII\n")
    (tmp_path / "r_2.fq").write_text("@a\nGTACGT\n+\nIIIIII\n")
    (tmp_path / "fof").write_text(f"{tmp_path}/r_1.fastq\n{tmp_path}/r_2.fq\n")
    d = fasta.read_fof(spark, str(tmp_path / "fof"), paired=True)
    assert [r["name"] for r in d.collect()] == ["r_1_r_2"]
    assert sorted(r["seq"] for r in fasta.read_reads(spark, d).collect()) == ["ACGTAC", "ACGTAN", "GTACGT"]
    built = ix.build_index(spark, str(tmp_path / "fof"), 4, from_reads=True, paired=True)
    want = {}
    for s in ("ACGTAC", "ACGTA", "GTACGT"):
        for i in range(len(s) - 3):
            want[canon(s[i : i + 4])] = want.get(canon(s[i : i + 4]), 0) + 1
    from abundex.functions.kmers import decode

    assert {r["k"]: r["count"] for r in built.matrix().select(decode("kmer", 4).alias("k"), "count").collect()} == {k: v for k, v in want.items() if v >= 2}


def test_catalog(spark, tmp_path):
    text = "nb_monotig:10\nk:31\nrecord_option:1\nnb_eq_class:3\nnb_colors:2\ndo_query_on_disk:1\na:61379\nb:98922\n"
    (tmp_path / "info").write_text(text)
    info = catalog.read_info(spark, str(tmp_path / "info"))
    assert info["datasets"] == [("a", 61379), ("b", 98922)] and catalog.format_info(info) == text
    import struct

    (tmp_path / "old").write_bytes(struct.pack("<QIIqQ?", 10, 31, 1, 3, 2, True))
    d = spark.createDataFrame([(0, "a", 5), (1, "b", 6)], "dataset_id int, name string, total_kmers bigint")
    up = catalog.upgrade_info(spark, str(tmp_path / "old"), d)
    assert (up["k"], up["nb_eq_class"], up["datasets"]) == (31, 3, [("a", 5), ("b", 6)])
    with pytest.raises(ValueError):
        catalog.parse_info("k:31\n")


def test_output_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert sinks.output_path(None, "a/q.x.fa", 40, 2) == "./query_results/out_query_abundex_P40_q_2.out"
    assert sinks.output_path(str(tmp_path / "d"), "q.fa", 40) == f"{tmp_path}/d/query_results/out_query_abundex_P40_q_0.out"
    assert sinks.output_path(str(tmp_path / "e" / "f.tsv"), "q.fa", 40) == f"{tmp_path}/e/f.tsv"
    monkeypatch.setattr(sinks.os, "access", lambda *a: False)
    with pytest.raises(PermissionError):
        sinks.output_path(str(tmp_path / "g"), "q.fa", 40)


def test_inbox(spark, files, index, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(QUERY)
    q = inbox.answer_inbox(index, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "sum", 0)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["query"], r["name"], r["value"]) for r in got.collect()) == sorted((row.split("\t")[0], n, v) for row in expected("sum", 0) for n, v in zip(("one", "two"), row.split("\t")[1:]))


def test_server(spark, files, index, tmp_path):
    port, up = [], threading.Event()
    service = server.Service(index, "index")
    t = threading.Thread(target=server.serve, args=(service, 0), kwargs={"ready": lambda p: (port.append(p), up.set())})
    t.start()
    assert up.wait(20)
    out = str(tmp_path / "r.tsv")
    got = server.send(["INDEX", "HELP", f"FILE:{files}/q.fa:THRESHOLD:0:OUTFILE:{out}:FORMAT:sum", "FILE:nowhere.fa", "FILE", "NONSENSE"], port[0])
    assert got[0] == "INDEX:index" and got[2] == "DONE" and got[3].startswith("ERROR:") and got[4].startswith("ERROR:") and got[5] == "UNKNOWN command: NONSENSE" and got[6] == "BYE"
    assert open(out).read().splitlines()[1:] == expected("sum", 0)
    assert server.send(["QUIT"], port[0]) == ["BYE"]
    t.join(20)
    assert not t.is_alive()


def test_cli(spark, files, tmp_path, capsys, monkeypatch):
    from abundex import cli

    out = str(tmp_path / "ix")
    assert cli.main(["index", "-f", str(files / "fof.txt"), "-k", str(K), "-o", out]) == 0
    assert cli.main(["query", "-l", out, "-q", str(files / "q.fa"), "-F", "s", "-P", "0", "-o", str(tmp_path / "o.tsv")]) == 0
    assert (tmp_path / "o.tsv").read_text().splitlines()[1:] == expected("sum", 0)
    with pytest.raises(SystemExit):
        cli.main(["index", "-f", "x", "--nocount", "--log-count"])


def test_analytics(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (2, 30.0), (4, 40.0)], "x int, y double")
    assert an.spearman(df, "x", "y").first()["r"] == pytest.approx(0.6324555, abs=1e-6)
    a = spark.createDataFrame([([5, 5, 5, 0, 0, 7],)], "c array<int>")
    pairs = an.rle(F.col("c"), 2)
    assert [tuple(x) for x in a.select(pairs).first()[0]] == [(2, 5), (1, 5), (2, 0), (1, 7)]
    assert a.select(an.unrle(pairs)).first()[0] == [5, 5, 5, 0, 0, 7]
    v = spark.createDataFrame([([1, 0, 4], [1, 3, 4]), ([1, 2], [2, 4]), ([0, 2], [1, 2])], "a array<int>, b array<int>")
    assert [tuple(r) for r in v.select(an.equal_where_present(F.col("a"), F.col("b")), an.similar_counts(F.col("a"), F.col("b"), 2.0)).collect()] == [(True, False), (False, True), (True, False)]
    assert spark.createDataFrame([("x:1:2:33",)], "h string").select(an.header_counts(F.col("h"))).first()[0] == [1, 2, 33]
    assert [r["id"] for r in an.sample_rows(spark.range(100), 5, "id").collect()] == [r["id"] for r in an.sample_rows(spark.range(100).repartition(3), 5, "id").collect()]
    u = fasta.unitig_reads(spark.createDataFrame([("r1", "1;-2;3;"), ("r2", "2;2;")], "read string, value string"))
    assert {r["unitig"]: r["reads"] for r in u.collect()} == {1: ["r1"], 2: ["r1", "r2"], 3: ["r1"]}


def test_lookup_reads_the_buckets_it_needs(spark, files, index, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BUCKET_KMERS", 2)
    ix.build_index(spark, str(files / "fof.txt"), K).save(str(tmp_path / "ix"))
    cut = ix.load_index(spark, str(tmp_path / "ix"))
    assert cut.buckets > 3 and cut.info().collect() == index.info().collect()
    q = spark.createDataFrame([(0, "x", "ACGTACC")], "query_ord long, header string, seq string")
    out = cut.query(q, "sum", 0)
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x and "bucket" in x)
    assert " IN (" in line or "=" in line.split("PartitionFilters")[1]
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert key(out) == key(index.query(q, "sum", 0))
    assert key(cut.query_file(str(files / "q.fa"), "raw", 0)) == key(index.query_file(str(files / "q.fa"), "raw", 0))
    assert key(cut.matrix()) == key(index.matrix())


def test_index_in_memory(spark, files, index):
    held = ix.load_index(spark, str(files / "index")).cache()
    assert held.kmer_class.storageLevel.useMemory and held.classes.storageLevel.useMemory
    q = lambda i: sorted(tuple(r) for r in i.query_file(str(files / "q.fa"), "raw", 40).collect())
    assert q(held) == q(index)
    held.kmer_class.unpersist()
    held.classes.unpersist()


def test_rebuilt_catalog(spark, files, index):
    got = ix.rebuild_catalog(spark, str(files / "fof.txt"), K).collect()
    _, totals = model(U1, U2)
    assert [(r["name"], r["total_kmers"]) for r in sorted(got, key=lambda r: r["dataset_id"])] == [("one", totals[0]), ("two", totals[1])]


def test_saturation(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">0 km:f:70000.0\nACGTACC\n>1 km:f:65535.0\nGGGGGG\n>2 km:f:3.0\nTTAAC\n")
    (tmp_path / "fof").write_text(f"{tmp_path}/a.fa\n")
    counts = lambda **more: sorted({r["count"] for r in ix.build_index(spark, str(tmp_path / "fof"), K, **more).matrix().collect()})
    assert counts() == [3, 65535, 70000] and counts(saturate=65535) == [3, 65535]


def test_interleaved_pairs(spark, tmp_path):
    (tmp_path / "l.fa").write_text(">a/1\nacg\n>b/1\nGG\n")
    (tmp_path / "r.fa").write_text(">a/2\nttt\n>b/2\nCC\n")
    one = lambda f: fasta._records(spark, str(tmp_path / f), ">").select("at", "header", F.regexp_replace("body", r"\s", "").alias("seq"))
    got = [r["value"] for r in fasta.interleave_pairs(one("l.fa"), one("r.fa")).collect()]
    assert got == [">a/1\nACG", ">a/2\nTTT", ">b/1\nGG", ">b/2\nCC"]


def test_sample_lists(spark, tmp_path):
    (tmp_path / "s").write_text("SRR1\n\n SRR2 \n")
    assert sorted((r["sample"], r["label"]) for r in fasta.read_samples(spark, str(tmp_path / "s"), "x").collect()) == [("SRR1", "x"), ("SRR2", "x")]


def test_run_tag():
    import re

    assert re.fullmatch(r"\d{8}_\d{6}_\d{6}", sinks.run_tag()) and sinks.query_base("a/b.c.fa") == "b"


def test_interactive(spark, files, index, tmp_path, capsys, monkeypatch):
    import io

    from abundex import cli

    (tmp_path / "q.fa").write_text(QUERY)
    monkeypatch.setattr("sys.stdin", io.StringIO(f"{tmp_path}/q.fa\n\n{tmp_path}/q.fa 0\n\n\n{tmp_path}/never.fa\n"))
    assert cli.main(["interactive", "-l", str(files / "index"), "-F", "s", "-P", "40", "-o", str(tmp_path)]) == 0
    first, second = capsys.readouterr().out.split()
    assert open(first).read().splitlines()[1:] == expected("sum", 40) and open(second).read().splitlines()[1:] == expected("sum", 0)


def test_mixed_reads_are_one_scan_a_kind(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nACGTAC\n+\nIIIIII\n")
    (tmp_path / "b.fa").write_text(">b\nGGGT\nAC\n")
    (tmp_path / "c.fasta").write_text(">c\nTTTT\n")
    (tmp_path / "fof").write_text("".join(f"{tmp_path}/{x}\n" for x in ("a.fastq", "b.fa", "c.fasta")))
    out = fasta.read_reads(spark, fasta.read_fof(spark, str(tmp_path / "fof")))
    assert sorted((r["dataset_id"], r["seq"]) for r in out.collect()) == [(0, "ACGTAC"), (1, "GGGTAC"), (2, "TTTT")]
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan text") == 2


def test_runs_of_long_arrays(spark):
    df = spark.createDataFrame([([7] * 5000 + [1] * 3,), ([],), (None,), ([9],)], "c array<int>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(an.rle(F.col("c"), 2000, 5)).collect()]
    assert got == [[(2000, 5), (2000, 5), (1000, 5), (3, 1)], [], None, [(1, 5)]]
