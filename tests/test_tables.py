import numpy as np
import pytest

from abundex.operators.matrix import _grouped
from abundex.sources.tables import read_table


@pytest.mark.parametrize("files, shuffled", [(1, True), (6, False)])
def test_only_tables_of_few_splits_are_dealt_out(spark, tmp_path, files, shuffled):
    path = str(tmp_path / "t")
    spark.range(60).repartition(files).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    try:
        table = read_table(spark, path)
        assert ("Repartition" in table._jdf.queryExecution().optimizedPlan().toString()) == shuffled
        assert sorted(r["id"] for r in table.collect()) == list(range(60))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("k, groups", [(4, 1), (31, 1), (31, 2), (31, 5), (21, 1000)])
def test_equal_cells_come_together(k, groups):
    rng = np.random.default_rng(k + groups)
    codes = rng.choice(rng.integers(0, 1 << (2 * k), 50, dtype=np.int64), 2000)
    g = rng.integers(0, groups, 2000)
    order = _grouped(codes, g, k)
    pairs = list(zip(codes[order].tolist(), g[order].tolist()))
    runs = 1 + sum(a != b for a, b in zip(pairs, pairs[1:]))
    assert sorted(order.tolist()) == list(range(2000)) and runs == len(set(pairs))
