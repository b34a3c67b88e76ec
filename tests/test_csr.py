"""The file of binary compressed rows: round trips by several tasks, row conditions before planning, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.sources import csr, matrices


def matrix(n=300, m=40, seed=1):
    g = np.random.default_rng(seed)
    cells = g.random((n, m)) < 0.1
    cells[50:90] = False  # empty rows, also the last ones
    cells[-5:] = False
    cells[120] = True
    return [(int(i), int(j), float(g.integers(1, 99))) for i, j in zip(*np.nonzero(cells), strict=True)]


@pytest.mark.parametrize("task_cells, batch", [(7, 3), (100, 64), (10**6, 10**5)])
def test_round_trip(spark, tmp_path, monkeypatch, task_cells, batch):
    monkeypatch.setattr(csr, "BATCH_CELLS", batch)
    cells, path = matrix(), str(tmp_path / "a.csr")
    csr.write_csr(spark.createDataFrame(cells, "i int, j int, v double").repartition(5), path, (300, 40))
    assert open(path, "rb").read() == matrices.csr_bytes((300, 40), cells)
    assert csr.shape_of(path) == (300, 40, len(cells))
    got = csr.read_csr(spark, path, task_cells)
    assert got.rdd.getNumPartitions() == -(-len(cells) // task_cells)
    assert sorted(map(tuple, got.collect())) == cells
    assert sorted(map(tuple, matrices.read_binary_csr(spark, path).collect())) == cells
    assert [p.name for p in tmp_path.iterdir() if p.is_file()] == ["a.csr"]


def test_conditions_on_rows_shrink_the_read(spark, tmp_path):
    cells, path = matrix(), str(tmp_path / "a.csr")
    csr.write_csr(spark.createDataFrame(cells, "i int, j int, v double"), path, (300, 40))
    i = F.col("i")
    for condition, keep in [
        ((i >= 100) & (i < 130), lambda x: 100 <= x < 130),
        ((i > 100) & (i <= 120) & (F.col("j") > 3), lambda x: 100 < x <= 120),
        (i == 120, lambda x: x == 120),
        (i == 60, lambda x: x == 60),
        (i > 10**6, lambda x: False),
        (i < -1, lambda x: False),
        (i < 10**6, lambda x: True),
    ]:
        got = csr.read_csr(spark, path, 5).filter(condition)
        want = [c for c in cells if keep(c[0]) and ("j" not in str(condition) or c[1] > 3)]
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() <= max(1, -(-sum(keep(c[0]) for c in cells) // 5))


def test_empty_and_ill_formed_matrices(spark, tmp_path):
    path = str(tmp_path / "e.csr")
    csr.write_csr(spark.createDataFrame([], "i int, j int, v double"), path, (3, 2))
    assert open(path, "rb").read() == matrices.csr_bytes((3, 2), []) and csr.read_csr(spark, path).collect() == []
    with pytest.raises(Exception, match="beyond the shape"):
        csr.write_csr(spark.createDataFrame([(3, 0, 1.0)], "i int, j int, v double"), str(tmp_path / "x.csr"), (3, 2))
    assert not (tmp_path / "x.csr").exists()
    with pytest.raises(ValueError, match="mounted"):
        csr.mounted("hdfs://a/b")
    assert csr.mounted("file:///a/b") == csr.mounted("file:/a/b") == "/a/b"
