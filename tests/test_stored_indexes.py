"""Indexes on disk against exhaustive search, and what they read."""

import numpy as np
import pytest

from marlstone.operators import retrieval
from marlstone.operators.streams import Best
from marlstone.sources.cells import CellIndex


def grouped(n, dims, groups, seed, noise=0.35):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dims))
    return middle[r.integers(groups, size=n)] + noise * r.normal(size=(n, dims))


def frame(spark, x, name="id", step=1):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x) if i % step == 0], f"{name} long, v array<double>").repartition(4)


def test_cells_agree_with_exact_search_and_read_a_share(spark, tmp_path):
    x = grouped(6000, 40, 50, 1)
    v, q = frame(spark, x), frame(spark, x, "qid", 100)
    index = CellIndex.build(v, f"file://{tmp_path}/cells", cells=48)
    want = retrieval.dense(v, q, 5)
    got = index.search(q, 5, probes=6)
    said = retrieval.parity(want, got).first()
    share = index.share_read(q, 6)
    assert said.n == 60 and said.overlap >= 0.99 and said.top1 >= 0.99 and share < 0.25
    exact = index.search(q, 5, probes=48, shortlist=6000)
    assert sorted((r.qid, r.rank, r.chunk_id, round(r.score, 9)) for r in exact.collect()) == sorted((r.qid, r.rank, r.chunk_id, round(r.score, 9)) for r in want.collect())


def test_unprobed_cells_are_not_read(spark, tmp_path):
    x = grouped(3000, 16, 20, 2)
    CellIndex.build(frame(spark, x), f"file://{tmp_path}/cells", cells=20)
    index = CellIndex(spark, f"file://{tmp_path}/cells")  # from disk
    one = frame(spark, x[:1], "qid")
    near = {int(c) for c in index.probed(np.array([x[0] / np.linalg.norm(x[0])]), 3)[0]}
    # cells that are not probed may be broken, and codes are scored without reading vectors
    files = list(tmp_path.glob("cells/cells/cell=*/*.parquet"))
    others = [f for f in files if int(f.parent.name[5:]) not in near]
    assert len(others) >= len(files) * 3 / 4
    for f in others:
        f.write_bytes(b"broken")
    got = index.search(one, 3, probes=3)
    assert [r.chunk_id for r in got.orderBy("rank").collect()][0] == 0
    assert "ReadSchema: struct<id:bigint,code:binary>" in got._jdf.queryExecution().executedPlan().toString()


def test_cells_edges(spark, tmp_path):
    x = grouped(300, 10, 5, 3)  # ten dimensions are no whole parts
    v = frame(spark, x)
    odd = spark.createDataFrame([(None, [1.0] * 10), (900, None), (901, [0.0] * 10), (0, x[0].tolist())], "id long, v array<double>")
    index = CellIndex.build(v.unionByName(odd), f"file://{tmp_path}/a", cells=4, words=16)
    assert index.rows().count() == 302
    index.append(frame(spark, x[:1] * 2).selectExpr("id + 5000 as id", "v"))
    q = frame(spark, x[:2], "qid")
    ids = [r.chunk_id for r in index.search(q, 3, probes=4, shortlist=400).filter("qid = 0").orderBy("rank").collect()]
    assert ids == [0, 0, 5000]
    assert index.search(q, 0).count() == 0 and index.search(q.limit(0), 3).count() == 0
    empty = CellIndex.build(v.limit(0), f"file://{tmp_path}/b")
    assert empty.search(q, 3).count() == 0
    with pytest.raises(ValueError):
        empty.append(v)
    names = CellIndex.build(v.selectExpr("concat('c', id) as id", "v"), f"file://{tmp_path}/c", cells=3)
    assert names.search(q, 1, probes=3).first().chunk_id.startswith("c")


def test_large_scores_keep_their_order():
    best = Best(["q"], 2)
    best.see(["a", "b", "c"], np.array([[600_000.0], [1.0], [2.0]]))
    assert best.ids == [["a", "c"]]
    best = Best(["q"], 2)
    best.see(["b", "a", "c"], np.array([[7e8], [7e8], [2.0]]))
    assert best.ids == [["a", "b"]]
    with pytest.raises(OverflowError):
        best.see(["d"], np.array([[1e12]]))
