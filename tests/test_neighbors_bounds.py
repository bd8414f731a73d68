"""What a query of nearest neighbours has to look at, and how rows are dealt whatever the parts of their files."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import knn, ml_models


def brute(points, k):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_a_query_travels_to_few_cells_and_finds_the_same(spark, monkeypatch, shift):
    """Points spread evenly: by summaries of the cells alone a query looked into more than a third of them."""
    points = np.random.default_rng(2).uniform(0, 1, (3000, 3)) + shift
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id bigint, v array<double>").cache()
    sent, plain = {}, type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, *a, **b: sent.update({f.__name__: (f, self)}) or plain(self, f, *a, **b))
    found = knn.nearest(df, df, "id", "v", 4, exclude_self=True, pivots=60)
    got = {}
    for row in found.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append(row["neighbor"])
    assert [got[i] for i in range(3000)] == brute(points, 4).tolist()
    carry, asked = sent["carry"]
    cells = [len(c) for message in carry(iter([asked.toPandas()])) for c in message["cells"]]
    assert sum(cells) / 3000 < 6
    # without a bound from its own cell a query looks into many more
    batch = pd.DataFrame({"qid": np.arange(3000), "qvec": list(points)})
    assert sum(len(c) for message in carry(iter([batch])) for c in message["cells"]) > 2 * sum(cells)


def test_equal_points_and_crowded_cells(spark):
    """More equal points than neighbours, cells cut into blocks, and queries far from all points."""
    r = np.random.default_rng(4)
    points = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)), r.normal(0, 1, (300, 2)).round(1)])
    asked = np.concatenate([np.zeros((3, 2)), np.full((2, 2), 100.0), r.normal(0, 1, (60, 2)).round(1)])
    schema = "id bigint, v array<double>"
    train, query = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], schema) for a in (points, asked))
    found = knn.nearest(train, query, "id", "v", 5, block_rows=16, chunk_rows=8, pivots=12)
    got = {}
    for row in found.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append(row["neighbor"])
    for i, q in enumerate(asked):
        d = np.sqrt(((points - q) ** 2).sum(1))
        assert got[i] == np.lexsort((np.arange(len(d)), d))[:5].tolist()


def test_a_row_group_in_many_parts_is_dealt(spark, tmp_path):
    """A file of one row group is cut into parts by its bytes, all but one of them empty."""
    spark.range(60000).selectExpr("id", "rand(1) AS x", "rand(2) AS y").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 4 and max(df.rdd.glom().map(len).collect()) == 60000
        assert max(ml_models._dealt(df, 60000).rdd.glom().map(len).collect()) < 30000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
