"""Whitening against numpy's own eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm.queries import op11_embedding_whitening
from notelake.llm.whitening import solve_right, whitened


def brute(vectors, first=8):
    """{row number: (deviation, whitened)} and explained, by whole numbers and one dense SVD."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    apart = n * x - s
    centred = apart.astype(float) / n
    _, single, axes = np.linalg.svd(centred, full_matrices=False)
    value = single**2 / n
    return [int(v) for v in (apart**2).sum(1)], centred @ axes[:first].T / np.sqrt(value[:first]), value[:first] / value.sum()


def check(spark, vectors, first=8):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    made = whitened(df, first).toPandas().sort_values(["vec_id", "component"])
    deviation, projected, explained = brute(vectors, first)
    k = projected.shape[1]
    assert len(made) == len(vectors) * k and set(made.n) == {len(vectors)}
    assert [int(v) for v in made.deviation[made.component == 1]] == deviation
    got = made.whitened.to_numpy().reshape(len(vectors), k)
    sign = np.sign((got * projected).sum(0))
    assert np.abs(got - sign * projected).max() < 1e-6
    assert np.allclose(made.explained[:k], explained, rtol=1e-9) and made.identity_error.iloc[0] < 1e-8


def test_equals_dense_svd(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(400, 12)) * np.linspace(0.1, 3, 12))
    check(spark, rng.normal(size=(300, 5)) * [1, 2, 3, 4, 5])
    check(spark, rng.normal(size=(200, 8)) * 10.0 ** np.arange(8) @ rng.normal(size=(8, 8)))  # ill-conditioned


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(50, 3)) * [2.0**44, 2.0**43, 2.0**42]
    made = whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), 1)
    got = {r.vec_id: None if r.deviation is None else int(r.deviation) for r in made.collect()}
    want = brute(vectors)[0]
    assert got == {i: v if v < 10**38 else None for i, v in enumerate(want)} and max(want) > 2**63


def test_query_on_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    deviation, projected, explained = brute([r.embedding for r in table])
    made = op11_embedding_whitening(spark, "/root/testdata/sf0.01").toPandas().sort_values(["vec_id", "component"])
    got = made.whitened.to_numpy().reshape(len(table), 8)
    sign = np.sign((got * projected).sum(0))
    assert made.deviation[made.component == 3].astype(int).tolist() == deviation
    assert np.abs(got - sign * projected).max() < 1e-7 and np.allclose(made.explained[:8], explained, rtol=1e-9)
    assert made.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("rank", [1, 3])
def test_directions_without_variance(spark, rank):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, size=(100, rank)) @ rng.integers(-3, 4, size=(rank, 6)) / 64
    made = whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>"), 8).toPandas()
    shown = made.groupby("component").agg(empty=("whitened", lambda v: v.isna().all()), explained=("explained", "first"))
    assert shown["empty"].tolist() == [False] * rank + [True] * (6 - rank) and shown.explained[rank + 1 :].eq(0).all()
    assert made.identity_error.iloc[0] < 1e-6


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (None, [0.5, -1.0], "c"), (2, None, "d"), (3, [], "e"), (4, [1.0, None], "f"), (5, [float("nan"), 1.0], "g"), (6, [float("inf"), 1.0], "h"), (7, [1.0], "i"), (8, [3.0, 1.0], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").withColumns({"n": F.lit("x"), "id": F.lit(0), "vector": F.lit(1)})
    made = whitened(df)
    assert sorted((r.vec_id or 0, r.component, r.n) for r in made.collect()) == sorted((i, c, 4) for i in (0, 1, 1, 8) for c in (1, 2))
    assert whitened(df.limit(0)).collect() == [] and whitened(df.limit(0)).columns == made.columns
    alone = whitened(df.filter("vec_id = 8")).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in alone] == [(None, None, None, 0)] * 2


def test_triangular_solve():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(70, 70))) + 10 * np.eye(70)
    q = rng.normal(size=(9, 70))
    assert np.allclose(solve_right(q @ r, r), q)
