"""Operator 12 against numpy's eigendecomposition and exact whole-number sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component double"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    """Entries as whole numbers, exact deviations, and the whitened rows up to the sign of each component."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    apart = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for _, x in kept])
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    values, turn = values[::-1], turn[:, ::-1]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}
    return n, exact, [i for i, _ in kept], apart @ turn / np.sqrt(np.maximum(values, 1e-300)), values


def check(got, vectors, k):
    n, exact, ids, white, values = brute(vectors)
    assert len(got) == n * k
    table = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(k):
        mine = np.array([table[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(mine - sign * white[:, j]).max() < 1e-7
        assert table[ids[0], j + 1]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
    assert all(r["n"] == n and r["deviation"] == exact[r["vec_id"]] for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize(("dims", "parts"), [(5, 1), (12, 40)])
def test_whitening_is_numpys(spark, dims, parts):
    rnd = np.random.default_rng(dims)
    vectors = [(i, list(rnd.normal(size=dims) @ np.diag(1 + np.arange(dims)) + 3)) for i in range(400)]
    vectors += [(900 + i, vectors[7][1]) for i in range(150)]  # one vector many times
    vectors += [(2000, None), (2001, []), (2002, [None] * dims), (2003, [math.nan] + [0.0] * (dims - 1)), (2004, [math.inf] * dims)]
    got = whitening.whiten(frame(spark, vectors, parts), components=4).collect()
    check(got, vectors, 4)


def test_more_components_than_dimensions_and_repeated_rows(spark):
    rnd = np.random.default_rng(2)
    vectors = [(i, list(rnd.normal(size=3))) for i in range(60)]
    df = frame(spark, vectors)
    got = whitening.whiten(df.unionAll(df)).collect()
    assert len(got) == 2 * 60 * 3 and {r["component"] for r in got} == {1, 2, 3}
    assert got[0]["n"] == 120 and got[0]["identity_error"] < 1e-9


def test_rank_deficient_rows(spark):
    rnd = np.random.default_rng(4)
    half = rnd.normal(size=(80, 2)).astype(np.float32)
    got = whitening.whiten(frame(spark, [(i, [a, b, a, b]) for i, (a, b) in enumerate(half.tolist())])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 2) for r in got)
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    assert got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("vectors", [[(1, [0.5, 2.0])], [(i, [1.0, -1.0]) for i in range(20)]])
def test_no_variance(spark, vectors):
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert len(got) == 2 * len(vectors) and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)


def test_empty_tables_other_lengths_and_null_ids(spark):
    df = frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (None, [0.0, 0.5]), (4, [1.0] * 7)])
    got = whitening.whiten(df)
    assert sorted({r["vec_id"] for r in got.collect()}, key=repr) == [1, 2, None]
    empty = whitening.whiten(df.where("false"))
    assert empty.count() == 0 and empty.schema == got.schema or [f.dataType for f in empty.schema] == [f.dataType for f in got.schema]
    assert whitening.whiten(df.where("vec_id = 99").unionAll(frame(spark, [(1, None)]))).count() == 0


def test_huge_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["deviation"] for r in got if r["vec_id"] < 3} == {None}
    # beside entries of 2^33 the second dimension's variance is under a double's precision
    assert all(math.isfinite(r["whitened"]) if r["component"] == 1 else r["whitened"] is None for r in got)


def test_spectra_by_rank_one_updates():
    """Merged spectra are those of numpy, also with repeated eigenvalues and directions left out."""
    rnd = np.random.default_rng(1)
    for rows in (rnd.normal(size=(90, 16)), np.eye(6)[rnd.integers(0, 6, 300)], np.tile(rnd.normal(size=(1, 5)), (40, 1)), rnd.normal(size=(3, 9)), np.repeat(rnd.integers(0, 2, (50, 1)), 4, axis=1).astype(float)):
        parts = [whitening.Spectrum.empty(rows.shape[1]) for _ in range(3)]
        for i, row in enumerate(rows):
            parts[i % 2].take(row)
        joint = parts[2]
        for p in parts[:2]:
            joint.merge(p)
        want = np.cov(rows.T, bias=True) * len(rows)
        assert joint.n == len(rows) and np.allclose(joint.mean, rows.mean(axis=0))
        assert np.allclose(joint.vectors * joint.values @ joint.vectors.T, want, atol=1e-9 * max(1, np.abs(want).max()))
        assert np.allclose(joint.vectors.T @ joint.vectors, np.eye(rows.shape[1]), atol=1e-10)


def test_query(spark, tmp_path):
    rnd = np.random.default_rng(8)
    vectors = [(i, rnd.normal(size=64).astype(np.float32).tolist()) for i in range(300)]
    frame(spark, vectors).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.queries()["op12_embedding_whitening"](spark, str(tmp_path))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), vectors, 32)
    # the measured error is that of the returned rows
    wide = np.array([r[0] for r in got.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("component", "whitened"))).alias("w")).select(F.col("w.whitened")).collect()])
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-8
