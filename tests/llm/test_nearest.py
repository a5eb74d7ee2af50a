import duckdb
import numpy as np
import pytest

from tabkit.llm import nearest
from tabkit.llm.queries import QUERIES


def brute(ids, x, query_ids, k=10):
    out = {}
    for q in query_ids:
        d = np.sqrt(np.square(x - x[ids == q][0]).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hadamard_turns_without_stretching():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = nearest.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(nearest.hadamard(y), x)


def test_nearest_probe_is_the_own_bucket():
    x = np.random.default_rng(2).normal(size=(50, 12))
    tables = nearest.Tables(12, 3, 2)
    for t in range(3):
        probes = tables.probes(x, t, 20)
        assert (probes[:, 0] == tables.buckets(x, t)).all()
        assert all(len(set(p)) == 20 for p in probes)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}'").fetchnumpy()
    ids, x = e["vec_id"], np.stack(e["embedding"]).astype(float)
    want = brute(ids, x, ids[ids % 100 == 0])
    got = by_query(QUERIES["op6_nearest"](spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert len(found) == 10
        for i, score in found:
            assert score == pytest.approx(np.linalg.norm(x[ids == i][0] - x[ids == q][0]), abs=1e-12)


def test_many_buckets_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[300:800] = x[300]
    ids = np.arange(1500) * 5
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, table int")
    want = brute(ids, x, ids[ids % 100 == 0])
    got = by_query(nearest.search(df))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    hot = [q for q in want if want[q][-1][1] == 0]
    assert hot and all(got[q] == want[q] for q in hot)


@pytest.mark.parametrize("most, tables", [(4, 8), (1, 1)])
def test_recall_beyond_the_most_probes(spark, monkeypatch, most, tables):
    monkeypatch.setattr(nearest, "ROWS_PER_BUCKET", 4)
    monkeypatch.setattr(nearest, "MOST_PROBES", most)
    x = np.random.default_rng(4).normal(size=(1200, 16))
    ids = np.arange(1200) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = brute(ids, x, ids[ids % 100 == 0])
    got = by_query(nearest.search(df, tables=tables))
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_queries_with_few_answers_are_completed(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_BUCKET", 2)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 4)
    x = np.random.default_rng(5).normal(size=(400, 8))
    ids = np.arange(400) * 50
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids[:380], x[:380])], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id < 500")
    got = by_query(nearest.search(df, asked, tables=1, probes=1))
    want = brute(ids[:380], x[:380], ids[:10])
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in want[q]] for q in want}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (100, [0.0, 0.0])]
    rows += [(4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (200, [2.0, 0.0]), (None, [1.0, 1.0])]
    got = by_query(nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {
        0: [(1, 0.0), (200, 1.0), (2, pytest.approx(2**0.5))],
        200: [(0, 1.0), (1, 1.0), (2, pytest.approx(5**0.5))],
    }


def test_empty(spark):
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
