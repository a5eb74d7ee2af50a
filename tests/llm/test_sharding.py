import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tabkit.llm import sharding
from tabkit.llm.queries import QUERIES


def check_slots(rows):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for held in shards.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return {s: sum(r["size"] for r in held) for s, held in shards.items()}


def test_query_is_near_equal(spark):
    rows = QUERIES["op9_sharding"](spark, "/root/testdata/sf0.1").collect()
    docs = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    sizes = check_slots(rows)
    assert sorted(sizes) == list(range(8))
    assert max(sizes.values()) < 1.01 * min(sizes.values())


def shard(df, **how):
    return sharding.kd_shards(
        df, F.col("n"), {"a": F.col("a"), "b": F.col("b")}, F.xxhash64("t"), F.col("id"), **how
    )


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_hot_value_is_split(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.randint(1, 100), 5 if i < 1500 else rng.randint(0, 9), None if i % 3 else i, "same" if i < 1500 else str(i)) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, "id long, n int, a int, b int, t string"), shards=shards).collect()
    sizes = check_slots(got)
    assert len(got) == 3000 and sorted(sizes) == list(range(shards))
    assert max(sizes.values()) - min(sizes.values()) <= 400


def test_target_bytes_and_repeated_rows(spark):
    rows = [(7, 10, 1, 1, "x")] * 500
    got = shard(spark.createDataFrame(rows, "id long, n int, a int, b int, t string"), target_bytes=700).collect()
    sizes = check_slots(got)
    assert max(sizes.values()) <= 700 and sum(sizes.values()) == 5000


def test_nulls_clashing_names_and_small_tables(spark):
    schema = "id long, n int, a int, b int, t string, shard string, size string"
    got = shard(spark.createDataFrame([(None, None, None, None, None, "s", "z")], schema), shards=4)
    assert got.columns == ["id", "n", "a", "b", "t", "size", "shard", "slot"]
    assert [(r["size"], r["slot"]) for r in got.collect()] == [(0, 0)]
    assert shard(spark.createDataFrame([], schema), shards=4).count() == 0
    assert shard(spark.createDataFrame([], schema), target_bytes=10).count() == 0


def test_equal_texts_stay_together(spark):
    rows = [(i, 10, i % 50, 0, f"text {i % 50}") for i in range(1000)]
    got = shard(spark.createDataFrame(rows, "id long, n int, a int, b int, t string"), shards=2).collect()
    places = {}
    for r in got:
        places.setdefault(r["t"], set()).add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 1


def test_clashing_names_keep_their_values(spark):
    names = ["_tie", "_node", "_id", "_row", "_d0", "_c0", "user 0", "a.b", "Size", "Shard", "n", "a", "b", "t", "id"]
    df = spark.createDataFrame([(*[f"{c}{i}" for c in names[:10]], 1 + i % 7, i % 3, i, f"t{i}", i) for i in range(200)], names)
    placed = shard(df, shards=4)
    assert placed.columns == [n for n in names if n not in ("Size", "Shard")] + ["size", "shard", "slot"]
    rows = placed.collect()
    assert sorted(r["id"] for r in rows) == list(range(200))
    assert all(r[c] == f"{c}{r['id']}" for r in rows for c in names[:8])
    assert sorted(check_slots(rows)) == list(range(4))
