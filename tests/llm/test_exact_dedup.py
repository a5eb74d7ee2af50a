import random
import string

import numpy as np
import pytest
from oracle import compare, connect

from tabkit.llm import exact_dedup
from tabkit.llm.queries import ORACLES, QUERIES


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for limit in (1, 50, 1 << 20, 1 << 45):
            values = np.unique(rng.integers(0, limit, n)).astype(np.uint64)
            k, unary, rest = exact_dedup.rice_encode(values, limit)
            assert (exact_dedup.rice_decode(len(values), k, unary, rest) == values).all()
    dense = np.unique(rng.integers(0, 1 << 45, 10_000)).astype(np.uint64)
    _, unary, rest = exact_dedup.rice_encode(dense, 1 << 45)
    assert len(unary) + len(rest) < 0.6 * dense.nbytes


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES["op3_exact_dedup"](spark, sf), connect(sf), ORACLES["op3_exact_dedup"])


def plain(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(lower), []).append(doc_id)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("per_message", [500_000, 3])
def test_small_tables(spark, monkeypatch, per_message):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_MESSAGE", per_message)
    rng = random.Random(4)
    texts = ["", None, "Éa", "éa", "ABC", "abc", "long " * 5000, "LONG " * 5000, "ß", "ẞ", "K", "k"]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, "abc"), (None, "only"), (None, "only"), (7, "other")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, sha binary").repartition(7)
    got = exact_dedup.duplicates(df).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == plain(rows)


def test_dedup_keeps_columns_and_rows(spark):
    rows = [(1, "A", 1), (2, "a", 2), (3, None, 3), (4, "", 4), (None, "b", 5), (None, "c", 6), (5, "C", 7)]
    kept = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, _dropped long"))
    assert kept.columns == ["doc_id", "text", "_dropped"]
    assert sorted(r["_dropped"] for r in kept.collect()) == [2, 4, 5, 7]


def test_filter_keeps_what_is_wanted(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    wanted = spark.range(0, 5000, 50).withColumnRenamed("id", "w")
    left = {r["k"] for r in exact_dedup.semi_reduce(rows, "k", wanted, "w").collect()}
    assert left >= set(range(0, 5000, 50)) and len(left) < 1000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicates(df).count() == 0
    assert exact_dedup.dedup(df).count() == 0
