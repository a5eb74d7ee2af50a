import hashlib
import math

import numpy as np
import pytest
from oracle import compare, connect

from tabkit.llm import quantise
from tabkit.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("size", [1, 4, 7])
@pytest.mark.parametrize("spread", [2, 60, 1 << 24])
def test_tree_finds_the_nearest(size, spread):
    rng = np.random.default_rng(size)
    for count in (1, 3, 13, 64, 200):
        entries = rng.integers(-spread, spread + 1, (count, size))
        points = np.concatenate([rng.integers(-spread, spread + 1, (500, size)), entries])
        at, best = quantise.nearest_entries(points, entries, quantise.build(entries))
        every = quantise.squared(points, entries)
        assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_tree_of_equal_entries():
    entries = np.full((64, 4), 9)
    entries[40:] = 8
    at, best = quantise.nearest_entries(np.array([[9, 9, 9, 9], [0, 0, 0, 0]]), entries, quantise.build(entries))
    assert at.tolist() == [0, 40] and best.tolist() == [0, 256]


def test_tree_leaves_subtrees_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (8, 4))
    entries = (centres[:, None] + rng.integers(-20, 20, (8, 8, 4))).reshape(64, 4)
    points = entries[rng.integers(0, 64, 1000)] + rng.integers(-5, 5, (1000, 4))
    visits = []
    quantise.nearest_entries(points, entries, quantise.build(entries), visits)
    assert sum(visits) < 0.4 * len(points) * len(entries)


def test_bounds_hold():
    squares = np.array([0, 1, 2, 3, (1 << 53) + 1, (1 << 60) + 7], np.int64)
    for s, low, high in zip(squares.tolist(), quantise.root_below(squares), quantise.root_above(squares)):
        assert int(low * 2**20) ** 2 <= s << 40 and int(math.ceil(high * 2**20)) ** 2 >= s << 40


def plain(rows, parts, entries, rounds, scale=256):
    """rows: (vec_id, vector, label), ids distinct"""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept], default=0) // parts)
    cut = {i: [(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, piece):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for i in cut:
                held.setdefault(nearest(p, cut[i][p])[1], []).append(cut[i][p])
            moved = {n: [sum(c) // len(group) for c in zip(*group)] for n, group in held.items()}
            books[p] = [moved.get(n, e) for n, e in enumerate(books[p])]
    found = {i: [nearest(p, cut[i][p]) for p in range(parts)] for i in cut}
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    sums = {}
    for i, _, label in kept:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in found[i])
    return sorted((i, "".join(f"{n:02x}" for _, n in found[i]), sum(d for d, _ in found[i]), sums[label], sha) for i, _, label in kept)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_plain(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        vector = rng.normal(0, 0.5, 12).astype(np.float32).tolist()
        rows.append((i * 7 - 900, vector if i % 9 else rows[-1][1] if rows else vector, None if i % 3 else i % 5))
    rows += [(5001, None, 1), (5002, [None] * 12, 1), (5003, [math.nan] + [0.0] * 11, 1), (5004, [math.inf] * 12, 1)]
    rows += [(-5000, [], 7), (5006, [1.0] * 5, None)]
    got = quantise.codes(spark.createDataFrame(rows, SCHEMA).repartition(4), parts=4, entries=20, rounds=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 4, 20, 2)


def test_fewer_rows_than_entries_and_repeated_ids(spark):
    rows = [(2, [1.0, 2.0], 1), (1, [3.0, -4.0], 1), (1, [3.0, -4.5], 1), (None, [0.0, 0.0], 1)]
    got = quantise.codes(spark.createDataFrame(rows, SCHEMA), parts=2).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["code"], r["error"]) for r in got) == [
        (False, 1, "0000", 0),
        (False, 1, "0001", 0),
        (False, 2, "0202", 0),
        (True, None, "0303", 0),
    ]


def test_huge_components_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], 1, 2, "x"), (2, [0.0, 0.0], 1, 2, "x")], SCHEMA + ", error int, `Code` string")
    assert [r["error"] for r in quantise.codes(df, parts=2).collect()] == [0, 0]
    assert [r["error"] for r in quantise.codes(df, parts=2, entries=1, rounds=0).orderBy("vec_id").collect()] == [0, 2 << 48]
    assert quantise.codes(df.limit(0)).collect() == []


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES["op11_codes"](spark, sf), connect(sf), ORACLES["op11_codes"])
