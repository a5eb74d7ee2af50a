import random

import duckdb
import numpy as np
import pytest

from tabkit.llm import jaccard
from tabkit.llm.components import components
from tabkit.llm.queries import QUERIES


def brute(rows, threshold=0.8, size=5):
    """(doc_id, class_id, n_links, n_text_links, copies) per row, by all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().split()
        n = max(1, len(words) - size + 1) if words else 0
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(n)))
    distinct = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    number = {s: i for i, s in enumerate(distinct)}
    holding = {}
    for s in distinct:
        for g in s:
            holding.setdefault(g, []).append(number[s])
    links = {i: set() for i in number.values()}
    for s in distinct:
        shared = {}
        for g in s:
            for j in holding[g]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != number[s] and n >= threshold * (len(s) + len(distinct[j]) - n) - 1e-9:
                links[number[s]].add(j)
    copies = {i: 0 for i in links}
    ids = {i: [] for i in links}
    for (doc_id, _), s in zip(rows, sets):
        if s:
            copies[number[s]] += 1
            ids[number[s]].append(doc_id)
    label = {}
    for start in links:
        if start not in label:
            seen, todo = {start}, [start]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            least = min(min(ids[i]) for i in seen)
            label.update({i: least for i in seen})
    out = []
    for (doc_id, _), s in zip(rows, sets):
        if not s:
            out.append((doc_id, doc_id, 0, 0, 1))
        else:
            i = number[s]
            out.append((doc_id, label[i], copies[i] - 1 + sum(copies[j] for j in links[i]), len(links[i]), copies[i]))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"], r["copies"]) for r in df.collect())


def near_copies(rng, words, n, changes):
    base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(120)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 10**6))
        yield " ".join(copy)


@pytest.mark.parametrize("block_sets", [1000, 7])
def test_classes_and_links_against_all_pairs(spark, block_sets):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [t for _ in range(6) for t in near_copies(rng, words, 12, 3)]
    texts += ["", None, "  \n", "one two", "one  two", "one two three four five", "a b"] + texts[:5]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, class_id string, head long")
    assert result(jaccard.join(df, block_sets=block_sets)) == brute(rows)


def test_query_on_whole_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert result(QUERIES["op5_jaccard"](spark, "/root/testdata/sf0.01")) == brute(rows)


def test_beginnings_are_shortened_until_the_recall_holds():
    depth = jaccard.shortened(0.8)
    assert jaccard.expected_recall(0.8, depth, jaccard.TREES) >= jaccard.RECALL
    assert depth == jaccard.DEPTH or jaccard.expected_recall(0.8, depth + 1, jaccard.TREES) < jaccard.RECALL
    assert jaccard.shortened(0.95) > depth


def test_forest_collides_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    forest, hits = jaccard.Forest(1, 64), []
    for _ in range(100):
        pool = rng.integers(1 << 62, size=100, dtype=np.uint64)
        hits.append((forest.nodes(pool[:90]) == forest.nodes(pool[10:])).mean())
    assert abs(np.mean(hits) - 0.8) < 0.02


def test_dedup_keeps_one_of_each_class(spark):
    rng = random.Random(2)
    texts = [t for _ in range(3) for t in near_copies(rng, ["u", "v"], 5, 1)] + ["", None, "solo text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a row without id"), (None, "a row without id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _dropped int")
    kept = jaccard.dedup(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 0, 5, 10, 15, 16, 17]


def test_components_of_long_paths_and_hubs(spark):
    rng = random.Random(9)
    nodes = rng.sample(range(10_000), 300)
    path, hub = nodes[:100], nodes[100:250]
    edges = list(zip(path, path[1:])) + [(hub[0], n) for n in hub[1:]] + [(nodes[250], nodes[250])]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(path) for n in path} | {n: min(hub) for n in hub}


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
