import itertools
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tabkit.llm import bpe, frames, toxicity
from tabkit.llm.queries import QUERIES


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    chain = rng.normal(size=(2, 2))
    lengths = [3, 0, 5, 1]
    emissions = rng.normal(size=sum(lengths))
    at = np.concatenate(([0], np.cumsum(lengths)))
    marginal, pairs = toxicity.forward_backward(emissions, at, chain)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:]):
        total, sums, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e for e, l in zip(emissions[a:b], y) if l) + sum(chain[p, q] for p, q in zip(y, y[1:])))
            total += w
            sums += w * np.array(y)
            for p, q in zip(y, y[1:]):
                joint[p, q] += w
        if b > a:
            assert np.allclose(marginal[a:b], sums / total)
            want_pairs += joint / total
    assert np.allclose(pairs, want_pairs)


def test_features_are_words_and_beginnings():
    data, _, starts, ends, _ = toxicity.read_tokens(["Idiots, idiot!", "ÉTÉ été"])
    f = toxicity.token_features(data, starts, ends)
    assert len(f) == 4 and f[0, 0] != f[1, 0]
    assert (f[0, 1:4] == f[1, 1:4]).all() and (f[2] == f[3]).all()


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()}


def test_held_out_accuracy(scored):
    labels = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    held = [(scored[i]["score"], t) for i, t in labels.items() if scored[i]["held_out"]]
    hits = sum((s >= 0.5) == bool(t) for s, t in held)
    # Here some toxic labels stand on texts without any toxic word.
    assert len(held) > 500 and hits >= 0.95 * len(held)
    assert sum(s >= 0.5 for s, t in held if t) >= 0.7 * sum(t for _, t in held)
    assert sum(s >= 0.5 for s, t in held if not t) <= 0.01 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in scored.values())


def test_held_out_rows_are_by_crc(scored):
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())


def small_model():
    rng = random.Random(1)
    words = ["calm", "river", "stone", "green", "walk"]
    texts, toxic = [], []
    for i in range(80):
        body = [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(30)]
        if i % 2:
            body.insert(rng.randrange(30), "Nasty" + rng.choice("abc"))
        texts.append(" ".join(body))
        toxic.append(i % 2)
    return toxicity.train(texts, np.array(toxic) == 1)


def test_spans_and_odd_texts(spark):
    model = small_model()
    texts = ["été 😀 NASTYz, nastya river", "calm river", "", None, "river " * 30_000 + "nastyb", "  \n"]
    df = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(texts)] + [(None, "nastya", 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    spans = got[0]["spans"]
    assert [texts[0][s["start"] : s["end"]].lower().startswith("nasty") for s in spans] and spans
    assert [r["predicted"] for r in (got[0], got[1], got[2], got[3], got[4], got[5], got[None])] == [1, 0, 0, 0, 1, 0, 1]
    assert not got[None]["held_out"]
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5]


def test_near_copies_are_one_witness():
    base = " ".join(f"w{i}" for i in range(100))
    least = []
    for text in (base, base + " tail", "something else entirely, not alike", ""):
        data, _, starts, ends, _ = toxicity.read_tokens([text])
        least.append(toxicity.least_runs(toxicity.token_features(data, starts, ends)[:, 0]))
    assert list(toxicity.related(least)) == [0, 0, 2, 3]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, model).collect())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_known_features_are_found_in_little_memory():
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 12, 3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 6000)) for _ in range(80)] + ["x" * 300_000, ""]
    data, _, starts, ends, token_at = toxicity.read_tokens(texts)
    hashes = toxicity.token_features(data, starts, ends)
    known = np.unique(hashes[::997, 0])
    model = toxicity.Model(known[known != 0], rng.normal(size=np.count_nonzero(known)), -2.0, np.zeros((2, 2)), np.zeros(3))
    want, size = model.ids(hashes), hashes.nbytes
    del hashes
    tracemalloc.start()
    rows, ids = model.find(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows == want[0]).all() and (ids == want[1]).all() and len(rows)
    assert peak < size / 2
    emissions = model.emissions(len(starts), rows, ids)
    assert (model.marginals(emissions, token_at) == toxicity.forward_backward(emissions, token_at, model.chain)[0]).all()


def test_tidied_tasks_let_go_of_the_caches_of_other_operators(spark):
    count = frames.tidied(lambda batches: iter([len(frames.WORKER_CACHES)]))

    def run(batches):
        list(batches)
        bpe.per_worker(len, "a vocabulary")
        held = len(frames.WORKER_CACHES)
        yield pa.RecordBatch.from_pydict({"held": pa.array([held]), "left": pa.array([*count([])])})

    found = spark.range(1).coalesce(1).mapInArrow(run, "held long, left long").first()
    assert found["held"] > 0 and found["left"] == 0
