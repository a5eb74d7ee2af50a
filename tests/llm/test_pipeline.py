import corpus_pipeline
import duckdb
import pytest
from test_jaccard import brute as classes

from tabkit.session import stage

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage is given and returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(kept, spark):
    want = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, (_, after) in kept.items():
        if name != "packing":
            assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in want]


def test_toxic_documents_go(kept):
    before, after = (rows(x) for x in kept["toxicity"])
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    gone = before.keys() - after.keys()
    assert sum(labels[i] for i in gone if i in labels) >= 0.6 * sum(labels.values())
    assert sum(1 - labels[i] for i in gone if i in labels) <= 0.01 * len(labels)


def test_one_copy_stays(kept):
    before, after = (rows(x) for x in kept["exact_dedup"])
    groups = {}
    for i, t in before.items():
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(i)
    assert after.keys() == {max(g) for g in groups.values()}


def test_one_of_each_class_stays(kept):
    before, after = (rows(x) for x in kept["near_dedup"])
    assert after.keys() == {c for _, c, *_ in classes(list(before.items()))}


def test_repeated_passages_are_cut(kept):
    import brute

    before, after = (rows(x) for x in kept["substring_dedup"])
    ordered = sorted(before.items())
    for (i, text), (_, removed, left) in zip(ordered, brute.removed_words(ordered, 13)):
        assert after[i].encode().split() == left.split()
        if not removed:
            assert after[i] == text
    chars = {r["doc_id"]: r["n_chars"] for r in kept["substring_dedup"][1].collect()}
    assert chars == {i: len(t) for i, t in after.items()}


def test_packing_holds_all_tokens(kept):
    from test_bpe import library
    from test_packing import check_sequences

    before, packed = rows(kept["packing"][0]), kept["packing"][1].collect()
    check_sequences(packed, 4096)
    ids = {i: [*t, 2] for i, t in zip(before, library([t or "" for t in before.values()]))}
    found = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(int.from_bytes(r["ids"][j : j + 4], "little") for j in range(0, len(r["ids"]), 4))
    assert found == ids


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept["packing"][1].count()
