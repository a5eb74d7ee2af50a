import hashlib
import random
import string
import zlib

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tabkit.llm import merkle
from tabkit.llm.queries import ORACLES, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_siblings(levels, at):
    for level in levels[:-1]:
        start = at - at % 8
        yield "".join(level[start:at]), "".join(level[at + 1 : start + 8])
        at //= 8


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""

    def leaf(row):
        texts = [None if v is None else str(v) for v in row]
        return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))

    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_levels([r[2] for r in sorted(trees[lang], key=lambda r: r[:3])]) for lang in order}
    top = plain_levels([built[lang][-1][0] for lang in order])
    root, out = top[-1][0] if order else None, []
    for number, lang in enumerate(order):
        for at, (_, _, digest, row) in enumerate(sorted(trees[lang], key=lambda r: r[:3])):
            path = [*plain_siblings(built[lang], at), *plain_siblings(top, number)]
            fold = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                fold = leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in path:
                fold = sha(left + fold + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], digest, built[lang][-1][0], root, proof, fold, fold == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows, tmp_path, extra=""):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_merkle"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 1, "en": 8, "": 9, "é": 65}, {"en": 513, None: 512, "de": 4097}, {f"l{i}": 1 + i % 10 for i in range(80)}])
def test_against_plain(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows, doc_id = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc_id += rng.randint(1, 3)
            text = rng.choice([None, "", "ÄÖ nur Umlaute", "no capitals", "Some CAPITALS é", "x" * 5000])
            rows.append((doc_id, rng.choice([None, "", "web:1"]), lang, rng.choice([None, 5]), text))
    assert sorted(run(spark, rows, tmp_path), key=repr) == sorted(plain(rows), key=repr)


def test_nulls_repeats_and_large_ids(spark, tmp_path):
    rows = [(None, "s", "en", 1, "A")] * 2 + [(7, "s", "en", 1, "B")] * 9 + [(7, "s", "en", 1, "C"), ((1 << 62) + 1, None, None, None, None)]
    assert sorted(run(spark, rows, tmp_path), key=repr) == sorted(plain(rows), key=repr)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_proofs_and_extra_columns(spark):
    rows = [(i, "s", "en", 1, f"Text {i}", "p", "q", 3, 4) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA + ", pos string, digest string, n int, `known` int")
    got = merkle.manifest(df, claims={"text": F.lit("other")}, claimed=F.col("doc_id") == 5, with_proof=True).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [5]
    for r in got:
        assert merkle.folded(r["leaf"], r["proof"]) == r["root"]
        assert sha("".join(r["proof"])) == r["proof_sha256"]


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES["op13_merkle"](spark, sf), connect(sf), ORACLES["op13_merkle"])
