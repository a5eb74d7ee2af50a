import random
import zlib

import duckdb
import pytest
from test_bpe import ODD, library

from tabkit.llm import packing
from tabkit.llm.bpe import read_vocabulary
from tabkit.llm.queries import QUERIES, VOCABULARY


def check_sequences(rows, window):
    """Offsets gapless from 0, no sequence over the window; returns the sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sequences


def test_best_fit_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(30):
        window = rng.choice([1, 7, 64, 100])
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 200))), reverse=True)
        left, want = [], []
        for n in lengths:
            fits = [r for r in left if r >= n]
            room = min(fits, default=window)
            want.append(room)
            if fits:
                left.remove(room)
            left.append(room - n)
        placed = packing.best_fit(lengths, window)
        used = {}
        for (sequence, offset), n, room in zip(placed, lengths, want):
            assert offset == used.get(sequence, 0) and window - offset == room
            used[sequence] = offset + n
    with pytest.raises(ValueError):
        packing.best_fit([8], 7)


def test_query_on_whole_table(spark):
    docs = duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    ids = {i: [*tokens, 2] for (i, _), tokens in zip(docs, library([t for _, t in docs]))}
    rows = QUERIES["op1_packing"](spark, "/root/testdata/sf0.01").collect()
    pieces = {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc_id, found in pieces.items():
        found.sort()
        assert [s for s, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))]
        assert sum(n for _, n in found) == len(ids[doc_id])
    total = sum(map(len, ids.values()))
    assert len(check_sequences(rows, 4096)) <= -(-total // 4096) + 1


@pytest.mark.parametrize("per_task", [200_000, 5])
def test_sequences_hold_every_token_once(spark, per_task):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD * 2)] + [(None, None, 1)], "doc_id long, text string, offset int")
    packed = packing.pack(packing.pieces(df, VOCABULARY, window=32), window=32, pieces_per_task=per_task)
    rows = packed.collect()
    check_sequences(rows, 32)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed, window=32).collect()}
    ids = {i: [*t, 2] for i, t in enumerate(library(ODD * 2))} | {None: [2]}
    for r in rows:
        piece = b"".join(i.to_bytes(4, "little") for i in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert bytes(r["ids"]) == piece
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == piece
    assert all(len(s) == 4 * 32 for s in whole.values())
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


def test_rows_without_length_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 4, "a"), (2, None, "b"), (3, 0, "c"), (4, 4, None)], "doc_id long, length int, sequence_id string")
    packed = packing.pack(df, window=8)
    assert packed.columns == ["doc_id", "length", "sequence_id", "offset"]
    got = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in packed.collect()}
    assert got[2] == got[3] == (None, None)
    assert sorted([got[1], got[4]]) == [(got[1][0], 0), (got[1][0], 4)]


def test_clashing_names_keep_their_values(spark):
    names = ["_row", "_row_", "a.b", "_Length", "_group", "Offset", "length"]
    df = spark.createDataFrame([(f"u{i}", i, f"v{i}", -i, "g", "gone", 1 + i % 5) for i in range(30)], names)
    packed = packing.pack(df, window=8)
    assert packed.columns == [n for n in names if n != "Offset"] + ["sequence_id", "offset"]
    rows = packed.collect()
    assert sorted((r["_row_"], r["_row"], r["a.b"], r["_Length"]) for r in rows) == [(i, f"u{i}", f"v{i}", -i) for i in range(30)]
    for held in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == held)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(df, VOCABULARY)).count() == 0
    one = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert packing.pieces(one, VOCABULARY, end_id=None).count() == 0


def test_encoder_by_the_library_builds_no_trie():
    encoder = packing.packed_encoder(read_vocabulary(VOCABULARY))
    want = [b"".join(i.to_bytes(4, "little") for i in ids) for ids in library(ODD)]
    assert [b"".join(words) for words in encoder.by_word(ODD)] == want
    assert "trie" not in vars(encoder)
