import random
import tracemalloc

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import GroupedData

from tabkit.llm import substring_dedup, suffix_dedup, windows
from tabkit.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def odd_rows(seed, alphabet, n=60):
    """Short texts over few letters, with copies, overlaps, nulls, empty and long ones."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n // 2)]
    rows = []
    for doc_id in rng.sample(range(1000), n):
        a, b = rng.choice(pool), rng.choice(pool)
        cut = rng.randint(0, len(a))
        rows.append((doc_id, rng.choice([a, a + b, a[cut:] + b[:cut], "".join(rng.choice(alphabet) for _ in range(50))])))
    longest = "".join(rng.choice(alphabet) for _ in range(5000))
    return [*rows, (2000, None), (2001, ""), (2002, "a" * 300), (2003, longest), (2004, longest[1000:3000])]


@pytest.mark.parametrize("heavy_key", [50_000, 3])
@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abcdé "), (3, "a")])
def test_bytes_against_brute_force(spark, seed, alphabet, heavy_key):
    rows = odd_rows(seed, alphabet)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", tid string")
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(df, window=16, heavy_key=heavy_key).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), (n, removed, spans, kept) in zip(rows, brute.removed_bytes(rows, 16)):
        r = got[doc_id]
        assert (r["n_bytes"], n - len(r["kept"]), len(r["removed"]), bytes(r["kept"])) == (n, removed, spans, kept)


@pytest.mark.parametrize("heavy_key", [50_000, 3])
@pytest.mark.parametrize("seed, alphabet", [(1, "ab "), (2, "ab\t \n"), (3, "é  \x85\xa0")])
def test_words_against_brute_force(spark, seed, alphabet, heavy_key):
    rows = odd_rows(seed, alphabet)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", runs string")
    got = {r["doc_id"]: r for r in substring_dedup.digests(df, window=6, heavy_key=heavy_key).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), (n, removed, kept) in zip(rows, brute.removed_words(rows, 6)):
        r = got[doc_id]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, brute.sha(kept))


def test_fragments_of_heavy_keys_stay_out_of_buckets(spark, monkeypatch):
    dealt = []
    cogroup = GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: dealt.append(self._df) or cogroup(self, other))
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(20)) + shared[i % 2 :] + str(i)) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: len(r["kept"]) for r in suffix_dedup.dedup(docs, window=24, heavy_key=5).collect()}
    assert got == {i: n - removed for (i, _), (n, removed, _, _) in zip(rows, brute.removed_bytes(rows, 24))}
    (texts,) = dealt
    assert texts.groupBy("key").count().filter("count > 5").count() == 0


def test_long_texts_are_cut_between_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 64)
    rows = odd_rows(5, "ab c")
    for is_words, size in ((True, 6), (False, 16)):
        for _, text in rows:
            data = brute.text_of(text)
            units = data.split() if is_words else data
            seen = []
            for _, starts, counts, _, _, begin, stop in windows.Windows(size, 4, is_words).fragments([data]):
                for s, n, a, b in zip(starts, counts, begin, stop):
                    seen += range(s, s + n)
                    assert (data[a:b].split() if is_words else data[a:b]) == units[s : s + n + size - 1]
            assert sorted(seen) == list(range(max(0, len(units) - size + 1)))


def test_suffix_array_is_sorted():
    rng = random.Random(4)
    for _ in range(50):
        texts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(8, 60))) for _ in range(5)]
        wanted = [len(t) - 7 for t in texts]
        order = suffix_dedup.suffix_array(texts, wanted, 8)
        assert sorted(order) == [(i, j) for i, n in enumerate(wanted) for j in range(n)]
        keys = [texts[i][j : j + 8] for i, j in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("slices", [1, 3, 1 << 14])
def test_suffixes_sorted_in_parts(monkeypatch, slices):
    monkeypatch.setattr(suffix_dedup, "SLICES", slices, raising=False)
    rng = random.Random(7)
    for alphabet in (b"ab\xff", b"a", b"\x00a"):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(20, 60))) for _ in range(12)]
        wanted = [len(t) - 19 for t in texts]
        order = suffix_dedup.suffix_array(texts, wanted, 20)
        assert sorted(order) == [(i, j) for i, n in enumerate(wanted) for j in range(n)]
        keys = [texts[i][j : j + 20] for i, j in order]
        assert keys == sorted(keys)
        found = suffix_dedup.repeated_suffixes(texts, wanted, 20)
        assert [f.tolist() for f in found] == [[keys.count(t[j : j + 20]) > 1 for j in range(n)] for t, n in zip(texts, wanted)]


def test_memory_of_a_key_with_many_contexts():
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 123, 568, dtype=np.uint8).tobytes() for _ in range(2000)]
    texts = [t[:200] + texts[0][200:264] + t[264:] for t in texts]
    tracemalloc.start()
    found = suffix_dedup.repeated_suffixes(texts, [169] * 2000, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not any(f.any() for f in found)
    assert peak < 40e6


def test_repeated_rows_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, "other " + text), (None, text), (7, text + " tail"), (7, text)]
    df = spark.createDataFrame(rows, DOCS)
    words = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.digests(df).collect())
    assert words == [(-1, 40, 0), (5, 40, 40), (5, 40, 40), (5, 41, 40), (7, 40, 40), (7, 41, 40)]
    sizes = sorted((r["doc_id"] or -1, r["n_bytes"], len(r["kept"])) for r in suffix_dedup.dedup(df, window=50).collect())
    n = len(text)
    assert sizes == [(-1, n, 0), (5, n, 0), (5, n, 0), (5, n + 6, 6), (7, n, 0), (7, n + 5, 5)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert substring_dedup.digests(df).count() == 0
    assert suffix_dedup.dedup(df).count() == 0
    assert substring_dedup.dedup(df).columns == ["doc_id", "text"]


def test_cleaned_documents_keep_their_white_space(spark):
    run = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"a\n{run}\tb"), (2, f"c\t{run}\n\nd  e"), (3, f"x {run} "), (4, run), (5, None)]
    out = substring_dedup.dedup(spark.createDataFrame([(i, t, i) for i, t in rows], DOCS + ", _left long"))
    assert out.columns == ["doc_id", "text", "_left"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "c\td  e", 3: "x", 4: "", 5: None}


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op7_substring_dedup"])
def test_queries_on_whole_tables(spark, name):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    if name.startswith("op4"):
        # A window of 400 bytes by its hash; the brute count is over every place.
        for (i, _), (n, removed, spans, kept) in zip(rows, brute.removed_bytes(rows, 400)):
            r = got[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, brute.sha(kept))
    else:
        for (i, _), (n, removed, kept) in zip(rows, brute.removed_words(rows, 13)):
            r = got[i]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, brute.sha(kept))


def test_filter_passes_every_shared_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << windows.KEY_BITS, 5000))
    slice_size, bits = -(-(1 << windows.KEY_BITS) // 8), 1000
    pages = b""
    for owner in range(8):
        inside = keys[(keys // slice_size) == owner] - owner * slice_size
        page = np.zeros(bits, np.uint8)
        page[windows.bit_in_slice(inside.astype(np.uint64), slice_size, bits)] = 1
        pages += np.packbits(page).tobytes()
    assert windows.may_be_set(keys, {"bits_each": bits, "slice_size": slice_size, "pages": pages}).all()
