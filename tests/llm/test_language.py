import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabkit.llm import language
from tabkit.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def plain_characters(text):
    """Words of letters with their marks, one blank after each."""
    out = ""
    for c in text.lower() + " ":
        group = unicodedata.category(c)[0]
        if group == "L" or group == "M" and out and out[-1] != " ":
            out += c
        elif out and out[-1] != " ":
            out += " "
    return out


class PlainModel:
    """Interpolated Kneser-Ney by the book, over dictionaries."""

    def __init__(self, texts, order):
        counts = Counter()
        for text in texts:
            padded = " " * (order - 1) + plain_characters(text)
            counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts = {}
        for k, c in self.counts.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discounts[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.5
        self.order = order

    def probability(self, context, char, alphabet, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / alphabet
        context = context[len(context) - (k - 1) :]
        lower = self.probability(context[1:], char, alphabet, k - 1)
        followers = {g: c for g, c in self.counts[k].items() if g[:-1] == context}
        if not followers:
            return lower
        total, d = sum(followers.values()), self.discounts[k]
        return max(0, followers.get(context + char, 0) - d) / total + d * len(followers) / total * lower

    def entropy(self, text, alphabet):
        chars = plain_characters(text)
        padded = " " * (self.order - 1) + chars
        return -sum(math.log(self.probability(padded[i : i + self.order - 1], c, alphabet)) for i, c in enumerate(chars)) / len(chars)


LEARNED = {
    "en": ["the cat sat on the mat", "The thin thief, 3 the thorns!", "that is all; that was it"],
    "de": ["die Katze saß auf der Matte", "Über den Dächern der Stadt", "das ist alles"],
    "हि": ["हिन्दी में लिखा", "यह एक वाक्य है"],
}
ASKED = ["the mat", "Dächer", "xyz", "में है", "a", "été", "THE 1 cat?", " x " * 40]


def rows_of(learned):
    """Ids that are not held out."""
    ids = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    return [(next(ids), text, lang) for lang, texts in learned.items() for text in texts]


def test_entropies_against_plain(spark):
    model = language.fit(spark.createDataFrame(rows_of(LEARNED), SCHEMA).repartition(3))
    plain = {lang: PlainModel(texts, 4) for lang, texts in LEARNED.items()}
    assert set(model.languages) == set(plain)
    alphabet = len({g for p in plain.values() for g in p.counts[1]}) + 1
    assert model.alphabet == alphabet
    sizes, entropies = language.Scorer(model).entropies(ASKED)
    assert sizes.tolist() == [len(plain_characters(t)) for t in ASKED]
    want = [[plain[lang].entropy(t, alphabet) for t in ASKED] for lang in model.languages]
    np.testing.assert_allclose(entropies, want, rtol=1e-4)


def test_probabilities_sum_to_one(spark):
    for most in (language.MOST_GRAMS, 60):
        model = language.fit(spark.createDataFrame(rows_of(LEARNED), SCHEMA), most_grams=most)
        chars = sorted({c for texts in LEARNED.values() for t in texts for c in plain_characters(t)})
        for context in ("   ", "the", " da", "qqq"):
            codes = np.concatenate([np.frombuffer((context + c).encode("utf-32-le"), np.uint32) for c in [*chars, "一"]])
            ends = np.arange(3, len(codes), 4)
            for number in range(len(model.languages)):
                assert model.probabilities(codes, ends, number).sum() == pytest.approx(1, abs=1e-4)
    assert sum(len(t[0]) for tables in model.tables for t in tables) < 150


def test_memory_of_a_scorer_is_bounded(spark):
    model = language.fit(spark.createDataFrame(rows_of(LEARNED), SCHEMA))
    all_at_once = language.Scorer(model).entropies(ASKED)
    small = language.Scorer(model)
    small.most = 5
    for i, text in enumerate(ASKED * 3):
        sizes, entropies = small.entropies([text])
        assert sizes[0] == all_at_once[0][i % len(ASKED)]
        np.testing.assert_allclose(entropies[:, 0], all_at_once[1][:, i % len(ASKED)], rtol=1e-6)


def test_undetermined_nulls_and_repeats(spark):
    docs = rows_of(LEARNED) + [(None, "the cat", None), (-1, None, "en"), (-2, "", None), (-3, "12 !? ́", None), (-4, "the", None), (-4, "die Dächer", None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", score int, `Accepted` string")
    got = language.identify(df, language.fit(df)).collect()
    assert len(got) == len(docs)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[None][0]["lang"] == "en"
    for i in (-1, -2, -3):
        assert tuple(by_id[i][0])[1:] == ("und", 0.0, False, None)
    assert sorted(r["lang"] for r in by_id[-4]) == ["de", "en"]
    for r in got:
        assert 0 <= r["score"] <= 1


def test_no_language_and_no_rows(spark):
    df = spark.createDataFrame([(0, "text", None), (1, "text", None)], SCHEMA)
    model = language.fit(df)
    assert {tuple(r)[1:] for r in language.identify(df, model).collect()} == {("und", 0.0, False, None)}
    assert language.identify(df.limit(0), model).collect() == []


def test_held_out_rows_are_not_learned(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    df = spark.createDataFrame([*rows_of({"en": ["the cat"]}), (out, "die Katze", "de")], SCHEMA)
    assert language.fit(df).languages == ["en"]


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_language"](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and {r["lang_pred"] for r in rows} <= {*docs.values(), "und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    told = [(r["lang_pred"] == docs[r["doc_id"]], r["accepted"]) for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert sum(hit for hit, _ in told) > 0.99 * len(told)
    assert sum(ok for _, ok in told) > 0.95 * len(told)


def test_foreign_text_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = [(i, "".join(chr(0x430 + (i * 7 + j * j) % 32) if j % 6 else " " for j in range(400)), None) for i in range(20)]
    got = language.identify(spark.createDataFrame(strange, SCHEMA), language.fit(docs)).collect()
    assert not any(r["accepted"] for r in got)


def test_calibration_covers_all_learned_rows(spark, monkeypatch):
    seen, calibrated = [], language.calibrated
    monkeypatch.setattr(language, "calibrated", lambda model, rows, *rest: seen.append(rows.count()) or calibrated(model, rows, *rest))
    texts = [(i, "the cat sat" if i % 2 else "le chat est", "en" if i % 2 else "fr") for i in range(8000)]
    language.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(8000))]


def small_model():
    """Two languages over eight letters, with hashes that the model itself makes."""
    grams = [(lang, k, lang[0] * (k - 1) + c, 0.1) for lang in ("ab", "cd") for k in (1, 2, 3, 4) for c in "abcdefgh "]
    return language.assemble(pa.table(dict(zip(("lang", "k", "gram", "alpha"), zip(*grams)))), 4)


def test_grams_met_before_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh "), 500)) for _ in range(40)]
    scorer = language.Scorer(small_model())
    first = scorer.entropies(texts)
    sorted_places, unique = [], np.unique
    monkeypatch.setattr(language.np, "unique", lambda x, **kw: sorted_places.append(len(x)) or unique(x, **kw))
    again = scorer.entropies(texts[::-1])
    assert sum(sorted_places) == 0
    assert (again[0][::-1] == first[0]).all()
    np.testing.assert_allclose(again[1][:, ::-1], first[1], rtol=1e-12)


@pytest.mark.parametrize("memory, slots, block, costs", [(1 << 10, 4, 64, 1), (1 << 17, 4, 1000, 999), (1 << 25, 4, 1, 1 << 20)])
def test_any_table_and_block_gives_the_same(monkeypatch, memory, slots, block, costs):
    rng = np.random.default_rng(4)
    texts = ["", "  ", *("".join(rng.choice(list("abcdefghxyz "), n)) for n in (1, 5, 3000, 1, 700)), "12"]
    model = small_model()
    codes, owner = language.characters(texts, 4)
    ends = np.flatnonzero(owner >= 0)
    each = [-np.log(model.probabilities(codes, ends, number)) for number in range(2)]
    want = [np.bincount(owner[ends], c, minlength=len(texts)) / np.maximum(1, np.bincount(owner[ends], minlength=len(texts))) for c in each]
    for name, value in (("MEMORY", memory), ("FIRST_SLOTS", slots), ("BLOCK", block), ("COSTS", costs)):
        monkeypatch.setattr(language, name, value)
    scorer = language.Scorer(model)
    for _ in range(2):
        sizes, entropies = scorer.entropies(texts)
        assert sizes.tolist() == np.bincount(owner[ends], minlength=len(texts)).tolist()
        np.testing.assert_allclose(entropies, want, rtol=1e-6)
        assert scorer.costs.nbytes + scorer.keys.nbytes <= max(memory, 4 * 16)


def test_lookups_at_once_do_not_follow_length_or_languages(monkeypatch):
    seen, costs = [], language.Scorer._costs
    monkeypatch.setattr(language, "COSTS", 1000)
    monkeypatch.setattr(language.Scorer, "_costs", lambda self, *args: seen.append(costs(self, *args)) or seen[-1])
    language.Scorer(small_model()).entropies(["abc def gh " * 1000, "abc"])
    assert max(x.size for x in seen) <= 1000 and sum(len(x) for x in seen) == 11004


@pytest.mark.parametrize("most", [1, 60, 250, 400])
def test_a_model_beyond_memory_leaves_no_gram_out(spark, most):
    asked = [(-1 - i, text, None) for i, text in enumerate([*ASKED, None, "", "12", "the cat " * 300, "the mat"])]
    docs = spark.createDataFrame(rows_of(LEARNED) + asked, SCHEMA).repartition(3)
    whole, model = language.fit(docs), language.fit(docs, most_grams=most)
    assert (model.temperature, model.least_score, model.ceilings) == (whole.temperature, whole.least_score, whole.ceilings)
    want = {r["doc_id"]: r for r in language.identify(docs, whole).collect()}
    got = language.identify(docs, model).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == len(want) == docs.count()
    for r in got:
        w = want[r["doc_id"]]
        assert (r["lang"], r["accepted"]) == (w["lang"], w["accepted"])
        assert r["score"] == pytest.approx(w["score"], rel=1e-4)
        assert r["cross_entropy"] == (None if w["cross_entropy"] is None else pytest.approx(w["cross_entropy"], rel=1e-5))
    plain = {lang: PlainModel(texts, 4) for lang, texts in LEARNED.items()}
    found = {r["doc_id"]: r["cross_entropy"] for r in got}
    for i, text in enumerate(ASKED):
        assert found[-1 - i] == pytest.approx(min(p.entropy(text, model.alphabet) for p in plain.values()), rel=1e-4)
    assert whole.rest is None and 1 <= model.held < 4
    held = sum(len(t[0]) for tables in model.tables for t in tables)
    rest = sum(len(r["alphas"]) for r in model.rest.alphas.collect())
    assert held <= most or model.held == 1
    assert held + rest == sum(len(t[0]) for tables in whole.tables for t in tables)
    assert len(model.frequent[0]) <= max(1, most * 24 // 20)
