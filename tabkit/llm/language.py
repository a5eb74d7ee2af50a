"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and read as words: runs of letters (with their marks), each followed
by one blank; everything else only separates words. A model of order 4 for each language
gives every character a probability from the three before it.

Training counts over all rows it may learn from: tasks fold the character 4-grams of their
texts, Spark adds them up, and each lower order counts in how many ways its grams are
continued to the left (Kneser-Ney). Discounts come from the counts of counts, a language
and order each. Of every order a model keeps two sorted arrays of 64-bit hashes: grams with
their discounted probability, and contexts with the mass left for the order below.

No gram is left out. Of a model with more than ``most_grams`` the lower orders that fit are
held in memory, the others stay tables. The costs of learned grams then come from joins with
these, once, and those of the most frequent go to all tasks. What a text holds beyond them is
joined with the others, distinct grams with their counts, and added to the text's own sum.

The language of lowest cross-entropy per character wins. Its probability has a temperature
that is calibrated on all learned documents, and so are the limits below which the answer is
rejected: the probability, and the cross-entropy that texts of the language itself reach.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.llm.frames import chunks, record_batch
from tabkit.session import stage

ORDER = 4
#: Grams that a model holds in memory, all languages and orders together: 24 bytes a gram,
#: so a broadcast of 48 MB at most. The orders beyond it stay tables, and the costs of
#: frequent grams get as many bytes.
MOST_GRAMS, GRAM_BYTES = 2_000_000, 24
#: Grams a counting task holds before it passes them on, and how many at once.
GRAMS_PER_MESSAGE, GRAMS_PER_BATCH = 1_000_000, 1 << 16
#: Bytes of log-probabilities a scoring task remembers, and the slots it begins with.
MEMORY, FIRST_SLOTS = 32 << 20, 1 << 12
#: Characters a scoring task works on at once (longer texts are not cut), and costs it
#: looks up at once, all languages together.
BLOCK, COSTS = 1 << 18, 1 << 20
TEMPERATURES = [2.0 ** (i / 2) for i in range(17)]
SCORE_BINS, ENTROPY_BINS, ENTROPY_STEP = 200, 400, 0.05
LEAST_MASS = 1e-9
BLANK = 0x20
UNDETERMINED = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: What a code point is: 0 unknown yet, 1 neither, 2 a mark, 3 a letter.
_KINDS = np.zeros(0x110000, np.uint8)


def kinds(codes: np.ndarray) -> np.ndarray:
    found = _KINDS[codes]
    if not found.all():
        for code in np.unique(codes[found == 0]).tolist():
            group = unicodedata.category(chr(code))[0]
            _KINDS[code] = 3 if group == "L" else 2 if group == "M" else 1
        found = _KINDS[codes]
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, ``order - 1`` blanks before each, and the text number
    of each character (-1 for those blanks). A text without letters has no characters."""
    lower = [t.lower() for t in texts]
    # A blank after each text ends its last word.
    joined = np.frombuffer("".join(t + " " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    kind = kinds(joined)
    letter = kind == 3
    # A mark belongs to a word only if it follows one of its characters.
    edge = np.flatnonzero(np.diff(kind == 2, prepend=False))
    for start, end in zip(edge[::2], [*edge[1::2], len(kind)][: len(edge[::2])]):
        letter[start:end] = start > 0 and letter[start - 1]
    before = np.concatenate(([False], letter[:-1])) if len(letter) else letter
    kept = np.flatnonzero(letter | before)
    codes, number = np.where(letter, joined, BLANK)[kept], number[kept]
    pad = order - 1
    at = np.arange(len(kept)) + pad * (number + 1)
    out = np.full(len(kept) + pad * len(texts), BLANK, np.uint32)
    owner = np.full(len(out), -1, np.int64)
    out[at], owner[at] = codes, number
    return out, owner


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For ``n`` = 0 to ``order`` the hash of the ``n`` characters that end at each place;
    places with fewer before them mean nothing."""
    sums = gram_sums(codes, order)
    return [np.zeros(len(codes), np.uint64), *(mix(total + np.uint64(n + 1)) for n, total in enumerate(sums))]


def gram_hash(codes: np.ndarray, order: int) -> np.ndarray:
    """The last of ``gram_hashes`` alone."""
    *_, total = gram_sums(codes, order)
    return mix(total + np.uint64(order))


def gram_sums(codes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each ``n`` one array, which the next ``n`` changes."""
    each = mix(codes.astype(np.uint64) + np.uint64(1))
    total, factor = each.copy(), 1
    yield total
    for n in range(1, order):
        factor = factor * int(MULTIPLIER) % (1 << 64)
        total[n:] += each[:-n] * np.uint64(factor)
        yield total


def grams_at(codes: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """``[place, order]``: the characters that end at each place."""
    return np.stack([codes[ends - order + 1 + i] for i in range(order)], axis=1)


def gram_texts(grams: np.ndarray) -> list[str]:
    joined = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
    order = grams.shape[1]
    return [joined[i : i + order] for i in range(0, len(joined), order)]


def gram_codes(texts: Iterable[str]) -> np.ndarray:
    """The characters of grams one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def may_learn(docs: DataFrame, id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is not held out; a null id counts as an empty text."""
    return ~held_out(docs[quoted(id_col)], modulus, remainder)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    number = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(number.cast("binary")) % modulus == remainder


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, c)`` over ``rows (lang, text)``, staged."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def folded(parts: list[tuple]) -> tuple:
        hashes, grams, counts = (np.concatenate(x) for x in zip(*parts))
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return hashes[first], grams[first], np.bincount(inverse, counts).astype(np.int64)

    def messages(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            _, grams, counts = folded(parts)
            for start in range(0, len(counts), GRAMS_PER_BATCH):
                part = slice(start, start + GRAMS_PER_BATCH)
                texts = gram_texts(grams[part])
                yield record_batch({"lang": [lang] * len(texts), "gram": texts, "n": counts[part]}, schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in chunks(batches, 1 << 20):
            texts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, mine in texts.items():
                codes, owner = characters(mine, order)
                ends = np.flatnonzero(owner >= 0)
                if not len(ends):
                    continue
                hashes = gram_hash(codes, order)[ends]
                distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                held.setdefault(lang, []).append((distinct, grams_at(codes, ends[first], order), counts))
                size += len(distinct)
            if size > GRAMS_PER_MESSAGE:
                held = {lang: [folded(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > GRAMS_PER_MESSAGE // 2:
                    yield from messages(held)
                    held, size = {}, 0
        yield from messages(held)

    sent = rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return stage(sent.groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")


def by_orders(counts: DataFrame, order: int) -> DataFrame:
    """``(lang, k, gram, c, context)`` of all orders ``k``, staged."""
    levels = [counts.select("lang", F.lit(order).alias("k"), "gram", "c")]
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, k).alias("gram")
        levels.append(levels[-1].groupBy("lang", shorter).agg(F.count("*").alias("c")).select("lang", F.lit(k).alias("k"), "gram", "c"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return stage(every.withColumn("context", F.expr("substring(gram, 1, k - 1)")), "orders")


def discounted(every: DataFrame) -> DataFrame:
    """``(lang, k, gram, alpha)``: the discounted probability of each gram's last character
    after the others, for all grams of ``by_orders``."""
    once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discounts = every.groupBy("lang", "k").agg(once.alias("n1"), twice.alias("n2"))
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    discounts = discounts.select("lang", "k", F.greatest(F.lit(0.1), F.least(F.lit(0.95), d)).alias("d"))
    totals = every.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"))
    # One row for each language and order, so of a model's size at most.
    return (
        every.join(totals, ["lang", "k", "context"])
        .join(discounts, ["lang", "k"])
        .select("lang", "k", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("alpha"))
    )


@dataclass(frozen=True)
class Rest:
    """What of a model is not in memory, by languages' numbers: ``alphas (k, gram, alphas)``
    and ``masses (k, context, masses)``, and ``known (gram, c, costs)``, all learned grams of
    full order, their counts and what they cost in each language."""

    alphas: DataFrame
    masses: DataFrame
    known: DataFrame | None = None


@dataclass(frozen=True)
class Model:
    """``tables[language][k - 1]`` holds, for order ``k``, the sorted hashes of grams, their
    probabilities, the sorted hashes of contexts, and the mass these leave to lower orders.
    Beyond order ``held`` they are empty: ``rest`` has what is there, and ``frequent`` the
    sorted hashes of frequent grams of full order and their costs."""

    languages: list[str]
    order: int
    alphabet: int
    tables: list[list[tuple[np.ndarray, ...]]]
    temperature: float = 1.0
    least_score: float = 0.0
    ceilings: list[float] = field(default_factory=list)
    held: int = ORDER
    rest: Rest | None = None
    frequent: tuple[np.ndarray, np.ndarray] | None = None

    def probabilities(self, codes: np.ndarray, ends: np.ndarray, language: int) -> np.ndarray:
        """Of the characters at ``ends``, each after those before it."""
        return self.by_hashes(*self.hashes_at(codes, ends), language)

    def hashes_at(self, codes: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Those of grams and of their contexts, by order."""
        hashes = gram_hashes(codes, self.order)
        return [h[ends] for h in hashes[1:]], [h[ends - 1] for h in hashes[:-1]]

    def by_hashes(self, grams_at: list[np.ndarray], contexts_at: list[np.ndarray], language: int) -> np.ndarray:
        p = np.full(len(grams_at[0]), 1 / self.alphabet)
        for gram, context, (grams, alpha, contexts, mass) in zip(grams_at, contexts_at, self.tables[language]):
            p = looked_up(grams, alpha, gram, 0) + looked_up(contexts, mass, context, 1) * p
        return p


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), float(default))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def assemble(rows: pa.Table, order: int) -> Model:
    """The sorted arrays, from ``(lang, k, gram, alpha)``."""
    order_column, lang_column = rows.column("k").to_numpy(), np.array(rows.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(lang_column.tolist()), key=lambda s: s.encode())
    alpha, grams = rows.column("alpha").to_numpy(), rows.column("gram")
    tables, alphabet = [], set()
    for lang in languages:
        tables.append([])
        mine = lang_column == lang
        for k in range(1, order + 1):
            at = np.flatnonzero(mine & (order_column == k))
            codes = gram_codes(grams.take(pa.array(at)).to_pylist())
            if k == 1:
                alphabet.update(codes.tolist())
            last = np.arange(k - 1, len(codes), k)
            hashes = gram_hashes(codes, k)
            keys, contexts = hashes[k][last], hashes[k - 1][last - 1]
            rank = np.argsort(keys)
            distinct, inverse = np.unique(contexts, return_inverse=True)
            # What the grams of a context leave.
            mass = np.maximum(LEAST_MASS, 1 - np.bincount(inverse, alpha[at], minlength=len(distinct)))
            tables[-1].append((keys[rank], alpha[at][rank].astype(np.float32), distinct, mass.astype(np.float32)))
    return Model(languages, order, len(alphabet) + 1, tables)


class Scorer:
    """Cross-entropies of texts, remembering what grams cost in each language.

    Grams stand in a table by their hash, or behind it at the next free slot. It is half
    full at most, so a gram is found in a step or two, and only those not met before are
    sorted and worked out.
    """

    def __init__(self, model: Model):
        self.model = model
        self.most_slots = 1 << (MEMORY // (4 * max(1, len(model.languages)) + 8)).bit_length() - 1
        self.most = self.most_slots // 2
        self._clear(FIRST_SLOTS)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and ``[language, text]`` nats per character."""
        sizes = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(self.model.languages), len(texts)))
        for number, costs, _, _ in self._places(texts, sizes):
            self._add(sums, number, costs)
        return sizes, sums / np.maximum(1, sizes)

    @staticmethod
    def _add(sums: np.ndarray, number: np.ndarray, costs: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(number, prepend=-1))
        sums[:, number[first]] += np.add.reduceat(costs, first, axis=0, dtype=np.float64).T

    def _places(self, texts: list[str], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Characters that are looked up at once: the number of the text that each is in,
        its costs, and its place in the codes given last. Fills in the sizes of texts."""
        lengths = np.cumsum([len(t) for t in texts])
        step = max(1, COSTS // max(1, len(self.model.languages)))
        a = 0
        while a < len(texts):
            # Whole texts, few enough for a processor's cache.
            done = lengths[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(lengths, done + BLOCK, "right")))
            codes, owner = characters(texts[a:b], self.model.order)
            ends = np.flatnonzero(owner >= 0)
            owner = owner[ends]
            sizes[a:b] = np.diff(np.searchsorted(owner, np.arange(b - a + 1)))
            # 0 is a free slot.
            wanted = np.maximum(gram_hash(codes, self.model.order)[ends], np.uint64(1))
            for low in range(0, len(ends), step):
                part = slice(low, low + step)
                yield a + owner[part], self._costs(wanted[part], codes, ends[part]), ends[part], codes
            a = b

    def _costs(self, wanted: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``[place, language]`` of the characters at ``ends``, whose grams are ``wanted``."""
        order = self.model.order
        at, new = self._slots(wanted)
        out = self.costs.take(at, axis=0)
        if len(new):
            distinct, first, inverse = np.unique(wanted[new], return_index=True, return_inverse=True)
            # Only the characters that matter: each new gram with those before it.
            made = self._worked_out(distinct, grams_at(codes, ends[new[first]], order))
            out[new] = made[inverse]
            self._remember(distinct, made)
        return out

    def _worked_out(self, keys: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """``[gram, language]`` of grams not met before."""
        around = grams.ravel()
        hashes = self.model.hashes_at(around, np.arange(self.model.order - 1, len(around), self.model.order))
        made = np.empty((len(keys), len(self.model.languages)), np.float32)
        for language in range(made.shape[1]):
            made[:, language] = -np.log(self.model.by_hashes(*hashes, language))
        return made

    def _slots(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, or else the free slot that ends its search; and which keys
        are not there."""
        last = len(self.keys) - 1
        at = (wanted & np.uint64(last)).view(np.int64)
        found = self.keys.take(at)
        new, left = [], np.flatnonzero(found != wanted)
        found = found[left]
        while len(left):
            new.append(left[found == 0])
            left = left[found != 0]
            at[left] = at[left] + 1 & last
            found = self.keys[at[left]]
            other = found != wanted[left]
            left, found = left[other], found[other]
        return at, np.concatenate(new) if new else left

    def _remember(self, keys: np.ndarray, costs: np.ndarray) -> None:
        """Take up grams that are not in the table, each once."""
        if self.held + len(keys) > self.most:
            self._clear(len(self.keys))
            keys, costs = keys[: self.most], costs[: self.most]
        if 2 * (self.held + len(keys)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.costs[used]
            self._clear(min(self.most_slots, 1 << (4 * (len(used) + len(keys)) - 1).bit_length()))
            self._put(*old)
        self._put(keys, costs)

    def _put(self, keys: np.ndarray, costs: np.ndarray) -> None:
        self.held += len(keys)
        left = np.arange(len(keys))
        while len(left):
            # Of keys that find the same free slot one gets it; the others look on.
            at, _ = self._slots(keys[left])
            self.keys[at] = keys[left]
            got = self.keys[at] == keys[left]
            self.costs[at[got]] = costs[left[got]]
            left = left[~got]

    def _clear(self, slots: int) -> None:
        self.held = 0
        self.keys = np.zeros(slots, np.uint64)
        self.costs = np.zeros((slots, len(self.model.languages)), np.float32)


class FrequentScorer(Scorer):
    """The same for a model of which only frequent grams have their costs at hand."""

    def partly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Characters of each text, ``[language, text]`` nats of those of frequent grams,
        and the others: text number, gram and count, by text."""
        order = self.model.order
        sizes = np.zeros(len(texts), np.int64)
        sums = np.zeros((len(self.model.languages), len(texts)))
        numbers, grams = [np.zeros(0, np.int64)], [np.zeros((0, order), np.uint32)]
        for number, costs, ends, codes in self._places(texts, sizes):
            missing = np.isnan(costs[:, 0])
            numbers.append(number[missing])
            grams.append(grams_at(codes, ends[missing], order))
            self._add(sums, number, np.where(missing[:, None], np.float32(0), costs))
        number, gram = np.concatenate(numbers), np.concatenate(grams)
        rank = np.lexsort((*gram.T, number))
        number, gram = number[rank], gram[rank]
        other = np.concatenate(([True], (number[1:] != number[:-1]) | (gram[1:] != gram[:-1]).any(axis=1)))[: len(number)]
        first = np.flatnonzero(other)
        return sizes, sums, (number[first], gram[first], np.diff(first, append=len(number)))

    def _worked_out(self, keys, grams):
        known, costs = self.model.frequent
        if not len(known):
            return np.full((len(keys), len(self.model.languages)), np.nan, np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where((known[at] == keys)[:, None], costs[at], np.float32(np.nan))


def posteriors(sizes: np.ndarray, entropies: np.ndarray, temperature: float) -> np.ndarray:
    """``[language, text]`` from the likelihood of whole texts, its logarithm divided by
    the temperature, since characters are no independent witnesses."""
    logs = -entropies * sizes / temperature
    odds = np.exp(logs - logs.max(axis=0))
    return odds / odds.sum(axis=0)


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    modulus: int = 4,
    remainder: int = 2,
    order: int = ORDER,
    most_grams: int = MOST_GRAMS,
    accepted_errors: float = 0.01,
) -> Model:
    """Models of all languages, from all rows with a language and a text that are not held
    out. Repeated rows count as often as they occur. Without such rows the model has no
    language and every text is undetermined."""
    rows = docs.filter(may_learn(docs, id_col, modulus, remainder)).select(
        docs[quoted(lang_col)].cast("string").alias("lang"),
        docs[quoted(text_col)].cast("string").alias("text"),
    )
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = count_grams(rows, order)
    every = by_orders(counts, order)
    sizes = dict(every.groupBy("k").count().collect())
    # Order 1 is the alphabet and always held.
    held = max(1, *(k for k in range(order + 1) if sum(sizes.get(i, 0) for i in range(1, k + 1)) <= most_grams))
    grams = discounted(every)
    if held < order:
        grams = stage(grams, "grams")
    model = replace(assemble(grams.filter(F.col("k") <= held).toArrow(), order), held=held)
    if not model.languages:
        return model
    if held < order:
        model = replace(model, rest=by_key(grams.filter(F.col("k") > held), model.languages))
        known = stage(gram_costs(counts.groupBy("gram").agg(F.sum("c").alias("c")), model), "known")
        model = replace(model, rest=replace(model.rest, known=known), frequent=most_frequent(known, len(model.languages), most_grams))
    return calibrated(model, rows, accepted_errors)


def by_key(grams: DataFrame, languages: list[str]) -> Rest:
    """The grams of ``discounted``, those of all languages together."""

    def together(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        # A key has a row for each language at most.
        entries = F.map_from_entries(F.collect_list(F.struct("language", value)))
        return stage(rows.groupBy("k", key).agg(entries.alias(name)), name)

    language = F.array_position(F.lit(languages), F.col("lang")).cast("int") - 1
    rows = grams.select(language.alias("language"), "k", "gram", F.expr("substring(gram, 1, k - 1)").alias("context"), "alpha")
    left = rows.groupBy("language", "k", "context").agg((1 - F.sum("alpha")).alias("left"))
    masses = left.select("language", "k", "context", F.greatest(F.lit(LEAST_MASS), "left").alias("mass"))
    return Rest(together(rows, "gram", "alpha", "alphas"), together(masses, "context", "mass", "masses"))


def most_frequent(known: DataFrame, languages: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and costs of the grams of largest count, as many as take the memory of
    ``most`` grams of a model."""
    most = max(1, most * GRAM_BYTES // (8 + 4 * languages))
    kept, least, size = known, 0, known.count()
    while size > most:
        above = kept.agg(F.percentile_approx("c", F.lit(1 - most / size), F.lit(10000)).alias("c")).first()["c"]
        least = max(least + 1, above)
        kept = known.filter(F.col("c") > least)
        size = kept.count()
    keys, costs = [np.zeros(0, np.uint64)], [np.zeros((0, languages), np.float32)]
    for batch in kept.select("gram", "costs").toArrow().to_batches(GRAMS_PER_BATCH):
        codes = gram_codes(batch.column("gram").to_pylist())
        order = len(codes) // len(batch)
        keys.append(np.maximum(gram_hash(codes, order)[order - 1 :: order], np.uint64(1)))
        costs.append(batch.column("costs").flatten().to_numpy().reshape(-1, languages))
    all_keys = np.concatenate(keys)
    rank = np.argsort(all_keys)
    return all_keys[rank], np.concatenate(costs)[rank]


def gram_costs(grams: DataFrame, model: Model) -> DataFrame:
    """``grams``, different ones of full order, with ``costs`` for each language: the
    probability by the orders in memory, then order by order joined with the others."""
    wanted = stage(grams, "wanted")
    shared = grams.sparkSession.sparkContext.broadcast(replace(model, rest=None, frequent=None))
    schema = pa.schema([("gram", pa.string()), ("p", pa.list_(pa.float64()))])

    def lowest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes = gram_codes(batch.column("gram").to_pylist())
            hashes = own.hashes_at(codes, np.arange(own.held - 1, len(codes), own.held))
            p = np.stack([own.by_hashes(*hashes, language) for language in range(len(own.languages))], axis=1)
            yield record_batch({"gram": batch.column("gram"), "p": list(p)}, schema)

    def ends(k: int) -> DataFrame:
        return wanted.select(F.substring("gram", model.order - k + 1, k).alias("gram")).distinct()

    def interpolated(p: Column, language: Column) -> Column:
        alpha, mass = F.col("alphas")[language], F.col("masses")[language]
        return F.coalesce(alpha, F.lit(0.0)) + F.coalesce(mass, F.lit(1.0)) * p

    found = ends(model.held).mapInArrow(lowest, "gram string, p array<double>")
    for k in range(model.held + 1, model.order + 1):
        parts = wanted if k == model.order else ends(k)
        names = parts.columns
        parts = parts.select("*", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("shorter"))
        joined = parts.join(found.select(F.col("gram").alias("shorter"), "p"), "shorter")
        joined = joined.join(model.rest.alphas.filter(F.col("k") == k).drop("k"), "gram", "left")
        joined = joined.join(model.rest.masses.filter(F.col("k") == k).drop("k"), "context", "left")
        found = joined.select(*names, F.transform("p", interpolated).alias("p"))
    return found.select(*grams.columns, F.transform("p", lambda p: (-F.log(p)).cast("float")).alias("costs"))


Scored = Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]


def with_entropies(
    rows: DataFrame, model: Model, work: Callable[[Scored], Iterator[pa.RecordBatch]], schema: str, learned: bool = False
) -> tuple[DataFrame, Broadcast]:
    """What ``work`` makes of batches of ``rows``, which have a ``text``, with the sizes and
    entropies of their texts, and the broadcast that this needs. ``work`` must not ask for
    the text. Texts that are all ``learned`` have no grams that the model does not know."""
    if model.rest is None:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            return work((batch, *scorer.entropies(texts_of(batch))) for batch in chunks(batches, 1 << 20))

        return rows.mapInArrow(whole, schema), shared

    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None, tables=[]))
    languages, names = len(model.languages), [name for name in rows.columns if name != "text"]

    def partly(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = FrequentScorer(shared.value)
        # Staged below, so that each row keeps its number.
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches, 1 << 18):
            sizes, sums, (number, grams, counts) = scorer.partly(texts_of(batch))
            starts = pa.array(np.searchsorted(number, np.arange(len(sizes) + 1)), pa.int32())
            columns = {name: batch.column(name) for name in names} | {
                "row": pa.array(row + np.arange(len(sizes)), pa.int64()),
                "size": pa.array(sizes),
                "sums": pa.array(list(sums.T), pa.list_(pa.float64())),
                "grams": pa.ListArray.from_arrays(starts, pa.array(gram_texts(grams), pa.string())),
                "counts": pa.ListArray.from_arrays(starts, pa.array(counts, pa.int64())),
            }
            row += len(sizes)
            yield pa.RecordBatch.from_pydict(columns)

    made = "row long, size long, sums array<double>, grams array<string>, counts array<long>"
    fields = "".join(f"`{name}` {kind}, " for name, kind in rows.select(*names).dtypes)
    found = stage(rows.mapInArrow(partly, fields + made), "partly")
    missing = found.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("at")).select("row", "at.grams", "at.counts")
    missing = missing.toDF("row", "gram", "n")
    costs = model.rest.known.select("gram", "costs")
    if not learned:
        unknown = missing.select("gram").distinct().join(costs, "gram", "left_anti")
        costs = costs.unionByName(gram_costs(unknown, model))
    more = missing.join(costs, "gram").groupBy("row")
    more = more.agg(F.array(*[F.sum(F.col("n") * F.get("costs", F.lit(i)).cast("double")) for i in range(languages)]).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    summed = found.join(more, "row", "left").select(*names, "size", sums.alias("sums"))

    def done(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Scored:
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                yield batch, sizes, batch.column("sums").flatten().to_numpy().reshape(-1, languages).T / np.maximum(1, sizes)

        return work(each())

    return summed.mapInArrow(done, schema), shared


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def calibrated(model: Model, rows: DataFrame, accepted_errors: float) -> Model:
    """The temperature of least logarithmic loss, the least score that keeps errors among
    accepted answers at ``accepted_errors``, and for each language the cross-entropy that
    199 of 200 of its own texts stay below. Tasks return histograms, not documents."""
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int32()), ("bin", pa.int32()), ("value", pa.float64())])
    number = {lang: i for i, lang in enumerate(model.languages)}

    def measure(scored: Scored) -> Iterator[pa.RecordBatch]:
        right, wrong = np.zeros((2, len(TEMPERATURES), SCORE_BINS))
        loss, reached = np.zeros((len(TEMPERATURES), 1)), np.zeros((len(number), ENTROPY_BINS))
        for batch, sizes, entropies in scored:
            true = np.array([number.get(lang, -1) for lang in batch.column("lang").to_pylist()])
            use = np.flatnonzero((sizes > 0) & (true >= 0))
            sizes, entropies, true = sizes[use], entropies[:, use], true[use]
            each = np.arange(len(use))
            hits = entropies.argmin(axis=0) == true
            np.add.at(reached, (true, np.minimum(ENTROPY_BINS - 1, entropies[true, each] / ENTROPY_STEP).astype(int)), 1)
            for i, temperature in enumerate(TEMPERATURES):
                chances = posteriors(sizes, entropies, temperature)
                loss[i] -= np.log(np.maximum(1e-12, chances[true, each])).sum()
                bins = np.minimum(SCORE_BINS - 1, chances.max(axis=0, initial=0) * SCORE_BINS).astype(int)
                np.add.at(right[i], bins[hits], 1)
                np.add.at(wrong[i], bins[~hits], 1)
        for kind, table in enumerate((right, wrong, loss, reached)):
            row, place = np.nonzero(table)
            yield record_batch({"kind": np.full(len(row), kind), "row": row, "bin": place, "value": table[row, place]}, schema)

    sent, shared = with_entropies(rows.select("lang", "text"), model, measure, "kind int, row int, bin int, value double", True)
    tables = [np.zeros((len(TEMPERATURES), SCORE_BINS)) for _ in range(2)]
    tables += [np.zeros((len(TEMPERATURES), 1)), np.zeros((len(model.languages), ENTROPY_BINS))]
    for r in sent.groupBy("kind", "row", "bin").agg(F.sum("value").alias("value")).collect():
        tables[r["kind"]][r["row"], r["bin"]] = r["value"]
    shared.unpersist()
    right, wrong, loss, reached = tables
    best = int(loss[:, 0].argmin())
    # Errors and answers at or above each bin.
    bad, all_above = (np.cumsum(t[::-1])[::-1] for t in (wrong[best], right[best] + wrong[best]))
    good = np.flatnonzero(bad <= accepted_errors * all_above)
    least = (good[0] if len(good) else SCORE_BINS) / SCORE_BINS
    shares = np.cumsum(reached, axis=1) / np.maximum(1, reached.sum(axis=1, keepdims=True))
    ceilings = [float((row >= 0.995).argmax() + 1) * ENTROPY_STEP if row[-1] > 0 else float("inf") for row in shares]
    return replace(model, temperature=TEMPERATURES[best], least_score=float(least), ceilings=ceilings)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang, score, accepted, cross_entropy)`` for every row.

    ``lang`` is the learned language of lowest cross-entropy per character, ties going to
    the one first in byte order, and ``score`` its probability. ``accepted`` is false where
    the score or the cross-entropy is beyond the calibrated limits. A null text, one
    without letters, and any text if no language was learned are ``und`` with score 0, not
    accepted, and a null cross-entropy. Rows that repeat an id are judged each for itself;
    other columns are not looked at.
    """
    rows = docs.select(docs[quoted(id_col)].cast("long").alias("doc_id"), docs[quoted(text_col)].cast("string").alias("text"))
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    limits = np.array([*(model.ceilings or [np.inf] * len(model.languages)), np.inf])
    languages, temperature, least_score = len(model.languages), model.temperature, model.least_score
    schema = pa.schema(
        [("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("cross_entropy", pa.float64())]
    )

    def score(scored: Scored) -> Iterator[pa.RecordBatch]:
        for batch, sizes, entropies in scored:
            told = (sizes > 0) & (languages > 0)
            best, scores, lowest = np.full(len(sizes), languages), np.zeros(len(sizes)), np.full(len(sizes), np.nan)
            if told.any():
                best[told] = entropies[:, told].argmin(axis=0)
                scores[told] = posteriors(sizes[told], entropies[:, told], temperature).max(axis=0)
                lowest[told] = entropies[:, told].min(axis=0)
            columns = {
                "doc_id": batch.column("doc_id"),
                "lang": names[best],
                "score": scores,
                "accepted": told & (scores >= least_score) & ~(lowest > limits[best]),
                "cross_entropy": pa.array(lowest, from_pandas=True),
            }
            yield record_batch(columns, schema)

    return with_entropies(rows, model, score, "doc_id long, lang string, score double, accepted boolean, cross_entropy double")[0]
