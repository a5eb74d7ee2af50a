"""Repeated windows: minimisers, super-windows and the exchange that finds them.

A text is a sequence of units (bytes or words). Every window of ``window`` units owns
the smallest hash among its grams of ``gram`` units. Consecutive windows that own the
same gram travel together as one packed string, a fragment, to the bucket of that hash;
equal windows own equal grams and so meet in one bucket.

Little text has to move. Tasks first exchange the Golomb-coded hashes of their
fragments; the owners of the hash ranges answer with a bitmap of those that are shared.
Of these, thin rows (hash, digest of the fragment, place) tell which hashes have one
fragment only, whose windows all repeat or none, and which hold different fragments.
Only one copy of each of the latter is sent, by the document of smallest id that has
it. Bitmaps have a bounded size and may let too much pass, which later steps drop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.exact_dedup import rice_decode, rice_encode
from tabkit.llm.frames import chunks, record_batch, release_memory, semi_reduce, small_batches, task_count, text_number, tidied
from tabkit.session import stage

#: Bits of a gram's hash, and of its place inside a block, which breaks ties leftmost.
KEY_BITS, PLACE_BITS = 44, 20
#: Units a task works on at once, few enough for a processor's cache; longer texts are
#: cut between windows.
BLOCK = 1 << 15
#: Hashes a sender holds before it sends: some 60 MB while they are sorted and coded.
HASHES_PER_MESSAGE = 500_000
#: Hashes an owner is meant for: some 40 MB while they are compared.
HASHES_PER_OWNER = 1_000_000
#: Bits of the answer at most: 16 MB.
FILTER_BITS = 1 << 27
FRAGMENTS_PER_BUCKET = 10_000
#: Keys of more different fragments are counted window by window, over all tasks.
HEAVY_KEY = 50_000

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
BYTE_CODES = _random.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of ``gram`` bytes, by doubling; ``gram`` is a power of two."""
    h, size, factor = BYTE_CODES[data], 1, int(MULTIPLIER)
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    return mix(h)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not white space."""
    edges = np.diff(np.concatenate(([True], WHITE[data], [True])).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A hash for each word: a polynomial in the bytes, from prefix sums over blocks of
    whole words."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        n = high - low
        powers, back = _powers(int(MULTIPLIER), n), _powers(pow(int(MULTIPLIER), -1, 1 << 64), n)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE_CODES[data[low:high]] * powers)))
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        at = to
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 20), np.uint64(base)))))
        if n <= 1 << 20:
            _POWERS[base] = known
    return known[:n]


def word_gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    h = np.zeros(max(0, n), np.uint64)
    for i in range(gram):
        h = h * MULTIPLIER + words[i : i + len(h)]
    return mix(h)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` consecutive ones."""
    low, size = keys, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


@dataclass(frozen=True)
class Windows:
    """What a unit is and how wide windows are."""

    window: int
    gram: int
    words: bool

    @property
    def bytes_per_fragment(self) -> int:
        """About how much text one fragment's windows start in: minimisers lie half a
        window's grams apart, and words are taken to have six bytes with their space."""
        return max(1, (self.window - self.gram + 2) // 2 * (6 if self.words else 1))

    def fragments(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of fragments: ``(text number, start, windows, key, digest, from byte,
        to byte)`` with starts in units, and byte places in that text."""
        if not self.words:
            for part in self._blocks([len(t) for t in texts]):
                data = np.concatenate([np.frombuffer(texts[i], np.uint8)[a:b] for i, a, b in part])
                numbers, units, *found = self._fragments(part, BYTE_CODES[data], byte_gram_hashes(data, self.gram))
                yield numbers, units, *found, units, units + found[0] + self.window - 1
            return
        data = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends = word_spans(data)
        hashes = word_hashes(data, starts, ends)
        text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        word_at = np.searchsorted(starts, text_at)
        for part in self._blocks(np.diff(word_at).tolist()):
            words = np.concatenate([hashes[word_at[i] + a : word_at[i] + b] for i, a, b in part])
            numbers, units, *found = self._fragments(part, words, word_gram_hashes(words, self.gram))
            first = word_at[numbers] + units
            last = first + found[0] + self.window - 2
            yield numbers, units, *found, starts[first] - text_at[numbers], ends[last] - text_at[numbers]

    def _blocks(self, lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
        """Stretches ``(text, from unit, to unit)`` that overlap by a window less one, in
        lists of about ``BLOCK`` units. Cuts go by places in the text alone."""
        part, size = [], 0
        for number, length in enumerate(lengths):
            for start in range(0, max(0, length - self.window + 1), BLOCK):
                end = min(length, start + BLOCK + self.window - 1)
                if part and size + end - start > BLOCK:
                    yield part
                    part, size = [], 0
                part.append((number, start, end))
                size += end - start
        if part:
            yield part

    def _fragments(self, part: list[tuple[int, int, int]], codes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = np.array([end - start for _, start, end in part])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(len(grams), dtype=np.uint64)
        ranked = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place
        owned = window_minima(ranked, self.window - self.gram + 1)
        # Windows that reach over the end of their stretch are none.
        stretch = np.repeat(np.arange(len(part)), sizes)[: len(owned)]
        at = np.flatnonzero(np.arange(len(owned)) + self.window <= offsets[1:][stretch])
        first = np.ones(len(at), bool)
        first[1:] = (owned[at[1:]] != owned[at[:-1]]) | (stretch[at[1:]] != stretch[at[:-1]])
        starts = at[first]
        counts = np.diff(np.append(np.flatnonzero(first), len(at)))
        of = stretch[starts]
        numbers = np.array([i for i, _, _ in part])[of]
        units = starts - offsets[of] + np.array([a for _, a, _ in part])[of]
        keys = (owned[starts] >> np.uint64(PLACE_BITS)).astype(np.int64)
        # A polynomial in the fragment's units, from prefix sums.
        n = len(codes)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * _powers(int(MULTIPLIER), n))))
        stops = starts + counts + self.window - 1
        back = _powers(pow(int(MULTIPLIER), -1, 1 << 64), n)[starts]
        digests = mix((sums[stops] - sums[starts]) * back + counts.astype(np.uint64)).view(np.int64)
        return numbers, units, counts, keys, digests

    def packed(self, text: bytes, begin: int, stop: int) -> bytes:
        """A fragment as it travels: its bytes, or its words joined by one space."""
        piece = text[begin:stop]
        return b" ".join(piece.split()) if self.words else piece


def split_words(text: bytes) -> list[bytes]:
    """Words at runs of space and 0x09-0x0D, which is how ``bytes.split`` splits."""
    return text.split()


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tid, text)``: bytes of the text (null: empty), its id (null: the
    smallest) and a hash of the text, so that rows that repeat an id with other texts
    stay apart."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        text_number(text).alias("tid"),
        text.cast("binary").alias("text"),
    )


def real_id(name: str) -> Column:
    """The id as it was given; the smallest long stood for null."""
    return F.when(F.col(name) != F.lit(-(1 << 63)), F.col(name))


def shared_keys(rows: DataFrame, windows: Windows, across_ids: bool) -> Broadcast:
    """A bitmap over hashes of the fragment keys that occur more than once, or with
    ``across_ids`` under more than one id."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    count = size // windows.bytes_per_fragment + 1
    owners = task_count(count, HASHES_PER_OWNER, at_least=8)
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * count).bit_length()))
    bits_each = -(-bits // owners)
    slice_size = -(-(1 << KEY_BITS) // owners)
    ddl = "owner int, n int, k int, unary binary, remainders binary, multiple binary"
    schema = pa.schema([("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("remainders", pa.binary()), ("multiple", pa.binary())])

    def message(held):
        keys, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, keys)) if across_ids else np.argsort(keys)
        keys, ids = keys[order], ids[order]
        distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
        multiple = ids[first] != ids[first + counts - 1] if across_ids else counts > 1
        distinct = distinct.astype(np.uint64)
        cuts = np.searchsorted(distinct, np.arange(owners + 1, dtype=np.uint64) * np.uint64(slice_size))
        out = []
        for owner in range(owners):
            a, b = cuts[owner], cuts[owner + 1]
            if a < b:
                code = rice_encode(distinct[a:b] - np.uint64(owner * slice_size), slice_size)
                out.append((owner, int(b - a), *code, np.packbits(multiple[a:b]).tobytes()))
        return record_batch(dict(zip(schema.names, zip(*out))), schema)

    def send(batches):
        held, size = [], 0
        for batch in chunks(batches, 1 << 20):
            ids = batch.column("doc_id").to_numpy()
            for numbers, _, _, keys, *_ in windows.fragments(batch.column("text").to_pylist()):
                if len(keys):
                    held.append((keys, ids[numbers]))
                    size += len(keys)
            if size >= HASHES_PER_MESSAGE:
                yield message(held)
                held, size = [], 0
        if size:
            yield message(held)

    def answer(group: pa.Table) -> pa.Table:
        page = np.zeros(bits_each, np.uint8)
        parts = []
        for m in group.to_batches(max_chunksize=1):
            n, k, unary, remainders, multiple = (m.column(c)[0].as_py() for c in schema.names[1:])
            values = rice_decode(n, k, unary, remainders)
            flags = np.unpackbits(np.frombuffer(multiple, np.uint8))[:n] > 0
            page[bit_in_slice(values[flags], slice_size, bits_each)] = 1
            parts.append(values)
        values = np.concatenate(parts)
        parts.clear()
        # A value that several senders have lies beside its like.
        values.sort()
        page[bit_in_slice(values[1:][values[1:] == values[:-1]], slice_size, bits_each)] = 1
        packed = np.packbits(page).tobytes()
        del values, page
        release_memory()
        return pa.table({"owner": group.column("owner")[:1], "page": pa.array([packed], pa.binary())})

    sent = rows.select("doc_id", "text").mapInArrow(tidied(send), ddl)
    return _bitmap(sent.groupBy("owner").applyInArrow(answer, "owner int, page binary"), owners, bits_each, slice_size)


def _bitmap(answers: DataFrame, owners: int, bits_each: int, slice_size: int) -> Broadcast:
    """Owners' pages, one after another, to every task: ``FILTER_BITS`` at most."""
    pages = {r["owner"]: bytes(r["page"]) for r in answers.collect()}
    empty = np.packbits(np.zeros(bits_each, np.uint8)).tobytes()
    return answers.sparkSession.sparkContext.broadcast(
        {"bits_each": bits_each, "slice_size": slice_size, "pages": b"".join(pages.get(o, empty) for o in range(owners))}
    )


def bit_in_slice(values: np.ndarray, slice_size: int, bits: int) -> np.ndarray:
    return (values.astype(np.float64) * (bits / slice_size)).astype(np.int64).clip(0, bits - 1)


def may_be_set(keys: np.ndarray, answer: dict) -> np.ndarray:
    owner, inside = np.divmod(keys, answer["slice_size"])
    bit = bit_in_slice(inside, answer["slice_size"], answer["bits_each"])
    pages = np.frombuffer(answer["pages"], np.uint8)
    at = owner * (-(-answer["bits_each"] // 8)) + (bit >> 3)
    return (pages[at] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0


def shared_places(rows: DataFrame, windows: Windows, shared: Broadcast) -> DataFrame:
    """``(key, digest, doc_id, tid, start, windows)`` of the fragments whose keys may be
    shared, staged."""
    ddl = "key long, digest long, doc_id long, tid long, start long, windows int"
    schema = pa.schema([(c, pa.int64()) for c in ("key", "digest", "doc_id", "tid", "start")] + [("windows", pa.int32())])

    def cut(batches):
        for batch in chunks(batches, 1 << 20):
            ids, tids = (batch.column(c).to_numpy() for c in ("doc_id", "tid"))
            for numbers, starts, counts, keys, digests, _, _ in windows.fragments(batch.column("text").to_pylist()):
                keep = np.flatnonzero(may_be_set(keys, shared.value))
                if len(keep):
                    n = numbers[keep]
                    columns = keys[keep], digests[keep], ids[n], tids[n], starts[keep], counts[keep]
                    yield record_batch(dict(zip(schema.names, columns)), schema)

    return stage(rows.mapInArrow(tidied(cut), ddl), "places")


def holder(digests: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hash of a fragment and the document that is to send it."""
    return (mix(digests.view(np.uint64) ^ mix(ids.astype(np.int64).view(np.uint64))) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def wanted_holders(facts: DataFrame, count: int) -> Broadcast:
    """A bitmap over ``holder`` of the fragments whose text is wanted."""
    owners = task_count(count, 1_000_000, at_least=8)
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    bits_each, slice_size = -(-bits // owners), -(-(1 << KEY_BITS) // owners)
    schema = pa.schema([("owner", pa.int32()), ("inside", pa.int64())])

    def hashed(batches):
        for batch in batches:
            h = holder(batch.column("digest").to_numpy(), batch.column("low").to_numpy())
            yield record_batch({"owner": h // slice_size, "inside": h % slice_size}, schema)

    def page(group: pa.Table) -> pa.Table:
        bits = np.zeros(bits_each, np.uint8)
        bits[bit_in_slice(group.column("inside").to_numpy(), slice_size, bits_each)] = 1
        return pa.table({"owner": group.column("owner")[:1], "page": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    sent = facts.select("digest", "low").mapInArrow(hashed, "owner int, inside long")
    return _bitmap(sent.groupBy("owner").applyInArrow(page, "owner int, page binary"), owners, bits_each, slice_size)


def fragment_texts(rows: DataFrame, windows: Windows, wanted: Broadcast) -> DataFrame:
    """``(key, digest, fragment)`` of the wanted fragments, once each."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("fragment", pa.binary())])

    def cut(batches):
        for batch in chunks(batches, 1 << 20):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy()
            for numbers, _, _, keys, digests, begin, stop in windows.fragments(texts):
                keep = np.flatnonzero(may_be_set(holder(digests, ids[numbers]), wanted.value))
                if len(keep):
                    places = zip(numbers[keep], begin[keep], stop[keep])
                    pieces = [windows.packed(texts[i], a, b) for i, a, b in places]
                    yield record_batch({"key": keys[keep], "digest": digests[keep], "fragment": pieces}, schema)

    return rows.select("doc_id", "text").mapInArrow(tidied(cut), "key long, digest long, fragment binary").distinct()


@dataclass(frozen=True)
class Rule:
    """What repeats, in terms of folded fragments ``(copies, low, high)``.

    ``in_bucket`` and ``in_heavy`` make marks: the runs ``(from, to, least)`` of windows
    that occur again, where ``least`` is the smallest id they have. With ``across_ids``
    a run counts for documents of larger id only.
    """

    across_ids: bool
    in_bucket: Callable[[pa.Table], pa.Table]
    in_heavy: Callable[[DataFrame], DataFrame]

    def open_keys(self, keys: DataFrame) -> DataFrame:
        """Keys whose fragments have to be compared window by window."""
        differ = F.col("fragments") > 1
        return keys.filter(differ if self.across_ids else differ & F.col("lone"))

    def repeats(self) -> Column:
        """Whether a fragment repeats as a whole."""
        return F.col("low") < F.col("high") if self.across_ids else F.col("copies") > 1


RUN = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("least", pa.int64())])
MARKS_TYPE = "array<struct<from: int, to: int, least: bigint>>"
MARKS = f"key long, digest long, marks {MARKS_TYPE}"
MARKS_SCHEMA = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("marks", pa.list_(RUN))])


def runs_of(least: np.ndarray, repeats: np.ndarray) -> list[dict]:
    """The runs of windows that repeat, cut where their smallest id changes."""
    change = np.flatnonzero((np.diff(least) != 0) | (np.diff(repeats.astype(np.int8)) != 0)) + 1
    edges = [0, *change.tolist(), len(least)]
    return [{"from": a, "to": b, "least": int(least[a])} for a, b in zip(edges, edges[1:]) if repeats[a]]


def repeated(rows: DataFrame, windows: Windows, rule: Rule, heavy_key: int = HEAVY_KEY) -> DataFrame:
    """``(doc_id, tid, runs)``: for each document that has any, the ranges ``(from, to)``
    of window starts that repeat, staged. See the module text for the steps."""
    with small_batches(rows.sparkSession):
        return _repeated(rows, windows, rule, heavy_key)


def _repeated(rows: DataFrame, windows: Windows, rule: Rule, heavy_key: int) -> DataFrame:
    shared = shared_keys(rows, windows, rule.across_ids)
    places = shared_places(rows, windows, shared)
    facts = stage(
        places.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")),
        "facts",
    )
    keys = facts.groupBy("key").agg(F.count("*").alias("fragments"), F.max(F.col("copies") == 1).alias("lone"))
    open_keys = stage(rule.open_keys(keys).select("key", "fragments"), "open-keys")
    opened = stage(facts.join(open_keys, "key"), "opened")
    count = opened.count()
    whole = facts.join(open_keys, "key", "left_anti").filter(rule.repeats())
    marks = whole.select("key", "digest", "low", F.lit(None).cast(MARKS_TYPE).alias("marks"))
    if count:
        texts = fragment_texts(rows, windows, wanted_holders(opened, count))
        made = _marks(texts, opened, rule, count, heavy_key)
        marks = marks.unionByName(made.withColumn("low", F.lit(None).cast("long")))
    hits = places.join(marks, ["key", "digest"])
    # Without marks of their own, all windows of a fragment repeat.
    all_of_it = F.array(F.struct(F.lit(0).alias("from"), F.col("windows").alias("to"), F.col("low").alias("least")))
    runs = F.coalesce("marks", all_of_it)
    if rule.across_ids:
        runs = F.filter(runs, lambda r: r["least"] < F.col("doc_id"))
    moved = F.transform(
        runs, lambda r: F.struct((F.col("start") + r["from"]).alias("from"), (F.col("start") + r["to"]).alias("to"))
    )
    ranges = hits.select("doc_id", "tid", moved.alias("runs")).filter(F.size("runs") > 0)
    # A document's ranges are no more than its own length.
    found = ranges.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return stage(found, "repeats")


def with_runs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of documents that have runs, with these. Only their texts move."""
    return semi_reduce(rows, "doc_id", found, "doc_id").join(found, ["doc_id", "tid"])


def _marks(texts: DataFrame, opened: DataFrame, rule: Rule, count: int, heavy_key: int) -> DataFrame:
    buckets = task_count(count, FRAGMENTS_PER_BUCKET, at_least=8)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_bucket")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return MARKS_SCHEMA.empty_table()
        facts = right.select(["key", "digest", "copies", "low", "high"])
        both = left.select(["key", "digest", "fragment"]).join(facts, ["key", "digest"], join_type="inner")
        made = rule.in_bucket(both) if both.num_rows else MARKS_SCHEMA.empty_table()
        release_memory()
        return made

    def bucketed(texts: DataFrame, facts: DataFrame) -> DataFrame:
        left = texts.select("*", bucket).groupBy("_bucket")
        right = facts.select("key", "digest", "copies", "low", "high", bucket).groupBy("_bucket")
        return left.cogroup(right).applyInArrow(meet, MARKS)

    heavy = opened.filter(F.col("fragments") > heavy_key)
    if heavy.isEmpty():
        return bucketed(texts, opened)
    # A bucket loads what it is dealt, so texts of heavy keys must not get there at all.
    texts = stage(texts, "fragments")
    hot = stage(heavy.select("key").distinct(), "heavy-keys")
    spread = texts.join(hot, "key", "left_semi").join(heavy.drop("fragments"), ["key", "digest"])
    light = texts.join(hot, "key", "left_anti")
    return bucketed(light, opened.filter(F.col("fragments") <= heavy_key)).unionByName(rule.in_heavy(spread))


def covered(n: int, window: int, runs: list | None) -> np.ndarray:
    """Which of ``n`` units the windows of the given ranges cover."""
    steps = np.zeros(n + 1, np.int32)
    if runs:
        np.add.at(steps, [r["from"] for r in runs], 1)
        np.add.at(steps, [r["to"] + window - 1 for r in runs], -1)
    return np.cumsum(steps[:-1]) > 0
