"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled clean or toxic. A token's features are its word and the beginnings
of its word; neighbours are tied by transition weights. Forward-backward gives each
token's marginal; a document's score comes from its marginals by a logistic fit, and
runs of tokens likely toxic are its offending spans.

Labels exist for documents only, so token labels are derived from them on the training
sample: features are chosen greedily that occur in as many yet unexplained toxic
documents and as few clean ones as possible, and mark their tokens in toxic documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.frames import chunks, drop_documents, record_batch, release_memory, text_number, texts_by_id, tidied
from tabkit.llm.windows import BYTE_CODES, MULTIPLIER, _powers, mix

#: The training sample: at most so many documents of either label, of at most so many
#: bytes each, those with the smallest hash of their id.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 1500, 1 << 16
#: Lengths in bytes of word beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: A feature is chosen if it explains so many unrelated toxic documents.
LEAST_SUPPORT = 4
#: Features are kept whose rate in clean documents is at most this part of their rate
#: in toxic ones.
MOST_ELSEWHERE = 0.1
ROUNDS, RATE, RIDGE = 60, 0.5, 1e-2
BLOCK = 1 << 20
#: Bytes of text whose features are held at a time when known ones are looked up.
LOOKUP = 1 << 17
#: Tokens, padding included, that a pass over texts side by side holds.
CELLS = 1 << 18
#: Tokens after which training cuts a text into chains of their own.
CHAIN = 256

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(text: str) -> str:
    """Lower case, character by character where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of ASCII letters and digits and of bytes above."""
    edges = np.diff(np.concatenate(([False], WORD_BYTE[data], [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def token_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row per token: hashes of its word and its beginnings, 0 for one too long."""
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        powers = _powers(int(MULTIPLIER), high - low)
        back = _powers(pow(int(MULTIPLIER), -1, 1 << 64), high - low)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE_CODES[data[low:high]] * powers)))
        s, e = starts[at:to] - low, ends[at:to] - low
        back = back[s]
        out[at:to, 0] = mix((sums[e] - sums[s]) * back)
        for i, size in enumerate(PREFIXES, 1):
            long = e - s >= size
            stop = np.where(long, s + size, s)
            out[at:to, i] = np.where(long, mix((sums[stop] - sums[s]) * back + np.uint64(size)), np.uint64(0))
        at = to
    return out


def read_tokens(texts: list[str]):
    """All texts at once: lowered bytes, text starts, token starts and ends, and the
    token range of each text."""
    parts = [lowered(t).encode("utf-8") for t in texts]
    text_at = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    data = np.frombuffer(b" ".join(parts), np.uint8)
    starts, ends = tokens(data)
    return data, text_at, starts, ends, np.searchsorted(starts, text_at)


@dataclass
class Model:
    """Sorted feature hashes and their weights towards toxic, the chain's potentials as
    ``[from][to]`` log weights, and the document fit over ``document_evidence``."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    chain: np.ndarray
    fit: np.ndarray

    def __post_init__(self):
        self.hint = np.zeros(1 << 20, bool)
        self.hint[self.features & np.uint64((1 << 20) - 1)] = True

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature number) of the known features among token rows."""
        rows, columns = np.nonzero(self.hint[hashes & np.uint64((1 << 20) - 1)])
        found = hashes[rows, columns]
        at = np.searchsorted(self.features, found).clip(0, max(0, len(self.features) - 1))
        known = self.features[at] == found if len(self.features) else np.zeros(len(found), bool)
        return rows[known], at[known]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of the features of all tokens, of which only a stretch is held."""
        found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + LOOKUP, "right")))
            rows, ids = self.ids(token_features(data, starts[at:to], ends[at:to]))
            found.append((rows + at, ids))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found))

    def emissions(self, n: int, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(rows, self.weights[ids], minlength=n)

    def marginals(self, emissions: np.ndarray, token_at: np.ndarray) -> np.ndarray:
        return forward_backward(emissions, token_at, self.chain, paired=False)[0]


def forward_backward(emissions: np.ndarray, token_at: np.ndarray, chain: np.ndarray, paired: bool = True):
    """Marginals of toxic per token, and the summed pair marginals ``[from][to]``, zeros
    unless ``paired``.

    With two labels a message is one number, the odds of toxic. Texts run side by side,
    those of like length together.
    """
    lengths = np.diff(token_at)
    (t00, t01), (t10, t11) = np.exp(chain)
    marginal, pairs = np.zeros(len(emissions)), np.zeros((2, 2))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    done = 0
    while done < len(order):
        longest = int(lengths[order[done]])
        block = order[done : done + max(1, CELLS // longest)]
        done += len(block)
        size = lengths[block]
        step = np.arange(longest)[:, None]
        inside = step < size
        place = np.where(inside, token_at[block] + step, 0)
        e = np.where(inside, np.exp(np.clip(emissions[place], -30, 30)), 1.0)
        ahead, behind = np.empty_like(e), np.ones_like(e)
        ahead[0] = e[0]
        for t in range(1, longest):
            r = ahead[t - 1]
            ahead[t] = e[t] * (t01 + r * t11) / (t00 + r * t10)
        for t in range(longest - 2, -1, -1):
            r = e[t + 1] * behind[t + 1]
            behind[t] = np.where(inside[t + 1], (t10 + r * t11) / (t00 + r * t01), 1.0)
        both = ahead * behind
        marginal[place[inside]] = (both / (1 + both))[inside]
        if paired and longest > 1:
            follow = inside[1:]
            a, b = ahead[:-1][follow], (e * behind)[1:][follow]
            joint = np.array([[np.full_like(a, t00), t01 * b], [t10 * a, t11 * a * b]])
            pairs += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    return marginal, pairs


def document_evidence(marginal: np.ndarray, token_at: np.ndarray) -> np.ndarray:
    """Per document: one, the log odds of its most toxic token, the log of the expected
    number of toxic tokens."""
    n = len(token_at) - 1
    out = np.tile([1.0, -12.0, 0.0], (n, 1))
    full = np.flatnonzero(np.diff(token_at))
    if len(full):
        p = np.clip(marginal, 1e-6, 1 - 1e-6)
        most = np.maximum.reduceat(p, token_at[full])
        out[full, 1] = np.log(most / (1 - most))
        out[full, 2] = np.log1p(np.add.reduceat(marginal, token_at[full]))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def least_runs(words: np.ndarray) -> list[int]:
    """Four least hashes over the runs of five words, at least one of which near copies
    share almost surely."""
    if not len(words):
        return []
    width = min(5, len(words))
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        runs = runs * MULTIPLIER + words[k : k + len(runs)]
    return [int(mix(runs ^ mix(np.array([seed + 1], np.uint64))).min()) for seed in range(4)]


def related(least: list[list[int]]) -> np.ndarray:
    """A number per document that near copies share, so that a copied text does not
    count as many witnesses."""
    first: dict[tuple[int, int], int] = {}
    group = np.arange(len(least))
    for i, values in enumerate(least):
        for seed, value in enumerate(values):
            group[i] = min(group[i], group[first.setdefault((seed, value), i)])
    return group


def choose_features(rows, ids, token_at, toxic, groups, n_features) -> np.ndarray:
    """Greedy cover of the toxic documents, see the module text."""
    document = np.searchsorted(token_at, rows, "right") - 1
    seen = np.unique(groups[document].astype(np.int64) * n_features + ids)
    group, feature = np.divmod(seen, n_features)
    is_toxic = np.zeros(len(toxic), bool)
    is_toxic[groups[toxic]] = True
    clean = np.bincount(feature[~is_toxic[group]], minlength=n_features)
    open_, chosen = is_toxic.copy(), []
    while True:
        gain = np.bincount(feature[open_[group]], minlength=n_features)
        worth = gain - 10 * clean
        best = int(worth.argmax())
        if worth[best] < LEAST_SUPPORT:
            return np.array(chosen, np.int64)
        chosen.append(best)
        open_[group[feature == best]] = False


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit the field to token labels derived from document labels, then the document
    fit. Without documents of both labels the model scores everything low."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, np.zeros((2, 2)), np.array([-6.0, 0.0, 0.0]))
    if not toxic.any() or toxic.all():
        return empty

    def read(text: str) -> np.ndarray:
        data, _, starts, ends, _ = read_tokens([text])
        return token_features(data, starts, ends)

    # Only what several toxic documents and few others hold can speak for toxicity.
    # Documents are read one by one, so that the features of one at a time are held.
    held = np.concatenate([np.unique(read(text)) for text, bad in zip(texts, toxic) if bad])
    kept, count = np.unique(held[held != 0], return_counts=True)
    kept, count = kept[count >= LEAST_SUPPORT], count[count >= LEAST_SUPPORT]
    model = Model(kept, np.zeros(0), -4.0, np.zeros((2, 2)), np.zeros(3))
    others = np.zeros(len(kept), np.int64)
    for text, bad in zip(texts, toxic):
        if not bad:
            others[np.unique(model.ids(read(text))[1])] += 1
    del held
    telling = others * toxic.sum() <= MOST_ELSEWHERE * count * (~toxic).sum()
    model = Model(kept[telling], np.zeros(0), -4.0, np.zeros((2, 2)), np.zeros(3))
    n_features = len(model.features)
    if not n_features:
        return empty
    found, least, lengths = [], [], []
    for text in texts:
        features = read(text)
        rows, ids = model.ids(features)
        found.append((rows + sum(lengths[-1:]), ids))
        least.append(least_runs(features[:, 0]))
        lengths.append(sum(lengths[-1:]) + len(features))
    token_at = np.array([0, *lengths])
    rows, ids = (np.concatenate(x) for x in zip(*found))
    del found
    in_toxic = np.repeat(toxic, np.diff(token_at))
    chosen = choose_features(rows, ids, token_at, toxic, related(least), n_features)
    labels = np.zeros(token_at[-1])
    labels[rows[np.isin(ids, chosen)]] = 1
    labels[~in_toxic] = 0

    # Adagrad on the regularised log likelihood.
    model.weights = np.zeros(n_features)
    want = np.bincount(ids, labels[rows], minlength=n_features)
    chain_at = np.unique(np.concatenate([token_at, np.arange(0, token_at[-1], CHAIN)]))
    joined = np.ones(len(labels), bool)
    joined[chain_at[:-1]] = False
    here, before = labels[1:][joined[1:]], labels[:-1][joined[1:]]
    want_pairs = np.array([[((1 - before) * (1 - here)).sum(), ((1 - before) * here).sum()], [(before * (1 - here)).sum(), (before * here).sum()]])
    n_tokens, n_toxic = len(labels), labels.sum()
    # What has a number per token and is not used any more goes before the rounds.
    del in_toxic, labels, joined, here, before
    release_memory()
    squares, bias_square, pair_squares = np.full(n_features, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        marginal, got_pairs = forward_backward(model.emissions(n_tokens, rows, ids), chain_at, model.chain)
        step = want - np.bincount(ids, marginal[rows], minlength=n_features) - RIDGE * model.weights
        squares += step * step
        model.weights += RATE * step / np.sqrt(squares)
        bias_step = n_toxic - marginal.sum()
        bias_square += bias_step * bias_step
        model.bias += RATE * bias_step / np.sqrt(bias_square)
        pair_step = want_pairs - got_pairs - model.chain
        pair_squares += pair_step * pair_step
        model.chain += RATE * pair_step / np.sqrt(pair_squares)

    x = document_evidence(model.marginals(model.emissions(n_tokens, rows, ids), token_at), token_at)
    y, fit = toxic.astype(float), np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge logistic regression
        p = sigmoid(x @ fit)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        fit += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * fit)
    model.fit = fit
    used = np.abs(model.weights) > 1e-6
    return Model(model.features[used], model.weights[used], model.bias, model.chain, fit)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model from a bounded sample of labelled documents that are not held out.

    Labels that are null, or of no document, are ignored; of several for one document
    the largest counts. Null doc_ids have no label.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = texts_by_id(docs).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # First the ids of the sample, thin; then the texts of these few documents.
    thin = sizes.select("doc_id").join(known, "doc_id")
    picked = [
        thin.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1]).distinct()
    rows = sizes.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").toArrow()
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_numpy() == 1)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, tid, held_out, score, predicted, spans)`` per document, whole texts;
    ``tid`` is a hash of the text.

    ``spans`` are the runs of tokens of marginal ``threshold`` or more as character
    offsets ``(start, end)`` in the text with their largest marginal. Null and empty
    texts have no tokens and the lowest score; rows that repeat are scored each; a null
    doc_id is not held out. Other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def spans_of(text_bytes, offset, starts, ends, marginal):
        likely = np.flatnonzero(np.diff(np.concatenate(([False], marginal >= threshold, [False])).astype(np.int8)))
        out = []
        for a, b in likely.reshape(-1, 2):
            low, high = int(starts[a]) - offset, int(ends[b - 1]) - offset
            begin = len(text_bytes[:low].decode("utf-8"))
            out.append({"start": begin, "end": begin + len(text_bytes[low:high].decode("utf-8")), "score": float(marginal[a:b].max())})
        return out

    def run(batches):
        m = shared.value
        for batch in chunks(batches):
            data, text_at, starts, ends, token_at = read_tokens(batch.column("text").to_pylist())
            rows, ids = m.find(data, starts, ends)
            marginal = m.marginals(m.emissions(len(starts), rows, ids), token_at)
            scores = sigmoid(document_evidence(marginal, token_at) @ m.fit)
            spans = [[] for _ in scores]
            for i in np.unique(np.searchsorted(token_at, np.flatnonzero(marginal >= threshold), "right") - 1):
                a, b = token_at[i], token_at[i + 1]
                raw = data[text_at[i] : text_at[i + 1] - 1].tobytes()
                spans[i] = spans_of(raw, text_at[i], starts[a:b], ends[a:b], marginal[a:b])
            made = {"doc_id": batch.column("doc_id"), "tid": batch.column("tid"), "score": scores, "spans": spans}
            yield record_batch(made, schema)

    rows = texts_by_id(docs).withColumn("tid", text_number(F.col("text")))
    scored = rows.mapInArrow(tidied(run), "doc_id long, tid long, score double, spans array<struct<start: long, end: long, score: double>>")
    return scored.select(
        "doc_id",
        "tid",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def reject(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return drop_documents(docs, score(named, model).filter("predicted = 1"), id_col, text_col)
