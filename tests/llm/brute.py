"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter

SPACES = b" \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def text_of(text):
    return b"" if text is None else text.encode("utf-8")


def removed_bytes(rows, window):
    """{row number: (n_bytes, n_removed, n_spans, kept)}"""
    texts = [text_of(t) for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def removed_words(rows, window):
    least = {}
    split = [text_of(t).split() for _, t in rows]
    for (doc_id, _), words in zip(rows, split):
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for (doc_id, _), words in zip(rows, split):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g)))
    return out
