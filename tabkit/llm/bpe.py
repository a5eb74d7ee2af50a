"""BPE encoding by a trie of distinct words, and decoding.

A word's pieces follow from its last piece and the encoding of what stands before it:
a sequence is a BPE encoding exactly when every two neighbours are. So each node of a
trie over distinct words needs one state only, the last piece of its prefix, which is
the one vocabulary entry that ends there and gets along with the state of the node
where it begins. Words that share a prefix share those states.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tabkit.llm.frames import WORKER_CACHES, chunks, record_batch, texts_by_id

#: Words kept per Python worker between batches; only a cache, it drops nothing.
CACHED_WORDS = 600_000
#: Below this code point texts are in NFC already, and lower case goes by character.
PLAIN_LIMIT = 0x0300
WORD_END = "</w>"

#: Fixed values of the vocabulary's format: contractions, and Unicode white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    printable = [b for r in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(r[0], r[1] + 1)]
    letters = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in letters)
    letters.update({b: chr(0x100 + i) for i, b in enumerate(others)})
    return [letters[b] for b in range(256)]


class WordSplitter:
    """Cuts a text into the words that the vocabulary file's rules give.

    Texts below U+0300 take one precompiled pattern; others take the library's own
    normaliser and splitter, whose Unicode tables may differ from Python's. A word is
    a str of byte letters; an id stands for a special token found in the text.
    """

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        special = {t["content"]: t["id"] for t in json.loads(vocabulary)["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        plain = [chr(c) for c in range(PLAIN_LIMIT)]
        kinds = {c: unicodedata.category(c)[0] for c in plain}
        letters, numbers = (
            "".join(re.escape(c) for c in plain if kinds[c] == kind) for kind in ("L", "N")
        )
        self.pattern = re.compile(
            f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{re.escape(WHITE_SPACE)}{letters}{numbers}]+"
        )
        self.not_plain = re.compile(f"[^\x00-{chr(PLAIN_LIMIT - 1)}]")
        self.letters = byte_letters()
        self.latin = {i: c for i, c in enumerate(self.letters)}

    def to_letters(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return word.encode("utf-8").decode("latin-1").translate(self.latin)

    def words(self, text: str) -> list[str | int]:
        """Words as written for plain text, marked by a leading space when they are
        byte letters already (no word holds a space)."""
        if self.special_pattern and "<" in text:
            parts = self.special_pattern.split(text)
            if len(parts) > 1:
                return [
                    w
                    for part in parts
                    for w in ([self.special[part]] if part in self.special else self.plain_words(part))
                ]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if self.not_plain.search(text) is None:
            return self.pattern.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [" " + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def letters_of(self, word: str) -> str:
        return word[1:] if word[0] == " " else self.to_letters(word)


class TrieEncoder:
    """Encodes distinct words over a trie of their byte letters."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.agreeing: dict[tuple[str, str], bool] = {}
        #: The lengths of the pieces that end in two given letters, the longest first,
        #: for pieces inside a word and at its end. Every single letter is a piece.
        self.sizes: dict[str, dict[str, list[int]]] = {"": {}, WORD_END: {}}
        for token in self.ids:
            end = WORD_END if token.endswith(WORD_END) and token != WORD_END else ""
            letters = token[: len(token) - len(end)]
            if len(letters) > 1:
                self.sizes[end].setdefault(letters[-2:], set()).add(len(letters))
        for by_end in self.sizes.values():
            for ending, sizes in by_end.items():
                by_end[ending] = sorted(sizes, reverse=True)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the pair of lowest rank, the leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranked = [
                (self.ranks[pair], i)
                for i, pair in enumerate(zip(symbols, symbols[1:]))
                if pair in self.ranks
            ]
            if not ranked:
                break
            _, i = min(ranked)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            return [*token[: -len(WORD_END) - 1], token[-len(WORD_END) - 1 :]]
        return list(token)

    def agree(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart and whole when merged side by side; an empty
        left piece asks whether the right one is an encoding by itself."""
        known = self.agreeing.get((left, right))
        if known is None:
            if len(self.agreeing) > 4 * CACHED_WORDS:
                self.agreeing.clear()
            whole = self.symbols(left) + self.symbols(right)
            known = self.merge(whole) == ([left, right] if left else [right])
            self.agreeing[left, right] = known
        return known

    def last_piece(self, path: str, states: list[str], end: str) -> str:
        """The last piece of ``path`` given the states of its shorter prefixes."""
        n, ids, agreeing = len(path), self.ids, self.agreeing
        for size in self.sizes[end].get(path[-2:], ()):
            if size <= n:
                piece = path[n - size :] + end
                if piece in ids:
                    pair = states[n - size], piece
                    fits = agreeing.get(pair)
                    if fits or fits is None and self.agree(*pair):
                        return piece
        return path[-1] + end

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """``(word, pieces)`` for distinct words of byte letters."""
        root: dict = {}
        for word in words:
            node = root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word
        # Depth first; states[d] is the last piece of the current path's first d letters.
        path, states, todo = "", [""], [("", 0, root)]
        while todo:
            letter, depth, node = todo.pop()
            if depth:
                path = path[: depth - 1] + letter
                del states[depth:]
            if "" in node:
                yield node[""], self.pieces(path, states)
            below = [(c, depth + 1, child) for c, child in node.items() if c]
            if below:
                if depth:
                    states.append(self.last_piece(path, states, ""))
                todo.extend(below)

    def pieces(self, path: str, states: list[str]) -> list[str]:
        """Walk back from the end of a word, whose last letter carries the word end."""
        found = [self.last_piece(path, states, WORD_END)]
        at = len(path) - len(found[0]) + len(WORD_END)
        while at:
            found.append(states[at])
            at -= len(found[-1])
        return found[::-1]


class Decoder:
    """Ids back to text as the library does for a file without a decoder: the pieces
    joined by a space, special tokens included, unknown ids left out."""

    def __init__(self, vocabulary: str):
        rules = json.loads(vocabulary)
        self.pieces = {i: t for t, i in rules["model"]["vocab"].items()}
        self.pieces |= {t["id"]: t["content"] for t in rules["added_tokens"]}

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.pieces[i] for i in ids if i in self.pieces)


class Encoder:
    """Texts to ids. Distinct words unseen so far go through one trie per batch, and
    ``form`` makes of a word's ids what is wanted of them."""

    def __init__(self, vocabulary: str, form: Callable[[list[int]], Any] = lambda ids: ids):
        self.vocabulary = vocabulary
        self.splitter = WordSplitter(vocabulary)
        self.form = form
        self.forms: dict[str | int, Any] = {}

    @cached_property
    def trie(self) -> TrieEncoder:
        return TrieEncoder(self.vocabulary)

    def ids_of(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        for letters, pieces in self.trie.encode_words(words):
            yield letters, [self.trie.ids[p] for p in pieces]

    def by_word(self, texts: list[str]) -> list[list[Any]]:
        """For each text the forms of its words in order."""
        word_lists = [self.splitter.words(t) for t in texts]
        seen = set().union(*word_lists)
        if len(self.forms) > CACHED_WORDS:
            self.forms.clear()
        forms, new = self.forms, {}
        for word in seen - forms.keys():
            if isinstance(word, int):
                forms[word] = self.form([word])
            else:
                new.setdefault(self.splitter.letters_of(word), []).append(word)
        for letters, ids in self.ids_of(new):
            form = self.form(ids)
            for word in new[letters]:
                forms[word] = form
        return [[forms[w] for w in words] for words in word_lists]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for ids in found for i in ids] for found in self.by_word(texts)]


class LibraryEncoder(Encoder):
    """The same, with the library's own model on each distinct word."""

    def ids_of(self, words):
        tokenize = self.splitter.library.model.tokenize
        for letters in words:
            yield letters, [t.id for t in tokenize(letters)]


def per_worker(make: Callable[[str], Any], vocabulary: str) -> Any:
    """What ``make`` gives for a vocabulary, once per Python worker, which outlives its
    tasks; it holds caches only, until another operator's ``tidied`` task begins."""
    key = (make.__module__, make.__qualname__, hash(vocabulary))
    if key not in WORKER_CACHES:
        WORKER_CACHES[key] = make(vocabulary)
    return WORKER_CACHES[key]


def digesting_encoder(vocabulary: str) -> Encoder:
    """A word as its number of ids, its written ids and its decoded pieces."""
    decoder = Decoder(vocabulary)
    return Encoder(
        vocabulary, lambda ids: (len(ids), " ".join(map(str, ids)).encode(), decoder.decode(ids).encode("utf-8"))
    )


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``, one row per document, ids as the library gives without added
    special tokens, truncation and padding.

    Null text counts as empty and gives no ids; special tokens written in a text become
    their ids; repeated rows are encoded each; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    shared = _shared(docs, vocabulary_path)

    def run(batches):
        encoder = per_worker(Encoder, shared.value)
        for batch in chunks(batches):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield record_batch({"doc_id": batch.column("doc_id"), "ids": ids}, schema)

    return texts_by_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids decode as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    shared = _shared(encoded, vocabulary_path)

    def run(batches):
        decoder = per_worker(Decoder, shared.value)
        for batch in chunks(batches):
            texts = [decoder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield record_batch({"doc_id": batch.column("doc_id"), "text": texts}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` and then
    ``decode`` give, digested where it is made, so that no ids leave the task.

    The written form of a word's ids and pieces is made once per distinct word.
    """
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    shared = _shared(docs, vocabulary_path)

    def run(batches):
        encoder = per_worker(digesting_encoder, shared.value)
        for batch in chunks(batches):
            counts, ids_sha, decoded_sha = [], [], []
            for found in encoder.by_word(batch.column("text").to_pylist()):
                counts.append(sum([f[0] for f in found]))
                ids_sha.append(hashlib.sha256(b" ".join([f[1] for f in found])).hexdigest())
                decoded_sha.append(hashlib.sha256(b" ".join([f[2] for f in found])).hexdigest())
            made = {"n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
            yield record_batch({"doc_id": batch.column("doc_id")} | made, schema)

    return texts_by_id(docs, id_col, text_col).mapInArrow(run, columns)


def read_vocabulary(path: str) -> str:
    """The file's content, of a fixed size of a few MB; executors get it by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
