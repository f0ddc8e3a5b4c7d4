"""Byte-pair encoding by backtracking over longest matches, and its decoding.

The longest tokens starting at each place of a word come from one Aho-Corasick
pass. The encoder takes the longest token that is compatible with the token
before it (merging the two token strings would split at the same place),
shortens it or backs up where none is, and never visits a dead place twice:
the merges that a rank-ordered merge loop would make, in linear time; the rule is the
published one for tables of compatible token pairs. Decoding gathers token bytes through
an offset table. Case, composition and letter classes of text beyond ASCII are taken from
the tokenizer file's own normalizer and splitter, as Unicode versions differ in them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tideline.llm.common import id_and_text

MEMO, PAIRS = 200_000, 200_000
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_END = 0x10000  # added to a word's last character, which carries the end-of-word suffix


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class PairEncoder:
    """Exact merges of one word, given as symbols (characters)."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]):
        self.ids, self.length = tokens, {i: len(s) for s, i in tokens.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split = {i: (i, i) for i in tokens.values()}
        rank = {i: n for n, i in enumerate(sorted(i for s, i in tokens.items() if len(s) == 1))}
        for a, b in merges:
            new = tokens[a + b]
            self.pairs[tokens[a], tokens[b]] = new
            if new not in rank:
                rank[new] = len(rank)
                self.split[new] = tokens[a], tokens[b]
        self.rank = rank
        self.shorter: dict[int, int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in tokens.items():
            if i in rank:
                self.automaton.add_word(s, (len(s), i))
                self.shorter[i] = next((tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if tokens.get(s[:n]) in rank), -1)
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge order leaves a boundary between two adjacent tokens."""
        known = self.table.get((left, right))
        if known is None:
            if len(self.table) >= PAIRS:
                self.table.clear()
            known = self.table[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, split = self.rank, self.split
        limit = len(rank)
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and rank[joined] < limit:
                return False
            if rank[left] > rank[right]:
                limit, last = rank[left], left
                left = split[left][1]
                if left == last:
                    limit, last = rank[right] + 1, right
                    right = split[right][0]
                    if right == last:
                        return True
            else:
                limit, last = rank[right] + 1, right
                right = split[right][0]
                if right == last:
                    limit, last = rank[left], left
                    left = split[left][1]
                    if left == last:
                        return True

    def encode(self, word: str) -> list[int]:
        longest = [(0, -1)] * len(word)
        for end, (n, i) in self.automaton.iter(word):
            if n > longest[end - n + 1][0]:
                longest[end - n + 1] = n, i
        out: list[int] = []
        open_ = bytearray(b"\1" * (len(word) + 1))
        at, token = 0, longest[0][1]
        while at < len(word):
            end = at + self.length[token] if token >= 0 else -1
            if end >= 0 and open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at][1] if at < len(word) else -1
            elif token >= 0 and self.shorter[token] >= 0:
                token = self.shorter[token]
            elif out:
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]
            else:
                raise ValueError(f"no tokens spell {word!r}")
        return out


class WordBpe:
    """A tokenizer file with NFC, single spaces, lower case, a word pattern,
    byte-level characters and an end-of-word suffix; no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.encoder = PairEncoder(
            {self._symbols(s): i for s, i in model["vocab"].items()},
            [(self._symbols(a), self._symbols(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])],
        )
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_alphabet()
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        table = {i: s.encode() for s, i in model["vocab"].items()} | {i: s.encode() for s, i in self.special.items()}
        pieces = [table.get(i, b"") + b" " for i in range(max(table) + 1)]
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int32)
        self.pool = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space."""
        if chunk.isascii():
            words = ["".join([self.bytes[b] for b in w.encode()]) for w in self.pattern.findall(chunk.lower())]
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        out = []
        for word in words:
            ids = self.words.get(word)
            if ids is None:
                got = self.encoder.encode(word[:-1] + chr(ord(word[-1]) + _END))
                ids = struct.pack("<%dI" % len(got), *got)
                if len(self.words) >= MEMO:
                    self.words.clear()
                if len(word) < 64:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space
            chunks = _SPACE.split(text)
        else:
            chunks = text.split()
        memo, out = self.memo, []
        for c in chunks:
            ids = memo.get(c)
            if ids is None:
                ids = self._chunk(c)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(c) < 64:
                    memo[c] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become them."""
        if self.specials is None or "<|" not in text and self.specials.search(text) is None:
            return self._plain(text)
        return b"".join(
            np.array([self.special[p]], dtype="<u4").tobytes() if k % 2 else self._plain(p)
            for k, p in enumerate(self.specials.split(text))
        )

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, one space between them, as without a decoder."""
        parts = []
        for lo in range(0, len(ids), 1 << 18):
            part = ids[lo : lo + (1 << 18)]
            n = self.lengths[part]
            shift = self.offsets[part] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int32)
            parts.append(self.pool[np.repeat(shift, n) + np.arange(n.sum(), dtype=np.int32)].tobytes())
        return b"".join(parts)[:-1]


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary``: little-endian unsigned 32-bit ids of each whole text.

    Null and empty texts give no ids. ``path`` names the vocabulary file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t.as_py()) for t in batch.column(1)], pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(i.as_py() or b"", dtype="<u4")).decode() for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what encoding and decoding give, as digests.

    Both run in one pass, so neither ids nor decoded texts leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(bpe.decode(np.frombuffer(ids, dtype="<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
