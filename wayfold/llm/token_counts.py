"""Token counts of whole texts by byte-pair encoding, many words at once.

1. Texts are cut into pre-tokens by the tokenizer's pattern.  Special strings are tokens of their own and divide a
   text, as the library does by default.  Long texts are cut before a lone space first, where a pre-token always
   begins.  Texts with characters from U+0500 on are cut by the library's pre-tokenizer, whose table of letters is
   of another version of Unicode than the pattern engine's.
2. Distinct pre-tokens that a worker does not know yet become a ragged array of byte symbols.  In each round every
   sequence finds the lowest rank among its pairs, and all places of that pair are merged in all sequences at the same
   time (of a run of overlapping places every second one, from the left).  A sequence leaves when none of its pairs
   has a rank; its surviving symbols are its tokens.  Merging changes neighbouring pairs only to pairs of other
   symbols, so this is the order of the library: lowest rank first, left to right.
3. A text's count is the sum over its pre-tokens.

A worker keeps the counts of at most KNOWN short pre-tokens, then starts anew.  No shuffle.

Defined cases: null and empty texts have no bytes and no tokens.  Null and repeated ids are rows like others.  Other
columns do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import slices

#: Tokens above which a text is too long for a sequence.
LIMIT = 1024
#: Pre-tokens whose counts a worker keeps, and the length of those worth keeping.
KNOWN, SHORT = 1 << 19, 40
#: Characters of a text that are cut into pre-tokens at once, and bytes that are merged at once.
CHARACTERS, SYMBOLS = 1 << 17, 1 << 20
_counters: dict[str, "Counter"] = {}


class Merges:
    """Ranks of symbol pairs, as a hash table in arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in plain]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.of_byte = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.none = len(pairs)
        self.into = np.array([*(vocabulary[a + b] for a, b in pairs), 0], np.int64)
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) % len(self.keys)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key)
        off = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(off):
            slot[off] = (slot[off] + 1) % len(self.keys)
            off = off[(self.keys[slot[off]] != key[off]) & (self.keys[slot[off]] != -1)]
        return self.ranks[slot]

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of each word."""
        out = np.array([len(w) for w in words], np.int64)
        own = np.flatnonzero(out > 1)
        counts = out[own]
        symbol = self.of_byte[np.frombuffer(b"".join([words[k] for k in own]), np.uint8)]
        rank = np.full(len(symbol), self.none)
        rank[:-1] = self.rank(symbol[:-1], symbol[1:])
        rank[np.cumsum(counts) - 1] = self.none  # no pair goes beyond its sequence
        while len(own):
            ends = np.cumsum(counts)
            seq = np.repeat(np.arange(len(own)), counts)
            low = np.minimum.reduceat(rank, ends - counts)
            # Places that overlap (aaa) follow one another: the first, third ... of such a run are merged.
            at = np.flatnonzero((rank == low[seq]) & (rank < self.none))
            fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(seq[at]) > 0)))[: len(at)]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbol[at] = self.into[rank[at]]
            counts = counts - np.bincount(seq[at], minlength=len(own))
            out[own] = counts
            going = (low < self.none) & (counts > 1)
            stays = going[seq]
            at = at[stays[at]]
            last = np.zeros(len(symbol), bool)
            last[ends - 1] = True
            last[at[last[at + 1]]] = True  # a merged pair may be the last of its sequence
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            symbol, rank, last, changed = symbol[stays], rank[stays], last[stays], place[at]
            own, counts = own[going], counts[going]
            if len(changed):
                changed = np.unique(np.concatenate([changed, np.maximum(changed - 1, 0)]))
                rank[changed] = np.where(last[changed], self.none, self.rank(symbol[changed], symbol[np.minimum(changed + 1, len(symbol) - 1)]))
        return out


class Counter:
    """text -> number of tokens; made once in a worker."""

    def __init__(self, json_path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            model = json.load(f)
        self.merges = Merges(model["model"]["vocab"], model["model"]["merges"])
        special = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.rare, self.lone = regex.compile(r"[^\x00-\u04ff]"), regex.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
        self.library = Tokenizer.from_file(json_path).pre_tokenizer
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHARACTERS and (m := self.lone.search(text, at + CHARACTERS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def pre_tokens(self, text: str) -> list[str]:
        if self.rare.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def learn(self, words: list[str]) -> None:
        """Counts of ``words``, merged in batches of about SYMBOLS bytes."""
        spelt = [w.encode() for w in words]
        ends, at = np.cumsum([len(w) for w in spelt]), 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SYMBOLS, "right")))
            self.known.update(zip(words[at:to], self.merges.survivors(spelt[at:to]).tolist(), strict=True))
            at = to

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, size = [], 0
        for k, text in enumerate(texts):
            pieces = self.special.split(text or "") if self.special else [text or ""]
            out[k] += len(pieces) - 1
            for piece in pieces:
                for part in self.parts(piece):
                    held.append((k, self.pre_tokens(part)))
                    size += len(part)
                    if size >= 4 * CHARACTERS:
                        self._sum(held, out)
                        held, size = [], 0
        self._sum(held, out)
        return out

    def _sum(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        words = set().union(*(part for _, part in held))
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > KNOWN:
            self.known, missing = {}, words
        self.learn(list(missing))
        for k, part in held:
            out[k] += sum(map(self.known.__getitem__, part))
        for word in missing:
            if len(word) >= SHORT:
                del self.known[word]


def counter(json_path: str) -> Counter:
    if json_path not in _counters:
        _counters[json_path] = Counter(json_path)
    return _counters[json_path]


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", json_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row; ``json_path``: a byte-level BPE file that all machines have."""
    import public_tokenizers

    json_path = json_path or str(public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(json_path).count
        for batch in batches:
            for at, to, _, off in slices(batch.column(1)):
                n = count(batch.column(1).slice(at, to - at).to_pylist())
                columns = [batch.column(0).slice(at, to - at), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id)


def op12_rank_merge(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null texts have none."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
