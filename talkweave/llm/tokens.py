"""Token counts of whole texts under a byte-pair vocabulary with word ends, by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import SLICE

NONE = np.int64(1) << 40
SLOT_BITS = 19
CACHE = 1_000_000         # chunks and words whose counts a worker remembers; then it starts anew
CACHED_CHARS = 64


@dataclass
class Vocabulary:
    """What a tokenizer file says, as arrays (about 1 MB)."""

    plain: np.ndarray        # id of each byte
    final: np.ndarray        # id of each byte at the end of a word
    pairs: np.ndarray        # keys left * size + right in an open hash table; -1: free
    rank: np.ndarray         # by slot
    merged: np.ndarray       # by slot
    size: int
    pattern: str
    specials: tuple[str, ...]
    lower: bool
    compose: bool


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in shown}
    names.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)})
    return [names[b] for b in range(256)]


def _home(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of the keys, and each key's slot in it."""
    table, slot, at = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(len(keys), np.int64), _home(keys)
    todo = np.arange(len(keys))
    while len(todo):
        free = table[at[todo]] < 0
        _, first = np.unique(at[todo][free], return_index=True)
        put = todo[free][first]
        table[at[put]] = keys[put]
        slot[put] = at[put]
        todo = np.setdiff1d(todo, put)
        at[todo] = (at[todo] + 1) % len(table)
    return table, slot


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, or of a free place."""
    at = _home(keys)
    got = table[at]
    todo = np.flatnonzero((got != keys) & (got >= 0))
    while len(todo):
        at[todo] = (at[todo] + 1) % len(table)
        got = table[at[todo]]
        todo = todo[(got != keys[todo]) & (got >= 0)]
    return at


def read_vocabulary(path: str) -> Vocabulary:
    """Of a ``tokenizers`` .json file with a split pattern, byte-level names and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    end = model["end_of_word_suffix"] or ""
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or not split["invert"] or split["behavior"] != "Removed":
        raise ValueError("not a vocabulary of this kind")
    size = max(vocab.values()) + 1
    a, b, c = (np.array(x, np.int64) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in model["merges"]), strict=True))
    pairs, at = _slots(a * size + b)
    rank, merged = np.full(len(pairs), NONE), np.zeros(len(pairs), np.int64)
    rank[at], merged[at] = np.arange(len(a)), c
    names = _byte_names()
    return Vocabulary(np.array([vocab[n] for n in names]), np.array([vocab[n + end] for n in names]), pairs, rank, merged, size, split["pattern"]["Regex"],
                      tuple(t["content"] for t in spec["added_tokens"]), "Lowercase" in steps, "NFC" in steps)


def merged_lengths(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Symbols left of each word when no pair can merge any more.

    All words are one flat array. In each round every word merges all places of its lowest-ranked pair, left to right.
    """
    out = np.zeros(len(words), np.int64)
    length = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    own = np.repeat(np.arange(len(words)), length)
    ids = v.plain[raw]
    last = length.cumsum()[length > 0] - 1
    ids[last] = v.final[raw[last]]
    while len(ids):
        same = own[:-1] == own[1:]
        key = ids[:-1] * v.size + ids[1:]
        at = _find(v.pairs, key)
        rank = np.append(np.where(same, v.rank[at], NONE), NONE)
        start = np.flatnonzero(np.append(True, ~same))
        count = np.diff(np.append(start, len(ids)))
        low = np.minimum.reduceat(rank, start)
        done = low == NONE
        out[own[start[done]]] = count[done]
        low = np.repeat(low, count)
        take = (rank == low) & (rank < NONE)
        # a pair of two like symbols can overlap itself: of a run of places every second one is taken, from the first on
        place = np.flatnonzero(take)
        if len(place):
            head = np.append(True, np.diff(place) > 1)
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
            place = place[nth % 2 == 0]
        ids[place] = v.merged[at[place]]
        keep = np.repeat(~done, count)
        keep[place + 1] = False
        ids, own = ids[keep], own[keep]
    return out


_worker: dict = {}


class Counter:
    """Counts with a cache of chunks between blanks, which no pre-token crosses."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cache: dict[str, int] = {"": 0}
        self.find = regex.compile(v.pattern).findall
        self.special = re.compile("|".join(map(re.escape, v.specials))) if v.specials else None

    def _normal(self, text: str) -> str:
        if self.v.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # each letter is lowered on its own, so a sigma that ends a word is lowered like any other
        return text.replace("\u03a3", "\u03c3").lower() if self.v.lower else text

    def _fill(self, chunks: list[str], into: dict[str, int]) -> None:
        """A chunk of letters is one pre-token; others are cut by the pattern."""
        cut = {c: [c] if c.isalpha() else self.find(c) for c in chunks}
        fresh = [w for w in dict.fromkeys(w for parts in cut.values() for w in parts) if w not in into]
        into.update(zip(fresh, merged_lengths([w.encode() for w in fresh], self.v).tolist(), strict=True))
        for c, parts in cut.items():
            if len(parts) != 1 or parts[0] != c:
                into[c] = sum(map(into.__getitem__, parts))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache = {"": 0}
        extra, split = [0] * len(texts), []
        for k, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                split.append([c for p in parts for c in self._normal(p).replace("\n", " ").split(" ")])
            else:
                split.append(self._normal(text).replace("\n", " ").split(" "))
        fresh = set().union(*split).difference(self.cache)
        long: dict[str, int] = {}
        self._fill([c for c in fresh if len(c) <= CACHED_CHARS], self.cache)
        self._fill([c for c in fresh if len(c) > CACHED_CHARS], long)
        get = self.cache.__getitem__
        if not long:
            return [e + sum(map(get, chunks)) for e, chunks in zip(extra, split, strict=True)]
        return [e + sum(long[c] if c in long else get(c) for c in chunks) for e, chunks in zip(extra, split, strict=True)]


def _counted(batches, vocabulary):
    counter = _worker.get("counter")
    if counter is None or counter.v is not vocabulary.value:     # a worker keeps its counter from task to task
        counter = _worker["counter"] = Counter(vocabulary.value)
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        size = np.asarray(pc.binary_length(text)).astype(np.int64)
        run = np.append(0, size.cumsum())
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(run, run[i] + SLICE, "right")) - 1)
            tokens = counter.count(text.slice(i, j - i).to_pylist())
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(size[i:j]), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
            i = j


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``: tokens of the whole text as the library for the
    file at ``path`` gives them, special strings in a text being one token each and nothing being added.

    ``path`` is read by the driver and its arrays are broadcast. Null texts are empty: 0 bytes, 0 tokens. Repeated rows
    get equal counts; an empty table gives an empty result; other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    found = docs.select("doc_id", "text").mapInArrow(partial(_counted, vocabulary=held), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
