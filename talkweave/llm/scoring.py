"""Language-model scores from a log-frequency Bloom filter of 1- to 3-gram counts.

All texts are cut into sheets of about ``FLUSH`` tokens. A sheet sends its distinct n-grams, by hash range, to the range's
reducer, each with the number of times it occurs in the sheet's training texts. The reducer adds these up over all sheets
and enters what it has into its segment of the filter: an n-gram of level ``q`` (1 + the floor of the log2 of its count) as
(n-gram, 1) to (n-gram, q). Every n-gram a sheet asked for is then probed at 1, 2, ... until one is missing, and the levels
go back to the sheets. One-offs are entered too: the filter follows the training text, in segments bounded by the number of
ranges. Segments are not broadcast, as their sum has no bound; the probes go to them.

A level stands for the middle of the counts it covers. A probe finds an entry that is not there with a probability of about
``(1 - exp(-PROBES / entry_bits)) ** PROBES``, 0.4 % as set, so levels are never too low and seldom too high. Words keep their
exact counts, which ``base_score`` needs.

Probabilities are smoothed by their histories: P(w) = (c + 0.5) / (N + 0.5 (V + 1)), P(w | v) = (c(vw) + M2 P(w)) / (c(v) + M2) and
P(w | u v) = (c(uvw) + M3 P(w | v)) / (c(uv) + M3), where no count is taken above that of its history. An n-gram that occurs twice
after a history that does so, too, is thus likelier than one that occurs once; an unseen history passes all weight down.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import U, Words, mix, packed, text_slices, unpacked

ORDER = 3
M2, M3 = 8.0, 2.0            # weight of the shorter history's probability, in occurrences
ENTRY_BITS = 12              # of the filter for each level of each n-gram
PROBES = 6
FLUSH = 5 << 18              # tokens counted together, and texts' tokens scored as one sheet
RANGE_BYTES = 6 << 20        # training text per hash range, about
LEVELS = 48
BEGIN, END = mix(np.array([11, 13], U))
_STEP = U(0xD6E8FEB86659FD93)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) with one BEGIN before and one END after the words of each."""
    count = words.counts()
    place = np.arange(len(words.hash)) + 2 * words.doc + 1
    token = np.empty(len(words.hash) + 2 * words.docs, U)
    token[place] = words.hash
    last = (count + 2).cumsum() - 1
    token[last] = END
    token[last - count - 1] = BEGIN
    return np.repeat(np.arange(words.docs), count + 2), token


def _grams(doc: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token but BEGIN, by order; 0 where an n-gram would leave its document."""
    two = np.zeros(len(token), U)
    two[1:] = mix(token[:-1] * U(3) + token[1:] + U(2))
    three = np.zeros(len(token), U)
    three[2:] = mix(two[1:-1] * U(3) + token[2:] + U(3))
    head = np.append(True, doc[1:] != doc[:-1])
    three[head] = 0
    three[1:][head[:-1]] = 0
    keep = ~head
    return [token[keep], two[keep], three[keep]]


def _level(counts: np.ndarray) -> np.ndarray:
    """1 + the floor of the log2 of each count; 0 for none."""
    return np.frexp(counts.astype(np.float64))[1]


def _middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 0, 1, 2.5, 5.5, ..."""
    return np.where(level > 0, (3 * 2.0 ** (level - 1.0) - 1) / 2, 0.0)


def _spots(names: np.ndarray, level: int, size: int):
    """The bits of (n-gram, level)."""
    seed = mix(names + U(int(_STEP) * level % (1 << 64)))
    first, second = seed >> U(32), seed & U(0xFFFFFFFF) | U(1)
    for j in range(PROBES):
        yield ((first + U(j) * second) % U(size)).astype(np.int64)


class Segment:
    """A hash range's part of the log-frequency Bloom filter, for n-grams of one order."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS):
        level = _level(counts)
        self.size = max(64, int(level.sum()) * entry_bits)
        bits = np.zeros(self.size, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for spot in _spots(names[level >= q], q, self.size):
                bits[spot] = True
        self.bits = np.packbits(bits, bitorder="little")

    def levels(self, names: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by membership probes."""
        out = np.zeros(len(names), np.uint8)
        alive = np.arange(len(names))
        for q in range(1, LEVELS + 1):
            there = np.ones(len(alive), bool)
            for spot in _spots(names[alive], q, self.size):
                there &= self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = q
        return out


def _ranges(training: DataFrame) -> int:
    volume = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")), volume // RANGE_BYTES + 1))


def _steps(names: np.ndarray, shift: int) -> bytes:
    """Ascending hashes without their low ``shift`` bits: the first, and the steps to the next, packed."""
    if not len(names):
        return b""
    names = names >> U(shift)
    return names[:1].tobytes() + packed(names[1:] - names[:-1])


def _stepped(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U)
    return np.append(np.frombuffer(data, U, 1), unpacked(data[8:]).view(U)).cumsum(dtype=U)


_SHIFT = (0, 16, 16)         # words are named by 64 bits, longer n-grams by 48
_NAMES, _COUNTS = ([f"{kind}{order}" for order in range(1, ORDER + 1)] for kind in ("names", "counts"))
_SHEET = ["range", "sheet", "ids", "lengths", "ranks", "places", *_NAMES, *_COUNTS]
_ANSWER = ["range", "sheet", "ids", "lengths", "ranks", "places", "names1", *_COUNTS]


def _schema(columns: list[str]) -> str:
    return ", ".join(f"{c} " + {"range": "int", "sheet": "long", "ids": "array<bigint>"}.get(c, "binary") for c in columns)


def _table(columns: list[str], rows: list[dict]) -> pa.Table:
    kinds = {"range": pa.int32(), "sheet": pa.int64(), "ids": pa.list_(pa.int64())}
    return pa.table([pa.array([r.get(c) for r in rows], kinds.get(c, pa.binary())) for c in columns], names=columns)


def _sheets(batches, ranges):
    """A sheet of texts: a row with the ids, the texts' lengths in tokens and the place of each token among the sheet's words,
    and a row per hash range with its n-grams and how often each occurs in the training texts."""
    part = TaskContext.get().partitionId()
    nth, tokens = 0, 0
    ids, lengths, held = [], [], []

    def flush():
        nonlocal ids, lengths, held, nth, tokens
        sheet = (part << 32) + nth
        rows: dict[int, dict] = {}
        *parts, train = zip(*held, strict=True)
        held, train = [], np.concatenate(train)
        for order in range(ORDER):
            names, back = np.unique(np.concatenate(parts.pop(0)), return_inverse=True)
            times = np.bincount(back, train, len(names)).astype(np.int64)
            if not order:
                # Frequent words get small places, which pack well.
                ranks = np.argsort(-np.bincount(back), kind="stable")
                places = np.argsort(ranks)[back]
            elif len(names) and names[0] == 0:
                names, times = names[1:], times[1:]
            cut = np.searchsorted(_range(names, ranges), np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cut)):
                row = rows.setdefault(int(r), {"range": int(r), "sheet": sheet, **dict.fromkeys(_NAMES, b""), **dict.fromkeys(_COUNTS, packed(np.empty(0, U)))})
                row |= {_NAMES[order]: _steps(names[cut[r]:cut[r + 1]], _SHIFT[order]), _COUNTS[order]: packed(times[cut[r]:cut[r + 1]])}
        # The sheet's own row passes through one of the ranges, another for each sheet.
        own = {"range": (part + nth) % ranges, "sheet": sheet, "ids": pa.chunked_array(ids).combine_chunks().to_pylist(),
               "lengths": packed(np.concatenate(lengths)), "ranks": packed(ranks), "places": packed(places)}
        ids, lengths, nth, tokens = [], [], nth + 1, 0
        return _table(_SHEET, [own, *rows.values()]).to_batches()

    for batch in batches:
        training = np.asarray(batch.column("training").cast(pa.uint8()))
        for row, data, bounds in text_slices(batch.column("text")):
            doc, token = _sequences(Words(data, bounds))
            docs = len(bounds) - 1
            count = np.bincount(doc, minlength=docs) - 1
            held.append((*_grams(doc, token), np.repeat(training[row:row + docs], count)))
            ids.append(batch.column("doc_id").slice(row, docs))
            lengths.append(count)
            tokens += int(count.sum())
            if tokens >= FLUSH:
                yield from flush()
    if ids:
        yield from flush()


def _answered(entry_bits: int):
    def answer(table: pa.Table) -> pa.Table:
        """The rows of a range with the counts of words and the filter's levels of longer n-grams, over all sheets, instead
        of their own counts; a sheet's own row as it is."""
        rows = table.to_pylist()
        asked = [r for r in rows if r["ids"] is None]
        for order in range(ORDER):
            names = [_stepped(r[_NAMES[order]]) for r in asked]
            total, back = np.unique(np.concatenate(names or [np.empty(0, U)]), return_inverse=True)
            times = np.concatenate([unpacked(r[_COUNTS[order]]) for r in asked] or [np.empty(0, np.int64)])
            found = np.bincount(back, times, len(total)).astype(np.int64)
            if order:
                there = found > 0
                found = Segment(total[there], found[there], entry_bits).levels(total)
            found = found[back]
            last = 0
            for r, own in zip(asked, names, strict=True):
                r[_COUNTS[order]] = packed(found[last:last + len(own)])
                last += len(own)
        return _table(_ANSWER, rows)
    return answer


def _scored(types: int, tokens: int):
    mass = tokens + 0.5 * (types + 1)

    def score(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["ids"] is not None, r["range"]))
        own, rows = rows[-1], rows[:-1]
        length = unpacked(own["lengths"])
        docs = len(length)
        doc = np.repeat(np.arange(docs), length + 1)
        head = np.append(True, doc[1:] != doc[:-1])
        token = np.full(len(doc), BEGIN, U)
        token[~head] = np.concatenate([_stepped(r["names1"]) for r in rows])[unpacked(own["ranks"])[unpacked(own["places"])]]
        owner, first = doc[~head], head[:-1][~head[1:]]
        found = []
        for order, grams in enumerate(_grams(doc, token)):
            names, back = np.unique(grams, return_inverse=True)
            counts = np.concatenate([unpacked(r[_COUNTS[order]]) for r in rows]).astype(np.float64)
            if order and names[0] == 0:
                counts = np.append(0.0, counts)
            if len(counts) != len(names):
                raise ValueError(f"{len(counts)} counts for {len(names)} n-grams of a sheet")
            found.append(counts[back] if not order else _middle(counts[back]))
        c1, c2, c3 = found
        before, before2 = (np.where(first, 0.0, np.append(0.0, c[:-1])) for c in (c1, c2))
        p = (c1 + 0.5) / mass
        base = np.log10(p)
        for count, history, weight in ((c2, before, M2), (c3, before2, M3)):
            p = (np.minimum(count, history) + weight * p) / (history + weight)
        by_doc = lambda value: np.bincount(owner, value, minlength=docs)
        return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "n_tokens": length, "n_known": by_doc(c1 > 0).astype(np.int64),
                         "base_score": by_doc(base), "score": by_doc(np.log10(p))})
    return score


def _distinct_words(batches, ranges):
    """The distinct words of a task's texts by hash range, about FLUSH at a time; the number of tokens in the first row."""
    seen, tokens = np.empty(0, U), 0

    def flush():
        cut = np.searchsorted(_range(seen, ranges), np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(cut))
        return pa.record_batch([pa.array(used, pa.int32()), pa.array([_steps(seen[cut[r]:cut[r + 1]], 0) for r in used], pa.binary()),
                                pa.array([tokens, *[0] * (len(used) - 1)], pa.int64())], names=["range", "words", "tokens"])

    for batch in batches:
        for _, data, bounds in text_slices(batch.column("text")):
            own = Words(data, bounds).hash
            tokens += len(own) + len(bounds) - 1
            seen = np.union1d(seen, np.append(own, END))
            if len(seen) >= FLUSH:
                yield flush()
                seen, tokens = np.empty(0, U), 0
    if len(seen):
        yield flush()


def _vocabulary(table: pa.Table) -> pa.Table:
    names = np.unique(np.concatenate([_stepped(w) for w in table.column("words").to_pylist()]))
    return pa.table({"types": pa.array([len(names)], pa.int64()), "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64())})


def score_texts(docs: DataFrame, training: Column, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``, learned from its rows where
    ``training`` holds: words and one end are the tokens of a text.

    base_score: sum of log10((c + 0.5) / (N + 0.5 (V + 1))) with exact training counts; n_known: tokens with c > 0;
    score: log10 probability under the model, with exact training counts of words and the filter's levels of all longer
    n-grams; ``entry_bits`` sets the size of the filter. Null and empty texts are one end
    token; rows where ``training`` is null do not train; repeated rows count and are scored each; without training texts
    all counts are 0; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    ranges = _ranges(rows)
    words = rows.filter("training").select("text").mapInArrow(partial(_distinct_words, ranges=ranges), "range int, words binary, tokens long")
    types, tokens = (int(x or 0) for x in words.groupBy("range").applyInArrow(_vocabulary, "types long, tokens long").agg(F.sum("types"), F.sum("tokens")).first())
    answers = rows.mapInArrow(partial(_sheets, ranges=ranges), _schema(_SHEET)).groupBy("range").applyInArrow(_answered(entry_bits), _schema(_ANSWER))
    scored = answers.groupBy("sheet").applyInArrow(_scored(types, tokens), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
