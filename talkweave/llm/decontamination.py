"""Documents that hold items of a benchmark: BM25 retrieval with block-max pruning, then a check of question and answer.

The benchmark's items, cut into entries of at most ``SPAN`` words, form an inverted index with BM25 impacts, each divided
by the entry's score for itself. Every passage of every document is a query: two neighbouring runs of ``SPAN`` words, so
that an entry lies whole in some passage. All entries of at least ``THRESHOLD`` are retrieved. As in block-max WAND,
lists and blocks are skipped by upper bounds: passages whose terms' largest impacts cannot reach the threshold, then blocks
of entries whose largest impacts cannot, and only then are postings summed. The bounds are arrays over all passages of
a slice instead of cursors, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ragged import Words, fold, text_slices

SPAN = 64
BLOCK = 16                 # entries under one block maximum
THRESHOLD = 0.6            # of an entry's score for itself
WIDTH = 5                  # words of the shingles that verify a match
QUESTION, ANSWER = 0.8, 0.6
INDEX_BYTES = 16 << 20     # benchmark text in one index, which is broadcast; more makes more indexes, one pass each
K1, B = 1.2, 0.75
BROADCAST_ROWS = 500_000


def _arrow_words(texts: list[str]):
    for _, data, bounds in text_slices(pc.utf8_lower(pa.array(texts, pa.string())), 1 << 60):
        return Words(data, bounds, punctuation=False)
    return Words(np.empty(0, np.uint8), np.zeros(1, np.int64))


@dataclass
class Index:
    terms: np.ndarray         # sorted word hashes
    most: np.ndarray          # largest impact of each term
    block_most: np.ndarray    # (posting blocks) largest impact; see block_start, block_id
    block_start: np.ndarray   # term -> first posting block
    block_id: np.ndarray
    post_start: np.ndarray    # posting block -> first posting
    entry: np.ndarray
    impact: np.ndarray
    item: np.ndarray          # entry -> item position
    item_ids: list
    shingles: list[np.ndarray]   # item -> hashes of its shingles in order
    question: np.ndarray      # item -> words before the answer; all of them if there is one sentence only
    words: np.ndarray         # item -> number of words


def _last_sentence(text: str) -> int:
    """Where the last sentence of ``text`` begins; its length if it has one only."""
    body = text.rstrip(" \t\r\n.?!")
    at = max(body.rfind(c) for c in ".?!\n")
    return at + 1 if at >= 0 else len(text)


@dataclass
class Statistics:
    """Counts over the entries of the whole benchmark."""
    entries: int
    words: int
    terms: np.ndarray         # sorted word hashes
    df: np.ndarray            # entries that hold the word


def _postings(words: Words):
    """(words of an item, entries of an item, terms, and term, entry and count of each posting)."""
    count = words.counts()
    first = np.append(0, count.cumsum())
    nth = np.arange(len(words.hash)) - first[words.doc]
    fit = count >= WIDTH
    run = np.where(fit, np.maximum(1, -(-count // SPAN)), 0)
    base = np.append(0, run.cumsum())
    use = fit[words.doc]
    entry = (base[words.doc] + nth * run[words.doc] // np.maximum(1, count[words.doc]))[use]
    terms, term = np.unique(words.hash[use], return_inverse=True)
    n = max(int(base[-1]), 1)
    pair, tf = np.unique(term * n + entry, return_counts=True)
    return count, run, terms, pair // n, pair % n, tf


def _counted(batches):
    """Rows (part, term, df, words) of each batch of items (part, text); the one without a term has the number of entries."""
    for batch in batches:
        part = np.asarray(batch.column("part"))
        for p in np.unique(part):
            _, run, terms, term, _, tf = _postings(_arrow_words(batch.column("text").filter(pa.array(part == p)).to_pylist()))
            df = np.append(np.bincount(term, minlength=len(terms)), run.sum())
            names = pa.array([*terms.view(np.int64).tolist(), None], pa.int64())
            yield pa.record_batch([pa.array(np.full(len(df), p), pa.int32()), names, pa.array(df, pa.int64()),
                                   pa.array(np.append(np.zeros(len(terms), np.int64), int(tf.sum())), pa.int64())], names=["part", "term", "df", "words"])


def statistics(items: DataFrame) -> DataFrame:
    """Counts of all ``items`` (part, text), for each part the terms it holds: part, term, df, words. Part -1, without a
    term, has the number of entries and of words."""
    rows = items.mapInArrow(_counted, "part int, term long, df long, words long")
    each = written(rows.groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "benchmark-terms")
    whole = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    own = each.filter("term is not null").select("part", "term").join(whole, "term").select("part", "term", "df", "words")
    return written(own.unionByName(whole.filter("term is null").withColumn("part", F.lit(-1))), "benchmark-statistics")


def _statistics_of(table: DataFrame, part: int) -> Statistics:
    """Those of one part's terms: no more than its index holds."""
    rows = table.filter(F.col("part").isin(-1, part)).select("term", "df", "words").collect()
    entries, words = next(((r[1], r[2]) for r in rows if r[0] is None), (0, 0))
    terms = np.array([r[0] for r in rows if r[0] is not None], np.int64).view(np.uint64)
    order = np.argsort(terms)
    return Statistics(entries, words, terms[order], np.array([r[1] for r in rows if r[0] is not None], np.int64)[order])


def build_index(ids: list, texts: list[str], whole: Statistics | None = None) -> Index:
    """The index of these items; ``whole`` has the counts of all items where these are a part of them."""
    words = _arrow_words(texts)
    count, run, terms, term, entry, tf = _postings(words)
    question = _arrow_words([t[:_last_sentence(t)] for t in texts]).counts()
    question = np.where(question < count, np.minimum(question, np.maximum(count - WIDTH, 0)), count)
    first = np.append(0, count.cumsum())
    n = int(run.sum())
    length = np.bincount(entry, tf, minlength=n)
    if whole is None:
        whole = Statistics(n, int(tf.sum()), terms, np.bincount(term, minlength=len(terms)))
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log1p((whole.entries - df + 0.5) / (df + 0.5))
    mean = max(whole.words / max(whole.entries, 1), 1e-9)
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[entry] / mean))
    impact = impact / np.bincount(entry, impact, minlength=n)[entry]
    block = term * (n // BLOCK + 1) + entry // BLOCK
    head = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
    most = np.zeros(len(terms))
    np.maximum.at(most, term, impact)
    return Index(terms, most, np.maximum.reduceat(impact, head) if len(head) else impact, np.searchsorted(term[head], np.arange(len(terms) + 1)),
                 entry[head] // BLOCK, np.append(head, len(entry)), entry, impact, np.repeat(np.arange(len(ids)), run), list(ids),
                 [fold(words.hash[first[k]:first[k + 1]], WIDTH) for k in range(len(ids))], question, count)


def _spread(start: np.ndarray, key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, owner) of all positions start[key] to start[key + 1]."""
    size = start[key + 1] - start[key]
    total = np.append(0, size.cumsum())
    at = np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(start[key], size)
    return at, np.repeat(owner, size)


def retrieve(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, entry, score) of all (passage, entry) pairs of at least THRESHOLD; first word counts in the slice."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(index.terms) or not len(words.hash):
        return none
    term = np.minimum(np.searchsorted(index.terms, words.hash), len(index.terms) - 1)
    known = index.terms[term] == words.hash
    count = words.counts()
    first = np.append(0, count.cumsum())
    nth = np.arange(len(words.hash)) - first[words.doc]
    runs = -(-count // SPAN)
    base = np.append(0, runs.cumsum())
    run = base[words.doc] + nth // SPAN
    pair = np.unique((run * len(index.terms) + term)[known])
    run, term = pair // len(index.terms), pair % len(index.terms)
    bound = np.bincount(run, index.most[term], minlength=int(base[-1]))
    home = np.repeat(np.arange(words.docs), runs)
    follows = np.append(home[1:] == home[:-1], False)
    both = bound + np.where(follows, np.append(bound[1:], 0), 0)
    passage = np.flatnonzero(both >= THRESHOLD)
    if not len(passage):
        return none
    at = np.searchsorted(run, np.arange(int(base[-1]) + 1))
    mine, who = _spread(at, passage, np.arange(len(passage)))
    next_run = np.where(follows[passage], passage + 1, passage)
    more, also = _spread(at, next_run[next_run > passage], np.flatnonzero(next_run > passage))
    pair = np.unique(np.append(who * len(index.terms) + term[mine], also * len(index.terms) + term[more]))
    who, term = pair // len(index.terms), pair % len(index.terms)
    keep = np.bincount(who, index.most[term], minlength=len(passage)) >= THRESHOLD
    who, term = who[keep[who]], term[keep[who]]
    spot, who = _spread(index.block_start, term, who)
    blocks = int(index.block_id.max()) + 1
    key = who * blocks + index.block_id[spot]
    names, key = np.unique(key, return_inverse=True)
    live = np.bincount(key, index.block_most[spot], minlength=len(names)) >= THRESHOLD
    spot, key = spot[live[key]], key[live[key]]
    post, key = _spread(index.post_start, spot, key)
    cell = key * BLOCK + index.entry[post] % BLOCK
    cells, back = np.unique(cell, return_inverse=True)
    score = np.bincount(back, index.impact[post], minlength=len(cells))
    good = np.flatnonzero(score >= THRESHOLD)
    name = names[cells[good] // BLOCK]
    run = passage[name // blocks]
    return first[home[run]] + (run - base[home[run]]) * SPAN, name % blocks * BLOCK + cells[good] % BLOCK, score[good]


def _matches(batches, index):
    index = index.value
    for batch in batches:
        for row, data, bounds in text_slices(pc.utf8_lower(batch.column("text"))):
            words = Words(data, bounds, punctuation=False)
            begin, entry, score = retrieve(words, index)
            if not len(entry):
                continue
            last = np.append(0, words.counts().cumsum())
            best: dict[tuple[int, int], tuple] = {}
            for b, item, s in zip(begin.tolist(), index.item[entry].tolist(), score.tolist(), strict=True):
                doc = int(words.doc[b])
                lo, hi = max(int(last[doc]), b - int(index.words[item])), min(int(last[doc + 1]), b + 2 * SPAN + int(index.words[item]))
                there = fold(words.hash[lo:hi], WIDTH)
                found = np.isin(index.shingles[item], there)
                covered = np.zeros(int(index.words[item]), bool)
                for j in range(WIDTH):
                    covered[j:j + len(found)] |= found
                q = int(index.question[item]) or len(covered)
                asked, answered = float(covered[:q].mean()), float(covered[q:].mean()) if q < len(covered) else 1.0
                if asked >= QUESTION and answered >= ANSWER:
                    spots = np.flatnonzero(np.isin(there, index.shingles[item]))
                    got = (s, asked, answered, lo - int(last[doc]) + int(spots[0]), lo - int(last[doc]) + int(spots[-1]) + WIDTH)
                    if got[:3] > best.get((doc, item), (-1.0,))[:3]:
                        best[doc, item] = got
            if best:
                keys = sorted(best)
                cols = list(zip(*(best[k] for k in keys), strict=True))
                yield pa.record_batch([batch.column("doc_id").take(pa.array([row + d for d, _ in keys])), pa.array([index.item_ids[i] for _, i in keys], pa.int64()),
                                       *(pa.array(c, pa.float64()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])],
                                      names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item it holds: doc_id, item_id, score (BM25 over the item's own), the covered
    shares of question and answer, and the words (from 0, the end excluded) between which the item lies.

    An item's answer is its last sentence, if it has several, and the words before it as far as it has fewer than five. A word of an item is covered if one of the item's
    five-word shingles that holds it is found near the passage; QUESTION and ANSWER are the least shares. Words are
    runs of letters and digits in lower case. Items with fewer than five words, null texts or ids take no part; equal items
    are each reported. A repeated document is reported for each of its rows; null and empty texts hold nothing. Empty
    tables give an empty result. A benchmark of more than INDEX_BYTES is cut into indexes by hash, each of which sees
    all documents and weighs words by their counts in the whole benchmark, so that scores do not depend on the cut. Very
    long texts are taken whole, in slices of passages; of equal places of an item the first in its document is reported.
    """
    spark = docs.sparkSession
    items = benchmark.filter("text is not null and item_id is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // INDEX_BYTES) + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    counts = statistics(items.select("part", "text")) if parts > 1 else None       # the items of a single part are all items
    out = None
    for part in range(parts):
        rows = items.filter(F.col("part") == part).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows],
                                                        None if counts is None else _statistics_of(counts, part)))
        found = docs.select("doc_id", "text").mapInArrow(
            partial(_matches, index=held), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark item. Only their ids are moved, broadcast while
    they are few. Rows with a null doc_id stay."""
    gone = written(benchmark_matches(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct(), "contaminated")
    hint = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(hint, "doc_id", "left_anti").select(docs.columns)
