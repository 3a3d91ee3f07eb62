"""Alignment of two tokenizers over whole texts by interval coalescing, and how common each linked id pair is.

A byte-level tokenizer (A) reads a space and the text, a piece tokenizer (B) reads the text and adds that space itself, so
both cut the same bytes. All tokens of a slice of texts become byte intervals: sorted by start, with the running maximum of
their ends; a group breaks where a start reaches that maximum. Overlaps expand inside the groups.

How many documents hold an id pair is counted on sheets of some megabytes of text: a sheet sends its distinct pairs by
buckets of A ids, sums are made by slab of sheets and then over all slabs, and go back to the sheets that asked.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import written
from .ragged import U, packed, text_slices, unpacked
from .tokens import _byte_names

SLICE = 1 << 18          # bytes of text aligned at once; a longer text is a slice of its own
SHEET = 1 << 20          # links whose pairs are asked about at once, about
SLAB = 512               # sheets whose pairs a reducer adds up at once
# The pattern that cuts text into words before A's merges, and characters whose classes no library disputes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")


@cache
def _byte_level(path: str):
    """(tokenizer, bytes of each id) of a ``tokenizers`` .json file with byte-level names."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {name: b for b, name in enumerate(_byte_names())}
    table = [b""] * (max(tokenizer.get_vocab_size(), max(vocab.values()) + 1))
    for name, i in vocab.items():
        table[i] = bytes(byte[c] for c in name)
    return tokenizer, table


@cache
def _pieces(path: str):
    """(processor, bytes of each id) of a ``sentencepiece`` .model file."""
    import sentencepiece
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(processor.get_piece_size())
    table = [bytes([int(processor.id_to_piece(i)[3:-1], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return processor, table


@cache
def _plain(path: str):
    """The same vocabulary for plain text in the faster library: its ranks are the ids, in the order of the merges."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, table = {t["content"] for t in spec["added_tokens"]}, _byte_level(path)[1]
    ranks = {table[i]: i for name, i in spec["model"]["vocab"].items() if name not in added}
    in_order = all(ranks[table[spec["model"]["vocab"][x]] + table[spec["model"]["vocab"][y]]] == 256 + k for k, (x, y) in enumerate(map(_pair, spec["model"]["merges"])))
    return tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if in_order else None


def _pair(merge) -> tuple[str, str]:
    return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)


def encoded(texts: list[str], path_a: str, path_b: str) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of A and B for each text; none for an empty text, or where the bytes of either do not give the text back."""
    a, bytes_a = _byte_level(path_a)
    b, bytes_b = _pieces(path_b)
    plain = _plain(path_a)
    left = [plain.encode_ordinary(" " + t) if plain and PLAIN.fullmatch(t) else a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    right = b.encode(texts, num_threads=1) if texts else []
    for k, text in enumerate(texts):
        raw = b" " + text.encode()
        if not text or b"".join(map(bytes_a.__getitem__, left[k])) != raw or b"".join(map(bytes_b.__getitem__, right[k])) != raw:
            left[k], right[k] = [], []
    return left, right


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B interval, numbered along the line."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((np.arange(len(start)) >= len(start_a), start))
    reach = np.maximum.accumulate(end[order]) if len(end) else end
    group = np.empty(len(start), np.int64)
    group[order] = np.append(0, start[order][1:] >= reach[:-1]).cumsum()[:len(start)]
    return group[:len(start_a)], group[len(start_a):]


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into A, into B) of all overlapping intervals; both sides ascend and are disjoint."""
    low = np.searchsorted(end_b, start_a, "right")
    times = np.searchsorted(start_b, end_a, "left") - low
    first = times.cumsum() - times
    a = np.repeat(np.arange(len(start_a)), times)
    return a, np.arange(len(a)) - first[a] + low[a]


@cache
def _decimals(ids: int) -> np.ndarray:
    """The decimal digits of the numbers below ``ids``, a row each, with room for one more byte."""
    width = len(str(ids - 1))
    return np.pad(np.arange(ids).astype(f"S{width}").view(np.uint8).reshape(ids, width), ((0, 0), (0, 1)))


def _written_ids(ids: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each with the byte ``after`` it (0: none): (bytes, where each id's begin)."""
    table = _decimals(size)
    digits = (table > 0).sum(1)
    wide = table[ids]
    wide[np.arange(len(ids)), digits[ids]] = after
    return wide[wide > 0], np.append(0, (digits[ids] + (after > 0)).cumsum())


def _aligned(batches, path_a, path_b):
    size_a, size_b = (np.array([len(x) for x in table[1]], np.int64) for table in (_byte_level(path_a), _pieces(path_b)))
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for row, data, bounds in text_slices(texts, SLICE):
            docs = len(bounds) - 1
            left, right = encoded(texts.slice(row, docs).to_pylist(), path_a, path_b)
            n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
            a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((left, n_a), (right, n_b)))
            end_a, end_b = size_a[a].cumsum(), size_b[b].cumsum()
            span = end_a - size_a[a], end_a, end_b - size_b[b], end_b
            group_a, group_b = coalesced(*span)
            doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
            heads = np.append(True, group_a[1:] != group_a[:-1])[:len(a)]
            i, j = overlaps(*span)
            link = a[i].astype(U) << U(32) | b[j].astype(U)
            owner = doc_a[i]
            link = link[np.lexsort((link, owner))]
            n_links = np.bincount(owner, minlength=docs)
            # the groups as text: A's ids, a bar, B's ids; groups in order
            side = np.append(np.zeros(len(a), np.int64), np.ones(len(b), np.int64))
            key = np.append(group_a, group_b) * 2 + side
            order = np.argsort(key, kind="stable")
            key, doc = key[order], np.append(doc_a, doc_b)[order]
            after = np.where(key[1:] == key[:-1], ord(","), np.where(key[1:] >> 1 == key[:-1] >> 1, ord("|"), np.where(doc[1:] == doc[:-1], ord(";"), 0)))
            text, at = _written_ids(np.append(a, b)[order], np.append(after, 0)[:len(order)].astype(np.uint8), max(len(size_a), len(size_b)))
            cut = at[np.append(0, (n_a + n_b).cumsum())]
            at_link = np.append(0, n_links.cumsum())
            yield pa.record_batch([
                batch.column("doc_id").slice(row, docs), pa.array(n_a), pa.array(n_b), pa.array(np.bincount(doc_a[heads], minlength=docs)), pa.array(n_links),
                pa.array([text[cut[d]:cut[d + 1]].tobytes().decode() for d in range(docs)], pa.string()),
                pa.array([link[at_link[d]:at_link[d + 1]].tobytes() for d in range(docs)], pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text; other columns are not looked at): doc_id, n_a and n_b (tokens), n_groups,
    n_links, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B, in order) and links (an unsigned 64-bit a << 32 | b for each
    overlapping pair of tokens, ascending, little-endian).

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a ``sentencepiece`` model that adds the leading space. Texts
    are taken whole, whatever their length; strings of special tokens are plain text. Null and empty texts, and texts that
    the joined bytes of A or of B do not give back, have zeros, an empty ``groups`` and empty ``links``. Rows with a null
    doc_id and repeated rows are rows like others; an empty table gives an empty result. No ties arise: bytes cut the groups.
    """
    return docs.select("doc_id", "text").mapInArrow(
        partial(_aligned, path_a=path_a, path_b=path_b), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary")


def _sheets(batches):
    """A row per run of documents: their columns, the distinct pairs in them with the number of documents that hold each, and
    per document its pairs (as places among the distinct) and how often each occurs."""
    nth = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def flush():
        nonlocal nth
        flat, length = (np.concatenate([h[i] for h in held]) for i in range(2))
        rest = pa.concat_arrays([h[2] for h in held])
        held.clear()
        doc = np.repeat(np.arange(len(length)), length)
        at = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1]))[:len(flat)])
        times = np.diff(np.append(at, len(flat)))
        names, back = np.unique(flat[at], return_inverse=True)
        nth += 1
        return pa.record_batch([
            pa.array([nth], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest),
            *(pa.array([x], pa.binary()) for x in (packed(np.diff(names, prepend=U(0))), packed(np.bincount(back, minlength=len(names))),
                                                  packed(np.bincount(doc[at], minlength=len(length))), packed(back), packed(times)))],
            names=["sheet", "rows", "names", "holders", "lengths", "places", "times"])

    n = 0
    for batch in batches:
        links = batch.column("links").fill_null(b"").cast(pa.large_binary())
        _, offsets, data = links.buffers()
        at = np.frombuffer(offsets, np.int64, len(links) + 1, links.offset * 8) // 8
        flat = np.frombuffer(data, U, at[-1] - at[0], at[0] * 8) if len(links) and at[-1] > at[0] else np.empty(0, U)
        at, rest = at - at[0], batch.drop_columns(["links"]).to_struct_array()
        row = 0
        while row < len(links):
            to = min(len(links), max(row + 1, int(np.searchsorted(at, at[row] + SHEET - n, "right")) - 1))
            held.append((flat[at[row]:at[to]], np.diff(at[row:to + 1]), rest.slice(row, to - row)))
            n += int(at[to] - at[row])
            row = to
            if n >= SHEET or row < len(links):
                yield flush()
                n = 0
    if held:
        yield flush()


def _names(data: bytes) -> np.ndarray:
    return unpacked(data).astype(U).cumsum(dtype=U)


def _asks(batches, buckets):
    """A sheet's pairs by bucket of their A ids: (bucket, slab, sheet, names, holders)."""
    for batch in batches:
        for sheet, names, holders in zip(*(batch.column(c).to_pylist() for c in ("sheet", "names", "holders")), strict=True):
            name, held = _names(names), unpacked(holders)
            bucket = (name >> U(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            parts = [order[cut[b]:cut[b + 1]] for b in used]
            slab = int.from_bytes(hashlib.blake2b(sheet.to_bytes(8, "little"), digest_size=6).digest(), "little")
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array([slab] * len(used), pa.int64()), pa.array([sheet] * len(used), pa.int64()),
                                   pa.array([packed(np.diff(name[p], prepend=U(0))) for p in parts], pa.binary()), pa.array([packed(held[p]) for p in parts], pa.binary())],
                                  names=["bucket", "slab", "sheet", "names", "holders"])


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([_names(x) for x in table.column("names").to_pylist()] or [np.empty(0, U)])
    held = np.concatenate([unpacked(x) for x in table.column("holders").to_pylist()] or [np.empty(0, np.int64)])
    order = np.argsort(names, kind="stable")
    names, held = names[order], held[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])[:len(names)])
    return names[first], np.add.reduceat(held, first) if len(first) else held


def _slab_sums(table: pa.Table) -> pa.Table:
    names, held = _summed(table)
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "names": [packed(np.diff(names, prepend=U(0)))], "holders": [packed(held)]})


def _totals(table: pa.Table) -> pa.Table:
    """Exact totals of a bucket's pairs, and whether each is the highest of its A id."""
    names, held = _summed(table)
    a = names >> U(32)
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])[:len(a)])
    top = np.repeat(np.maximum.reduceat(held, first), np.diff(np.append(first, len(a)))) if len(a) else held
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "names": [packed(np.diff(names, prepend=U(0)))], "holders": [packed(held)],
                     "best": [packed(held == top)]})


_ANSWER = "sheet long, names binary, holders binary, best binary"


def _answered(totals: pa.Table, asks: pa.Table) -> pa.Table:
    rows = {"sheet": [], "names": [], "holders": [], "best": []}
    if totals.num_rows:
        total = totals.to_pylist()[0]
        names, held, best = _names(total["names"]), unpacked(total["holders"]), unpacked(total["best"])
        for sheet, own in zip(asks.column("sheet").to_pylist(), asks.column("names").to_pylist(), strict=True):
            at = np.searchsorted(names, _names(own))
            for name, value in (("sheet", sheet), ("names", own), ("holders", packed(held[at])), ("best", packed(best[at]))):
                rows[name].append(value)
    return pa.table([pa.array(rows["sheet"], pa.int64()), *(pa.array(rows[c], pa.binary()) for c in ("names", "holders", "best"))], names=list(rows))


def _told(sheet: pa.Table, answers: pa.Table) -> pa.Table:
    own = sheet.combine_chunks().to_batches()[0]
    parts = answers.to_pylist()
    names = np.concatenate([_names(p["names"]) for p in parts] or [np.empty(0, U)])
    order = np.argsort(names)
    held, best = (np.concatenate([unpacked(p[c]) for p in parts] or [np.empty(0, np.int64)])[order] for c in ("holders", "best"))
    lengths, places, times = (unpacked(own.column(c)[0].as_py()) for c in ("lengths", "places", "times"))
    at = np.append(0, lengths.cumsum())
    run = [np.append(0, (times * value[places]).cumsum()) for value in (best, held)]
    rows = own.column("rows").flatten()
    return pa.table([*rows.flatten(), *(pa.array(r[at[1:]] - r[at[:-1]], pa.int64()) for r in run)], names=[*(f.name for f in rows.type), "n_best", "count_sum"])


def count_links(aligned: DataFrame) -> DataFrame:
    """The rows of ``aligned`` (its column links as ``align_tokens`` writes it) without links, and with n_best (links whose
    pair is held by as many documents as any pair of its A id; ties count) and count_sum (over links, the number of documents
    that hold the pair). A document is a row; every row counts. Null links count as none. An empty table gives an empty result.

    Sheets are written to the shared folder once, so no text is encoded twice.
    """
    spark = aligned.sparkSession
    rest = [f for f in aligned.schema.fields if f.name != "links"]
    shape = StructType([StructField("sheet", LongType()), StructField("rows", ArrayType(StructType(rest)))])
    more = "sheet long, names binary, holders binary, lengths binary, places binary, times binary"
    schema = StructType([*shape.fields, *StructType.fromDDL(more).fields[1:]])
    sheets = written(aligned.mapInArrow(_sheets, schema), "alignment-sheets")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slabs = int(sheets.count() // SLAB) + 1
    asks = (sheets.select("sheet", "names", "holders").mapInArrow(partial(_asks, buckets=buckets), "bucket int, slab long, sheet long, names binary, holders binary")
            .withColumn("slab", F.pmod("slab", F.lit(slabs)).cast("int")))
    sums = asks.groupBy("bucket", "slab").applyInArrow(_slab_sums, "bucket int, names binary, holders binary")
    totals = sums.groupBy("bucket").applyInArrow(_totals, "bucket int, names binary, holders binary, best binary")
    spread = totals.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    answers = spread.groupBy("bucket", "slab").cogroup(asks.groupBy("bucket", "slab")).applyInArrow(_answered, _ANSWER)
    out = StructType([*rest, StructField("n_best", LongType()), StructField("count_sum", LongType())])
    return sheets.select("sheet", "rows", "lengths", "places", "times").groupBy("sheet").cogroup(answers.groupBy("sheet")).applyInArrow(_told, out)
