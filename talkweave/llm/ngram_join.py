"""Jaccard self-join of documents on their word shingles, by vertical partitioning.

The global order of shingles is the order of their hashes. It is cut into fragments, every set is cut along with it, and
two uses follow.

* Candidates. Sets of similarity ``t`` differ in at most ``r = (1 - t) / t`` times the smaller size. Of ``2 r + 2`` fragments
  more than half are then equal in both. With all fragments in one global order, rarest first, two such sets have an
  equal one among the first ``r + 1`` of each, so only these are looked at: a passage that many documents share makes its
  fragments common, and they come last. Sizes are banded so that the two sets of a pair are cut alike; a set that
  reaches into lower bands is cut for those too. Families that come out large are chained anew by exact counts (``families``).
  First of all, sets that have too little in common with all others together are left out (``retained``).
* Counts. Sets chained by equal fragments form a family. Families are laid out in blocks, and blocks in parts; every pair of
  parts is compared one fragment at a time, each giving a small matrix of partial overlaps, and the matrices of a pair of parts
  are summed. Blocks hold sets of like size; those whose sizes cannot link do not meet. The sums are exact overlaps, so the similarity test is exact.

Equal sets are one class from the start and copies are never paired. No pair is emitted as a row: what leaves a pair of
parts is a spanning forest of its links and each member's number of links. A block travels as one row, once to each part that
it meets: its shingles once each, and the places of its members' among them, so near copies take little room.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .components import components
from .families import _led, _meet, refined
from .ragged import U, Words, mix, packed, shingle_sets, text_slices, unpacked
from .rarity import CELLS, cell_counts, rarest
from .retained import hashed_sets, hopeful, sketched

BLOCK = 128                # sets in a block; a task holds the blocks of two parts, of one fragment
SPAN = 16                  # blocks of a family from which a part holds more than one
PART = 4                   # blocks in a part at most
FRAGMENTS = 4              # fragments the overlaps are counted in
BAND = 1.5                 # ratio of the sizes that are cut alike
KEYS = 1 << 20             # fragment keys a task sorts at once
BUCKET_KEYS = 1 << 19      # fragment keys that meet in one reducer, about
BROADCAST_ROWS = 500_000   # member rows (48 bytes each) up to which they are broadcast


def _reach(size, percent: int):
    """The most elements in which a set of this size and one no smaller, at the threshold, can differ."""
    return (100 - percent) * size // percent


def _fragments(doc: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int):
    """For each band that sets reach into: (band by set, wanted sets, doc and index and key of the fragments that are not empty)."""
    band = np.floor(np.log(np.maximum(size, 1)) / np.log(BAND) + 1e-9).astype(np.int64)
    for lower in range(int(np.ceil(np.log(100 / percent) / np.log(BAND) - 1e-9)) + 1):
        tag = band - lower
        wanted = (size > 0) & (tag >= 0) & (size * percent <= 100 * np.ceil(BAND ** (tag + 1) + 1e-6))
        most = _reach(np.ceil(BAND ** (tag + 1.0)).astype(np.int64), percent)
        wanted &= most > 0
        take = wanted[doc]
        d, v = doc[take], value[take]
        if not len(d):
            continue
        cut = ((v >> U(32)) * (2 * most + 2)[d].astype(U)) >> U(32)
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (cut[1:] != cut[:-1])
        at = np.flatnonzero(first)
        run = np.concatenate([np.zeros(1, U), mix(v).cumsum(dtype=U)])
        total = run[np.append(at[1:], len(v))] - run[at]
        d, cut = d[at], cut[at]
        yield tag, wanted, most, d, cut, mix(total + mix(cut * U(4099) + tag[d].astype(U)))


def fragment_keys(doc: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(doc, key) of the fragments by which sets find each other: the ``r + 1`` rarest of each by ``counts``, empty ones last."""
    docs, keys = [np.empty(0, np.int64)], [np.empty(0, U)]
    for tag, wanted, most, d, cut, key in _fragments(doc, value, size, percent):
        chosen = rarest(d, key, np.zeros(CELLS, np.int64) if counts is None else counts, most + 1)
        docs.append(d[chosen])
        keys.append(key[chosen])
        filled = np.bincount(d, minlength=len(size))
        for k in np.flatnonzero(wanted & (filled <= most)):
            empty = _empty(cut[d == k], most[k], tag[k])
            docs.append(np.full(len(empty), k))
            keys.append(empty)
    return np.concatenate(docs), np.concatenate(keys)


def _empty(cut: np.ndarray, most: int, tag: int) -> np.ndarray:
    """Keys of the first empty fragments of a set that has too few others."""
    empty = np.setdiff1d(np.arange(2 * most + 2, dtype=U), cut)
    return np.sort(mix(mix(empty * U(4099) + U(tag))))[:most + 1 - len(cut)]


def _owned(batches, width, percent):
    """All fragments as (owner, key, last, table) of ``families.exact_edges``: a set is an owner in each band it reaches into."""
    for doc, value, size, cls in _class_sets(batches, width):
        owners, keys, lasts, tables, n = [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, bool)], [np.empty((0, 2), np.int64)], 0
        for tag, wanted, most, d, cut, key in _fragments(doc, value, size, percent):
            place = wanted.cumsum() - 1 + n
            filled = np.bincount(d, minlength=len(size))
            found = [(place[d], key, np.zeros(len(d), bool))]
            for k in np.flatnonzero(wanted & (filled <= most)):
                empty = _empty(cut[d == k], most[k], tag[k])
                found.append((np.full(len(empty), place[k]), empty, np.ones(len(empty), bool)))
            for out, part in zip((owners, keys, lasts), zip(*found, strict=True), strict=True):
                out += part
            tables.append(np.column_stack([cls[wanted], most[wanted] + 1]))
            n += int(wanted.sum())
        yield np.concatenate(owners), np.concatenate(keys), np.concatenate(lasts), np.concatenate(tables)


def _all_keys(batches, width, percent):
    for doc, value, size, _ in _class_sets(batches, width):
        for *_, key in _fragments(doc, value, size, percent):
            yield key


def _class_sets(batches, width):
    """(doc, hash, size, class) of the sets of each slice of (cls, text)."""
    for cls, doc, value, size, _ in hashed_sets(batches, width):
        yield doc, value, size, np.asarray(cls)


def _packed(batches, width, percent, buckets, counts):
    """Rows (bucket, keys, owner, classes, edges): each key once per flush, so a key that many sets share stays small."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        keys, cls, pairs = _led(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        names, owner = np.unique(cls, return_inverse=True)
        cut = np.searchsorted((keys >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1))
        share = np.array_split(pairs, buckets)
        spin = int(names[0] % buckets) if len(names) else 0
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            mine = share[(b + spin) % buckets]
            if hi > lo or len(mine):
                used, local = np.unique(owner[lo:hi], return_inverse=True)
                yield b, keys[lo:hi].tobytes(), local.astype(np.uint32).tobytes(), names[used].tobytes(), mine.tobytes()
        held.clear()

    def out(rows):
        rows = list(rows)
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)],
                               names=["bucket", "keys", "owner", "classes", "edges"])

    n = 0
    for doc, value, size, cls in _class_sets(batches, width):
        d, k = fragment_keys(doc, value, size, percent, counts)
        held.append((k, cls[d]))
        n += len(k)
        if n >= KEYS:
            yield out(flush())
            n = 0
    if n:
        yield out(flush())


_CUT = "cls long, copies long, family long, block int, part int, low int, high int, size long, fragment int, piece binary"


def _cut(batches, width):
    """The sets of family members in FRAGMENTS pieces; a row each, empty pieces too. Columns: text, then _CUT's first seven."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = [part.split()[0] for part in _CUT.split(",")]
    for batch in batches:
        for row, data, bounds in text_slices(batch.column(0)):
            words = Words(data, bounds)
            doc, value = shingle_sets(words, width)
            size = np.bincount(doc, minlength=words.docs)
            cut = (value >> U(32)) * U(FRAGMENTS) >> U(32)
            at = np.searchsorted(doc * FRAGMENTS + cut.astype(np.int64), np.arange(words.docs * FRAGMENTS + 1))
            for r in range(words.docs):
                rest = [batch.column(c)[row + r].as_py() for c in range(1, 8)]
                pieces = [value[at[r * FRAGMENTS + f]:at[r * FRAGMENTS + f + 1]].tobytes() for f in range(FRAGMENTS)]
                yield pa.record_batch([pa.array([x] * FRAGMENTS, t) for x, t in zip(rest, types, strict=True)]
                                      + [pa.array([int(size[r])] * FRAGMENTS, pa.int64()), pa.array(range(FRAGMENTS), pa.int32()), pa.array(pieces, pa.binary())], names=names)


def _own_text(batches, width):
    """The rows (cls, text) whose text is of that class."""
    for batch in batches:
        own = np.concatenate([found for *_, found in hashed_sets([batch], width)] or [np.empty(0, np.int64)])
        yield batch.filter(pa.array(own == np.asarray(batch.column("cls"))))


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns of a sorted stream, as lists of row tuples."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now and held:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def _overlaps(member: np.ndarray, value: np.ndarray, sets: int, left: int | None = None) -> np.ndarray:
    """Shared elements of every two of a few sets, given as (member, value); with ``left``, of each of the first with each of the rest."""
    _, at, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    place = shared.cumsum() - 1
    keep = shared[at]
    member, at = member[keep], place[at[keep]]
    total = np.zeros((sets, sets) if left is None else (left, sets - left), np.float32)
    order = np.argsort(at, kind="stable")
    member, at = member[order], at[order]
    for lo in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(at, (lo, lo + 4096))
        part = np.zeros((sets, int(at[j - 1]) - lo + 1), np.float32)
        part[member[i:j], at[i:j] - lo] = 1
        total += part @ part.T if left is None else part[:left] @ part[left:].T
    return total.astype(np.int32)


def shelved(lists: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Ascending lists of 64-bit values as (the values once each, the places of each list among them)."""
    values, at = np.unique(np.concatenate([np.empty(0, U), *lists]), return_inverse=True)
    steps = np.diff(at, prepend=0)
    size = np.array([len(x) for x in lists], np.int64)
    first = (size.cumsum() - size)[size > 0]
    steps[first] = at[first]
    return packed(np.diff(values, prepend=U(0))), packed(steps)


def unshelved(values: bytes, places: bytes, size: np.ndarray) -> np.ndarray:
    """What ``shelved`` took, one list after the other; ``size``: of each list."""
    steps, size = unpacked(places), size[size > 0]
    run = steps.cumsum()
    first = size.cumsum() - size
    return unpacked(values).astype(U).cumsum(dtype=U)[run - np.repeat(run[first] - steps[first], size)]


def _bundled(batches):
    """A row per (family, block, fragment): who is in the block, and their pieces."""
    for (family, block, fragment), held in _groups(batches, 3):
        held = sorted(held)
        _, _, _, part, low, high, _ = held[0]
        who = np.array([(cls, part, size, copies, len(piece) // 8) for cls, size, copies, *_, piece in held], np.int64)
        values, places = shelved([np.frombuffer(r[6], U) for r in held])
        yield pa.record_batch([pa.array([family], pa.int64()), *(pa.array([x], pa.int32()) for x in (block, part, low, high, fragment)),
                               *(pa.array([x], pa.binary()) for x in (who.tobytes(), values, places))],
                              names=["family", "block", "part", "low", "high", "fragment", "members", "values", "places"])


def _partial(batches):
    rows = []

    def out():
        return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(
            [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["family", "i", "j", "fragment", "members", "overlaps"])

    for (family, i, j, fragment), held in _groups(batches, 4):
        held = sorted(held, key=lambda r: r[:2])
        each = [np.frombuffer(r[2], np.int64).reshape(-1, 5) for r in held]
        who = np.concatenate(each)
        value = np.concatenate([unshelved(r[3], r[4], w[:, 4]) for r, w in zip(held, each, strict=True)])
        member = np.repeat(np.arange(len(who)), who[:, 4])
        left = None if i == j else int((who[:, 1] == i).sum())
        rows.append((family, i, j, fragment, who[:, :4].tobytes() if not fragment else b"", packed(_overlaps(member, value, len(who), left).ravel())))
        if len(rows) >= 64:
            yield out()
            rows = []
    if rows:
        yield out()


def _linked(batches, percent):
    rows = []
    for (_, i, j), held in _groups(batches, 3):
        who = np.frombuffer(next(r[1] for r in held if r[0] == 0), np.int64).reshape(-1, 4)
        cls, part, size, copies = who.T
        left = len(who) if i == j else int((part == i).sum())
        right = 0 if i == j else left
        overlap = sum(unpacked(r[2]) for r in held).reshape(left, len(who) - right)
        some = 100 * overlap >= percent * (size[:left, None] + size[None, right:] - overlap)
        link = np.zeros((len(who), len(who)), bool)
        link[:left, right:] = some
        if i != j:
            link[right:, :left] = some.T
        np.fill_diagonal(link, False)
        low = np.arange(len(who))
        while True:
            new = np.minimum(low, np.where(link, low[None, :], len(who)).min(1))
            if (new == low).all():
                break
            low = new
        links = link @ copies
        for k in np.flatnonzero(links):
            rows.append((int(cls[k]), int(cls[low[k]]), int(links[k])))
        if len(rows) >= 4096:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "links"])
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "links"])


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents linked when 100 * |A & B| >= percent * |A | B| over their distinct ``width``-word shingles.

    Returns a row for each row of ``docs`` (doc_id, text; other columns are not looked at): doc_id, n_shingles (size of
    the set), component_id (smallest doc_id reachable by links, itself included), n_links (other rows it links with).
    Fewer words than ``width`` are one shingle; null, empty and wordless texts have no set and link with nothing. Rows
    with a null doc_id link with nothing and get a null component_id. Repeated rows are copies of each other. An empty
    table gives an empty result. ``percent`` is 51 to 100.
    """
    if not 51 <= percent <= 100:
        raise ValueError("percent is 51 to 100")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sized = sketched(docs, width, "ngram-sized")
    classes = (sized.filter("doc_id is not null and n_shingles > 0").groupBy("cls", "n_shingles")
               .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    hopes = hopeful(sized, classes, percent, "ngram-hopeful")
    some = F.broadcast(hopes) if hopes.count() <= BROADCAST_ROWS else hopes
    # A repeated id may bring other texts: those of the class are kept, one for each class.
    reps = docs.join(some, docs.doc_id == some.rep).select("cls", "text").mapInArrow(partial(_own_text, width=width), "cls long, text string")
    texts = written(reps.dropDuplicates(["cls"]), "ngram-texts")
    total = hopes.agg(F.sum("n_shingles")).first()[0] or 0
    keys = total * (100 - percent) // percent * 3 // 2
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // BUCKET_KEYS + 1)
    shared = spark.sparkContext.broadcast(cell_counts(texts, partial(_all_keys, width=width, percent=percent)))

    def key_rows(batches):
        return _packed(batches, width, percent, buckets, shared.value)

    edges = texts.mapInArrow(key_rows, "bucket int, keys binary, owner binary, classes binary, edges binary").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    each = 2 * keys // max(1, hopes.count()) + 1
    families = refined(components(edges, "ngram-families"), texts, partial(_owned, width=width, percent=percent), each, "ngram-refined")

    # Blocks of like size, in parts of one or a few blocks: two sets that link lie in the same band of sizes or in neighbouring ones.
    ratio = max(100 / percent, 1.0001)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("int")
    member = families.join(classes.withColumnRenamed("cls", "node"), "node").withColumn("band", band)
    along = Window.partitionBy("root").orderBy("band")
    bands = member.groupBy("root", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("n"))
    bands = bands.withColumn("first", F.sum("n").over(along) - F.col("n"))
    low = F.when(F.lag("band").over(along) == F.col("band") - 1, F.lag("first").over(along)).otherwise(F.col("first"))
    high = F.col("first") + F.col("n") - 1 + F.when(F.lead("band").over(along) == F.col("band") + 1, F.lead("n").over(along)).otherwise(0)
    step = F.least(F.ceil(F.sum("n").over(Window.partitionBy("root")) / F.lit(SPAN)), F.lit(PART)).cast("int")
    bands = bands.select("root", "band", "n", "first", step.alias("step"), low.alias("low"), high.alias("high"))
    part = lambda block: F.floor(block / F.col("step")).cast("int")
    members = written(
        member.join(bands, ["root", "band"])
        .select(F.col("node").alias("cls"), "copies", F.col("root").alias("family"),
                (F.col("first") + F.pmod(F.xxhash64("node"), F.col("n"))).cast("int").alias("block"), "step", "low", "high")
        .withColumns({"part": part(F.col("block")), "low": part(F.col("low")), "high": part(F.col("high"))}).drop("step"), "ngram-members")
    chosen = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    pieces = texts.join(chosen, "cls").select("text", "cls", "copies", "family", "block", "part", "low", "high").mapInArrow(partial(_cut, width=width), _CUT)
    bundles = (pieces.select("family", "block", "fragment", "cls", "size", "copies", "part", "low", "high", "piece")
               .repartition("family", "block", "fragment").sortWithinPartitions("family", "block", "fragment")
               .mapInArrow(_bundled, "family long, block int, part int, low int, high int, fragment int, members binary, values binary, places binary"))
    paired = (bundles.withColumn("other", F.explode(F.sequence("low", "high")))
              .select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fragment", "part", "block", "members", "values", "places"))
    counted = (paired.repartition("family", "i", "j", "fragment").sortWithinPartitions("family", "i", "j", "fragment", "part", "block")
               .mapInArrow(_partial, "family long, i int, j int, fragment int, members binary, overlaps binary"))
    linked = written(counted.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "fragment")
                     .mapInArrow(partial(_linked, percent=percent), "a long, b long, links long"), "ngram-links")

    sized = sized.drop("sketch")
    joined = components(linked.select("a", "b"), "ngram-components")
    reps = joined.join(classes.withColumnRenamed("cls", "node"), "node")
    lowest = reps.groupBy("root").agg(F.min("rep").alias("component"))
    more = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = reps.join(lowest, "root").join(more, "node", "left").select(F.col("node").alias("cls"), "component", "links")
    own = classes.select("cls", "rep", "copies").join(found, "cls", "left")
    return (sized.join(own, "cls", "left")
            .select("doc_id", "n_shingles",
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component", "rep"))).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
                    .otherwise(F.lit(0)).cast("long").alias("n_links")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of ``ngram_components``: the one with the smallest doc_id.

    All columns stay. Rows that repeat a doc_id are one document; its first row in the order of all columns stays. Rows
    with a null doc_id stay. The ids to leave out, not the texts, are moved; they are broadcast while they are few.
    """
    found = written(ngram_components(docs, width, percent), "ngram-found")
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "ngram-gone")
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    again = written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "ngram-again")
    if again.isEmpty():
        return kept.select(docs.columns)
    hint = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    single = kept.join(hint, "doc_id", "left_anti").select(docs.columns)
    double = kept.join(hint, "doc_id", "left_semi")
    one = double.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(one.select(docs.columns))
