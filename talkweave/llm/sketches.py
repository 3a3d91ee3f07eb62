"""Near-copy detection with bottom-k sketches from one hash function.

* Sketch. A set keeps its ``K`` smallest shingle hashes; a set of no more is its own sketch.
* Inverted lists. Sets at the threshold share many retained values. A first inversion of all retained values counts, for
  each set, those it has in common with any other: with too few, it links with nothing. Of the others, in one global order
  (rarest first, ``rarity``), two that link share a value among the first few of each. Only those are posted then, and sets
  under one value are chained into families. A passage that many documents share is common, comes last in the order,
  and chains only documents that consist of little else. Families that come out large are chained anew by exact counts (``families``).
* Overlaps. A family is compared in chunks: inverted lists of all retained values give every two sketches' overlap; the
  sketch of the union of the two (its ``K`` smallest values) estimates the similarity; estimates within ``SIGMAS`` standard
  deviations of the threshold or above are verified on the full sets. Pairs already joined are not looked at again. Where a large
  family is left in parts, its sets are laid out in blocks that travel as one row each, and the blocks are compared.

Equal sets are one class from the start. No pair is emitted: what leaves a chunk is a spanning forest of verified links.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .components import components
from .families import _led, _meet, refined
from .ngram_join import _groups, _overlaps, shelved, unshelved
from .ragged import U, Words, mix, shingle_sets, sum_by, text_slices
from .rarity import cell_counts, rarest
from .retained import K, POSTINGS, SIGMAS, _bucket, _spread, _unrolled, buckets_of, hashed_sets, hopeful, least_shared, retained, sketched

CHUNK = 512                # sets compared in one task at once
LEADERS = 8                # sets of a large family that every chunk of it meets
MANY = 4                   # pairs to verify for each set from which the overlaps of all full sets are counted at once
BROADCAST_ROWS = 500_000   # rows (48 bytes each) up to which they are broadcast
SALTS = 8                  # parts into which the copies of one text are cut where results are joined back


def _postings(doc: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, value) of the retained values by which sets find each other."""
    doc, value = retained(doc, value, len(size))
    some = rarest(doc, value, counts, np.minimum(size, K) - least_shared(size, percent) + 1)
    return doc[some], value[some]


def _owned(batches, percent):
    """The retained values as (owner, key, last, table) of ``families.exact_edges``."""
    for doc, value, size, cls in _unrolled(batches):
        doc, value = retained(doc, value, len(size))
        yield doc, value, np.zeros(len(doc), bool), np.column_stack([cls, np.minimum(size, K) - least_shared(size, percent) + 1])


def _values(batches):
    for _, value, _, _ in _unrolled(batches):
        yield value


def _posted(batches, percent, buckets, counts):
    """Rows (bucket, keys, owner, classes, edges): each posted value once per flush, with one class; the others are edges to it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        values, cls, pairs = _led(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        bucket = _bucket(values, buckets)
        order = np.argsort(bucket, kind="stable")
        values, cls, cut = values[order], cls[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        share = np.array_split(pairs, buckets)
        out = []
        for b in range(buckets):
            used, local = np.unique(cls[cut[b]:cut[b + 1]], return_inverse=True)
            if len(used) or len(share[b]):
                out.append((b, values[cut[b]:cut[b + 1]].tobytes(), local.astype(np.uint32).tobytes(), used.tobytes(), share[b].tobytes()))
        return pa.record_batch([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in range(1, 5))],
                               names=["bucket", "keys", "owner", "classes", "edges"])

    n = 0
    for doc, value, size, cls in _unrolled(batches):
        d, v = _postings(doc, value, size, percent, counts)
        held.append((v, cls[d]))
        n += len(v)
        if n >= POSTINGS:
            yield flush()
            n = 0
    if n:
        yield flush()


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(shared, size) of the sketch of the union of two sketched sets: the ``K`` smallest values of both."""
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    union = np.append(both[:-1][~same], both[-1:])
    if len(union) <= K:
        return int(same.sum()), len(union)
    return int(np.searchsorted(both[:-1][same], union[K - 1], "right")), K


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The estimate on the sketches first, then the exact similarity of the full sets (ascending)."""
    shared, size = estimate(a[:K], b[:K])
    most = (len(a) + len(b)) * 100 / (100 + percent)
    if shared < percent / 100 * size - SIGMAS * float(_spread(np.array(most), percent)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], label: np.ndarray, active: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j), one for each two parts of the sets that they join; sets with equal labels are joined already. Only
    pairs with at least one ``active`` set are looked at, and with ``side`` only those of two sides."""
    size = np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(len(sets)), np.minimum(size, K))
    shared = _overlaps(member, np.concatenate([s[:K] for s in sets]), len(sets))
    need = least_shared(size, percent)
    may = (shared >= np.maximum(need[:, None], need[None, :])) & (100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :]))
    may &= active[:, None] | active[None, :]
    if side is not None:
        may &= side[:, None] != side[None, :]
    sure = np.count_nonzero(may & (label[:, None] != label[None, :])) > 2 * MANY * len(sets)
    if sure:
        both = _overlaps(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
        may &= 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label, out = label.copy(), []
    for i in range(1, len(sets)):
        rest = np.flatnonzero(may[i, :i] & (label[:i] != label[i]))
        rest = rest[np.argsort(-shared[i, rest], kind="stable")]
        while len(rest):
            j, rest = rest[0], rest[1:]
            if sure or linked(sets[i], sets[j], percent):
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
                rest = rest[label[rest] != label[i]]
    return out


def _members(held, width) -> list[tuple[int, np.ndarray, tuple]]:
    """(class, set, rest) once for each class, of rows (class, text, rest...) whose text is of that class."""
    once: dict[int, tuple] = {}
    for row, data, bounds in text_slices(pa.array([r[1] for r in held], pa.large_string())):
        words = Words(data, bounds)
        doc, value = shingle_sets(words, width)
        size = np.bincount(doc, minlength=words.docs)
        cls = mix(sum_by(doc, mix(value), words.docs) + size.astype(U)).view(np.int64)
        at = np.searchsorted(doc, np.arange(words.docs + 1))
        for k in range(words.docs):
            if held[row + k][0] == cls[k]:
                mine = once.get(int(cls[k]))
                # of a set that is there as a leader and as a member, the member
                if mine is None or held[row + k][2:] > mine[1]:
                    once[int(cls[k])] = value[at[k]:at[k + 1]], held[row + k][2:]
    return [(c, *once[c]) for c in sorted(once)]


def _joined(batches, width, percent):
    """Verified links of each (family, chunk), as a forest over classes; rows (family, chunk, cls, text, label, active)."""
    rows = []
    for _, held in _groups(batches, 2):
        found = _members(held, width)
        if len(found) < 2:
            continue
        label = np.unique(np.array([f[2][0] for f in found], np.int64), return_inverse=True)[1]
        links = forest([f[1] for f in found], label, np.array([f[2][1] for f in found], bool), percent)
        rows += [(found[i][0], found[j][0]) for i, j in links]
        if len(rows) >= 4096:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])


def _compared(docs: DataFrame, chosen: DataFrame, width: int, percent: int, purpose: str) -> DataFrame:
    """Links inside the groups (family, chunk) of ``chosen`` (rep, cls, family, chunk, label, active). Texts move once per group."""
    hint = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    texts = docs.join(hint, docs.doc_id == hint.rep).select("family", "chunk", "cls", "text", "label", "active")
    return written(texts.repartition("family", "chunk").sortWithinPartitions("family", "chunk").mapInArrow(partial(_joined, width=width, percent=percent), "a long, b long"), purpose)


def _own_sets(batches, width):
    """The sets of rows (cls, text, family, block, part, rest) whose text is of that class, with the other columns."""
    for batch in batches:
        at = 0
        for _, doc, value, size, cls in hashed_sets([batch], width):
            own = batch.slice(at, len(size))
            at += len(size)
            cut = np.searchsorted(doc, np.arange(len(size) + 1))
            rows = pa.array([value[cut[k]:cut[k + 1]].tobytes() for k in range(len(size))], pa.binary())
            found = pa.record_batch([*(own.column(x) for x in ("family", "block", "cls", "part", "rest")), rows], names=["family", "block", "cls", "part", "rest", "values"])
            yield found.filter(pa.array(cls == np.asarray(own.column("cls"))))


def _shelves(batches):
    """A row per (family, block): its members (class, part, rest, size), and their sets."""
    for (family, block), held in _groups(batches, 2):
        held = list({r[0]: r for r in held}.values())
        who = np.array([(cls, part, rest, len(value) // 8) for cls, part, rest, value in held], np.int64)
        yield pa.record_batch([pa.array([family], pa.int64()), pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in (who.tobytes(), *shelved([np.frombuffer(r[3], U) for r in held])))],
                              names=["family", "block", "members", "values", "places"])


def _far_joined(batches, percent):
    """Verified links between the members of two blocks, or within one, as a forest over classes."""
    for _, held in _groups(batches, 3):
        each = [np.frombuffer(r[1], np.int64).reshape(-1, 4) for r in held]
        who = np.concatenate(each)
        sets = [x for r, w in zip(held, each, strict=True) for x in np.split(unshelved(r[2], r[3], w[:, 3]), w[:, 3].cumsum()[:-1])]
        label = np.unique(who[:, 1], return_inverse=True)[1]
        side = np.repeat(np.arange(len(each)), [len(w) for w in each]) if len(each) > 1 else None
        links = forest(sets, label, who[:, 2] == 1, percent, side)
        if links:
            yield pa.record_batch([pa.array([int(who[x[c], 0]) for x in links], pa.int64()) for c in range(2)], names=["a", "b"])


def _far(docs: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of the ``rest`` of families with each other and with their core; ``large``: rep, cls, family, band, part, rest."""
    spare = F.floor((F.count(F.lit(1)) - 1) / F.lit(CHUNK // 2)).cast("int") + 1
    along = Window.partitionBy("family").orderBy(F.col("rest").desc(), "band")
    shelf = large.groupBy("family", "rest", "band").agg(spare.alias("n")).withColumn("first", (F.sum("n").over(along) - F.col("n")).cast("int"))
    own = written(large.join(shelf, ["family", "rest", "band"])
                  .select("rep", "cls", "family", "part", F.col("rest").cast("int").alias("rest"), (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("n"))).cast("int").alias("block")), "sketch-blocks")
    # Each block of the rest meets, of what has a size in reach, the core and the blocks of the rest from itself on.
    left = shelf.filter("rest").select("family", F.col("band").alias("near"), F.explode(F.expr("sequence(first, first + n - 1)")).alias("i"))
    right = shelf.select("family", "band", F.explode(F.expr("sequence(first, first + n - 1)")).alias("j"))
    pairs = (left.join(right, "family").filter("abs(near - band) <= 1 and i <= j")
             .select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    hint = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    sets = docs.join(hint, docs.doc_id == hint.rep).select("cls", "text", "family", "block", "part", "rest")
    shelves = (sets.mapInArrow(partial(_own_sets, width=width), "family long, block int, cls long, part long, rest int, values binary")
               .repartition("family", "block").sortWithinPartitions("family", "block", "cls")
               .mapInArrow(_shelves, "family long, block int, members binary, values binary, places binary"))
    met = shelves.join(pairs, ["family", "block"]).select("family", "i", "j", "block", "members", "values", "places")
    return written(met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "block")
                   .mapInArrow(partial(_far_joined, percent=percent), "a long, b long"), "sketch-far")


def _links(docs: DataFrame, classes: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that join all classes of a family that any links join."""
    many = families.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    member = written(families.join(many, "root").join(classes.withColumnRenamed("cls", "node"), "node")
                     .select("rep", F.col("node").alias("cls"), "n_shingles", F.col("root").alias("family"), "members"), "sketch-members")
    chunks = F.floor((F.col("members") - 1) / F.lit(CHUNK)).cast("int") + 1
    first = member.select("rep", "cls", "family", F.pmod(F.xxhash64("cls"), chunks).cast("int").alias("chunk"), F.col("cls").alias("label"), F.lit(1).alias("active"))
    large = member.filter(F.col("members") > CHUNK)
    if large.isEmpty():
        return _compared(docs, first, width, percent, "sketch-links")
    # A large family: every chunk also meets the family's leaders, which joins most of it.
    leaders = (large.groupBy("family", "members").agg(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("cls", F.lit(3)), F.floor(F.col("members") / LEADERS)) == 0, F.col("cls")))).alias("lead"))
               .select("family", F.explode(F.slice("lead", 1, 4 * LEADERS)).alias("cls")))
    lead = (large.join(leaders, ["family", "cls"]).select("rep", "cls", "family", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("cls").alias("label"), F.lit(0).alias("active")))
    near = _compared(docs, first.unionByName(lead), width, percent, "sketch-links")
    # What it did not join is compared with all of the family that has a size in reach, except with its own part.
    part = components(near, "sketch-parts").withColumnRenamed("node", "cls")
    large = large.join(part, "cls", "left").withColumn("part", F.coalesce("root", "cls")).drop("root")
    sizes = large.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    core = sizes.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("core"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    large = written(large.join(core, "family").withColumn("band", band).withColumn("rest", F.col("part") != F.col("core")), "sketch-rest")
    if large.isEmpty():
        return near
    far = _far(docs, large.select("rep", "cls", "family", "band", "part", "rest"), width, percent)
    return near.unionByName(far)


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents linked when 100 * |A & B| >= percent * |A | B| over their distinct ``width``-word shingles, links verified on
    the full sets.

    Returns a row for each row of ``docs`` (doc_id, text; other columns are not looked at): doc_id, n_shingles (size of the
    set), component_id (smallest doc_id reachable by links, itself included), kept (doc_id is component_id). Fewer words than
    ``width`` are one shingle; null, empty and wordless texts have no set and link with nothing. Texts are taken whole,
    whatever their length. Rows with a null doc_id link with nothing, have a null component_id and are kept. Repeated rows are
    copies of each other. No ties arise: ids are compared. An empty table gives an empty result. ``percent`` is 1 to 100.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sized = sketched(docs, width, "sketch-sized")
    known = sized.filter("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("cls", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    buckets = buckets_of(sized)
    hopes = hopeful(sized, classes, percent, "sketch-hopeful")
    some = F.broadcast(hopes) if hopes.count() <= BROADCAST_ROWS else hopes
    chosen = known.alias("s").join(some.alias("h"), F.expr("s.doc_id = h.rep and s.cls = h.cls")).select("s.cls", "s.n_shingles", "s.sketch")
    shared = spark.sparkContext.broadcast(cell_counts(chosen, _values))

    def posted(batches):
        return _posted(batches, percent, buckets, shared.value)

    edges = chosen.mapInArrow(posted, "bucket int, keys binary, owner binary, classes binary, edges binary").groupBy("bucket").applyInArrow(_meet, "a long, b long")
    families = refined(components(edges, "sketch-families"), chosen, partial(_owned, percent=percent), K, "sketch-refined")
    joined = components(_links(docs, classes, families, width, percent), "sketch-components")
    lowest = joined.join(classes.withColumnRenamed("cls", "node"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    found = joined.join(lowest, "root").select(F.col("node").alias("cls"), "component")
    # Only classes with copies or links have something to tell; the rows of one class are met in SALTS parts.
    told = (classes.join(found, "cls", "left").filter("copies > 1 or component is not null").select("cls", F.coalesce("component", "rep").alias("component"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = sized.drop("sketch").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.least("doc_id", "component")).otherwise(F.col("doc_id"))
    return (salted.join(told, ["cls", "salt"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
