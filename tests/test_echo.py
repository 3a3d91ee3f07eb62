from pyspark.sql import functions as F

from talkweave.functions import text as tx, timing as tm, vectors as vc
from talkweave.operators import echo

ROW = "meeting_id bigint, chunk_index int, seg_ord int, source string, speaker string, start_s double, end_s double, text string"
VOICE = "meeting_id bigint, chunk_index int, source string, speaker string, embedding array<float>"
KEYS, IDENT = ["meeting_id", "chunk_index"], ["seg_ord"]
SAME = [(1, 0, "local", "Speaker 1", [1.0, 0.0]), (1, 0, "remote", "Speaker 1", [1.0, 0.05]), (1, 0, "remote", "Speaker 2", [0.0, 1.0])]


def kept(spark, segs, voices=SAME, **kw):
    rows = [(1, 0, i, src, who, float(a), float(b), text) for i, (src, who, a, b, text) in enumerate(segs)]
    out = echo.remove_echo(spark.createDataFrame(rows, ROW), spark.createDataFrame(voices, VOICE), KEYS, IDENT, **kw)
    return sorted(r.seg_ord for r in out.collect())


REMOTE = ("remote", "Remote Speaker 1", 0, 10, "we ship the release on friday morning")


def test_all_gates_are_needed(spark):
    assert kept(spark, [REMOTE, ("local", "Local Speaker 1", 1, 9, "We ship the release on Friday morning!")]) == [0]
    assert kept(spark, [REMOTE, ("local", "Local Speaker 1", 8, 30, "we ship the release on friday morning")]) == [0, 1]
    assert kept(spark, [REMOTE, ("local", "Local Speaker 1", 1, 9, "something else entirely was said")]) == [0, 1]
    assert kept(spark, [REMOTE, ("local", "Local Speaker 7", 1, 9, "we ship the release on friday morning")]) == [0, 1]
    other = [("remote", "Remote Speaker 2", 0, 10, REMOTE[4]), ("local", "Local Speaker 1", 1, 9, REMOTE[4])]
    assert kept(spark, other) == [0, 1]


def test_containment_and_window(spark):
    assert kept(spark, [REMOTE, ("local", "Local Speaker 1", 2, 4, "the release on friday")]) == [0]
    halves = [("remote", "Remote Speaker 1", 0, 4, "alpha beta gamma delta"), ("remote", "Remote Speaker 1", 5, 9, "epsilon zeta eta theta"),
              ("local", "Local Speaker 1", 0, 9, "alpha beta gamma delta epsilon zeta eta theta")]
    assert kept(spark, halves) == [0, 1]
    assert kept(spark, halves[1:]) == [0, 1]


def test_no_remote_rows_and_threshold_is_strict(spark):
    assert kept(spark, [("local", "Local Speaker 1", 0, 5, "a b c")]) == [0]
    half = [("remote", "Remote Speaker 1", 0, 10, REMOTE[4]), ("local", "Local Speaker 1", 5, 15, REMOTE[4])]
    assert kept(spark, half) == [0, 1]


def test_stacked_voices_are_pooled(spark):
    voices = [(1, 0, "local", "Speaker 1", [1.0, 0.0, 0.0, 1.0]), (1, 0, "remote", "Speaker 1", [0.5, 0.5])]
    segs = [REMOTE, ("local", "Local Speaker 1", 1, 9, REMOTE[4])]
    assert kept(spark, segs, voices) == [0]
    both = [(1, 0, "local", "Speaker 1", [1.0, 0.0, 0.0, 1.0]), (1, 0, "remote", "Speaker 1", [0.5, 0.5, 0.5, 0.5])]
    assert kept(spark, segs, both) == [0, 1]
    assert kept(spark, segs, both, dim=2) == [0]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    w = lambda s: tx.word_set(F.lit(s))
    assert one(tx.jaccard(w("Hello, world"), w("hello WORLD"))) == 1.0
    assert one(tx.jaccard(w(""), w("!!"))) == 0.0
    assert one(tx.containment(w("a b"), w("a b c d"))) == 1.0 and one(tx.containment(w(""), w("a"))) == 0.0
    assert abs(one(vc.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)))) - 1) < 1e-12
    for a, b in (([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])):
        arr = lambda x: F.array(*map(F.lit, x)).cast("array<float>")
        assert one(vc.cosine(arr(a), arr(b))) == 0.0
    r = lambda *v: one(tm.overlap_ratio(*[F.lit(float(x)) for x in v]))
    assert (r(0, 10, 0, 10), r(0, 10, 5, 15), r(0, 5, 6, 9), r(0, 10, 2, 4), r(3, 3, 0, 9)) == (1.0, 0.5, 0.0, 1.0, 0.0)
    assert one(vc.common_divisor(F.array(F.lit(8), F.lit(12)))) == 4


def test_centroids_over_all_chunks(spark):
    """Three and more chunks a voice, a voice that appears late, and one whose length does not divide."""
    from talkweave.functions import vectors as vc
    rows = [(1, "a", c, [float(c + k) for k in range(4)]) for c in range(5)] + [(1, "late", 4, [1.0, 2.0, 3.0, 4.0]), (1, "twice", 2, [float(k) for k in range(8)]), (1, "odd", 0, [1.0, 2.0]), (1, "odd", 3, [3.0, 4.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "m int, speaker string, chunk_index int, embedding array<float>")
    dims = spark.createDataFrame([(1, 4)], "m int, dim int")
    got = {r.speaker: r.embedding for r in echo.centroids(df, ["m", "speaker"], "chunk_index", dims, ["m"]).collect()}
    want = {r.speaker: r.embedding for r in echo.stacked(df, ["m", "speaker"], "chunk_index").withColumn("embedding", vc.centroid(F.col("embedding"), F.lit(4))).collect()}
    assert got == want and got["a"] == [2.0, 3.0, 4.0, 5.0] and got["late"] == [1.0, 2.0, 3.0, 4.0] and len(got["odd"]) == 6
