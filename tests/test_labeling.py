"""Segments, words and turns."""

import random

from pyspark.sql import functions as F

from talkweave.functions.text import trim_blank
from talkweave.operators import labeling as lb
from talkweave.operators.intervals import overlap_pairs

SEG = "meeting_id bigint, chunk_index int, source string, seg_ord int, start_s double, end_s double, text string, confidence double"
TURN = "meeting_id bigint, chunk_index int, source string, turn_ord int, t_start double, t_end double, speaker string, quality_score double"
WORD = "meeting_id bigint, chunk_index int, source string, seg_ord int, word_ord int, w_start double, w_end double, word string"
SPEECH = "meeting_id bigint, chunk_index int, source string, r_start double, r_end double, probability double"


def segs(spark, *rows):
    return spark.createDataFrame([(1, 0, "remote", i, float(a), float(b), t, 0.9) for i, (a, b, t) in enumerate(rows)], SEG)


def turns(spark, *rows):
    return spark.createDataFrame([(1, 0, "remote", i, float(a), float(b), s, q) for i, (a, b, s, q) in enumerate(rows)], TURN)


def words(spark, *rows):
    return spark.createDataFrame([(1, 0, "remote", s, i, float(a), float(b), w) for i, (s, a, b, w) in enumerate(rows)], WORD)


def word_winner(w0, w1, all_turns):
    best, top = None, 0.0
    for t0, t1, who in all_turns:
        o = max(0.0, min(w1, t1) - max(w0, t0))
        if o > top:
            best, top = who, o
        elif o > 0 and o == top and t0 <= (w0 + w1) / 2 <= t1:
            best = who
    if best is None and all_turns:
        gaps = [w0 - t1 if w0 > t1 else (t0 - w1 if t0 > w1 else 0.0) for t0, t1, _ in all_turns]
        best = all_turns[gaps.index(min(gaps))][2]
    return best


def segment_winner(s0, s1, all_turns):
    best, top = "Unknown", 0.0
    for t0, t1, who in all_turns:
        o = max(0.0, min(s1, t1) - max(s0, t0))
        if o > top:
            best, top = who, o
        if t0 <= (s0 + s1) / 2 <= t1 and o == top:
            best = who
    return best


def test_owners_match_a_direct_replay(spark):
    rng = random.Random(4)
    grid = lambda: rng.randrange(0, 400) / 4.0
    turn_rows, seg_rows, word_rows, want_word, want_seg = [], [], [], {}, {}
    for m in range(40):
        mine = []
        for o in range(rng.randrange(0, 7)):
            a = grid()
            b = a + rng.randrange(0, 60) / 4.0
            mine.append((a, b, f"S{rng.randrange(4)}"))
            turn_rows.append((m, 0, "remote", o, a, b, mine[-1][2], None))
        for o in range(12):
            a = grid()
            b = a + rng.randrange(1, 200) / 4.0
            seg_rows.append((m, 0, "remote", o, a, b, "x", 0.1))
            want_seg[m, o] = segment_winner(a, b, mine)
            b = a + rng.randrange(0, 4) / 4.0
            word_rows.append((m, 0, "remote", 0, o, a, b, " w"))
            want_word[m, o] = word_winner(a, b, mine)
    t = spark.createDataFrame(turn_rows, TURN)
    got = lb.word_owner(spark.createDataFrame(word_rows, WORD), t).collect()
    assert {(r.meeting_id, r.word_ord): r.owner for r in got} == want_word
    got = lb.label_by_overlap(spark.createDataFrame(seg_rows, SEG), t).collect()
    assert {(r.meeting_id, r.seg_ord): r.owner for r in got} == want_seg


def test_overlap_pairs_find_each_pair_once(spark):
    rng = random.Random(9)
    left = [(rng.randrange(3), i, a, a + rng.randrange(0, 90)) for i in range(80) for a in [float(rng.randrange(-50, 300))]]
    right = [(rng.randrange(3), i, a, a + rng.randrange(0, 400)) for i in range(80) for a in [float(rng.randrange(-50, 300))]]
    l = spark.createDataFrame(left, "k int, i int, a double, b double")
    r = spark.createDataFrame(right, "k int, j int, c double, d double")
    for touching in (False, True):
        got = sorted((x.i, x.j) for x in overlap_pairs(l, r, ["k"], "a", "b", "c", "d", touching).collect())
        ok = (lambda a, b, c, d: a <= d and c <= b) if touching else (lambda a, b, c, d: a < d and c < b)
        assert got == sorted((i, j) for k, i, a, b in left for q, j, c, d in right if k == q and ok(a, b, c, d))


def split(spark, s, w, t):
    out = lb.split_at_speaker_changes(s, lb.word_owner(w, t))
    return [(r.start_s, r.end_s, r.text, r.dominant) for r in out.orderBy("seg_ord", "piece").collect()]


def test_segment_is_cut_where_the_speaker_changes(spark):
    s = segs(spark, (0, 4, "one two, three four"))
    t = turns(spark, (0, 2, "A", 0.9), (2, 4, "B", 0.9))
    w = words(spark, (0, 0.2, 0.8, "one"), (0, 1.0, 1.6, " two"), (0, 2.1, 2.2, ","), (0, 2.3, 2.8, " three"), (0, 3.0, 3.7, " four"))
    # The comma stays with the words before it although it lies in B's turn; outer pieces keep the segment's bounds.
    assert split(spark, s, w, t) == [(0.0, 2.2, "one two,", "A"), (2.3, 4.0, "three four", "B")]


def test_single_owner_keeps_the_text_and_few_words_pass(spark):
    s = segs(spark, (0, 2, "It's 5."), (2, 4, "ok"))
    t = turns(spark, (0, 4, "A", 0.9))
    w = words(spark, (0, 0.1, 0.5, "It is"), (0, 0.6, 1.0, " five."), (1, 2.5, 3.0, "ok"))
    assert split(spark, s, w, t) == [(0.0, 2.0, "It's 5.", "A"), (2.0, 4.0, "ok", None)]


def test_symbols_open_pieces_and_blank_words_do_not(spark):
    s = segs(spark, (0, 4, "hi 👍 there"))
    t = turns(spark, (0, 1, "A", 0.9), (1, 2, "B", 0.9), (2, 4, "A", 0.9))
    w = words(spark, (0, 0.2, 0.8, "hi"), (0, 1.2, 1.8, " 👍"), (0, 2.2, 2.3, "  "), (0, 2.5, 3.0, " there"))
    assert [x[2:] for x in split(spark, s, w, t)] == [("hi", "A"), ("👍", "B"), ("there", "A")]


def test_without_turns_nothing_is_cut(spark):
    s = segs(spark, (0, 2, "a b"))
    w = words(spark, (0, 0.1, 0.5, "a"), (0, 0.6, 1.0, " b"))
    assert split(spark, s, w, turns(spark, (0, 1, "X", None)).where("false")) == [(0.0, 2.0, "a b", None)]


def test_gate_matrix(spark):
    cases = spark.createDataFrame([
        ("loud good", 0.9, 0.8, True), ("loud bad", 0.9, 0.1, True), ("quiet good", 0.1, 0.8, True), ("quiet bad", 0.1, 0.1, True),
        ("no quality", 0.1, None, True), ("no map", 0.0, 0.1, False), ("edges", 0.5, 0.3, True)], "n string, f double, q double, m boolean")
    got = cases.select("n", lb.decide(F.lit("A"), F.col("f"), F.col("q"), F.col("m")).alias("v")).collect()
    assert {r.n: (r.v.speaker, r.v.include) for r in got} == {
        "loud good": ("A", True), "loud bad": ("Unknown", True), "quiet good": ("A", True), "quiet bad": ("A", False),
        "no quality": ("A", True), "no map": ("A", True), "edges": ("A", True)}
    off = cases.select("n", lb.decide(F.lit("A"), F.col("f"), F.col("q"), F.col("m"), 0.0).alias("v")).collect()
    assert {r.n: r.v.speaker for r in off}["quiet bad"] == "Unknown"


def test_repeats_and_empty_segments(spark):
    s = segs(spark, (0, 1, "yes"), (1, 1, "never"), (1, 2, " yes\t"), (2, 3, "no"), (3, 4, "yes"))
    got = lb.drop_empty_and_repeats(s).orderBy("seg_ord").collect()
    assert [r.seg_ord for r in got] == [0, 3, 4]


def test_trim_leaves_line_breaks(spark):
    got = spark.createDataFrame([("\t a\n ",)], "x string").select(trim_blank(F.col("x"))).first()[0]
    assert got == "a\n"


def label(spark, s, w, t, sp):
    out = lb.label_streams(s, w, t, sp)
    return sorted((r.meeting_id, r.seg_ord, r.piece, round(r.start_s, 6), round(r.end_s, 6), r.speaker, r.text) for r in out.collect())


def corpus(spark, shift=0.0, meetings=(1,)):
    rng = random.Random(5)
    s, w, t, sp = [], [], [], []
    for i in range(15):
        a = i * 8 + rng.random()
        b = a + 3 + rng.random() * 5
        s.append((i, a, b, " ".join(f"w{i}_{k}" for k in range(6))))
        w += [(i, k, a + k * 0.5, a + k * 0.5 + 0.3, ("" if k == 0 else " ") + f"w{i}_{k}") for k in range(6)]
        t += [(2 * i, a - 1, a + 1.4, f"S{rng.randrange(3)}", rng.random()), (2 * i + 1, a + 1.4, b, f"S{rng.randrange(3)}", rng.random())]
        sp.append((a, a + rng.random() * 6, rng.random()))
    x = shift
    return (spark.createDataFrame([(m, 0, "remote", i, a + x, b + x, c, 0.5) for m in meetings for i, a, b, c in s], SEG),
            spark.createDataFrame([(m, 0, "remote", i, k, a + x, b + x, c) for m in meetings for i, k, a, b, c in w], WORD),
            spark.createDataFrame([(m, 0, "remote", o, a + x, b + x, c, q) for m in meetings for o, a, b, c, q in t], TURN),
            spark.createDataFrame([(m, 0, "remote", a + x, b + x, p) for m in meetings for a, b, p in sp], SPEECH))


def test_metamorphic_shift_shuffle_and_copies(spark):
    base = label(spark, *corpus(spark))
    assert len(base) > 15
    moved = label(spark, *corpus(spark, shift=64.0))
    assert [(r[1], r[2], r[5], r[6]) for r in moved] == [(r[1], r[2], r[5], r[6]) for r in base]
    assert all(abs(m[3] - b[3] - 64) < 1e-5 for m, b in zip(moved, base))
    shuffled = label(spark, *[d.orderBy(F.rand(3)) for d in corpus(spark)])
    assert shuffled == base
    twice = label(spark, *corpus(spark, meetings=(1, 2)))
    assert [r[1:] for r in twice if r[0] == 2] == [r[1:] for r in base]


def test_sentences_respect_decimals(spark):
    rows = [(1, 0, "remote", i, i * 1.0, i + 0.5, tok) for i, tok in enumerate([" Costs", " 1.", "5 million.", "  ", " Ok?", " tail"])]
    df = spark.createDataFrame(rows, "meeting_id bigint, chunk_index int, source string, token_ord int, w_start double, w_end double, token string")
    got = lb.sentences(df, lb.STREAM, "token_ord").orderBy("start_s").collect()
    assert [(r.text, r.start_s, r.end_s) for r in got] == [("Costs 1.5 million.", 0.0, 2.5), ("Ok?", 3.0, 4.5), ("tail", 5.0, 5.5)]


def test_words_are_sorted_once_for_their_pieces(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = spark.createDataFrame([], "meeting_id bigint, chunk_index int, source string, seg_ord int, word_ord int, w_start double, w_end double, word string")
        turns = spark.createDataFrame([], "meeting_id bigint, chunk_index int, source string, turn_ord int, t_start double, t_end double, speaker string, quality_score double")
        plan = lb.word_pieces(lb.word_owner(words.repartition(2), turns.repartition(2))).select("meeting_id", "word_ord", "piece")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
