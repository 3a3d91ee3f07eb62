"""Calendar lookups against a direct search over all events."""

import random
from datetime import datetime, timedelta

from talkweave.operators import directory as dr

DAY = datetime(2024, 5, 1)


def test_calendar_pick_equals_a_search_and_pairs_nothing(spark):
    rng = random.Random(5)
    at = lambda m: DAY + timedelta(minutes=m)
    events = [(k, k % 2, s := rng.randrange(600), None if k % 19 == 0 else s + rng.choice([-5, 0, 5, 30, 300]), k % 11 == 0, k % 7 == 0) for k in range(80)]
    meetings = [(k, k % 3, rng.randrange(700)) for k in range(300)]
    cal = spark.createDataFrame([(k, o, at(s), None if e is None else at(e), a, d) for k, o, s, e, a, d in events],
                                "cal_id bigint, owner int, starts_at timestamp, ends_at timestamp, all_day boolean, declined boolean")
    asked = spark.createDataFrame([(k, o, at(m)) for k, o, m in meetings], "meeting bigint, owner int, now timestamp")
    out = dr.calendar_pick(asked, cal, ["owner"], ["meeting"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, o, m in meetings:
        mine = [(c, s, e) for c, w, s, e, a, d in events if w == o and not a and not d]
        running = [(-s, c) for c, s, e in mine if e is not None and s <= m < e]
        soon = [(s, c) for c, s, e in mine if m < s <= m + 10]
        if running or soon:
            want[k] = (min(running or soon)[1], bool(running))
    assert len({r for _, r in want.values()}) == 2 and {r.meeting: (r.cal_id, r.running) for r in out.collect()} == want
