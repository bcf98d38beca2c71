"""Sliding windows of an account's replies against plain Python."""

import random

from murmuration.operators import behaviour

DAY = 10


def plain(rows):
    best = {}
    for account in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == account and r[3] and r[4] is not None]
        for anchor in own:
            inside = [r for r in own if anchor[2] <= r[2] <= anchor[2] + DAY]
            found = (len({r[4] for r in inside}), len(inside), anchor[2] - max(r[2] for r in inside))
            best[account] = max(best.get(account, found), found)
    return {(a, t, n, -s) for a, (t, n, s) in best.items()}


def test_sliding_targets_equal_all_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randrange(60), rng.random() < 0.8, rng.choice(["t1", "t2", "t3", "t4", None])) for i in range(240)]
    rows += [(1000 + i, "same", 5, True, f"t{i % 3}") for i in range(9)] + [(2000, "one", 7, True, "t"), (2001, "none", 7, False, "t"), (2002, "edge", 0, True, "x"), (2003, "edge", DAY, True, "y"), (2004, "edge", DAY + 1, True, "z")]
    df = spark.createDataFrame(rows, "id long, account_id string, at_us long, is_reply boolean, in_reply_to string")
    assert {tuple(r) for r in behaviour.sliding_targets(df, DAY).collect()} == plain(rows)
    plan = behaviour.sliding_targets(df, DAY)._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "Cartesian" not in plan
