"""The life cycle, policies replayed, review plans and the attention list against plain Python."""

import hashlib
import math
import random

import pytest

from murmuration.operators import findings, planning
from murmuration.operators.findings import Rule

H = 3_600_000


def plain_lifecycle(series, rule):
    """(status, exceeds, normals, resolved_at) after each of (at, missing, exceeded), by a table of situations."""
    status, exceeds, normals, resolved, out = "none", 0, 0, None, []
    for at, missing, exceeded in series:
        if not missing:
            idle = status in ("none", "resolved")
            match idle, exceeded:
                case True, False:
                    exceeds = 0
                case True, True:
                    exceeds, normals = exceeds + 1, 0
                    age = None if resolved is None else at - resolved
                    cooling = age is not None and rule.cooldown_ms is not None and age < rule.cooldown_ms
                    if exceeds >= (1 if rule.critical_immediate else rule.activation) and not cooling:
                        recent = age is not None and rule.recurrence_ms is not None and age <= rule.recurrence_ms
                        status, resolved = "active" if status == "none" else "recurring" if recent else "new_episode", None
                case False, True:
                    normals = 0
                case False, False:
                    normals += 1
                    if normals >= rule.resolution:
                        status, exceeds, resolved = "resolved", 0, at
        out.append((status, exceeds, normals, resolved))
    return out


RULES = (Rule("x", "low", 0, 0), Rule("x", "low", 0, 0, 1, 1, 5 * H, None), Rule("x", "low", 0, 0, 3, 2, None, 4 * H), Rule("x", "low", 0, 0, 3, 1, 40 * H, 3 * H, True))


@pytest.mark.parametrize("rule", RULES)
def test_lifecycle_equals_a_plain_fold(spark, rule):
    rng = random.Random(6)
    series = {k: [(i * H, rng.random() < 0.15, rng.random() < p) for i in range(60)] for k, p in (("a", 0.5), ("b", 0.8), ("c", 0.2), ("d", 0.0))}
    rows = [(k, *o) for k, own in series.items() for o in own]
    random.Random(1).shuffle(rows)
    got = findings.lifecycle(spark.createDataFrame(rows, "label_key string, at long, missing boolean, exceeded boolean"), rule).orderBy("label_key", "at").collect()
    want = [s for k in sorted(series) for s in plain_lifecycle(series[k], rule)]
    assert [(r["status"], r["exceeds"], r["normals"], r["resolved_at"]) for r in got] == want
    assert {s for s, *_ in want} >= {"none", "active", "resolved"}
    opened = [r["at"] for r in got if r["label_key"] == "a" and r["opened"]]
    assert opened and all(plain_lifecycle(series["a"], rule)[at // H][0] in findings.OPEN for at in opened)


def test_durations():
    assert [findings.duration_ms(d) for d in ("P30D", "PT1H", "P1DT2H3M", "P", "PT")] == [30 * 24 * H, H, 26 * H + 180_000, 0, 0]
    for bad, strict in (("P1W", False), ("1H", False), ("P", True), ("PT", True)):
        with pytest.raises(ValueError):
            findings.duration_ms(bad, strict)


def world(seed=4):
    rng = random.Random(seed)
    seen, reasons = [], []
    for label in ("x", "y"):
        for i in range(14):
            evaluated = rng.randrange(0, 30)
            own = {r: rng.randrange(0, 8) for r in "pqr" if rng.random() < 0.8}
            seen.append((f"{label}{i}", label, i * 24 * H, evaluated, min(evaluated, sum(own.values()))))
            reasons += [(f"{label}{i}", r, n) for r, n in own.items() if n]
    return seen, reasons


def flags(policy, now, before, reasons):
    out = {}
    for rule in policy:
        if not rule.enabled:
            continue
        if rule.type == "label_count_drop":
            missing = min(now[3], before[3]) < rule.minimum_sample
            drop = 0 if before[4] == 0 else (before[4] - now[4]) / before[4]
            out[f"label_count_drop+label:{now[1]}"] = not missing and drop >= rule.relative_threshold
        else:
            a, b = ({r: n for i, r, n in reasons if i == s[0]} for s in (now, before))
            for r in a.keys() | b.keys():
                if b.get(r, 0) >= rule.minimum_sample:
                    out[f"reason_distribution_shift+label:{now[1]}+reason:{r}"] = (0 if b.get(r, 0) == 0 else (b[r] - a.get(r, 0)) / b[r]) >= rule.relative_threshold
    return out


NEW = (Rule("label_count_drop", "high", 0.2, 5), Rule("reason_distribution_shift", "medium", 0.5, 2))
OLD = (Rule("label_count_drop", "critical", 0.5, 10), Rule("reason_distribution_shift", "low", 0.2, 4))
OFF = (Rule("label_count_drop", "critical", 0.5, 10), Rule("reason_distribution_shift", "low", 0.2, 4, enabled=False))


@pytest.mark.parametrize("old", [OLD, OFF])
def test_backtest_finds_where_policies_differ(spark, old):
    seen, reasons = world()
    begin, end = 2 * 24 * H, 12 * 24 * H
    want = set()
    for label in "xy":
        own = [s for s in seen if s[1] == label and begin <= s[2] <= end]
        for before, now in zip(own, own[1:]):
            a, b = (flags(p, now, before, reasons) for p in (NEW, old))
            severity = {"label_count_drop": ("high", "critical"), "reason_distribution_shift": ("medium", "low")}
            want |= {(now[0], f, severity[f.split("+")[0]][0], "new_in_candidate") for f, x in a.items() if x and not b.get(f)}
            want |= {(now[0], f, severity[f.split("+")[0]][1], "missing_in_candidate") for f, x in b.items() if x and not a.get(f)}
    frames = spark.createDataFrame(seen, "id string, label_key string, at long, evaluated long, true_count long"), spark.createDataFrame(reasons, "id string, reason string, n long")
    got = findings.backtest(*frames, NEW, old, begin, end).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and (old is OFF or len({k for *_, k in want}) == 2)


def test_shadow_compares_first_snapshots_with_nothing(spark):
    seen, reasons = world()
    frames = spark.createDataFrame(seen, "id string, label_key string, at long, evaluated long, true_count long"), spark.createDataFrame(reasons, "id string, reason string, n long")
    got = {(r["snapshot_id"], r["fingerprint"]): r for r in findings.shadow(*frames, NEW).collect()}
    assert got["x0", "label_count_drop+label:x"]["missing"] and got["x0", "label_count_drop+label:x"]["baseline"] == 0
    want = {}
    for label in "xy":
        own = [s for s in seen if s[1] == label]
        for before, now in zip([("none", label, 0, 0, 0), *own], own):
            want |= {(now[0], f): x for f, x in flags(NEW, now, before, reasons).items()}
    assert {k: r["exceeded"] for k, r in got.items()} == want


def test_episodes_side_by_side(spark):
    seen, reasons = world(9)
    frames = spark.createDataFrame(seen, "id string, label_key string, at long, evaluated long, true_count long"), spark.createDataFrame(reasons, "id string, reason string, n long")
    one, two = Rule("label_count_drop", "high", 0.1, 1, 1, 1), Rule("label_count_drop", "high", 0.3, 1, 1, 2)
    want = {}
    for side, rule in enumerate((one, two)):
        for label in "xy":
            own, states, opened = [s for s in seen if s[1] == label], [], None
            for before, now in zip(own, own[1:]):
                states.append((now[2], min(now[3], before[3]) < 1, next(iter(flags((rule,), now, before, reasons).values()))))
            before = "none"
            for (at, *_), (status, *_rest, resolved) in zip(states, plain_lifecycle(states, rule)):
                if status in findings.OPEN and before not in findings.OPEN:
                    opened = (f"label_count_drop+label:{label}", at)
                    want.setdefault(opened, [None] * 4)[2 * side] = status
                if status == "resolved" and before in findings.OPEN:
                    want[opened][2 * side + 1] = resolved
                before = status
    got = {(r["fingerprint"], r["opened_at"]): ([r["new_kind"], r["new_resolved_at"], r["old_kind"], r["old_resolved_at"]], r["diff"]) for r in findings.replayed(findings.comparisons(*frames), one, two).collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert {d for _, d in got.values()} >= {"new", "gone"} or {d for _, d in got.values()} & {"same", "changed"}


def rank(seed, value):
    return hashlib.sha256(f"{seed}\0{value}".encode()).hexdigest()


def plain_plan(labels, candidates, populations, seed, budget):
    info = {r[0]: r for r in labels}

    def risk(key):
        _, _, found, changes, now, was, coverage, stale = info[key]
        shift = 0 if now is None or was is None else (0 if now == 0 else 1) if was == 0 else abs(now - was) / abs(was)
        total = 1 + min(4, found * 2) + (min(3, math.log2(changes + 1)) if changes > 0 else 0) + (3 if shift >= 0.3 else 1 if shift >= 0.1 else 0)
        return round(total + (2 if coverage is not None and coverage < 0.8 else 0) + (2 if stale is not None and stale > 0.1 else 0), 3)

    same = {}
    for c in candidates:
        same[c[0], c[4]] = same.get((c[0], c[4]), 0) + 1

    def told(c):
        key, _, value, sure, reason, version, evaluable, change = c
        each = [
            ("insufficient_support", not evaluable, 9), ("recent_change", change is not None, 8), ("old_rule_version", version != info[key][1], 6), ("positive_evidence_negative", not value and sure < 0.9, 5 + (0.9 - sure) * 3),
            ("low_confidence_positive", value and sure < 0.5, 5 + (0.5 - sure) * 3), ("rare_reason", same[key, reason] <= 2, 2),
        ]
        return [(n, s) for n, holds, s in each if holds]

    out, taken = [], set()
    for key in sorted(info, key=lambda k: rank(seed, f"{k}:baseline-order")):
        for value in (True, False):
            own = [c for c in candidates if c[0] == key and c[2] == value and c[6] and c[7] is None]
            if own and len(out) < budget:
                c = min(own, key=lambda c: rank(seed, f"{c[0]}:{c[1]}:baseline"))
                taken.add((c[0], c[1]))
                out.append((f"{key}:{c[1]}", "random_positive" if value else "random_negative", 0.0, [n for n, _ in told(c)], populations.get((key, value))))
    rest = []
    for c in candidates:
        if (c[0], c[1]) not in taken and c[0] in info:
            signals = told(c)
            kind, more = signals[0] if signals else ("risk_targeted", 0)
            rest.append((-round(risk(c[0]) + more, 3), rank(seed, f"{c[0]}:{c[1]}:{kind}"), f"{c[0]}:{c[1]}", kind, [n for n, _ in signals]))
    for priority, _, sample, kind, signals in sorted(rest)[: max(0, budget - len(out))]:
        out.append((sample, kind, -priority, signals, None))
    return out


@pytest.mark.parametrize("budget", [3, 25, 500])
def test_review_plan_equals_a_plain_one(spark, budget):
    rng = random.Random(8)
    labels = [(f"l{i}", "2", rng.randrange(4), rng.choice([0, 1, 9]), rng.choice([None, 0.0, 0.5]), rng.choice([None, 0.0, 0.4]), rng.choice([None, 0.5, 0.9]), rng.choice([None, 0.05, 0.3])) for i in range(6)]
    candidates = [(f"l{rng.randrange(7)}", f"a{i}", rng.random() < 0.4, rng.choice([0.1, 0.45, 0.9, 0.95, 1.0]), rng.choice(["p", "q", f"own{i}"]), rng.choice(["1", "2", "2"]), rng.random() < 0.8, rng.choice([None, None, "added"])) for i in range(120)]
    populations = [(f"l{i}", v, 10 * i + v) for i in range(6) for v in (True, False)]
    got = planning.review_plan(
        spark.createDataFrame(labels, "label_key string, rule_version string, findings long, changes long, prevalence double, was_prevalence double, coverage double, stale double"),
        spark.createDataFrame(candidates, "label_key string, account_id string, value boolean, confidence double, reason string, rule_version string, evaluable boolean, change_type string"),
        spark.createDataFrame(populations, "label_key string, value boolean, n long"), "seed", budget,
    ).collect()
    want = plain_plan(labels, candidates, {(k, v): n for k, v, n in populations}, "seed", budget)
    assert [(r["sample_id"], r["sample_kind"], r["priority"], r["signals"], r["population"]) for r in got] == want and len(want) <= budget


def test_changes_overlay_candidates(spark):
    schema = "label_key string, account_id string, value boolean, reason string"
    base, new = spark.createDataFrame([("x", "a", True, "mine"), ("x", "b", True, "mine")], schema), spark.createDataFrame([("x", "a", False, "theirs", "added"), ("x", "c", False, "theirs", "removed")], schema + ", change_type string")
    assert sorted(map(tuple, planning.overlaid(base, new).collect())) == [("x", "a", True, "mine", "added"), ("x", "b", True, "mine", None), ("x", "c", False, "theirs", "removed")]


ISSUE = "id string, type string, status string, severity string, component string, detected_at long"
FINDING = "id string, type string, status string, severity string, scope_type string, scope_id string, detected_at long"


def test_attention_list(spark):
    found = [("f1", "drop", "active", "high", "label", "x", 50), ("f2", "drop", "recurring", "high", "label", "y", 60), ("f3", "drop", "active", "high", "label", "z", 10), ("f4", "drop", "resolved", "critical", "label", "z", 1), ("f5", "drop", "active", "strange", "label", "z", 1), ("f6", "drop", "active", "low", "label", "x", 0)]
    seen = [(1, "f1", 1, 9, 10), (2, "f1", 2, 1, 10), (3, "f3", 5, 5, 50), (4, "f3", 5, 5, 0), (5, "f2", 1, None, None)]
    open_ = [("i1", "stalled", "active", "high", "crawler", 55), ("i2", "stalled", "active", "critical", "crawler", 99), ("i3", "stalled", "resolved", "critical", "crawler", 1)]
    frames = spark.createDataFrame(open_, ISSUE), spark.createDataFrame(found, FINDING), spark.createDataFrame(seen, "id long, finding_id string, observed_at long, affected long, total long")
    rows = planning.attention(*frames).collect()
    assert [r["source_id"] for r in rows] == ["i2", "f2", "f1", "f3", "i1", "f6"] and [r["priority"] for r in rows] == list(range(1, 7))
    assert (rows[0]["summary"], rows[1]["summary"], rows[2]["affected"]) == ("crawler: stalled", "drop (label:y)", 1)
    assert [r["source_id"] for r in planning.attention(*frames, most=4).collect()] == ["i2", "f2", "f1", "f3"]
    assert planning.attention(*[f.limit(0) for f in frames]).count() == 0


def plain_kept(series, rule):
    """(episode, transition) after each observation (at, missing, drop), once a finding is there: thresholds by whether it is open, and a resolution that each further look renews."""
    status, exceeds, normals, resolved, episode, out = "none", 0, 0, None, 0, []
    for at, missing, drop in series:
        is_open = status in ("active", "recurring")
        bound = (rule.resolution_threshold if is_open else rule.activation_threshold) or rule.relative_threshold
        (told, exceeds, normals, resolved), = [plain_step((status, exceeds, normals, resolved), at, missing, drop >= bound, rule)]
        if told in ("active", "new_episode") and not is_open:
            episode += 1
        if told == "resolved":
            resolved = at
        status = "active" if told == "new_episode" else told
        if episode:
            out.append((episode, told))
    return out


def plain_step(state, at, missing, exceeded, rule):
    status, exceeds, normals, resolved = state
    if missing:
        return state
    if status in ("active", "recurring"):
        normals = 0 if exceeded else normals + 1
        return ("resolved", 0, normals, at) if normals >= rule.resolution else (status, exceeds, normals, resolved)
    if not exceeded:
        return status, 0, normals, resolved
    age = None if resolved is None else at - resolved
    if exceeds + 1 < rule.activation or (age is not None and rule.cooldown_ms is not None and age < rule.cooldown_ms):
        return status, exceeds + 1, 0, resolved
    return ("active" if status == "none" else "recurring" if age <= rule.recurrence_ms else "new_episode"), exceeds + 1, 0, None


def test_findings_that_are_kept(spark):
    rule = Rule("x", "high", 0.5, 0, 2, 2, 3 * H, H, activation_threshold=0.6, resolution_threshold=0.2)
    rng = random.Random(12)
    series = {f: [(i * H + (i > 40) * 9 * H * (i - 40), rng.random() < 0.1, rng.choice([0.0, 0.1, 0.3, 0.55, 0.7, 0.9])) for i in range(70)] for f in ("a", "b", "c")}
    rows = [(f, "l", at, missing, drop, 1, 2) for f, own in series.items() for at, missing, drop in own]
    seen = spark.createDataFrame(rows, "fingerprint string, label_key string, at long, missing boolean, drop double, now long, was long")
    occurred = findings.occurrences(seen, rule).orderBy("fingerprint", "at").cache()
    want = {f: plain_kept(own, rule) for f, own in series.items()}
    got = {}
    for r in occurred.collect():
        got.setdefault(r["fingerprint"], []).append((r["episode"], "resolved" if r["transition"] == "resolved" else r["transition"]))
    # An opening is told once; while it goes on, a new episode is active.
    tidy = lambda own: [(e, "active" if t == "new_episode" else t) for e, t in own]
    assert {f: tidy(own) for f, own in got.items()} == {f: tidy(own) for f, own in want.items()}
    assert max(e for own in want.values() for e, _ in own) > 1 and any(t == "recurring" for own in want.values() for _, t in own)
    ends = {(r["fingerprint"], r["episode"]): r for r in findings.kept_findings(occurred).collect()}
    assert all(r["superseded"] == ((f, e + 1) in ends) and (r["resolved_at"] is None) == (r["status"] != "resolved") for (f, e), r in ends.items())
