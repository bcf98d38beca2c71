"""Repairs against all edit strings of short conversations and a plain search of longer ones, and the awkward tables."""

import itertools
import random
import re
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from murmuration.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
INITIAL = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
SHAPE = re.compile(r"(s?(ua)+)?")


def cost_of(symbol, edit):
    return {"K": 0, "D": 3}.get(edit[0], 2) + (symbol.isupper() and edit[0] != "D")


def every(signature, most_inserts=3):
    """Least (cost, audit) of all edit strings, by trying them."""
    best = None
    each = [["D"] if c == "x" else ["K", "Ru", "Ra", "D"] for c in signature]
    for edits in itertools.product(*each):
        price = sum(cost_of(c, e) for c, e in zip(signature, edits))
        for inserts in itertools.product(*[[()] + [p for n in range(1, most_inserts + 1) for p in itertools.product("ua", repeat=n)]] * (len(signature) + 1)):
            if sum(map(len, inserts)) > most_inserts:
                continue
            roles, audit = "".join(inserts[0]), "I" * len(inserts[0])
            for c, e, more in zip(signature, edits, inserts[1:]):
                roles += ("" if e == "D" else c.lower() if e == "K" else e[1]) + "".join(more)
                audit += e[0] + "I" * len(more)
            if SHAPE.fullmatch(roles):
                found = (price + 2 * sum(map(len, inserts)), audit)
                best = found if best is None else min(best, found)
    return best


def plain(signature):
    """Least (cost, audit) by a search from the front over what stands so far."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, last, new):
        out = [(0, "")] if i == len(signature) and last in ("", "a") else []
        if new < 2:
            out += [(2 + c, "I" + a) for r in legal[last] if r != "s" for c, a in [rest(i, r, new + 1)]]
        if i < len(signature):
            s = signature[i]
            c, a = rest(i + 1, last, 0)
            out.append((3 + c, "D" + a))
            if s != "x":
                extra = int(s.isupper())
                for r in legal[last]:
                    c, a = rest(i + 1, r, 0)
                    out += [(c + extra, "K" + a)] * (s.lower() == r) + [(c + extra + 2, "R" + a)] * (r != "s")
        return min(out, default=(10**9, ""))

    return rest(0, "", 0)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_edit_strings(n):
    for signature in map("".join, itertools.product("suaoSUAOx", repeat=n)):
        assert next(conversations.walk(iter([signature]))) == every(signature) == plain(signature), signature


def test_sorted_signatures_share_layers(monkeypatch):
    rng, made = random.Random(4), []
    signatures = sorted("".join(rng.choice("suauauaoSUAOx") for _ in range(rng.randint(0, 9))) for _ in range(400))
    real = conversations.layer_after
    monkeypatch.setattr(conversations, "layer_after", lambda layer, symbol: made.append(symbol) or real(layer, symbol))
    assert list(conversations.walk(iter(signatures))) == [plain(s) for s in signatures]
    assert len(made) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})  # one layer for each node of the trie


def expected(rows):
    """What the query has to give, by conversation."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
        signature, seen, n = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            c = role[:1] if role[:1] in set("sua") else "o"
            signature += {"blank": "x", "duplicate": "x", "truncated": c.upper()}.get(fault, c)
            if fault:
                n[fault] += 1
        cost, audit = plain(signature)
        queue, last, lines = list(own), "", []
        for edit in audit:
            role, text = ("", "") if edit == "I" else queue.pop(0)[1:]
            if edit in "IR":
                role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last]
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        turns = [t for t, *_ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n.values(), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(seed=2, n=150):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            text = rng.choice(["Yes.", "No!", "and then", "why? ", "", " \t\n", "end.\n\n", None, "é😀。", f"line {rng.randrange(9)}.", "x" * 3000 + "."])
            out.append((conv, None if rng.random() < 0.04 else turn + rng.choice((0, 0, 0, 3)), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "User"]), text))
    out += [(None, 1, "user", "hello."), (None, None, "assistant", "yes."), (-4, None, None, None), out[0], out[0]]
    return out


def queried(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = conversations.op12_conversations(spark, str(folder)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[k] for k in names) for r in got}


def test_query_equals_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 2)
    rows = table()
    assert queried(spark, tmp_path, rows) == expected(rows)


def test_empty_tables_and_one_long_conversation(spark, tmp_path, monkeypatch):
    assert queried(spark, tmp_path / "none", []) == {}
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 64)
    long = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(250)]
    assert queried(spark, tmp_path / "long", long) == expected(long)


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "More.")]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS at", "'x' AS audit", "2 AS signature", "3 AS digest", "true AS is_row", "4 AS cost", "5 AS block", "6 AS turns")
    assert conversations.repair(more).collect() == conversations.repair(df).collect()
    assert conversations.repair(df).first()["audit"] == "KKIK"
