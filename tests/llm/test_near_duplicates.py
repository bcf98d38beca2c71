import random
import re
from itertools import combinations

import pytest
from helpers import frame, rows, words

from murmuration.llm import components, jaccard_join, line_dedup, shingles


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(data):
    sets = [shingle_set(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(data)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(data, sets))]


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), int(share * len(w))):
        w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed=5):
    rng = random.Random(seed)
    out = []
    for base in (words(rng, 200, 10**6), words(rng, 90), words(rng, 30)):
        out += [base] + [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(25)]
        for _ in range(3):  # chains of small edits
            out.append(edited(rng, out[-1], 0.03))
        out.append(base.upper())
    common = words(rng, 60)
    out += [common + " " + words(rng, rng.randint(5, 30)) for _ in range(25)]
    rng.shuffle(out)
    return [(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(out)]


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_components_against_brute_force(spark):
    data = near_copies() + [(1000 + r[0], *r[1:]) for r in rows()] + [(None, "only this text has no id at all", "en", "s", 0), (2000, "a b", "en", "s", 0), (2001, "A  B\n", "en", "s", 0)]
    data += [data[0]] * 3
    assert got(jaccard_join.near_duplicates(frame(spark, data, extra=True))) == sorted(plain_components(data), key=str)


def test_groups_without_a_common_hub(spark, monkeypatch):
    """Stars with wide radii, so that links between members of different groups have to be found."""
    rng = random.Random(8)
    base = words(rng, 120, 10**6)
    chain, texts = base, [base]
    for _ in range(40):
        chain = edited(rng, chain, 0.017)
        texts.append(chain)
    order = list(range(len(texts)))
    rng.shuffle(order)
    data = [(k, texts[o], "en", "s", 0) for k, o in enumerate(order)]
    assert got(jaccard_join.near_duplicates(frame(spark, data))) == sorted(plain_components(data), key=str)


def test_adaptive_prefix_keeps_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_LOCAL", 1)
    data = near_copies(11)
    assert got(jaccard_join.near_duplicates(frame(spark, data))) == sorted(plain_components(data), key=str)


def test_nothing_to_join(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert got(jaccard_join.near_duplicates(frame(spark, [(1, None, "en", "s", 0), (2, " \n", "en", "s", 0)]))) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    df = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r["node"]: r["root"] for r in df.collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[1000 + i] for i in range(50)} == {1000}


def test_shingles_of_sliced_batches():
    import pyarrow as pa

    texts = ["a b c d e f", "", "A\tb  c\x0bd e F", "x", "é ü ß", "a b c d e"]
    whole = dict(shingles.shingle_sets(pa.array(texts)))
    part = dict(shingles.shingle_sets(pa.array(["zzz", *texts])[1:]))
    assert all((whole[i] == part[i]).all() for i in whole) and len(whole) == len(texts)
    assert (whole[0] == whole[2]).all() and len(whole[0]) == 2 and len(whole[1]) == 0
    assert set(whole[5]) < set(whole[0])


# lines


def plain_removed(data):
    places = sorted((r[0], i, x) for r in data if r[0] is not None for i, x in enumerate((r[1] or "").split("\n")))
    sets = [(d, i, set(re.findall(r"[^ \t\n\x0b\f\r]+", x.lower()))) for d, i, x in places]
    sets = [(d, i, s) for d, i, s in sets if s]
    out = set()
    for k, (d, i, s) in enumerate(sets):
        for e, j, t in sets[:k]:
            if (e, j) < (d, i) and 100 * len(s & t) >= 80 * len(s | t):
                out.add((d, i))
                break
    return out


def line_docs(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 40)) for _ in range(30)]
    out = []
    for i in range(40):
        picks = [edited(rng, rng.choice(base), rng.choice([0, 0, 0.05, 0.15])) if rng.random() < 0.6 else words(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 8))]
        out.append((i, "\n".join(picks), "en", "s", 0))
    return out + [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "\n\n", "en", "s", 0), (53, out[0][1], "en", "s", 0), (54, "one two three four five " * 900, "en", "s", 0), (55, "ONE  two three\tfour five ", "en", "s", 0), (56, "one two three four five", "en", "s", 0)]


def test_removed_lines_against_brute_force(spark):
    data = line_docs() + [line_docs()[2]] * 2
    found = {(r["doc"], r["line"]) for r in line_dedup.removed_lines(frame(spark, data, extra=True)).collect()}
    assert found == plain_removed(data) and found


def test_dedup_keeps_other_lines_and_columns(spark):
    data = line_docs()
    df = frame(spark, data, extra=True)
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    gone = plain_removed(data)
    for r in data:
        lines = (r[1] or "").split("\n")
        rest = [x for i, x in enumerate(lines) if (r[0], i) not in gone]
        if any(x.strip() for x in rest) or len(rest) == len(lines):
            assert kept[r[0]]["text"] == (r[1] if len(rest) == len(lines) else "\n".join(rest))
        else:
            assert r[0] not in kept
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.removed_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [5, 7, 10, 33])
def test_least_overlap(n):
    assert jaccard_join.needed(n) == min(k for k in range(n + 1) if 100 * k >= 80 * n)
