"""The manifest against a plain tree, the monoid's laws, and the awkward tables."""

from hashlib import sha256
from zlib import crc32

import pytest
from helpers import DOCS, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def proof(tree, i):
    out = []
    for row in tree[:-1]:
        if (i ^ 1) < len(row):
            out.append((i & 1, row[i ^ 1]))
        else:
            out.append((2, ""))
        i //= 2
    return out


def plain(data):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    by = {}
    for r in data:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([trees[x][1][-1][0] for x in order])
    out = []
    for j, lang in enumerate(order):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            path = proof(tree, i) + proof(top, j)
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:4], r[4] + 1)) if tampered and r[4] is not None else leaf(r)
            for side, sibling in path:
                node = h(node if side == 2 else node + sibling if side == 0 else sibling + node)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], h("".join(s for _, s in path)), node, node == top[-1][0]))
    return out


def data(seed, n):
    langs = ("en", "fr", None, "", "é", "=")
    plain_rows = [(d, t, langs[d % 13 % 6], s, c) for d, t, _, s, c in rows(seed, n)]
    return plain_rows + [(None, "no id", "en", "s", 5), (None, None, None, None, None), plain_rows[3], plain_rows[3], (-5, "x", "en", None, None), (2**60, "far", "fr", "s", 3)]


def queried(spark, folder, table):
    frame(spark, table).write.parquet(f"{folder}/documents.parquet")
    got = merkle.op11_merkle(spark, str(folder)).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got), key=repr)


@pytest.mark.parametrize("part_rows,fan", [(20_000, 64), (3, 2)])
def test_query_equals_a_plain_tree(spark, tmp_path, monkeypatch, part_rows, fan):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    monkeypatch.setattr(merkle, "FAN", fan)
    table = data(3, 40)
    assert queried(spark, tmp_path, table) == sorted(plain(table), key=repr)


def test_joins_of_many_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_BROADCAST", 2)
    table = data(8, 20)
    got = merkle.manifest(frame(spark, table, extra=True)).select("key", "leaf", "root").collect()
    assert sorted((repr(r["key"]), r["leaf"].hex(), r["root"].hex()) for r in got) == sorted((repr(r[0]), r[1], r[3]) for r in plain(table))


def test_one_row_and_none(spark, tmp_path):
    one = [(7, "alone", "en", "s", 5)]
    assert queried(spark, tmp_path / "one", one) == plain(one)
    assert queried(spark, tmp_path / "none", []) == []
    assert merkle.manifest(spark.createDataFrame([], DOCS)).columns == ["key", "leaf", "changed_leaf", "index", "leaves", "tree_index", "trees", "subroot", "root", "proof"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(2, 4), st.data())
def test_merge_is_a_commutative_monoid(n, arity, draw):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    parts = [{}, {}, {}]
    for i, part in enumerate(draw.draw(st.lists(st.integers(0, 2), min_size=n, max_size=n))):
        parts[part][0, i] = leaves[i]
    a, b, c = (merkle.merge({}, p, n, arity) for p in parts)
    left = merkle.merge(merkle.merge(a, b, n, arity), c, n, arity)
    assert left == merkle.merge(a, merkle.merge(b, c, n, arity), n, arity) == merkle.merge(merkle.merge(c, a, n, arity), b, n, arity)
    assert left == merkle.merge(left, {}, n, arity) and len(left) == 1
    ((top, index), root), = left.items()
    assert (top, index) == (len(merkle.widths(n, arity)) - 1, 0)
    merkle.merge({}, {(0, i): x for i, x in enumerate(leaves)}, n, arity, seen=(seen := {}))
    for i in range(n):
        path, last = merkle.siblings(seen, 0, i, n, arity)
        assert last == (top, 0) and merkle.fold(leaves[i], path, [(i, n)], arity) == root
        assert merkle.fold(b"x" * 32, path, [(i, n)], arity) != root


def test_a_range_of_parts_keeps_few_nodes():
    n = 100_000
    own = merkle.merge({}, {(0, i): b"%032d" % i for i in range(33_333, 70_001)}, n)
    assert len(own) <= 2 * len(merkle.widths(n))
