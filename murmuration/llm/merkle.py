"""Merkle dataset manifest by an associative sparse-forest monoid.

A forest holds the nodes of one tree that are not resolved yet, keyed by level and index. Two forests
merge by union; whenever a run of siblings is complete (its length is known from the number of leaves) the run
gives way to its parent. The order of merges doesn't matter, so parts of the input reduce on their own and
their forests are merged in a tree of rounds. Rounds merge neighbouring parts, since only neighbours complete
runs: a forest of neighbouring parts keeps O(log n) nodes at its two edges, whatever it covers.
(RDD.treeReduce deals parts out by number modulo the width, where nothing would complete before the driver.)
Going down again over the same rounds, every unresolved node gets its siblings up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import documents, spool

ARITY = 2
#: Leaves of a part, about, and parts that a round merges into one.
PART_ROWS, FAN = 20_000, 64
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Forest = dict[tuple[int, int], bytes]


def digest(parts: list[bytes]) -> bytes:
    """Of digests as lower-case hex text, concatenated."""
    return sha256(b"".join(parts).hex().encode()).digest()


def widths(leaves: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level, leaves first, down to the one root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def merge(one: Forest, other: Forest, leaves: int, arity: int = ARITY, seen: Forest | None = None) -> Forest:
    """The monoid's operation: the union, with every complete run of siblings replaced by its parent. `seen` gets all nodes on the way."""
    nodes, levels = one | other, widths(leaves, arity)
    rows: dict[int, set[int]] = {}
    for level, index in nodes:
        rows.setdefault(level, set()).add(index)
    if seen is not None:
        seen.update(nodes)
    for level in range(len(levels) - 1):
        for parent in {i // arity for i in rows.get(level, ())}:
            run = [(level, i) for i in range(parent * arity, min((parent + 1) * arity, levels[level]))]
            if all(k in nodes for k in run):
                nodes[level + 1, parent] = digest([nodes.pop(k) for k in run])
                rows.setdefault(level + 1, set()).add(parent)
                if seen is not None:
                    seen[level + 1, parent] = nodes[level + 1, parent]
    return nodes


def siblings(seen: Forest, level: int, index: int, leaves: int, arity: int = ARITY) -> tuple[bytes, tuple[int, int]]:
    """The siblings of a node, level by level and left to right, as far as `seen` has its parents; and the last of these."""
    out, levels = [], widths(leaves, arity)
    while level + 1 < len(levels) and (level + 1, index // arity) in seen:
        first = index // arity * arity
        out += [seen[level, i] for i in range(first, min(first + arity, levels[level])) if i != index]
        level, index = level + 1, index // arity
    return b"".join(out), (level, index)


def fold(leaf: bytes, proof: bytes, places: list[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that a leaf and its siblings lead to; places: (index, leaves) in its own tree, then of that tree's root in the next, and so on."""
    at, node = 0, leaf
    for index, leaves in places:
        for width in widths(leaves, arity)[:-1]:
            first = index // arity * arity
            left, right = index - first, min(first + arity, width) - index - 1
            run = [proof[at + 32 * i : at + 32 * (i + 1)] for i in range(left + right)]
            node, at, index = digest([*run[:left], node, *run[left:]]), at + 32 * (left + right), index // arity
    return node


def _trees(rows: list[dict]) -> dict[str, tuple[int, Forest]]:
    out: dict[str, tuple[int, Forest]] = {}
    for r in rows:
        out.setdefault(r["tree"], (r["leaves"], {}))[1][r["level"], r["index"]] = r["node"]
    return out


NODE = "part long, tree string, leaves long, level int, index long, node binary, top boolean"
_NODE = pa.schema([("part", pa.int64()), ("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.binary()), ("top", pa.bool_())])
_PATHS = pa.schema([("part", pa.int64()), ("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("proof", pa.binary())])


def _node_rows(part: int, trees: dict[str, tuple[int, Forest]]) -> pa.Table:
    return pa.Table.from_pylist([{"part": part, "tree": t, "leaves": n, "level": k[0], "index": k[1], "node": v, "top": k[0] == len(widths(n)) - 1} for t, (n, f) in trees.items() for k, v in f.items()], _NODE)


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.take(pa.compute.sort_indices(rows, [("tree", "ascending"), ("key", "ascending"), ("leaf", "ascending")], null_placement="at_start"))


def _leaves(rows: pa.Table, info: pa.Table) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """tree, number of its leaves, index of the first leaf here, leaves: of each tree that has leaves in this part."""
    leaf, at = rows.column("leaf").to_pylist(), 0
    for i in sorted(info.to_pylist(), key=lambda r: r["tree"].encode()):
        yield i["tree"], i["leaves"], i["first"], leaf[at : at + i["n"]]
        at += i["n"]


def _reduce_part(rows: pa.Table, info: pa.Table) -> pa.Table:
    part = info.column("part")[0].as_py()
    return _node_rows(part, {t: (n, merge({}, {(0, first + i): x for i, x in enumerate(own)}, n)) for t, n, first, own in _leaves(_ordered(rows), info)})


def _merge_parts(rows: pa.Table) -> pa.Table:
    return _node_rows(rows.column("part")[0].as_py(), {t: (n, merge({}, f, n)) for t, (n, f) in _trees(rows.to_pylist()).items()})


def _proofs_below(below: pa.Table, above: pa.Table) -> pa.Table:
    """Siblings up to the root of each node that came into a round, from those of the nodes that left it."""
    known = {(r["tree"], r["level"], r["index"]): r["proof"] for r in above.to_pylist()}
    rows, out = below.to_pylist(), []
    for tree, (n, forest) in _trees(rows).items():
        merge({}, forest, n, seen=(seen := {}))
        for level, index in forest:
            own, last = siblings(seen, level, index, n)
            out.append({"tree": tree, "level": level, "index": index, "proof": own + known.get((tree, *last), b"")})
    parts = {(r["tree"], r["level"], r["index"]): r["below"] for r in rows}
    return pa.Table.from_pylist([r | {"part": parts[r["tree"], r["level"], r["index"]]} for r in out], _PATHS)


def _proofs_of_leaves(rows: pa.Table, info: pa.Table) -> pa.Table:
    rows, index, proofs = _ordered(rows), [], []
    above = {r["tree"]: {(p["level"], p["index"]): p["proof"] for p in r["proofs"] or ()} for r in info.to_pylist()}
    for tree, n, first, own in _leaves(rows, info):
        merge({}, {(0, first + i): x for i, x in enumerate(own)}, n, seen=(seen := {}))
        for i in range(first, first + len(own)):
            path, last = siblings(seen, 0, i, n)
            index.append(i)
            proofs.append(path + above[tree].get(last, b""))
    return rows.append_column("index", pa.array(index, pa.int64())).append_column("proof", pa.array(proofs, pa.binary()))


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, subroot, leaves) of each tree, and the rows of `leaves` (tree, key, leaf, more) with index, leaves and proof.

    Leaves ascend by key within a tree, nulls first, equal keys by leaf.
    """
    parts = max(1, -(-leaves.count() // PART_ROWS))
    # Rows that are equal in all of it are told apart by number, so that many of them can be cut too.
    numbered = spool(leaves.withColumn("__number", F.monotonically_increasing_id()), "leaves")
    cut = spool(numbered.repartitionByRange(parts, "tree", "key", "leaf", "__number").withColumn("part", F.spark_partition_id().cast("long")).drop("__number"), "parts")
    held = cut.groupBy("tree", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    info = spool(held.select("tree", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("leaves")), "info")

    rounds = [spool(cut.select("part", "tree", "key", "leaf").groupBy("part").cogroup(info.groupBy("part")).applyInArrow(_reduce_part, NODE), "forest")]
    last = info.agg(F.max("part")).first()[0] or 0
    top = F.col("top")
    while last > 0:
        last //= FAN
        rounds.append(spool(rounds[-1].where(~top).withColumn("part", (F.col("part") / FAN).cast("long")).groupBy("part").applyInArrow(_merge_parts, NODE), "forest"))
    roots = rounds[0].where(top)
    for r in rounds[1:]:
        roots = roots.unionByName(r.where(top))
    roots = spool(roots.select("tree", F.col("node").alias("subroot"), "leaves"), "roots")

    paths = None  # a node without a row here is a root
    for r in reversed(rounds[:-1]):
        below = r.where(~top).select((F.col("part") / FAN).cast("long").alias("part"), "tree", "leaves", "level", "index", "node", F.col("part").alias("below"))
        none = below.select("part", "tree", "level", "index", F.col("node").alias("proof")).limit(0)
        paths = spool(below.groupBy("part").cogroup((none if paths is None else paths).groupBy("part")).applyInArrow(_proofs_below, "part long, tree string, level int, index long, proof binary"), "paths")
    if paths is None:
        own = info.withColumn("proofs", F.lit(None).cast("array<struct<level:int,index:bigint,proof:binary>>"))
    else:
        by = paths.groupBy("part", "tree").agg(F.collect_list(F.struct("level", "index", "proof")).alias("proofs"))  # two edges of a part: O(log n)
        own = info.join(by, ["part", "tree"], "left")
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return roots, cut.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_proofs_of_leaves, f"{schema}, index long, proof binary").drop("part")


def leaf_of(fields: dict[str, Column]) -> Column:
    """sha256 of all fields, `-` for null, else the length in UTF-8 bytes, a colon and the value; as bytes."""
    spelled = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*spelled), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", key_col: str = "doc_id", changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """key, leaf, changed_leaf, index, leaves, tree_index, trees, subroot, root (bytes) and proof (the siblings' bytes, up to the root): one row for each row of `docs`.

    A tree for each value of `tree_col` over its rows by `key_col`, and one tree over their roots by that value (null first, UTF-8 bytewise).
    `changed` and `when`: fields that some rows have otherwise, for changed_leaf; null elsewhere.
    Nulls in any field are told from all values; null keys come first in their tree. Rows with the same key are ordered by their leaves, and rows
    repeated whole are leaves each, which of them has which index is left open as nothing tells them apart. Texts are hashed whole, however
    long. A single row is its own root. An empty table gives an empty result. Columns but `fields` are not looked at, whatever their names.
    """
    own = {f: F.col(f) for f in fields}
    other = F.when(when, leaf_of(own | (changed or {}))) if when is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))  # null sorts first
    roots, rows = trees(docs.select(tree.alias("tree"), F.col(key_col).alias("key"), leaf_of(own).alias("leaf"), other.alias("changed_leaf")))
    top, placed = trees(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("leaf"), F.col("leaves").alias("below")))
    tops = placed.select(F.col("key").alias("tree"), F.col("leaf").alias("subroot"), F.col("below").alias("leaves"), F.col("index").alias("tree_index"), F.col("proof").alias("top_proof")).join(
        F.broadcast(top.select(F.col("subroot").alias("root"), F.col("leaves").alias("trees")))  # one row
    )
    tops = spool(tops, "tops")
    # One row for each tree: broadcast where they are few, else joined with each tree's rows dealt over several keys.
    few = tops.count() <= MOST_BROADCAST
    if few:
        joined = rows.join(F.broadcast(tops), "tree")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
        joined = salted.join(tops.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["tree", "__salt"])
    return joined.select("key", "leaf", "changed_leaf", "index", "leaves", "tree_index", "trees", "subroot", "root", F.concat("proof", "top_proof").alias("proof"))


#: Trees whose roots are broadcast, and salts of each tree beyond.
MOST_BROADCAST, SALTS = 10_000, 16


@F.pandas_udf(BinaryType())
def _folded(leaf: pd.Series, proof: pd.Series, index: pd.Series, leaves: pd.Series, tree_index: pd.Series, trees_: pd.Series) -> pd.Series:
    return pd.Series([fold(x, p, [(i, n), (j, m)]) for x, p, i, n, j, m in zip(leaf, proof, index, leaves, tree_index, trees_)])


def folded_root(leaf: str | Column = "leaf") -> Column:
    """The root that a manifest's row gives for `leaf` and its own siblings."""
    return _folded(leaf, "proof", "index", "leaves", "tree_index", "trees")


def _hex(col: str) -> Column:
    return F.lower(F.hex(col))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`; where 7 divides the id's crc32, the proof is held against a row whose n_chars is one more."""
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, changed={"n_chars": F.col("n_chars") + 1}, when=tampered).withColumn("folded", folded_root(F.coalesce("changed_leaf", "leaf")))
    return rows.select(
        F.col("key").alias("doc_id"), _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), F.sha2(_hex("proof"), 256).alias("proof_sha256"),
        _hex("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_SPELL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_BYTES = "list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1)))"  # decimal digits and a sign alone
_STEP = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, CAST(doc_id AS VARCHAR) AS k,
    sha256(concat({", ".join(_SPELL.format(f) for f in FIELDS)})) AS leaf,
    sha256(concat({", ".join(_SPELL.format("(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS)})) AS other
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    coalesce(xor(CAST(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform({_BYTES}, lambda a: CAST(a AS BIGINT))), lambda c, b: {_STEP}) AS BIGINT), 4294967295) % 7 = 0, false) AS tampered
  FROM t),
nodes AS (
  SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS width FROM l
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), CAST(ceil(any_value(width) / 2) AS BIGINT) FROM nodes WHERE width > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS j FROM nodes WHERE width = 1),
tops AS (
  SELECT 0 AS level, j, subroot AS h, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), CAST(ceil(any_value(width) / 2) AS BIGINT) FROM tops WHERE width > 1 GROUP BY level, j // 2),
up AS (
  SELECT l.doc_id, l.leaf, l.tampered, tree, s.subroot, l.i, j, 0 AS level, 0 AS stage, '' AS proof, CASE WHEN l.tampered THEN l.other ELSE l.leaf END AS folded, n.width
  FROM l JOIN subroots s USING (tree) JOIN nodes n USING (tree) WHERE n.level = 0 AND n.i = l.i
  UNION ALL
  SELECT doc_id, leaf, tampered, tree, subroot, CASE WHEN width > 1 THEN i // 2 ELSE j END, j, CASE WHEN width > 1 THEN level + 1 ELSE 0 END, CASE WHEN width > 1 THEN stage ELSE 1 END,
    proof || coalesce(sib, ''), CASE WHEN width = 1 THEN folded WHEN sib IS NULL THEN sha256(folded) WHEN i % 2 = 0 THEN sha256(folded || sib) ELSE sha256(sib || folded) END,
    CASE WHEN width > 1 THEN CAST(ceil(width / 2) AS BIGINT) ELSE (SELECT count(*) FROM subroots) END
  FROM (
    SELECT up.*, CASE WHEN stage = 0 THEN n.h ELSE p.h END AS sib FROM up
    LEFT JOIN nodes n ON stage = 0 AND up.width > 1 AND n.tree = up.tree AND n.level = up.level AND n.i = xor(up.i, 1)
    LEFT JOIN tops p ON stage = 1 AND up.width > 1 AND p.level = up.level AND p.j = xor(up.i, 1))
  WHERE width > 1 OR stage = 0)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM up, (SELECT h FROM tops WHERE width = 1) r WHERE stage = 1 AND up.width = 1
"""
