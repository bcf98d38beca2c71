"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with the same shingle set are one node. All nodes order their shingles alike, rare ones first,
and a node's prefix is so long that two similar nodes must share at least l prefix shingles; l is 1
unless the prefix's shingles are frequent, and is then raised, with the prefix, by what candidates
would cost. Near copies in large groups are first tied to one hub each; what remains are pairs of
groups, which are compared hub by hub, and the triangle inequality of the Jaccard distance tells
the pairs of groups whose members need looking at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, spool, text_or_empty
from .components import connected_components
from .shingles import set_hash, shingle_sets

#: Two sets link when 100 * intersection >= THRESHOLD * union. Prefix lengths are written for 80.
THRESHOLD = 80
MAX_DISTANCE = 1 - THRESHOLD / 100
#: The order of shingles knows so many frequent ones; it bears on cost alone, never on what is found.
FREQUENT, LEAST_LOCAL, LOCAL_TOKENS = 1 << 19, 2, 4_000_000
#: Hash buckets of nodes whose sets are wanted (a bit each, sent to the executors).
WANTED_BITS = 1 << 20
#: Cost of verifying a candidate, in prefix entries.
VERIFY_COST = 20
PAIRS_AT_ONCE = 1 << 20
#: Pairs of groups that a task holds to add up their shared tokens; entries of one hub that go to one task.
PAIRS_HELD, HUB_ENTRIES = 1 << 19, 1 << 17

Batches = Iterator[pa.RecordBatch]


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values).view(np.int64) if getattr(values, "dtype", None) == np.uint64 else np.asarray(values, np.int64))


def _describe(batches: Batches) -> Batches:
    """Rows (doc_id, node, n) of texts, and rows (null, token, count) of shingles that are frequent in this task."""
    held, size = [], 0

    def frequent(kind: pa.DataType) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LEAST_LOCAL
        return pa.RecordBatch.from_arrays([pa.nulls(int(often.sum()), kind), _long(tokens[often]), _long(counts[often]), pa.array([True] * int(often.sum()), pa.bool_())], names=["doc_id", "node", "n", "token"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        nodes, sizes = [], []
        for _, s in shingle_sets(batch.column(1)):
            nodes.append(set_hash(s))
            sizes.append(len(s))
            held.append(s)
            size += len(s)
            if size >= LOCAL_TOKENS:
                yield frequent(kind)
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), _long(nodes), _long(sizes), pa.array([False] * len(nodes), pa.bool_())], names=["doc_id", "node", "n", "token"])
    if held:
        yield frequent(kind)


def needed(n: np.ndarray | int):
    """The least overlap of a set of n with a similar set: ceil(0.8 n)."""
    return -(-n * THRESHOLD // 100)


def prefix(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The prefix of a sorted set, how many of its shingles lie behind the prefix, and how many are not known as frequent.

    The first n - needed + l shingles; l is chosen among a few so that entries plus estimated
    candidates, at VERIFY_COST each, cost least. A candidate takes l entries at least.
    """
    n = len(tokens)
    need = int(needed(n))
    often = np.ones(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = np.where(frequent[at] == tokens, counts[at], 1)
    shortest = n - need + 1
    if often.max() == 1:
        return tokens[:shortest], need - 1, n
    order = np.argsort(often, kind="stable")
    tokens, met = tokens[order], np.cumsum(often[order] - 1)
    choices = sorted({min(1 + shortest * q // 4, need) for q in (0, 1, 2, 4)})
    cost = [n - need + more + met[n - need + more - 1] * (1 + VERIFY_COST / more) for more in choices]
    more = choices[int(np.argmin(cost))]
    return tokens[: n - need + more], need - more, int((often == 1).sum())


def _prefixes(frequent: np.ndarray, counts: np.ndarray):
    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            found, held = [], 0
            for _, s in shingle_sets(batch.column(0)):
                node = set_hash(s) if len(s) else 0
                if not len(s) or node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                p, rest, rare = prefix(s, frequent, counts)
                found.append((p, node, len(s) << 32 | rest, rare))
                held += len(p)
                if held > 200_000:
                    yield _entries(found)
                    found, held = [], 0
            if found:
                yield _entries(found)

    return run


def _entries(found: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
    lengths = [len(f[0]) for f in found]
    node, sizes, rare = (np.repeat(np.array([f[i] for f in found], np.int64), lengths) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays([_long(np.concatenate([f[0] for f in found])), _long(node), _long(sizes), pa.array(rare.astype(np.int32))], names=["token", "node", "sizes", "rare"])


def _shared(batches: Batches) -> Batches:
    """Of entries sorted by token, rareness and node: those whose token has two nodes or more, each with the token's first node as hub.

    The first node has the fewest shingles that are not frequent: the plainest copy, where a token's nodes are near copies.
    """
    token = last = None
    hub, told = (0, 0, 0), False
    for batch in batches:
        t, node, sizes = (batch.column(i).to_numpy() for i in range(3))
        n, rest = sizes >> 32, sizes & 0xFFFFFFFF
        if not len(t):
            continue
        carried = token is not None and t[0] == token
        if carried:
            fresh = np.flatnonzero((t != token) | (node != last))
            t, node, n, rest = (np.r_[h, x[fresh]] for h, x in zip((token, *hub), (t, node, n, rest)))
        new = np.r_[True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])]
        t, node, n, rest = t[new], node[new], n[new], rest[new]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        lengths = np.diff(np.r_[starts, len(t)])
        many = np.repeat(lengths > 1, lengths)
        first = np.repeat(starts, lengths)
        out = many.copy()
        if carried and told:
            out[0] = False
        was_told = carried and told and len(starts) == 1
        token, last, hub = t[-1], node[-1], (node[starts[-1]], n[starts[-1]], rest[starts[-1]])
        told = bool(lengths[-1] > 1) or was_told
        if out.any():
            yield pa.RecordBatch.from_arrays([_long(x) for x in (t[out], node[out], n[out], rest[out], node[first][out], n[first][out])], names=["token", "node", "n", "rest", "hub", "hub_n"])


SIDE = ("lo", "hi", "rest", "radius")


def _group_pairs(batches: Batches) -> Batches:
    """Of entries dealt by hub and sorted by hub, token and group: pairs of groups in the same token whose sizes allow a link, counted.

    Tokens of one hub have much the same groups: their pairs are added up here, as far as PAIRS_HELD goes, before they are sent on.
    columns: token, node (the group's hub), least and greatest size, greatest rest, radius in millionths, root (groups
    with the same root are linked already).
    """
    held = None
    names = ["a", "b", "m", *[f"{s}_a" for s in SIDE], *[f"{s}_b" for s in SIDE]]

    def added(parts: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(parts, 1)
        x = x[:, np.lexsort((x[1], x[0]))]
        at = np.flatnonzero(np.r_[True, (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)])
        m = np.add.reduceat(x[2], at)
        x = x[:, at]
        x[2] = m
        return x

    def pairs(x: np.ndarray) -> Iterator[np.ndarray]:
        new = np.r_[True, (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)]
        x = x[:, new]
        starts = np.flatnonzero(np.r_[True, np.diff(x[0]) != 0])
        lengths = np.diff(np.r_[starts, x.shape[1]])
        # For every row, how many rows of its token come after it.
        after = np.repeat(starts + lengths, lengths) - np.arange(x.shape[1]) - 1
        row = 0
        ends = np.cumsum(after)
        while row < x.shape[1]:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS_AT_ONCE, side="right")))
            own = after[row:stop]
            a = np.repeat(np.arange(row, stop), own)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
            row = stop
            fits = (x[3, a] * 100 >= x[2, b] * THRESHOLD) & (x[3, b] * 100 >= x[2, a] * THRESHOLD) & (x[6, a] != x[6, b])
            a, b = a[fits], b[fits]
            if len(a):
                order = np.lexsort((x[1, b], x[1, a]))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.r_[True, (np.diff(x[1, a]) != 0) | (np.diff(x[1, b]) != 0)])
                m = np.diff(np.r_[at, len(a)])
                a, b = a[at], b[at]
                yield np.stack([x[1, a], x[1, b], m, *x[2:6, a], *x[2:6, b]])

    def whole_tokens() -> Iterator[np.ndarray]:
        nonlocal held
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(7)])
            x = x if held is None else np.concatenate([held, x], 1)
            if not x.shape[1]:
                continue
            going_on = np.flatnonzero(x[0] != x[0, -1])  # the last token may go on
            cut = int(going_on[-1]) + 1 if len(going_on) else 0
            held = x[:, cut:]
            if cut:
                yield from pairs(x[:, :cut])
        if held is not None and held.shape[1]:
            yield from pairs(held)

    parts, size = [], 0
    for found in whole_tokens():
        parts.append(found)
        size += found.shape[1]
        if size > PAIRS_HELD:
            parts = [added(parts)]
            size = parts[0].shape[1]
            if 2 * size > PAIRS_HELD:
                yield pa.RecordBatch.from_arrays([_long(v) for v in parts[0]], names=names)
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([_long(v) for v in added(parts)], names=names)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of `nodes`, recomputed from the texts; the tasks get one bit for each hash bucket of nodes."""
    wanted = nodes.select(F.pmod("node", F.lit(WANTED_BITS)).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)
    bits = np.zeros(WANTED_BITS, bool)
    bits[wanted] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Batches) -> Batches:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            out, blobs, held = [], [], 0
            for _, s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                node = set_hash(s)
                if not bits[node % WANTED_BITS] or node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                out.append(node), blobs.append(s.tobytes())
                held += len(s)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([_long(out), pa.array(blobs, pa.binary())], names=["node", "shingles"])
                    out, blobs, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([_long(out), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    found = docs.select("text").mapInArrow(run, "node long, shingles binary")
    return spool(found.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _overlaps(batches: Batches) -> Batches:
    for batch in batches:
        found = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            found.append((both, len(x) + len(y) - both))
        both = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _long(both[:, 0]), _long(both[:, 1])], names=["a", "b", "both", "union"])


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, union) of distinct pairs (a, b) of nodes, from the texts' whole sets."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(docs, nodes)
    first, second = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    whole = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return spool(whole.mapInArrow(_overlaps, "a long, b long, both long, union long"), "verified")


LINKED = f"100 * both >= {THRESHOLD} * union"


def _edges(verified: DataFrame) -> DataFrame:
    return verified.where(LINKED).select(F.col("a").alias("u"), F.col("b").alias("v"))


def enough(m: str, a: str, b: str):
    """Shared prefix shingles that a similar pair must have: its least overlap, less what can lie behind both prefixes."""
    least = F.ceil((F.col(f"lo_{a}") + F.col(f"lo_{b}")) * THRESHOLD / (100 + THRESHOLD) - 1e-6)
    return F.col(m) >= F.greatest(F.lit(1), least - F.greatest(f"rest_{a}", f"rest_{b}"))


def _unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those `pairs` (a, b) that `edges` don't join."""
    root = connected_components(edges)
    both = pairs.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return spool(both.where("NOT (coalesce(ra, a) <=> coalesce(rb, b))").select(*pairs.columns), "apart")


def links(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Edges (u, v) of nodes: every link of different sets is an edge, or its ends are joined by edges."""
    top = meta.where("token").groupBy("node").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "node").limit(FREQUENT).toPandas()
    order = np.argsort(top["node"].to_numpy(np.int64).view(np.uint64))
    frequent, counts = top["node"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order]
    entries = docs.select("text").mapInArrow(_prefixes(frequent, counts), "token long, node long, sizes long, rare int")
    shared = entries.repartition("token").sortWithinPartitions("token", "rare", "node").mapInArrow(_shared, "token long, node long, n long, rest long, hub long, hub_n long")
    shared = spool(shared, "shared")

    # Hubs: each node's most frequent first node, where much of the prefix is shared.
    to_hub = shared.where(f"node <> hub AND 100 * least(n, hub_n) >= {THRESHOLD} * greatest(n, hub_n)").groupBy("node", "hub", "n").agg(F.count("*").alias("m"))
    to_hub = spool(to_hub.where("20 * m >= n"), "to-hub")
    best = to_hub.groupBy("node").agg(F.max(F.struct("m", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    starred = verify(docs, spool(best, "hubs"))
    edges = _edges(starred)
    hubs = edges.select("v").distinct()
    members = starred.where(LINKED).join(hubs, F.col("a") == F.col("v"), "left_anti").select(F.col("a").alias("node"), F.col("b").alias("center"), (F.lit(1) - F.col("both") / F.col("union")).alias("distance"))
    members = spool(members, "members")
    own = shared.groupBy("node").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))
    placed = own.join(members, "node").unionByName(own.join(members.select(F.col("center").alias("node")).distinct(), "node").select("node", "n", "rest", F.col("node").alias("center"), F.lit(0.0).alias("distance")))
    placed = spool(placed, "placed")
    groups = placed.groupBy("center").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("g_rest"), F.ceil(F.max("distance") * 1_000_000).cast("long").alias("radius"))
    table = placed.select("node", "center").join(groups, "center")

    # The other hubs that nodes met: the likeliest pair of each two groups that hubs haven't tied together.
    tied = connected_components(edges)
    rooted = lambda x: tied.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    more = to_hub.join(rooted("node"), "node", "left").join(rooted("hub"), "hub", "left").withColumns({"ra": F.coalesce("root_node", "node"), "rb": F.coalesce("root_hub", "hub")}).where("ra <> rb")
    more = more.groupBy(F.least("ra", "rb").alias("r"), F.greatest("ra", "rb").alias("s")).agg(F.max(F.struct("m", "node", "hub")).alias("best")).select(F.col("best.node").alias("a"), F.col("best.hub").alias("b"))
    edges = spool(edges.unionByName(_edges(verify(docs, spool(more, "more-hubs")))), "edges")

    # Pairs of groups (most are single nodes) that hubs haven't tied together already.
    tied = connected_components(edges)
    crowded = spool(shared.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ENTRIES).alias("parts")).where("parts > 1"), "crowded")
    dealt = F.xxhash64("hub", F.pmod(F.xxhash64("token"), F.coalesce("parts", F.lit(1)))).alias("dealt")  # a token has one hub
    entries = shared.join(small(crowded), "hub", "left").select("token", "node", "n", "rest", dealt)
    grouped = entries.join(table, "node", "left").join(tied, "node", "left").select(
        "token", F.coalesce("center", "node").alias("node"), F.coalesce("lo", "n").alias("lo"), F.coalesce("hi", "n").alias("hi"), F.coalesce("g_rest", "rest").alias("rest"), F.coalesce("radius", F.lit(0)).cast("long").alias("radius"), F.coalesce("root", "node").alias("root"), "dealt"
    )
    names = ", ".join(f"{s}_{x} long" for x in "ab" for s in SIDE)
    pairs = grouped.repartition("dealt").sortWithinPartitions("dealt", "token", "node").drop("dealt").mapInArrow(_group_pairs, f"a long, b long, m long, {names}")
    keep = [f"{s}_{x}" for x in "ab" for s in SIDE]
    pairs = pairs.groupBy("a", "b").agg(F.sum("m").alias("m"), *[F.max(c).alias(c) for c in keep]).where(enough("m", "a", "b"))
    pairs = spool(pairs.select("a", "b", (F.col("radius_a") + F.col("radius_b")).alias("radius")), "pairs")
    compared = verify(docs, pairs)
    edges = spool(edges.unionByName(_edges(compared)), "edges")

    # Groups that aren't linked by their hubs, but whose members may be.
    hub_distance = F.lit(1) - F.col("both") / F.col("union")
    near = compared.where(f"NOT ({LINKED})").join(pairs.where("radius > 0"), ["a", "b"]).withColumn("d", hub_distance).where(F.col("d") - MAX_DISTANCE - 1e-6 <= F.col("radius") / 1_000_000)
    apart = _unlinked(spool(near.select("a", "b", "d"), "near"), edges)
    if apart.isEmpty():
        return edges
    # First each member with the other group's hub: that links most groups, and tells how far each member is from both hubs.
    everyone = own.join(placed.select("node", "center", "distance"), "node", "left").select("node", "n", "rest", F.coalesce("center", "node").alias("home"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    ways = apart.select(F.col("a").alias("home"), F.col("b").alias("away"), "d").unionByName(apart.select(F.col("b").alias("home"), F.col("a").alias("away"), "d"))
    sides = spool(ways.join(everyone, "home"), "sides")
    crossed = verify(docs, spool(sides.where("node <> home").select(F.col("node").alias("a"), F.col("away").alias("b")).distinct(), "crossed"))
    edges = spool(edges.unionByName(_edges(crossed)), "edges")
    apart = _unlinked(apart, edges)
    if apart.isEmpty():
        return edges
    # Then members of groups that are still apart: by the triangle inequality on both hubs, two that link are about as far from either.
    far = crossed.select(F.col("a").alias("node"), F.col("b").alias("away"), hub_distance.alias("cross"))
    sides = sides.join(far, ["node", "away"], "left").withColumn("cross", F.coalesce("cross", "d")).drop("d")
    reach = sides.groupBy(F.col("home").alias("away"), F.col("away").alias("home")).agg(F.max("distance").alias("reach"))
    # A group of one node is done: all members have met its hub.
    sides = spool(sides.join(reach, ["home", "away"]).where(f"cross <= {MAX_DISTANCE} + 1e-6 + reach"), "sides")
    tokens = shared.select("token", "node")

    def side(x: str, home: str, away: str) -> DataFrame:
        own_side = sides.join(apart.select("a", "b"), (F.col("home") == F.col(home)) & (F.col("away") == F.col(away))).join(tokens, "node")
        return own_side.select("token", "a", "b", *[F.col(c).alias(f"{name}_{x}") for c, name in (("node", "node"), ("n", "lo"), ("rest", "rest"), ("distance", "off"), ("cross", "cross"))])

    members = side("a", "a", "b").join(side("b", "b", "a"), ["token", "a", "b"]).where(
        f"abs(off_a - cross_b) <= {MAX_DISTANCE} + 1e-6 AND abs(cross_a - off_b) <= {MAX_DISTANCE} + 1e-6 AND 100 * least(lo_a, lo_b) >= {THRESHOLD} * greatest(lo_a, lo_b)"
    )
    members = members.groupBy("node_a", "node_b", "lo_a", "lo_b", "rest_a", "rest_b").agg(F.count("*").alias("m")).where(enough("m", "a", "b"))
    found = verify(docs, spool(members.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "members"))
    return edges.unionByName(_edges(found))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`.

    component_id is the least id that links reach, its own among them. A text without words (null,
    empty, white space) has no shingles and is linked with nothing: its component is its own id. Rows
    that share an id are documents each. A null id is ignored in a component where others have ids. Columns but the
    two are not looked at; an empty table gives an empty result.
    Components are all it gives: not every link is verified, so there is no list or number of links.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    meta = spool(own.mapInArrow(_describe, f"doc_id {kind}, node long, n long, token boolean"), "nodes")
    roots = spool(connected_components(links(own.select("text"), meta)), "roots")
    rows = meta.where("NOT token").select("doc_id", "node", "n")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    nodes = spool(nodes, "least")
    component = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.join(component, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
