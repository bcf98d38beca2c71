"""Conversation structure repair by dynamic programming over a trie of signatures.

A row is one symbol: its role's initial and its fault. A conversation is the string of its symbols, its
signature. Signatures are sorted, so that a walk over them is a walk over their prefix trie: the layers of least costs are
computed once for a prefix that neighbours share, and an answer is read off at each signature's end.
Texts are hashed on the way; only the last step, which spells the repaired conversations, moves them, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spool

WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a new or renamed turn is from each state on: (state, role).
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
INSERT, DELETE, REROLE, UNFINISHED = 2, 3, 2, 1
#: Symbol of a row that has to go; a truncated row's initial is in upper case, a role but system, user, assistant is `o`.
GONE = "x"
NEVER = 1 << 60
#: Rows of a conversation whose symbols are put together at first.
BLOCK_ROWS = 4096

Layer = tuple[int, int, int, int]


def edges(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, state after, cost) of the edits of a row."""
    out = [("D", state, DELETE)]
    if symbol != GONE:
        extra = UNFINISHED * symbol.isupper()
        kept = MOVES.get(symbol.lower(), {}).get(state)
        out += [("K", kept, extra)] * (kept is not None) + [("R", NEXT[state][0], REROLE + extra)]
    return out


def _inserted(costs: list[int]) -> Layer:
    costs[USER] = min(costs[USER], min(costs[START], costs[SYSTEM], costs[ASSISTANT]) + INSERT)
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    return tuple(costs)


def layer_after(layer: Layer, symbol: str) -> Layer:
    costs = [NEVER] * 4
    for state, cost in enumerate(layer):
        for _, after, price in edges(symbol, state):
            costs[after] = min(costs[after], cost + price)
    return _inserted(costs)


def answer(layers: list[Layer], signature: str) -> tuple[int, str]:
    """Least cost and the ASCII-least of the cheapest edit strings, from the layers of all prefixes: the states that a cheapest way passes, then the least letter at each step."""
    cost = min(layers[-1][START], layers[-1][ASSISTANT])
    live: list[set[int]] = [set() for _ in layers]
    live[-1] = {s for s in (START, ASSISTANT) if layers[-1][s] == cost}
    for i in range(len(layers) - 1, -1, -1):
        if i < len(signature):
            live[i] = {s for s in range(4) for _, after, price in edges(signature[i], s) if after in live[i + 1] and layers[i][s] + price == layers[i + 1][after]}
        for _ in range(2):
            live[i] |= {s for s in range(4) if NEXT[s][0] in live[i] and layers[i][s] + INSERT == layers[i][NEXT[s][0]]}
    out, i, state = [], 0, START
    while True:
        ways = [("I", i, NEXT[state][0])] if NEXT[state][0] in live[i] and layers[i][state] + INSERT == layers[i][NEXT[state][0]] else []
        if i < len(signature):
            ways += [(c, i + 1, after) for c, after, price in edges(signature[i], state) if after in live[i + 1] and layers[i][state] + price == layers[i + 1][after]]
        if not ways:
            return cost, "".join(out)
        letter, i, state = min(ways)
        out.append(letter)


def walk(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Answers of sorted signatures; the stack of layers is the path from the trie's root to the current node."""
    stack, before, found = [_inserted([0, NEVER, NEVER, NEVER])], None, None
    for signature in signatures:
        if signature != before:
            shared = len(commonprefix([before or "", signature]))
            del stack[shared + 1 :]
            for symbol in signature[shared:]:
                stack.append(layer_after(stack[-1], symbol))
            found, before = answer(stack, signature), signature
        yield found


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    queue: list[pa.RecordBatch] = []

    def signatures() -> Iterator[str]:
        for batch in batches:
            queue.append(batch)
            yield from batch.column("signature").to_pylist()

    answers = walk(signatures())
    held: list[tuple[int, str]] = []
    for found in answers:
        held.append(found)
        if len(held) == queue[0].num_rows:
            yield queue.pop(0).append_column("cost", pa.array([c for c, _ in held], pa.int64())).append_column("audit", pa.array([a for _, a in held]))
            held = []


class _Spelling:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, role = NEXT[self.state]
            self.put(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = MOVES[role[0]][self.state]
            self.put(role, text)
        elif edit == "R":
            self.state, role = NEXT[self.state]
            self.put(role, text)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its head comes first, then its rows; heads with the hash of what is repaired go on."""
    head, now = None, None
    for batch in batches:
        done, rows = [], batch.select(["is_row", "audit", "role", "text"]).to_pydict()
        for i, (is_row, audit, role, text) in enumerate(zip(*rows.values())):
            if is_row:
                now.row(role, text)
                continue
            if head is not None:
                now.inserts()
                done.append(head.append_column("repaired_sha256", pa.array([now.hash.hexdigest()])))
            head, now = batch.slice(i, 1).drop_columns(["is_row", "role", "text", "turn", "digest"]), _Spelling(audit)
        yield from done
    if head is not None:
        now.inserts()
        yield head.append_column("repaired_sha256", pa.array([now.hash.hexdigest()]))


def _joined(rows: DataFrame, keys: list[str], at: str, what: str, *more: Column) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what])
    return rows.groupBy(*keys).agg(F.array_join(parts, "").alias(what), *more)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation.

    Rows go by turn, nulls first; rows with one turn by role and then by the text's sha256, so copies of a row are neighbours.
    A null role or text is one space. Rows whose conversation is null are one conversation. Blank rows, an empty text among them, and later rows with
    a role and text seen before are deleted. A conversation of which nothing stays has an empty audit's hash, that of the empty string. An empty
    table gives an empty result. Columns but the four named aren't looked at, whatever their names. Texts are taken whole; a task holds one
    text and one symbol for each row of a conversation, however long it is, but one task spells it, since its hash runs from first to last.
    """
    own = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = own.select("conv_id", "turn", "role", "digest", (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    initial = F.substring("role", 1, 1)
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("at")) > 1
    placed = narrow.select(
        "*", F.row_number().over(turns).alias("at"), initial.alias("initial"), F.lag(initial).over(turns).alias("before"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(turns))).alias("new_turn")
    ).withColumn("again", again)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    faults = {"blank": F.col("blank"), "duplicate": ~F.col("blank") & F.col("again"), "truncated": ~F.col("blank") & ~F.col("again") & F.col("open")}
    symbol = F.when(F.col("blank") | F.col("again"), GONE).when(F.col("open"), F.upper(known)).otherwise(known)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    counts = [F.count_if(c).alias(k) for k, c in faults.items()] + [F.count_if(F.col("before").isNotNull() & ~legal).alias("illegal"), F.count_if("new_turn").alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most")]
    blocks = _joined(placed.withColumns({"block": F.floor((F.col("at") - 1) / BLOCK_ROWS), "signature": symbol}), ["conv_id", "block"], "at", "signature", *counts)
    sums = [F.sum(k).alias(k) for k in (*faults, "illegal", "turns")] + [F.min("least").alias("least"), F.max("most").alias("most")]
    # A turn's rows can lie in two blocks; new_turn was marked before.
    heads = spool(_joined(blocks, ["conv_id"], "block", "signature", *sums), "heads")
    # Equal signatures are cut by conversation, so that a common one is no single task's.
    sorted_heads = heads.withColumn("__cut", F.xxhash64("conv_id")).repartitionByRange("signature", "__cut").drop("__cut").sortWithinPartitions("signature")
    schema = ", ".join(f"`{n}` {t}" for n, t in heads.dtypes)
    solved = sorted_heads.mapInArrow(_solve, f"{schema}, cost long, audit string")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    found = solved.select("conv_id", gaps.alias("gaps"), *faults, "illegal", "cost", "audit")
    stream = found.withColumn("is_row", F.lit(False)).unionByName(own.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "role", "digest")
    schema = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    return ordered.select(*found.columns, "is_row", "turn", "role", "text", "digest").mapInArrow(_spell, f"{schema}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of `conv_id:turn` (nulls are one space) modulo 20: dropped, emptied, without ends, repeated or from the user."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    changed = kept.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return changed.drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations`, damaged, and repaired; conversations without rows after the damage have zeros."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "__conv")
    ids = rows.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256")
    )
