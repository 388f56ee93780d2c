"""Repair of conversation structure by Hirschberg's divide and conquer.

The roles of a repaired conversation read ``(s?(ua)+)?``, which takes four states: at
the start, after system, after user, after assistant.  Every row is kept, given
another role or deleted, and empty turns may be inserted anywhere; what a row can
do is a 4 x 4 table of costs and edits.  Forward and backward vectors over the four
states meet at the middle row, the cheapest crossing whose edits so far are ASCII-least
is taken, and both halves are solved alike, so that only states are ever stored.

The edits that lead to two states are compared without being spelled out: each
ends with the edit of the same row, so neither begins the other, and a vector holds
their rank beside the costs.  The same tables compose: a block of rows is a 4 x 4
table itself.  Long conversations are cut into blocks that are summed up and solved
in many tasks, with the crossings between blocks found level by level above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.llm.common import bounded_batches, table, written

BLOCK = 4096  # rows that one table sums up
FAN = 1024  # tables that one table above sums up
PACK = 50_000  # rows of blocks in one task

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a turn that continues the alternation
NAMES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 4, 2, 0)  # of the turns that a conversation lacks at its end
DELETE, RENAME, INSERT, CUT = 3, 2, 2, 1
FAR = 1 << 40  # no way
GONE, TRUNCATED = 8, 4  # kinds of rows: 0-3 initial s, u, a, other; 4-7 the same, truncated; 8 must go
WHITE = " \t\n\x0b\x0c\r"

Vector = tuple[tuple[int, ...], tuple[int, ...]]


def _moves(kind: int) -> list[list[tuple[int, str]]]:
    """Cheapest edits, ASCII-least among equals, from each state over one row to each state."""
    out = [[(FAR, "")] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):  # more turns only lead to states that fewer reach
            ways = [(DELETE, "D", state)]
            if kind != GONE:
                extra, initial = (CUT if kind & TRUNCATED else 0), kind & 3
                if initial == 0 and state == START:
                    ways.append((extra, "K", SYSTEM))
                if initial in (1, 2) and NEXT[state] == initial + 1:
                    ways.append((extra, "K", NEXT[state]))
                ways.append((RENAME + extra, "R", NEXT[state]))
            for cost, edit, to in ways:
                out[start][to] = min(out[start][to], (INSERT * inserted + cost, "I" * inserted + edit))
            state = NEXT[state]
    return out


MOVES = [_moves(kind) for kind in range(9)]
COSTS = [tuple(tuple(x[0] for x in row) for row in moves) for moves in MOVES]
_TAILS = sorted({x[1] for moves in MOVES for row in moves for x in row})
ORDERS = [tuple(tuple(_TAILS.index(x[1]) for x in row) for row in moves) for moves in MOVES]


def at(state: int) -> Vector:
    """The vector of a start at one state."""
    return tuple(0 if s == state else FAR for s in range(4)), (0, 0, 0, 0)


def ahead(vector: Vector, costs, orders) -> tuple[Vector, int]:
    """The vector one table further, its least cost taken out, and that cost."""
    before, ranks = vector
    best = []
    for q in range(4):
        ways = [(before[p] + costs[p][q], ranks[p], orders[p][q]) for p in range(4) if before[p] < FAR and costs[p][q] < FAR]
        best.append(min(ways, default=(FAR, 9, 9)))
    base = min(b[0] for b in best)
    place = sorted({b[1:] for b in best})
    return (tuple(b[0] - base if b[0] < FAR else FAR for b in best), tuple(place.index(b[1:]) for b in best)), base


def back(after: tuple[int, ...], costs) -> tuple[int, ...]:
    """Least costs from each state through one table to the end, less the least of them."""
    found = [min(costs[p][q] + after[q] for q in range(4)) for p in range(4)]
    base = min(found)
    return tuple(min(f - base, FAR) for f in found)


@lru_cache(maxsize=1 << 16)
def ahead_row(vector: Vector, kind: int) -> tuple[Vector, int]:
    return ahead(vector, COSTS[kind], ORDERS[kind])


@lru_cache(maxsize=1 << 16)
def back_row(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    return back(after, COSTS[kind])


def crossings(n: int, forward: Callable, backward: Callable, start: int, end: int) -> list[int]:
    """The states before, between and after n steps of the cheapest, ASCII-least way.

    ``forward(vector, i)`` and ``backward(after, i)`` pass step i.
    """
    states = [start] * n + [end]
    parts = [(0, n)]
    while parts:
        low, high = parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector, after = at(states[low]), at(states[high])[0]
        for i in range(low, middle):
            vector = forward(vector, i)[0]
        for i in range(high - 1, middle - 1, -1):
            after = backward(after, i)
        states[middle] = min(range(4), key=lambda s: (min(vector[0][s] + after[s], FAR), vector[1][s]))
        parts += [(low, middle), (middle, high)]
    return states


def row_states(kinds: list[int], start: int, end: int) -> list[int]:
    return crossings(len(kinds), lambda v, i: ahead_row(v, kinds[i]), lambda a, i: back_row(a, kinds[i]), start, end)


def summed(n: int, forward: Callable) -> tuple[list[int], list[int]]:
    """Costs and ranks (16 each) of n steps as one table."""
    costs, ranks = [], []
    for p in range(4):
        vector, total = at(p), 0
        for i in range(n):
            vector, more = forward(vector, i)
            total += more
        costs += [c + total if c < FAR else FAR for c in vector[0]]
        ranks += list(vector[1])
    return costs, ranks


def _items(kinds: np.ndarray, copies: np.ndarray) -> tuple[list[int], list[int]]:
    """Steps of some rows, and how often each is repeated: copies after the first are one run of deletions."""
    items, times = [], []
    for kind, n in zip(kinds.tolist(), copies.tolist()):
        if kind == GONE:
            items.append(GONE)
            times.append(n)
        else:
            items.append(kind)
            times.append(1)
            if n > 1:
                items.append(GONE)
                times.append(n - 1)
    return items, times


# --- rows -----------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Faults dealt by crc32 of conv_id:turn, modulo 20; nulls there and in role and text are one space.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"),
        F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("fault"))
    return x.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in order with their block: an ascending number that no other conversation has.

    Conversations are cut by range of (conv_id, turn, role:text), so a long one is in many tasks.
    Equal rows are one row with a count.
    """
    trimmed = F.rtrim("text", F.lit(WHITE))
    x = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    x = x.select(
        "conv_id", "turn", "role", "text", "copies",
        (trimmed == "").alias("blank"), F.coalesce(F.right(trimmed, F.lit(1)).isin(*".!?"), F.lit(False)).alias("ended"),
        F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1)
        .when(F.col("role").startswith("a"), 2).otherwise(3).alias("initial"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"), F.concat("role", F.lit(":"), "text").alias("line"))
    bounded_batches(rows.sparkSession)
    ordered = x.repartitionByRange("conv_id", "turn", F.left("line", F.lit(64))).sortWithinPartitions(
        "conv_id", "turn", "line", "role").drop("line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, last = (TaskContext.get().partitionId() << 32) - 1, 0, object()
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column("conv_id").to_pylist():
                if conv != last or place == BLOCK:
                    block, place, last = block + 1, 0, conv
                blocks.append(block)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())],
                [*batch.schema.names, "block", "pos"])

    schema = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    return written(ordered.mapInArrow(run, schema + ", block long, pos int"))


def _judged(numbered: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, block, pos, copies, kind, initial, blank, again): what each row is, without its text."""
    x = numbered.select("conv_id", "block", "pos", "copies", "blank", "ended", "initial", "key")
    first = x.groupBy("conv_id", "key").agg(F.min(F.struct("block", "pos")).alias("first"))
    first = first.select(F.col("conv_id").alias("conv"), F.col("key").alias("of"), "first")
    again = F.struct("block", "pos") > F.col("first")
    return x.join(first, x["conv_id"].eqNullSafe(first["conv"]) & (x["key"] == first["of"])).select(
        "conv_id", "block", "pos", "copies", "blank", (again & ~F.col("blank")).alias("again"), "initial",
        F.when(F.col("blank") | again, GONE).otherwise(F.col("initial") + F.when(F.col("ended"), 0).otherwise(TRUNCATED))
        .cast("int").alias("kind"))


def _split(t: pa.Table) -> Iterator[tuple[pa.Table, int]]:
    """The blocks of a task's rows, each in order."""
    t = t.sort_by([("block", "ascending"), ("pos", "ascending")])
    block = t.column("block").to_numpy()
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() if len(block) else []
    for start, stop in zip(edges, [*edges[1:], len(block)]):
        yield t.slice(start, stop - start), int(block[start])


def _legal(left: int, right: int) -> bool:
    return (left, right) in ((0, 1), (1, 2), (2, 1))


def _sum_blocks(t: pa.Table) -> pa.Table:
    """The table of each block."""
    rows = []
    for part, block in _split(t):
        items, times = _items(part.column("kind").to_numpy(), part.column("copies").to_numpy())
        costs, ranks = summed(len(items), lambda v, i: ahead_row(v, items[i]))
        more = DELETE * (sum(times) - len(times))
        rows.append((part.column("conv_id")[0].as_py(), block, [c + more if c < FAR else FAR for c in costs], ranks))
    columns = list(zip(*rows)) or [()] * 4
    kinds = (t.schema.field("conv_id").type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "id", "costs", "ranks"])


def _tables(t: pa.Table) -> tuple[pa.Table, list, list]:
    t = t.sort_by("id")
    four = [[np.array(x).reshape(4, 4).tolist() for x in t.column(n).to_pylist()] for n in ("costs", "ranks")]
    return t, *four


def _sum_tables(t: pa.Table) -> pa.Table:
    """One table of some tables in a row."""
    t, costs, ranks = _tables(t)
    found = summed(len(costs), lambda v, i: ahead(v, costs[i], ranks[i]))
    return pa.table([t.column("conv_id").slice(0, 1), t.column("parent").slice(0, 1),
                     pa.array([found[0]], pa.list_(pa.int64())), pa.array([found[1]], pa.list_(pa.int32()))],
                    names=["conv_id", "id", "costs", "ranks"])


def _cross_tables(t: pa.Table) -> pa.Table:
    """The states at both ends of each of some tables in a row."""
    t, costs, ranks = _tables(t)
    states = crossings(len(costs), lambda v, i: ahead(v, costs[i], ranks[i]), lambda a, i: back(a, costs[i]),
                       t.column("start")[0].as_py(), t.column("end")[0].as_py())
    return pa.table([t.column("id"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())],
                    names=["id", "start", "end"])


def _ends(blocks: DataFrame, conv_type: str) -> DataFrame:
    """(id, start, end): the states at both ends of each block (conv_id, id, costs, ranks)."""
    fields = f"conv_id {conv_type}, id long, costs array<long>, ranks array<int>"
    levels, whole = [], []
    nodes = blocks
    while True:
        mine = Window.partitionBy("conv_id")
        nodes = written(nodes.withColumns({
            "n": F.count("*").over(mine), "idx": F.row_number().over(mine.orderBy("id")) - 1}))
        whole.append(nodes.where("n = 1").select("id", "costs", "ranks"))
        many = nodes.where("n > 1")
        if many.isEmpty():
            break
        groups = Window.partitionBy("conv_id", F.floor(F.col("idx") / FAN))
        levels.append(written(many.withColumn("parent", F.min("id").over(groups)).drop("n", "idx")))
        nodes = levels[-1].groupBy("parent").applyInArrow(_sum_tables, fields)
    # Each conversation is one table somewhere: it starts at the start, and ends where that is cheapest.
    last = F.array_min(F.array(*[F.struct((F.col("costs")[q] + END[q]).alias("cost"), F.col("ranks")[q].alias("rank"),
                                          F.lit(q).alias("end")) for q in range(4)]))["end"]
    ends = whole.pop().select("id", F.lit(START).alias("start"), last.alias("end"))
    while levels:
        down = levels.pop().join(ends.withColumnRenamed("id", "parent"), "parent")
        ends = down.groupBy("parent").applyInArrow(_cross_tables, "id long, start int, end int")
        ends = written(ends.unionByName(whole.pop().select("id", F.lit(START).alias("start"), last.alias("end"))))
    return ends


def _solve_blocks(t: pa.Table, ends: pa.Table) -> pa.Table:
    """The edits of each block with their cost, and what its rows are."""
    known = {i: (s, e) for i, s, e in zip(*(ends.column(n).to_pylist() for n in ("id", "start", "end")))}
    rows = []
    for part, block in _split(t):
        kind, copies, initial = (part.column(n).to_numpy() for n in ("kind", "copies", "initial"))
        blank, again = (part.column(n).to_numpy() for n in ("blank", "again"))
        items, times = _items(kind, copies)
        states = row_states(items, *known[block])
        cost, audit = 0, []
        for item, n, p, q in zip(items, times, states, states[1:]):
            one, tail = MOVES[item][p][q]
            cost += one + DELETE * (n - 1)
            audit.append(tail + "D" * (n - 1))
        first = ~blank & ~again
        pairs = sum(not _legal(a, b) for a, b in zip(initial.tolist(), initial[1:].tolist()))
        rows.append((
            part.column("conv_id")[0].as_py(), block, "".join(audit), cost, int(copies[blank].sum()),
            int(copies[again].sum() + (copies[first] - 1).sum()), int((first & (kind >= TRUNCATED)).sum()),
            pairs + int((copies - 1).sum()), int(initial[0]), int(initial[-1])))
    columns = list(zip(*rows)) or [()] * 10
    kinds = (t.schema.field("conv_id").type, pa.int64(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=_SOLVED)


_SOLVED = ["conv_id", "block", "audit", "cost", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last"]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, role, text) of every edit in order; (conv_id, None, facts) before a block's rows and
    before each turn inserted at the end.

    Rows come sorted by conversation, block and place; a block's edits come before its rows.
    """
    last, state, audit, here = object(), START, "", 0

    def close() -> Iterator[tuple]:
        nonlocal state
        while state in (SYSTEM, USER):
            state = NEXT[state]
            yield last, None, {"cost": INSERT}
            yield last, "I", None, NAMES[state], ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != last:
                yield from close()
                last, state = row["conv_id"], START
            if row["pos"] < 0:
                audit, here = row["audit"], 0
                yield last, None, row
                continue
            for _ in range(row["copies"]):
                while audit[here] == "I":
                    state, here = NEXT[state], here + 1
                    yield last, "I", None, NAMES[state], ""
                edit, here = audit[here], here + 1
                role = row["role"]
                if edit == "R":
                    state = NEXT[state]
                    role = NAMES[state]
                elif edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield last, edit, row["turn"], role, row["text"]
    yield from close()


def _solved(rows: DataFrame) -> DataFrame:
    """Rows and edits of blocks, all of a conversation in one task, in order.

    Only texts pass that task one after the other; what to do with them is known.
    """
    numbered = _numbered(rows)
    judged = written(_judged(numbered))
    conv_type = dict(rows.dtypes)["conv_id"]
    packs = judged.count() // PACK + 1
    pack = lambda c: F.pmod(F.xxhash64(c), F.lit(packs)).alias("pack")
    blocks = judged.groupBy(pack("block")).applyInArrow(
        _sum_blocks, f"conv_id {conv_type}, id long, costs array<long>, ranks array<int>")
    solved = judged.groupBy(pack("block")).cogroup(_ends(blocks, conv_type).groupBy(pack("id"))).applyInArrow(
        _solve_blocks, f"conv_id {conv_type}, block long, audit string, cost long, n_blank long, n_duplicate long, "
                       "n_truncated long, n_illegal long, first int, last int")
    both = numbered.select("conv_id", "block", "pos", "turn", "role", "text", "copies").unionByName(
        solved.withColumn("pos", F.lit(-1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, step, edit, turn, role, text: every edit of the cheapest repair of each conversation.

    ``rows`` has conv_id (any type), turn (long), role and text (strings, not null) and
    ``copies``, how often the row occurs.  Rows are taken by turn (nulls first), those of
    one turn by role:text.  Edits are Keep, Rerole (``role`` is the new one), Delete and
    Insert; the rows other than D are the repaired conversation.  A null conv_id is a
    conversation; no rows give no rows.
    """
    conv_type = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, step, size = [], object(), 0, 0
        schema = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                kind = b.schema.field("conv_id").type
                schema = pa.schema([("conv_id", kind), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                                    ("role", pa.string()), ("text", pa.string())])
                yield b

        for conv, edit, *rest in _edits(typed()):
            if edit is None:
                continue
            step = step + 1 if conv == last else 0
            last = conv
            out.append((conv, step, edit, *rest))
            size += len(rest[2])
            if len(out) >= 4096 or size > 1 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return _solved(rows).mapInArrow(run, f"conv_id {conv_type}, step long, edit string, turn long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (as for ``repair``) counts of faults, cost, edits and the repaired text's hash.

    The hash and the edits are one value a conversation, so its texts pass one task, as a stream.
    """
    conv_type = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, now = None, object(), None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                yield b

        def result() -> pa.RecordBatch:
            values = [last, *now["sums"], "".join(now["audit"]), now["hash"].hexdigest()]
            kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [
                "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for conv, edit, *rest in _edits(typed()):
            if now is None or conv != last:
                if now is not None:
                    yield result()
                last, now = conv, {"sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "lines": 0, "initial": None}
            if edit is None:
                row = rest[0]
                for i, name in enumerate(("n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost")):
                    now["sums"][i] += row.get(name, 0)
                if "first" in row:
                    now["sums"][3] += now["initial"] is not None and not _legal(now["initial"], row["first"])
                    now["initial"] = row["last"]
                continue
            now["audit"].append(edit)
            if edit != "D":
                _, role, text = rest
                now["hash"].update(("\n" if now["lines"] else "").encode() + f"{role}:{text}".encode())
                now["lines"] += 1
        if now is not None:
            yield result()

    return _solved(rows).mapInArrow(
        run, f"conv_id {conv_type}, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, repaired_sha256 string")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conv_id of ``conversations`` (conv_id, turn, role, text), after ``damage``.

    Null and string ids, null and repeated turns, null, empty and very long texts and
    other roles are as ``damage`` and ``repair`` say; other columns are not read.
    """
    rows = damage(conversations)
    turns = rows.groupBy("conv_id").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    out = digests(rows)
    ids = conversations.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    for side in (turns, out):
        side = side.withColumnRenamed("conv_id", "of")
        ids = ids.join(side, ids["conv_id"].eqNullSafe(side["of"]), "left").drop("of")
    return ids.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_hirschberg_repair": op13_hirschberg_repair}
ORACLES: dict[str, str] = {}
