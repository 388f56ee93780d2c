"""Repair of conversations against a plain search that spells out all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from srclens.llm import conversations

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, block string, pos long, copies string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, f"{r[2]}:{r[3]}".encode(), r[2]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        trimmed = text.strip(WHITE)
        out.append("blank" if not trimmed else "duplicate" if (role, text) in seen else
                   "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # a state is the initial before


def search(rows):
    """Least (cost, edits, lines) with a whole string for each state after each row."""
    names = {"u": "user", "a": "assistant"}

    def insert(found):
        out = dict(found)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                to = NEXT[state]
                new = cost + 2, audit + "I", [*lines, names[to] + ":"]
                out[to] = min(out.get(to, new), new)
        return out

    found = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value)

        # Every number of insertions is tried from every state, as the shorter string need not be the lesser one.
        for state, (cost, audit, lines) in found.items():
            here = (cost, audit, lines, state)
            for _ in range(5):
                cost, audit, lines, at = here
                offer(at, (cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role[:1] == NEXT[at] or role[:1] == "s" and at == "":
                        offer(role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    offer(NEXT[at], (cost + 2 + more, audit + "R", [*lines, f"{names[NEXT[at]]}:{text}"]))
                here = (cost + 2, audit + "I", [*lines, names[NEXT[at]] + ":"], NEXT[at])
        found = new
    return min(insert(found)[s] for s in ("", "a") if s in insert(found))


def brute(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = ordered([r for r in damaged(rows) if r[0] == conv])
        cost, audit, lines = search(mine) if mine else (0, "", [])
        turns = [r[1] for r in mine if r[1] is not None]
        kinds, initials = faults(mine), [r[2][:1] for r in mine]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in (
                "blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0) if not isinstance(r[0], str) else r[0])


def got(df):
    return [tuple(r) for r in sorted(df.collect(), key=lambda r: (r[0] is not None, r[0] or 0))]


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t", None, "A long answer. With two ends", "Why?", "ok. \n", "…", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "util", "sys"]
    return [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1, 1])[0],
             rng.choice(texts) if rng.random() < .6 else f"text {rng.random()}.", "x", 1, "y") for _ in range(n)]


def test_random_conversations(spark):
    rows = random_rows(1, 500)
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversations.repaired_digests(df)) == brute(rows)


def test_long_conversations_in_small_blocks(spark, monkeypatch):
    """Most rows in one conversation, tables three levels high."""
    blocks = conversations._numbered
    monkeypatch.setattr(conversations, "FAN", 3)
    monkeypatch.setattr(conversations, "PACK", 40)

    def small(rows):
        # Workers have their own BLOCK: renumber what they give.
        from pyspark.sql import functions as F
        x = blocks(rows)
        return x.withColumn("block", F.col("block") * 1000 + F.floor(F.col("pos") / 4)).withColumn("pos", F.col("pos") % 4)

    monkeypatch.setattr(conversations, "_numbered", small)
    rows = [(0 if i % 3 else r[0], i if i % 7 else r[1], *r[2:]) for i, r in enumerate(random_rows(2, 260))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversations.repaired_digests(df)) == brute(rows)


def test_repaired_rows(spark):
    rows = random_rows(3, 200)
    out = {}
    for r in conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "step").collect():
        out.setdefault(r.conv_id, []).append(r)
    for row in brute(rows):
        mine = out.get(row[0], [])
        assert "".join(r.edit for r in mine) == row[7]
        kept = [r for r in mine if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == row[8]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
        assert [r.step for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_all_short_sequences(n):
    """Every sequence of kinds of rows: the crossing's states give the plain search's string."""
    shown = {0: ("system", "."), 1: ("user", "."), 2: ("assistant", "."), 3: ("tool", "."), 5: ("user", "x"), 8: ("user", "")}
    for kinds in itertools.product(shown, repeat=n):
        rows = [(0, i, shown[k][0], f"{i}{shown[k][1]}" if shown[k][1] else "") for i, k in enumerate(kinds)]
        costs, ranks = conversations.summed(n, lambda v, i: conversations.ahead_row(v, kinds[i]))
        end = min(range(4), key=lambda q: (costs[q] + conversations.END[q], ranks[q]))
        states = conversations.row_states(list(kinds), 0, end)
        audit = "".join(conversations.MOVES[k][p][q][1] for k, p, q in zip(kinds, states, states[1:]))
        cost, want, _ = search(rows)
        assert (costs[end] + conversations.END[end], audit + "I" * (conversations.END[end] // 2)) == (cost, want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(conversations.repaired_digests(empty)) == []
    assert conversations.repair(conversations.damage(empty)).collect() == []
    dropped = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 1, "")], SCHEMA)
    assert got(conversations.repaired_digests(df)) == [(dropped, *[0] * 6, "", hashlib.sha256().hexdigest())]


def test_string_ids(spark):
    rows = [(f"c{c}", t, "user" if t % 2 == 0 else "assistant", f"t{t}.", "", 1, "") for c in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    want = sorted(brute(rows), key=lambda r: r[0])
    assert sorted(tuple(r) for r in conversations.repaired_digests(df).collect()) == want


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(conversations.op13_hirschberg_repair(spark, SF)) == brute(rows)
