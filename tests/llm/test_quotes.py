from __future__ import annotations

import hashlib
import random
import re

import pytest

from srclens.llm import quotes
from srclens.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, mid string, depth string, hash string, target string"
MARK = re.compile(quotes.MARKS)


def lines_of(text):
    out = []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        marks = MARK.match(line)
        out.append((marks.group(0).count(">"), line[marks.end():]) if marks else (0, line))
    return [(None if d == 0 and re.match(quotes.INTRODUCTION, s) and i + 1 < len(out) and out[i + 1][0] > 0 else d, s)
            for i, (d, s) in enumerate(out)]


def norm(s):
    return re.sub(r"\s+", " ", s.lower(), flags=re.A).strip(" ")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def paragraphs(lines):
    out, last = [], None
    for d, s in lines:
        if d is None or not s.strip():
            last = None
        elif d == last:
            out[-1][1].append(s)
        else:
            out.append((d, [s]))
            last = d
    return out


def brute(messages):
    rows = sorted(set((c if c is not None else -1, t if t is not None else -1, r, x) for c, t, r, x in messages), key=str)
    parsed = [(c, t, r, lines_of(x)) for c, t, r, x in rows]
    said = {}
    for c, t, _, lines in parsed:
        for d, p in paragraphs(lines):
            if d == 0:
                for unit in {norm(" ".join(p)), *map(norm, p)}:
                    said.setdefault((c, unit), set()).add(t)
    latest = lambda c, u, t: max((x for x in said.get((c, u), ()) if x < t), default=None)
    out, parent = [], {}
    for c, t, r, lines in parsed:
        own = "\n".join(s for d, s in lines if d == 0)
        own = re.sub(r"\n{3,}", "\n\n", own)
        own = re.sub(r"^\s+|\s+$", "", own, flags=re.A)
        q = [(d, p) for d, p in paragraphs(lines) if d > 0]
        n_linked, up = 0, None
        for d, p in q:
            targets = [latest(c, norm(" ".join(p)), t)]
            if targets == [None] and len(p) > 1:
                targets = [latest(c, norm(s), t) for s in p]
            targets = [x for x in targets if x is not None]
            n_linked += bool(targets)
            if d == 1 and targets:
                up = max([*targets, *([up] if up is not None else [])])
        if up is not None:
            parent[c, t] = max(up, parent.get((c, t), up))
        out.append([c, t, r, own, md5(norm(own)), len(q), n_linked, max((d for d, _ in q), default=0), up])
    for row in out:
        at = row[1]
        while (row[0], at) in parent:
            at = parent[row[0], at]
        row.append(at)
    for row in out:
        row.append(1 + sum((x[0], x[9]) == (row[0], row[9]) and (x[1], x[2] or "", x[3]) < (row[1], row[2] or "", row[3]) for x in out))
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def run(spark, messages):
    return got(quotes.conversations(spark.createDataFrame([(*m, "a", "b", "c", "d") for m in messages], SCHEMA)))


MESSAGES = [
    (1, 0, "user", "Shall we meet\non Monday?\n\nBring the papers."),
    (1, 1, "assistant", "On Monday Ann wrote:\n> Shall we  MEET\n> on Monday?\n\nYes, at noon."),
    (1, 2, "user", "> > Shall we meet\n> > on Monday?\n>\n> Yes, at noon.\nFine.\r\n>> Bring the papers."),
    (1, 3, "user", "> on Monday?\n> something never said\nWhich one?"), (1, 4, "user", "> Which one?\nThe next."),
    (1, 5, "user", "> nobody said this\n>>> deep"), (1, 6, "user", "> Fine.\n> > > Shall we meet\n"),
    (2, 0, "user", "> Yes, at noon.\nNot here."), (2, 1, "user", ""), (2, 2, "user", None), (2, 2, "user", None),
    (None, 3, None, "alone"), (2, None, "user", "> alone"), (3, 5, "a", "same turn"), (3, 5, "b", "> same turn"),
    (3, 9, "a", "On holiday I wrote:\nnothing quoted"),
]


@pytest.mark.parametrize("range_", [quotes.RANGE, 2])
def test_brute_force(spark, monkeypatch, range_):
    monkeypatch.setattr(quotes, "RANGE", range_)
    assert run(spark, MESSAGES) == brute(MESSAGES)


@pytest.mark.parametrize("seed", [1, 2])
def test_long_conversation(spark, monkeypatch, seed):
    monkeypatch.setattr(quotes, "RANGE", 16)
    rng = random.Random(seed)
    told, messages = ["thanks"], []
    for t in range(120):
        picks = [rng.choice(told) for _ in range(rng.randrange(3))]
        own = rng.choice(["thanks", f"point {t}", f"point {t}\nand {t % 7}"])
        messages.append((7, t, "u", "\n\n".join(["\n".join("> " * rng.randrange(1, 3) + x for x in p.split("\n")) for p in picks] + [own])))
        told += [own, own.split("\n")[-1]]
    assert run(spark, messages) == brute(messages)


def test_replies_come_after(spark):
    rows = quotes.conversations(spark.createDataFrame([(*m, "", "", "", "") for m in MESSAGES], SCHEMA)).collect()
    place = {(r.conv_id, r.turn): (r.thread_turn, r.position) for r in rows}
    replies = [r for r in rows if r.parent_turn is not None]
    assert replies
    for r in replies:
        thread, position = place[r.conv_id, r.parent_turn]
        assert thread == r.thread_turn and position < r.position


def test_no_rows(spark):
    assert run(spark, []) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(quotes.op1_quotation_links(spark, "/root/testdata/sf0.01")) == brute(rows)
