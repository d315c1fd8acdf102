"""Conversation repair: the agenda against all edits, and whole tables against plain loops."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from adflow.llm import chat_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def all_edits(turns, most=2):
    """The lightest (cost, audit, repaired) by trying every edit of every turn with up to ``most`` insertions at each place."""
    best = None
    inserts = [c for n in range(most + 1) for c in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, roles, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        for ins in inserts:
            r = roles + [x[0] for x in ins]
            li = lines + [f"{x}:" for x in ins]
            c, a = cost + 5 * len(ins), audit + "I" * len(ins)
            if i == len(turns):
                if SHAPE.match("".join(r)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, "\n".join(li))
                continue
            role, text, fault = turns[i]
            go(i + 1, c + 2, a + "D", r, li)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            go(i + 1, c + more, a + "K", [*r, role[:1] or "?"], [*li, f"{role}:{text}"])
            for to in ("user", "assistant"):
                go(i + 1, c + 1 + more, a + "R", [*r, to[0]], [*li, f"{to}:{text}"])

    go(0, 0, "", [], [])
    return best


def by_table(turns):
    """(cost, audit) by a plain table over turns and states, with the insertions closed over."""
    inf = (10 ** 9, "")
    closed = lambda row: [min([row[q], *[(row[p][0] + 5 * n, row[p][1] + "I" * n)
                                         for p in range(4) for n in (1, 2) if row[p] != inf and cr_after(p, n) == q]])
                          for q in range(4)]

    def cr_after(p, n):
        for _ in range(n):
            p = 3 if p == 2 else 2
        return p

    row = closed([(0, ""), inf, inf, inf])
    for role, _, fault in turns:
        new = [inf] * 4
        for q, (c, a) in enumerate(row):
            if (c, a) == inf:
                continue
            moves = [(2, "D", q)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}
                if to.get(role[:1]) is not None:
                    moves.append((more, "K", to[role[:1]]))
                moves.append((1 + more, "R", 3 if q == 2 else 2))
            for cost, edit, at in moves:
                new[at] = min(new[at], (c + cost, a + edit))
        row = closed(new)
    return min(row[0], row[3])


FAULTS = ["", "", "", "truncated", "blank", "duplicate"]


def test_agenda_against_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.choice(FAULTS)) for i in range(rng.randint(0, 4))]
        cost, audit, text = all_edits(turns)
        items = [(r[:1], f) for r, _, f in turns]
        (got,) = cr.lightest(items).values()
        assert got == (cost, audit) == by_table(turns)
        done = cr.applied([{"role": r, "text": t} for r, t, _ in turns], 0, audit)
        assert "\n".join(f"{d['role']}:{d['text']}" for d in done) == text


def test_agenda_against_table_on_long_conversations():
    rng = random.Random(3)
    for n in (30, 80, 200):
        turns = [(rng.choice(["user", "assistant", "system", "user"]), "t", rng.choice(FAULTS)) for _ in range(n)]
        (got,) = cr.lightest([(r[:1], f) for r, _, f in turns]).values()
        assert got == by_table(turns)


def expected(rows):
    """The report's rows by plain loops."""
    blank = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns = set(), []
        for _, role, text in own:
            kept = text.strip(" \t\n\v\f\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        firsts = [r[0][:1] for r in turns]
        cost, audit = by_table(turns)
        done = cr.applied([{"role": r, "text": t} for r, t, _ in turns], 0, audit)
        faults = [f for _, _, f in turns]
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts)), cost, audit,
                    hashlib.sha256("\n".join(f"{d['role']}:{d['text']}" for d in done).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng):
    texts = ["Yes.", "No!", "so", "  ", "", "a b? ", "Ünï. 日本。", "x\nThe end.\n", None, "\xa0", "what?"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.9:
                role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
                text = rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randint(0, 3)}." + rng.choice(["", " more", "!"])
                rows.append((conv, rng.choice([turn, turn, turn, None, 10 ** 9, -5]) if rng.random() < 0.2 else turn, role, text))
    rows += [rows[3]] * 3 + [(500, None, None, None), (501, None, "user", "Hi."), (502, 1, "user", "z" * 50_000 + ".")]
    rows += [(600, i, rng.choice(["user", "assistant"]), f"Turn {i if rng.random() < .9 else 1}" + rng.choice([".", "."," and"]))
             for i in range(700)]                                  # one conversation holds half of all rows
    return rows + [(700, 7, "user", "Again.")] * 90                # repeated rows


@pytest.mark.parametrize("piece,chars", [(cr.PIECE, cr.PIECE_CHARS), (7, 60)])
def test_report_against_loops(spark, piece, chars):
    rows = conversations(random.Random(11))
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, `key` string, part string")
    got = cr.repair_report(table, piece=piece, piece_chars=chars)
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == cols
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows)


def test_repaired_turns_have_the_shape(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in conversations(random.Random(12))]
    done = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    roles = {}
    for r in sorted(done.turns().collect(), key=lambda r: (r["part"], r["seq"], r["pos"])):
        roles.setdefault(r["conv_id"], []).append(r["role"][:1])
        assert r["edit"] in "KRI" and (r["edit"] != "I" or r["text"] == "")
    assert all(SHAPE.match("".join(r)) for r in roles.values()) and len(roles) > 80


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_report(table).count() == 0 and cr.repair(table).turns().count() == 0
