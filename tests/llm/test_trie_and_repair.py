"""Repair and prefix trie against brute force: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from profilion.llm import op12_repair, op13_trie

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, dropped string, nth string, a string, _row string, depth long"


@pytest.fixture(scope="module")
def turns():
    r = random.Random(5)
    words = ["Yes.", "No", "", " \n", "What?", "ends badly", "é ü.", "x." * 4000, "Stop!"]
    rows = []
    for c in range(60):
        for t in range(r.choice([1, 2, 3, 5, 9, 40]) if c != 7 else 400):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            rows.append((c * 3 if c % 4 else c, None if r.random() < 0.05 else t + r.choice([0, 0, 0, 3]), role, None if r.random() < 0.05 else r.choice(words)))
    rows += [rows[4], rows[4], (None, 1, "user", "No id."), (None, 2, "assistant", "None"), (90, 0, "user", "Same."), (95, 0, "user", "Same."), (500, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark, turns):
    return spark.createDataFrame([(*t, "old", "old", "old", "old", 9) for t in turns], SCHEMA).repartition(7)


def by_turn(rows):
    return sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


def mended(rows):
    """(cost, audit, turns) of the cheapest edits, by all states after each row."""
    states = {0: (0, "", ())}

    def put_in(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                to, role = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[s]
                new = (cost + 3, audit + "I", (*out, (role, "")))
                states[to] = min(states.get(to, new), new)
        return states

    for role, text, kind in rows:
        after = {}
        for s, (cost, audit, out) in put_in(states).items():
            more, keeps = 3 * (kind == "truncated"), {"s": (0,), "u": (0, 1, 3), "a": (2,)}.get(role[:1], ())
            found = [(s, cost + 4, "D", out)]
            if kind not in ("blank", "duplicate"):
                if s in keeps:
                    found.append(({"s": 1, "u": 2, "a": 3}[role[0]], cost + more, "K", (*out, (role, text))))
                to = 3 if s == 2 else 2
                found.append((to, cost + 3 + more, "R", (*out, ("assistant" if to == 3 else "user", text))))
            for to, c, letter, o in found:
                after[to] = min(after.get(to, (10**9,)), (c, audit + letter, o))
        states = after
    done = put_in(states)
    return min(done[s] for s in (0, 3) if s in done)


def wanted_repair(turns):
    convs = {c: [] for c, *_ in turns}
    for c, t, role, text in turns:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
        convs[c] += [] if fate == 0 else [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows, met, marked, count = by_turn(rows), set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            tail = text.rstrip(BLANKS)[-1:]
            kind = "blank" if not tail else "duplicate" if (role, text) in met else "truncated" if tail not in ".!?" else None
            met.add((role, text))
            marked.append((role, text, kind))
            if kind:
                count[kind] += 1
        dated = [t for t, *_ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, said = mended(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
        out[c] = (c, max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, *count.values(), illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("size", [op12_repair.BLOCK, 5])
def test_repair(table, turns, size):
    """A block of five rows makes most conversations go on from block to block."""
    found = {r.conv_id: tuple(r) for r in op12_repair.repaired(op12_repair.damaged(table), size).collect()}
    wanted = wanted_repair(turns)
    assert found.keys() == wanted.keys()
    for c in wanted:
        assert found[c] == wanted[c]


def test_repair_of_nothing(table):
    assert op12_repair.repaired(op12_repair.damaged(table.limit(0))).collect() == []


def test_automaton_is_small():
    """The lazy table ends: differences of costs between states are bounded."""
    automaton, r = op12_repair.Automaton(), random.Random(1)
    for _ in range(50):
        automaton.scan([r.choice(["x", "s", "st", "u", "ut", "a", "at", "o", "ot"]) for _ in range(300)], op12_repair.ENDS)
    assert len(automaton.vectors) < 60


def wanted_trie(turns):
    convs = {}
    for c, t, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in by_turn(rows)] for c, rows in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].encode()) if path else 0
    rows = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if made[c] == path)
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(who), len(path), parent, len(who), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize(("size", "first"), [(8192, 4), (4, 1)])
def test_trie(table, turns, size, first):
    found = op13_trie.trie(*op13_trie.rebuilt(table, size), size, first).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == wanted_trie(turns)


def test_trie_of_copies_and_of_nothing(spark):
    """Copies of one conversation never part, and end in one node; a single conversation is a chain from the root on."""
    copies = [(c * 5, t, "user", f"turn {t}") for c in range(30) for t in range(12)]
    for rows in (copies, copies[:12], []):
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        found = op13_trie.trie(*op13_trie.rebuilt(table, 7), 7, 2).collect()
        assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == wanted_trie(rows)


def test_worth_of_a_hot_parent(spark):
    """More children of one node than a thousandth of the nodes: their parent is broadcast, others are joined by shuffle."""
    rows = [(c, 0, "user", "hello") for c in range(3000)] + [(c, 1, "user", f"t{c % 1500}") for c in range(3000)]
    turns = spark.createDataFrame([(c, d + 1, bytes(x, "ascii"), len(x)) for c, d, _, x in rows], "conv_id long, depth long, turn_name binary, bytes long")
    found = op13_trie.trie(turns.select("conv_id").distinct(), turns, 64)
    assert found.groupBy("depth").agg(F.count("*"), F.sum("n_convs"), F.max("parent_conv_id")).orderBy("depth").collect() == [(0, 1, 3000, None), (1, 1, 3000, 0), (2, 1500, 3000, 0)]
