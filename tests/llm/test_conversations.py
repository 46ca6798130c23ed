import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tests.conftest import SF_SMALL
from tremor.llm import conversations as C
from tremor.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    """The conversations after damage: conv_id -> (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub("[.!?]", "", text)
        elif what == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(what, 1))
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, fault):
    """Shortest path over (row, repaired initials so far): cost, then audit as
    text; states are the prefixes of the grammar's words, not our table."""
    def prefix(word):
        return any(GRAMMAR.fullmatch(word + more) for more in ("", "a", "ua"))

    def state(word):
        return word if len(word) < 2 else word[-2:]

    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, audit, at, word = heapq.heappop(todo)
        if at == len(initials) and GRAMMAR.fullmatch(word):
            return cost, audit
        if (at, state(word)) in done:
            continue
        done.add((at, state(word)))
        for c in "ua":
            if prefix(word + c):
                heapq.heappush(todo, (cost + 3, audit + "I", at, word + c))
        if at < len(initials):
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, word))
            if fault[at] not in ("blank", "duplicate"):
                more = 3 * (fault[at] == "truncated")
                if prefix(word + initials[at]):
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, word + initials[at]))
                for c in "ua":
                    if prefix(word + c):
                        heapq.heappush(todo, (cost + 3 + more, audit + "R", at + 1, word + c))
    raise AssertionError


def repaired(rows, audit):
    left, out = list(rows), []
    for letter in audit:
        need = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((need, ""))
        else:
            _, role, text = left.pop(0)
            if letter != "D":
                out.append((role if letter == "K" else need, text))
    assert not left and GRAMMAR.fullmatch("".join(role[0] for role, _ in out))
    return "\n".join(f"{role}:{text}" for role, text in out)


def brute(rows):
    out = []
    for conv, now in plain_damage(rows).items():
        fault = faults(now)
        turns = [t for t, _, _ in now if t is not None]
        initials = [role[:1] for _, role, _ in now]
        cost, audit = cheapest(initials, fault)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                    hashlib.sha256(repaired(now, audit).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def encoded(initials, fault):
    place = {"s": 1, "u": 2, "a": 3}
    return bytes(3 * place.get(i, 0) + (2 if f in ("blank", "duplicate") else f == "truncated") for i, f in zip(initials, fault))


def test_every_short_conversation_equals_the_shortest_path():
    kinds = [(i, f) for i in "suax" for f in ("", "truncated", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            initials, fault = [r[0] for r in rows], [r[1] for r in rows]
            assert C.repair(encoded(initials, fault)) == cheapest(initials, fault)


@pytest.mark.parametrize("run_rows", [1, 2, 3, 7, 256])
def test_runs_of_any_length_give_the_same_repair(run_rows):
    rnd = random.Random(run_rows)
    for _ in range(120):
        n = rnd.randrange(60)
        initials, fault = rnd.choices("ssuuuaaax", k=n), rnd.choices(["", "", "", "truncated", "duplicate"], k=n)
        assert C.repair(encoded(initials, fault), run_rows) == cheapest(initials, fault)


def test_long_conversation_is_solved_in_runs():
    rnd = random.Random(1)
    initials, fault = rnd.choices("uuas", k=20_000), rnd.choices(["", "truncated", "blank"], k=20_000)
    cost, audit = C.repair(encoded(initials, fault))
    assert (cost, audit) == cheapest(initials, fault)


def rows_of(seed, conversations):
    rnd, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rnd.randrange(1, 12)):
            if rnd.random() < 0.9:
                rows.append((c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]),
                             rnd.choice(["One.", "Two?", "Three", "Yes!  ", "é.", " \t", "open,  ", f"{t} {c}.", "a.b!c?"])))
    return rows


def test_query_equals_brute_force_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_conversation_repair"](spark, SF_SMALL)) == brute(rows)


def test_odd_rows(spark):
    rows = rows_of(5, 200)
    rows += rows[:40] + [(None, 0, "user", "a."), (None, None, None, None), (None, 3, "assistant", "b"), (901, None, "user", "x."), (901, None, "assistant", "y."),
                         (902, 5, "", ""), (903, -4, "ünknown", "."), (903, 9, "user", "long " * 60_000 + "."), (904, 1, "user", None), (905, 2, None, "t."),
                         (906, -(1 << 63), "user", "q."), (906, (1 << 63) - 1, "assistant", "q.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for name in ("what", "mark", "copies", "kind", "found", "blank", "cut", "seen"):
        frame = frame.withColumn(name, F.lit("x"))
    want = [r if r[0] != 906 else (r[0], min(r[1], (1 << 63) - 1), *r[2:]) for r in brute(rows)]
    got = collected(C.repair_conversations(frame.repartition(7)))
    assert got == want
    # a conversation that lost all its rows is there with zeros
    gone = [r for r in got if r[7] == "" and r[6] == 0]
    assert gone and gone[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
