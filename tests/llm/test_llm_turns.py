"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foldwise.llm import turns
from foldwise.llm.queries import QUERIES

ROWS = "conv_id bigint, turn bigint, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")


def edits_by_brute_force(kinds, most_inserts=4):
    """The cheapest (cost, audit) over all edit strings; kinds are (initial, fault)."""
    best = None
    for inserts in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(kinds) + 1), inserts):
            choices = [[("K", i), ("R", "u"), ("R", "a"), ("D", "")] if f in ("", "truncated") else [("D", "")] for i, f in kinds]
            for picked in itertools.product(*choices):
                cost = 3 * inserts + sum({"K": 0, "R": 3, "D": 4}[e] + (3 if f == "truncated" and e != "D" else 0) for (e, _), (_, f) in zip(picked, kinds))
                audit = "".join("I" * places.count(k) + (picked[k][0] if k < len(kinds) else "") for k in range(len(kinds) + 1))
                if best is not None and (cost, audit) >= best:
                    continue
                for roles in itertools.product("ua", repeat=inserts):
                    new, symbols = iter(roles), []
                    for k in range(len(kinds) + 1):
                        symbols += [next(new) for _ in range(places.count(k))]
                        symbols += [picked[k][1]] if k < len(kinds) else []
                    if WHOLE.fullmatch("".join(symbols)):
                        best = (cost, audit)
                        break
    return best


def edits_by_states(kinds):
    """The same over the states of the pattern, for conversations of any length."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    at = {0: (0, "")}

    def relax(at):
        for _ in range(6):
            for state, (cost, audit) in list(at.items()):
                for x in "ua":
                    to = step.get((state, x))
                    if to is not None:
                        at[to] = min(at.get(to, (9**9, "")), (cost + 3, audit + "I"))
        return at

    for initial, fault in kinds:
        new = {}
        for state, (cost, audit) in relax(at).items():
            for x, price, edit in [(None, 4, "D"), *([] if fault in ("blank", "duplicate") else [(initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")])]:
                to = state if x is None else step.get((state, x))
                if to is not None:
                    value = (cost + price + (3 if fault == "truncated" and edit != "D" else 0), audit + edit)
                    new[to] = min(new.get(to, (9**9, "")), value)
        at = new
    return min(v for k, v in relax(at).items() if k in (0, 3))


def expected(rows):
    """The whole result for the turns of one conversation in order: (turn, role, text)."""
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append((role[:1], fault))
    cost, audit = edits_by_states(kinds)
    out, last, at = [], "", 0
    for edit in audit:
        due = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((due, ""))
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else due, text))
        last = out[-1][0][0]
    numbers = [t for t, _, _ in rows if t is not None]
    initials = [i for i, _ in kinds]
    count = lambda f: sum(x == f for _, x in kinds)
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def by_conversation(rows, every=()):
    """Turns that tie are ordered as the operator's docstring says."""
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    groups = {c: [] for c in every}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        groups.setdefault(r[0], []).append(r[1:])
    return {c: expected(rows) for c, rows in groups.items()}


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


ALPHABET = [(i, f) for i in ("s", "u", "a", "t") for f in ("", "blank", "truncated")]


def test_parse_against_brute_force():
    for n in (0, 1, 2):
        for kinds in itertools.product(ALPHABET, repeat=n):
            got = turns.cheapest([(0, *x) for x in turns.parse("".join(turns.token(*k) for k in kinds))])
            assert got == edits_by_brute_force(kinds), kinds
    rng = random.Random(3)
    for _ in range(60):
        kinds = [rng.choice(ALPHABET) for _ in range(3)]
        assert edits_by_states(kinds) == edits_by_brute_force(kinds, 3), kinds


def test_equal_tops_accept_the_same():
    """Merging is right: stacks with one top are complete after the same continuations."""
    done = turns.automaton()[2]
    stacks = {_after((0, None), tail[:n]) for tail in itertools.product("sua", repeat=4) for n in range(5)} - {None}
    for a, b in itertools.combinations(stacks, 2):
        if a[0] == b[0]:
            for more in itertools.product("sua", repeat=3):
                x, y = _after(a, more), _after(b, more)
                assert (x is None) == (y is None) and (x is None or (x[0] in done) == (y[0] in done))


def _after(stack, symbols):
    for x in symbols:
        found = turns.shift(stack, x) if stack else ()
        stack = found[0] if found else None
    return stack


@pytest.mark.parametrize("size", [1, 2, 7])
def test_composed_segments_against_states(size):
    rng = random.Random(size)
    for _ in range(60):
        kinds = [rng.choice(ALPHABET) for _ in range(rng.randrange(1, 30))]
        letters = "".join(turns.token(*k) for k in kinds)
        table = None
        for k in range(0, len(letters), size):
            part = [(entry, *x) for entry in turns.entries() for x in turns.parse(letters[k : k + size], entry)]
            table = part if table is None else turns.compose(table, part)
        assert turns.cheapest(table) == edits_by_states(kinds)


def test_repair_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 5)
    monkeypatch.setattr(turns, "FAN_IN", 2)
    rng = random.Random(11)
    texts = ["Fine.", "cut off", "", " \t\n", "Fine. \n", "é?", None, "a!b", "word " * 40_000 + "."]
    rows = []
    for conv in [None, *range(30), -5]:
        for turn in range(rng.choice((1, 2, 5, 40))):
            rows.append((conv, rng.choice((turn, turn, turn, None, turn + 3)), rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)), rng.choice(texts)))
    rows += [(99, k, ("user", "assistant")[k % 2], f"Text {k}.") for k in range(300)]
    rows += [(98, 1, "user", "same.")] * 40
    rows += rows[:7]
    df = spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit(1)).withColumn("kind", F.lit("x")).repartition(3)
    every = {r[0] for r in rows}
    assert collected(turns.repair(turns.damage(df), df)) == by_conversation(damaged(rows), every)


def test_conversations_without_turns(spark):
    rows = [(5, 1, "user", "Hi?"), (5, 2, "assistant", "Yes."), (6, None, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = collected(turns.repair(df.where("conv_id = 5"), df))
    assert got[6] == nothing and got[5][5:7] == (0, "KK")
    assert collected(turns.repair(df.limit(0), df)) == {5: nothing, 6: nothing}
    assert turns.repair(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(QUERIES["op12_turn_repair"](spark, f"/root/testdata/{sf}"))
    assert got == by_conversation(damaged(rows), {r[0] for r in rows})
    assert any(g[5] for g in got.values())
