"""Repair of conversations whose turns break the role grammar, by generalised LR parsing with weighted edits.

The grammar of role initials is ``(s?(ua)+)?``.  Its LR automaton reads a conversation turn by turn.  At each turn every
live stack may keep it, give it another role, delete it, or insert a turn before it; the stacks share their lower
parts, and stacks with the same top are merged by the smallest (cost, audit), where the audit is the string of edit
initials.  Equal tops accept the same continuations here, and of two audits of equal cost that lead from one place to
another none is the beginning of the other, so the smaller one stays the smaller one.

A conversation of any length is cut into segments of bounded length.  A segment is parsed once from every stack top
with which it can be entered; the tables (entry, exit) -> (cost, audit) of consecutive segments are composed in rounds
of bounded fan-in.  Only narrow rows take part in that.  Texts are shuffled once, for the digest of the repaired
conversation: rows of a conversation pass one after another and are never gathered, but as a SHA-256 has no parts that could
be computed apart, they pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_row_index
from foldwise.session import materialise

#: T is a conversation, P a run of pairs of question and answer.
GRAMMAR = (("T", ""), ("T", "P"), ("T", "sP"), ("P", "ua"), ("P", "Pua"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Turns parsed by one call, and tables composed by one.
SEGMENT = 256
FAN_IN = 16
_SYMBOLS = "sua"
_BLANKS = " \t\n\x0b\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")

Stack = tuple  # (state, stack below); the lowest has None below
Value = tuple[int, str]  # cost, audit


@lru_cache(maxsize=1)
def automaton() -> tuple[list[dict[str, int]], list[list[int]], frozenset[int]]:
    """Transitions of each LR(0) state, the rules it may reduce by, and the states in which T is complete."""
    names = {left for left, _ in GRAMMAR}

    def closure(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            rest = GRAMMAR[rule][1][dot:]
            more = {(k, 0) for k, (left, _) in enumerate(GRAMMAR) if rest and left == rest[0] in names} - items
            items |= more
            todo += more
        return frozenset(items)

    states = [closure({(k, 0) for k, (left, _) in enumerate(GRAMMAR) if left == "T"})]
    moves: list[dict[str, int]] = []
    for state in states:  # grows while it is read
        moves.append({})
        for symbol in sorted({GRAMMAR[rule][1][dot] for rule, dot in state if dot < len(GRAMMAR[rule][1])}):
            to = closure({(rule, dot + 1) for rule, dot in state if GRAMMAR[rule][1][dot : dot + 1] == symbol})
            if to not in states:
                states.append(to)
            moves[-1][symbol] = states.index(to)
    complete = [[rule for rule, dot in state if dot == len(GRAMMAR[rule][1])] for state in states]
    return moves, [[rule for rule in rules if GRAMMAR[rule][0] != "T"] for rules in complete], frozenset(k for k, rules in enumerate(complete) if any(GRAMMAR[rule][0] == "T" for rule in rules))


@lru_cache(maxsize=4096)
def shift(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    """The stacks after reading one role initial, reduced as far as they go; none if it can't stand here."""
    moves, reductions, _ = automaton()
    to = moves[stack[0]].get(symbol)
    if to is None:
        return ()
    found, todo = [], [(to, stack)]
    while todo:
        top = todo.pop()
        if not reductions[top[0]] or any(s in moves[top[0]] for s in _SYMBOLS):
            found.append(top)
        for rule in reductions[top[0]]:
            left, right = GRAMMAR[rule]
            below = top
            for _ in right:
                below = below[1]
            todo.append((moves[below[0]][left], below))
    return tuple(found)


@lru_cache(maxsize=1)
def entries() -> dict[int, Stack]:
    """A stack for each top that can stand between two turns."""
    stacks: list[Stack] = [(0, None)]
    for stack in stacks:  # grows while it is read
        stacks += [s for symbol in _SYMBOLS for s in shift(stack, symbol) if s not in stacks]
    return {stack[0]: stack for stack in reversed(stacks)}


def _merge(tops: dict[int, tuple[int, str, Stack]], cost: int, audit: str, stacks: tuple[Stack, ...]) -> bool:
    changed = False
    for stack in stacks:
        old = tops.get(stack[0])
        if old is None or (cost, audit) < old[:2]:
            tops[stack[0]] = (cost, audit, stack)
            changed = True
    return changed


def _inserted(tops: dict[int, tuple[int, str, Stack]]) -> dict[int, tuple[int, str, Stack]]:
    """The tops reached by inserting any number of turns."""
    changed = True
    while changed:
        changed = False
        for cost, audit, stack in list(tops.values()):
            for symbol in ROLES:
                changed |= _merge(tops, cost + INSERT, audit + "I", shift(stack, symbol))
    return tops


def token(initial: str, fault: str) -> str:
    """One letter for a turn's role initial and first fault."""
    return chr(65 + 4 * (_SYMBOLS.find(initial) if initial and initial in _SYMBOLS else 3) + FAULTS.index(fault))


@lru_cache(maxsize=1 << 15)
def parse(tokens: str, entry: int = 0) -> tuple[tuple[int, int, str], ...]:
    """(exit top, cost, audit) of the cheapest repairs of a run of turns entered with a stack top."""
    tops = {entry: (0, "", entries()[entry])}
    for letter in tokens:
        kind, fault = divmod(ord(letter) - 65, 4)
        reached: dict[int, tuple[int, str, Stack]] = {}
        for cost, audit, stack in _inserted(tops).values():
            _merge(reached, cost + DELETE, audit + "D", (stack,))
            if FAULTS[fault] in ("blank", "duplicate"):
                continue
            extra = TRUNCATED if FAULTS[fault] == "truncated" else 0
            if kind < 3:
                _merge(reached, cost + extra, audit + "K", shift(stack, _SYMBOLS[kind]))
            for symbol in ROLES:
                _merge(reached, cost + extra + REROLE, audit + "R", shift(stack, symbol))
        tops = reached
    return tuple((top, cost, audit) for top, (cost, audit, _) in sorted(tops.items()))


@lru_cache(maxsize=1)
def endings() -> dict[int, Value]:
    """The cheapest insertions that complete a conversation from each top."""
    done = automaton()[2]
    found = {top: [v[:2] for k, v in _inserted({top: (0, "", stack)}).items() if k in done] for top, stack in entries().items()}
    return {top: min(values) for top, values in found.items() if values}


def compose(first: list, second: list) -> list[tuple[int, int, int, str]]:
    """The table of two runs of turns, one after the other; a table lists (entry, exit, cost, audit)."""
    after: dict[int, list] = {}
    for entry, leave, cost, audit in second:
        after.setdefault(entry, []).append((leave, cost, audit))
    best: dict[tuple[int, int], Value] = {}
    for entry, middle, cost, audit in first:
        for leave, more, rest in after[middle]:
            value = (cost + more, audit + rest)
            if (entry, leave) not in best or value < best[entry, leave]:
                best[entry, leave] = value
    return [(*ends, *value) for ends, value in best.items()]


def cheapest(table: list) -> Value:
    """Cost and audit of the cheapest whole repair."""
    last = endings()
    return min((cost + last[leave][0], audit + last[leave][1]) for entry, leave, cost, audit in table if entry == 0 and leave in last)


def _illegal(left: str, right: str) -> int:
    """Whether two neighbouring turns, given by letters, are no su, ua or au."""
    pair = "".join((*_SYMBOLS, "?")[(ord(x) - 65) // 4] for x in (left, right))
    return int(pair not in ("su", "ua", "au"))


_TABLE = "array<struct<entry:int,leave:int,cost:bigint,audit:string>>"
_RUN = f"conv string, part bigint, steps {_TABLE}, head string, tail string, illegal bigint"


def _rows(steps: list) -> list[dict]:
    return [dict(zip(("entry", "leave", "cost", "audit"), x)) for x in steps]


def _parse_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for conv, part, tokens in zip(batch["conv"], batch["part"], batch["tokens"]):
            steps = [(entry, *x) for entry in ((0,) if part == 0 else entries()) for x in parse(tokens, entry)]
            out.append((conv, part, _rows(steps), tokens[0], tokens[-1], sum(map(_illegal, tokens, tokens[1:]))))
        yield pd.DataFrame(out, columns=["conv", "part", "steps", "head", "tail", "illegal"])


def _compose_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for conv, part, runs in zip(batch["conv"], batch["part"], batch["runs"]):
            steps, illegal, tail = None, 0, None
            for run in runs:
                table = [(x["entry"], x["leave"], x["cost"], x["audit"]) for x in run["steps"]]
                steps = table if steps is None else compose(steps, table)
                illegal += run["illegal"] + (_illegal(tail, run["head"]) if tail else 0)
                tail = run["tail"]
            out.append((conv, part, _rows(steps), runs[0]["head"], tail, illegal))
        yield pd.DataFrame(out, columns=["conv", "part", "steps", "head", "tail", "illegal"])


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        best = [cheapest([(x["entry"], x["leave"], x["cost"], x["audit"]) for x in steps]) for steps in batch["steps"]]
        yield pd.DataFrame({"conv": batch["conv"], "illegal": batch["illegal"], "cost": [b[0] for b in best], "audit": [b[1] for b in best]})


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _plain(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults chosen by the CRC of conversation and turn: about one turn in four.

    One twentieth each is dropped, emptied, stripped of ends of sentences, repeated, or given to the user.  Null
    conversations and turns count as a space there, null roles and texts become one.
    """
    rows = _plain(turns)
    place = F.concat(_key(F.col("conv_id")), F.lit(":"), _key(F.col("turn")))
    rows = rows.withColumn("_fate", F.crc32(place.cast("binary")) % 20).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("_fate") == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Narrow rows in order: conv, turn, row_index, token and fault.  Turns that tie are ordered by a digest of role and text."""
    end = F.rtrim("text", F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = turns.select(
        _key(F.col("conv_id")).alias("conv"), "turn", _digest().alias("digest"),
        F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).alias("fault"),
        F.coalesce(F.nullif(F.instr(F.lit(_SYMBOLS), initial) * F.when(initial == "", 0).otherwise(1), F.lit(0)) - 1, F.lit(3)).alias("kind"),
        F.monotonically_increasing_id().alias("tie"),  # lets equal rows lie in several partitions
    )
    placed = with_row_index(narrow, "conv", F.asc_nulls_first("turn"), "digest", "tie").drop("tie")
    first = placed.groupBy("conv", "digest").agg(F.min("row_index").alias("first"))
    fault = F.when((F.col("fault") != 1) & (F.col("row_index") > F.col("first")), 2).otherwise(F.col("fault"))
    return placed.join(first, ["conv", "digest"]).select("conv", "turn", "row_index", fault.alias("fault"), F.char(65 + 4 * F.col("kind") + fault).alias("token"))


def plan_repairs(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation in ``turns`` (as ``damage`` gives them)."""
    rows = materialise(_faults(turns))
    share = lambda fault: F.count_if(F.col("fault") == FAULTS.index(fault)).alias(fault)
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    counts = rows.groupBy("conv").agg(
        F.least(F.coalesce(gaps, wide(F.lit(0))), wide(F.lit((1 << 63) - 1))).cast("bigint").alias("gaps"),
        share("blank"), share("duplicate"), share("truncated"), F.min("row_index").alias("start"),
    )
    segment = F.floor(F.col("row_index") / SEGMENT)
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "token"))), lambda x: x["token"]), "")
    segments = rows.groupBy("conv", segment.alias("segment")).agg(tokens.alias("tokens"))
    part = F.col("segment") - F.floor(F.col("start") / SEGMENT)
    runs = materialise(segments.join(counts.select("conv", "start"), "conv").select("conv", part.alias("part"), "tokens").mapInPandas(_parse_segments, _RUN))
    last = runs.agg(F.max("part")).first()[0] or 0
    while last:
        packed = F.array_sort(F.collect_list(F.struct("part", "steps", "head", "tail", "illegal")))
        last //= FAN_IN
        runs = runs.groupBy("conv", F.floor(F.col("part") / FAN_IN).alias("part")).agg(packed.alias("runs")).mapInPandas(_compose_runs, _RUN)
    best = runs.select("conv", "steps", "illegal").mapInPandas(_choose, "conv string, illegal bigint, cost bigint, audit string")
    return counts.drop("start").join(best, "conv")


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the audit of each conversation over its rows and hash what it leaves."""
    head, edits, digest, last, lines = None, "", hashlib.sha256(), "", 0

    def put(role: str, text: str) -> None:
        nonlocal last, lines
        digest.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        last, lines = role[:1], lines + 1

    def due() -> str:
        return "assistant" if last == "u" else "user"

    def insert(at: int) -> int:
        while edits[at : at + 1] == "I":
            put(due(), "")
            at += 1
        return at

    def closed(at: int) -> dict:
        if insert(at) != len(edits):
            raise ValueError(f"audit and turns of conversation {head['conv_id']} differ")
        return head | {"repaired_sha256": digest.hexdigest()}

    at = 0
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if head is not None:
                    out.append(closed(at))
                head = {c: row[c] for c in ("conv_id", *_FIGURES, "audit")}
                edits, digest, last, lines, at = row["audit"], hashlib.sha256(), "", 0, 0
                continue
            at = insert(at)
            edit = edits[at : at + 1]
            at += 1
            if edit == "K":
                put(row["role"], row["text"])
            elif edit == "R":
                put(due(), row["text"])
            elif edit != "D":
                raise ValueError(f"audit and turns of conversation {head['conv_id']} differ")
        yield pa.RecordBatch.from_pylist(out, schema)
    if head is not None:
        yield pa.RecordBatch.from_pylist([closed(at)], schema)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``conversations`` (conv_id; by default those of ``turns``).

    ``turns`` has conv_id, turn, role, text; others are ignored.  Returns conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.  Turns are taken in ascending order, nulls first; turns that tie are taken by a
    digest of role and text.  Null roles and texts count as one space; rows without conv_id form one conversation; a
    role whose first letter is none of s, u, a can't be kept; repeated rows are duplicates.  A conversation without turns
    has zeros, an empty audit and the digest of nothing; empty tables give an empty table.
    """
    turns = _plain(turns)
    every = (conversations if conversations is not None else turns).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    heads = every.withColumn("conv", _key(F.col("conv_id"))).join(plan_repairs(turns), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _FIGURES]
    heads = heads.select("conv", "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.lit(0).alias("kind"))
    rows = turns.select(_key(F.col("conv_id")).alias("conv"), "turn", _digest().alias("digest"), "role", "text", F.lit(1).alias("kind"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    streams = both.repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "digest")
    figures = ", ".join(f"{c} bigint" for c in _FIGURES)
    return streams.select("kind", "conv_id", *_FIGURES, "audit", "role", "text").mapInArrow(_digests, f"conv_id bigint, {figures}, audit string, repaired_sha256 string")
