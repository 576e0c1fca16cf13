"""Operator 11: repair of the structure of conversations by secondary-sorted streams."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

SPACES = " \t\n\x0b\x0c\r"
# states: nothing so far, after the system turn, after user, after assistant
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State, and role, that an inserted or renamed turn leads to.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = ["user", "user", "assistant", "user"]
#: Where a kept turn leads to, by the initial of its role.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Cost and edits behind the last turn.
END, TAIL = (0, 4, 2, 0), ("", "II", "I", "")
LETTERS = "DIKR"
#: Backpointers that are held in memory; more go to a file of the task.
HELD = 1 << 20


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations(conv_id, turn, role, text)`` as a careless export leaves them, chosen by
    crc32(``conv_id:turn``) % 20, where nulls are one space: 0 drops a row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 writes it twice, 4 makes it the user's. Null roles and texts become one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind > 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), "kind")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select("conv_id", "turn", "role", "text")


def _keyed(turns: DataFrame) -> DataFrame:
    """Conversations by a string that nulls have, too; turns as (timed, at), so that nulls come first and stay exact."""
    return turns.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("at"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _step(costs: tuple, initial: str, gone: bool, cut: bool) -> tuple[int, tuple, bytes]:
    """One turn, from behind: (least cost, costs above it by state, backpointer). The backpointer has the best edit of
    each state, two bits each, and whether the turn is the system's, which tells where keeping it leads to at first."""
    found = []
    for s in range(4):
        options = {"D": costs[s] + 3}
        if not gone:
            options["R"] = costs[NEXT[s]] + 2 + cut
            if initial in KEPT[s]:
                options["K"] = costs[KEPT[s][initial]] + cut
        found.append(options)
    plain = [min(o.values()) for o in found]
    user, assistant = min(plain[USER], 2 + plain[ASSISTANT]), min(plain[ASSISTANT], 2 + plain[USER])
    for s in range(4):  # an inserted turn leads to user or assistant in front of the same turn
        found[s]["I"] = 2 + (assistant if NEXT[s] == ASSISTANT else user)
    least = [min(o.values()) for o in found]
    edits = sum(LETTERS.index(min(e for e, c in o.items() if c == m)) << 2 * s for s, (o, m) in enumerate(zip(found, least)))
    base = min(least)
    return base, tuple(c - base for c in least), (edits | (initial == "s") << 8).to_bytes(2, "big")


class _Repair:
    """Dynamic programme over one conversation whose turns arrive last one first."""

    steps: dict = {}  # costs of the states differ by little, so few steps are distinct

    def __init__(self):
        self.costs, self.total, self.rows = END, 0, 0
        self.back = tempfile.SpooledTemporaryFile(max_size=HELD)
        self.faults = dict.fromkeys(["", "blank", "duplicate", "truncated"], 0)
        self.illegal, self.later = 0, None
        self.distinct, self.most, self.least = 0, None, None

    def add(self, timed: bool, at: int, role: str, fault: str) -> None:
        self.faults[fault] += 1
        self.illegal += self.later is not None and role[:1] + self.later not in ("su", "ua", "au")
        self.later = role[:1]
        if timed and at != self.least:
            self.most = at if self.most is None else self.most
            self.distinct, self.least = self.distinct + 1, at
        key = (self.costs, self.later, fault in ("blank", "duplicate"), fault == "truncated")
        if key not in self.steps:
            if len(self.steps) > 1 << 16:
                self.steps.clear()
            self.steps[key] = _step(*key)
        base, self.costs, pointer = self.steps[key]
        self.total, self.rows = self.total + base, self.rows + 1
        self.back.write(pointer)

    def audit(self) -> str:
        """The edits from the first turn on, with backpointers read from the end of what was written."""
        out, state, end = [], EMPTY, 2 * self.rows
        while end:
            begin = max(0, end - HELD)
            self.back.seek(begin)
            held = self.back.read(end - begin)
            for i in range(len(held) - 2, -1, -2):
                pointer = held[i] << 8 | held[i + 1]
                while (letter := LETTERS[pointer >> 2 * state & 3]) == "I":
                    out.append(letter)
                    state = NEXT[state]
                out.append(letter)
                if letter == "R" or letter == "K" and not (state == EMPTY and pointer >> 8):
                    state = NEXT[state]
                elif letter == "K":
                    state = SYSTEM
            end = begin
        self.back.close()
        return "".join(out) + TAIL[state]

    def record(self, conv: str) -> dict:
        cost = self.total + self.costs[EMPTY]
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return {"conv": conv, "gaps": gaps, **{k: v for k, v in self.faults.items() if k}, "illegal": self.illegal, "cost": cost, "audit": self.audit()}


def _audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, conv, held = None, None, None

    def settle(earlier: tuple | None) -> None:
        timed, at, role, text, fault = held
        same = earlier is not None and earlier[:4] == held[:4]
        state.add(timed, at, role, "duplicate" if same and fault != "blank" else fault)

    for frame in frames:
        done = []
        for c, *row in zip(*(frame[k] for k in ("conv", "timed", "at", "role", "text", "fault"))):
            if c != conv:
                if state is not None:
                    settle(None)
                    done.append(state.record(conv))
                state, conv = _Repair(), c
            else:
                settle(tuple(row))
            held = tuple(row)
        if done:
            yield pd.DataFrame(done)
    if state is not None:
        settle(None)
        yield pd.DataFrame([state.record(conv)])


AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """(conv, faults, cost, audit) of each conversation of keyed turns, from a stream of its turns, last one first.

    A duplicate's first place is found by an aggregate over (conversation, role, digest), so no task holds the texts
    that a conversation has had; equal turns of one number are told by their neighbour in the stream.
    """
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = turns.withColumn("digest", digest)
    place = F.struct("timed", "at")
    first = turns.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("conv", "digest", "first")
    ends = F.rtrim("text", F.lit(SPACES))
    fault = F.when(ends == "", "blank").when(F.col("first") < place, "duplicate").when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    rows = turns.join(first.hint("merge"), ["conv", "digest"], "left").select("conv", "timed", "at", "role", "text", fault.alias("fault"))
    down = [F.col(c).desc() for c in ("timed", "at", "role", "text")]
    return rows.repartition("conv").sortWithinPartitions("conv", *down).mapInPandas(_audits, AUDIT)


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, audit, at, state, number = None, "", 0, EMPTY, 0

    for frame in frames:
        out = []

        def insert():
            nonlocal at, state, number
            while at < len(audit) and audit[at] == "I":
                out.append((conv, number, "I", ROLE[state], ""))
                state, at, number = NEXT[state], at + 1, number + 1

        for c, row, role, text in zip(frame["conv"], frame["row"], frame["role"], frame["text"]):
            if not row:
                insert()
                conv, audit, at, state, number = c, text, 0, EMPTY, 0
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit != "D":
                role = ROLE[state] if edit == "R" else role
                out.append((conv, number, edit, role, text))
                state = SYSTEM if role[:1] == "s" else NEXT[state]
                number += 1
        yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])
    rest = []
    for _ in audit[at:]:
        rest.append((conv, number, "I", ROLE[state], ""))
        state, number = NEXT[state], number + 1
    yield pd.DataFrame(rest, columns=["conv", "place", "edit", "role", "text"])


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns of repaired conversations. The turns of a conversation follow each
    other, in order, within one partition."""
    head = found.select("conv", F.lit(False).alias("row"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = turns.select("conv", F.lit(True).alias("row"), "timed", "at", "role", "text").unionByName(head)
    rows = rows.repartition("conv").sortWithinPartitions("conv", "row", "timed", "at", "role", "text")
    return rows.mapInPandas(_repaired, "conv string, place long, edit string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of ``turns(conv_id, turn, role, text)``.

    A conversation's turns are taken by (turn, role, text), null turns first, so ties and repeated rows have one order.
    Null conversation ids are one conversation, null roles and texts one space; an empty text is a blank turn. Other
    columns are ignored; an empty table gives empty results. A conversation is one stream, as its turns depend on each
    other in order: a task holds a batch of it and one megabyte of backpointers, and the rest of these in a file that
    is gone with the task. Only its audit, a byte for each edit, is held whole, as it is one value of the result.
    """
    turns = _keyed(turns)
    found = stored(audits(turns), "audits")
    return found, repaired_turns(turns, found)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, running = None, None
    for frame in frames:
        done = []
        for c, role, text in zip(frame["conv"], frame["role"], frame["text"]):
            if c != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
    if running is not None:
        yield pd.DataFrame([(conv, running.hexdigest())], columns=["conv", "repaired_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, turns = repair(damage(conversations))
    digests = turns.mapInPandas(_digests, "conv string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    rows = ids.join(found.hint("merge"), "conv", "left").join(digests.hint("merge"), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
