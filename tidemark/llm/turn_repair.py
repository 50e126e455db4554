"""Repair of conversations: damage, faults, and the cheapest edits to a legal order of roles.

Rows are sorted by conversation over all tasks, so a conversation of any size is cut where a task
ends. Those that lie within one task are repaired there. The others leave one summary for each run of
rows, among it the cheapest edits for each pair of roles before and after; summaries of a conversation
are put together, and its rows are then read once more, in order, for the digest of the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.turn_search import AFTER, ASSISTANT, START, SYSTEM, USER, finish, joined, solve, transfer

SPACES = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: What a run of rows leaves: kind 0 a repaired conversation, 1 the summary of a run, 2 a row of its text.
RUN_SCHEMA = (
    "kind int, conv_id bigint, part int, run int, row int, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string, "
    "low bigint, high bigint, n_turns bigint, first string, last string, ways string, role string, text string, copies bigint")
#: Rows of one conversation that a task holds at once.
RUN_ROWS = 20_000


def mark(conv_id: Column, turn: Column, modulus: int = 20) -> Column:
    """crc32 of ``conv_id:turn``, a null being one space."""
    spaced = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.pmod(F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")), F.lit(modulus))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage; a null role or text is one space."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("mark", mark(F.col("conv_id"), F.col("turn"))).where("mark <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("mark") == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and whether the first is new, sorted over all tasks.

    Equal rows are counted before they move, and the first turn of a text comes from digests.
    """
    key = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    first = rows.groupBy(F.col("conv_id").alias("first_conv"), F.col("key").alias("first_key")).agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("any_null"))
    new = F.when(F.col("any_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("key") == F.col("first_key")))
    order = ["conv_id", "turn", "role", "text"]
    return rows.select(*order, "copies", new.alias("new")).repartitionByRange(*order).sortWithinPartitions(*order)


def letters(role: str, text: str, copies: int, new: bool) -> tuple[str, tuple[int, int, int]]:
    """The turns of equal rows for the search, and how many are blank, duplicate and truncated."""
    last = text.rstrip(SPACES)[-1:]
    if not last:
        return "d" * copies, (copies, 0, 0)
    cut = last not in ".!?"
    turn = (role[:1] if role[:1] in ("s", "u", "a") else "x") if new else ""
    return (turn.upper() if cut else turn) + "d" * (copies - new), (0, copies - new, int(cut and new))


class Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows = conv_id, []
        self.counts = [0, 0, 0]
        self.turns: list[str] = []
        self.illegal = self.n_turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, new: bool) -> None:
        found, counts = letters(role, text, copies, new)
        self.turns.append(found)
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        if turn is not None:
            self.n_turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append((role, text, copies))

    def repaired(self) -> dict:
        cost, audit = solve("".join(self.turns))
        digest = Repaired(audit)
        for row in self.rows:
            digest.add(*row)
        return self.summary() | {"kind": 0, "gaps": gaps(self.low, self.high, self.n_turns), "cost": cost, "audit": audit, "repaired_sha256": digest.end()}

    def summary(self) -> dict:
        return {"conv_id": self.conv_id, **dict(zip(COUNTS[1:4], self.counts)), "illegal": self.illegal,
                "low": self.low, "high": self.high, "n_turns": self.n_turns, "first": self.first, "last": self.last}

    def parts(self, part: int, run: int) -> Iterator[dict]:
        """The summary of a run that may go on elsewhere, and its rows."""
        ways = "\n".join(f"{b} {e} {c} {a}" for (b, e), (c, a) in transfer("".join(self.turns)).items())
        at = {"part": part, "run": run}
        yield self.summary() | at | {"kind": 1, "ways": ways}
        for i, (role, text, copies) in enumerate(self.rows):
            yield at | {"kind": 2, "conv_id": self.conv_id, "row": i, "copies": copies, "role": role, "text": text}


def gaps(low: int | None, high: int | None, n_turns: int) -> int:
    return 0 if low is None else high - low + 1 - n_turns


class Repaired:
    """Digest of the repaired lines, row by row; the roles of new turns follow from the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self._line(role, text, {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT))
            elif letter == "R":
                self._new(text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._new("")

    def _new(self, text: str) -> None:
        after = AFTER[self.state]
        self._line("user" if after == USER else "assistant", text, after)

    def _line(self, role: str, text: str, state: int) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, state


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, types[t]) for n, t in (f.split() for f in ddl.split(","))])


def _emit(rows: Iterator[dict], ddl: str, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held, schema = [], _arrow(ddl)
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[dict]:
    """Rows of the first and last conversation of a task may go on in another one."""
    part, n, inside, run = TaskContext.get().partitionId(), 0, False, None
    for batch in batches:
        for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if run is None or conv_id != run.conv_id:
                if run is not None:
                    yield from [run.repaired()] if inside else run.parts(part, n)
                    inside, n = True, n + 1
                run = Run(conv_id)
            elif len(run.rows) >= run_rows:
                yield from run.parts(part, n)
                inside, n, run = False, n + 1, Run(conv_id)
            run.add(*row)
    if run is not None:
        yield from run.parts(part, n)


COMPOSED = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"


def _compose(runs: pd.DataFrame) -> pd.DataFrame:
    """The summaries of one conversation, put together in order."""
    total, ways, last = dict.fromkeys(COUNTS, 0), None, None
    low = high = None
    n_turns = 0
    for r in runs.sort_values(["part", "run"]).itertuples():
        for c in COUNTS[1:5]:
            total[c] += int(getattr(r, c))
        total["illegal"] += last is not None and last + r.first not in LEGAL
        last = r.last
        if r.high is not None:
            n_turns += int(r.n_turns) - (high == int(r.low))
            low, high = int(r.low) if low is None else low, int(r.high)
        own = {}
        for way in r.ways.split("\n"):
            b, e, cost, audit = way.split(" ")
            own[int(b), int(e)] = (int(cost), audit)
        ways = own if ways is None else joined(ways, own)
    total["cost"], audit = finish(ways)
    total["gaps"] = gaps(low, high, n_turns)
    conv_id = runs["conv_id"].iloc[0]
    return pd.DataFrame([{"conv_id": None if pd.isna(conv_id) else int(conv_id), **total, "audit": audit}]).astype({"conv_id": "Int64"})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """conv_id and digest from each conversation's audit and, after it, its rows in order."""
    conv_id, digest = None, None
    for batch in batches:
        for conv, kind, audit, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                if digest is not None:
                    yield {"conv_id": conv_id, "repaired_sha256": digest.end()}
                conv_id, digest = conv, Repaired(audit)
            else:
                digest.add(role, text, copies)
    if digest is not None:
        yield {"conv_id": conv_id, "repaired_sha256": digest.end()}


def repaired(conversations: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row for each conv_id of the input: its faults after damage and its cheapest repair.

    Rows go by turn (nulls first), then role, then text. Rows of a null conv_id form one conversation. A
    role that is empty or begins with another letter than s, u, a cannot be kept. Conversations that lost
    all rows give zeros, an empty audit and the digest of the empty string. Repeated rows are rows of their
    own; extra columns change nothing; an empty table gives an empty result.
    """
    runs = stored(ordered(damaged(conversations)).mapInArrow(lambda batches: _emit(_runs(batches, run_rows), RUN_SCHEMA), RUN_SCHEMA), "turn-runs")
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    whole = runs.where("kind = 0").select(*columns)
    # Turns as text: pandas has no exact whole numbers beside nulls.
    summaries = runs.where("kind = 1").withColumns({c: F.col(c).cast("string") for c in ("low", "high")})
    composed = stored(summaries.groupBy("conv_id").applyInPandas(_compose, COMPOSED), "turn-composed")
    lines = composed.selectExpr("conv_id", "0 kind", "audit", "null role", "null text", "0L copies", "0 part", "0 run", "0 row").unionByName(
        runs.where("kind = 2").selectExpr("conv_id", "2 kind", "null audit", "role", "text", "copies", "part", "run", "row"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "run", "row").select("conv_id", "kind", "audit", "role", "text", "copies")
    schema = "conv_id bigint, repaired_sha256 string"
    digests = lines.mapInArrow(lambda batches: _emit(_digests(batches), schema), schema).withColumnRenamed("conv_id", "of")
    cut = composed.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select(*columns)
    found = whole.unionByName(cut).withColumnRenamed("conv_id", "of")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
