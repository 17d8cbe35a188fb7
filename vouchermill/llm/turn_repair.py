"""Repair of the structure of conversations with the fewest edits.

Faults of a turn are `blank`, `duplicate` (role and text seen earlier in the
conversation) and `truncated` (no end mark at its end); the first counts. A
repaired conversation has the roles `(s?(ua)+)?`: an opening system turn, then
users and assistants in turn. `edit_lattice` finds the cheapest edits and, among
those, the least audit.

1. Equal rows of a conversation are counted together, so copies of a row cost
   nothing, and the first turn of every role and text is found by an aggregate.
2. Rows are sorted by conversation and turn into ranges. Each task cuts its
   range into blocks of at most BLOCK_ROWS rows and solves each of them; a block
   in the middle of a conversation is solved for every state before and after
   it. A conversation that holds a third of all rows is spread over the tasks.
3. Blocks are put together from the last to the first (without texts): of equal
   costs the least audit goes on. A task holds the audit of one conversation,
   which is a value of the result.
4. Blocks and their edits stream by in order, giving the repaired turns or their
   digest. A SHA-256 digest cannot be split, so the turns of one conversation
   pass through one task, a batch at a time; nothing is gathered.

Defined cases: a null role or text is one space; a null conv_id is a
conversation of its own; null turns come first; rows with equal turns are taken
by role and then by the MD5 of their text; a role without an initial fits
nowhere and is given another one or deleted; a conversation without rows
(`damage` may drop them all) has an empty audit; an empty table stays empty;
other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vouchermill.llm import batches
from vouchermill.llm.edit_lattice import ACCEPTING, AFTER, START, WANTED, Item, cheapest, prepend
from vouchermill.session import shared_folder

BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: exit of a block that ends its conversation
ENDED = -1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and how often the row counts."""
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies")
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of `rows_of` with planted faults; a row that is dropped counts 0 times."""

    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    gone = kind == 0
    return rows.select(
        "conv_id",
        "turn",
        F.when(gone, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("copies") * F.when(gone, 0).when(kind == 3, 2).otherwise(1)).alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Different rows with `live` (0: no copy stays, 1: one does, 2: one does and is
    truncated) and the numbers of blank and duplicate copies."""
    content = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    body = F.rtrim("text", F.lit(BLANKS))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))
    once = once.select("*", F.md5(content).alias("content"), F.md5("text").alias("digest"), (body == "").alias("empty"), F.right(body, F.lit(1)).alias("last"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = once.where((F.col("copies") > 0) & ~F.col("empty")).groupBy("content").agg(F.min(place).alias("first"))
    copies, opening = F.col("copies"), F.col("first").eqNullSafe(place)
    stays = (copies > 0) & ~F.col("empty") & opening
    return once.join(first, "content", "left").select(
        "conv_id", "turn", "role", "digest", "text", "copies",
        F.when(stays, F.when(F.col("last").isin(".", "!", "?"), 1).otherwise(2)).otherwise(0).alias("live"),
        F.when(F.col("empty"), copies).otherwise(0).alias("blank"),
        F.when(F.col("empty"), 0).otherwise(copies - stays.cast("bigint")).alias("duplicate"),
    )


_EDGES = "array<struct<entry int, leave int, cost bigint, audit string>>"


def _blocks_schema(conv: pa.DataType, turn: pa.DataType) -> pa.Schema:
    edge = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema(
        [("conv_id", conv), ("seq", pa.int64()), ("edges", pa.list_(edge)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
         ("live", pa.list_(pa.int32())), ("forced", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("low", turn), ("high", turn),
         *((c, pa.int64()) for c in ("steps", "blank", "duplicate", "truncated", "illegal"))]
    )


class _Block:
    """Rows of one conversation that follow one another."""

    def __init__(self, known_start: bool):
        self.known_start = known_start
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.live: list[int] = []
        self.forced: list[int] = []
        self.turns: list = []
        self.initials: list[str] = []  # of all copies, but equal ones are counted by `same`
        self.illegal = self.blank = self.duplicate = self.truncated = self.chars = self.steps = 0

    def add(self, turn, role: str, text: str, copies: int, live: int, blank: int, duplicate: int) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.initials:
            self.illegal += self.initials[-1] + initial not in LEGAL
        self.illegal += copies - 1
        self.initials.append(initial)
        if turn is not None:
            self.steps += not self.turns or self.turns[-1] != turn
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.roles.append(role)
        self.texts.append(text if live else "")
        self.live.append(live)
        self.forced.append(blank + duplicate)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + (live == 2)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def items(self) -> tuple[Item, ...]:
        out = []
        for initial, live, forced in zip(self.initials, self.live, self.forced):
            if live:
                out.append(Item(initial, live == 2))
            if forced:
                out.append(Item("", False, forced))
        return tuple(out)

    def row(self, conv, seq: int, known_end: bool, solve) -> dict:
        items, edges = self.items(), []
        for entry in (START,) if self.known_start else range(4):
            for leave in (ENDED,) if known_end else range(4):
                found = solve(items, entry, ACCEPTING if leave == ENDED else (leave,))
                if found:
                    edges.append({"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]})
        return {
            "conv_id": conv, "seq": seq, "edges": edges, "roles": self.roles, "texts": self.texts, "live": self.live, "forced": self.forced,
            "first": self.initials[0] if self.initials else None, "last": self.initials[-1] if self.initials else None,
            "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None, "steps": self.steps,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
        }


def blocks(rows: DataFrame) -> DataFrame:
    """Solved blocks of the rows of `with_faults`, stored."""
    spark = rows.sparkSession
    batches.for_texts(spark)
    stored = shared_folder(spark, "turn-faults")
    rows.write.parquet(stored)
    sort = ["conv_id", "turn", "role", "digest"]
    ordered = spark.read.parquet(stored).repartitionByRange(*sort).sortWithinPartitions(*sort)
    conv_type, turn_type = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = (
        f"conv_id {conv_type}, seq bigint, edges {_EDGES}, roles array<string>, texts array<string>, live array<int>, forced array<bigint>, first string, "
        f"last string, low {turn_type}, high {turn_type}, steps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    )
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = lru_cache(1 << 14)(cheapest)  # short conversations are much alike
        seq = TaskContext.get().partitionId() << 32
        block, conv, out, chars, arrow = None, None, [], 0, None
        for batch in stream:
            arrow = arrow or _blocks_schema(batch.schema.field("conv_id").type, batch.schema.field("turn").type)
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "live", "blank", "duplicate")]
            for new, turn, *rest in zip(*columns):
                if block is None or new != conv or block.full():
                    if block is not None:
                        out.append(block.row(conv, seq, new != conv, solve))
                        seq, chars = seq + 1, chars + block.chars
                    # what the range before this one ends with is not known here
                    block = _Block(block is not None and new != conv)
                    conv = new
                    if len(out) >= 512 or chars >= BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, chars = [], 0
                block.add(turn, *rest)
        if block is not None:
            out.append(block.row(conv, seq, False, solve))
            yield pa.RecordBatch.from_pylist(out, arrow)

    columns = ["conv_id", "turn", "role", "text", "copies", "live", "blank", "duplicate"]
    solved = shared_folder(spark, "turn-blocks")
    ordered.select(*columns).mapInArrow(cut, schema).write.parquet(solved)
    return spark.read.parquet(solved)


def edits(solved: DataFrame) -> DataFrame:
    """Of blocks, without their texts: a row per conversation (seq -1) with its
    counts, cost and audit, and a row per block with the state before it and its
    part of the audit. Stored."""
    spark = solved.sparkSession
    conv_type = solved.schema["conv_id"].dataType.simpleString()
    counts = [(c, pa.int64()) for c in (*COUNTS, "cost")]

    def joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, arrow = [], 0, None
        conv, open_, rest, total, after, low, high, steps = None, False, {}, {}, None, None, None, 0

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_pylist(out, arrow)
            out, size = [], 0
            return batch

        def finished():
            """Rows of a conversation whose first block has been taken."""
            nonlocal size
            cost, chain = rest[START]
            parts, link = [], chain
            while link is not None:
                parts.append((link.block, link.entry, link.audit))
                link = link.rest
            gaps = high - low + 1 - steps if steps else 0
            out.append({"conv_id": conv, "seq": -1, "audit": "".join(x[2] for x in parts), "gaps": gaps, "cost": cost, **total})
            for block, entry, audit in parts:
                out.append({"conv_id": conv, "seq": block, "entry": entry, "audit": audit})
                size += len(audit)
                if len(out) >= 4096 or size > BLOCK_CHARS:
                    yield flush()

        for batch in stream:
            if arrow is None:
                arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("seq", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()), *counts])
            for r in batch.to_pylist():
                if not open_ or r["conv_id"] != conv:
                    if open_:
                        yield from finished()
                    conv, open_, rest = r["conv_id"], True, {ENDED: (0, None), **{x: (0, None) for x in ACCEPTING}}
                    total, after, low, high, steps = dict.fromkeys(COUNTS[1:], 0), None, None, None, 0
                rest = prepend(r["seq"], [(e["entry"], e["leave"], e["cost"], e["audit"]) for e in r["edges"]], rest)
                for c in total:
                    total[c] += r[c]
                if r["last"] is not None and after is not None:
                    total["illegal"] += r["last"] + after not in LEGAL
                after = after if r["first"] is None else r["first"]
                if r["steps"]:
                    steps += r["steps"] - (r["high"] == low)
                    low, high = r["low"], r["high"] if high is None else high
        if open_:
            yield from finished()
        if out:
            yield flush()

    kept = ["conv_id", "seq", "edges", "first", "last", "low", "high", "steps", *COUNTS[1:]]
    ordered = solved.select(*kept).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    folder = shared_folder(spark, "turn-edits")
    ordered.mapInArrow(
        joined, f"conv_id {conv_type}, seq bigint, entry int, audit string, " + ", ".join(f"{c} bigint" for c, _ in counts)
    ).write.parquet(folder)
    return spark.read.parquet(folder)


def _turns(audit: str, state: int, block: dict) -> list[tuple[str, str]]:
    """Repaired turns of a block."""
    rows, at, done = [], 0, 0  # done: copies of the current row that have an edit
    for letter in audit:
        if letter == "I":
            rows.append((WANTED[state], ""))
            state = AFTER[state, WANTED[state][0]]
            continue
        while done == (block["live"][at] > 0) + block["forced"][at]:
            at, done = at + 1, 0
        done += 1
        if letter == "K":
            rows.append((block["roles"][at], block["texts"][at]))
            state = AFTER[state, block["roles"][at][:1]]
        elif letter == "R":
            rows.append((WANTED[state], block["texts"][at]))
            state = AFTER[state, WANTED[state][0]]
    return rows


def _in_order(solved: DataFrame, found: DataFrame) -> DataFrame:
    """Summary of each conversation, then for each block its edits and its turns."""
    turns = solved.select("conv_id", "seq", "roles", "texts", "live", "forced")
    both = found.withColumn("kind", F.lit(0)).unionByName(turns.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind")


def _stream(stream: Iterator[pa.RecordBatch]):
    """(row of the conversation, repaired turns of its next block or None at its beginning)."""
    head = edit = None
    for batch in stream:
        for row in batch.to_pylist():
            if row["seq"] == -1:
                head = row
                yield head, None
            elif row["kind"] == 0:
                edit = row
            else:
                yield head, _turns(edit["audit"], edit["entry"], row)


def solve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and edits of the rows of `rows_of`, damaged or not."""
    solved = blocks(with_faults(rows))
    return solved, edits(solved)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text."""
    solved, found = solve(rows_of(conversations))
    conv_type = solved.schema["conv_id"].dataType.simpleString()

    def told(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for head, turns in _stream(stream):
            place = place if turns is not None else 0
            if turns:
                out = [{"conv_id": head["conv_id"], "place": place + i, "role": r, "text": t} for i, (r, t) in enumerate(turns)]
                place += len(turns)
                yield pa.RecordBatch.from_pylist(out)

    return _in_order(solved, found).mapInArrow(told, f"conv_id {conv_type}, place bigint, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired turns."""
    solved, found = solve(rows)
    conv_type = solved.schema["conv_id"].dataType.simpleString()
    named = (*COUNTS, "cost", "audit")

    def told(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, before = [], None, False
        arrow = None

        def line(head: dict) -> dict:
            return {"conv_id": head["conv_id"], **{c: head[c] for c in named}, "repaired_sha256": digest.hexdigest()}

        now = None
        for head, turns in _stream(stream):
            if turns is None:
                if now is not None:
                    out.append(line(now))
                now, digest, before = head, hashlib.sha256(), False
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out)
                    out = []
            elif turns:
                if before:
                    digest.update(b"\n")
                digest.update("\n".join(f"{r}:{t}" for r, t in turns).encode())
                before = True
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, line(now)])

    return _in_order(solved, found).mapInArrow(
        told, f"conv_id {conv_type}, " + ", ".join(f"{c} bigint" for c in named[:-1]) + ", audit string, repaired_sha256 string"
    )
