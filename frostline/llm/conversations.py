"""Repair of the turn structure of conversations, of any length.

Rows are put in order and coded, one letter each, by built-in functions. The letters of up to
``BLOCK`` consecutive rows form a string; ``repair_search`` finds the cheapest edits of each by
branch and bound, in tasks that do not depend on how long a conversation is. A conversation of
several blocks joins their tables from front to back. At last the edits meet the texts again,
in a stream sorted by conversation and turn: a task holds the edits of one conversation and a
batch of rows, never all texts of a conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import repair_search
from frostline.llm.common import BLANKS, parallelism, text_slices
from frostline.llm.places import places_in_groups
from frostline.session import write_scratch

BLOCK_BITS = 8  # rows of a block: 256
SPACE = " "

# What happens to a row by crc32("conv_id:turn") % FAULTS; all other rows stay (fixed values).
FAULTS = 20
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults; nulls count as one space."""
    texts = {n: F.coalesce(F.col(n).cast("string"), F.lit(SPACE)) for n in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(texts["conv_id"], F.lit(":"), texts["turn"]).cast("binary")) % F.lit(FAULTS)
    text = F.when(fault == EMPTY, "").when(fault == UNSTOP, F.translate(texts["text"], ".!?", "")).otherwise(texts["text"])
    role = F.when(fault == AS_USER, "user").otherwise(texts["role"])
    times = F.when(fault == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.where(fault != DROP)
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
        .select("conv_id", "turn", "role", "text")
    )


def _initial() -> Column:
    return F.substring("role", 1, 1)


def _order() -> list[Column]:
    """Order of the rows of a conversation: equal turns by role and the text's hash."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("hash")]


def row_codes(rows: DataFrame) -> DataFrame:
    """(conv_id, place, code) of rows (conv_id, turn, role, text): place in the conversation
    and the letter of ``repair_search``. The first of equal rows is no duplicate."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5(F.col("text").cast("binary")).alias("hash"),
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut_off"),
    )
    placed = write_scratch(places_in_groups(narrow, "conv_id", _order(), "place", "turns"), "turns-placed")
    firsts = placed.groupBy("conv_id", "role", "hash").agg(F.min("place").alias("place"))
    firsts = firsts.select(F.col("conv_id").alias("of_conv"), F.col("place").alias("of_place"))
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("place") == F.col("of_place"))
    role = F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x")
    code = (
        F.when(F.col("blank"), "B")
        .when(F.col("of_place").isNull(), "D")
        .when(F.col("cut_off"), F.upper(role))
        .otherwise(role)
    )
    return placed.join(firsts, same, "left").select("conv_id", "place", code.alias("code"))


TABLE = "array<struct<entry: int, exit: int, cost: bigint, audit: string>>"


def _solve(bits: int):
    schema = pa.schema(
        [("conv_id", pa.int64()), ("block", pa.int64()), ("only", pa.bool_())]
        + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated")]
        + [("steps", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
    )

    def run(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            for conv, block, codes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "codes"))):
                only = block == 0 and len(codes) < 1 << bits
                steps = [(0, -1, *repair_search.whole(codes))] if only else repair_search.block_table(codes, block == 0)
                steps = [dict(zip(("entry", "exit", "cost", "audit"), s)) for s in steps]
                cut = sum(c in "SUAX" for c in codes)
                for name, value in zip(schema.names, (conv, block, only, codes.count("B"), codes.count("D"), cut, steps)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _chain(batches):
    """Joins the tables of blocks that come sorted by conversation and block."""
    schema = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    states, conv, begun = None, None, False

    def label():
        cost, audit = repair_search.close(states)
        return {"conv_id": conv, "cost": cost, "audit": audit}

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if not begun or r["block"] == 0:
                if begun:
                    done.append(label())
                states, conv, begun = {repair_search.START: (0, "")}, r["conv_id"], True
            states = repair_search.extend(states, [tuple(s.values()) for s in r["steps"]])
        yield pa.RecordBatch.from_pylist(done, schema)
    if begun:
        yield pa.RecordBatch.from_pylist([label()], schema)


def audits(codes: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, audit) of every conversation in (conv_id, place, code), and
    (conv_id, blank, duplicate, truncated)."""
    one = F.struct("place", "code")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["code"]), "")
    blocks = codes.groupBy("conv_id", F.shiftright("place", bits).alias("block")).agg(letters.alias("codes"))
    counts = ("blank", "duplicate", "truncated")
    kinds = f"conv_id long, block long, only boolean, {', '.join(f'{n} long' for n in counts)}, steps {TABLE}"
    solved = write_scratch(blocks.mapInArrow(_solve(bits), kinds), "repair-blocks")
    alone = solved.where("only").select("conv_id", F.expr("steps[0].cost AS cost"), F.expr("steps[0].audit AS audit"))
    parts = solved.where("NOT only").select("conv_id", "block", "steps")
    chained = (
        parts.repartition(parallelism(codes.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInArrow(_chain, "conv_id long, cost long, audit string")
    )
    found = solved.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in counts])
    return alone.union(chained), found


MARKER, ROW = 0, 1
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
LEGAL = {"su", "ua", "au"}  # fixed values


class _Repair:
    """One conversation while its rows come by: its counts, and the hash of what stays."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at = head, head["audit"] or "", 0
        self.state, self.digest, self.empty = repair_search.START, hashlib.sha256(), True
        self.illegal, self.before = 0, None
        self.first, self.last, self.turns = None, None, 0

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _new_turn(self, text: str) -> None:
        self._put("assistant" if self.state == repair_search.USER else "user", text)
        self.state = repair_search._TURN[self.state]

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._new_turn("")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._new_turn(text)
        elif edit == "K":
            self._put(role, text)
            system = self.state == repair_search.START and initial == "s"
            self.state = repair_search.SYSTEM if system else repair_search._TURN[self.state]

    def report(self) -> dict:
        self._insertions()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        counts = {n: self.head[n] or 0 for n in ("blank", "duplicate", "truncated", "cost")}
        return counts | {
            "conv_id": self.head["conv_id"], "gaps": gaps, "illegal": self.illegal, "audit": self.audit,
            "repaired_sha256": self.digest.hexdigest(),
        }


def _apply(batches):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )
    current = None
    for batch in text_slices(batches):
        done = []
        for r in batch.to_pylist():
            if r["kind"] == MARKER:
                if current is not None:
                    done.append(current.report())
                current = _Repair(r)
            else:
                current.row(r["turn"], r["role"], r["text"])
        yield pa.RecordBatch.from_pylist(done, schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.report()], schema)


def repair(conversations: DataFrame, damaged: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation of
    ``conversations``, judged by its rows in ``damaged``.

    Rows go by turn, null turns first, equal turns by role and text hash; a null id is a
    conversation of its own. A role may have any text; only the initials s, u and a can stay.
    Repeated rows are duplicates. A conversation without rows, or an empty table, gives zeros
    with an empty audit, or no rows. Further columns play no part. A conversation's audit is one
    value and its hash one sequence, so the last step reads each conversation in one task.
    """
    rows = damaged.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    labels, counts = audits(row_codes(rows), bits)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = ids
    for more in (labels, counts):
        more = more.withColumnRenamed("conv_id", "of_conv")
        heads = heads.join(more, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left").drop("of_conv")
    heads = heads.withColumn("kind", F.lit(MARKER))
    texts = rows.withColumns({"hash": F.md5(F.col("text").cast("binary")), "kind": F.lit(ROW)})
    n = parallelism(conversations.sparkSession)
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition(n, "conv_id")
    ordered = stream.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order())
    return ordered.drop("hash").mapInArrow(_apply, REPORT)
