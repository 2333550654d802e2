"""Repair of conversation structure, with an audit of the edits (the programme is in ``audits``).

A conversation's rows stand in the order of their turns (nulls first).  Its faults: blank rows,
rows equal in role and text to an earlier one, rows whose last mark ends no sentence.  The cheapest
edits give role initials that read ``(s?(ua)+)?``.

Conversations of bounded size are grouped by one shuffle and repaired as they stream by.  Longer ones
never lie in one task as a whole: their rows are spread by range over (conversation, turn), cut into
segments, and each segment's costs between all states are computed on its own.  Per conversation
only these (a few numbers per segment) meet, to choose the states at the borders; then each segment's
edits are read off.  At last a long conversation's rows stream in order past its hash, a running sum
that can't be split, one row in memory at a time.

Defined results: null roles and texts are one space; null conversation ids are one conversation; rows
of equal turn are ordered by the MD5 of role and text; an empty role is no legal initial; repeated
rows are duplicates; a conversation without rows gives zeros, no edits and the hash of the
empty string; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import audits
from staylens.llm.common import Generations, map_arrow, slices, stored, worker_memo

#: A conversation with more rows, or more characters, is repaired in segments of so many rows.
SEGMENT_ROWS = 2048
WHOLE_CHARS = 4_000_000
#: Conversations of up to so many rows share one memo of their repairs, in two generations.
MEMO_ROWS, MEMO_REPAIRS = 16, 20_000

SPACE = " \t\n\x0b\x0c\r"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, present) with faults by a hash of conversation and turn.

    A dropped row stays as a row that is not ``present``, so that no conversation is lost.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled(text_col), ".!?", "")).otherwise(filled(text_col))
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(filled(role_col)).alias("role"), text.alias("text"),
        (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")


def whole(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, present) as they are."""
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("present"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds the faults that a row has alone, and the digest of role and text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    return (rows.withColumn("blank", bare == "")
            .withColumn("open", ~F.col("blank") & ~F.substring(bare, -1, 1).isin(".", "!", "?"))
            .withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))))


class Report:
    """Faults, cost and repaired text of one conversation, whose rows come in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.state, self.lines, self.hash, self.audit = audits.EMPTY, 0, hashlib.sha256(), []

    def row(self, turn, role: str, blank: bool, duplicate: bool, is_open: bool) -> int:
        """Counts a row; its symbol."""
        duplicate = duplicate and not blank
        truncated = is_open and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        return audits.symbol(role[:1], blank or duplicate, truncated)

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insert(self, n: int) -> None:
        for _ in range(n):
            role, self.state = audits.turn_after(self.state)
            self.line(role, "")
            self.cost += audits.COST["I"]

    def edit(self, edits: str, sym: int, role: str, text: str) -> None:
        """Applies a row's edits: insertions before it, then its own."""
        self.audit.append(edits)
        self.insert(len(edits) - 1)
        own = edits[-1]
        self.cost += audits.COST[own]
        if own != "D":
            due, after = audits.turn_after(self.state)
            if own == "K" and role[:1] == "s":
                after = audits.SYSTEM
            self.state = after
            self.cost += audits.TRUNCATED_COST * (sym % 2)
            self.line(role if own == "K" else due, text)

    def close(self) -> tuple:
        ending = audits.ENDING[self.state]
        self.audit.append(ending)
        self.insert(len(ending))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def by_row(audit: str) -> Iterator[str]:
    """The edits of a conversation row by row: insertions before a row go with it."""
    low = 0
    for high, e in enumerate(audit, 1):
        if e != "I":
            yield audit[low:high]
            low = high


class _Repairs(Generations):
    def value_of(self, symbols: bytes) -> str:
        return audits.repair(symbols)[1]

    def kept(self, symbols: bytes) -> bool:
        return len(symbols) <= MEMO_ROWS


def repair_rows(rows: list[tuple], repairs) -> tuple:
    """The result of a conversation whose (turn, role, text, blank, open) are in order."""
    report, seen, symbols = Report(), set(), bytearray()
    for turn, role, text, blank, is_open in rows:
        symbols.append(report.row(turn, role, blank, (role, text) in seen, is_open))
        seen.add((role, text))
    for edits, sym, (_, role, text, _, _) in zip(by_row(repairs[bytes(symbols)]), symbols, rows):
        report.edit(edits, sym, role, text)
    return report.close()


def result_batch(convs: list, results: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*results)) if results else [[]] * len(RESULT)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, kind), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])],
        ["conv", *RESULT])


def result_schema(rows: DataFrame) -> str:
    numbers = ", ".join(f"{n} long" for n in RESULT[:6])
    return f"conv {dict(rows.dtypes)['conv']}, {numbers}, audit string, repaired_sha256 string"


def repair_whole(rows: DataFrame) -> DataFrame:
    """Results of conversations that fit a task's memory, each in one partition."""
    def run(batches):
        repairs = worker_memo("repairs", lambda: _Repairs(MEMO_REPAIRS))
        at, group, kind = None, [], None
        for b in slices(batches):
            kind = b.column(0).type
            convs, results = [], []
            for conv, turn, role, text, present, blank, is_open in zip(*(c.to_pylist() for c in b.columns)):
                if at is not None and at[0] != conv:
                    convs.append(at[0])
                    results.append(repair_rows(group, repairs))
                    group = []
                at = (conv,)
                if present:
                    group.append((turn, role, text, blank, is_open))
            yield result_batch(convs, results, kind)
        if at is not None:
            yield result_batch([at[0]], [repair_rows(group, repairs)], kind)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "digest")
    return map_arrow(ordered.select("conv", "turn", "role", "text", "present", "blank", "open"), run, result_schema(rows))


def repair_in_segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Results of conversations of any length, from their rows (all present)."""
    held = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    marks = held.select("conv", "turn", "digest", "uid", F.substring("role", 1, 1).alias("initial"), "blank", "open")
    # The first of equal rows; a partly aggregated minimum, so that no group of equal rows gathers.
    firsts = marks.groupBy("conv", "digest").agg(F.min(F.struct("turn", "uid"))["uid"].alias("uid")).select("uid", F.lit(True).alias("first"))
    place = ["conv", "turn", "digest", "uid"]
    ordered = (marks.join(firsts, "uid", "left").withColumn("duplicate", F.col("first").isNull())
               .repartitionByRange(*place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()))
    kind = dict(rows.dtypes)["conv"]

    def cut(batches):
        at, part, number, held_rows, conv_type = None, None, 0, [], None

        def segment():
            symbols = bytes(s for _, s, _ in held_rows)
            costs, order = audits.segment_costs(symbols)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], conv_type), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([[u for u, _, _ in held_rows]], pa.list_(pa.int64())), pa.array([symbols], pa.binary()),
                 pa.array([bytes(d for _, _, d in held_rows)], pa.binary()),
                 pa.array([costs], pa.list_(pa.int64())), pa.array([order], pa.list_(pa.int32()))],
                ["conv", "part", "segment", "uids", "symbols", "duplicates", "costs", "order"])

        for b in slices(batches):
            conv_type = b.column(0).type
            for conv, uid, initial, blank, is_open, duplicate, p in zip(*(c.to_pylist() for c in b.columns)):
                if held_rows and (at[0] != conv or len(held_rows) == segment_rows):
                    yield segment()
                    number, held_rows = number + 1, []
                at, part = (conv,), p
                must_go = blank or duplicate
                held_rows.append((uid, audits.symbol(initial, must_go, is_open), duplicate))
        if held_rows:
            yield segment()

    segments = stored(map_arrow(
        ordered.select("conv", "uid", "initial", "blank", "open", "duplicate", "part"), cut,
        f"conv {kind}, part int, segment int, uids array<long>, symbols binary, duplicates binary, costs array<long>, order array<int>"),
        "segments")

    def choose(batches):
        at, group = None, []

        def chosen():
            path = audits.choose_path([(c, o) for _, _, c, o in group])
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], pa.int32()), pa.array([g[1] for g in group], pa.int32()),
                 pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32())], ["part", "segment", "start", "end"])

        for b in slices(batches):
            for conv, part, number, costs, order in zip(*(c.to_pylist() for c in b.columns)):
                if at is not None and at[0] != conv:
                    yield chosen()
                    group = []
                at = (conv,)
                group.append((part, number, costs, order))
        if group:
            yield chosen()

    borders = map_arrow(segments.select("conv", "part", "segment", "costs", "order").repartition("conv")
                        .sortWithinPartitions("conv", "part", "segment"), choose, "part int, segment int, start int, end int")

    def edits(batches):
        for b in slices(batches, 16):
            for part, number, uids, symbols, duplicates, start, end in zip(*(c.to_pylist() for c in b.columns)):
                n = len(uids)
                found = list(by_row(audits.segment_edits(symbols, start, end)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array([bool(d) for d in duplicates]), pa.array(found, pa.string())],
                    ["uid", "part", "segment", "at", "duplicate", "edits"])

    edited = map_arrow(segments.join(borders, ["part", "segment"]).select("part", "segment", "uids", "symbols", "duplicates", "start", "end"),
                       edits, "uid long, part int, segment int, at int, duplicate boolean, edits string")

    def report(batches):
        at, current, conv_type = None, None, None
        for b in slices(batches):
            conv_type = b.column(0).type
            for conv, turn, role, text, blank, is_open, duplicate, found in zip(*(c.to_pylist() for c in b.columns)):
                if at is None or at[0] != conv:
                    if current:
                        yield result_batch([at[0]], [current.close()], conv_type)
                    current = Report()
                at = (conv,)
                current.edit(found, current.row(turn, role, blank, duplicate, is_open), role, text)
        if current:
            yield result_batch([at[0]], [current.close()], conv_type)

    last = (held.join(edited, "uid").repartition("conv").sortWithinPartitions("conv", "part", "segment", "at")
            .select("conv", "turn", "role", "text", "blank", "open", "duplicate", "edits"))
    return map_arrow(last, report, result_schema(rows))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", segment_rows: int = SEGMENT_ROWS,
                         whole_chars: int = WHOLE_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (as ``whole`` or ``damage`` gives them): the id, then RESULT."""
    sizes = (rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
             .where((F.col("n") > segment_rows) | (F.col("chars") > whole_chars)).select(F.col("conv").alias("long_conv")))
    long = stored(sizes, "long-conversations")
    is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
    faulty = with_faults(rows)
    out = repair_whole(faulty.join(long, is_long, "left_anti"))
    if not long.isEmpty():
        apart = faulty.join(long, is_long, "left_semi")
        none = apart.groupBy("conv").agg(F.max("present").alias("any")).where(~F.col("any"))
        out = (out.unionByName(repair_in_segments(apart.where("present"), segment_rows))
               .unionByName(repair_whole(apart.join(none.select(F.col("conv").alias("long_conv")), is_long, "left_semi"))))
    return out.withColumnRenamed("conv", conv_col)
