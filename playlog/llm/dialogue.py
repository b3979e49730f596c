"""Repair of the turn order of conversations, by a lazily determinised weighted automaton.

A conversation is right when the first letters of its roles read ``(s?(ua)+)?``.  Four states say what may come next.
A row may be kept (K, 0), given the role that is due (R, 3) or deleted (D, 4); an empty row of the role that is due may be
inserted anywhere (I, 3).  Blank and repeated rows must be deleted; a truncated row that stays costs 3 more.

The cost of repairing the rest of a conversation from each of the four states is a vector.  Vectors less their minimum are few
(inserting bounds their differences), so they are the states of a deterministic automaton, found as rows ask for them and
kept in a transition table.  Rows are scanned once from the last to the first with that table: the sum of what was taken off is the
cost.  The edits are then read off against the scan, first row first, along arcs that lose nothing; where several do, the least
letter is taken, which gives the ASCII-least of the cheapest edit strings.

Rows move once, by conversation.  Each pass reads a partition as a stream after a local sort, which spills: a task holds one batch,
however long a conversation is.  (A conversation stays with one task: the digest of its repaired text is sequential anyway.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.common import trimmed

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. Per state: the letter that is due, the letters that may come with the state they lead to.
DUE = "uuau"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
#: Cost of the end of a conversation: what must be inserted.
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]
Symbol = tuple[str, str]  # first letter of the role, fault


@cache
def _costs(rest: Vector, symbol: Symbol) -> Vector:
    """Cheapest cost from each state before a row, with rest the costs after it."""
    letter, fault = symbol
    more = TRUNCATED if fault == "truncated" else 0
    best = [DELETE + c for c in rest]
    if fault not in ("blank", "duplicate"):
        for q in range(4):
            best[q] = min(best[q], REROLE + more + rest[NEXT[q][DUE[q]]], *([more + rest[NEXT[q][letter]]] if letter in NEXT[q] else []))
    for _ in range(3):  # inserts before the row, three at most: longer chains pass a state twice
        best = [min(best[q], INSERT + best[NEXT[q][DUE[q]]]) for q in range(4)]
    return tuple(best)


@cache
def step(rest: Vector, symbol: Symbol) -> tuple[Vector, int]:
    """The transition table: the normalised vector before a row and what was taken off."""
    best = _costs(rest, symbol)
    return tuple(c - min(best) for c in best), min(best)


@cache
def edits(rest: Vector, symbol: Symbol, state: int) -> tuple[str, int]:
    """The least letters of edits up to and with a row that lose nothing, and the state after it."""
    letter, fault = symbol
    best, done = _costs(rest, symbol), ""
    more = TRUNCATED if fault == "truncated" else 0
    while True:
        due = NEXT[state][DUE[state]]
        if best[state] == DELETE + rest[state]:
            return done + "D", state
        if best[state] == INSERT + best[due]:
            done, state = done + "I", due
        elif letter in NEXT[state] and best[state] == more + rest[NEXT[state][letter]]:
            return done + "K", NEXT[state][letter]
        else:
            return done + "R", due


def closing(state: int) -> int:
    """Rows to insert at the end."""
    return END[state] // INSERT


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): rows dealt by conversation, each with its first fault.

    blank: no character but blanks and \\x09-\\x0D; duplicate: role and text seen earlier in the conversation; truncated: the last
    other character is not one of ``.!?``.  A null role or text is one blank.  Rows go by turn, nulls first, then role and text;
    a null conv_id is a conversation.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.withColumn("fault", F.when(blank, "blank").when(again, "duplicate").when(cut, "truncated").otherwise("none"))


def _rows(stream: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in stream:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about limit characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_COLUMNS = ("conv_id", "turn", "role", "text", "fault")
_SCAN = "conv_id {id}, turn long, role string, text string, fault string, after array<int>, togo long, left long"
_REPAIR = "conv_id {id}, place long, edit string, turn long, role string, text string, old_role string, fault string, cost long"


def _schema(text: str, kind: str) -> tuple[str, pa.Schema]:
    names = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    whole = text.format(id=kind)
    return whole, pa.schema([(n, names[t]) for n, t in (c.split(" ") for c in whole.split(", "))])


def scanned(rows: DataFrame) -> DataFrame:
    """marked() rows with the normalised vector after each (after), the cost of the conversation from it on (togo) and the rows that follow (left)."""
    spark_schema, schema = _schema(_SCAN, dict(rows.dtypes)["conv_id"].replace("bigint", "long"))

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(_rows(stream, _COLUMNS), key=lambda r: r[0]):
                vector, taken = END, 0
                for left, row in enumerate(group):
                    after = vector
                    vector, off = step(vector, (row[2][:1], row[4]))
                    taken += off
                    yield *row, list(after), taken + vector[0], left

        yield from _batches(each(), schema)

    ordered = rows.select(*_COLUMNS).sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc(F.col("fault") == "duplicate"))
    return ordered.mapInArrow(trimmed(scan), spark_schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text, old_role, fault, cost), one row an edit, in order within their partitions.

    edit is K, R, D or I; place counts the edits of a conversation from 0; cost is that of the whole conversation by the scan.
    Deleted rows are among them (edit D); inserted rows have no turn and no old_role.  An empty table gives no rows; other columns are not read.
    """
    found = scanned(marked(rows))
    spark_schema, schema = _schema(_REPAIR, dict(found.dtypes)["conv_id"].replace("bigint", "long"))

    def trace(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv, group in groupby(_rows(stream, (*_COLUMNS, "after", "togo")), key=lambda r: r[0]):
                state, place, cost = 0, 0, None
                for _, turn, role, text, fault, after, togo in group:
                    cost = togo if cost is None else cost
                    letters, end = edits(tuple(after), (role[:1], fault), state)
                    for letter in letters:
                        due = DUE[state]
                        if letter == "I":
                            yield conv, place, "I", None, ROLE[due], "", None, "none", cost
                            state = NEXT[state][due]
                        else:
                            yield conv, place, letter, turn, ROLE[due] if letter == "R" else role, text, role, fault, cost
                        place += 1
                    state = end
                for _ in range(closing(state)):
                    yield conv, place, "I", None, ROLE[DUE[state]], "", None, "none", cost
                    state, place = NEXT[state][DUE[state]], place + 1

        yield from _batches(each(), schema)

    return found.sortWithinPartitions("conv_id", F.desc("left")).mapInArrow(trimmed(trace), spark_schema)


_SUMMARY = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation of rows: gaps in its turns, faults, illegal neighbours, cost, audit and the digest of the repaired ``role:text`` lines."""
    done = repair(rows)
    spark_schema, schema = _schema(_SUMMARY, dict(done.dtypes)["conv_id"].replace("bigint", "long"))

    def sum_up(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("conv_id", "edit", "turn", "role", "text", "old_role", "fault", "cost")

        def each() -> Iterator[tuple]:
            for conv, group in groupby(_rows(stream, columns), key=lambda r: r[0]):
                faults, illegal, audit, digest = dict.fromkeys(("blank", "duplicate", "truncated", "none"), 0), 0, [], hashlib.sha256()
                low = high = before = letter = None
                turns, some, total = 0, False, 0
                for _, edit, turn, role, text, old, fault, cost in group:
                    audit.append(edit)
                    total = cost
                    if edit != "D":
                        digest.update(f"{'\n' if some else ''}{role}:{text}".encode("utf-8"))
                        some = True
                    if edit == "I":
                        continue
                    faults[fault] += 1
                    illegal += letter is not None and letter + old[:1] not in ("su", "ua", "au")
                    letter = old[:1]
                    if turn is not None:
                        low, high, turns = turn if low is None else low, turn, turns + (turn != before)
                        before = turn
                gaps = 0 if low is None else high - low + 1 - turns
                yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, total, "".join(audit), digest.hexdigest()

        yield from _batches(each(), schema)

    return done.mapInArrow(trimmed(sum_up), spark_schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults of the benchmark, by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("__kind")).where("__kind <> 0")
    kind = F.col("__kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))))
    return rows.drop("col")


def restored(rows: DataFrame) -> DataFrame:
    """summaries() of the damaged rows, with a row for every conversation that rows name; one without rows after damage has zeros, no edits and the digest of nothing."""
    found = summaries(damaged(rows)).withColumnRenamed("conv_id", "__id")
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
