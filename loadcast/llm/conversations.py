"""Operator 11: repair of conversation structure by a streamed dynamic programme.

Rows are dealt out by conversation and sorted by turn. The role initials of a
repaired conversation read ``(s?(ua)+)?``; the cheapest edits that lead there
are found in two passes over the sorted rows, each of which carries its state
across Arrow batches:

* backwards, from the last turn, the cost still to come from each of the four
  states of that pattern. Each row gets one byte: the edit to make next in each
  state, two bits a state. As the costs relative to each other take few
  values, a row costs one look-up.
* forwards, the edits are read off those bytes, the counts are taken and the
  repaired text is hashed (or returned row by row).

Between the passes Spark sorts the rows of its partition once more, without a
shuffle. A sort spills, so a conversation of any length needs memory for its
audit string only: no task holds its rows or its bytes. What marks a row as a
duplicate is ranked by a window that reuses the same partitioning.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from loadcast.llm.workers import map_arrow

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: ASCII white space, as ``\x20\x09-\x0D``.
BLANKS = " \t\n\x0b\f\r"

#: Faults: 0 none, 1 blank, 2 duplicate, 3 truncated. Initials: 0 s, 1 u, 2 a, 3 any other.
#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
FORCED = (2, 2, 3, 2)  # where an inserted or re-roled row leads
NAMES = ("", "", "user", "assistant")
END = (0, 2 * INSERT, INSERT, 0)

#: Edits in the order of their initials, which settles ties.
EDITS = "DIKR"


def step(costs: tuple, initial: int, fault: int):
    """Costs before a row from those after it, less their least, and the byte of the edits to make."""
    late = TRUNCATED if fault == 3 else 0
    options = []
    for state in range(4):
        own = {"D": DELETE + costs[state]}
        if fault not in (1, 2):
            if (state, initial) in NEXT:
                own["K"] = KEEP + late + costs[NEXT[state, initial]]
            own["R"] = REROLE + late + costs[FORCED[state]]
        options.append(own)
    now = [min(own.values()) for own in options]
    for _ in range(3):
        now = [min(cost, INSERT + now[FORCED[state]]) for state, cost in enumerate(now)]
    byte = 0
    for state, own in enumerate(options):
        own["I"] = INSERT + now[FORCED[state]]
        byte |= EDITS.index(next(e for e in EDITS if own.get(e) == now[state])) << 2 * state
    least = min(now)
    return tuple(c - least for c in now), byte


def backwards(batches):
    """Each batch with the column ``edits``; rows come conversation by conversation, last turn first.

    The first columns are conv, present, initial and fault.
    """
    known: dict = {}
    costs, conv = END, object()
    for batch in batches:
        out = bytearray()
        for own, present, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if own != conv:
                conv, costs = own, END
            if not present:
                out.append(0)
                continue
            at = costs, initial, fault
            found = known.get(at)
            if found is None:
                found = known[at] = step(*at)
            costs, byte = found
            out.append(byte)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int16())], [*batch.schema.names, "edits"])


class Walk:
    """One conversation, read from its first turn."""

    def __init__(self, conv, write):
        self.conv, self.write = conv, write
        self.state, self.cost, self.audit = 0, 0, bytearray()
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = self.placed = 0

    def move(self, edit, state, role, text, turn=None):
        self.audit += edit
        self.state = state
        self.write(self.conv, self.placed, turn, role, text, edit)
        self.placed += 1

    def insert(self):
        self.cost += INSERT
        state = FORCED[self.state]
        self.move(b"I", state, NAMES[state], "")

    def row(self, turn, role, text, initial, fault, edits):
        self.counts[fault] += 1
        if self.before is not None and (self.before, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.turns == 0 else self.low
            self.high = self.turn = turn
            self.turns += 1
        while (edit := EDITS[edits >> 2 * self.state & 3]) == "I":
            self.insert()
        if edit == "D":
            self.cost += DELETE
            self.audit += b"D"
            return
        self.cost += TRUNCATED if fault == 3 else 0
        if edit == "K":
            self.move(b"K", NEXT[self.state, initial], role, text, turn)
        else:
            self.cost += REROLE
            state = FORCED[self.state]
            self.move(b"R", state, NAMES[state], text, turn)

    def end(self):
        while END[self.state]:
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, self.audit.decode())


def walks(batches, write):
    """The finished conversations of rows (conv, present, initial, fault, turn, role, text, edits), first turn first."""
    walk = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(8)]
        for conv, present, initial, fault, turn, role, text, edits in zip(*columns, strict=True):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    yield walk
                walk = Walk(conv, write)
            if present:
                walk.row(turn, role, text, initial, fault, edits)
        yield None
    if walk is not None:
        yield walk


REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def report(batches, schema: pa.Schema):
    """One row a conversation; the repaired text goes through a hash as it is read."""
    sha = hashlib.sha256()

    def write(conv, place, turn, role, text, edit):
        sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())

    done = []
    for walk in walks(batches, write):
        if walk is not None:
            done.append((*walk.end(), sha.hexdigest()))
            sha = hashlib.sha256()
        elif done:
            yield batch_of(done, schema)
            done = []
    if done:
        yield batch_of(done, schema)


def rewritten(batches, schema: pa.Schema):
    """The rows of the repaired conversations, numbered from 0 in each."""
    rows = []

    def write(conv, place, turn, role, text, edit):
        rows.append((conv, place, turn, role, text, {b"K": "keep", b"R": "rerole", b"I": "insert"}[edit]))

    for walk in walks(batches, write):
        if walk is not None:
            walk.end()
        elif rows:
            yield batch_of(rows, schema)
            rows.clear()
    if rows:
        yield batch_of(rows, schema)


def marked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """conv, present, initial, fault, turn, role, text and rank among equal rows, dealt out by conversation."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), there.alias("present"),
                      F.col(f"`{turn_col}`").cast("long").alias("turn"),
                      F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))
    first = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    same = Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    ranked = own.repartition("conv").withColumn("rank", F.row_number().over(same))
    fault = (F.when(last == "", 1).when(F.col("rank") > 1, 2)
             .when(~last.isin(".", "!", "?"), 3).otherwise(0))
    return ranked.select("conv", "present", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"),
                         "turn", "role", "text", "rank")


def edited(marks: DataFrame) -> DataFrame:
    """The marked rows with the byte of edits, each conversation in one partition, sorted from its first turn."""
    order = ["role", "text", "rank"]
    last_first = marks.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), *(F.col(c).desc() for c in order))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marks.schema)
    with_edits = map_arrow(last_first, backwards, f"{schema}, edits short")
    sorted_ = with_edits.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), *order)
    return sorted_.select("conv", "present", "initial", "fault", "turn", "role", "text", "edits")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits that mend its structure, and what they cost.

    ``(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.
    A row has one fault: blank (ASCII white space only), duplicate (role and
    text stood earlier in the conversation) or truncated (its last character
    that is no white space is not ``.``, ``!`` or ``?``). Keep is free, a new
    role costs 3, deleting 4 (blank and duplicate rows must go), inserting an
    empty user or assistant row 3; a truncated row that stays adds 3. Of
    equally cheap edits the audit string least in ASCII is taken.

    Turns are integers and read in their order, null turns first; rows of one
    turn in the order of role, then text. Null roles and texts are one space.
    An empty role counts as a foreign one. Null conversation ids are one
    conversation. Rows for which ``present`` is false or null only name their
    conversation; one without other rows gets zeros, an empty audit and the
    hash of nothing. Other columns play no part. An empty table gives no rows.
    """
    kind = dict(rows.dtypes)[conv_col]
    arrow = f"conv {kind}, {REPORT}"
    schema = arrow_schema(rows, arrow)
    found = map_arrow(edited(marked(rows, conv_col, turn_col, role_col, text_col, present)), lambda b: report(b, schema), arrow)
    return found.withColumnRenamed("conv", conv_col)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: ``(conv_col, place, turn, role, text, edit)``.

    ``edit`` is keep, rerole or insert; an inserted row has no turn. Faults,
    ties and nulls are as for ``repair``. A conversation that loses all its
    rows has none here.
    """
    arrow = f"conv {dict(rows.dtypes)[conv_col]}, place long, turn long, role string, text string, edit string"
    schema = arrow_schema(rows, arrow)
    found = map_arrow(edited(marked(rows, conv_col, turn_col, role_col, text_col, present)), lambda b: rewritten(b, schema), arrow)
    return found.withColumnRenamed("conv", conv_col)


def arrow_schema(frame: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
