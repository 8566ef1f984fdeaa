"""Repair of conversation structure by a lazily determinised weighted automaton.

Roles of a whole conversation read ``(s?(ua)+)?``.  Keeping, re-roling, deleting and inserting turns
are weighted arcs of a small nondeterministic automaton.  Its determinised form, read from the last
turn to the first, has as states vectors of the costs that the rest of the conversation takes
from each point of the pattern, less their least; states are made when first met and cached
in a transition table, so the scan that gives the costs is one table look-up a turn.  A trace
back, from the first turn to the last, follows arcs that are tight under those costs and takes
the least letter at each step: the audit.

A conversation's turns stream through one task in sorted order, because the digest of the
repaired text is sequential; memory does not grow with the conversation, but for its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, hash128, small_batches
from .resample import CRC_TABLE_SQL, crc32_sql

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Points of the pattern: nothing yet, after s, after u, after a.  The turn that each expects, and where that leads.
POINTS = range(4)
EXPECTS, LEADS = "uuau", (2, 2, 3, 2)
FULL = {"u": "user", "a": "assistant"}
#: Faults of a turn by number.
FAULTS = ("", "blank", "duplicate", "truncated")
#: Role initials that the pattern knows, by number.
INITIALS = ("", "u", "a", "s")


def symbol(fault: Column, initial: Column) -> Column:
    """What the automaton reads of a turn: 0 if it must go, else 1 to 8 by initial and truncation."""
    known = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(0)
    return F.when(fault.isin(1, 2), 0).otherwise(1 + 2 * known + F.when(fault == 3, 1).otherwise(0)).cast("int")


class Repairer:
    """The determinised automaton.  A state is a cost vector, packed into one int, a byte a point."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._normal(self._close([0, 99, 99, 0]))

    @staticmethod
    def _close(costs: list[int]) -> list[int]:
        """Costs with insertions: two rounds, as no cheapest repair inserts three turns in a row."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[LEADS[q]]) for q, c in enumerate(costs)]
        return costs

    @staticmethod
    def _normal(costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        return int.from_bytes(bytes(c - least for c in costs), "big"), least

    @staticmethod
    def arcs(point: int, read: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next point) of the edits that use up a turn, letters ascending."""
        found = [("D", DELETE, point)]
        if read:
            initial, extra = INITIALS[(read - 1) // 2], TRUNCATED * ((read - 1) % 2)
            if initial == EXPECTS[point]:
                found.append(("K", extra, LEADS[point]))
            elif initial == "s" and point == 0:
                found.append(("K", extra, 1))
            found.append(("R", REROLE + extra, LEADS[point]))
        return found

    def _before(self, after: int, read: int) -> list[int]:
        rest = after.to_bytes(4, "big")
        return self._close([min(cost + rest[to] for _, cost, to in self.arcs(q, read)) for q in POINTS])

    def step(self, after: int, read: int) -> tuple[int, int]:
        """The state before a turn and what its normalisation took off."""
        found = self.steps.get((after, read))
        if found is None:
            found = self.steps[after, read] = self._normal(self._before(after, read))
        return found

    def trace(self, point: int, read: int, after: int) -> tuple[str, int]:
        """The least letters of tight arcs from ``point`` over one turn, and the point after it."""
        found = self.traces.get((point, read, after))
        if found is None:
            costs, rest, letters, at = self._before(after, read), after.to_bytes(4, "big"), "", point
            while not letters or letters[-1] == "I":
                tight = [(letter, to) for letter, cost, to in self.arcs(at, read) if cost + rest[to] == costs[at]]
                if INSERT + costs[LEADS[at]] == costs[at]:
                    tight.append(("I", LEADS[at]))
                letter, at = min(tight)
                letters += letter
            found = self.traces[point, read, after] = letters, at
        return found


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's.

    Nulls of role, text and in that key count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(blank("role"))
    left = conversations.withColumn("what", what).where("what <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1)))
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_EDITS = "turn long, step long, edit string, fault string, cost int, was string, role string, text string"


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of each conversation, in order: (conv_id, turn, step, edit, fault, cost, was, role, text).

    ``edit`` is K, R, D or I (keep, re-role, delete, insert); of equally cheap repairs the one whose
    letters come first in ASCII order.  ``was`` is the role before, ``role`` the one after; a
    deleted turn keeps its role and text, an inserted one has empty text and a null turn.

    Turns are read by turn number, nulls first, then by role and text (UTF-8 order).  A turn's
    first fault counts: blank (only ASCII blanks), duplicate (role and text of an earlier turn),
    truncated (last other character not ``.!?``).  Null role or text counts as one space.  A null
    conversation id is a conversation of its own; an empty table gives an empty table; other
    columns are left out.  Output is in order within each conversation and within its task.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    small_batches(rows.sparkSession)
    # One shuffle: the window and both sorts reuse the partitioning by conversation.
    h1, h2 = hash128(F.col("text"))
    same = Window.partitionBy("conv_id", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.withColumns({"h1": h1, "h2": h2}).repartition("conv_id").withColumn("seen", F.row_number().over(same)).drop("h1", "h2")
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(F.col("seen") > 1, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    read = dealt.withColumn("fault", fault.cast("int"))
    read = read.withColumn("symbol", symbol(F.col("fault"), F.left("role", F.lit(1))))
    down = [F.col("conv_id").asc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("seen").desc()]
    up = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("seen").asc()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last turn to the first: the state after each turn, and which turn is the last."""
        machine, state, held = Repairer(), 0, object()
        for batch in batches:
            after, last = [], []
            for conv, sign in zip(batch.column("conv_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True):
                last.append(conv != held)
                if conv != held:
                    state, held = machine.end, conv
                after.append(state)
                state = machine.step(state, sign)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.int64()), pa.array(last)], names=[*batch.schema.names, "after", "last"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the first turn to the last: the edits."""
        machine, point, step = Repairer(), 0, 0
        for batch in batches:
            at, edits, steps, costs, roles = [], [], [], [], []
            was = batch.column("role").to_pylist()
            columns = (batch.column(n).to_pylist() for n in ("symbol", "after", "last"))
            for i, (sign, after, last) in enumerate(zip(*columns, strict=True)):
                letters, to = machine.trace(point, sign, after)
                here = point
                for letter in letters:
                    at.append(None if letter == "I" else i)
                    roles.append(was[i] if letter in "KD" else FULL[EXPECTS[here]])
                    extra = TRUNCATED * (sign > 0 and (sign - 1) % 2)
                    costs.append({"I": INSERT, "D": DELETE, "K": extra, "R": REROLE + extra}[letter])
                    here = LEADS[here] if letter in "IR" else here
                    step += 1
                    steps.append(step)
                edits += letters
                point = to
                if last:
                    while point in (1, 2):
                        at.append(None)
                        roles.append(FULL[EXPECTS[point]])
                        costs.append(INSERT)
                        edits.append("I")
                        step, point = step + 1, LEADS[point]
                        steps.append(step)
                    # An insertion belongs to the conversation of the turn beside it.
                    point, step = 0, 0
            beside, row = [], 0
            for i in at:
                row = row if i is None else i
                beside.append(row)
            yield _edits(batch, at, beside, edits, steps, costs, roles)

    def _edits(batch: pa.RecordBatch, at: list, beside: list, edits: list, steps: list, costs: list, roles: list) -> pa.RecordBatch:
        rows_at = pa.array(at, pa.int64())
        text = pc.fill_null(batch.column("text").take(rows_at), "")
        faults = pa.array(FAULTS).take(pc.fill_null(batch.column("fault").take(rows_at), 0))
        parts = [batch.column("conv_id").take(pa.array(beside, pa.int64())), batch.column("turn").take(rows_at), pa.array(steps, pa.int64()), pa.array(edits, pa.string())]
        parts += [faults, pa.array(costs, pa.int32()), pc.fill_null(batch.column("role").take(rows_at), ""), pa.array(roles, pa.string()), text]
        return pa.RecordBatch.from_arrays(parts, names=[f.name for f in edits_schema])

    scanned_schema = T.StructType([*read.schema.fields, T.StructField("after", T.LongType()), T.StructField("last", T.BooleanType())])
    edits_schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_EDITS).fields])
    scanned = read.sortWithinPartitions(*down).mapInArrow(scan, scanned_schema)
    return scanned.sortWithinPartitions(*up).mapInArrow(trace, edits_schema)


def summarise(edits: DataFrame, in_order: bool = False) -> DataFrame:
    """One row for each conversation of ``repair``'s edits: gaps, faults, cost, audit and the digest of the repaired text.

    ``gaps`` counts turn numbers missing between the least and the greatest; ``illegal`` adjacent
    turns, as they were, whose role initials are not su, ua or au.  Set ``in_order`` for rows that come straight from
    ``repair``; others are dealt by conversation and sorted first.
    """
    if not in_order:
        edits = edits.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    schema = T.StructType([edits.schema["conv_id"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    class Told:
        def __init__(self, conv):
            self.conv, self.counts, self.illegal, self.cost, self.audit = conv, dict.fromkeys(FAULTS, 0), 0, 0, []
            self.digest, self.lines, self.initial = hashlib.sha256(), 0, None
            self.low = self.high = None
            self.turns = 0

        def add(self, turn, edit, fault, cost, was, role, text) -> None:
            self.audit.append(edit)
            self.cost += cost
            self.counts[fault] += 1
            if edit != "I":
                if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                    self.illegal += 1
                self.initial = was[:1]
                if turn is not None and turn != self.high:
                    self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if edit != "D":
                self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.lines += 1

        def row(self) -> tuple:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, *[self.counts[f] for f in FAULTS[1:]], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, arrow = None, None
        for batch in batches:
            arrow = arrow or pa.schema([pa.field(f.name, batch.schema.field(0).type if f.name == "conv_id" else pa.string() if f.dataType == T.StringType() else pa.int64()) for f in schema])
            done = []
            for conv, turn, step, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if step == 1:
                    if told:
                        done.append(told.row())
                    told = Told(conv)
                told.add(turn, *rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(told.row(), arrow, strict=True)], schema=arrow)

    return edits.mapInArrow(run, schema)


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = summarise(repair(damage(rows)), in_order=True)
    # Conversations that lost all their rows come back with zeros.
    every = rows.select(F.col("conv_id").alias("every")).distinct().join(told, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    counts = [zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _options_sql(point: int) -> str:
    """The cheapest (cost, audit, text) of one turn and the rest from a point, no insertion before the turn."""
    letter, to = EXPECTS[point], LEADS[point] + 1
    line = lambda role: f"chr(10) || {role} || ':' || r.text || f.best[{{}}].t"
    made = [f"{{'c': f.best[{point + 1}].c + {DELETE}, 'a': 'D' || f.best[{point + 1}].a, 't': f.best[{point + 1}].t}}"]
    keep = lambda at: f"{{'c': f.best[{at}].c + r.extra, 'a': 'K' || f.best[{at}].a, 't': {line('r.role').format(at)}}}"
    made.append(f"CASE WHEN r.stays AND r.initial = '{letter}' THEN {keep(to)} END")
    if point == 0:
        made.append(f"CASE WHEN r.stays AND r.initial = 's' THEN {keep(2)} END")
    name = f"'{FULL[letter]}'"
    made.append(f"CASE WHEN r.stays THEN {{'c': f.best[{to}].c + {REROLE} + r.extra, 'a': 'R' || f.best[{to}].a, 't': {line(name).format(to)}}} END")
    return f"list_min(list_filter([{', '.join(made)}], lambda x: x IS NOT NULL))"


def _insert_sql(rest: str, point: int) -> str:
    return f"{{'c': {rest}.c + {INSERT}, 'a': 'I' || {rest}.a, 't': chr(10) || '{FULL[EXPECTS[point]]}:' || {rest}.t}}"


#: The same rows in DuckDB: the best repair of every suffix of a conversation, from its last turn to its first.
OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL}, marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE what <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, count(*) OVER (PARTITION BY conv_id) AS size,
         left(role, 1) AS initial, rtrim(text, {_BLANK_SQL}) AS bare
  FROM damaged
), told AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair
  FROM numbered
), turns AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM told
), suffixes AS (
  SELECT DISTINCT conv_id, size AS done,
         [{{'c': 0, 'a': '', 't': ''}},
          {{'c': {2 * INSERT}, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}},
          {{'c': {INSERT}, 'a': 'I', 't': chr(10) || 'assistant:'}},
          {{'c': 0, 'a': '', 't': ''}}] AS best
  FROM turns
  UNION ALL
  SELECT conv_id, done, [list_min([own[1], {_insert_sql("u", 0)}]), list_min([own[2], {_insert_sql("u", 1)}]), u, list_min([own[4], {_insert_sql("own[3]", 3)}])]
  FROM (
    SELECT *, list_min([own[3], {_insert_sql("own[4]", 2)}]) AS u
    FROM (
      SELECT f.conv_id, f.done - 1 AS done, [{", ".join(_options_sql(q) for q in POINTS)}] AS own
      FROM suffixes f JOIN turns r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.n = f.done
    )
  )
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(s.best[1].c, 0)::BIGINT AS cost,
       coalesce(s.best[1].a, '') AS audit, sha256(coalesce(substr(s.best[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN suffixes s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.done = 0
"""
