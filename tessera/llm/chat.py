"""Transcript parsing and canonical chat rendering.

Who speaks is recovered by a hidden Markov model over the lines of a conversation.  States are
(role, begins a turn) and (role, goes on); a line shows its speaker marker, whether a gap comes
before it, its length and a few signs of its kind.  Transition and emission tables are counted
on a bounded sample of labelled turns, on top of fixed prior counts for markers, which the
training rows may lack.  Viterbi runs over blocks of turns: each block is one max-plus matrix,
blocks of blocks likewise, so a conversation of any length is decoded without gathering it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Bound of the labelled sample, in turns; turns of one block; children of one matrix.
MAX_TURNS, BLOCK, FAN = 20_000, 64, 64
#: Bits that count the blocks of one partition.
BLOCK_BITS = 24
#: Speaker names that a marker may use, by role.
NAMES = {
    "system": ("system", "instruction", "instructions", "sys"),
    "user": ("user", "human", "customer", "client", "me", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(r"^[\s#*>\[(<|]{0,8}(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")[\s\])>|*]{0,6}(?::[\s*]*|\|?>\s*|\]\s*|\s-\s|$)", re.IGNORECASE)
_FEATURES = {"marker": 4, "gap": 2, "length": 7, "sign": 5}
#: Prior counts of a marker on a line that begins a turn of its own role, of another role, of none.
_MARKER_PRIOR = (40.0, 0.2, 60.0)


def line_features(line: str, gap: bool) -> tuple[int, int, int, int]:
    """(marker, gap, length, sign) as small integers."""
    found = MARKER.match(line)
    marker = 1 + ROLES.index(_ROLE_OF[found[1].lower()]) if found else 0
    body = line[found.end() :] if found else line
    length = min(6, int(np.log2(1 + len(body) / 16)))
    sign = 1 if body.rstrip().endswith("?") else 2 if re.match(r"\s*(?:[-*+]|\d+[.)])\s", body) else 3 if body.startswith(("```", "    ")) else 4 if not body.strip() else 0
    return marker, int(gap), length, sign


def turn_features(text: str | None) -> list[tuple[int, int, int, int]]:
    """One feature tuple for each line of a turn; its first line comes after a gap."""
    lines = (text or "").split("\n")
    return [line_features(line, i == 0 or not lines[i - 1].strip()) for i, line in enumerate(lines)]


def fit(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> dict:
    """Start, transition and emission log tables from at most MAX_TURNS labelled turns.

    Conversations are taken in the order of a hash of their id; turns of other roles are left
    out.  Without labelled turns the prior counts alone decide.
    """
    known = conversations.where(F.col(role_col).isin(*ROLES) & F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    # The sample is bounded by MAX_TURNS; its texts are measured before they reach the driver.
    sample = known.select(F.xxhash64(conv_col).alias("h"), F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("text"))
    sample = sample.orderBy("h", "c", "t", "r", F.xxhash64("text")).limit(MAX_TURNS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.array([[list(f) for f in turn_features(t.as_py())] for t in batch.column("text")], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("h", "c", "t", "r")] + [lines], names=["h", "c", "t", "r", "lines"])

    kind = known.schema[conv_col].dataType
    measured = sample.mapInArrow(measure, T.StructType().add("h", "long").add("c", kind).add("t", known.schema[turn_col].dataType).add("r", "string").add("lines", T.ArrayType(T.ArrayType(T.IntegerType()))))
    n = len(STATES)
    start, step = np.ones(n), np.ones((n, n)) * 0.5
    emit = {f: np.ones((n, size)) * 0.5 for f, size in _FEATURES.items()}
    for s, (role, begins) in enumerate(STATES):
        own, other, none = _MARKER_PRIOR if begins else (0.1, 0.1, 60.0)
        emit["marker"][s] += [none, *[own if r == role else other for r in ROLES]]
        emit["gap"][s] += [0.5, 20.0] if begins else [20.0, 4.0]
        start[s] += 5.0 if begins else 0.0
        for to, (_, starts) in enumerate(STATES):
            # A line that goes on stays with its role.
            step[s, to] = 1e-6 if not starts and STATES[to][0] != role else step[s, to] + 1.0
    conversation = before = None
    for r in sorted(measured.collect(), key=lambda r: (r.h, str(r.c), r.t, r.r)):
        if (r.h, r.c) != conversation:
            conversation, before = (r.h, r.c), None
        for i, line in enumerate(r.lines):
            now = STATES.index((r.r, i == 0))
            for (_, table), value in zip(emit.items(), line, strict=True):
                table[now, value] += 1
            if before is None:
                start[now] += 1
            else:
                step[before, now] += 1
            before = now
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).tolist()
    return {"start": log(start), "step": log(step), "emit": {f: log(t) for f, t in emit.items()}}


class Decoder:
    """Viterbi in max-plus form.  A matrix holds, for each state before and each last state, the best score."""

    def __init__(self, model: dict):
        self.start, self.step = np.array(model["start"]), np.array(model["step"])
        self.emit = [np.array(model["emit"][f]) for f in _FEATURES]

    def scores(self, features: list) -> np.ndarray:
        """One row for each line, one column for each state."""
        at = np.array(features, np.int64).reshape(-1, len(self.emit))
        return sum(table[:, at[:, k]].T for k, table in enumerate(self.emit))

    def lines(self, scores: np.ndarray) -> list[np.ndarray]:
        """One matrix a line; the last row stands for the state before a conversation."""
        moves = np.vstack([np.hstack([self.step, np.full((len(STATES), 1), -np.inf)]), np.append(self.start, -np.inf)])
        return [moves + np.append(row, -np.inf)[None, :] for row in scores]

    @staticmethod
    def product(matrices: list[np.ndarray]) -> np.ndarray:
        out = matrices[0]
        for m in matrices[1:]:
            out = (out[:, :, None] + m[None, :, :]).max(axis=1)
        return out

    @staticmethod
    def route(matrices: list[np.ndarray], first: np.ndarray, last: int | None) -> list[int]:
        """The last state of each matrix on the best path from ``first`` (scores of the states
        before) to ``last`` (any if None); ties go to the lowest state."""
        score, back = first, []
        for m in matrices:
            total = score[:, None] + m
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        state = int(score.argmax()) if last is None else last
        path = [state]
        for b in reversed(back[1:]):
            state = int(b[state])
            path.append(state)
        return path[::-1]

    def entry(self, before: int | None) -> np.ndarray:
        """Scores of the states before a block; None stands for the start of a conversation."""
        only = np.full(len(STATES) + 1, -np.inf)
        only[len(STATES) if before is None else before] = 0.0
        return only


def _pieces(text: str, states: list[int]) -> list[tuple[str, str]]:
    """(role, body) of each recovered turn in one row's lines, markers removed."""
    out: list[tuple[str, list[str]]] = []
    for i, (line, state) in enumerate(zip((text or "").split("\n"), states, strict=True)):
        role, begins = STATES[state]
        found = MARKER.match(line)
        own = found and _ROLE_OF[found[1].lower()] == role
        if i == 0 or role != out[-1][0] or (begins and own):
            out.append((role, []))
        out[-1][1].append(line[found.end() :] if own else line)
    return [(role, "\n".join(lines).strip("\n")) for role, lines in out]


def render(role: str, body: str) -> str:
    """One canonical turn; delimiters inside the body are broken up."""
    return f"<|{role}|>\n{body.replace('<|', '< |')}\n<|end|>\n"


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows``, sorted over and within partitions, with ``b0``: blocks of at most BLOCK rows of one conversation.

    Numbers rise along the order: the partition comes first, then a count inside it, so neither a
    hot conversation nor rows without a turn or an id make a larger block.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, before = (TaskContext.get().partitionId() << BLOCK_BITS) - 1, BLOCK, None
        for batch in batches:
            blocks = []
            for conv in batch.column("conv").to_pylist():
                if filled == BLOCK or conv != before:
                    block, filled, before = block + 1, 0, conv
                filled += 1
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "b0"])

    return rows.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("b0", T.LongType())]))


def parse(conversations: DataFrame, model: dict, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, part, role, text, rendered): one row for each recovered turn.

    Roles come from the lines alone.  Rows of a conversation are ordered by turn (null last),
    then by a hash of their text; rows with one conv_id, null too, are one conversation.  A null or
    empty text is one empty line.  A row whose lines change speaker gives several parts.
    """
    conv, turn = conversations.schema[conv_col].dataType, conversations.schema[turn_col].dataType
    said = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("tie"), F.col("luck")]
    # Equal rows are interchangeable: they may be dealt over several ranges.
    sorted_rows = said.withColumns({"tie": F.xxhash64("text"), "luck": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(_in_blocks(sorted_rows.drop("luck")))

    def ordered(table: pa.Table) -> tuple[list, list]:
        turns, ties = table.column("turn").to_pylist(), table.column("tie").to_pylist()
        order = sorted(range(len(turns)), key=lambda i: (turns[i] is None, turns[i] if turns[i] is not None else 0, ties[i]))
        texts = table.column("text").to_pylist()
        return [turns[i] for i in order], [texts[i] for i in order]

    def matrix(key: tuple, table: pa.Table) -> pa.Table:
        decoder = Decoder(model)
        _, texts = ordered(table)
        made = decoder.product(decoder.lines(decoder.scores([f for t in texts for f in turn_features(t)])))
        return pa.table({"conv": pa.array([key[0].as_py()], table.schema.field("conv").type), "b": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([made.tobytes()], pa.binary())})

    level_type = T.StructType().add("conv", conv).add("b", "long").add("m", "binary")
    levels = [settle(rows.groupBy("conv", "b0").applyInArrow(matrix, level_type))]

    def join_up(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("b").to_numpy())
        ms = [np.frombuffer(m, np.float64).reshape(len(STATES) + 1, -1) for m in table.column("m").to_pylist()]
        return pa.table({"conv": pa.array([key[0].as_py()], table.schema.field("conv").type), "b": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([Decoder.product([ms[i] for i in order]).tobytes()], pa.binary())})

    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > FAN:
        levels.append(settle(levels[-1].groupBy("conv", F.floor(F.col("b") / FAN).alias("up")).applyInArrow(join_up, level_type)))

    state_type = T.StructType().add("conv", conv).add("b", "long").add("before", "integer").add("last", "integer")

    def decode(key: tuple, table: pa.Table) -> pa.Table:
        """Boundary states of the children, from their parent's (whole conversations at the top)."""
        decoder = Decoder(model)
        bs = table.column("b").to_numpy()
        order = np.argsort(bs)
        ms = [np.frombuffer(table.column("m")[int(i)].as_py(), np.float64).reshape(len(STATES) + 1, -1) for i in order]
        before = table.column("before")[0].as_py() if "before" in table.column_names else None
        last = table.column("last")[0].as_py() if "last" in table.column_names else None
        path = decoder.route(ms, decoder.entry(before), last)
        befores = [before, *path[:-1]]
        return pa.table({"conv": pa.array([key[0].as_py()] * len(path), table.schema.field("conv").type), "b": pa.array(bs[order], pa.int64()), "before": pa.array(befores, pa.int32()), "last": pa.array(path, pa.int32())})

    known = settle(levels[-1].groupBy("conv").applyInArrow(decode, state_type))
    for level in reversed(levels[:-1]):
        parents = known.select(F.col("conv").alias("c"), F.col("b").alias("up"), "before", "last")
        children = level.withColumn("up", F.floor(F.col("b") / FAN)).alias("x")
        joined = children.join(parents.alias("y"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("x.up") == F.col("y.up"))).select("conv", F.col("x.up").alias("up"), "b", "m", "before", "last")
        known = settle(joined.groupBy("conv", "up").applyInArrow(decode, state_type))

    out_type = T.StructType().add("conv", conv).add("turn", turn).add("part", "integer").add("role", "string").add("text", "string").add("rendered", "string")

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        decoder = Decoder(model)
        turns, texts = ordered(table)
        features = [turn_features(t) for t in texts]
        path = decoder.route(decoder.lines(decoder.scores([f for t in features for f in t])), decoder.entry(table.column("before")[0].as_py()), table.column("last")[0].as_py())
        out, at = [], 0
        for turn_, text, lines in zip(turns, texts, features, strict=True):
            for part, (role, body) in enumerate(_pieces(text, path[at : at + len(lines)])):
                out.append((key[0].as_py(), turn_, part, role, body, render(role, body)))
            at += len(lines)
        kinds = [table.schema.field("conv").type, table.schema.field("turn").type, pa.int32(), pa.string(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "turn", "part", "role", "text", "rendered"])

    ends = known.select(F.col("conv").alias("c"), F.col("b").alias("kb"), "before", "last")
    ready = rows.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("b0") == F.col("kb"))).select("conv", "b0", "turn", "text", "tie", "before", "last")
    return ready.groupBy("conv", "b0").applyInArrow(tell, out_type).withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    held_out = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = fit(turns.where(~held_out))
    return parse(turns.drop("role"), model)
