"""Bounded chunks of ordered records: the greedy cut of a byte budget, without a sequential pass.

Where a block of records is cut depends on one number only: the bytes that the chunk open at
its beginning holds already.  Each block is summed up as a function of that number, a short
table as cuts soon fall together; a source's functions are composed in order, which gives the true number at the
beginning of every block; then all blocks are cut at once.  Blocks are the range partitions of
the ordered records, so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import settle

#: Bytes between two records of a chunk.
SEPARATOR = 1


class Block:
    """The costs of a block's records in order, and how the greedy cut runs through it."""

    def __init__(self, costs: np.ndarray, capacity: int):
        self.capacity, self.ends = capacity, np.cumsum(costs)
        self.begins = self.ends - costs

    def after(self, begin: int) -> int:
        """The record that no longer fits a chunk with ``begin`` bytes before it."""
        return int(np.searchsorted(self.ends, begin + self.capacity, "right"))

    def function(self) -> tuple[int, list[int], list[int], list[int]]:
        """(total, edges, open, cuts): if less than ``edges[k]`` bytes are free (the first such k), the
        block ends with ``open[k]`` bytes in its last chunk and holds ``cuts[k]`` chunk starts."""
        n = len(self.ends)
        following = np.searchsorted(self.ends, self.begins + self.capacity, "right")
        last, cuts = np.arange(n), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                last[i], cuts[i] = last[following[i]], cuts[following[i]] + 1
        # Only a record with at most a chunk's bytes before it in the block can be its first start.
        firsts = int(np.searchsorted(self.begins, self.capacity, "right"))
        total = int(self.ends[-1])
        edges, held, counts = [], [], []
        for i in range(firsts):
            now = (total - int(self.begins[last[i]]), int(cuts[i]))
            if edges and (held[-1], counts[-1]) == now:
                edges[-1] = int(self.ends[i])
            else:
                edges.append(int(self.ends[i]))
                held.append(now[0])
                counts.append(now[1])
        return total, edges, held, counts

    def starts(self, carried: int) -> list[int]:
        """The records that begin a chunk, if the chunk open before the block holds ``carried`` bytes."""
        out, i = [], int(np.searchsorted(self.ends, self.capacity - carried, "right"))
        while i < len(self.ends):
            out.append(i)
            i = self.after(int(self.begins[i]))
        return out


def _sorted_block(table: pa.Table, capacity: int) -> tuple[pa.Table, Block]:
    table = table.sort_by("at")
    return table, Block(table.column("cost").to_numpy().astype(np.int64), capacity)


def plan_chunks(records: DataFrame, source: str, order: list[str], size: Column, budget: int, overhead: int = 0) -> DataFrame:
    """``records`` with ``chunk`` (from 0 in each source) and ``rejected``.

    A source's records are taken in order and a chunk is closed when the next record would take it
    over the budget.  A record costs its size (null: 0) and one separator, a chunk also ``overhead`` bytes (its
    envelope with the longest numbers).  A record that no chunk can hold is rejected: its chunk is null and the others are
    planned without it.  Records that agree in source and order may come in any order; a null source is one of its
    own; columns named like the new ones are replaced.  A task holds one range partition at a time.
    """
    capacity = budget - overhead
    if capacity <= SEPARATOR:
        raise ValueError("the budget does not hold an envelope and a record")
    names = [c for c in records.columns if c not in ("chunk", "rejected")]
    cost = (F.coalesce(size, F.lit(0)) + SEPARATOR).cast("long")
    sized = records.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source}`").alias("source"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], cost.alias("cost"))
    keys = [F.col("source"), *[F.col(f"o{i}") for i in range(len(order))]]
    ranged = sized.where(F.col("cost") <= capacity).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ordered = settle(ranged.select("row", "source", "cost", at.alias("at"))).withColumn("part", F.shiftright("at", 33))
    kind = ordered.schema["source"].dataType

    function = T.StructType([T.StructField("source", kind), *T.StructType.fromDDL("part long, total long, edges array<long>, held array<long>, cuts array<long>").fields])
    entry = T.StructType([T.StructField("source", kind), *T.StructType.fromDDL("part long, carried long, before long").fields])
    planned = T.StructType([ordered.schema["row"], T.StructField("chunk", T.LongType())])

    def summed(table: pa.Table) -> pa.Table:
        table, block = _sorted_block(table, capacity)
        total, edges, held, cuts = block.function()
        one = table.select(["source", "part"]).slice(0, 1)
        for name, value, type_ in (("total", total, pa.int64()), *[(n, v, pa.list_(pa.int64())) for n, v in (("edges", edges), ("held", held), ("cuts", cuts))]):
            one = one.append_column(name, pa.array([value], type_))
        return one

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source_, carried, before, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for value, total, edges, held, cuts in zip(*[batch.column(n).to_pylist() for n in ("source", "total", "edges", "held", "cuts")], strict=True):
                if not begun or value != source_:
                    # A full chunk before the first block: its first record begins a chunk.
                    source_, carried, before, begun = value, capacity, 0, True
                out.append((carried, before))
                k = int(np.searchsorted(np.array(edges), capacity - carried, "right"))
                if k == len(edges):
                    carried += total
                else:
                    carried, before = held[k], before + cuts[k]
            extra = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("part"), *extra], names=entry.names)

    def cut(table: pa.Table) -> pa.Table:
        table, block = _sorted_block(table, capacity)
        marks = np.zeros(len(table), np.int64)
        marks[block.starts(table.column("carried")[0].as_py())] = 1
        chunk = np.cumsum(marks) + table.column("before")[0].as_py() - 1
        return table.select(["row"]).append_column("chunk", pa.array(chunk, pa.int64()))

    blocks = ordered.select("source", "part", "at", "cost").groupBy("source", "part").applyInArrow(summed, function)
    entries = blocks.repartition("source").sortWithinPartitions("source", "part").mapInArrow(chained, entry)
    entries = settle(entries).select(F.col("source").alias("s"), F.col("part").alias("p"), "carried", "before")
    told = ordered.join(entries, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    done = told.select("row", "source", "part", "at", "cost", "carried", "before").groupBy("source", "part").applyInArrow(cut, planned)
    kept = done.select("row.*", "chunk", F.lit(False).alias("rejected"))
    refused = sized.where(F.col("cost") > capacity).select("row.*", F.lit(None).cast("long").alias("chunk"), F.lit(True).alias("rejected"))
    return kept.unionByName(refused)
