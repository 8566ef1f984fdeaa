"""Near-duplicate vectors by p-stable hashing with exact cosine checks.

Vectors compare only inside one label.  Equal vectors form a class first, so copies are one
node.  Normalised vectors go to TABLES buckets each: DEPTH Gaussian projections, shifted and cut
into steps of WIDTH.  The depth grows with the logarithm of the largest label so that buckets
stay small, and the tables follow so that a pair at the threshold is found with a probability of
RECALL.  A bucket is cut into blocks of about BLOCK vectors and blocks meet pairwise as matrix
products, in double precision; only link counts and a spanning star of each block's linked
groups leave a task, never pairs.  A pair counts in the first table in which it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash128, pack, settle, unpack
from .components import components

COSINE = 0.93
WIDTH = 3.0
RECALL = 0.998
#: Vectors of other groups that a bucket may hold by chance, about.
CHANCE = 64
BLOCK = 1024
SEED = 20240229


def collision(distance: float, width: float) -> float:
    """The chance that one shifted Gaussian projection puts two points into the same step."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(largest: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(depth, tables) for labels of at most ``largest`` classes; far means cosine 0.3 and less."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2 - 0.6), width)
    depth = max(4, math.ceil(math.log(max(1.0, largest / CHANCE)) / -math.log(far)))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - near**depth))


def _keys(x: np.ndarray, depth: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit bucket key for each vector and table."""
    rng = np.random.default_rng(SEED + x.shape[1])
    directions = rng.standard_normal((x.shape[1], depth * tables))
    shifts = rng.uniform(0, width, depth * tables)
    odd = rng.integers(1, 1 << 62, depth * tables, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.floor((x @ directions + shifts) / width).astype(np.int64).view(np.uint64) * odd
    keys = steps.reshape(len(x), tables, depth).sum(axis=2, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, depth: int, tables: int, width: float) -> DataFrame:
    """(node, copies, label, unit vector, keys) for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("vector").to_pylist()]
            unit, keys = [b""] * len(vectors), [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                x = _unit([vectors[i] for i in at])
                k = _keys(x, depth, tables, width)
                for n, i in enumerate(at):
                    unit[i], keys[i] = x[n].tobytes(), k[n].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), batch.column("label"), pa.array(unit, pa.binary()), pa.array(keys, pa.binary())],
                names=["node", "copies", "label", "unit", "keys"],
            )

    return classes.mapInArrow(run, T.StructType().add("node", "long").add("copies", "long").add("label", classes.schema["label"].dataType).add("unit", "binary").add("keys", "binary"))


def _spread(hashed: DataFrame, tables: int) -> DataFrame:
    """(table, bucket, node) in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            where = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys), batch.column("node").take(where), batch.column("label").take(where), pa.compute.binary_length(batch.column("unit")).take(where)],
                names=["t", "key", "node", "label", "bytes"],
            )

    import pyarrow.compute  # noqa: F401

    schema = T.StructType().add("t", "integer").add("key", "long").add("node", "long").add("label", hashed.schema["label"].dataType).add("bytes", "integer")
    return hashed.mapInArrow(run, schema).select("t", F.xxhash64("key", "label", "bytes").alias("bucket"), "node")


def _block_links(cosine: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, _, one, two = (k.as_py() for k in key)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        # Equal sums of squares come from equal classes only; ties in order do not matter.
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(node), -1)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(len(node), -1)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        linked = x[left] @ x[right].T >= cosine
        if one == two:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        if t:
            earlier = np.zeros(len(i), bool)
            for before in range(t):
                earlier |= keys[i, before] == keys[j, before]
            i, j = i[~earlier], j[~earlier]
        counts = np.bincount(i, copies[j], len(node))
        if one != two:
            counts += np.bincount(j, copies[i], len(node))
        label = node.copy()
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            if (low == label).all():
                break
            label = low
        some = counts > 0
        return pa.table({"node": node[some], "n": counts[some].astype(np.int64), "least": label[some]})

    return run


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vectors`` with ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null, their lengths agree and their cosine
    in double precision is at least ``cosine``.  Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing: they are their own component.  ``component_id`` is
    the least id reachable by links (ids that repeat keep one row each; a null id is never least).
    """
    names = vectors.columns
    packed = pack(vectors)
    row = F.col("row")
    numbers = row.getField(vector_col)
    fine = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(row.getField(label_col).isNotNull() & fine & F.exists(numbers, lambda v: v != 0), F.lit(False))
    h1, _ = hash128(row.getField(label_col), numbers)
    noded = packed.select("row", F.when(usable, h1).alias("node"))
    classes = settle(
        noded.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min(row.getField(id_col)).alias("least_id"), F.first(row.getField(label_col)).alias("label"), F.first(numbers).alias("vector"))
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, tables = plan_tables(largest, cosine, width, recall)
    hashed = settle(_hashed(classes.select("node", "copies", "label", "vector"), depth, tables, width))
    spread = _spread(hashed, tables)
    shared = spread.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = spread.join(shared, ["t", "bucket"]).join(hashed.select("node", "copies", "unit", "keys"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", other).select(
        "t", "bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "copies", "unit", "keys"
    )
    found = settle(members.groupBy("t", "bucket", "one", "two").applyInArrow(_block_links(cosine), "node long, n long, least long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    joined = classes.select("node", "copies", "least_id").join(counts, "node", "left").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leasts = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = joined.join(leasts, "component").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = noded.join(told, "node", "left")
    component = F.when(F.col("node").isNull(), row.getField(id_col)).otherwise(F.col("component_id"))
    return unpack(out, names, n_links=F.coalesce("n_links", F.lit(0)).cast("long"), component_id=component, kept=row.getField(id_col).eqNullSafe(component))


def op7_p_stable_vectors(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return link(vectors).select("vec_id", "n_links", "component_id", "kept")
