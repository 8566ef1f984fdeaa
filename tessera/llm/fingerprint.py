"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by their counts.  For each of SAMPLES samples every term
draws r and c from Gamma(2, 1) and b from U(0, 1), all fixed by a hash of the term and the
sample's number; with t = floor(ln w / r + b) the term minimising ln c - r (t - b + 1) is
sampled together with t.  Two texts agree on a sample with a probability equal to the
generalised Jaccard similarity of their counts, so the share of equal samples estimates it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, settle, small_batches, unpack

#: Samples in a fingerprint; each is written as four hex digits, 0000 for a text without words.
SAMPLES = 128
#: Words whose draws one task keeps for good (the first it meets, so the frequent ones among
#: them), and those it keeps for a while: a text, its successor and its edited form share words.
CACHE, RECENT = 36_000, 16_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Draws of r, c and b lie on a grid of so many equally likely values.
_GRID = 1 << 16


def gamma_quantiles() -> np.ndarray:
    """The middle quantiles of Gamma(2, 1) on the grid, by bisection of 1 - (1 + x) exp(-x)."""
    wanted = (np.arange(_GRID) + 0.5) / _GRID
    low, high = np.zeros(_GRID), np.full(_GRID, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


class Sampler:
    def __init__(self, samples: int = SAMPLES, cache: int = CACHE, recent: int = RECENT):
        self.samples, self.kept, self.limit = samples, cache, cache + recent
        self.steps = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gamma = gamma_quantiles()
        self.gamma, self.ln_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.rows: dict[bytes, int] = {}
        self.recent: list[bytes] = []
        self.hashes = np.zeros(self.limit, np.uint64)
        self.one, self.r, self.b, self.lnc = (np.zeros((self.limit, samples), np.float32) for _ in range(4))

    def _draw(self, hashes: np.ndarray):
        """For each word: ln a at weight 1, r, b and ln c, one column for each sample."""
        x = _mix(hashes[:, None] ^ self.steps[None, :])
        field = np.uint64(_GRID - 1)
        r, lnc = self.gamma[x & field], self.ln_gamma[x >> np.uint64(16) & field]
        b = (x >> np.uint64(48)).astype(np.float32) * np.float32(1 / _GRID)
        return lnc - r * (1 - b), r, b, lnc

    def _cached(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of at most RECENT words; recent ones are forgotten together when full."""
        new = [w for w in words if w not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.limit:
                for w in self.recent:
                    del self.rows[w]
                self.recent = []
                new = [w for w in words if w not in self.rows]
            first = len(self.rows)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))
            at = slice(first, first + len(new))
            self.hashes[at] = hashes
            self.one[at], self.r[at], self.b[at], self.lnc[at] = self._draw(hashes)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            self.recent += new[max(0, self.kept - first) :]
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def sample(self, text: str) -> np.ndarray:
        """The fingerprint as 16-bit numbers; all 0 for a text without words."""
        counts = Counter(text.encode("utf-8", "surrogatepass").split())
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        columns = np.arange(self.samples)
        words = list(counts)
        for start in range(0, len(words), 4096):
            some = words[start : start + 4096]
            rows = self._cached(some)
            logs = np.log(np.fromiter(map(counts.__getitem__, some), np.float32, len(some)))
            lna = self.one[rows]
            many = np.flatnonzero(logs)
            if len(many):
                at = rows[many]
                r, b = self.r[at], self.b[at]
                lna[many] = self.lnc[at] - r * (np.floor(logs[many][:, None] / r + b) - b + 1)
            low = lna.argmin(axis=0)
            value, chosen = lna[low, columns], rows[low]
            level = np.floor(logs[low] / self.r[chosen, columns] + self.b[chosen, columns]).astype(np.int64).view(np.uint64)
            sampled = _mix(self.hashes[chosen] + level * np.uint64(0x9E3779B97F4A7C15))
            better = value < best
            best, out = np.where(better, value, best), np.where(better, sampled, out)
        return (out % np.uint64(65535) + np.uint64(1)).astype(np.uint16) if words else np.zeros(self.samples, np.uint16)


@lru_cache(maxsize=1)
def _sampler(samples: int) -> Sampler:
    return Sampler(samples)


def _packed(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with ``fingerprint``; null text counts as empty, equal texts have equal ones."""
    names = docs.columns
    packed = pack(docs).withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(samples)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            made = pa.array([_packed(sampler.sample(t.as_py())).hex() for t in batch.column(at)], pa.string())
            yield batch.set_column(at, "fingerprint", made)

    small_batches(packed.sparkSession)
    made = packed.mapInArrow(run, T.StructType().add("row", packed.schema["row"].dataType).add("fingerprint", "string"))
    return unpack(made, names, fingerprint=F.col("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(sampler: Sampler, text: str, following: str, own: np.ndarray, other: np.ndarray) -> tuple:
    import hashlib

    changed = edited(text, following)
    after = sampler.sample(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return len(text), digest, _packed(own), _packed(after), likeness(own, after), likeness(own, other)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness; one row per row.

    The following document is the next by descending id (then by a hash of the text; null ids
    last), after the last the first.  Rows are range-partitioned and sorted, so neighbours meet
    in one task; a partition's last row is finished with the first row of the next partition.
    An only row follows itself.  Null text counts as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"id {kind}, {_RESULT}, part int, edge string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = _sampler(samples), TaskContext.get().partitionId()
        arrow = None
        held = None
        for batch in batches:
            arrow = arrow or _arrow_schema(batch.schema.field("id").type)
            out: list[tuple] = []
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                now = (id_.as_py(), text.as_py(), sampler.sample(text.as_py()))
                if held is None:
                    out.append((now[0], *[None] * 6, part, "first", now[1]))
                else:
                    out.append((held[0], *_compare(sampler, held[1], now[1], held[2], now[2]), part, None, None))
                held = now
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)
        if held is not None:
            yield _batch([(held[0], *[None] * 6, part, "last", held[1])], arrow)

    small_batches(ordered.sparkSession)
    halves = settle(ordered.mapInArrow(run, schema))
    parts = halves.where("edge = 'first'").select("part")
    following = parts.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("next_part"),
    )
    firsts = halves.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    open_ = halves.where("edge = 'last'").select("id", "text", "part").join(following, "part").join(firsts, "next_part").select("id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(samples)
        for batch in batches:
            out = []
            for id_, text, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.append((id_, *_compare(sampler, text, after, sampler.sample(text), sampler.sample(after))))
            yield _batch(out, pa.schema(list(_arrow_schema(batch.schema.field("id").type))[:7]))

    closed = open_.mapInArrow(finish, f"id {kind}, {_RESULT}")
    done = halves.where("edge IS NULL").drop("part", "edge", "text").unionByName(closed)
    hexed = {n: F.lower(F.hex(n)) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return done.withColumns(hexed).withColumnRenamed("id", id_col)


def _arrow_schema(id_type: pa.DataType) -> pa.Schema:
    kinds = [("id", id_type), ("n_chars", pa.int64()), *[(n, pa.binary()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]]
    kinds += [("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
    return pa.schema(kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
