"""Substring de-duplication with a count-min prefilter and exact grouping.

A window is WINDOW consecutive words.  Its anchor is the leftmost smallest hash among its
sub-windows of ANCHOR words: equal windows have equal anchors, and about a tenth of all
positions are anchors.  Each partition sketches its anchors in a two-row count-min sketch with
counters that stop at 2; the merged sketch overestimates every window's count, so a window that
repeats always passes.  A second pass groups the passing windows by a 128-bit hash and finds those
that passed by mistake; they go back to their documents, and every word that a truly repeated
window covers is removed.

The sketch has CELLS_PER_ANCHOR cells for each expected anchor, two bits a cell, and at most
MAX_CELLS cells: its size as a broadcast is bounded.  Beyond that bound more windows pass and
the exact grouping, which combines before its shuffle, takes the load; none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, small_batches, unpack

WINDOW = 35
ANCHOR = 18
CELLS_PER_ANCHOR = 8
#: At two bits a cell the largest sketch takes 256 MB.
MAX_CELLS = 1 << 30
_SEGMENT = 1 << 20
#: Words whose hashes one task remembers; anchors held before a sketch is sent on.
CACHE, FLUSH = 150_000, 1_000_000
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Roller:
    """Rolling hashes of runs of words; powers of the bases are kept and grown as needed."""

    def __init__(self):
        self.words = _Hashes()
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverse = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > CACHE:
            self.words.clear()
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            size = max(n, 2 * len(self.powers[0]), 4096)
            for k, base in enumerate(_BASES):
                for kept, factor in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                    steps = np.full(size, factor, np.uint64)
                    steps[0] = 1
                    kept[k] = np.multiply.accumulate(steps)

    def runs(self, hashes: np.ndarray, length: int, k: int = 0) -> np.ndarray:
        """A hash of each run of ``length`` words; k chooses one of two independent ones."""
        n = len(hashes)
        if n < length:
            return np.zeros(0, np.uint64)
        self._grow(n)
        own = _mix(hashes + _U(k)) if k else hashes
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * self.powers[k][:n], out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * self.inverse[k][: n - length + 1])

    def anchors(self, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each sub-window, and for each window the position of its anchor."""
        small = self.runs(hashes, anchor)
        span = window - anchor + 1
        view = np.lib.stride_tricks.sliding_window_view(small, span)
        return small, view.argmin(axis=1) + np.arange(len(view))


def _cells(values: np.ndarray, cells: int) -> np.ndarray:
    """The two cells of each value: one in either half of the sketch."""
    half = _U(cells // 2 - 1)
    return np.stack([values & half, (_mix(values + _U(0x5851F42D4C957F2D)) & half) + _U(cells // 2)])


class Sketch:
    """A merged count-min sketch: a bit for 'once or more' is not needed, only for 'twice or more'."""

    def __init__(self, cells: int, segments: dict[int, bytes]):
        self.cells = cells
        self.bits = np.zeros(cells // 8, np.uint8)
        for segment, data in segments.items():
            at = segment * (_SEGMENT // 8)
            self.bits[at : at + len(data)] = np.frombuffer(data, np.uint8)

    def repeated(self, values: np.ndarray) -> np.ndarray:
        """Whether a value's estimated count is two or more (never False for a true repeat)."""
        one, two = _cells(values, self.cells)
        bit = lambda c: (self.bits[c >> _U(3)] >> (c & _U(7)).astype(np.uint8)) & 1
        return (bit(one) & bit(two)).astype(bool)


def sketch_size(docs_bytes: int) -> int:
    """Cells of the sketch, a power of two: six bytes a word, two anchors in each span."""
    anchors = docs_bytes / 6 * 2 / (WINDOW - ANCHOR + 2)
    cells = 1 << max(21, int(np.ceil(np.log2(max(1.0, CELLS_PER_ANCHOR * anchors)))))
    return min(MAX_CELLS, cells)


def build_sketch(rows: DataFrame, cells: int, window: int, anchor: int) -> DataFrame:
    """(segment, bits): the segments of the merged sketch, one bit a cell for a count of 2 or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, waiting = Roller(), [], 0

        def emit() -> pa.RecordBatch:
            found, counts = np.unique(_cells(np.concatenate(held), cells).ravel(), return_counts=True)
            segments = (found // _U(_SEGMENT)).astype(np.int32)
            starts = np.flatnonzero(np.diff(segments, prepend=-1))
            offsets = (found % _U(_SEGMENT)).astype(np.uint32) << np.uint32(1) | (counts > 1)
            parts = np.split(offsets.astype("<u4"), starts[1:])
            return pa.RecordBatch.from_arrays([pa.array(segments[starts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "marks"])

        for batch in batches:
            for text in batch.column(0):
                hashes = roller.of_words(text.as_py().encode("utf-8", "surrogatepass").split())
                if len(hashes) < window:
                    continue
                small, at = roller.anchors(hashes, window, anchor)
                held.append(small[at[np.diff(at, prepend=-1) != 0]])
                waiting += len(held[-1])
                if waiting >= FLUSH:
                    yield emit()
                    held, waiting = [], 0
        if held:
            yield emit()

    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)
        for batch in tables:
            for marks in batch.column("marks"):
                data = np.frombuffer(marks.as_py(), "<u4")
                cells_, more = data >> 1, (data & 1).astype(bool)
                twice[cells_[more | once[cells_]]] = True
                once[cells_] = True
        bits = np.packbits(twice, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "bits"])

    marks = rows.select("text").mapInArrow(partial, "segment int, marks binary")
    return marks.groupBy("segment").applyInArrow(merge, "segment int, bits binary")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept words joined by one space, ``n_words``, ``n_removed``.

    A word goes if some window that covers it starts anywhere else too, in the same document or
    another; all windows are judged on the input.  Null text has no words; texts shorter than a
    window lose nothing; rows that are equal in every column are separate documents.
    """
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    packed = pack(docs, key=True).withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    size = packed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch_size(size)
    # At most MAX_CELLS bits in all, whatever the corpus.
    segments = {r.segment: bytes(r.bits) for r in build_sketch(packed, cells, window, anchor).collect()}
    sent = spark.sparkContext.broadcast((cells, segments))

    def passing(roller: Roller, sketch: Sketch, hashes: np.ndarray) -> np.ndarray:
        small, at = roller.anchors(hashes, window, anchor)
        new = np.diff(at, prepend=-1) != 0
        return np.flatnonzero(sketch.repeated(small[at[new]])[np.cumsum(new) - 1])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, sketch = Roller(), Sketch(*sent.value)
        for batch in batches:
            out, held = [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                hashes = roller.of_words(text.as_py().encode("utf-8", "surrogatepass").split())
                if len(hashes) < window or not len(found := passing(roller, sketch, hashes)):
                    continue
                out.append((np.full(len(found), key.as_py(), np.int64), *[roller.runs(hashes, window, k)[found].view(np.int64) for k in (0, 1)]))
                held += len(found)
                if held >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k1", "h1", "h2"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k1", "h1", "h2"])

    windows = packed.select("k1", "text").mapInArrow(candidates, "k1 long, h1 long, h2 long")
    single = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("k1").alias("k1")).where("n = 1")
    mistakes = single.groupBy("k1").agg(F.collect_list("h1").alias("mistakes"))
    joined = packed.select("k1", "row", "text").join(mistakes, "k1", "left").select("row", "text", "mistakes")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, sketch = Roller(), Sketch(*sent.value)
        for batch in batches:
            kept, totals, removed = [], [], []
            row, text, wrong = (batch.column(batch.schema.get_field_index(n)) for n in ("row", "text", "mistakes"))
            for value, mistaken in zip(text, wrong, strict=True):
                words = value.as_py().encode("utf-8", "surrogatepass").split()
                totals.append(len(words))
                hashes = roller.of_words(words)
                found = passing(roller, sketch, hashes) if len(words) >= window else np.zeros(0, np.int64)
                if len(found) and mistaken.is_valid:
                    own = roller.runs(hashes, window)[found].view(np.int64)
                    found = found[~np.isin(own, mistaken.values.to_numpy(zero_copy_only=False))]
                if len(found):
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, found, 1)
                    np.add.at(edges, found + window, -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            made = [pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([row, *made], names=["row", "kept", "n_words", "n_removed"])

    kind = T.StructType().add("row", packed.schema["row"].dataType).add("kept", "string").add("n_words", "long").add("n_removed", "long")
    done = joined.mapInArrow(reduce, kind)
    return unpack(done, names, **{text_col: F.col("kept"), "n_words": F.col("n_words"), "n_removed": F.col("n_removed")})


def op4_count_min_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, CAST(len(words) AS BIGINT) - 33)) AS pos, words FROM w WHERE len(words) >= 35
), hashed AS (
  SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS h FROM wins
), reps AS (
  SELECT h FROM hashed GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS at FROM hashed WHERE h IN (SELECT h FROM reps)
), each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, CAST(len(words) AS BIGINT) + 1)) AS at FROM w
), kept AS (
  SELECT e.doc_id, count(*) FILTER (WHERE c.at IS NOT NULL) AS removed,
         string_agg(e.word, ' ' ORDER BY e.at) FILTER (WHERE c.at IS NULL) AS text
  FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.at = c.at GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
