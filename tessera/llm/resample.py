"""Importance resampling of documents towards the distribution of a target corpus.

Hashed n-gram counts form a sparse matrix, a row for each document and a column for each bucket,
persisted as blocks in compressed sparse row form: ids, row pointers, column indices, counts.
Column sums of the blocks give the distributions of corpus and target; the product of the
matrix with the buckets' gains gives each document's weight.  Documents are drawn without
replacement by weight plus Gumbel noise that depends on the id alone, so reruns agree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, small_batches

#: Buckets, longest run of words, least words of a document that may be drawn, share drawn, key of the noise.
BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Non-zero counts after which a block is closed, blocks of a Parquet row group, and features whose bucket a task remembers.
#: Readers decode up to a row group at a time and hand on an Arrow batch of blocks, so both are bounded, whatever a task reads.
BLOCK_COUNTS, GROUP_BLOCKS, CACHE = 4096, 128, 500_000
#: A word in UTF-8 bytes: ASCII digits and letters (lower case by then) and all bytes of other characters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Buckets:
    """Feature buckets of texts; the bucket of a feature is remembered (a bounded number of them)."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.known = buckets, longest, {}

    def count(self, text: bytes) -> tuple[int, Counter]:
        """The number of words and the features in each bucket of one whole text."""
        words = _WORD.findall(text.lower())  # bytes: A-Z only
        found: Counter = Counter()
        if len(self.known) > CACHE:
            self.known.clear()
        known, buckets = self.known, self.buckets
        for size in range(1, self.longest + 1):
            runs = words if size == 1 else [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
            for feature, n in Counter(runs).items():
                at = known.get(feature)
                if at is None:
                    at = zlib.crc32(feature) % buckets
                    if len(feature) <= 64:
                        known[feature] = at
                found[at] += n
        return len(words), found


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The document-by-bucket counts as CSR blocks, one block a row.

    Columns: ``ids``, ``words``, ``features`` (one entry a document), ``ptr`` (one more), ``buckets``
    and ``counts`` (one entry a non-zero count, buckets ascending within a document).  A feature is
    a run of 1 to ``longest`` words joined by one space, its bucket the CRC-32 of its UTF-8 bytes modulo
    ``buckets``.  Null and empty texts are empty rows; repeated rows and null ids are rows of their
    own; other columns are left out.  A block holds at most one Arrow batch of documents and,
    unless one document has more, BLOCK_COUNTS counts.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType()
    for name, item in (("ids", kind), ("words", T.LongType()), ("features", T.LongType()), ("ptr", T.IntegerType()), ("buckets", T.IntegerType()), ("counts", T.LongType())):
        schema.add(name, T.ArrayType(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Buckets(buckets, longest)
        for batch in batches:
            begin, words, features, ptr, at, counts = 0, [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                n, found = hashed.count(text.as_py() or b"")
                rows = sorted(found.items())
                at += [b for b, _ in rows]
                counts += [c for _, c in rows]
                words.append(n)
                features.append(sum(found.values()))
                ptr.append(len(at))
                if len(at) >= BLOCK_COUNTS or i == batch.num_rows - 1:
                    parts = [batch.column(0).slice(begin, len(words)), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(ptr, pa.int32()), pa.array(at, pa.int32()), pa.array(counts, pa.int64())]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in parts]
                    yield pa.RecordBatch.from_arrays(lists, names=schema.names)
                    begin, words, features, ptr, at, counts = i + 1, [], [], [0], [], []

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


def _values(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the matrix's column sums without zeros.  A task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, counts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                np.add.at(total, _values(at, i), _values(counts, i))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus for each bucket, with one feature added to each."""
    all_corpus, all_target = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = [(target.get(b, 0) + 1.0) * all_corpus / ((corpus.get(b, 0) + 1.0) * all_target) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the matrix times the vector of gains, block by block."""
    kind = matrix.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", kind).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, features, ptr, at, counts = batch.columns
            weights = []
            for i in range(batch.num_rows):
                sums = np.concatenate([[0], np.cumsum(gain[_values(at, i)] * _values(counts, i))])
                ends = _values(ptr, i)
                weights.append(sums[ends[1:]] - sums[ends[:-1]])
            if weights:
                yield pa.RecordBatch.from_arrays([ids.flatten(), words.flatten(), features.flatten(), pa.array(np.concatenate(weights), pa.int64())], names=schema.names)

    return matrix.mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of Gumbel noise, from the first 32 bits of the SHA-256 of ``seed:id`` (null id: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id",
    buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row a document; ``rank`` 1, 2, 3... of those drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) with
    the highest scores are drawn; ties go to the smaller id, null last, then in any order between
    rows with the same id.  Null and empty texts have no features and weight 0.  An empty table
    gives an empty table, an empty target a flat distribution.  The column sums that reach the
    driver have one row a bucket.
    """
    matrix = settle(count_matrix(docs, id_col, text_col, buckets, longest), GROUP_BLOCKS)
    sums = [{r.bucket: r.n for r in column_sums(m, buckets).collect()} for m in (matrix, count_matrix(target, target_id, text_col, buckets, longest))]
    scored = weigh(matrix, gains(*sums, buckets)).withColumn("score", F.col("weight") + gumbel("id", seed))
    # A global order in range partitions: a row's place is its partition's offset and its place in it.
    # The last key deals rows of one id and score over partitions.
    may = (F.col("n_words") >= min_words).alias("may")
    keyed = scored.select("*", may, F.monotonically_increasing_id().alias("row"))
    order = [F.col("may").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = settle(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    held = {r.part: (r.n, r.m) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("may").alias("m")).collect()}
    drawn = percent * sum(m for _, m in held.values()) // 100
    offsets, before = {}, 0
    for p in sorted(held):
        offsets[p], before = before, before + held[p][0]
    starts = docs.sparkSession.createDataFrame(sorted(offsets.items()), "part int, before long")
    rank = F.col("before") + place + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return numbered.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))


def take_drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all columns kept; rows without an id are left out."""
    return docs.join(ranked.where("rank IS NOT NULL").select(id_col).distinct(), id_col, "left_semi")


def op13_importance_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return resample(docs, target).drop("n_words")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of the UTF-8 bytes of the expression ``text``; needs a row of ``CRC_TABLE_SQL`` beside it."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i::INT + 1, 2))::UBIGINT)"
    step = "xor(c >> 8, entries[1 + (xor(c, b) & 255)::BIGINT])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {step}), 4294967295::UBIGINT)"


#: The 256 remainders of the CRC-32 polynomial, made by eight steps each.
CRC_TABLE_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, [0,0,0,0,0,0,0,0]::UBIGINT[]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS entries
  FROM range(256) t(n)
)"""

#: The same rows in DuckDB.
OP13_SQL = rf"""
WITH {CRC_TABLE_SQL}, texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts
), buckets AS (
  SELECT word, ({crc32_sql("word")} % 10000)::INT AS bucket FROM (SELECT DISTINCT word FROM words), crc_table
), counts AS (
  SELECT side, id, bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM counts GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counts JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
