"""Line de-duplication over a corpus, in DataFrame operations only.

Lines are exploded with a 128-bit hash of their normalised key; one aggregation that combines
before its shuffle finds the keys held by two or more documents and the document that keeps
them; dropped positions go back to the documents, which are rebuilt in the row.  A line that a
third of all documents share costs one partial row per task in the aggregation and meets its
keeper by broadcast.  The text itself is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, hash128, pack, settle, unpack

#: Keys shorter than this many code points are never dropped.
MIN_CHARS = 10
#: A key found in at least this many documents is repeated.
MIN_DOCS = 2
#: Most keys that count as hot, and the least number of lines that such a key has.
HOT_KEYS, HOT_LEAST = 10_000, 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z in lower case (other letters as they are)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` rebuilt without repeated lines, ``n_lines`` and ``n_dropped`` (long).

    A line goes if its key has at least ``min_chars`` code points, occurs in two or more
    documents and this is not the smallest id that holds it.  Null or empty text is one empty
    line.  Rows with the same id are one document; a null id counts as larger than any other.
    Rows equal in every column are treated alike.  An empty table gives an empty table; columns
    named like the new ones are replaced.
    """
    names = docs.columns
    packed = pack(docs, key=True)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    lines = packed.select(
        "k1", "k2", F.col("row").getField(id_col).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    ).withColumn("key", line_key(F.col("line")))
    h1, h2 = hash128(F.col("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select("k1", "k2", "doc", "pos", h1.alias("h1"), h2.alias("h2"))
    repeated = settle(
        lines.groupBy("h1", "h2")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.bool_or(F.col("doc").isNull()).alias("nameless"), F.count("*").alias("n"))
        .where((F.col("first") != F.col("last")) | (F.col("nameless") & F.col("first").isNotNull()))
        .select("h1", "h2", "first", "n")
    )
    # Fewer than HOT_KEYS keys can hold that share of all repeated lines each: they are broadcast, and
    # their lines, already decided, are dealt over all tasks of the join that decides the rest.
    common = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= max(HOT_LEAST, common / HOT_KEYS)
    hot = repeated.where(is_hot).select("h1", "h2", F.col("first").alias("hot_first"))
    cold = repeated.where(~is_hot).select(F.col("h1").alias("at"), "h2", "first")
    decided = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    at = F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("k1", "k2", "pos"))
    told = decided.withColumn("at", at).join(cold, ["at", "h2"], "left").withColumn("keeper", F.coalesce("hot_first", "first"))
    dropped = (
        told.where(F.col("keeper").isNotNull() & ~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    joined = packed.join(dropped, ["k1", "k2"], "left")
    # One flag for each line up to the last one dropped; later lines pair with a null and stay.
    before = lambda i: F.coalesce(F.get(F.col("gone"), i - 1), F.lit(-1))
    flags = F.flatten(
        F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True))))
    )
    all_lines = F.split(text, "\n", -1)
    paired = F.arrays_zip(all_lines.alias("line"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("gone"))
    stay = F.filter(paired, lambda x: ~F.coalesce(x["gone"], F.lit(False)))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    return unpack(
        joined,
        names,
        **{
            text_col: kept,
            "n_lines": F.size(all_lines).cast("long"),
            "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        },
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (r.keeper IS NOT NULL AND r.keeper <> l.doc_id) AS gone
  FROM keyed l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
