"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns
a DataFrame; ``run`` writes each stage's rows as Parquet to the shared folder and reads them
back for the next.  All stages but the last return the columns of their input; an empty table gives an empty table.  The stages use
zstandard, min-hash and Newton iterations, which SQL cannot express, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, mixing, near_dup, toxicity
from tessera.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the training labels.

    Null and empty texts get a score too; rows without an id are scored but teach nothing.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.is_held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another document holds first; ``n_chars`` follows the new text.

    A document that loses lines and has only blanks left goes: its text is in other documents.
    Documents that were blank before (null or empty too) stay as they are.
    """
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & ~F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    done = found.where(~emptied).select(docs.columns)
    return done.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least id, null last.  Blank texts all stay."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 2 times); a null source is one of its own."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every copy, their number, and digests of ids and decoded bytes; null text has no tokens."""
    both = bpe.round_trip(docs, *bpe.default_vocabulary())
    return both.select("doc_id", "lang", "source", "ids", *[c.alias(n) for n, c in bpe.digests(both).items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
