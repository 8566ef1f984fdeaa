"""Stored differences of publications: reused while they agree with their publications, replaced when not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import object_hash, row_json
from ..functions.shared import settle
from ..streaming.outbox import read_or_empty

_PAIR = ["from_id", "to_id"]
_CHANGES = ("added", "removed", "modified", "unchanged")
#: One stored row: a header (section ``summary``) or a change of a pair.
STORED = "diff_id string, generated_at timestamp, content_hash string, section string, key string, change string, changed_fields array<string>, added long, removed long, modified long, unchanged long, from_id string, to_id string"


def compare_pairs(pairs: DataFrame, objects: DataFrame, section: str, key: str, fields: list[str]) -> DataFrame:
    """(from_id, to_id, section, key, change, changed_fields) of every object of every pair (from_id, to_id).

    ``objects`` has (publication_id, key, version_id, content_hash, fields..).  Objects are unchanged if version or content
    agree.  A pair's objects meet by (pair, key): many pairs are compared in one join.  The pairs are broadcast (a store keeps a
    folder for each), so that a publication's objects never gather in one task.
    """
    side = lambda end, tag: F.broadcast(pairs).join(objects.select(F.col("publication_id").cast("string").alias(f"{end}_id"), F.col(key).cast("string").alias("key"), F.struct("version_id", "content_hash", *fields).alias(tag)), f"{end}_id")
    joined = side("from", "a").join(side("to", "b"), [*_PAIR, "key"], "full_outer")
    same = (F.col("a.version_id") == F.col("b.version_id")) | (F.col("a.content_hash") == F.col("b.content_hash"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    return joined.select(*_PAIR, F.lit(section).alias("section"), "key", change.alias("change"), F.when(change == "modified", differing).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def _hashed(rows: DataFrame) -> DataFrame:
    """(from_id, to_id, content_hash) of stored rows: the SHA-256 of summary and changes as one canonical object."""
    shown = rows.withColumn("pair", F.to_json(F.array(*_PAIR)))
    change = row_json(shown, id="key", change="change", changedFields="changed_fields")
    summary = row_json(shown, **{c: c for c in _CHANGES})
    items = shown.select("pair", "section", F.coalesce("key", F.lit("")).alias("key"), F.when(F.col("section") == "summary", summary).otherwise(change).alias("item"))
    found = object_hash(items, "pair", "section", "key", "item", ["entity", "relationship", "summary"])
    pair = F.from_json("pair", "array<string>")
    return found.select(pair[0].alias("from_id"), pair[1].alias("to_id"), F.col("hash").alias("fresh_hash"))


def content(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows to store for ``pairs``: a summary each, zeros too, and all changes but unchanged objects, with the content hash.

    The changes, the summaries and the hashes are written once: reading the result again compares and hashes nothing again.
    """
    changes = settle(changes)
    counts = changes.groupBy(*_PAIR).agg(*[F.count_if(F.col("change") == c).alias(c) for c in _CHANGES])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _CHANGES]
    none = lambda *typed: [F.lit(None).cast(t).alias(n) for n, t in typed]
    summary = settle(pairs.join(counts, _PAIR, "left").select(*_PAIR, F.lit("summary").alias("section"), *none(("key", "string"), ("change", "string"), ("changed_fields", "array<string>")), *zero))
    rows = changes.where("change <> 'unchanged'").select(*_PAIR, "section", "key", "change", "changed_fields", *none(*[(c, "long") for c in _CHANGES])).unionByName(summary)
    return rows.join(F.broadcast(settle(_hashed(rows).withColumnRenamed("fresh_hash", "content_hash"))), _PAIR)


def _state(stored_hash: str, now_hash: str) -> Column:
    """``corrupt`` (not what was stored), ``valid`` or ``outdated`` (not what its publications give); null if none is stored."""
    agree = F.col(stored_hash).eqNullSafe(F.col(now_hash))
    return F.when(~F.col("sound"), "corrupt").when(F.col("sound") & agree, "valid").when(F.col("sound"), "outdated")


class DiffStore:
    """Differences in Parquet, one partition for each ordered pair of publications.

    ``compare`` makes the current content of pairs from their publications: a function of the pairs (from_id, to_id) that
    returns ``compare_pairs`` rows of both sections.  Concurrent writers must write different pairs.
    """

    def __init__(self, spark: SparkSession, path: str, compare: Callable[[DataFrame], DataFrame], now: Callable[[], Column] = F.current_timestamp):
        self.spark, self.path, self.compare, self.now = spark, path, compare, now

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, STORED)

    def check(self, rows: DataFrame) -> DataFrame:
        """(from_id, to_id, diff_id, generated_at, content_hash, sound) of the stored pairs among ``rows``: sound if there is one
        summary, all rows carry the same id, time and hash, and the rows have that hash."""
        kept = rows.groupBy(*_PAIR).agg(
            F.min("diff_id").alias("diff_id"), F.min("generated_at").alias("generated_at"), F.min("content_hash").alias("content_hash"), F.count_if(F.col("section") == "summary").alias("summaries"),
            (F.count_distinct("diff_id", "generated_at", "content_hash") == 1).alias("one"),
        )
        known = rows.where(F.col("section").isin("entity", "relationship", "summary"))
        joined = kept.join(_hashed(known), _PAIR, "left")
        sound = F.col("one") & (F.col("summaries") == 1) & F.coalesce(F.col("fresh_hash") == F.col("content_hash"), F.lit(False))
        return joined.select(*_PAIR, "diff_id", "generated_at", "content_hash", sound.alias("sound"))

    def save(self, pairs: DataFrame) -> DataFrame:
        """Compare ``pairs`` and keep the result: (from_id, to_id, diff_id, action, state).

        A stored difference that is sound and equal to the new one is ``reused``, id and time with it; one that is corrupt or
        out of date is ``replaced`` as a whole; a new one is ``created``.  ``state`` is what ``verified`` says of the difference as it
        was found (null: none), for callers that mend: verifying before would compare the publications twice.
        """
        pairs = settle(pairs.select(*[F.col(c).cast("string").alias(c) for c in _PAIR]).distinct())
        fresh = content(pairs, self.compare(pairs))
        old = self.check(self.rows().join(F.broadcast(pairs), _PAIR, "left_semi")).select(*_PAIR, F.col("diff_id").alias("old_id"), F.col("content_hash").alias("old_hash"), "sound")
        now = fresh.where("section = 'summary'").select(*_PAIR, "content_hash").join(old, _PAIR, "left")
        stamped = now.withColumn("generated_at", self.now()).withColumn("state", _state("old_hash", "content_hash"))
        reused = F.col("state").eqNullSafe("valid")
        action = F.when(reused, "reused").when(F.col("state").isNotNull(), "replaced").otherwise("created")
        new_id = F.left(F.sha2(F.concat_ws("\x00", *_PAIR, "content_hash", F.col("generated_at").cast("string")), 256), F.lit(26))
        told = settle(stamped.select(*_PAIR, F.when(reused, F.col("old_id")).otherwise(new_id).alias("diff_id"), action.alias("action"), "state", "generated_at"))
        write = fresh.join(F.broadcast(told.where("action <> 'reused'").select(*_PAIR, "diff_id", "generated_at")), _PAIR)
        columns = [part.split()[0] for part in STORED.split(", ")]
        write.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PAIR).parquet(self.path)
        return told.drop("generated_at")

    def verified(self, pairs: DataFrame | None = None) -> DataFrame:
        """(from_id, to_id, diff_id, generated_at, state) of stored pairs, see ``_state``."""
        rows = self.rows() if pairs is None else self.rows().join(pairs.select(*[F.col(c).cast("string").alias(c) for c in _PAIR]), _PAIR, "left_semi")
        kept = settle(self.check(rows))
        wanted = kept.select(*_PAIR)
        fresh = content(wanted, self.compare(wanted)).where("section = 'summary'").select(*_PAIR, F.col("content_hash").alias("now_hash"))
        return kept.join(fresh, _PAIR, "left").select(*_PAIR, "diff_id", "generated_at", _state("content_hash", "now_hash").alias("state"))

    def comparisons(self, publication: str, after: str | None = None, limit: int = 50) -> DataFrame:
        """A page of the stored comparisons of a publication by id: 1 to 101 rows with their counts."""
        if not 1 <= limit <= 101:
            raise ValueError("limit must be within 1 and 101")
        rows = self.rows().where("section = 'summary'").where((F.col("from_id") == publication) | (F.col("to_id") == publication))
        rows = rows if after is None else rows.where(F.col("diff_id") > after)
        return rows.orderBy("diff_id").limit(limit).select("diff_id", *_PAIR, "generated_at", "content_hash", *_CHANGES)
