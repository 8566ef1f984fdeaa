"""Differences between two publications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, key: str, fields: list[str], version: str = "version_id", content: str = "content_hash") -> DataFrame:
    """key, ``change`` and ``changed_fields`` for the union of two snapshots.

    Objects are unchanged if version or content hash agree; otherwise the fields that differ are
    listed in the given order.
    """
    side = lambda df, tag: df.select(key, F.struct(version, content, *fields).alias(tag))
    joined = side(before, "a").join(side(after, "b"), key, "full_outer")
    same = (F.col(f"a.{version}") == F.col(f"b.{version}")) | (F.col(f"a.{content}") == F.col(f"b.{content}"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    return joined.select(key, change.alias("change"), F.when(change == "modified", differing).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def summary(changes: DataFrame, prefix: str = "") -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(f"{prefix}{c}") for c in ("added", "removed", "modified", "unchanged")])


def stored(changes: DataFrame, key: str, before: object, after: object) -> DataFrame:
    """One row to keep for a compared pair: both publications, the counts and a hash of every change."""
    from .reconcile import tree_hash

    rows = changes.select(F.concat_ws("..", F.lit(str(before)), F.lit(str(after))).alias("diff_id"), key, "change", F.concat_ws("|", "change", F.array_join("changed_fields", ",")).alias("_said"))
    hashed = tree_hash(rows, "diff_id", key, F.col("_said")).select("diff_id", "content_hash")
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")]
    return rows.groupBy("diff_id").agg(*counts).join(hashed, "diff_id")


def verify(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """(diff_id, state) of stored diffs against a new computation: valid, corrupt, or missing on the side that lacks it."""
    a, b = kept.select("diff_id", F.col("content_hash").alias("a")), fresh.select("diff_id", F.col("content_hash").alias("b"))
    state = F.when(F.col("a").isNull(), "not-stored").when(F.col("b").isNull(), "not-computed").when(F.col("a") == F.col("b"), "valid").otherwise("corrupt")
    return a.join(b, "diff_id", "full_outer").select("diff_id", state.alias("state"))
