"""Keyed writes as tables: what an upsert leaves, told row by row, before anything is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows carry, null keys among them, with their number ``n``: an upsert must refuse them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upserted(stored: DataFrame, rows: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """The table after writing ``rows`` over ``stored`` by key, with ``change``: kept, inserted, updated or unchanged.

    Both have the same columns and one row a key (see ``repeated_keys``).  With ``compare`` a stored row changes only if one of these
    columns differs, null being equal to null alone; else it stays as it was, its other columns too (``unchanged``).  Without, every row met
    is ``updated``.  Null keys never meet: such new rows are inserted.  One full join by key; rows with ``change`` other than
    kept or unchanged are what a writer has to write.
    """
    names = stored.columns
    others = [n for n in names if n not in keys]
    side = lambda df, mark: df.select(*[F.col(k) for k in keys], F.struct(F.lit(True).alias("there"), *[F.col(n) for n in others]).alias(mark))
    joined = side(stored, "_old").join(side(rows, "_new"), keys, "full")
    old, new = F.col("_old"), F.col("_new")
    differs = F.lit(True) if compare is None else reduce(lambda a, b: a | b, [~old[c].eqNullSafe(new[c]) for c in compare], F.lit(False))
    change = F.when(new.isNull(), "kept").when(old.isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    told = joined.withColumn("change", change)
    from_new = F.col("change").isin("inserted", "updated")
    return told.select(*[F.col(n) if n in keys else F.when(from_new, new[n]).otherwise(old[n]).alias(n) for n in names], "change")
