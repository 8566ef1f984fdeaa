"""Where rows come from and go: file inventories, discovery rules, and versioned table sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ancestors, extension, filename, fingerprint
from .repositories import read_repositories

__all__ = ["VersionedTable", "config_rows", "glob_regex", "matches_rules", "read_chunk", "read_files", "read_repositories"]


def read_files(spark: SparkSession, root: str, extensions: list[str] | None = None, excluded_folders: tuple[str, ...] = (), max_bytes: int = 16 << 20) -> DataFrame:
    """(path, filename, extension, size_bytes, modified_at, fingerprint, text) of the files below ``root``.

    Excluded folders match any path segment; size and extension filters reach the file listing,
    so larger files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/+", "/", root)).rstrip("/") + "/", "")
    files = files.where(F.col("length") <= max_bytes).withColumn("path", path)
    if excluded_folders:
        files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(f) for f in excluded_folders])))
    files = files.withColumn("extension", extension(filename(F.col("path"))))
    if extensions is not None:
        files = files.where(F.col("extension").isin(*extensions))
    return files.select(
        "path",
        filename(F.col("path")).alias("filename"),
        "extension",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        fingerprint(F.col("content")).alias("fingerprint"),
        F.decode("content", "UTF-8").alias("text"),
    )


def glob_regex(pattern: str) -> str:
    """A discovery glob as a regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a segment."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_rules(path: Column, rules: list[dict[str, list[str]]]) -> Column:
    """Whether some rule includes the path (an empty include list takes all) and does not exclude it.

    Patterns are tried on the path and on each of its ancestors.
    """
    tried = F.concat(F.array(path), ancestors(path))
    hit = lambda pattern: F.exists(tried, lambda p: p.rlike(glob_regex(pattern)))
    any_of = lambda patterns: reduce(lambda a, b: a | b, [hit(p) for p in patterns], F.lit(False))
    decided = [(any_of(r.get("include", [])) if r.get("include") else F.lit(True)) & ~any_of(r.get("exclude", [])) for r in rules]
    return reduce(lambda a, b: a | b, decided, F.lit(False))


def read_chunk(files: DataFrame, start: int, length: int = 256 * 1024) -> DataFrame:
    """A range of each file's text, at most 256 KiB."""
    size = min(length, 256 * 1024)
    return files.withColumn("chunk", F.substring("text", start + 1, size))


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(source_id, root, rules) from a parsed configuration; ids must be unique and roots present."""
    rows, seen = [], set()
    for source in config.get("sources", []):
        if source["id"] in seen or not source.get("root"):
            raise ValueError(f"source {source['id']!r} repeats or has no root")
        seen.add(source["id"])
        rows.append((source["id"], source["root"], [str(r) for r in source.get("include", [])], [str(r) for r in source.get("exclude", [])]))
    return spark.createDataFrame(rows, "source_id string, root string, include array<string>, exclude array<string>")


class VersionedTable:
    """A table kept as numbered Parquet folders; a write makes a new version and never overwrites.

    The newest version is the largest folder with Spark's success marker, so a lost or failed
    write leaves readers on the version before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(hadoop)
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if re.fullmatch(r"v\d+", n))

    def read(self, version: int | None = None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def write(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.parquet(f"{self.path}/v{version}")
        return version

    def insert_absent(self, rows: DataFrame, keys: list[str]) -> int:
        """Append the rows whose key is not there yet."""
        old = self.read()
        return self.write(old.unionByName(rows.join(old.select(keys), keys, "left_anti").dropDuplicates(keys)))

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Replace rows by key, add new ones."""
        old = self.read()
        return self.write(old.join(rows.select(keys), keys, "left_anti").unionByName(rows))

    def delete(self, keys_to_drop: DataFrame, keys: list[str]) -> int:
        return self.write(self.read().join(keys_to_drop.select(keys), keys, "left_anti"))
