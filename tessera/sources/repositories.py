"""Repositories below a root: a breadth-first listing whose frontier is a table, listed in tasks.

Each level is one job: tasks list the folders of the frontier, keep what they find out about
repositories and hand on the folders below.  The driver sees neither folders nor files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import settle

_REF = re.compile(r"ref: ([A-Za-z0-9._/-]+)")
_LISTED = "folder string, head string, is_repository boolean"


def _text(files: fs.FileSystem, path: str) -> str | None:
    """A small metadata file without blanks at its ends; None if there is none."""
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as stream:
        return stream.read().decode("utf-8", "replace").strip()


def head_of(files: fs.FileSystem, git: str) -> str | None:
    """What HEAD stands for: its loose ref, else its packed one, else the text of HEAD itself; None without HEAD."""
    head = _text(files, f"{git}/HEAD")
    found = _REF.fullmatch(head or "")
    if not found or any(part in ("", "..") for part in found[1].split("/")):
        return head
    loose = _text(files, f"{git}/{found[1]}")
    if loose is not None:
        return loose
    for line in (_text(files, f"{git}/packed-refs") or "").split("\n"):
        parts = line.split()
        if len(parts) >= 2 and not line.startswith(("#", "^")) and parts[1] == found[1]:
            return parts[0]
    return head


def read_repositories(spark: SparkSession, root: str, excluded_folders: tuple[str, ...] = ()) -> DataFrame:
    """(path, head, fingerprint) of all git repositories at or below ``root``, at any depth, nested ones included.

    ``root`` is a path or URI that Arrow's file systems know (local, hdfs, s3, gs); executors must reach it.  Folders named in
    ``excluded_folders`` and ``.git`` itself are not entered; links are not followed.  The fingerprint is the SHA-256 of path, NUL and
    commit (empty without HEAD).  A folder that vanishes while it is listed counts as empty.
    """
    start = fs.FileSystem.from_uri(root)[1] if "://" in root else root
    uri = root if "://" in root else None
    skipped = {".git", *excluded_folders}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(uri)[0] if uri else fs.LocalFileSystem()
        local = isinstance(files, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                out = []
                try:
                    entries = files.get_file_info(fs.FileSelector(folder))
                except FileNotFoundError:
                    entries = []
                for entry in entries:
                    if entry.type != fs.FileType.Directory:
                        continue
                    if entry.base_name == ".git":
                        out.append((folder, head_of(files, entry.path), True))
                    elif entry.base_name not in skipped and not (local and _is_link(entry.path)):
                        out.append((entry.path, None, False))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i < 2 else pa.array(c, pa.bool_()) for i, c in enumerate(zip(*out, strict=True))], schema=_schema)

    _schema = pa.schema([("folder", pa.string()), ("head", pa.string()), ("is_repository", pa.bool_())])
    frontier = spark.createDataFrame([(start.rstrip("/") or "/",)], "folder string")
    found = None
    while True:
        level = settle(frontier.repartition("folder").mapInArrow(listed, _LISTED))
        repositories = level.where("is_repository").select("folder", "head")
        found = repositories if found is None else found.unionByName(repositories)
        frontier = level.where("NOT is_repository").select("folder")
        if frontier.isEmpty():
            break
    commit = F.coalesce("head", F.lit(""))
    return found.select(F.col("folder").alias("path"), "head", F.sha2(F.concat("folder", F.lit("\x00"), commit), 256).alias("fingerprint"))


def _is_link(path: str) -> bool:
    import os

    return os.path.islink(path)


def fingerprint_of(path: str, head: str | None) -> str:
    """The fingerprint of one repository, as ``read_repositories`` makes it."""
    return hashlib.sha256(f"{path}\0{head or ''}".encode()).hexdigest()
