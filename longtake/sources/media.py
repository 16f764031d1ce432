"""Listing recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

# Suffixes of recordings, and folder names that are never searched.
SUFFIXES = [
    "aac", "aif", "aiff", "alac", "avi", "flac", "m4a", "m4v", "mkv", "mov",
    "mp3", "mp4", "mpeg", "mpg", "ogg", "opus", "wav", "webm", "wma", "wmv",
]
EXCLUDED = [".git", "process", "output"]
FOLDER_TASKS = 64


def filter_media(listing: DataFrame, path: str = "path") -> DataFrame:
    """Keep recordings outside hidden and excluded folders; ``path`` is relative to the root."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(EXCLUDED))
    return listing.where(suffix.isin(SUFFIXES) & ~hidden)


_ENTRIES = "path string, relative string, length long, modificationTime timestamp, folder boolean"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each folder, whatever its name starts with."""
    from pyarrow import fs

    for batch in batches:
        for path, relative in zip(batch["path"], batch["relative"], strict=True):
            store, folder = fs.FileSystem.from_uri(path)
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            if found:
                yield pd.DataFrame(
                    {
                        "path": [f"{path.rstrip('/')}/{f.base_name}" for f in found],
                        "relative": [f"{relative}{f.base_name}" for f in found],
                        "length": [f.size or 0 for f in found],
                        "modificationTime": pd.to_datetime([f.mtime_ns for f in found], utc=True).floor("us"),
                        "folder": [f.type == fs.FileType.Directory for f in found],
                    }
                )


def list_media(spark: SparkSession, root: str) -> DataFrame:
    """``(path, relative, length, modificationTime)`` below ``root``, in case-folded order.

    Folders are listed level by level, each level by many tasks; no file is opened. Spark's own
    file sources leave out names that start with an underscore, so they are not used here.
    """
    found = spark.createDataFrame([], _ENTRIES)
    level = spark.createDataFrame([(root, "")], "path string, relative string")
    while True:
        listed = stage(level.mapInPandas(_entries, _ENTRIES))
        found = found.union(listed.where("not folder"))
        name = F.regexp_extract("relative", r"([^/]*)$", 1)
        inner = listed.where(F.col("folder") & ~name.startswith(".") & ~name.isin(EXCLUDED))
        level = inner.select("path", F.concat("relative", F.lit("/")).alias("relative")).repartition(FOLDER_TASKS)
        if inner.isEmpty():
            break
    kept = filter_media(found, "relative").select("path", "relative", "length", "modificationTime")
    return kept.orderBy(F.lower("relative"), "relative")
