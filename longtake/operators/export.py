"""Files of finished recordings by named renderers, published all or nothing per recording and name.

A renderer is a function from one part of a recording (its cues in order) to text. It runs inside
tasks; one that fails takes neither the other renderers nor other recordings with it. Files are
written under a name of their own attempt and moved into place when the whole job has come through,
so a lost executor, a task that runs twice or a job that ends early leaves no half file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship, stage

PART_CUES = 1000
_MANIFEST = "job_id string, renderer string, parts long, bytes long, path string"

# (job_id, part_no, [(start, end, text), …]) -> text
Renderer = Callable[[object, int, list[tuple[float, float, str]]], str]


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _FileWriter(DataSourceWriter):
    """Rows (name, job_id, renderer, part_no, content), all of one file in one task and in order."""

    def __init__(self, options: dict) -> None:
        self.path, self.attempt = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{root}/_attempt-{self.attempt}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done, name, out, entry = _Written(), None, None, None
        try:
            for row in iterator:
                if row.name != name:
                    if out is not None:
                        out.close()
                    name, temporary = row.name, f"{folder}/{len(done.files)}"
                    out = store.open_output_stream(temporary)
                    entry = {"job_id": row.job_id, "renderer": row.renderer, "parts": 0, "bytes": 0, "path": name, "temporary": temporary}
                    done.files.append(entry)
                data = row.content.encode()
                out.write(data)
                entry["parts"] += 1
                entry["bytes"] += len(data)
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        entries = [e for m in messages if m is not None for e in m.files]
        for folder in {f"{root}/{e['path']}".rpartition("/")[0] for e in entries}:
            store.create_dir(folder, recursive=True)
        for e in entries:
            target = f"{root}/{e['path']}"
            if store.get_file_info(target).type == fs.FileType.File:
                store.delete_file(target)  # moving does not replace in every store
            store.move(e.pop("temporary"), target)
        store.create_dir(f"{root}/_published", recursive=True)
        with store.open_output_stream(f"{root}/_published/{self.attempt}.json") as out:
            for e in entries:
                out.write((json.dumps(e) + "\n").encode())
        self._drop(store, root)

    def abort(self, messages: list) -> None:
        self._drop(*fs.FileSystem.from_uri(self.path))

    def _drop(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_attempt-{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_attempt-{self.attempt}")


class RenderedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rendered_files"

    def schema(self) -> str:
        return "name string, job_id string, renderer string, part_no long, content string"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options)


@dataclass
class Export:
    """``published(job_id, renderer, parts, bytes, path)`` and ``failed(job_id, renderer, part_no, error)``."""

    published: DataFrame
    failed: DataFrame


class Renderers:
    """Renderers by name; the name is also the ending of the files."""

    def __init__(self) -> None:
        self.known: dict[str, Renderer] = {}

    def add(self, name: str, renderer: Renderer) -> Renderers:
        self.known[name] = renderer
        return self

    def _rendered(self, parts: DataFrame) -> DataFrame:
        known = self.known

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    content, error = None, None
                    try:
                        content = known[row.renderer](row.job_id, row.part_no, [(c["start"], c["end"], c["text"]) for c in row.cues])
                        if not isinstance(content, str):
                            content, error = None, "renderer gave no text"
                    except Exception as problem:
                        error = f"{type(problem).__name__}: {problem}"
                    out.append((row.job_id, row.renderer, row.part_no, content, error))
                yield pd.DataFrame(out, columns=["job_id", "renderer", "part_no", "content", "error"], dtype=object)

        return parts.mapInPandas(run, "job_id string, renderer string, part_no long, content string, error string")

    def export(self, cues: DataFrame, path: str, only: DataFrame | None = None) -> Export:
        """Render ``cues(job_id, cue_no, start, end, text)`` by every renderer into ``path/<job>.<name>``.

        A recording of which any part fails in a renderer is listed in ``failed`` and keeps the file
        it had before; pass ``failed`` as ``only`` to render just those again. Without cues there is no file.
        """
        spark = cues.sparkSession
        ship(spark)
        spark.dataSource.register(RenderedFiles)
        part = F.floor(F.col("cue_no") / PART_CUES).cast("long")
        cue = F.struct("cue_no", "start", "end", "text")
        parts = cues.groupBy(F.col("job_id").cast("string").alias("job_id"), part.alias("part_no")).agg(F.sort_array(F.collect_list(cue)).alias("cues"))
        parts = parts.withColumn("renderer", F.explode(F.array(*[F.lit(n) for n in self.known])))
        if only is not None:
            parts = parts.join(only.select("job_id", "renderer").distinct(), ["job_id", "renderer"], "left_semi")
        rendered = stage(self._rendered(parts))
        failed = rendered.where("error is not null").select("job_id", "renderer", "part_no", "error")
        whole = rendered.join(failed.select("job_id", "renderer").distinct(), ["job_id", "renderer"], "left_anti")
        name = F.concat(F.regexp_replace("job_id", r"[^A-Za-z0-9._-]+", "_"), F.lit("."), F.col("renderer"))
        files = whole.select(name.alias("name"), "job_id", "renderer", "part_no", "content")
        placed = files.repartition(spark.sparkContext.defaultParallelism * 4, "name").sortWithinPartitions("name", "part_no")
        before = _manifests(spark, path)
        placed.write.format("rendered_files").mode("append").save(path)
        new = sorted(_manifests(spark, path) - before)
        published = spark.read.schema(_MANIFEST).json(new) if new else spark.createDataFrame([], _MANIFEST)
        return Export(published, failed)


def _manifests(spark: SparkSession, path: str) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().toString() for s in store.listStatus(folder)} if store.exists(folder) else set()
